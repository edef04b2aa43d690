"""Main text of web pages by deducing each host's template from equivalence classes of its tokens.

A page is cut into tags and texts. A tag is told apart by the elements that are open around it, so the same tag in the
menu and in the article are different tokens. Per host, a token's occurrence vector says how often each page has it.
Tokens with one vector form an equivalence class; the vectors are folded into order-free sums, so Spark adds them up
before its shuffle and no host is ever held whole. A class is valid if at least ``SUPPORT`` of the host's pages have it;
valid classes nest by the elements around their tokens and make the template, whose places between tokens are the slots.
A class that nearly all its pages have once is part of the page's frame; one they have in varying numbers is a list.

The template decides on every page which of its slots are main. First come places of the frame that are an ``article`` or
``main``; articles of a list beside them (comments, teasers) go if they are shorter on average, and an article that the
template doesn't know stays. Where the frame has no article on the page, a place of the frame whose text varies wins over other articles if it has more text
outside links than one of these, by means over the host; without any article it is the page's slot with most such text.
Slots whose elements, or their classes, name a menu, header, footer, sidebar, notice, advert, form or reader comments are
never main. All other text of an article stays, also what pages share. On pages without one, a slot inside the chosen one
whose text is the same on nearly all pages (three at least) of a host whose pages differ belongs to the template and goes.
Hosts without a valid class (a single page, say) follow the names alone.

Blocks are the texts between block tags; white space inside becomes one space, character references are decoded.

Edge cases: a null page is empty and has no text; broken markup (unclosed or cut tags) is read up to its end; a null url
is a host of its own; repeated rows give a row each; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltern.llm.common import stage

SUPPORT = 0.5
NEARLY_ALL = 0.9
#: Templates are broadcast up to this many bytes; beyond it they meet the pages in a salted join.
BROADCAST_BYTES, SALTS = 16 << 20, 32

#: Fixed values of HTML: elements whose content is no text, elements without content, and inline elements.
RAW = {"script", "style", "noscript", "template", "svg", "textarea", "iframe", "object", "math", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = set("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that make places; paragraphs and inline elements don't.
STRUCTURE = set("article aside body details dialog div dl fieldset figure footer form head header main menu nav ol section select table title ul".split())
NOT_MAIN = {"aside", "button", "dialog", "fieldset", "footer", "form", "head", "header", "menu", "nav", "select", "title"}
NAMES = re.compile(r"(?:ad|ads|adsbygoogle|advert\w*|adbox|banner|breadcrumbs?|byline|comments?|consent|cookies?|copyright|disqus|footer|foot|form|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|notification|pager|pagination|popup|promo\w*|recommended|related|replies|reply|respond|search|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|subscription|tags|toolbar|topbar|tracking|widget)", re.I)
#: What may follow a name in a class of several parts, as in share-bar, and what before one only states a layout, as in has-sidebar.
BOXES = re.compile(r"(?:area|articles|bar|block|body|bottom|box|button|buttons|container|content|field|form|group|icons?|inner|items?|left|link|links|list|panel|posts|right|row|section|slot|stories|text|threads?|top|unit|wrap|wrapper|\d\w*)", re.I)
STATES = re.compile(r"(?:has|have|hide|is|no|non|show|with|without)", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z](?>[^>\"'=]++|=\s*+(?>\"[^\"]*\"|'[^']*'|[^>\s\"'][^>\s]*+)?|[\"'])*+>|[^<]+|<", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_DIGITS = re.compile(r"\d+")
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}

STATS = "host string, path string, pages long, tokens long, vector long, single long, chars long, linked long, low long, high long"


def slots(html: str) -> tuple[list[tuple[str, str, bool]], Counter]:
    """The texts as (path, text, in a link), with a None path for each block edge; and how often each token occurs.

    The token of an element that makes a place is its path and ``>``; numbers in class names and ids count as one.
    """
    texts: list[tuple[str, str, bool]] = []
    tokens: Counter = Counter()
    stack: list[tuple[str, str]] = []
    path, links, at, end = "", 0, 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        piece = m[0]
        if piece == "<" and (html[at : at + 1].isalpha() or html[at : at + 1] == "/"):  # a cut tag
            break
        if piece[0] != "<" or len(piece) == 1:
            texts.append((path, piece, links > 0))
            continue
        t = _TAG.match(piece)
        if t is None:
            continue
        close, tag = t[1], t[2].lower()
        if tag in RAW and not close:
            if not piece.endswith("/>"):
                done = _CLOSE[tag].search(html, at)
                at = done.end() if done else end
            tokens[f"{path}>{tag}"] += 1
            continue
        if close or tag not in STRUCTURE or piece.endswith("/>"):
            tokens[f"{path}>{close}{tag}"] += 1
        if tag == "a":
            links = 0 if close else 1
        if tag not in INLINE:
            texts.append((None, "", False))
        if tag == "p" and not close and stack and stack[-1][0] == "p":  # paragraphs don't nest
            stack.pop()
            path = "/".join(f"{a}[{b}]" if b else a for a, b in stack)
        marks = ""
        if tag not in STRUCTURE and tag not in VOID:
            # other elements make a place of their own where a name says that they are no main text, and what is open of
            # the same kind inside them is counted by entries without a name
            within = any(a == tag for a, _ in stack)
            marks = "" if close else " ".join(v for x in _MARK.finditer(piece) if (v := x[2] or x[3] or x[4]))
            if not (within if close or within else any(map(names_box, marks.split()))):
                continue
        if tag not in VOID:
            if close:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if tag not in STRUCTURE and stack[k][0] in STRUCTURE:
                        break
            elif not piece.endswith("/>"):
                marks = marks or " ".join(v for x in _MARK.finditer(piece) if (v := x[2] or x[3] or x[4]))
                stack.append((tag, _DIGITS.sub("0", marks)))
            path = "/".join(f"{a}[{b}]" if b else a for a, b in stack)
            if tag in STRUCTURE and not close and not piece.endswith("/>"):
                tokens[f"{path}>"] += 1
            links = 0
    return texts, tokens


@lru_cache(maxsize=4096)
def names_box(mark: str) -> bool:
    """Whether a class, id or role names a box that isn't main text: its last part, or its first with only box words after."""
    parts = [p for p in re.split("[_-]+", mark) if p]
    if not parts or STATES.fullmatch(parts[0]):
        return False
    return bool(NAMES.fullmatch(parts[-1]) or (NAMES.fullmatch(parts[0]) and all(BOXES.fullmatch(p) for p in parts[1:])))


def named_out(path: str) -> bool:
    """Whether an element of the path, by tag or by class, id or role, is none of the main text's; ``body`` goes by no name.

    A header element is left out wherever it stands, with a headline that an article has in it.
    """
    for part in path.split("/"):
        tag, _, marks = part.partition("[")
        if tag in NOT_MAIN or (tag != "body" and any(map(names_box, marks[:-1].split()))):
            return True
    return False


def article_of(path: str) -> str:
    """The path's outermost article or main element, or nothing."""
    parts = path.split("/")
    for k, part in enumerate(parts):
        if part.partition("[")[0] in ("article", "main"):
            return "/".join(parts[: k + 1])
    return ""


def host(url: str | None) -> str:
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", url or "")
    return (m[1] if m else url or "").rsplit("@", 1)[-1].lower()


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)))


def _signed(x: int) -> int:
    return (x & (1 << 64) - 1) - ((x & 1 << 63) << 1)


def token_statistics(pages: DataFrame) -> DataFrame:
    """Per host and token: pages that have it, occurrences, the folded vector, pages that have it once; per slot, its texts' size and sameness."""

    def stats(batches):
        for b in batches:
            rows: dict[tuple[str, str], list] = {}
            for page, url, html in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                h = host(url)
                texts, tokens = slots(html)
                said: dict[str, list] = {}
                for path, text, linked in texts:
                    if path is not None and text.strip():
                        s = said.setdefault(path, [0, 0, []])
                        n = len(text)
                        s[0] += n
                        s[1] += n * linked
                        s[2].append(text)
                for token, n in tokens.items():
                    r = rows.setdefault((h, token), [0, 0, 0, 0, 0, 0, None, None])
                    r[0] += 1
                    r[1] += n
                    r[2] += _hash(page, n) >> 32  # sums of 32 bits hold two billion pages of a host
                    r[3] += n == 1
                r = rows.setdefault((h, ""), [0, 0, 0, 0, 0, 0, None, None])
                r[0] += 1
                for path, (n, linked, parts) in said.items():
                    r = rows.setdefault((h, f"{path}#"), [0, 0, 0, 0, 0, 0, None, None])
                    r[0] += 1
                    r[4] += n
                    r[5] += linked
                    same = _signed(_hash(" ".join("".join(parts).split())))
                    r[6] = same if r[6] is None else min(r[6], same)
                    r[7] = same if r[7] is None else max(r[7], same)
            keys = list(rows)
            values = [rows[k] for k in keys]
            cols = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys])]
            cols += [pa.array([v[k] for v in values], pa.int64()) for k in range(8)]
            yield pa.RecordBatch.from_arrays(cols, names=["host", "path", "pages", "tokens", "vector", "single", "chars", "linked", "low", "high"])

    parts = pages.mapInArrow(stats, STATS)
    add = [F.sum(c).alias(c) for c in ("pages", "tokens", "vector", "single", "chars", "linked")]
    return parts.groupBy("host", "path").agg(*add, F.min("low").alias("low"), F.max("high").alias("high"))


def templates(stats: DataFrame) -> DataFrame:
    """(host, own, places): each host's slots, and the places of its valid classes with how often its pages have them."""
    pages = stats.where("path = ''").select(F.col("host").alias("h"), F.col("pages").alias("host_pages"))
    t = stats.where("path <> ''").join(pages, F.col("host") == F.col("h")).drop("h")
    # a class: the tokens of a host with one vector; it is valid if enough pages have it
    token = t.where(~F.col("path").endswith("#"))
    classes = token.groupBy("host", "vector", "tokens", "pages", "host_pages", "single").agg(F.collect_set("path").alias("members"))
    valid = classes.where((F.col("pages") >= 2) & (F.col("pages") >= SUPPORT * F.col("host_pages")))
    opened = valid.select("host", "tokens", (F.col("single") >= NEARLY_ALL * F.col("pages")).alias("once"), F.explode("members").alias("token")).where(F.col("token").endswith(">"))
    place = F.struct(F.expr("substring(token, 1, length(token) - 1)").alias("place"), "tokens", "once")
    places = opened.groupBy("host").agg(F.collect_list(place).alias("places"))
    slot = t.where(F.col("path").endswith("#")).select("host", F.expr("substring(path, 1, length(path) - 1)").alias("slot"), "pages", "chars", "linked", (F.col("low") == F.col("high")).alias("constant"))
    own = slot.groupBy("host").agg(F.collect_list(F.struct("slot", "pages", "chars", "linked", "constant")).alias("own"))
    return own.join(places, "host", "left")


class Slot(NamedTuple):
    """A slot that may be main: its text's size, and what the template says of it.

    ``article``: its outermost article, if any, of which ``size`` tells what one has on average. ``frame``: its place (the
    article's, for one in an article) is one that nearly all pages of its class have once; ``listed``: they have it in varying numbers.
    """

    article: str
    frame: bool
    listed: bool
    varies: bool
    placed: bool
    size: float


def nesting(places: Iterable[str]) -> dict[str, str]:
    """The template: each place with the nearest of the others around it, or nothing."""
    known = set(places)
    out = {}
    for p in known:
        up = p.rpartition("/")[0]
        while up and up not in known:
            up = up.rpartition("/")[0]
        out[p] = up
    return out


def main_slots(own: list, places: list | None) -> dict[str, Slot | None]:
    """What the template says of each of a host's slots; None for those that are named as no main text."""
    bare = lambda p: re.sub(r"\[[^\]]*\]", "", p).strip("/")
    of = {p["place"]: p for p in places or ()}
    template = nesting(of)
    layout = {bare(p) for p in template}
    # a place is of the frame if it and all places around it are
    frame: dict[str, bool] = {}
    for p in sorted(template, key=len):
        frame[p] = of[p]["once"] and frame.get(template[p], True)
    free = [s for s in own if not named_out(s["slot"])]
    out: dict[str, Slot | None] = {s["slot"]: None for s in own}
    # the same on nearly all pages of a host whose pages differ; the most frequent slot stands for the host's pages
    all_pages, differ = max((s["pages"] for s in own), default=0), any(not s["constant"] for s in own)
    same = {s["slot"] for s in own if differ and s["constant"] and s["pages"] >= max(3, NEARLY_ALL * all_pages)}
    inside: dict[str, list] = {}
    for s in free:
        if a := article_of(s["slot"]):
            held = inside.setdefault(a, [0, 0])
            held[0] += s["chars"] - s["linked"]
            held[1] = max(held[1], s["pages"])
    for s in free:
        p = s["slot"]
        if a := article_of(p):
            times = of[a]["tokens"] if a in of else inside[a][1]
            out[p] = Slot(a, frame.get(a, False), not frame.get(a, True), p not in same, a in of, inside[a][0] / times)
        else:  # the mean size of the text that isn't linked decides
            out[p] = Slot("", frame.get(p, False), not frame.get(p, True), p not in same, not layout or bare(p) in layout, (s["chars"] - s["linked"]) / s["pages"])
    return out


def chosen(shown: set[str], main: dict[str, Slot | None]) -> tuple[set[str], str | None]:
    """Of a page's slots the main ones in articles, or none and the best of the others."""
    own = {p: s for p in shown if (s := main.get(p))}
    articles = {p for p in shown if article_of(p) and not named_out(p)}
    if framed := [s.size for s in own.values() if s.article and s.frame]:
        return {p for p in articles if p not in own or not own[p].listed or own[p].size > max(framed)}, None
    others = {p: s for p, s in own.items() if not s.article}
    if articles:
        rivals = {p: s for p, s in others.items() if s.frame and s.varies}
        best = max(rivals, key=lambda p: (rivals[p].size, p), default=None)
        most = max((own[p].size if p in own else float("inf") for p in articles), default=0.0)
        return (set(), best) if best is not None and rivals[best].size > most else (articles, None)
    return set(), max(others, key=lambda p: (others[p].varies, others[p].placed, others[p].size, p), default=None)


def page_text(html: str, main: dict[str, Slot | None] | None) -> str:
    """The blocks of the main slots, in page order; a page chooses among its own slots, so a host can have any number of layouts."""
    texts, _ = slots(html)
    shown = {p for p, text, _ in texts if p is not None and text.strip()}
    articles, best = chosen(shown, main or {})
    out: list[str] = []
    for path, text, _ in texts:
        if path is None:
            out.append(" ")
            continue
        if articles:
            verdict = path in articles
        elif main and path in main:
            s = main[path]
            verdict = s is not None and (path == best or (best is not None and path.startswith(best + "/") and s.varies))
        else:
            verdict = not named_out(path) and (best is None or path.startswith(best))
        if verdict:
            out.append(unescape(text))
        elif out and out[-1] != " ":
            out.append(" ")
    return " ".join("".join(out).split())


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    # staged, as a template looks at the tokens three times
    found = stage(templates(stage(token_statistics(rows), "tokens")), "templates")
    size = found.agg(F.sum(F.size("own") * 64 + F.length(F.to_json("own")) + F.length(F.coalesce(F.to_json("places"), F.lit(""))))).first()[0] or 0
    schema = "page_id long, url string, text string, n_chars long"

    def texts(b: pa.RecordBatch, main_of) -> pa.RecordBatch:
        out = [page_text(h, main_of(i, u)) for i, (u, h) in enumerate(zip(b["url"].to_pylist(), b["html"].to_pylist(), strict=True))]
        return pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if size <= broadcast_bytes:
        held = rows.sparkSession.sparkContext.broadcast({r["host"]: main_slots(r["own"], r["places"]) for r in found.collect()})

        def by_lookup(batches):
            for b in batches:
                yield texts(b, lambda _, u: held.value.get(host(u)))

        return rows.mapInArrow(by_lookup, schema)

    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#@]*)"
    of = F.when(F.coalesce("url", F.lit("")).rlike(pattern), F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), pattern, 1))).otherwise(F.lower(F.coalesce("url", F.lit(""))))
    salted = rows.withColumn("_host", of).withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    copies = found.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(copies, (F.col("_host") == F.col("host")) & (F.col("_salt") == F.col("_s")), "left").select("page_id", "url", "html", "own", "places")

    def by_row(batches):
        for b in batches:
            own, places = b["own"].to_pylist(), b["places"].to_pylist()
            yield texts(b, lambda i, _: main_slots(own[i], places[i]) if own[i] else None)

    return joined.mapInArrow(by_row, schema)
