"""Quality rules: base counts, and the divergence of a document's histograms from its language's, natively.

Two histograms describe a document: the characters of its words by class, and its words by the common words of its
language (all other words are one class). Words with digits or an @ stay out of the first, so that numbers and addresses,
which clean texts may hold, don't count against them. Each language's reference is the mean histogram of its documents that pass the base rules and
the length guard. A document is rejected when the Jensen-Shannon distance (base two, 0 to 1) of either histogram exceeds
its limit. Documents shorter than a guard are not judged by that histogram, as short texts diverge by chance.

Edge cases: a null or empty text has no words and fails the base rules; a null or unknown language is ``other``, judged by
characters only; a language without a reference (no document passes) judges nobody; repeated rows are judged alike; an
empty table gives no rows; columns besides id, text and language are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltern.llm.common import SPACE_PATTERN, stage

#: Very common words of each language. Any other language shares one reference by characters alone.
COMMON = {
    "de": "auf das dem den der des die ein eine im in ist mit nicht sich und von zu".split(),
    "en": "a an and are as at be by for from in is it of on or that the this to was with".split(),
    "es": "con de del el en es la las los no por que se su un una y".split(),
    "fr": "au avec dans de des du en est et la le les par pour que qui sur un une".split(),
}
OTHER = "other"
#: Character classes; what none holds is the last class.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "stop": r"[.,;:?'\"()-]", "shout": "!"}
NUMERIC = "[0-9@]"
SYMBOLS = r"[#*$%&|<>]"

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Guards: characters and words below which a histogram isn't judged.
GUARD_CHARS, GUARD_WORDS = 200, 50
#: Limits of the Jensen-Shannon distances, and the wide ones by which documents may enter the final reference.
LIMIT_CHARS, LIMIT_WORDS = 0.13, 0.5
WIDE_CHARS, WIDE_WORDS = 0.24, 0.5


def _covered(marks: Column) -> Column:
    """Words covered by the 3-word windows that start at the ascending ``marks``."""
    gaps = F.zip_with(marks, F.slice(marks, F.lit(2), F.greatest(F.size(marks), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: bool = False) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, n_chars (those judged), and the two histograms (counts as doubles).

    ``carry`` keeps the whole row as ``_row``.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    keep = ["_row"] if carry else []
    lang = F.when(F.col(lang_col).isin(*COMMON), F.col(lang_col)).otherwise(OTHER)
    t = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *row)
    t = t.withColumn("words", F.array_remove(F.split("text", SPACE_PATTERN, -1), ""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    plain = F.when(F.rlike("text", F.lit(NUMERIC)), F.filter("words", lambda w: ~F.rlike(w, F.lit(NUMERIC)))).otherwise(F.col("words"))
    every = sorted({w for words in COMMON.values() for w in words})
    known = F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(*every))
    n = F.size("words")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
    t = t.select(
        *keep,
        "doc_id",
        "lang",
        n.alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        grams.alias("grams"),
        F.array_join(plain, "").alias("plain"),
        # two spaces, so that each word has its own on either side
        F.concat(F.lit(" "), F.array_join(known, "  "), F.lit(" ")).alias("padded"),
    )
    # most letters are small ones: what remains without them is short, and the other classes are counted there
    small = next(iter(CLASSES.values()))
    t = t.withColumn("n_chars", F.length("plain")).withColumn("plain", F.regexp_replace("plain", f"(?:{small})+", ""))
    # only texts with an equal pair of windows need their places
    pairs = F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    t = t.withColumn("sorted", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(pairs)))
    common = F.create_map(*[x for k, words in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, words)))])
    t = t.withColumn("common", F.coalesce(common[F.col("lang")], F.array().cast("array<string>")))
    # neighbours in the order of hashes tell which windows occur twice
    twice = F.transform("sorted", lambda x, j: F.when((x["h"] == F.get("sorted", j - 1)["h"]) | (x["h"] == F.get("sorted", j + 1)["h"]), x["i"]))
    t = t.withColumn("marks", F.sort_array(F.array_compact(twice)))
    others = [F.regexp_count("plain", F.lit(p)) for p in list(CLASSES.values())[1:]]
    classes = F.array((F.col("n_chars") - F.length("plain")).cast("double"), *[c.cast("double") for c in others])
    found = F.transform("common", lambda w: ((F.octet_length("padded") - F.octet_length(F.replace("padded", F.concat(F.lit(" "), w, F.lit(" "))))) / (F.octet_length(w) + 2)).cast("double"))
    t = t.select(
        *keep,
        "doc_id",
        "lang",
        "n_chars",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.when(F.col("marks").isNull(), 0).otherwise(_covered(F.col("marks"))).cast("long").alias("n_repeat_words"),
        classes.alias("classes"),
        found.alias("found"),
    )
    rest = lambda c, total: F.aggregate(c, total.cast("double"), lambda s, x: s - x)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    values = [
        *[F.col(c) for c in t.columns if c not in ("_row", "classes", "found")],
        failed.alias("base_failed"),
        F.concat("classes", F.array(rest("classes", F.col("n_chars")))).alias("char_counts"),
        F.concat("found", F.array(rest("found", F.col("n_words")))).alias("word_counts"),
    ]
    # as a generator's output, so that no filter on them is pushed below and computes them once more for each use
    return t.select(*keep, F.inline(F.array(F.struct(*values))))


def references(found: DataFrame) -> DataFrame:
    """(lang, char_ref, word_ref): each language's mean histograms; at most one row for each language of ``COMMON`` and one."""
    usable = found.where(~F.col("base_failed") & (F.col("n_chars") >= GUARD_CHARS) & (F.col("n_words") >= GUARD_WORDS))
    share = lambda c, n: F.transform(c, lambda x: x / F.col(n))
    shares = usable.select("lang", share("char_counts", "n_chars").alias("c"), share("word_counts", "n_words").alias("w"))
    widest = max(len(w) for w in COMMON.values()) + 1
    mean = lambda c, k: F.avg(F.get(F.col(c), F.lit(k)))
    means = shares.groupBy("lang").agg(
        F.array(*[mean("c", k) for k in range(len(CLASSES) + 1)]).alias("char_ref"),
        F.array_compact(F.array(*[mean("w", k) for k in range(widest)])).alias("word_ref"),
    )
    return means


def distance(counts: Column, total: Column, ref: Column) -> Column:
    """Jensen-Shannon distance, base two, of a count histogram and a reference of shares."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(counts, ref, lambda c, q: F.struct((c / total).alias("p"), q.alias("q")))
    sums = F.aggregate(terms, F.lit(0.0), lambda s, t: s + (part(t["p"], (t["p"] + t["q"]) / 2) + part(t["q"], (t["p"] + t["q"]) / 2)) / 2)
    return F.sqrt(F.greatest(sums, F.lit(0.0)))


def judge(found: DataFrame, refs: DataFrame, limit_chars: float = LIMIT_CHARS, limit_words: float = LIMIT_WORDS) -> DataFrame:
    """``found`` with char_distance, word_distance (null: not judged) and kept."""
    # the references are at most five rows, by ``references``
    own = refs.select(F.col("lang").alias("_lang"), "char_ref", "word_ref")
    t = found.join(F.broadcast(own), F.col("lang") == F.col("_lang"), "left")
    chars = F.when(F.col("n_chars") >= GUARD_CHARS, distance(F.col("char_counts"), F.col("n_chars"), F.col("char_ref")))
    words = F.when((F.col("n_words") >= GUARD_WORDS) & (F.col("lang") != OTHER), distance(F.col("word_counts"), F.col("n_words"), F.col("word_ref")))
    t = t.withColumn("char_distance", chars).withColumn("word_distance", words)
    far = F.coalesce(F.col("char_distance") > limit_chars, F.lit(False)) | F.coalesce(F.col("word_distance") > limit_words, F.lit(False))
    return t.withColumn("kept", ~F.col("base_failed") & ~far).drop("_lang", "char_ref", "word_ref")


def final_references(found: DataFrame) -> DataFrame:
    """The references that decide, from the staged features of all documents.

    A first reference, of all documents that pass the base rules, leaves out those far from it; the second is of the
    rest. So junk doesn't shape what it is compared with.
    """
    near = judge(found, references(found), WIDE_CHARS, WIDE_WORDS).where("kept").select(*found.columns)
    return references(near)


def assess(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, distances and verdict; the features are staged, so texts are read once."""
    found = stage(features(docs), "quality")
    return judge(found, final_references(found))


def report(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("char_distance", "word_distance")])


def kept_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected documents, all columns as they are.

    The features are staged beside the rows they judge: a copy of the table on disk costs far less than computing them
    again, texts never shuffle, and the references read the feature columns alone.
    """
    rows = stage(features(docs, carry=True), "quality")
    refs = stage(final_references(rows.drop("_row")), "references")
    return judge(rows, refs).where("kept").select("_row.*")
