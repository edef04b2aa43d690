import html as lib
import random
import re

import pyarrow.parquet as pq

from saltern.llm import html

SF = "/root/testdata/sf0.01"


def plain(fragment):
    """The text of an article by rules of its own: inline tags vanish, all others part blocks."""
    t = re.sub(r"</?(?:b|i|a|em|strong|span)(?:\s[^>]*)?>", "", fragment)
    return " ".join(lib.unescape(re.sub(r"<[^>]*>", " ", t)).split())


def test_whole_tables_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    want = {r["page_id"]: plain(re.search(r"<article>(.*)</article>", r["html"], re.S)[1]) for r in rows}
    for size in (html.BROADCAST_BYTES, 0):
        got = html.extract(pages, size).collect()
        assert {r.page_id: r.text for r in got} == want
        assert all(r.n_chars == len(r.text) for r in got)


def page(rng, k, wrap):
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(999)) for _ in range(n))
    body = [words(rng.randrange(8, 60)) for _ in range(rng.randrange(2, 6))]
    title = words(4)
    inner = f"<h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in body[:1]) + f"<aside class='x'>{words(9)}</aside><div class='share-bar'>Share this</div><div class=\"fixed\">Read our other stories</div>" + "".join(f"<p>{b}</p>" for b in body[1:])
    out = f"<html><head><title>{title}</title><style>p{{}}</style><script>var a='<article>no</article>';</script></head><body><header><h2>{words(3)}</h2></header><nav><a href=/>{words(2)}</a></nav><div id=cookie-notice>{words(8)}</div>"
    out += wrap.format(inner) + f"<div class=sidebar>{words(30)}</div><form><label>{words(3)}</label><input></form><section id='comments'><article><p>{words(20)}</p></article></section><footer>&copy; {words(5)}</footer></body></html>"
    # an article keeps what its pages share; elsewhere that is the template's
    return out, " ".join([title, body[0], *(["Read our other stories"] if "<div" not in wrap else []), *body[1:]])


def test_templates_of_other_sites(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for site, wrap in enumerate(["<article>{}</article>", "<main class=content>{}</main>", "<div class='body-text'>{}</div>"]):
        for k in range(8):
            text, main = page(rng, k, wrap)
            rows.append((site * 100 + k, f"https://site{site}.example/{k}", text))
            want[site * 100 + k] = main
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as path", "'y' as text")
    for size in (html.BROADCAST_BYTES, 0):
        assert {r.page_id: r.text for r in html.extract(df, size).collect()} == want


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no scheme", "plain &amp; <b>bo</b>ld < 3"), (4, "http://h/", "<article>cut <p>off &lt;x&gt; y <a href='"), (5, "http://h/", "<article><p>one<br>two</p><!-- c --><p>th<i>r</i>ee</article>"), (5, "http://h/", "<article><p>one<br>two</p><!-- c --><p>th<i>r</i>ee</article>"), (6, "http://u@H:80/x", "<nav>only menu</nav>"), (7, "x", "<p title=don't class='a>b' x=\"'>\">it's</p> \"quoted\" 'n' more" + "<p a=b=c'" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in html.extract(df).collect())
    assert got == [(1, ""), (2, ""), (3, "plain & bold < 3"), (4, "cut off <x> y"), (5, "one two three"), (5, "one two three"), (6, ""), (7, "it's \"quoted\" 'n' more")]
    assert html.extract(df.where("false")).count() == 0


def test_hosts_with_several_layouts_lose_no_page(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(24):
        text, main = page(rng, k, ["<article>{}</article>", "<div class='post'>{}</div>", "<div class='doc'>{}</div>"][k % 3])
        text = text if k % 3 == 0 else re.sub(r"<div class=\"fixed\">.*?</div>", "", text)
        rows.append((k, "https://mixed.example/x", text))
        want[k] = main
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (html.BROADCAST_BYTES, 0):
        got = {r.page_id: r.text for r in html.extract(df, size).collect()}
        assert {k: got[k] for k in got if k % 3} == {k: want[k] for k in want if k % 3}
        assert all(want[k].split()[-1] in got[k] for k in want)


def test_articles_keep_what_pages_share(spark):
    shared = "<div class='intro'><p>Same intro text.</p></div>"
    for n in (2, 4, 40):
        rows = [(k, "https://one.example/x", f"<article><h1>T{k}</h1>{shared}<p>Body number {k} says {k * 7}.</p></article>") for k in range(n)]
        got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert {r.page_id: r.text for r in got} == {k: f"T{k} Same intro text. Body number {k} says {k * 7}." for k in range(n)}
    same = [(k, "https://two.example/x", f"<article><h1>T</h1>{shared}<div><p>Body.</p></div></article>") for k in range(3)]
    got = html.extract(spark.createDataFrame(same, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == ["T Same intro text. Body."] * 3


def test_names_count_for_boxes_alone(spark):
    keeps = ["<body class='has-sidebar'>{}</body>", "<body class='sidebar search no-comments'>{}</body>", "<div class='with-sidebar no-comments'>{}</div>", "<div class='form-of-art layout'>{}</div>"]
    rows = [(k, f"https://k{k}.example/", w.format(f"<article><p>Text {k}</p><div class='form-of-art'>of art</div><div class='ad-slot'>Buy</div><div id=related-posts>More</div></article>")) for k, w in enumerate(keeps)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: f"Text {k} of art" for k in range(len(keeps))}
    for mark in "share-bar cookie-notice site-header main-nav comments comments-area ad-300x250 newsletter-signup sidebar__inner top-banner".split():
        assert html.names_box(mark), mark
    for mark in "has-sidebar no-comments form-of-art post-body content article-text bottom-line heading adventure searching-for-meaning".split():
        assert not html.names_box(mark), mark


def test_names_count_on_articles_and_paragraphs():
    from saltern.llm.html import page_text

    story = '<div class="post"><h1>T</h1><p>The main story text here.</p></div>'
    cases = {
        story + '<div><article class="comment"><p>I disagree!</p></article></div>': "T The main story text here.",
        '<article><p>Story.</p><article class="comment">nice read</article></article>': "Story.",
        '<article><p>Story.</p><section class="comment-thread"><p>nice</p></section></article>': "Story.",
        story + '<article class="advert">buy</article><article class="promo">more</article>': "T The main story text here.",
        '<article><p>Story.</p><div class="adsbygoogle">x</div><p class="ad">buy <b>now</b></p><p>End.</p></article>': "Story. End.",
        '<article><p>One <span class="ad">a <span>b</span> c</span>two.</p><ul><li class="share">s</li><li>kept</li></ul></article>': "One two. kept",
        '<article><p class="ad">buy<p>Kept<p class="lead">and led</article>': "Kept and led",
        '<article class="post has-sidebar"><p class="text">All.</p></article>': "All.",
        '<article><p class="ad">open <p>two</p></p><p>three</p></article><footer>f</footer>': "two three",
    }
    for html, want in cases.items():
        assert page_text(html, None) == want, html


def test_the_template_decides_on_pages_with_articles(spark):
    words = lambda k, n, w: " ".join(f"{w}{k}x{j}" for j in range(n))
    rows, want = [], {}
    for k in range(12):
        # comments in articles without a telling name: a list, as their number varies; the story is in the host's frame
        list_of = "".join(f"<article class='c{j}'><p>{words(k, 4, 'reply')}</p></article>" for j in range(k % 4))
        rows.append((k, "https://a.example/x", f"<body><div class='col'><article class='s{k}'><h1>T{k}</h1><p>{words(k, 40, 'w')}</p></article></div><div class='below'>{list_of}</div></body>"))
        want[k] = f"T{k} {words(k, 40, 'w')}"
        # the story is no article, but a box of the frame
        rows.append((100 + k, "https://b.example/x", f"<body><div class='story'><h1>T{k}</h1><p>{words(k, 40, 'w')}</p></div><div class='below'>{list_of}</div></body>"))
        want[100 + k] = want[k]
        # one page embeds an article that the template doesn't know; longer ones of a list stay beside a short one of the frame
        stray = f"<div class='card'><article><p>{words(k, 4, 'stray')}</p></article></div>" if k == 5 else ""
        rows.append((200 + k, "https://c.example/x", f"<body><div class='story'><p>{words(k, 40, 'w')}</p></div>{stray}</body>"))
        want[200 + k] = words(k, 40, "w")
        parts = [f"<article><p>{words(k, 30, f'part{j}y')}</p></article>" for j in range(1 + k % 3)]
        rows.append((300 + k, "https://d.example/x", f"<body><div class='lead'><article><p>{words(k, 5, 'lead')}</p></article></div><div class='parts'>{''.join(parts)}</div></body>"))
        want[300 + k] = " ".join([words(k, 5, "lead"), *(words(k, 30, f"part{j}y") for j in range(1 + k % 3))])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (html.BROADCAST_BYTES, 0):
        assert {r.page_id: r.text for r in html.extract(df, size).collect()} == want


def test_template_nests():
    assert html.nesting(["body", "body/div[a]", "body/div[a]/ul[x]/article"]) == {"body": "", "body/div[a]": "body", "body/div[a]/ul[x]/article": "body/div[a]"}
    own = [{"slot": f"body/section/{p}", "pages": 10, "chars": 100, "linked": 0, "constant": False} for p in ("article", "div")]
    once = lambda p, n=10: {"place": p, "tokens": n, "once": n == 10}
    # what stands in a list is of no frame
    got = html.main_slots(own, [once("body"), once("body/section", 30), once("body/section/article"), once("body/section/div")])
    assert not any(s.frame for s in got.values()) and all(s.listed for s in got.values())
    got = html.main_slots(own, [once("body"), once("body/section"), once("body/section/article")])
    assert got["body/section/article"].frame and not got["body/section/div"].frame
