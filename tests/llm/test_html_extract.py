from locusframe.llm import html_extract as hx


def test_article_of_a_whole_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
    <article><h1>Head &amp; line</h1><p><b>One&nbsp;two.<br><p>Three
       four&lt;5 &am</p><div class="ad-box ads">no</div><ul><li>item <i>a</i>b<li>item 2</ul><aside>side</aside><section class="comments"><p>Nice!</p></section>
    <form><p>Name</p><input></form><p>Last &copy; &#233;</p></article><div class="sidebar">links</div><footer>&copy; x</footer>"""
    assert hx.main_text(page) == "Head & line\n\nOne two.\n\nThree four<5 &am\n\nitem ab\n\nitem 2\n\nLast © é"


def test_without_article_and_broken_markup():
    assert hx.main_text("plain &lt;b&gt; text") == "plain <b> text"
    assert hx.main_text("<div class='content'><p>a<p>b<div>c</div></div><div class='sidebar'>x</div>") == "a\n\nb\n\nc"
    assert hx.main_text("<p>1 < 2 and <b>x</p><table><tr><td>a<td>b<tr><td>c</table><!-- open") == "1 < 2 and x\n\na b\n\nc"
    assert hx.main_text("<p>a<script>if (a<b) '</p>'</script>b</p>") == "ab"
    assert hx.main_text("<p>a <button>Go</button><span class='ads'>x</span>b<svg><text>t</text></svg></p>c") == "a b\n\nc"
    assert hx.main_text("") == "" and hx.main_text("<nav>x</nav>") == ""


def rows():
    out = []
    for i in range(8):
        body = "".join(f"<p>para {i} {j}</p>" for j in range(1 + i % 4))
        out.append((i, f"http://a.example/{i}", f"<html><body><div class='top-line'>Same words everywhere</div><div class='content'>{body}<div class='tail'>Always this</div></div></body></html>"))
    return out + [(20, "http://b.example/", "<article><p>only page</p><div class='tail'>kept here</div></article>"), (21, None, None), (22, "no url", "<p>x</p>"), (0, "http://a.example/0", out[0][2]), (None, "http://b.example/1", "<p>" + "long " * 50_000)]


def test_site_style_tree(spark):
    got = {(r.page_id, r.text, r.n_chars) for r in hx.extract(spark.createDataFrame(rows(), "page_id long, url string, html string").selectExpr("*", "'k' as text", "1 as low")).collect()}
    by = {p: t for p, t, _ in got}
    assert by[3] == "para 3 0\n\npara 3 1\n\npara 3 2\n\npara 3 3"
    assert by[20] == "only page\n\nkept here" and by[21] == "" and by[22] == "x" and len(by[None]) == 249_999
    assert all(n == len(t) for _, t, n in got)


def test_equal_articles_stay(spark):
    page = "<article><h1>T</h1><p>Same text</p></article>"
    df = spark.createDataFrame([(i, "http://c.example/x", page) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in hx.extract(df).collect()} == {"T\n\nSame text"}
    assert hx.extract(df.where("false")).collect() == []


def test_names_do_not_outweigh_the_article():
    assert hx.main_text("<main class='content has-sidebar'><p>a</p></main>") == "a"
    assert hx.main_text("<article class='post no-comments'><header class='entry-header'><h1 class='article-header'>T</h1></header><p>a</p></article>") == "T\n\na"
    assert hx.main_text("<div id='layout-with-sidebar'><article><p>a</p></article><div class='sidebar'>x</div></div>") == "a"
    assert hx.main_text("<div class='with-sidebar'><p>long enough text</p></div><p>b</p>") == "long enough text\n\nb"


def test_unnamed_elements_and_copies(spark):
    page = lambda i: f"<div><p>Same on all</p><table><tr><td>row</td></tr></table></div><div><p>own {i}</p></div>"
    one = "<div><p>text of a host with one page</p></div>"
    article = lambda i: f"<article><div class='box'>stays</div><p>{i}</p></article>"
    rows = [(i, "http://a.example/", page(i)) for i in range(6)] + [(20 + i, "http://a.example/", page(0)) for i in range(200)]
    rows += [(300 + i, "http://b.example/", one) for i in range(9)] + [(400 + i, "http://c.example/", article(i)) for i in range(9)]
    got = {r.page_id: r.text for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"own {i}" for i in range(6)) and got[20] == "own 0"  # 200 copies are one page
    assert got[300] == "text of a host with one page" and got[403] == "stays\n\n3"


SITE = [f"<body><div><a href='/'>Home</a> <a href='/x'>All posts</a></div><div><h2>Post {i}</h2><p>Body {i} of the post</p></div><div><p>Write to us at the office</p></div></body>" for i in range(7)]


def test_importance_decides(spark):
    df = spark.createDataFrame([(i, "http://s.example/", p) for i, p in enumerate(SITE)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in hx.extract(df).collect()}
    assert got == {i: f"Post {i}\n\nBody {i} of the post" for i in range(7)}
    without = {r.page_id: r.text for r in hx.extract(df, threshold=-1.0).collect()}
    assert without[0] == "Home All posts\n\nPost 0\n\nBody 0 of the post\n\nWrite to us at the office" and without != got


def test_links_that_end_every_article_go_and_equal_text_stays(spark):
    page = lambda i: f"<article><p>Equal lead on all pages</p><p>Own text {i}</p><ul><li><a href='/a'>Most read</a></li></ul></article>"
    df = spark.createDataFrame([(i, "http://s.example/", page(i)) for i in range(6)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in hx.extract(df).collect()} == {i: f"Equal lead on all pages\n\nOwn text {i}" for i in range(6)}


def test_a_form_around_the_page_keeps_its_article():
    assert hx.main_text("<form id='f'><nav>m</nav><article><p>a</p></article><input></form>") == "a"
    assert hx.main_text("<article></article><p>beside</p><footer>f</footer>") == "beside"


def test_tree_against_brute_force(spark):
    import math
    import random
    from collections import Counter, defaultdict

    r = random.Random(9)
    pages = []
    for i in range(60):
        parts = [r.choice(["<p>same</p>", f"<p>own {r.randrange(4)}</p>", "<div><p>in</p><p>two</p></div>", "<ul><li><a>m</a></li></ul>", f"<section><h2>{i}</h2></section>"]) for _ in range(r.randrange(1, 6))]
        pages.append((i, f"http://h{i % 3}.example/", "".join(parts)))
    pages += [(100 + i, u, h) for i, u, h in pages[:20]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    from locusframe.llm.scratch import Scratch

    rows = df.select("page_id", "url", hx.host_of(df["url"]).alias("host"), hx.F.lit(0).cast("bigint").alias("row"), "html")
    read = Scratch(spark, "t").cut(rows.mapInArrow(hx._parse, f"page_id bigint, url string, host string, row bigint, page bigint, {hx._PARSED}"), "parsed")
    got = {(x.host, x.path) for x in hx.low_nodes(read, 5, 0.2).collect()}
    seen = defaultdict(lambda: (Counter(), Counter()))
    for url, source in {(u, h) for _, u, h in pages}:
        p = hx.parsed(source)
        for path, style, content, loss in zip(p["paths"], p["styles"], p["contents"], p["loss"]):
            if loss < 0:
                seen[url[7:].rstrip("/"), path][0][style] += 1
                seen[url[7:].rstrip("/"), path][1][content] += 1

    def entropy(c):
        n = sum(c.values())
        return -sum(v / n * math.log(v / n) for v in c.values()) / math.log(n) if n > 1 else 1.0

    want = {k for k, (a, b) in seen.items() if sum(a.values()) >= 5 and max(entropy(a), entropy(b)) < 0.2}
    assert got == want and got and len(got) < len(seen)
    monkey = hx.BROADCAST_NODES
    try:
        hx.BROADCAST_NODES = 0
        far = {(x.page_id, x.text) for x in hx.extract(df).collect()}
    finally:
        hx.BROADCAST_NODES = monkey
    assert far == {(x.page_id, x.text) for x in hx.extract(df).collect()}
