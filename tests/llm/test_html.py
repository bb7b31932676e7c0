import html
import random
import time

import regex

from lexspan.llm import html_text as H

from .helpers import SF


def main_text(page):
    return H.extract(H.parse(page), None)


def test_blocks_and_references():
    assert main_text("<p>a<p>b &amp; c&nbsp; d") == "a\nb & c d"
    assert main_text("<article><h1> T </h1><ul><li>1<li>2</ul><table><tr><td>x<td>y</table>a<b>b</b><br>c</article>") == "T\n1\n2\nx\ny\nab c"
    assert main_text("<div id=main><nav>n</nav><p>A</p><div class='comments'>no</div><aside>s</aside><form>f</form></div><footer>f</footer>") == "A"
    assert main_text("<article><p>if a < b</p><script>x</p></script><style>p{}</style><!-- <p>no</p> --></article>out") == "if a < b"
    assert main_text("") == main_text("<nav>only</nav>") == ""


def test_depth_and_broken_markup():
    assert main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert main_text("<article><p>x</p><p title='unclosed>y</p>").startswith("x")
    assert main_text("</p></div>text<") == "text<"


def wrapper(pages):
    w = H.wrapper_of(H.parse(pages[0]))
    for p in pages[1:]:
        w = H.merged(w, H.wrapper_of(H.parse(p)))
    return w


def by_wrapper(pages):
    rule = H.rules(H.unpacked(H.packed(wrapper(pages))), len(pages))
    return [H.extract(H.parse(p), rule) for p in pages]


def test_wrapper_has_groups_options_and_slots():
    pages = [f"<body><article><h1>T{i}</h1>{'<p>a%d</p>' % i * (i + 1)}{'<ul><li>z</ul>' if i % 2 else ''}<div>Always</div></article></body>" for i in range(40)]
    article = wrapper(pages).kids[0].kids[0]
    parts = {x.tag: x for x in article.kids}
    assert [x.tag for x in article.kids] == ["h1", "p", "ul", "div"]
    assert parts["p"].rep and parts["ul"].opt and not parts["h1"].rep and not parts["h1"].opt
    assert parts["h1"].kids[0].digest is None and parts["div"].kids[0].digest and parts["div"].kids[0].seen == 40
    assert by_wrapper(pages)[3] == "T3\na3\na3\na3\na3\nz\nAlways"
    assert H.packed(H.unpacked(H.packed(wrapper(pages)))) == H.packed(wrapper(pages))


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def nameless(rng, i):
    """A page without telling tags or names, and its article."""
    menu = "<div><ul>" + "".join(f"<li><a href=/{k}>{words(rng, 2)}</a>" for k in range(rng.randint(3, 6))) + "</ul></div>"
    notice = "<div><p>We keep small files on your machine to serve you. Go on if you agree with that.</p></div>"
    advert = f"<div><p>{words(rng, 6)}</p><p>{words(rng, 3)}</p></div>"
    blocks = [words(rng, 4)] + [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 7))] + ["Always the same last line"]
    article = f"<div><h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:]) + "</div>"
    foot = f"<div>Page {i} of this place</div>"
    return f"<html><body>{menu}{notice if i % 3 else ''}{advert if i % 2 else ''}{article}{advert if i % 4 == 1 else ''}{foot}</body></html>", "\n".join(blocks)


def test_nothing_needs_a_telling_name():
    rng = random.Random(1)
    pages = [nameless(rng, i) for i in range(30)]
    assert by_wrapper([p for p, _ in pages]) == [a for _, a in pages]
    assert by_wrapper([p for p, _ in pages[:4]]) == [a for _, a in pages[:4]]


def test_the_wrapper_knows_what_one_page_does_not_show():
    """A notice longer than the article: alone the page says the notice, among its like the article."""
    rng = random.Random(2)
    notice = "<div><p>" + "The same long words of the house on every page. " * 20 + "</p></div>"
    pages = [f"<body>{notice}<div><h2>{words(rng, 3)}</h2><p>{words(rng, 25)}</p></div></body>" for _ in range(6)]
    want = [regex.sub(r"<[^>]*>", "\n", p.split("</div>")[1]).strip("\n").replace("\n\n", "\n") for p in pages]
    assert by_wrapper(pages) == want
    assert all(main_text(p) != w for p, w in zip(pages, want, strict=True))


def test_headings_beside_the_article_and_class_words_that_vary():
    rng = random.Random(3)
    body = lambda: "".join(f"<p>{words(rng, 30)}</p>" for _ in range(3))
    pages = [f"<body><div class='x{i}'><h1>T{i}</h1><div>{i} of May</div><div id=p{i} class='u{i} v{'abcdef'[i % 6]}'>{body()}</div></div><div>{words(rng, 5)}</div></body>" for i in range(12)]
    for i, text in enumerate(by_wrapper(pages)):
        lines = text.split("\n")
        assert lines[0] == f"T{i}" and len(lines) == 4 and lines[1:] == regex.findall("<p>(.*?)</p>", pages[i])
    sizes = [len(H.packed(wrapper(pages[:n]))) for n in (2, 12)]
    assert sizes[1] < 1.2 * sizes[0]


def test_merging_order_does_not_change_the_region():
    a, b = (H.wrapper_of(H.parse(f"<body>{x}<article><p>{x}</p></article></body>")) for x in ("one", "two"))
    assert H.packed(H.merged(a, b)) == H.packed(H.merged(b, a))


def test_long_lists_of_unlike_siblings():
    rng = random.Random(4)
    tags = "div section p h2 ul table pre dl center address".split()
    page = lambda: "<body>" + "".join(f"<{t}>{words(rng, 2)}</{t}>" for t in (rng.choice(tags) for _ in range(2_000))) + "</body>"
    a, b = (H.wrapper_of(H.parse(page())) for _ in range(2))
    began = time.process_time()
    both = H.merged(a, b)
    assert time.process_time() - began < 3
    ka, kb = a.kids[0].kids, b.kids[0].kids
    met = H.pairs(ka, kb)
    assert met == sorted(met) and all(ka[i].tag == kb[j].tag for i, j in met) and len(met) > 0.2 * min(len(ka), len(kb))
    assert sum(k.mass for k in both.kids[0].kids for k in k.kids) > 0


def expected(page):
    """The article of a generated page, by its plain marks alone."""
    inner = regex.search(r"<article>(.*?)(?:</article>|<footer>)", page, regex.S)[1]
    blocks = regex.split(r"</?(?:h1|p)>", inner)
    return "\n".join(t for t in (" ".join(html.unescape(regex.sub(r"<br>", " ", regex.sub(r"</?b>", "", b))).split()) for b in blocks) if t)


def test_query_on_whole_table(spark):
    got = {r.page_id: r for r in H.op7_html_wrappers(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == expected(p.html) and got[p.page_id].n_chars == len(got[p.page_id].text)


def test_pages_without_their_names(spark):
    """The same pages with every telling tag and name taken away: the wrappers still find the article."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    bare = lambda t: regex.sub(r"<(/?)(?:article|nav|footer|div)\b[^>]*>", r"<\1div>", t)
    hosts = {}
    for p in pages:
        hosts.setdefault(p.url.split("/")[2].lower(), []).append(p)
    rows = [(p.page_id, p.url, bare(p.html)) for h in hosts.values() if len(h) > 1 for p in h]
    found = {r.page_id: r.text for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    right = sum(found[p.page_id] == expected(p.html) for p in pages if p.page_id in found)
    assert right >= 0.95 * len(found), (right, len(found))


def test_reruns_agree(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").repartition(7)
    w = [sorted(map(tuple, H.wrappers(pages).collect())) for _ in range(2)]
    assert w[0] == w[1]


def test_odd_rows(spark):
    rows = [(1, None, "<p>a</p>", 1), (1, "http://h/x", None, 2), (None, "not a url", "<article><p>b", 3), (1, None, "<p>a</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = sorted(((r.page_id or 0), r.text, r.n_chars) for r in H.extracted(pages).collect())
    assert got == [(0, "b", 1), (1, "", 0), (1, "a", 1), (1, "a", 1)]
    assert H.extracted(pages.limit(0)).count() == 0


def test_article_texts_of_one_page_stay(spark):
    def page(i):
        once = "<h2 id=some-title>Some title</h2><blockquote>said once</blockquote><pre>code</pre>" if i == 7 else ""
        return f"<body><article><h1>T{i}</h1>{once}<p>a{i}</p></article></body>"

    pages = spark.createDataFrame([(i, "http://h/x", page(i)) for i in range(40)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extracted(pages).collect()}
    assert got == {i: f"T{i}\nSome title\nsaid once\ncode\na{i}" if i == 7 else f"T{i}\na{i}" for i in range(40)}


def test_text_does_not_depend_on_the_host_having_30_pages(spark):
    rows = [(i, f"http://h{n}/x", f"<body><article><h2>Summary</h2><p>a{i}</p></article></body>") for n in (29, 30) for i in range(n)]
    got = {r.text for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {f"Summary\na{i}" for i in range(30)}
