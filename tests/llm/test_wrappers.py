import pytest

from shelfcast.llm.wrappers import align, extract_main_text, parse, read_shape, shape

SCHEMA = "page_id bigint, url string, html string, text string, host string, blocks string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "t", "h", "b") for r in rows], SCHEMA)


def texts(page):
    return [t for _, t, _, _ in parse(page)[1]]


@pytest.mark.parametrize(("page", "want"), [
    ("<p>a <b>b</b>\n c</p><p>d", ["a b c", "d"]),
    ("<p>one<br>two<p>three", ["one", "two", "three"]),
    ("x &amp; y &eacute;&#33; &lt;b&gt;", ["x & y é! <b>"]),
    ("<script>if (a < b) t='</p>';</script><style>p{}</style>text", ["text"]),
    ("<div class='ad'>buy</div><div>keep</div><form>f<input value='x>y'></form>", ["keep"]),
    ("<nav><ul><li>m</ul></nav><header>h</header><article><header><h1>T</h1></header>x<aside>s</aside>y</article>",
     ["T", "x", "y"]),
    ("<div id=comments><p>c</div><section class='post related-links'>r</section><p>z", ["z"]),
    ("<!-- <p>no</p> --><!doctype html><p>yes", ["yes"]),
    ("<p>a < b and <3", ["a < b and <3"]),
    ("<td>1</td><td>2", ["1", "2"]),
    ("<div hidden>no</div><p class=readable>shadow", ["shadow"]),
    ("", []), ("</p></div>", []), ("<p", []),
])
def test_blocks(page, want):
    assert texts(page) == want


def test_alignment_matches_equal_trees_in_order():
    a = parse("<div><ul><li>1</ul><p>x</p><table></table></div>")[0]
    b = parse("<div><p>x</p><section></section><table></table></div>")[0]
    names = {n.number: n.sign for n in all_nodes(a)}, {n.number: n.sign for n in all_nodes(b)}
    matched = [(names[0][i], names[1][j]) for i, j in align(a, b)]
    assert matched == [("#root", "#root"), ("div", "div"), ("p", "p"), ("table", "table")]
    assert shape(read_shape(shape(a))) == shape(a)


def all_nodes(node):
    yield node
    for child in node.children:
        yield from all_nodes(child)


def test_constant_texts_are_template_and_varying_ones_content(spark):
    rows = [(i, f"https://Site.example/{i}", f"<div class=top><b>My site</b></div><div class=body><p>Story {i} is told "
             f"here.</p><p>Read on.</p></div><div class=end>All rights.</div>") for i in range(6)]
    rows += [(10, "https://other.example/x", "<div class=top>My site</div><p>Alone.</p>"),
             (11, None, "<p>No host.</p>"), (12, "https://site.example/n", None), (13, "https://site.example/e", ""),
             (None, "https://other.example/y", "<p>No key.</p>"), (10, "https://other.example/x",
                                                                "<div class=top>My site</div><p>Alone.</p>")]
    got = extract_main_text(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by_key = {r.page_id: r.text for r in got}
    assert [by_key[i] for i in range(6)] == [f"Story {i} is told here." for i in range(6)]
    assert by_key[10] == "My site\nAlone." and by_key[11] == "No host." and by_key[None] == "No key."
    assert by_key[12] == by_key[13] == ""
    assert extract_main_text(pages(spark, [])).collect() == []


def test_article_of_copies_is_kept(spark):
    rows = [(i, "http://a.example/", "<nav>m</nav><article><p>The same text.</p></article>") for i in range(8)]
    assert {r.text for r in extract_main_text(pages(spark, rows)).collect()} == {"The same text."}
    rows = [(i, "http://b.example/", f"<article><p>Text {i}.</p><p>Share now.</p></article>") for i in range(8)]
    assert {r.text for r in extract_main_text(pages(spark, rows)).collect()} == {f"Text {i}." for i in range(8)}


def test_large_page(spark):
    page = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    got = extract_main_text(pages(spark, [(1, "http://c.example/", page)])).first()
    assert got.text == "\n".join(["word word"] * 20_000)
