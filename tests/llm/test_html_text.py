"""Layout-aware rendering on hand-made pages."""

from tallymark.llm.html_text import MAX_DEPTH, extract, render_pages


def test_blocks_and_breaks():
    assert extract("<p>one  two\n three<p>four<br>five<div>six</div>seven") == "one two three\n\nfour\nfive\n\nsix\nseven"


def test_implied_tags():
    assert extract("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "* a\n* b\n  * c\n* d"
    assert extract("<ol start=3><li>x<li value=7>y<li>z</ol>") == "3. x\n7. y\n8. z"
    assert extract("<dl><dt>t<dd>d<dt>u</dl>") == "t\n    d\nu"


def test_table_is_aligned():
    assert extract("<table><caption>c</caption><tr><th>n<th>long name<tr><td>12<td>b</table>") == "c\nn  | long name\n12 | b"
    assert extract("<table><tr><td>a<td>b<tr><td colspan=2>wide cell<td>z</table>").split("\n")[1] == "wide cell | z"


def test_visibility():
    page = "<title>t</title><style>s</style><script>if(a<b)</script><p hidden>h<p style='color:red; DISPLAY: none'>n<p aria-hidden=true>x<!-- c --><p>seen<noscript>q</noscript><template>w</template>"
    assert extract(page) == "seen"


def test_entities_pre_and_alt():
    assert extract("a&amp;b&lt;&#x41;&#65;&#1114112;") == "a&b<AA�"
    assert extract("<pre>\n a\n  b</pre>") == " a\n  b"
    assert extract('x <img alt="pic" src=y> z <input value=v> <input type=hidden value=no>') == "x pic z v"


def test_broken_pages():
    assert extract("</p>a</b><i>b<p>c</i>d") == "ab\n\nc\n\nd"
    assert extract("text <a href='x") == "text"
    assert extract("5 < 6 and 7 > 3") == "5 < 6 and 7 > 3"
    deep = "<div>" * (3 * MAX_DEPTH) + "core" + "</div>" * (3 * MAX_DEPTH) + "<ul><li>" * 300 + "leaf"
    assert "core" in extract(deep) and "leaf" in extract(deep)


def test_no_text_is_lost_in_long_pages():
    page = "<div>" + "".join(f"<p>word{i}" for i in range(20_000))
    assert extract(page).split() == [f"word{i}" for i in range(20_000)]


def test_query_cases(spark):
    pages = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (2, "<p>a", "u"), (None, "<p>b", "u")], "page_id long, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"]) for r in render_pages(pages).collect()) == [(0, "b"), (1, ""), (2, ""), (2, "a")]
    assert render_pages(pages.limit(0)).count() == 0


def test_cells_that_reach_down():
    page = "<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td>D<td>E</table>"
    assert extract(page) == "A | B\n  | C\nD | E"
    assert extract("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f</table>") == "a | b | c\nd |   | e\nf |"


def test_visibility_is_inherited():
    page = "<p style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</p><ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>"
    assert extract(page) == "yes\n\n* yes"
    assert extract("<div style='display:none'><b style='visibility:visible'>no</b></div>x") == "x"


def test_deep_elements_keep_hiding():
    page = "<div>" * 700 + "a<div hidden>no<div>no</div>no</div>b" + "</div>" * 700 + "c"
    assert extract(page).split() == ["ab", "c"]


def test_time_is_linear():
    """Repeats of what never closes; each took time with the square of the page before."""
    import time

    for part in ("<a ", '<a "', "<a x='", "</b ", "<script></script ", "<!-- ", "<!x ", "<textarea></textarea"):
        extract(part * 1_000)
        began = time.time()
        extract(part * 60_000)
        assert time.time() - began < 5, part


def test_quotes_and_ends():
    assert extract('<a title="x>y">z</a> <b title="no end>w') == "z w"
    assert extract("a < b <c") == "a < b"
    assert extract("a<!-- never closed <b>c</b>") == "a"


def test_visible_characters_equal_an_independent_parser(spark):
    """All pages of the small table: the standard library's event parser sees the same characters, layout marks aside."""
    import os
    import re
    from html.parser import HTMLParser

    import pytest

    from tallymark.llm import html_text as H

    table = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(table):
        pytest.skip("no test tables here")

    class Seen(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.words = [], []

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            style = re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style") or "")
            hidden = tag in H.UNSEEN or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true" or bool(style)
            if tag not in H.VOID:
                self.stack.append((tag, hidden))
            elif not hidden and not any(h for _, h in self.stack):
                shown = a.get("alt") if tag == "img" else a.get("value") if tag == "input" and a.get("type", "text") not in ("hidden", "checkbox", "radio", "password", "file") else ""
                self.words += (shown or "").split()

        def handle_endtag(self, tag):
            at = max((i for i, (t, _) in enumerate(self.stack) if t == tag), default=None)
            if at is not None:
                del self.stack[at:]

        def handle_data(self, data):
            if not any(h for _, h in self.stack):
                self.words += data.split()

    mark = re.compile(r"^(\*|\||>|\d+\.|-{20})$")
    letters = lambda words: sorted("".join(w for w in words if not mark.match(w)))
    rows = spark.read.parquet(table).collect()
    for r in rows:
        seen = Seen()
        seen.feed(r["html"] or "")
        seen.close()
        assert letters(seen.words) == letters(extract(r["html"]).split()), r["page_id"]
    assert len(rows) > 100
