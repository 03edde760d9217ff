import re
from html.parser import HTMLParser

from plumbline.llm.render_html import extract_text, render

CASES = [
    ("", ""), ("<!-- only --><script>a<b</script>", ""), ("a &lt; b < c &amp; d", "a < b < c & d"),
    ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"), ("x<br>y<br/>z", "x\ny\nz"),
    ("<ul><li>a<li>b<ol start=3><li>c<li value=7>d</ol><li>e</ul>", "* a\n* b\n  3. c\n  7. d\n* e"),
    ("<table><tr><th>Name<th>Qty<tr><td>pear tree<td align=right>3</table>", "Name       Qty\npear tree    3"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td colspan=2>wide one<tr><td>x<td>y</table>", "wide one\nx         y"),
    ("<p hidden>no</p><p style='Display : none'>no</p><dialog>no</dialog><b>yes</b>", "yes"),
    ("<div style='visibility:hidden'>no<i style='visibility:visible'>yes</i></div>", "yes"),
    ("<pre>a  b\n  c</pre>", "a  b\n  c"), ("<title>t</title><body>b</body>", "b"), ("<p>a</div></span>b", "ab"), ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<a href='x>y'>link</a> <", "link <"), ("<li>a<li>b", "a\nb"), ("<textarea>t<b></textarea>u", "t<b>u"),
]


def test_cases():
    for page, want in CASES:
        assert render(page) == want, page


def test_broken_deep_and_long_pages():
    assert render("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert render("<table><tr><td>" * 300 + "x").strip() == "x"
    assert len(render("<p>" + "word " * 200_000)) > 900_000
    assert render("<script>never closed") == "" and "<b" in render("text <b 'unclosed")


def test_rows(spark):
    pages = spark.createDataFrame([(1, None, "t"), (2, "<p>x", "t"), (2, "<p>x", "t"), (None, "", "t")], "page_id long, html string, text string")
    assert sorted((str(r.id), r.text) for r in extract_text(pages).collect() if r.id != 1) == [("2", "x"), ("2", "x"), ("None", "")]
    assert extract_text(pages).where("id = 1").first().text is None
    assert extract_text(pages.limit(0)).collect() == []


def test_markup_inside_raw_elements_hides_nothing_after_them():
    for page, want in (
        ("<script>for(i=0;i<n;i++)f()</script><p>text</p>", "text"), ("a<script>if(x<!--y)f()</script>b<!--c-->d", "abd"), ("<style>a<b{}</style><p>text</p><div>more</div>", "text\n\nmore"),
        ("<style><!-- p{} </style>text", "text"), ("<script>s='<a href=\"x'</SCRIPT >text<script>t(a<b)</script> more", "text more"), ("<title>a<b</title>text", "text"),
        ("<textarea>a<b</textarea>text", "a<btext"), ("<script><!-- never closed <p>no", ""), ("<div><script>a</b<c</script>in</div>out", "in\nout"),
    ):
        assert render(page) == want, page


class Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title", "template")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title", "template")

    def handle_data(self, data):
        self.out += [] if self.skip else [data]


def test_every_visible_letter_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in pages:
        v = Visible()
        v.feed(r.html)
        v.close()
        assert sorted(re.sub(r"\W", "", "".join(v.out))) == sorted(re.sub(r"\W", "", render(r.html)))
