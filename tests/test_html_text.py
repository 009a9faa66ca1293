from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.sources import html_text as ht

md = ht.to_markdown


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("a&#8217;b&mdash;c &amp;lt; &notit; &#x1F600;", "a’b—c &lt; ¬it; \U0001f600"),
        ("<a href='x'>one</a> <a href=y>two</a> <a href=\"z&amp;w\">th<b>ree</b></a> <a name=q>four</a>", "[one](x) [two](y) [three](z&w) four"),
        ("<table><tr><td>1</td><td>2</td></tr><tr><td>3<td>a|b</table>", "| 1 | 2 |\n| --- | --- |\n| 3 | a\\|b |"),
        ("<pre>a  b\n  c\n\nd</pre>x", "```\na  b\n  c\n\nd\n```\nx"),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "- a\n  - b\n  - c\n- d"),
        ("<ol start=3><li>a</li><li>b<p>more</p></li></ol>", "3. a\n4. b\n   more"),
        ("<h2>Head <i>x</i></h2><p>one<p>two<br>three", "## Head x\none\ntwo\nthree"),
        ("<script>if (a < b) '</p>'</script><style>p{}</style><!-- no --><!doctype html>yes", "yes"),
        ("<title>A &amp; B</title><body>c", "A & B\nc"),
        ("<blockquote><p>q</p><p>r</p></blockquote>s<hr>t", "> q\n> r\ns\n---\nt"),
        ("<img src=a.png alt='A b'> <img alt=no>", "![A b](a.png)"),
        ("<table><tr><td>x<table><tr><td>in</td></tr></table></td></tr></table>", "| x in |\n| --- |"),
        ("a <b>b</b>c</i> d <unclosed", "a bc d"),
        ("<p>a\n  b&nbsp;c", "a b c"),
        ("", ""),
        ("<td>loose</td></li></ul>x", "loose\nx"),
        ("<!-- never closed", ""),
    ],
)
def test_shapes(html, want):
    assert md(html) == want


class Standard(HTMLParser):
    """The standard parser's tokens, texts joined, scripts and styles dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.skip = [], False

    def handle_starttag(self, tag, attrs):
        seen = {}
        for k, v in attrs:
            seen.setdefault(k, v or "")
        self.found.append(("start", tag, seen))
        self.skip = tag in ht.DROPPED

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.skip = False

    def handle_endtag(self, tag):
        self.found.append(("end", tag, {}))
        self.skip = False

    def handle_data(self, data):
        if not self.skip:
            if self.found and self.found[-1][0] == "text":
                data = self.found.pop()[1] + data
            self.found.append(("text", data, {}))


def joined(tokens):
    """Tokens with texts that only a comment parted as one."""
    out = []
    for kind, text, found in tokens:
        if kind == "text" and out and out[-1][0] == "text":
            text = out.pop()[1] + text
        out.append((kind, text, found))
    return out


WORDS = st.sampled_from(["a", " ", "b c", "&amp;", "&lt;", "&#8217;", "&eacute;", "&bogus;", "1 < 2", "3 > 2", "\n", "x=y", "漢", "'", '"', "&"])
NAMES = st.sampled_from(["p", "b", "ul", "li", "a", "table", "tr", "td", "pre", "br", "h1", "div", "DIV", "x-y"])
ATTRIBUTES = st.sampled_from(["", " href='q'", ' href="a&amp;b"', " href=u", " checked", ' a="1" a="2"', " B = 'c d'", "\n data-x='>'", ' t="<p>"'])
PARTS = st.one_of(WORDS, st.tuples(NAMES, ATTRIBUTES).map(lambda x: f"<{x[0]}{x[1]}>"), NAMES.map(lambda n: f"</{n}>"), NAMES.map(lambda n: f"</{n} >"), st.sampled_from(["<!-- c > -->", "<script>a<b</script>", "<style>x{}</style>", "<br/>"]))


@given(st.lists(PARTS, max_size=14))
@settings(max_examples=400, deadline=None)
def test_tokens_are_the_standard_parsers(parts):
    html = "".join(parts)
    want = Standard()
    want.feed(html)
    want.close()
    assert joined(ht.tokens(html)) == want.found


@given(st.lists(PARTS, max_size=20))
@settings(max_examples=300, deadline=None)
def test_no_word_is_lost(parts):
    html = "".join(p for p in parts if "|" not in p)
    letters = lambda t: sorted(c for c in t if c.isalnum())
    want = Standard()
    want.feed(html)
    want.close()
    text = "".join(t for kind, t, _ in want.found if kind == "text")
    got = letters(md(html))
    for c in letters(text):
        got.remove(c)


@given(st.text("<>/!-ab c\"'=&;#1", max_size=40))
@settings(max_examples=500, deadline=None)
def test_never_fails(html):
    md(html)


def test_long_and_deep_pages():
    assert md("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert len(md("<p>word</p>" * 50_000).split("\n")) == 50_000
    assert md("<" * 100_000).startswith("<<") and md("<a " * 20_000) == ""


def test_column(spark):
    df = spark.createDataFrame([(1, "<p>a<p>b"), (2, None), (3, "")], "id int, html string")
    assert [r.t for r in df.select(ht.html_markdown("html").alias("t"), "id").orderBy("id").collect()] == ["a\nb", "", ""]
    assert df.where(F.col("id") > 5).select(ht.html_markdown("html")).collect() == []


def test_bare_references(spark):
    """A title cut inside a reference: browsers resolve it, the query's SQL takes closed ones alone."""
    page = "<title>a&amp</title><p>b &lt;c&gt; &#39;d&#x41; &notit; &copy 1 <a href='/x&amp;y'>e&amp;lt;</a>"
    assert ht.to_markdown(page, bare=False) == "a&amp\nb <c> 'dA &notit; &copy 1 [e&lt;](/x&y)"
    assert ht.to_markdown(page).startswith("a&\nb <c> 'dA ¬it; © 1")
