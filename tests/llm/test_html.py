import random

import pytest

from tidecast.llm import html_text as h
from tidecast.llm import queries

CASES = [
    ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
    ("<ul><li>x<li>y<ol start=3><li>p<li>q</ol></ul>z", "- x\n- y\n  3. p\n  4. q\n\nz"),
    ("<table><tr><th>A<th>BB<tr><td>long cell<td>2</table>", "A          BB\nlong cell  2"),
    ("<table><td>1<td colspan=2>w<td>e<tr><td>22<td>u<td>v<td>x</table>", "1   w     e\n22  u  v  x"),
    ("a <b>bold</b>, <i> spaced </i>text  \n runs", "a bold, spaced text runs"),
    ("x<br>y<hr>z", "x\ny\n\n---\n\nz"),
    ("<pre>\n a  b\n   c\n</pre>after", " a  b\n   c\n\nafter"),
    ("<script>if (a<b) x('</p>')</script><style>p{}</style><title>t</title>seen", "seen"),
    ("<div hidden>no</div><p style='display:none'>no<p>yes<template>no</template>", "yes"),
    ("<head><title>t</title><body>b", "b"),
    ("a &amp; b &lt;c&gt; &copy; &#233; &bogus;", "a & b <c> © é &bogus;"),
    ("1 < 2 and <3 <!-- no -->end<div", "1 < 2 and <3 end"),
    ('<a href="x>y" title=\'<b>\'>link</a>', "link"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<blockquote>q<p>r</blockquote>", "  q\n\n  r"),
    ("</p></div>stray</table>", "stray"),
    ("<TABLE><TBODY><TR><TD>up<TABLE><TR><TD>in</TABLE><TD>x</TABLE>", "up  x\nin"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<p><a title=don't>Visible text</a> it's more</p><p>rest</p>", "Visible text it's more\n\nrest"),
    ("<a href=/o'brien>Visible</a> text here … it's end", "Visible text here … it's end"),
    ("<p a\"b c='>' =d e = \"x>y\"f>on</p>", "on"),
    ("a<b title=\"x>y\"", "a"),
    ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
    ("<table><tr><td>A<td rowspan=0>B<td>C<tr><td>D<td>E<tbody><tr><td>F<td>G<td>H</table>", "A  B  C\nD     E\nF  G  H"),
    ("<table><tr><td rowspan=2 colspan=2>A<td>B<tr><td>C<tr><td>D<td>E<td>F</table>", "A     B\n      C\nD  E  F"),
    ("<table><tr><td colspan=5000>A<td>B</table>", "A" + " " * 2000 + "B"),
    ("<ul><li>x<pre>a\n\nb</pre></ul>", "- x\n  a\n\n  b"),
    ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
    ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes<b>on</b></p>no<i>no</i></div>end", "yeson\n\nend"),
    ("<ul><li style='visibility:hidden'>no<li>yes</ul>", "- yes"),
    ("<div hidden><p style='visibility:visible'>no</p></div>yes", "yes"),
    ("", ""),
    (None, ""),
]


def plain_tag(page, at):
    """The end of the tag that begins at ``at`` and its attributes, by the states of the standard; None if it does not end.
    A quoted value that is never closed is no value: the quote begins a name."""
    at += 1 + (page[at + 1] == "/")
    while page[at : at + 1] and page[at] not in " \t\n\r\f\v/>":
        at += 1
    found, name, value, state = {}, None, "", "before name"

    def keep():
        if name:
            found.setdefault(name.lower(), value)

    while at < len(page):
        c, blank = page[at], page[at] in " \t\n\r\f\v"
        if state == "before name":
            if c == ">":
                return at + 1, found
            if not blank and c != "/":
                name, value, state = c, "", "name"
        elif state in ("name", "after name"):
            if c == "=":
                state = "before value"
            elif c in ">/":
                keep()
                state = "before name"
                at -= c == ">"
            elif blank:
                state = "after name"
            elif state == "name":
                name += c
            else:
                keep()
                name, value, state = c, "", "name"
        elif state == "before value":
            if c in "\"'" and c in page[at + 1 :]:
                end = page.index(c, at + 1)
                value = page[at + 1 : end]
                at = end
                keep()
                state = "before name"
            elif c == ">" or c in "\"'":
                keep()
                state = "before name"
                at -= 1
            elif not blank:
                value, state = c, "unquoted"
        elif blank or c == ">":
            keep()
            state = "before name"
            at -= c == ">"
        else:
            value += c
        at += 1
    return None


def test_attributes_against_the_states_of_the_standard():
    rng = random.Random(7)
    bits = ["a", "b", "hidden", "'", '"', "=", " ", "/", "\n", "x>", ">", "text "]
    for _ in range(20_000):
        page = "<p" + rng.choice(["", " ", "/"]) + "".join(rng.choices(bits, k=rng.randint(0, 12)))
        want, m = plain_tag(page, 0), h.TAG.match(page)
        if want is None:
            assert m["unended"] is not None, page
            continue
        assert m["unended"] is None and m.end() == want[0], page
        assert h.Element("p", m["rest"]).attributes() == want[1], page


@pytest.mark.parametrize("page,text", CASES)
def test_layout(page, text):
    assert h.render(page) == text


def test_any_input_is_rendered():
    rng = random.Random(1)
    bits = ["<", ">", "</", "p", "div", "<td>", "<tr>", "<table>", "</table>", "<li>", "<ul>", '"', "'", "=", " ", "&lt", "<!--", "-->", "text", "<script>", "<pre>", "\n", "<br/>"]
    for _ in range(2000):
        h.render("".join(rng.choices(bits, k=rng.randint(0, 40))))
    assert h.render("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert h.render("<table><tr><td>" * 3000 + "in").strip() == "in"
    assert h.render("<p>" + "word " * 200_000).count("word") == 200_000


def test_no_visible_word_is_lost(spark, sf):
    """Against a plain walk over the library parser's text events."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.off, self.words = 0, []

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.off:
                self.words += data.split()

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op7_html(spark, sf).collect()
    assert {r.page_id for r in got} == set(pages) and len(got) == len(pages)
    for r in got:
        plain = Words()
        plain.feed(pages[r.page_id])
        plain.close()
        shown = [w for w in r.text.replace("\n- ", "\n").removeprefix("- ").split()]
        assert "".join(shown) == "".join(plain.words)
        assert r.n_lines == r.text.count("\n") + 1


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (None, "u", "<p>a", "y"), (1, None, "", "z"), (1, None, "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text, r.n_lines) for r in h.page_texts(pages).collect()), key=str)
    assert got == sorted([(1, "", 0), (None, "a", 1), (1, "", 0), (1, "", 0)], key=str)
    assert h.page_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize("deep", [0, 149, 150, 151, 20_000])
def test_rules_hold_at_any_depth(deep):
    for tag in ("div", "font", "b"):
        inner = "<div hidden>no<div>no</div></div><svg>no</svg><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><pre>a  b</pre>"
        got = h.render(f"<{tag}>" * deep + inner + f"</{tag}>" * deep + "end")
        assert got == "- x\n- y\n\n1  2\n\na  b\n\nend"
    # End tags of deeper elements do not end a hidden one further out.
    assert h.render("<div hidden>" + "<div>" * deep + "</div>" * deep + "no</div>yes") == "yes"


def test_deep_unclosed_tags_take_linear_time():
    assert h.render("<b>" * 50_000 + "</i>" * 50_000 + "<p>x" * 1000).count("x") == 1000
