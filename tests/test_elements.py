"""Page text by elements."""
import pytest

from quarry.functions.elements import element_text, page_text


@pytest.mark.parametrize("html, text", [
    ("<p>a</p><p>b</p>", "a\nb"),
    ("<p>a<p>b<div>c</div>d", "a\nb\nc\nd"),                               # paragraphs that are never closed
    ("<ul><li>x<ul><li>y<li>z</ul><li>w</ul>end", "x\ny\nz\nw\nend"),      # nested lists, open items
    ("<table><tr><td>1<td>2<tr><td>3</table>4", "1\n2\n3\n4"),
    ("<b>bold <i>both</b> after</i>!", "bold both after!"),                # crossed tags
    ("<head><title>t</title><meta x>no<body><p>yes", "yes"),               # an open head ends at the body
    ("<div>a<template>no<p>no</template>b</div>", "ab"),
    ("<div><template>no</div>b", "b"),                                     # an open invisible element ends with its parent
    ("a<!-- <p>no</p> -->b<!-->c", "abc"),
    ("<script>if (a < b) { '<p>' }</script>x<style>p > a {}</style>y", "xy"),
    ("<a title='1 > 0' href=\"/x>y\">link</a>", "link"),                   # > inside attributes
    ("&lt;p&gt; &amp;lt; &eacute;&#233;&#xE9; &hellip; &notit; &nbsp; &#128;", "<p> &lt; ééé … ¬it; €"),
    ("a <br> b<br/>c<hr>d", "a\nb\nc\nd"),
    ("  x \t y\r\n\r\n z ", "x y\nz"),
    ("<p>code:</p><pre>  two\n\n    four</pre><p>end</p>", "code:\n  two\n\n    four\nend"),
    ("<!DOCTYPE html><html><body><h1>T</h1>t</body></html>", "T\nt"),
    ("<p>never closed <b", "never closed"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("", ""), (None, None), ("no markup", "no markup"), ("</p></div>stray", "stray"),
])
def test_fixtures(html, text):
    assert page_text(html) == text


def test_frame_keeps_columns_and_depth_is_no_limit(spark):
    deep = "<div>" * 20000 + "x" + "</div>" * 19999
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "keep"), (2, "v", None, None), (3, "w", deep, "k")],
                               "page_id long, url string, html string, text2 string")
    got = sorted(element_text(df).collect())
    assert got == [(1, "u", "keep", "a"), (2, "v", None, None), (3, "w", "k", "x")]
