"""P1-P11 on hand-made frames, with the results written out."""
from pyspark.sql import functions as F

from quarry.functions import urls as U
from quarry.operators.links import extract_links

SEEDS = {  # seed: (base, valid)
    "https://a.com": ("https://", True),
    "https://a.com/": ("https://a.com", True),
    "https://a.com/x": ("https://a.com", True),
    "https://a.com/x/": ("https://a.com/x", True),
    "https://a.com/x/y": ("https://a.com/x", False),
    "a.com": ("a.com", True),
    "a.com/x": ("a.com", True),
    "a/x": ("a/", True),
}


def test_derive_base_and_validity(spark):
    df = spark.createDataFrame([(s,) for s in SEEDS], "seed_url string")
    got = {r.seed_url: (r.base, r.valid) for r in df.select(
        "seed_url", U.derive_base(F.col("seed_url")).alias("base"),
        U.seed_valid(F.col("seed_url")).alias("valid")).collect()}
    assert got == SEEDS


# href: the link from https://a.org and from https://a.org/ (None: not a relative link, "": refused)
LINKS = {
    None: (None, None),
    "": (None, None),
    "/": (None, None),
    "x/": ("https://a.org/x", "https://a.org/x"),
    "x//": ("https://a.org/x/", "https://a.org/x/"),
    "/x": ("https://a.org/x", "https://a.org/x"),
    "x": ("https://a.org/x", "https://a.org/x"),
    "http://h/x": (None, None),
    "//h/x": ("https://a.org//h/x", "https://a.org//h/x"),
    "a.html": ("https://a.org/a.html", "https://a.org/a.html"),
    "html/x.html": ("", ""),
    "one.com/two.com": ("", ""),
    "X.PDF": ("https://a.org/X.PDF", "https://a.org/X.PDF"),
} | {f"p{needle}q": ("", "") for needle in U.BLOCKED_HREF_NEEDLES}


def test_accept_and_absolute(spark):
    h, b = F.col("h"), F.col("base")
    for place, base in enumerate(("https://a.org", "https://a.org/")):
        df = spark.createDataFrame([(base, x) for x in LINKS], "base string, href string").withColumn("h", U.normalize_href(F.col("href")))
        rows = df.select("href", F.when(~U.href_present(h) | ~U.is_relative(h), F.lit(None))
                         .when(U.accept_href(b, h), U.absolute_link(b, h)).otherwise(F.lit("")).alias("out")).collect()
        assert {r.href: r.out for r in rows} == {x: links[place] for x, links in LINKS.items()}


def test_counted_words_of_the_base(spark):
    df = spark.createDataFrame([("https://a.com/", "b.com"), ("https://a.com/", "b"), ("https://x.html", "y.html")], "base string, href string")
    assert [r.ok for r in df.select(U.accept_href(F.col("base"), F.col("href")).alias("ok")).collect()] == [False, True, False]


def test_route(spark):
    df = spark.createDataFrame([("http://x/a.pdf",), ("http://x/a",), ("/rel",), ("/doc.pdf",)], "href string")
    got = [r.r for r in df.select(U.route(F.col("href")).alias("r")).collect()]
    assert got == ["pdf", "page", "skip", "pdf"]


def test_links_are_elements(spark):
    html = """<p><a class=x href="/one">1</a><!-- <a href='/hidden'>h</a> --><A HREF='/two&amp;x'>2</A>
<script type="a">var s = "<a href='/scripted'>";</script><link rel=a href=/style><style>a:after{content:"<a href='/styled'>"}</style>
<abbr href="/no"></abbr><a data-href="/no2"></a><!--
<link href=/hidden2> --><a href=/three>3</a></p>"""
    df = spark.createDataFrame([(1, "u", html, "kept")], "page_id long, url string, html string, more string")
    rows = extract_links(df, carry=("more",)).collect()
    assert [(r.tag, r.pos, r.href, r.more) for r in rows] == [
        ("a", 0, "/one", "kept"), ("a", 1, "/two&x", "kept"), ("a", 2, "/three", "kept"), ("link", 0, "/style", "kept")]
