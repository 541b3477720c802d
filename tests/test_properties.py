"""SURVEY §5.3 properties with generated inputs."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import urls as U
from quarry.operators.chunk import chunk_documents, spans

ALPHABET = st.sampled_from(["a", "b", " ", " ", "é", "😀", " ", "\n", "\n\n", "xyz"])
TEXT = st.lists(st.one_of(ALPHABET, st.builds(lambda n: "w" * n, st.integers(900, 1100))),
                max_size=400).map("".join)
SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SLOW
@given(st.lists(TEXT, min_size=1, max_size=12))
def test_chunks_cover_the_text_within_bounds(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunk_documents(df, ["doc_id"]).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_idx, r.start, r.text))
    for i, t in enumerate(texts):
        chunks = sorted(got.get(i, []))
        assert [n for n, _, _ in chunks] == list(range(len(chunks)))
        covered = [False] * len(t)
        for _, start, text in chunks:
            at = t.index(text, start)
            assert 0 < len(text) <= 1000 and not t[start:at].strip()
            covered[at:at + len(text)] = [True] * len(text)
        assert all(c or t[p].isspace() for p, c in enumerate(covered))
        assert not t or list(spans(t, 1000, 50))[-1][1] == len(t)


HREF = st.lists(st.sampled_from(["/", "a", "html", ".com", "pdf", "png", "json", ":", ".ico", ".svg", ".si",
                                 "?", "%20", "#", "x/", "http", ".", "-"]), max_size=6).map("".join)


@SLOW
@given(st.lists(st.tuples(st.sampled_from(["https://a.org", "https://a.com/", "http://x.html"]), HREF),
                min_size=1, max_size=60))
def test_accepted_links(spark, pairs):
    """An accepted href lacks every blocked needle and, with its base, has each
    counted word at most once; the link is base and href around one slash."""
    df = spark.createDataFrame(pairs, "base string, href string").withColumn("h", U.normalize_href(F.col("href")))
    rows = df.where(U.href_present(F.col("h"))).select(
        "base", "h", U.accept_href(F.col("base"), F.col("h")).alias("ok"),
        U.absolute_link(F.col("base"), F.col("h")).alias("link")).collect()
    for r in rows:
        blocked = [n for n in U.BLOCKED_HREF_NEEDLES if n in r.h]
        counted = [w for w in U.AT_MOST_ONCE if (r.base + r.h).count(w) > 1]
        assert r.ok == (not blocked and not counted)
        assert r.link == r.base.removesuffix("/") + "/" + r.h.removeprefix("/")
