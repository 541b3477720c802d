"""Targets, copies and the emitted mix."""
from quarry.llm import mixing


def slow_targets(sizes):
    """source -> words to source -> target, by sharing again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        left = budget - sum(2 * sizes[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        share = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in stopped else share[s] for s in names}
        stopped |= over


def rows():
    out = [(i, " ".join(["w"] * (i % 17)), ("src%d" % (i * i % 7)) if i % 3 else "src0") for i in range(600)]
    return out + [(None, "a\tb\x0bc d", None), (1000, None, None), (1001, "", "empty"), (1002, "x y", "src1"), (1002, "x y", "src1")]


def test_plan(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, "keep") for r in data], "doc_id long, text string, source string, rate string")
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(data)
    sizes = {}
    for i, text, source in data:
        n = len([w for w in (text or "").replace("\t", " ").replace("\x0b", " ").split(" ") if w])
        sizes[source] = sizes.get(source, 0) + n
    want = slow_targets(sizes)
    for r in plan:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6
        assert r.taken == r.size * r.copies <= 2 * r.size
        assert r.copies in ((int(r.rate), int(r.rate) + 1) if r.rate % 1 else (int(r.rate),))
    taken = {s: sum(r.taken for r in plan if r.source == s) for s in sizes}
    assert abs(sum(taken.values()) - sum(want.values())) < 0.1 * sum(want.values())
    assert sorted(map(tuple, plan), key=repr) == sorted(map(tuple, mixing.mix_plan(docs.repartition(7)).collect()), key=repr)


def test_mix_emits_what_the_plan_says(spark):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows())], "doc_id long, text string, source string, rate long")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    want = {}
    for r in mixing.mix_plan(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    assert got == {k: v for k, v in want.items() if v}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, "b")], none.schema)
    assert [(r.size, r.target, r.copies) for r in mixing.mix_plan(blank).collect()] == [(0, 0.0, 1)] * 2
