"""Word-first backoff: scores against a direct computation, held-out accuracy."""
import math

from quarry.llm import langid
from quarry.llm.queries import op1_language_id


def small_model(spark, capacity=langid.CAPACITY):
    rows = [("de", "der Hund der Hund die Katze"), ("en", "the dog the dog the cat"), ("fr", "le chien élève"),
            (None, "the the the"), ("en", None)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    return langid.train(docs, capacity=capacity)


def test_known_words_and_backoff(spark):
    model = small_model(spark)
    assert model["langs"] == ["de", "en", "fr"]
    log = lambda n, total, most=6: math.log(n / total + 0.5 / most)
    words = {w: model["words"]["logs"][i].tolist() for w, i in model["words"]["index"].items()}
    assert words["dog"] == [log(0, 6), log(2, 6), log(0, 3)]
    assert words["der"] == [log(2, 6), log(0, 6), log(0, 3)]
    scorer = langid.Scorer(model)
    assert "dogs" not in words
    row = scorer.backed_off(["zzz", "dogs"])[1]
    texts = {"de": {"der": 2, "hund": 2, "die": 1, "katze": 1}, "en": {"the": 3, "dog": 2, "cat": 1}, "fr": {"le": 1, "chien": 1, "élève": 1}}
    counts = [{}, {}, {}]
    for i, found in enumerate(texts.values()):
        for w, n in found.items():
            m = f"<{w}>"
            for g in (m[a:b] for a in range(len(m)) for b in range(a + 1, min(len(m), a + 5) + 1)):
                if g not in "<>":
                    counts[i][g] = counts[i].get(g, 0) + n
    total = [{k: sum(n for g, n in c.items() if len(g) == k) for k in range(1, 6)} for c in counts]
    longest = [next((g for g in ("<dogs>"[at:at + n] for n in range(5, 0, -1)) if g not in "<>" and any(g in c for c in counts)), None)
               for at in range(6)]
    assert longest[0] == "<dog" and longest[5] is None       # "<dogs" was never seen: one character less
    longest = [g for g in longest if g]
    for i in range(3):
        want = sum(log(counts[i].get(g, 0), total[i][len(g)], max(t[len(g)] for t in total)) for g in longest) / len(longest)
        assert abs(row[i] - want) < 1e-12
    assert scorer.predict(b"the dogs")[0] == "en"
    assert scorer.predict("élève".encode())[0] == "fr"


def test_defined_results(spark):
    scorer = langid.Scorer(small_model(spark))
    for text in (None, b"", b" 123 -- \n", "²³".encode()):
        assert scorer.predict(text) == ("und", 0.0)
    lang, score = scorer.predict("日本".encode())
    assert lang == "de" and abs(score - 1 / 3) < 1e-9
    empty = langid.train(spark.createDataFrame([], "lang string, text string"))
    assert langid.Scorer(empty).predict(b"the dog") == ("und", 0.0)
    assert 0 <= scorer.predict(b"dog " * 100_000)[1] <= 1


def test_known_units_are_bounded(spark):
    model = small_model(spark, capacity=9)          # three per language
    assert sorted(model["words"]["index"]) == ["chien", "der", "dog", "hund", "le", "the", "élève"]


def test_words_in_parts_give_the_same(spark, monkeypatch):
    model = small_model(spark)
    text = " ".join(f"{a}{b}o{c}" for a in "dtlcz" for b in "aeio" for c in "gnstk").encode()
    want = langid.Scorer(model).sums(text)
    monkeypatch.setattr(langid, "WORDS_TOGETHER", 7)
    assert abs(langid.Scorer(model).sums(text) - want).max() < 1e-9


def test_identify_keeps_columns(spark):
    model = small_model(spark)
    docs = spark.createDataFrame([(1, "the dog", "a"), (None, None, None)], "doc_id long, text string, score string")
    got = langid.identify(docs, model, keep=("score", "text", "doc_id"), names=("l", "s"))
    assert got.columns == ["score", "text", "doc_id", "l", "s"]
    assert {(r.doc_id, r.text, r.score, r.l) for r in got.collect()} == {(1, "the dog", "a", "en"), (None, None, None, "und")}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op1_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held)
    assert 150 < len(held) < 350 and right > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_a_known_word_has_its_counts_in_all_languages(spark):
    docs = spark.createDataFrame([("a", "x x x x y"), ("b", "z z z z z z z z y")], "lang string, text string")
    words = langid.train(docs, capacity=10)["words"]          # from a fifth of a language's words on
    log = lambda n, total: math.log(n / total + 0.5 / 9)
    assert sorted(words["index"]) == ["x", "y", "z"]
    assert words["logs"][words["index"]["y"]].tolist() == [log(1, 5), log(1, 9)]


def unsegmented(rng, n):
    return "".join(chr(0x4E00 + int(2000 * rng.random() ** 2)) for _ in range(n))


def test_a_language_without_known_words_takes_none_of_another(spark):
    """Runs of letters that occur once each, more of them than the model holds words:
    that language has no known word, and both languages are told apart."""
    import random
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = [("en", " ".join(rng.choice(vocabulary) for _ in range(40))) for _ in range(60)]
    rows += [("zh", " ".join(unsegmented(rng, rng.randint(6, 12)) for _ in range(40))) for _ in range(300)]
    docs = spark.createDataFrame([(i, x, t) for i, (x, t) in enumerate(rows)], "doc_id long, lang string, text string")
    for capacity in (200, 2000, 10 ** 6):
        model = langid.train(docs, capacity=capacity)
        got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
        assert [got[i] for i in range(len(rows))] == [x for x, _ in rows], capacity


def test_many_labels_teach_within_bounds(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    docs = spark.createDataFrame([(x, f"word{x} " * n) for n, x in enumerate("abcdef", start=1)], "lang string, text string")
    model = langid.train(docs)
    assert model["langs"] == ["d", "e", "f"] and langid.Scorer(model).predict(b"wordf")[0] == "f"


def test_remembered_words_score_the_same(spark, monkeypatch):
    model = small_model(spark)
    texts = [b"dogs and cats, dogs", None, b"", "élève chiens zzz".encode(), b"dogs"]
    want = [langid.Scorer(model).predict(t) for t in texts]
    for remembered in (langid.REMEMBERED, 2):
        monkeypatch.setattr(langid, "REMEMBERED", remembered)
        scorer = langid.Scorer(model)
        for got in (scorer.predict_all(texts), scorer.predict_all(texts)):
            assert [x for x, _ in got] == [x for x, _ in want]
            assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, want, strict=True))
