"""Pattern spans against a direct reading of the rules; the Markov spans."""
import hashlib
import re

from quarry.llm import secret_scan
from quarry.llm.queries import op8_secrets

HEXES = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"


def slow_base(text):
    out = []
    rule = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(rule, text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


TEXTS = ["", "password: hunter2hunter2", "token=api_key: hunter2hunter2", "API-KEY apikey = 'abcdefgh' é Api_Key=\"12345678\"",
         "AKIAABCDEFGHIJKL AKIA1 AKIAAKIA12", f"é {HEXES} {HEXES[:31]} x{HEXES[:32]}", f"secret:{HEXES}", "toKen=abcdefgh paſſword=abcdefgh",
         "passwd='short' secret = = token:\nabcdefghij", "password=password=password=secret"]


def test_base_spans():
    for text in TEXTS:
        assert [s[:3] for s in secret_scan.base_spans(text.encode(), text)] == slow_base(text), text


def model(spark):
    words = " ".join(f"{a}{b}{c}" for a in ("inter", "trans", "under", "over") for b in ("nation", "port", "stand") for c in ("al", "ing", "able"))
    secrets = " ".join(f"token={hashlib.sha256(str(i).encode()).hexdigest()[:40]}{'QwErTyZxKpLm'[i % 12]}9Zb" for i in range(60))
    docs = spark.createDataFrame([(1, words * 20), (2, secrets), (3, None), (4, "")], "doc_id long, text string")
    return secret_scan.train(docs)


def test_random_tokens_are_added(spark):
    ratio = model(spark)
    text = "é internationalunderstanding transportableoverstanding 7c4a8d09cZ3762af61e595Q0943dc26494f8941b0Zb9 token=abcdefgh12345678abcdef12"
    spans = secret_scan.find_spans(text.encode(), ratio)
    assert [secret_scan.KINDS[k] for _, k, _ in spans][:1] == ["markov"]
    assert all(text[a:b].startswith(("7c4a", "token")) for a, _, b in spans)
    assert secret_scan.masked(text.encode(), ratio).decode() == "é internationalunderstanding transportableoverstanding [secret] [secret]"


def test_overlapping_spans_are_masked_together(spark):
    ratio = model(spark)
    assert secret_scan.masked(f"a secret={HEXES}, b".encode(), ratio) == b"a [secret], b"


def test_frames(spark):
    ratio = model(spark)
    data = [(1, f"x {HEXES}", "a"), (None, None, None), (2, "", "b"), (2, "plain words", "b"), (2, "plain words", "b")]
    docs = spark.createDataFrame(data, "doc_id long, text string, spans string")
    got = secret_scan.scan(docs, ratio).collect()
    assert sorted((r.id or -1, len(r.spans)) for r in got) == [(-1, 0), (1, 1), (2, 0), (2, 0), (2, 0)]
    masked = secret_scan.mask_secrets(docs, ratio)
    assert masked.columns == docs.columns
    assert sorted(map(tuple, masked.collect()), key=repr) == sorted([(i, t and t.replace(HEXES, "[secret]"), s) for i, t, s in data], key=repr)
    none = docs.limit(0)
    assert secret_scan.scan(none, secret_scan.train(none)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op8_secrets(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = slow_base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        digest = [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(digest).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("markov")] == digest
    added = sum("markov" in r.spans for r in rows)
    assert added < 0.1 * len(rows)


def test_the_rest_of_a_token_and_short_tokens(spark):
    ratio = model(spark)
    key = "7c4a8d09cZ3762af61e595Q0943dc26494f8941b0Zb9"
    for text, want in ((f"AKIAABCDEFGHIJKL/{key}", [("access", 0, 16), ("markov", 16, 61)]),
                       (f"{HEXES}-{key}", [("hex", 0, 64), ("markov", 64, 109)])):
        assert [(secret_scan.KINDS[k], a, b) for a, k, b in secret_scan.find_spans(text.encode(), ratio)] == want
    assert secret_scan.find_spans(b"a 7c4a8d09c3762af6 international", ratio) == [(2, 3, 18)]


WORDS = ("user name config file path load save index count value error response request handle create update delete session manager builder "
         "factory parse write read buffer stream socket server client local remote cache table column query result array string number object "
         "module package version release signal thread process kernel driver network address header payload message queue worker monitor "
         "logger metric sample window frame image pixel color width height left right upper lower").split()


def made_up_tokens():
    import base64
    import random
    import string
    rng = random.Random(11)
    some = lambda n: [rng.choice(WORDS) for _ in range(n)]
    drawn = lambda letters: ["".join(rng.choice(letters) for _ in range(rng.randint(24, 40))) for _ in range(500)]
    ordinary = {"snake": ["_".join(some(5)) for _ in range(500)], "camel": ["".join(w.title() for w in some(5)) for _ in range(500)],
                "path": ["/" + "/".join(some(5)) for _ in range(500)], "kebab": ["-".join(some(4)) for _ in range(500)],
                "date": [f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}" for _ in range(500)],
                "number": [str(rng.randrange(10 ** 19, 10 ** 20)) for _ in range(500)]}
    randoms = {"base62": drawn(string.ascii_letters + string.digits), "hex": drawn("0123456789abcdef"),
               "base64": [base64.b64encode(rng.randbytes(rng.randint(18, 30))).decode() for _ in range(500)]}
    return ordinary, randoms


def test_identifiers_are_ordinary_and_random_strings_are_not(spark):
    """With the model of a whole table of prose, which has no identifiers."""
    ratio = secret_scan.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    share = lambda tokens: sum(any(k == 3 for _, k, _ in secret_scan.find_spans(t.encode(), ratio)) for t in tokens) / len(tokens)
    ordinary, randoms = made_up_tokens()
    assert {k: share(v) for k, v in ordinary.items() if share(v) >= 0.02} == {}
    long_hex = [t for t in randoms["hex"] if len(t) < 32]          # longer ones are pattern matches
    assert share(randoms["base62"]) > 0.95 and share(randoms["base64"]) > 0.95 and share(long_hex) > 0.95


def test_markov_spans_by_a_plain_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ratio = secret_scan.train(docs)
    ordinary, randoms = made_up_tokens()
    texts = [f"{a} é {b}. {c}" for a, b, c in zip(ordinary["snake"], randoms["base62"], randoms["hex"], strict=True)][:200]
    for text in texts + [r.text for r in docs.limit(200).collect()]:
        base = slow_base(text)
        want, at = [], 0
        hidden = {i for a, _, b in base for i in range(a, b)}
        inside = [c in secret_scan.TOKEN_CHARS and i not in hidden for i, c in enumerate(text)] + [False]
        while at < len(text):
            end = at
            while inside[end]:
                end += 1
            if end > at:
                codes = [secret_scan.TOKEN_CHARS.index(c) + 1 for c in text[at:end]]
                best = max(sum(m[x, y] for x, y in zip(codes, codes[1:])) for m in ratio)
                if best > secret_scan.THRESHOLD * max(len(codes) - 1, secret_scan.FULL_TOKEN - 1):
                    want.append((at, 3, end))
            at = end + 1
        assert secret_scan.find_spans(text.encode(), ratio) == sorted(base + want)


def test_transition_tables_are_distributions():
    import numpy as np
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, (67, 67)).astype(float)[: len(secret_scan.TOKEN_CHARS), : len(secret_scan.TOKEN_CHARS)]
    assert np.allclose(secret_scan.random_shares(counts).sum(axis=1), 1)
    total = secret_scan.ordinary_shares(counts).sum(axis=1)
    assert ((total > 0.95) & (total < 1.05)).all()
