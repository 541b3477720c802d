"""The numbered queries, each over its whole table, and the oracle SQL of
those that SQL can express."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (alignment, langid, mixing, periodic, quality_classifier, quality_rules, secret_scan, simhash,
                        substring_dedup, suffix_dedup, topk, toxicity, unigram)
from quarry.llm.common import documents, id_crc, is_remainder, labels

QUERIES = {}
ORACLE_SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held = is_remainder("doc_id", 4, 2)
    return (langid.identify(docs, langid.train(docs.where(~held)))
            .select("doc_id", held.alias("held_out"), "lang_pred", "score"))


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return (simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
            .select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.col("component").alias("component_id")))


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text, how many are bytes, and the digest of what they
    decode to."""
    model = unigram.load()
    rows = unigram.encode(documents(spark, sf_dir, "doc_id", "text"), model).drop("text")
    kept = rows.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"),
                       unigram.byte_pieces(model).alias("n_bytes"), "pieces", F.col("pieces").alias("again"))
    return (unigram.decode(kept, model, "again")
            .select("doc_id", F.when(F.col("pieces").isNotNull(), F.col("n_pieces")).otherwise(0).alias("n_pieces"),
                    F.when(F.col("pieces").isNotNull(), F.col("n_bytes")).otherwise(0).alias("n_bytes"), "pieces",
                    F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels that are not held out."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    held = is_remainder("doc_id", 3, 1)
    model = toxicity.train(docs, labels(spark, sf_dir, "doc_id", "toxic").where(~held))
    return (toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
            .select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "mean_ratio"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to documents with smaller ids."""
    rows = suffix_dedup.remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL["op5_suffix_dedup"] = """
WITH texts AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT doc_id, b, unnest(range(0, greatest(n - 49, 0))) AS p FROM texts),
strings AS (SELECT doc_id, p, b[p + 1:p + 50] AS s FROM starts),
first_owner AS (SELECT s, min(doc_id) AS least FROM strings GROUP BY s),
lost AS (
  SELECT t.doc_id, t.p FROM strings t JOIN first_owner f ON t.s = f.s WHERE f.least < t.doc_id),
runs AS (
  SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM lost),
numbered AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM runs),
spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS z FROM numbered GROUP BY doc_id, span),
gaps AS (
  SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_here FROM spans),
cut AS (
  SELECT g.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last,
         string_agg(hex(t.b[from_here + 1:a]), '' ORDER BY a) AS head
  FROM gaps g JOIN texts t ON t.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT t.doc_id, t.n::BIGINT AS n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed,
       coalesce(c.n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN c.doc_id IS NULL THEN t.b ELSE unhex(coalesce(c.head, '') || hex(t.b[c.last + 1:t.n])) END) AS kept_sha256
FROM texts t LEFT JOIN cut c ON c.doc_id = t.doc_id
"""


@query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return (mixing.mix_plan(documents(spark, sf_dir, "doc_id", "text", "source"))
            .select("doc_id", "size", "source_size", "target", "taken", "copies"))


ORACLE_SQL["op6_mix_sources"] = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
placed AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM per_source),
weighed AS (
  SELECT *, ([5, 2, 1])[((place - 1) % 3 + 1)::INT]::BIGINT AS weight,
         (sum(source_size) OVER ())::BIGINT AS all_size FROM placed),
running AS (
  SELECT *,
    coalesce(sum(source_size) OVER (ORDER BY source_size / weight, place
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS size_before,
    (sum(weight) OVER (ORDER BY source_size / weight, place
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight_from
  FROM weighed),
marked AS (
  SELECT *, (3 * all_size - 4 * size_before) * weight > 4 * source_size * weight_from AS stopped FROM running),
opened AS (
  SELECT *, (sum(CASE WHEN stopped THEN source_size ELSE 0 END) OVER ())::BIGINT AS open_size,
         (sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER ())::BIGINT AS open_weight FROM marked),
targets AS (
  SELECT source, source_size,
    CASE WHEN stopped THEN (2 * source_size)::DOUBLE
         ELSE (weight * (3 * all_size - 4 * open_size))::DOUBLE / (2 * open_weight)::DOUBLE END AS target
  FROM opened),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0::DOUBLE END AS rate FROM targets),
drawn AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, r.rate,
    ('0x' || substr(md5('mix-1|' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
counted AS (
  SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM drawn)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM counted
"""


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; documents of label 1 are trusted."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    trusted = labels(spark, sf_dir, "doc_id", "quality").where("quality = 1").select("doc_id")
    return (quality_rules.rules(docs, trusted).withColumnRenamed("id", "doc_id")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "ratio"))


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, as counts and digests of their spans."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    spans = secret_scan.scan(docs, secret_scan.train(docs))
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"),
                        F.sha2(secret_scan.span_digest(base).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.span_digest(F.col("spans")).alias("spans"))


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels that are not held out."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    held = is_remainder("doc_id", 5, 0)
    weights = quality_classifier.train(docs, labels(spark, sf_dir, "doc_id", "quality").where(~held))
    return (quality_classifier.score(docs, weights).withColumnRenamed("id", "doc_id")
            .select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")))


@query
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every vector whose id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    vectors = topk.integer_vectors(rows, "vec_id", "embedding")
    return topk.top_k(vectors.where(F.col("id") % 100 == 0), vectors, 10)


ORACLE_SQL["op10_top_k"] = """
WITH whole AS (
  SELECT vec_id, [floor(x::DOUBLE * 1024)::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id,
    list_sum([q.v[i] * x.v[i] FOR i IN range(1, len(q.v) + 1)])::BIGINT AS score
  FROM whole q JOIN whole x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, place::INT AS rank, vec_id, score FROM ranked WHERE place <= 10
"""


WORDS = r"[^\x20\x09-\x0D]+"


def periodic_tails(docs: DataFrame) -> DataFrame:
    """Documents whose id's crc32 ends in 0 get a periodic tail: with g the other
    digits, word i >= a = g % n becomes word a + (i - a) % p, p = 1 + floor((n -
    a) / (3 + g % 8)).  Null ids and texts without a word stay."""
    h = id_crc("doc_id")
    rows = docs.withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORDS), 0)))
    g, n = F.floor(h / 10), F.size("w")
    rows = rows.withColumn("a", F.when(n > 0, g % n))
    rows = rows.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    moved = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.element_at("w", (1 + F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.coalesce(F.when(F.col("a").isNotNull(), F.array_join(moved, " ")), "text").alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, after the tails above."""
    rows = periodic.find_runs(periodic_tails(documents(spark, sf_dir, "doc_id", "text")))
    best = F.get(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"], r["period"]))), F.lit(0))
    written = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return (rows.withColumn("best", best)
            .select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                    (-F.col("best.l")).alias("length"), F.col("best.period").alias("period"),
                    F.floor(-1000 * F.col("best.l") / F.col("best.period")).alias("exponent_milli"),
                    F.sha2(written.cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers in every document."""
    rows, _ = alignment.align(documents(spark, sf_dir, "doc_id", "text"), alignment.load())
    return rows.withColumnRenamed("id", "doc_id")


@query
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to windows of documents with smaller ids."""
    rows = substring_dedup.remove_passages(documents(spark, sf_dir, "doc_id", "text"))
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(F.col("id").alias("doc_id"), "n_words", lost.alias("n_removed"),
                       F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL["op13_substring_dedup"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS p FROM texts),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM starts),
first_owner AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s),
lost AS (SELECT DISTINCT x.doc_id, unnest(range(x.p, x.p + 13)) AS i FROM windows x JOIN first_owner f ON x.s = f.s WHERE f.least < x.doc_id),
gone AS (SELECT doc_id, list(i) AS g, count(*) AS n FROM lost GROUP BY doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN g.doc_id IS NULL THEN t.w
              ELSE [x FOR x, i IN t.w IF NOT list_contains(g.g, i)] END, ' ')) AS kept_sha256
FROM texts t LEFT JOIN gone g ON g.doc_id = t.doc_id
"""
