"""Queries for questions, history, prompts and answers (W4, W5, J7, P13-P16,
F6-F12, S11, S12, M7)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import register
from quarry.catalog import sqlfrag as Q
from quarry.catalog.retrieval import QUESTIONS_SQL, _index, _questions, knn_sql, page_chunks_sql
from quarry.functions.prompt import (ANSWER_TEMPLATE, CONDENSE_TEMPLATE, fill_template, fill_template_sql,
                                     speaker_label_sql)
from quarry.operators import history as H
from quarry.operators.generate import batch_answer
from quarry.plans.ask import ask
from quarry.sources.requests import answers_json, parse_requests, to_requests
from quarry.sources.tables import table


def _conv(spark, sf):
    return table(spark, sf, "conversations")


LINE_SQL = f"{speaker_label_sql('role')} || ': ' || coalesce(text, '')"


def history_sql() -> str:
    return f"""hist AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS q_id, conv_id, turn, role,
  coalesce(list(line) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS h
  FROM (SELECT *, {LINE_SQL} AS line FROM conversations))"""


@register("chat_history", "W4", lambda: f"""WITH {history_sql()}
SELECT q_id, conv_id, turn, role, CAST(len(h) AS BIGINT) AS n_history, array_to_string(h, chr(10)) AS chat_history FROM hist""")
def q_chat_history(spark, sf):
    return H.chat_history(_conv(spark, sf)).drop("text")


SEGMENT_SQL = f"SELECT *, CAST(turn // 4 AS BIGINT) AS segment, {LINE_SQL} AS line FROM conversations"


@register("history_segments", "W4", f"""SELECT conv_id, segment, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY turn) AS lines
FROM ({SEGMENT_SQL}) GROUP BY conv_id, segment""")
def q_history_segments(spark, sf):
    """Every line stored once, four turns a segment."""
    return H.history_segments(_conv(spark, sf), turns=4).withColumn("lines", F.array_join("lines", "\n"))


@register("history_references", "W4", f"""SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS q_id, conv_id, turn, role, segment,
  count(*) OVER (PARTITION BY conv_id, segment ORDER BY turn) - 1 AS n_tail, count(*) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n_history
FROM ({SEGMENT_SQL})""")
def q_history_references(spark, sf):
    return H.history_references(_conv(spark, sf), turns=4).drop("text")


@register("history_rendered", "W4", lambda: f"""WITH {history_sql()}
SELECT q_id, conv_id, turn, role, CAST(len(h) AS BIGINT) AS n_history, array_to_string(h, chr(10)) AS chat_history FROM hist
WHERE turn = (SELECT max(turn) FROM conversations c WHERE c.conv_id = hist.conv_id)""")
def q_history_rendered(spark, sf):
    """The history of every conversation's newest message, from segments."""
    conv = _conv(spark, sf)
    refs = H.history_references(conv, turns=4)
    newest = refs.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return (H.render_history(refs.join(newest, ["conv_id", "turn"]), H.history_segments(conv, turns=4))
            .select("q_id", "conv_id", "turn", "role", "n_history", "chat_history"))


def token_buffer_sql(limit: int = H.MAX_HISTORY_TOKENS, conversations: str = "conversations") -> str:
    return f"""tb0 AS (SELECT *, {LINE_SQL} AS line,
  greatest(coalesce(len({Q.token_list('text')}), 0), 1) AS tok FROM {conversations}),
tb1 AS (SELECT *, coalesce(sum(tok) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM tb0),
tb2 AS (SELECT *, list({{'turn': turn, 'line': line}}) OVER (PARTITION BY conv_id ORDER BY p RANGE BETWEEN {limit} PRECEDING AND CURRENT ROW) AS cand FROM tb1),
tb AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS q_id, conv_id, turn, role, text,
  list_sort(list_filter(cand, lambda x: x.turn < turn)) AS kept FROM tb2)"""


@register("token_buffer", "W5", lambda: f"""WITH {token_buffer_sql()}
SELECT q_id, conv_id, turn, role, CAST(len(kept) AS BIGINT) AS n_history,
  array_to_string(list_transform(kept, lambda x: x.line), chr(10)) AS chat_history FROM tb""")
def q_token_buffer(spark, sf):
    return H.token_buffer(_conv(spark, sf)).drop("text")


@register("nonempty_questions", "P13", """SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS q_id, text AS question
FROM conversations WHERE role = 'user' AND text IS NOT NULL AND text <> ''""")
def q_nonempty_questions(spark, sf):
    return H.nonempty_questions(_questions(spark, sf)).select("q_id", "question")


LONG_SQL = "(SELECT conv_id % 3 AS conv_id, conv_id * 1000 + turn AS turn, role, text FROM conversations)"


@register("token_buffer_long", "W5", lambda: f"""WITH {token_buffer_sql(conversations=LONG_SQL)}
SELECT q_id, conv_id, turn, role, CAST(len(kept) AS BIGINT) AS n_history,
  array_to_string(list_transform(kept, lambda x: x.line), chr(10)) AS chat_history FROM tb""")
def q_token_buffer_long(spark, sf):
    """Three conversations that hold all messages, with turns far above 1000."""
    joined = _conv(spark, sf).select((F.col("conv_id") % 3).alias("conv_id"),
                                     (F.col("conv_id") * 1000 + F.col("turn")).alias("turn"), "role", "text")
    return H.token_buffer(joined).drop("text")


@register("transcript_view", "P16,F11", f"""SELECT c.conv_id, c.turn, CASE WHEN role = 'user' THEN '{H.PERSON_NAME}' ELSE '{H.BOT_NAME}' END AS name,
CASE WHEN role = 'user' THEN 'right' ELSE 'left' END AS side, text, strftime(e.ts, '%H:%M') AS time
FROM conversations c LEFT JOIN events e ON e.event_id = c.conv_id * 10 + c.turn""")
def q_transcript_view(spark, sf):
    """Messages with a time of day, taken from the events table."""
    e = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").select("event_id", "ts")
    timed = (_conv(spark, sf).withColumn("event_id", F.col("conv_id") * 10 + F.col("turn"))
             .join(e, "event_id", "left"))
    return H.transcript_view(timed, "ts").select("conv_id", "turn", "name", "side", "text", "time")


ENC_SQL = ("replace(replace(replace(replace(replace(url_encode(coalesce(text, '')), '%21', '!'), '%2A', '*'), "
           "'%27', ''''), '%28', '('), '%29', ')')")


@register("encode_question", "F9", f"""SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS q_id, {ENC_SQL} AS encoded
FROM conversations WHERE role = 'user'""")
def q_encode_question(spark, sf):
    from quarry.functions.urls import encode_component
    q = _questions(spark, sf)
    return q.select("q_id", encode_component(F.coalesce(F.col("question"), F.lit(""))).alias("encoded"))


@register("parse_requests", "S11,F10", f"""SELECT q_id, request_url, url_decode(replace(regexp_extract(request_url, '[?&]msg=([^&#]*)', 1), '+', ' ')) AS msg
FROM (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS q_id, '/get?msg=' || {ENC_SQL} AS request_url FROM conversations WHERE role = 'user')""")
def q_parse_requests(spark, sf):
    """Round trip: questions → request URLs (as the browser encodes them) → msg."""
    q = _questions(spark, sf).withColumn("question", F.coalesce(F.col("question"), F.lit("")))
    return parse_requests(to_requests(q)).select("q_id", "request_url", "msg")


HISTORY = "array_to_string(list_transform(kept, lambda x: x.line), chr(10))"


@register("build_prompt", "F6,F8", lambda: f"""WITH {token_buffer_sql()}
SELECT q_id, {fill_template_sql(ANSWER_TEMPLATE, {'chat_history': HISTORY, 'context': "''", 'question': 'text'})} AS prompt
FROM tb WHERE role = 'user'""")
def q_build_prompt(spark, sf):
    """Answer prompt per user turn with its token-bounded history; the original
    question is used (rephrasing is off), the context slot left empty."""
    h = H.token_buffer(_conv(spark, sf)).where(F.col("role") == "user")
    return h.select("q_id", fill_template(ANSWER_TEMPLATE, {"chat_history": F.col("chat_history"),
                                                            "context": F.lit(""),
                                                            "question": F.col("text")}).alias("prompt"))


@register("condense_prompt", "F7", lambda: f"""WITH {token_buffer_sql()}
SELECT q_id, {fill_template_sql(CONDENSE_TEMPLATE, {'chat_history': HISTORY, 'question': 'text'})} AS prompt
FROM tb WHERE role = 'user'""")
def q_condense_prompt(spark, sf):
    h = H.token_buffer(_conv(spark, sf)).where(F.col("role") == "user")
    return h.select("q_id", fill_template(CONDENSE_TEMPLATE, {"chat_history": F.col("chat_history"),
                                                              "question": F.col("text")}).alias("prompt"))


def answers_sql(extra: str = "") -> str:
    return ("WITH RECURSIVE " + page_chunks_sql() + ", " + QUESTIONS_SQL + ", " + knn_sql("qs", 1)
            + """, a AS (SELECT q_id, string_agg(c.text, chr(10) || chr(10) ORDER BY rank) AS context,
  first(c.source ORDER BY rank) AS source FROM ranked r JOIN pchunks c USING (chunk_id) GROUP BY q_id),
ans AS (SELECT q.q_id, coalesce(a.context, '') AS answer, a.source FROM qs q LEFT JOIN a USING (q_id))""" + extra)


def _answers(spark, sf, history=None):
    out = ask(_questions(spark, sf), _index(spark, sf), k=1, history=history)
    return batch_answer(out)


@register("history_prompt", "J7,F6", lambda: "WITH RECURSIVE " + page_chunks_sql() + ", " + QUESTIONS_SQL + ", "
          + knn_sql("qs", 1) + ", " + token_buffer_sql() + f""", a AS (SELECT q_id, string_agg(c.text, chr(10) || chr(10) ORDER BY rank) AS context
  FROM ranked r JOIN pchunks c USING (chunk_id) GROUP BY q_id)
SELECT q.q_id, {fill_template_sql(ANSWER_TEMPLATE, {'chat_history': "array_to_string(list_transform(tb.kept, lambda x: x.line), chr(10))", 'context': 'a.context', 'question': 'q.question'})} AS prompt
FROM qs q LEFT JOIN a USING (q_id) LEFT JOIN tb USING (q_id)""")
def q_history_prompt(spark, sf):
    """Question joined with its token-bounded history and its retrieved context."""
    hist = H.token_buffer(_conv(spark, sf)).select("q_id", "chat_history")
    return ask(_questions(spark, sf), _index(spark, sf), k=1, history=hist).select("q_id", "prompt")


@register("batch_answer", "M7", lambda: answers_sql(" SELECT q_id, source, answer FROM ans"))
def q_batch_answer(spark, sf):
    """Prompt column → answer column through the predictor hook (default: the
    extractive stand-in, no model shipped)."""
    return _answers(spark, sf).select("q_id", "source", "answer")


@register("answers_json", "S12,P14,T2,F12", lambda: answers_sql(
    " SELECT q_id, CAST(to_json({'answer': answer, 'source': source}) AS VARCHAR) AS json FROM ans"))
def q_answers_json(spark, sf):
    return answers_json(_answers(spark, sf)).select("q_id", "json")


@register("cite_sources", "P15", lambda: answers_sql(
    f""" SELECT q_id, CASE WHEN source IS NOT NULL AND source <> '' THEN answer || {Q.sql_lit(H.SOURCES_PREFIX)} || source
    ELSE answer || {Q.sql_lit(H.NO_SOURCES)} END AS cited FROM ans"""))
def q_cite_sources(spark, sf):
    return H.cite_sources(_answers(spark, sf)).select("q_id", "cited")
