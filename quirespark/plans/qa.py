"""Queries on question answering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import inference, qa
from quirespark.plans.inputs import longs, table


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.turn_pairs(table(spark, sf_dir, "conversations"))


def qa_history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.history(_pairs(spark, sf_dir))


def qa_text_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each conversation: its first message as the question, the document of that number as the paper."""
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "text")
    rows = first.join(docs, "conv_id").join(qa_history_window(spark, sf_dir).select("conv_id", "history"), "conv_id", "left")
    return rows.select("conv_id", qa.qa_prompt(F.col("question"), F.col("text"), F.col("history")).alias("prompt"))


def qa_summary_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", qa.summary_prompt(F.col("text")).alias("prompt"))


def _replies():
    return F.element_at(F.array(*map(F.lit, ("是", "否", "不是", "答案：是", "  是的", "我认为这里不需要是"))), (F.col("conv_id") % 6 + 1).cast("int"))


def qa_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", qa.needs_vision(_replies()).alias("needs_vision"))


def qa_image_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that a question names, of as many as the conversation's number allows."""
    question = F.element_at(F.array(*map(F.lit, ("第二张图说明了什么", "图1和表3", "第十一张图", "流程图", "贡献", "图 5 与第3幅图"))), (F.col("conv_id") % 6 + 1).cast("int"))
    images = F.transform(F.sequence(F.lit(1), F.col("conv_id") % 4 + 1), lambda k: F.concat(F.lit("slice_"), k.cast("string")))
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return ids.select("conv_id", F.array_join(qa.selected_images(question, images), ",").alias("images"), F.array_join(qa.images_or_first(qa.selected_images(question, images), images), ",").alias("looked_at"))


def qa_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a stub model for each document: replies, attempts and isolated errors."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("request_key"), F.col("lang").alias("prompt"))

    def answer(prompt: str) -> str:
        if prompt == "es":
            raise ValueError("no Spanish")
        return "" if prompt == "fr" else f"reply to {prompt}"

    policy = inference.RetryPolicy(max_retries=1, delay=0.0)
    return longs(inference.call(docs, lambda: inference.StubClient(answer), "stub", policy=policy))


QUERIES = {f.__name__: f for f in (qa_history_window, qa_text_prompt, qa_summary_prompt, qa_route, qa_image_select, qa_replayed)}
_PAIRS = """WITH m AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, text AS question, answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM m WHERE role = 'user' AND next_role = 'assistant'),
h AS (SELECT conv_id, count(*) AS n_turns, string_agg('Q: ' || question || chr(10) || 'A: ' || answer || chr(10) || chr(10), '' ORDER BY turn) AS history FROM p WHERE age <= 3 GROUP BY conv_id)"""


def _quoted(template: str) -> str:
    return "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _template(template: str, **values: str) -> str:
    out = _quoted(template)
    for name, value in values.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


_CUT = "substring({c}, 1, {n})"
_MORE = "CASE WHEN length({c}) > {n} THEN '...' ELSE '' END"
ORACLES = {
    "qa_history_window": f"{_PAIRS} SELECT * FROM h",
    "qa_text_prompt": f"""{_PAIRS}, f AS (SELECT conv_id, arg_min(text, turn) AS question FROM conversations GROUP BY conv_id)
        SELECT f.conv_id, {_template(qa.QA_PROMPT, content=_CUT.format(c='d.text', n=6000), more=_MORE.format(c='d.text', n=6000), history="CASE WHEN length(history) > 0 THEN 'History:' || chr(10) || history ELSE '' END", question='f.question')} AS prompt
        FROM f JOIN documents d ON d.doc_id = f.conv_id LEFT JOIN h ON h.conv_id = f.conv_id""",
    "qa_summary_prompt": f"SELECT doc_id, {_template(qa.SUMMARY_PROMPT, content=_CUT.format(c='text', n=8000), more=_MORE.format(c='text', n=8000))} AS prompt FROM documents",
    "qa_route": "SELECT conv_id, turn, conv_id % 6 IN (0, 2, 3, 4) AS needs_vision FROM conversations",
    "qa_image_select": """WITH c AS (SELECT DISTINCT conv_id, conv_id % 6 AS q, conv_id % 4 + 1 AS n FROM conversations),
        s AS (SELECT *, CASE q WHEN 0 THEN CASE WHEN n >= 2 THEN ['slice_2'] END WHEN 1 THEN CASE WHEN n >= 3 THEN ['slice_1', 'slice_3'] ELSE ['slice_1'] END WHEN 5 THEN CASE WHEN n >= 3 THEN ['slice_3'] END END AS named FROM c),
        t AS (SELECT *, CASE WHEN named IS NOT NULL THEN named WHEN q = 4 THEN [] WHEN n >= 2 THEN ['slice_1', 'slice_2'] ELSE ['slice_1'] END AS images FROM s)
        SELECT conv_id, array_to_string(images, ',') AS images, CASE WHEN len(images) > 0 THEN array_to_string(images, ',') ELSE array_to_string(list_transform(range(1, least(n, 3) + 1), lambda k: 'slice_' || k), ',') END AS looked_at FROM t""",
    "qa_replayed": """SELECT CAST(doc_id AS VARCHAR) AS request_key, CASE WHEN lang NOT IN ('es', 'fr') THEN 'reply to ' || lang END AS reply, CAST(CASE WHEN lang IN ('es', 'fr') THEN 2 ELSE 1 END AS BIGINT) AS attempts,
        CASE lang WHEN 'es' THEN 'ValueError: no Spanish' WHEN 'fr' THEN 'NoReply: empty reply' END AS error FROM documents""",
}
