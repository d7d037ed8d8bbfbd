"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Logs often hold a conversation again at every turn. Each turn is hashed with its position, and a running combination of
the hashes identifies every prefix of a conversation (two 64-bit hashes). A conversation whose whole hash is a
proper prefix of another one's is dropped by an anti-join; of equal ones the least conv_id stays. What stays is rendered.

Only hashes are shuffled to find the conversations to keep, and both sides of the anti-join hold a hash once, so a first
turn or a conversation that a third of the log shares isn't hot. The texts of those kept are shuffled once, to be rendered.

Defined results: turns are ordered by turn, role and text hash (nulls first); rows that repeat a turn with its role and
text count once; a null conv_id is a conversation of its own; a null role renders as `unknown`, a null text as an empty
one, and either differs from an empty string; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.llm.common import settled

#: A conversation's key: plain columns without nulls, so that joins, windows and groups share one partitioning.
KEY = ["absent", "cid"]
#: How a turn is rendered: before the role, after it, after the text.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    conv_id = F.col("conv_id").cast("long")
    turns = conversations.select(conv_id.isNull().alias("absent"), F.coalesce(conv_id, F.lit(0)).alias("cid"), F.col("turn").cast("long").alias("turn"), "role", "text")
    content = [F.isnull("role"), "role", F.isnull("text"), "text"]
    return turns.withColumns({"content": F.xxhash64(F.lit(1), *content), "content2": F.xxhash64(F.lit(2), *content)})


def _numbered(turns: DataFrame) -> DataFrame:
    """turns without repeats, with their position k from 1 on."""
    order = Window.partitionBy(*KEY).orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "content", "content2")
    same = F.lag(F.lit(True)).over(order) & (F.lag("turn").over(order).eqNullSafe(F.col("turn"))) & (F.lag("content").over(order) == F.col("content")) & (F.lag("content2").over(order) == F.col("content2"))
    return turns.withColumn("again", F.coalesce(same, F.lit(False))).filter(~F.col("again")).drop("again").withColumn("k", F.row_number().over(order).cast("long"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(absent, cid, n_turns, n_copies) of the conversations that stay: the key, which is (true, 0) for the null conv_id."""
    numbered = _numbered(_turns(conversations).drop("text"))
    so_far = Window.partitionBy(*KEY).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*KEY)
    prefixes = numbered.select(
        *KEY,
        "k",
        F.count("*").over(whole).alias("n"),
        F.bit_xor(F.xxhash64("k", "content", "content2")).over(so_far).alias("h1"),
        F.bit_xor(F.xxhash64("content2", "k", "content")).over(so_far).alias("h2"),
    )
    prefixes = settled(prefixes)
    classes = prefixes.filter("k = n").groupBy("n", "h1", "h2").agg(F.min(F.struct(*KEY)).alias("key"), F.count("*").alias("n_copies"))
    proper = prefixes.filter("k < n").select(F.col("k").alias("n"), "h1", "h2").distinct()
    return classes.join(proper, ["n", "h1", "h2"], "left_anti").select("key.*", F.col("n").alias("n_turns"), "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations."""
    keep = maximal(conversations)
    kept = _turns(conversations).join(keep.select(*KEY), KEY, "left_semi")
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    lines = _numbered(kept).select(*KEY, "k", line.alias("line"))
    texts = lines.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda t: t["line"]), "").alias("rendered"))
    return texts.join(keep, KEY).select(F.when(~F.col("absent"), F.col("cid")).alias("conv_id"), "n_turns", "n_copies", "rendered")


#: The same in SQL: prefixes are compared as lists of turns.
ORACLE = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
p AS (SELECT conv_id, k, n, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY k) AS turns FROM r),
c AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies, turns FROM p WHERE k = n GROUP BY n, turns)
SELECT c.conv_id, c.n_turns, c.n_copies,
       list_aggregate(list_transform(c.turns, lambda x: '{OPEN}' || coalesce(x.r, 'unknown') || replace('{MIDDLE}', chr(92) || 'n', chr(10)) || coalesce(x.t, '') || replace('{CLOSE}', chr(92) || 'n', chr(10))), 'string_agg', '') AS rendered
FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.turns = c.turns)
"""
