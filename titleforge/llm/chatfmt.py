"""Chat formatting (operator 10): relational, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "tool")


def format_chats(turns: DataFrame, unknown_role: str = "user") -> DataFrame:
    """One row per conversation: (conv_id, n_turns, n_messages, text).

    One shuffle on conv_id collects the turns as structs, which are sorted by (turn, role, text); neighbours of one
    role merge into one message, their texts joined by a line feed; messages read ``<|role|>`` LF text LF ``<|end|>``,
    joined by line feeds. Merging compares each struct with the one before it, so a long conversation takes linear
    time and memory.

    Defined cases: a role outside ROLES, or null, counts as ``unknown_role``; roles are trimmed and lower-cased; a null
    or blank text is left out (it counts in n_turns, not in messages, and doesn't separate its neighbours); a null turn
    sorts last; equal turns sort by role, then text; repeated rows stay; a null conv_id is a conversation of its own;
    a conversation of no text has the text '' and 0 messages. Other columns are ignored. An empty table gives no rows.
    """
    role = F.lower(F.trim(F.col("role")))
    role = F.when(role.isin(*ROLES), role).otherwise(F.lit(unknown_role))
    said = F.struct(F.col("turn").isNull().alias("no_turn"), F.col("turn").alias("turn"), role.alias("role"), F.col("text").alias("text"))
    has_text = F.coalesce(F.trim(F.col("text")) != "", F.lit(False))
    by_conv = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(F.when(has_text, said))).alias("s"))
    before = lambda i: F.element_at("s", i)["role"]  # noqa: E731  (i counts from 0, element_at from 1: the struct before)
    opens = lambda x, i: F.when(i == 0, F.lit(True)).otherwise(x["role"] != before(F.greatest(i, F.lit(1))))
    piece = lambda x, i: F.concat(F.when(i == 0, F.lit("")).when(opens(x, i), F.lit("\n<|end|>\n")).otherwise(F.lit("\n")), F.when(opens(x, i), F.concat(F.lit("<|"), x["role"], F.lit("|>\n"))).otherwise(F.lit("")), x["text"])
    starts = F.aggregate(F.transform("s", lambda x, i: opens(x, i).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x)
    body = F.array_join(F.transform("s", piece), "")
    return by_conv.select("conv_id", "n_turns", starts.alias("n_messages"), F.when(F.size("s") > 0, F.concat(body, F.lit("\n<|end|>"))).otherwise(F.lit("")).alias("text"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, text,
         CASE WHEN lower(trim(role)) IN ('system', 'user', 'assistant', 'tool') THEN lower(trim(role)) ELSE 'user' END AS role
  FROM conversations),
s AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS i,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS before
  FROM t WHERE trim(text) <> ''),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS m FROM s),
m AS (SELECT conv_id, m, '<|' || min(role) || '|>' || chr(10) || string_agg(text, chr(10) ORDER BY i) || chr(10) || '<|end|>' AS message FROM g GROUP BY conv_id, m),
c AS (SELECT conv_id, count(*) AS n_messages, string_agg(message, chr(10) ORDER BY m) AS text FROM m GROUP BY conv_id)
SELECT a.conv_id, a.n_turns, coalesce(c.n_messages, 0) AS n_messages, coalesce(c.text, '') AS text
FROM (SELECT conv_id, count(*) AS n_turns FROM t GROUP BY conv_id) a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
"""
