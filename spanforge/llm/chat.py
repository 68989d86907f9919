"""Preference formatting of chat data [native].

``preference_format`` takes pairs of turn lists, chosen and rejected.  The longest common prefix of
turns is rendered once as the prompt; each side's remaining turns are its completion.  A loss mask
marks, as character spans of the completion, what an assistant wrote (with its end mark).

``conversation_pairs`` builds pairs from a table of turns: a conversation up to its last assistant
turn is the chosen side; the rejected side has, in that turn's place, the last assistant reply of
the neighbouring conversation (ids 2i and 2i + 1 are neighbours).

Defined results: turns are ordered by turn, role and text, nulls first; a null text is empty and a
null role is ``user``; rows without a conversation id belong to no conversation and are left out; a
conversation without an assistant turn has two equal sides, so everything is prompt; without a
neighbour's reply the rejected completion is empty; repeated rows are repeated turns.  An empty
table gives an empty result; columns besides the four named ones are ignored.

Scale: one shuffle of turns by conversation, one equi-join of conversations by id.  One conversation
is one record and must fit a task, as each of its rendered strings must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.sources.tables import table


def render_turn(turn: Column) -> Column:
    """One turn in the chat template."""
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    """Turns, one after the other."""
    return F.array_join(F.transform(turns, render_turn), "")


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading turns that two lists share."""
    both = F.least(F.size(a), F.size(b))
    first = F.filter(F.sequence(F.lit(1), both), lambda i: ~(F.element_at(a, i).eqNullSafe(F.element_at(b, i))))
    return F.when(both < 1, F.lit(0)).otherwise(F.coalesce(F.get(first, F.lit(0)) - 1, both))


def loss_spans(turns: Column) -> Column:
    """Spans [beg, end) of assistant text with its end mark, in characters of ``render(turns)``."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<beg:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.length(render_turn(t))
        beg = acc["at"] + F.length(t["role"]) + 5
        span = F.array(F.struct(beg.cast("long").alias("beg"), (end - 1).cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def preference_format(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Adds n_prefix_turns, prompt, chosen_completion, rejected_completion, chosen_spans and
    rejected_spans to pairs of ``array<struct<role,text>>`` columns."""
    c, r = F.col(chosen), F.col(rejected)
    n = F.col("n_prefix_turns")
    rest = lambda x: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
    return (
        pairs.withColumn("n_prefix_turns", common_prefix(c, r))
        .withColumns({"prompt": render(F.slice(c, F.lit(1), n)), "_c": rest(c), "_r": rest(r)})
        .withColumns({"chosen_completion": render(F.col("_c")), "rejected_completion": render(F.col("_r")), "chosen_spans": loss_spans(F.col("_c")), "rejected_spans": loss_spans(F.col("_r"))})
        .drop("_c", "_r")
    )


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, chosen, rejected from a table (conv_id, turn, role, text)."""
    row = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("_t"))
    plain = F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    last = F.array_max(F.transform(F.filter(F.sequence(F.lit(1), F.size("_t")), lambda i: F.element_at(F.col("_t"), i)["role"] == "assistant"), lambda i: i))
    convs = convs.select("conv_id", plain.alias("_t"), last.alias("_last"))
    replies = convs.where(F.col("_last").isNotNull()).select(
        F.when(F.pmod("conv_id", F.lit(2)) == 0, F.col("conv_id") + 1).otherwise(F.col("conv_id") - 1).alias("conv_id"), F.element_at("_t", F.col("_last")).alias("_reply")
    )
    both = convs.join(replies, "conv_id", "left")
    head = F.slice("_t", F.lit(1), F.col("_last") - 1)
    return both.select(
        "conv_id",
        F.when(F.col("_last").isNull(), F.col("_t")).otherwise(F.slice("_t", F.lit(1), F.col("_last"))).alias("chosen"),
        F.when(F.col("_last").isNull(), F.col("_t")).when(F.col("_reply").isNull(), head).otherwise(F.concat(head, F.array("_reply"))).alias("rejected"),
    )


def spans_text(spans: Column) -> Column:
    """Spans as ``beg-end,beg-end``."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["beg"].cast("string"), s["end"].cast("string"))), ",")


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a formatted preference pair; texts as lengths and md5 digests."""
    out = preference_format(conversation_pairs(table(spark, sf_dir, "conversations")))
    texts = ("prompt", "chosen_completion", "rejected_completion")
    return out.select(
        "conv_id",
        F.col("n_prefix_turns").cast("long").alias("n_prefix_turns"),
        *[F.length(c).cast("long").alias(f"{c}_chars") for c in texts],
        *[F.md5(c).alias(f"{c}_md5") for c in texts],
        spans_text(F.col("chosen_spans")).alias("chosen_spans"),
        spans_text(F.col("rejected_spans")).alias("rejected_spans"),
    )


OP9_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n, max(CASE WHEN role = 'assistant' THEN i END) AS l FROM t GROUP BY conv_id),
reply AS (SELECT CASE WHEN t.conv_id % 2 = 0 THEN t.conv_id + 1 ELSE t.conv_id - 1 END AS conv_id, t.role, t.text
          FROM t JOIN n ON n.conv_id = t.conv_id AND n.l = t.i),
chosen AS (SELECT t.conv_id, i, role, text FROM t JOIN n USING (conv_id) WHERE i <= coalesce(l, n)),
rejected AS (
  SELECT t.conv_id, i, role, text FROM t JOIN n USING (conv_id) WHERE i <= coalesce(l - 1, n)
  UNION ALL SELECT n.conv_id, n.l, r.role, r.text FROM n JOIN reply r USING (conv_id) WHERE n.l IS NOT NULL),
differ AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, min(coalesce(c.i, r.i)) AS d
  FROM chosen c FULL JOIN rejected r ON c.conv_id = r.conv_id AND c.i = r.i
  WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY 1),
p AS (SELECT n.conv_id, coalesce(d - 1, coalesce(l, n)) AS k FROM n LEFT JOIN differ USING (conv_id)),
cr AS (SELECT c.*, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s FROM chosen c),
rr AS (SELECT c.*, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s FROM rejected c),
cc AS (SELECT cr.*, k, sum(CASE WHEN i > k THEN length(s) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) - length(s) AS pos0 FROM cr JOIN p USING (conv_id)),
rc AS (SELECT rr.*, k, sum(CASE WHEN i > k THEN length(s) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) - length(s) AS pos0 FROM rr JOIN p USING (conv_id)),
ca AS (SELECT conv_id, coalesce(string_agg(CASE WHEN i <= k THEN s END, '' ORDER BY i), '') AS prompt,
         coalesce(string_agg(CASE WHEN i > k THEN s END, '' ORDER BY i), '') AS comp,
         coalesce(string_agg(CASE WHEN i > k AND role = 'assistant' THEN CAST(CAST(pos0 + length(role) + 5 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos0 + length(s) - 1 AS BIGINT) AS VARCHAR) END, ',' ORDER BY i), '') AS spans
       FROM cc GROUP BY conv_id),
ra AS (SELECT conv_id, coalesce(string_agg(CASE WHEN i > k THEN s END, '' ORDER BY i), '') AS comp,
         coalesce(string_agg(CASE WHEN i > k AND role = 'assistant' THEN CAST(CAST(pos0 + length(role) + 5 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos0 + length(s) - 1 AS BIGINT) AS VARCHAR) END, ',' ORDER BY i), '') AS spans
       FROM rc GROUP BY conv_id)
SELECT p.conv_id, CAST(k AS BIGINT) AS n_prefix_turns,
       CAST(length(prompt) AS BIGINT) AS prompt_chars, CAST(length(ca.comp) AS BIGINT) AS chosen_completion_chars, CAST(length(coalesce(ra.comp, '')) AS BIGINT) AS rejected_completion_chars,
       md5(prompt) AS prompt_md5, md5(ca.comp) AS chosen_completion_md5, md5(coalesce(ra.comp, '')) AS rejected_completion_md5,
       ca.spans AS chosen_spans, coalesce(ra.spans, '') AS rejected_spans
FROM p JOIN ca USING (conv_id) LEFT JOIN ra USING (conv_id)
"""
