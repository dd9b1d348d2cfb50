"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation is rendered once, their rests are masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed marks of a rendered turn, and the role whose text is trained on.
OPEN, SEP, CLOSE, TRAINED = "<|", "|>\n", "<|end|>\n", "assistant"


def _mask(turns: Column) -> Column:
    """A character for each character: 1 over the text and end mark of trained turns, else 0."""

    def one(t: Column) -> Column:
        head = F.length(t["role"]) + F.lit(len(OPEN) + len(SEP))
        body = F.length(t["text"]) + F.lit(len(CLOSE))
        return F.concat(F.repeat(F.lit("0"), head), F.repeat(F.when(t["role"] == TRAINED, F.lit("1")).otherwise(F.lit("0")), body))

    return F.array_join(F.transform(turns, one), "")


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(SEP), t["text"], F.lit(CLOSE))), "")


def format_preferences(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, turn, role, text) rows to one row for each pair.

    chosen: boolean, the side a turn belongs to. Turns go by (turn, role, text), nulls first, so ties and repeated rows
    have an order; a null role or text is empty. Returns pair_id, prefix_turns, prompt, chosen, rejected and their
    masks. If one side is missing the prompt is empty and that side null; equal sides leave empty completions. Rows
    with a null pair_id or side are in no pair. Extra columns are ignored.

    Two conversations become one row whatever is done, so they are gathered once, by pair: partial aggregation on the map
    side, one shuffle, no join; all else are array functions in the JVM.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    side = lambda on: F.array_sort(F.collect_list(F.when(F.col("chosen") == F.lit(on), turn)))
    both = turns.where("pair_id is not null and chosen is not null").groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"))
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first_other = F.array_position(same, False)
    n = F.when((F.size("c") == 0) | (F.size("r") == 0), F.lit(0)).when(first_other > 0, first_other - 1).otherwise(F.size("c")).cast("int")
    cut = both.withColumn("prefix_turns", n)
    rest = lambda c: F.slice(c, F.col("prefix_turns") + 1, F.greatest(F.size(c), F.lit(1)))
    given = lambda c, v: F.when(F.size(c) > 0, v)
    return cut.select(
        "pair_id", "prefix_turns", _render(F.slice("c", F.lit(1), F.col("prefix_turns"))).alias("prompt"),
        given("c", _render(rest("c"))).alias("chosen"), given("r", _render(rest("r"))).alias("rejected"),
        given("c", _mask(rest("c"))).alias("chosen_mask"), given("r", _mask(rest("r"))).alias("rejected_mask"),
    )


def op8_preference_format(spark, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are a pair: the even one chosen, the odd one rejected."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return format_preferences(turns.select(F.floor(F.col("conv_id") / 2).alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen"), "turn", "role", "text"))


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (SELECT pair_id, max(n) FILTER (WHERE c) AS cn, max(n) FILTER (WHERE NOT c) AS rn FROM t GROUP BY 1
), d AS (
  SELECT a.pair_id, min(a.n) AS n FROM t a LEFT JOIN t b ON a.pair_id = b.pair_id AND a.n = b.n AND a.c <> b.c AND a.role = b.role AND a.text = b.text
  WHERE b.n IS NULL GROUP BY 1
), p AS (SELECT s.pair_id, CASE WHEN cn IS NULL OR rn IS NULL THEN 0 ELSE coalesce(d.n - 1, cn) END AS k FROM s LEFT JOIN d ON s.pair_id = d.pair_id
), r AS (
  SELECT t.pair_id, c, n, k, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS x,
         repeat('0', length(role) + 5) || repeat(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, length(text) + 8) AS m
  FROM t JOIN p ON t.pair_id = p.pair_id
)
SELECT pair_id::BIGINT AS pair_id, any_value(k)::INTEGER AS prefix_turns, coalesce(string_agg(x, '' ORDER BY n) FILTER (WHERE c AND n <= k), '') AS prompt,
       CASE WHEN count(*) FILTER (WHERE c) > 0 THEN coalesce(string_agg(x, '' ORDER BY n) FILTER (WHERE c AND n > k), '') END AS chosen,
       CASE WHEN count(*) FILTER (WHERE NOT c) > 0 THEN coalesce(string_agg(x, '' ORDER BY n) FILTER (WHERE NOT c AND n > k), '') END AS rejected,
       CASE WHEN count(*) FILTER (WHERE c) > 0 THEN coalesce(string_agg(m, '' ORDER BY n) FILTER (WHERE c AND n > k), '') END AS chosen_mask,
       CASE WHEN count(*) FILTER (WHERE NOT c) > 0 THEN coalesce(string_agg(m, '' ORDER BY n) FILTER (WHERE NOT c AND n > k), '') END AS rejected_mask
FROM r GROUP BY pair_id
"""
