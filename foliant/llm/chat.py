"""Chat formatting by multi-party perspective rotation: of every conversation, one rendering for each participant, who
speaks as the assistant there; all others are named users. Built-in expressions only.

A rendering comes in blocks of `block` consecutive turn numbers, in order: a long conversation is never gathered whole,
and the concatenation of its blocks is the rendering. mask lists the spans of characters to train on (start:stop, in the
block), the assistant's text and the mark that ends it.

A block of more than `most` turns (turns null or numbered alike) is put together from parts of that many; it is one row
of the query all the same, and so has to fit in one. `rotate` gives the parts themselves as rows (part, with the mask's
places in the part) unless `whole`.

Defined cases: a null conv_id takes no part; narrators (system) keep their role in every perspective and are no
participants; null or blank roles are the user "unknown", no participant; null text is empty; a null turn comes first;
equal turns come in the order of role and text, repeated rows each count; marks of the format inside texts lose their
bars, and in names line breaks, angle brackets and bars become underscores; a conversation without participants gives
no rows, nor does an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"


def rotate(turns: DataFrame, block: int = 64, narrators: tuple[str, ...] = ("system",), most: int = 4096, whole: bool = False) -> DataFrame:
    """conv_id, perspective, block, part (0 but for blocks of more than `most` turns; none if whole), n_turns, text, mask."""
    role = F.coalesce(F.nullif(F.trim(F.col("role").cast("string")), F.lit("")), F.lit("unknown"))
    said = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"<\|(im_start|im_end)\|>", "<$1>")
    rows = turns.where("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), said.alias("text"))
    people = rows.where(~F.col("role").isin(*narrators, "unknown")).select("conv_id", F.col("role").alias("perspective")).distinct()
    rows = rows.withColumn("block", F.floor(F.coalesce("turn", F.lit(0)) / block))
    rank = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text"))
    rows = rows.withColumn("part", F.floor((rank - 1) / most))
    blocks = rows.groupBy("conv_id", "block", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    if whole:  # rows of a block are in one partition already
        keys = ["conv_id", "block"]
        blocks = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "said")))["said"].alias("said"))
    else:
        keys = ["conv_id", "block", "part"]
        blocks = blocks.withColumn("said", F.array("said"))
    name = lambda r: F.regexp_replace(r, r"[\r\n<>|]", "_")

    def segment(x):
        mine = x["role"] == F.col("perspective")
        head = F.when(mine, "assistant").when(x["role"].isin(*narrators), x["role"]).otherwise(F.concat(F.lit("user name="), name(x["role"])))
        return F.struct(mine.alias("mine"), F.concat(F.lit(START), head, F.lit("\n")).alias("head"), F.concat(x["text"], F.lit(STOP)).alias("body"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(a, p):
        start = a["at"] + F.length(p["head"])
        stop = start + F.length(p["body"])
        return F.struct((stop + 1).alias("at"), F.when(p["mine"], F.concat(a["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop"))))).otherwise(a["spans"]).alias("spans"))

    def part(segments):
        text = F.array_join(F.transform(segments, lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
        return F.struct(text.alias("text"), F.aggregate(segments, begin, step)["spans"].alias("spans"))

    parts = blocks.join(people, "conv_id").withColumn("parts", F.transform("said", lambda x: part(F.transform(x, segment))))
    starts = F.aggregate("parts", F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p["text"]))))
    parts = parts.withColumn("starts", starts)
    span = lambda x, at: F.concat_ws(":", (x["start"] + at).cast("string"), (x["stop"] + at).cast("string"))
    spans = F.flatten(F.transform("parts", lambda p, i: F.transform(p["spans"], lambda x: span(x, F.get("starts", i)))))
    n_turns = F.aggregate("said", F.lit(0), lambda a, x: a + F.size(x)).cast("long")
    text = F.array_join("parts.text", "")
    return parts.select("conv_id", "perspective", *keys[1:], n_turns.alias("n_turns"), text.alias("text"), F.array_join(spans, ",").alias("mask"))


def report(conversations: DataFrame) -> DataFrame:
    return rotate(conversations, whole=True)


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS role, regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<\1>', 'g') AS text, floor(coalesce(turn, 0) / 64)::BIGINT AS block FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role NOT IN ('system', 'unknown')),
s AS (SELECT conv_id, perspective, block, row_number() OVER (PARTITION BY conv_id, perspective, block ORDER BY turn NULLS FIRST, role, text) AS n, role = perspective AS mine,
      '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN role ELSE 'user name=' || regexp_replace(role, '[\r\n<>|]', '_', 'g') END || chr(10) AS head, text || '<|im_end|>' AS body FROM t JOIN p USING (conv_id)),
o AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, block ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM s)
SELECT conv_id, perspective, block, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY n) AS text,
       coalesce(string_agg(start::BIGINT || ':' || (start + length(body))::BIGINT, ',' ORDER BY n) FILTER (WHERE mine), '') AS mask
FROM o GROUP BY conv_id, perspective, block
"""
