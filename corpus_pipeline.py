"""A corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, pieces.

Each stage takes the documents that its predecessor has left and returns documents with their columns (the last one
adds its own); between stages they are written and read again.

Defined cases: columns other than doc_id and text (and n_chars, which follows a cut text) pass all filtering stages as
they are, whatever their names; a null text is judged as an empty one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontaminate, jaccard, lattice, quality, suffix_dedup
from foliant.llm.common import stored


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict]:
    """docs whose columns but doc_id and text have names that no operator uses, and what each was called."""
    names = {c: c if c in ("doc_id", "text") else f"_own_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def restored(docs: DataFrame, names: dict, **new) -> DataFrame:
    """The columns set aside under their own names; those in `new` by its expressions."""
    return docs.select(*[new.get(c, F.col(h)).alias(c) for c, h in names.items()])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.7 and more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    aside, names = set_aside(docs)
    return restored(quality.quality_scores(aside, labels).where("score >= 0.7"), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of five-word Jaccard similarity 0.8 and more, the first row of the least doc_id. Rows go by
    doc_id and text; of equal rows that stay, one does."""
    docs, names = set_aside(docs)
    groups = jaccard.near_duplicates(docs, words=5, num=8, den=10, scheme=(1, 0))
    kept = F.sum(F.col("keeper").cast("int"))
    # what is known of (doc_id, text) where some row goes; a list of bounded size is sent to the documents, a longer one
    # is joined by key
    going = stored(groups.groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).agg(kept.alias("kept"), F.count("*").alias("n")).where("kept < n"))
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_t": F.xxhash64(F.col("text").cast("string"))})
    few = going.count() <= 1 << 19
    rest = keyed.join(F.broadcast(going) if few else going, ["_id", "_t"], "left_anti")
    again = going.where("kept > 0")
    if not again.isEmpty():
        rest = rest.unionByName(keyed.join(again, ["_id", "_t"], "left_semi").dropDuplicates(["_id", "_t"]))
    return restored(rest, names)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that a 100-byte string covers which starts earlier; n_chars follows the text.
    Documents of which nothing is left go."""
    aside, names = set_aside(docs)
    cut = suffix_dedup.cut(aside).where("n_removed < n_bytes or n_bytes = 0")
    new = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col(names["n_chars"]))
    return restored(cut, names, **new)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    aside, names = set_aside(docs)
    return restored(decontaminate.decontaminate(aside, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), names)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces. Groups are a third of those of the operator alone: more segments move,
    in less memory beside what the stages before have left in the executors."""
    return lattice.encode(docs, together=2)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", to_pieces),
]

#: SQL has no learned model, no merges of pieces and no removal of repeated bytes; the tests hold counts of its rows, and by stage
#: columns of clashing names, null texts and an empty table; no brute force over the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs)
    return docs
