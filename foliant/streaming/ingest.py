"""Events of parsing as rows, and files that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import strict
from ..options import RenderOptions
from ..plans import render
from ..sources import office


ERROR = "struct<kind:int,name:string,message:string,part:string>"


def events(f: DataFrame, files: DataFrame | None = None, lenient: bool = True) -> DataFrame:
    """doc_id, seq, event_type, section_idx, name, section_count, image_map, metadata, error.

    DocumentStart comes first and says what is to come: how many sections, the file name of every resource (before any
    section needs one) and the metadata; then a SectionParsed or SectionFailed for each section, DocumentEnd, and a
    ResourceExtracted for each resource (if files are given). A document that failed as a whole is one DocumentFailed.
    Strict (not lenient) events fail the query at the first error instead."""
    failed = office.kind(f, "error", kind="kind:int", name="name", message="message", section="section:int")
    error = F.struct("kind", "name", "message", "part").cast(ERROR).alias("error")
    broken = failed.where("section is null").select("doc_id", error)
    by_section = failed.where("section is not null").select("doc_id", F.col("section").alias("section_idx"), error)
    sections = render.sections(f).join(by_section, ["doc_id", "section_idx"], "left")

    def shaped(df: DataFrame, step: int, event: Column | str, **have: Column) -> DataFrame:
        base = {"_at": F.lit(0), "section_idx": F.lit(None).cast("int"), "name": F.lit(None).cast("string"), "section_count": F.lit(None).cast("long"), "image_map": F.lit(None).cast("map<string,string>"), "metadata": F.lit(None).cast("string"), "error": F.lit(None).cast(ERROR)}
        what = event if isinstance(event, Column) else F.lit(event)
        return df.select("doc_id", F.lit(step).alias("_step"), what.alias("event_type"), *[have.get(c, x).alias(c) for c, x in base.items()])

    whole = office.kind(f, "format", format="format").join(broken.select("doc_id"), "doc_id", "left_anti")
    # what the first event knows is there before any section is: counts of sections and the list of resources
    counts = sections.groupBy("doc_id").agg(F.count("*").alias("section_count"))
    maps = office.resource_list(f).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.array_distinct(F.collect_list(F.struct("resource_id", "filename"))))).alias("image_map"))
    meta = office.documents(f)
    meta = meta.select("doc_id", F.to_json(F.struct(*[c for c in meta.columns if c not in ("doc_id", "format", "error")])).alias("metadata"))
    first = whole.join(counts, "doc_id", "left").join(maps, "doc_id", "left").join(meta, "doc_id", "left")
    start = shaped(first, 0, "DocumentStart", name=F.col("format"), section_count=F.coalesce("section_count", F.lit(0)), image_map=F.coalesce("image_map", F.create_map().cast("map<string,string>")), metadata=F.col("metadata"))
    parsed = F.when(F.col("error").isNull(), "SectionParsed").otherwise("SectionFailed")
    out = start.unionByName(shaped(sections, 1, parsed, _at=F.col("section_idx"), section_idx=F.col("section_idx"), name=F.col("name"), error=F.col("error")))
    out = out.unionByName(shaped(whole, 2, "DocumentEnd"))
    if office.present(f, "error"):
        out = out.unionByName(shaped(broken, 2, "DocumentFailed", error=F.col("error")))
    if files is not None:
        out = out.unionByName(shaped(office.resources(files), 3, "ResourceExtracted", name=F.coalesce("filename", "resource_id"), error=F.col("error")))
    order = Window.partitionBy("doc_id").orderBy("_step", "_at", "name")
    out = out.withColumn("seq", F.row_number().over(order) - 1).drop("_step", "_at")
    return out if lenient else strict(out)


def each_event(files: DataFrame, callback: Callable[[Row], bool | None], lenient: bool = True, at_once: int = 32) -> int:
    """Events of files (doc_id, content) one by one, documents in the order of their ids, until the callback returns
    False. `at_once` documents are parsed at a time, so a caller who stops early has parsed no more than that beyond;
    returns how many documents were."""
    ids = [r["doc_id"] for r in files.select("doc_id").distinct().orderBy("doc_id").limit(at_once).collect()]
    done = 0
    while ids:
        some = files.where(F.col("doc_id").isin(ids)).select("doc_id", "content")
        done += len(ids)
        for row in iterate(events(office.stored_facts(some), None, lenient)):
            if callback(row) is False:
                return done
        ids = [r["doc_id"] for r in files.where(F.col("doc_id") > ids[-1]).select("doc_id").distinct().orderBy("doc_id").limit(at_once).collect()]
    return done


def iterate(df: DataFrame) -> Iterator[Row]:
    """Rows in order, a partition of them on the driver at a time."""
    yield from df.orderBy("doc_id", "seq").toLocalIterator()


def stream_markdown(spark: SparkSession, source: str, target: str, checkpoint: str, options: RenderOptions | None = None, files_per_trigger: int = 64, once: bool = False):
    """Files that arrive under source become rows of doc_id and markdown under target. The result is the batch one."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(source)

    def write(batch: DataFrame, epoch: int) -> None:
        facts = office.stored_facts(batch, "path")
        render.to_markdown(facts, options).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")  # a repeated epoch replaces itself

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
