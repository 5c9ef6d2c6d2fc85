"""Writers: one set of facts, several formats."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..options import HeadingConfig, RenderOptions
from ..plans import render
from ..sources import datasource, office

# Folders of text files (by the hash of doc_id), names of formats.
FOLDERS = [f"{i:02x}" for i in range(256)]
FORMATS = {"md": "md", "markdown": "md", "txt": "txt", "text": "txt", "json": "json"}


def save(rows: DataFrame, target: str, overwrite: bool = False) -> None:
    """Rows of path and data as files below target: all of them once every task has ended, or none."""
    datasource.register(rows.sparkSession)
    rows.write.format("office").mode("overwrite" if overwrite else "append").save(target)


def convert(files: DataFrame, target: str, formats: list[str], options: RenderOptions | None = None, as_files: bool = False) -> None:
    """target/md, target/txt, target/json: rows of doc_id and text as Parquet, or (as_files) a text file for each
    document, named after it, in one of FOLDERS. Packages are parsed once."""
    facts = office.stored_facts(files)
    o = options or RenderOptions(frontmatter=True, headings=HeadingConfig())
    for name in dict.fromkeys(FORMATS[f] for f in formats):
        out = {"md": lambda: render.to_markdown(facts, o), "txt": lambda: render.to_text(facts, o.cleanup), "json": lambda: render.to_json(facts)}[name]()
        if not as_files:
            out.write.mode("overwrite").parquet(f"{target}/{name}")
            continue
        body = next(c for c in out.columns if c != "doc_id")
        home = F.concat(F.substring(F.md5(F.coalesce("doc_id", F.lit(""))), 1, 2), F.lit("/"))
        save(out.select(F.concat(home, document_folder(F.col("doc_id")), F.lit(f".{name}")).alias("path"), F.col(body).alias("data")), f"{target}/{name}", True)


def written(spark: SparkSession, target: str) -> DataFrame:
    """path, length, content of the files below target that convert has written, empty ones too (which the format
    binaryFile leaves out). Tasks list a folder at a time, so the driver never has the list of all."""

    def batch(files: list) -> pa.RecordBatch:
        paths, bodies = zip(*files)
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(map(len, bodies), pa.int64()), pa.array(bodies, pa.binary())], names=["path", "length", "content"])

    def run(batches):
        system, root = datasource.at(target)
        for b in batches:
            for folder in b.column(0).to_pylist():
                files, size = [], 0
                for i in system.get_file_info(fs.FileSelector(f"{root}/{FOLDERS[folder]}", allow_not_found=True)):
                    with system.open_input_file(i.path) as stream:
                        files.append((i.path, stream.read()))
                    size += len(files[-1][1])
                    if size >= 4 << 20 or len(files) >= 1024:
                        yield batch(files)
                        files, size = [], 0
                if files:
                    yield batch(files)

    return spark.range(0, len(FOLDERS), 1, min(len(FOLDERS), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "path string, length long, content binary")


def info(f: DataFrame) -> DataFrame:
    """Metadata and counts of each document."""
    from ..functions.text import word_count

    text = render.plain(f).select("doc_id", word_count(F.col("text")).alias("n_words"), F.octet_length("text").alias("n_bytes"))
    sections = render.sections(f).groupBy("doc_id").agg(F.count("*").alias("n_sections"))
    return office.documents(f).join(sections, "doc_id", "left").join(text, "doc_id", "left")


def split_resources(r: DataFrame) -> DataFrame:
    """resources and folder: images or media."""
    return r.withColumn("folder", F.when(F.col("type") == "image", "images").otherwise("media"))


def escaped(name: Column) -> Column:
    """A name without separators: everything but letters, digits and a few marks by its bytes."""
    return F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))


def document_folder(doc_id: Column) -> Column:
    """A name of its own for every doc_id, whatever characters it holds."""
    name = F.concat(F.lit("doc-"), escaped(doc_id))
    return F.when(doc_id.isNull(), "doc").when(F.length(name) > 200, F.concat(F.lit("doc--"), F.sha2(doc_id, 256))).otherwise(name)


def extract(files: DataFrame, target: str) -> None:
    """Media as files: target/folder/name of a single document, and target/doc-id/folder/name where there are several
    (ids escaped; rows of one doc_id are one document). The last part of a name counts; where parts of a document share
    it, each is named by its escaped whole path."""
    single = files.select("doc_id").distinct().limit(2).count() < 2
    name = F.regexp_extract(F.regexp_replace("filename", r"\\", "/"), "[^/]*$", 0)
    r = split_resources(office.resources(files)).where("data is not null").dropDuplicates(["doc_id", "part"]).withColumn("name", name).where(~F.col("name").isin("", ".", ".."))
    r = r.withColumn("same", F.count("*").over(Window.partitionBy("doc_id", "folder", "name")))
    last = F.when(F.col("same") == 1, F.col("name")).otherwise(escaped(F.col("part")))
    home = F.lit("") if single else F.concat(document_folder(F.col("doc_id")), F.lit("/"))
    save(r.select(F.concat(home, F.col("folder"), F.lit("/"), last).alias("path"), "data"), target)
