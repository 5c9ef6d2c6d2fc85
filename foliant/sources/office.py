"""Packages as tables: parts, facts and what is read from them. The only Python is the leaf that unzips and parses."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import OfficeError
from ..work import stored
from .leaves import facts_of
from .package import Package

FACTS = "doc_id string, kind string, part string, ord long, attrs map<string,string>"
AT_ONCE = 16384
PARTS = "doc_id string, part string, ord int, bytes binary, error struct<kind:int,name:string,message:string,part:string>"


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and content of files; listing, globs and file stores are Spark's."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")


def container(content: Column) -> Column:
    """zip, cfb or unknown, by the first bytes."""
    return F.when(F.substring(content, 1, 4) == F.unhex(F.lit("504B0304")), "zip").when(F.substring(content, 1, 8) == F.unhex(F.lit("D0CF11E0A1B11AE1")), "cfb").otherwise("unknown")


def facts(files: DataFrame, key: str = "doc_id", content: str = "content", only_manifest: bool = False, kinds: Iterable[str] | None = None) -> DataFrame:
    """All facts of all packages (only_manifest: format, parts and relationships; kinds: those and errors). Store them
    (partitioned by kind) if several results are read from them."""
    wanted = None if kinds is None else {*kinds, "error"}

    def out(ids: list, rows: list) -> pa.RecordBatch:
        kind_, part, ord_, attrs = zip(*rows)
        ends, names, values = [0], [], []
        for a in attrs:
            names += a
            values += a.values()
            ends.append(len(names))
        maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kind_, pa.string()), pa.array(part, pa.string()), pa.array(ord_, pa.int64()), maps], names=["doc_id", "kind", "part", "ord", "attrs"])

    def run(batches):
        ids, rows = [], []  # of several small packages, or a part of a large one that is still being parsed
        for b in batches:
            for key_, data in zip(b.column(0).to_pylist(), b.column(1)):
                for fact in facts_of(data.as_py() or b"", only_manifest, kinds=wanted):
                    ids.append(key_)
                    rows.append(fact)
                    if len(rows) == AT_ONCE:
                        yield out(ids, rows)
                        ids, rows = [], []
        if rows:
            yield out(ids, rows)

    return files.select(F.col(key).cast("string").alias("doc_id"), F.col(content).alias("content")).mapInArrow(run, FACTS)


def stored_facts(files: DataFrame, key: str = "doc_id", content: str = "content", kinds: Iterable[str] | None = None) -> DataFrame:
    """The facts, written once and read by kind: each package is unzipped and parsed a single time, however many joins a
    result takes, and a result reads only the kinds it needs. kinds: keep only those (and errors). Packages that are
    dealt by doc_id already (synth does so) are kept so, as buckets, and joins within a document move nothing."""
    return stored(facts(files, key, content, kinds=kinds), by="kind", dealt=getattr(files, "_dealt", None) and ("doc_id", files._dealt))


def parts(files: DataFrame, prefix: str = "", key: str = "doc_id", content: str = "content") -> DataFrame:
    """Parts below a prefix, with their bytes; damage is a row with an error."""
    kind = pa.struct([("kind", pa.int32()), ("name", pa.string()), ("message", pa.string()), ("part", pa.string())])

    def run(batches):
        for b in batches:
            for key_, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                try:
                    p = Package(data or b"")
                    for i, name in enumerate(p.names):
                        if name.startswith(prefix) and not name.endswith("/"):
                            try:
                                rows.append((name, i, p.bytes(name), None))
                            except OfficeError as e:
                                rows.append((name, i, None, e))
                except OfficeError as e:
                    rows.append((e.part, 0, None, e))
                for name, i, body, e in rows:  # a part a batch: media can be large
                    error = None if e is None else {"kind": e.kind, "name": e.name, "message": e.message, "part": name}
                    yield pa.RecordBatch.from_arrays([pa.array([key_]), pa.array([name]), pa.array([i], pa.int32()), pa.array([body], pa.binary()), pa.array([error], kind)], names=["doc_id", "part", "ord", "bytes", "error"])

    return files.select(F.col(key).cast("string").alias("doc_id"), F.col(content).alias("content")).mapInArrow(run, PARTS)


def kind(f: DataFrame, which: str, /, **columns: str) -> DataFrame:
    """Facts of a kind with attributes as columns: name=attribute or name='attribute:type'."""
    out = [F.expr(f"try_cast(attrs['{a.split(':')[0]}'] as {a.split(':')[1] if ':' in a else 'string'})").alias(c) for c, a in columns.items()]
    present = getattr(f, "_present", None)
    # a kind that no package has is no rows, and joins with it go before anything runs
    return f.where(F.lit(False) if present is not None and which not in present else F.col("kind") == which).select("doc_id", "part", "ord", *out)


def present(f: DataFrame, *kinds: str) -> bool:
    """Whether any of the kinds may be among the facts: a plan need not have branches for what no package has."""
    known = getattr(f, "_present", None)
    return known is None or not known.isdisjoint(kinds)


def errors(f: DataFrame) -> DataFrame:
    e = kind(f, "error", kind="kind:int", name="name", message="message")
    return e.select("doc_id", F.struct("kind", "name", "message", "part").alias("error"))


def documents(f: DataFrame) -> DataFrame:
    """doc_id, format, error, and metadata: the last of repeated core elements, the first of Pages and Slides."""
    m = kind(f, "meta", name="name", value="value", app="app:boolean")
    core = m.where("not app").groupBy("doc_id", "name").agg(F.max_by("value", "ord").alias("value"))
    app = m.where("app").groupBy("doc_id", "name").agg(F.min_by("value", "ord").alias("value"))
    names = ["title", "author", "subject", "description", "keywords", "created", "modified", "last_modified_by", "application", "page_count", "word_count"]
    meta = core.unionByName(app).groupBy("doc_id").pivot("name", names).agg(F.first("value"))
    words = F.filter(F.transform(F.split("keywords", "[,;]"), lambda k: F.trim(k)), lambda k: k != "")
    meta = meta.withColumn("keywords", F.coalesce(words, F.array().cast("array<string>"))).withColumns({c: F.expr(f"try_cast({c} as bigint)") for c in ("page_count", "word_count")})
    units = kind(f, "sheet").unionByName(kind(f, "slide")).groupBy("doc_id").agg(F.count("*").alias("units"))
    formats = kind(f, "format", format="format").select("doc_id", "format")
    failed = errors(f).groupBy("doc_id").agg(F.min("error").alias("error"))
    out = formats.join(failed, "doc_id", "full").join(meta, "doc_id", "left").join(units, "doc_id", "left")
    return out.withColumn("page_count", F.coalesce("units", "page_count")).drop("units")


def relationships(f: DataFrame) -> DataFrame:
    return kind(f, "rel", rel_id="id", rel_type="type", target="target", external="external:boolean").withColumnRenamed("part", "source_part")


def targets(f: DataFrame) -> DataFrame:
    """doc_id, part, targets: of each part, a map from relationship id to target (as many as a part has)."""
    r = relationships(f)
    return r.groupBy("doc_id", F.col("source_part").alias("part")).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("rel_id", "target")))).alias("targets"))


def resource_list(f: DataFrame) -> DataFrame:
    """doc_id, resource_id, part, filename, type, mime_type, size of what a document carries: in Word what the main part's
    relationships name as pictures, by their ids; else the parts of the media folder, by their file names."""
    from ..functions.model import mime_in, resource_type_of

    held = kind(f, "part", size="size:long").select("doc_id", "part", "size")
    main = f.where("kind = 'format'").select("doc_id", F.col("part").alias("main"), F.col("attrs")["format"].alias("format"))
    pictures = relationships(f).where(F.contains("rel_type", F.lit("/image")) & ~F.col("external"))
    word = main.where("format = 'docx'").join(pictures.withColumnRenamed("source_part", "main"), ["doc_id", "main"])
    word = word.select("doc_id", "format", F.col("rel_id").alias("resource_id"), F.col("target").alias("part")).join(held, ["doc_id", "part"])
    name = F.element_at(F.split("part", "/"), -1)
    media = held.where(F.col("part").rlike("^(xl|ppt)/media/[^/]+$")).join(main.where("format <> 'docx'"), "doc_id")
    both = word.select("doc_id", "format", "resource_id", "part", "size").unionByName(media.select("doc_id", "format", name.alias("resource_id"), "part", "size"))
    return both.select("doc_id", "resource_id", "part", name.alias("filename"), resource_type_of(name).alias("type"), mime_in(name, F.col("format")).alias("mime_type"), "size")


def resources(files: DataFrame) -> DataFrame:
    """resource_list with the bytes (data). Only the packages' lists of parts and their relationships are parsed."""
    listed = resource_list(facts(files, only_manifest=True))
    return listed.drop("size").join(parts(files), ["doc_id", "part"]).select("doc_id", "resource_id", "part", "type", "filename", "mime_type", F.octet_length("bytes").cast("long").alias("size"), F.col("bytes").alias("data"), "error")


def reachable(f: DataFrame, most: int = 64) -> DataFrame:
    """doc_id, part, hops: the parts that relationships lead to from the package, by the least number of steps (null:
    none do). A round takes one more step from the parts that the last one found."""
    r = stored(relationships(f).where("not external").select("doc_id", "source_part", "target").distinct())
    found = stored(r.where("source_part = ''").select("doc_id", F.col("target").alias("part"), F.lit(1).alias("hops")))
    new = found
    for hops in range(2, most + 1):
        step = new.select("doc_id", F.col("part").alias("source_part")).join(r, ["doc_id", "source_part"]).select("doc_id", F.col("target").alias("part")).distinct()
        new = stored(step.join(found, ["doc_id", "part"], "left_anti").withColumn("hops", F.lit(hops)))
        if new.isEmpty():
            break
        found = stored(found.unionByName(new))
    else:
        raise ValueError(f"parts more than {most} relationships away")
    listed = kind(f, "part").select("doc_id", "part").where("part <> '[Content_Types].xml' and part not like '%.rels'")
    return listed.join(found, ["doc_id", "part"], "left")
