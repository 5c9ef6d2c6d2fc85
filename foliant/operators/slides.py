"""PowerPoint facts to sections, and charts of any package to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.model import plain_text, runs_of
from ..sources.office import kind, relationships, targets

#: Placeholders that hold furniture, not content.
FURNITURE = ("dt", "sldNum", "ftr", "hdr", "sldImg")
#: Kinds of facts that chart_tables reads.
CHARTS = ("chart", "category", "series", "point")


def slides(f: DataFrame) -> DataFrame:
    s = kind(f, "slide", slide="part")
    n = Window.partitionBy("doc_id").orderBy("ord")
    return s.select("doc_id", (F.row_number().over(n) - 1).alias("slide_idx"), "slide")


def placeholder_key(kind_: str, idx: str):
    return F.when(F.col(kind_) != "", F.col(kind_)).otherwise(F.concat(F.lit("idx:"), F.col(idx)))


def paragraphs(f: DataFrame) -> DataFrame:
    """Paragraphs of slides: an empty placeholder takes the text of its layout, else of its master."""
    p = kind(f, "slide_para", ph="ph:boolean", type="type", idx="idx", runs="runs").withColumnRenamed("part", "slide")
    p = p.where(~F.coalesce(F.col("type"), F.lit("")).isin(*FURNITURE)).withColumns({"runs": runs_of(F.col("runs")), "key": F.when(F.col("ph"), placeholder_key("type", "idx"))})
    inherited = kind(f, "placeholder", level="level", slide="slide", type="type", idx="idx", text="text").withColumn("key", placeholder_key("type", "idx"))
    inherited = inherited.groupBy("doc_id", "slide", "key").pivot("level", ["layout", "master"]).agg(F.max_by("text", "ord"))
    p = p.join(inherited, ["doc_id", "slide", "key"], "left").join(targets(f).withColumnRenamed("part", "slide"), ["doc_id", "slide"], "left")
    empty = plain_text(F.col("runs")) == ""
    text = F.coalesce(F.nullif("layout", F.lit("")), F.nullif("master", F.lit("")))
    taken = F.from_json(F.to_json(F.array(F.struct(text.alias("t")))), "array<struct<t:string>>")
    runs = F.when(~empty, F.transform("runs", lambda r: r.withField("rid", F.element_at("targets", r["rid"])))).when(text.isNotNull(), runs_of(F.to_json(taken)))
    heading = F.when(F.col("type").isin("title", "ctrTitle"), 1).when(F.col("type") == "subTitle", 2).otherwise(0)
    out = p.select("doc_id", "slide", "ord", runs.alias("runs"), heading.alias("heading")).where("runs is not null")
    return out.join(slides(f), ["doc_id", "slide"])


def table_cells(f: DataFrame) -> DataFrame:
    c = kind(f, "slide_cell", table_id="table", n="n:int", row="row:int", text="text").withColumnRenamed("part", "slide")
    return c.select("doc_id", "slide", "table_id", F.col("n").alias("table_ord"), "row", F.col("ord").cast("int").alias("col"), "text", (F.col("row") == 0).alias("is_header")).join(slides(f), ["doc_id", "slide"])


def notes(f: DataFrame) -> DataFrame:
    n = kind(f, "slide_note", runs="runs").withColumnRenamed("part", "slide").withColumn("text", plain_text(runs_of(F.col("runs"))))
    return n.join(slides(f), ["doc_id", "slide"]).select("doc_id", "slide_idx", "ord", "text")


def pictures(f: DataFrame) -> DataFrame:
    p = kind(f, "slide_pic", rid="rid", name="name", w="w:long", h="h:long").withColumnRenamed("part", "slide")
    rels = relationships(f).select("doc_id", F.col("source_part").alias("slide"), F.col("rel_id").alias("rid"), "target")
    return p.join(rels, ["doc_id", "slide", "rid"]).join(slides(f), ["doc_id", "slide"]).select("doc_id", "slide_idx", "ord", F.element_at(F.split("target", "/"), -1).alias("image"), F.col("name").alias("alt"), "w", "h")


def chart_points(f: DataFrame) -> DataFrame:
    """doc_id, chart, title, series_idx, series, pt_idx, category, value; categories and values meet by idx."""
    series = kind(f, "series", series="name").select("doc_id", F.col("part").alias("chart"), F.col("ord").alias("series_idx"), "series")
    points = kind(f, "point", pt_idx="idx:long", value="value:double").select("doc_id", F.col("part").alias("chart"), F.col("ord").alias("series_idx"), "pt_idx", "value")
    cats = kind(f, "category", category="value").select("doc_id", F.col("part").alias("chart"), F.col("ord").alias("pt_idx"), "category")
    titles = kind(f, "chart", title="title").select("doc_id", F.col("part").alias("chart"), "title")
    grid = series.join(cats, ["doc_id", "chart"])
    return grid.join(points, ["doc_id", "chart", "series_idx", "pt_idx"], "left").join(titles, ["doc_id", "chart"], "left")


def chart_tables(f: DataFrame) -> DataFrame:
    """doc_id, chart, title, header, rows: a row a category, a column a series, blank where there is no value."""
    number = F.when(F.col("value").isNull(), "").when(F.col("value") == F.floor("value"), F.format_string("%d", F.col("value").cast("long"))).otherwise(F.col("value").cast("string"))
    p = chart_points(f).withColumn("shown", number)
    rows = p.groupBy("doc_id", "chart", "title", "pt_idx", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("series_idx", "shown"))), lambda x: x["shown"]).alias("values"))
    table = rows.groupBy("doc_id", "chart", "title").agg(F.transform(F.array_sort(F.collect_list(F.struct("pt_idx", "category", "values"))), lambda x: F.concat(F.array(x["category"]), x["values"])).alias("rows"))
    heads = kind(f, "series", series="name").groupBy("doc_id", F.col("part").alias("chart")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "series"))), lambda x: x["series"]).alias("names"))
    first = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise("Category")
    return table.join(heads, ["doc_id", "chart"]).select("doc_id", "chart", "title", F.concat(F.array(first), F.col("names")).alias("header"), "rows")
