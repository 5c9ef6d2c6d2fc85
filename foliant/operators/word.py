"""Word facts to blocks: styles, numbering, links and notes are joins and windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.model import IMAGES, merge_runs, plain_text, runs_of
from ..sources.office import kind, present, targets

HOPS = 11
#: What a style can say, and what its readers take from the nearest one along basedOn that says it.
PROPERTIES = {"outline": "int", "bold": "boolean", "italic": "boolean", "underline": "boolean", "strike": "boolean", "font": "string", "size": "int", "color": "string", "highlight": "string"}


def style_properties(f: DataFrame) -> DataFrame:
    """doc_id, style_id, style_name and PROPERTIES: of each the value of the nearest style along basedOn that has one,
    itself first, over HOPS styles at most. A document's styles are folded where they lie, as one map."""
    own = kind(f, "style", style_id="id", style_name="name", based="based", **{c: f"{c}:{t}" for c, t in PROPERTIES.items()})
    of = ["based", *PROPERTIES]
    s = own.groupBy("doc_id", "style_id").agg(F.min_by(F.struct("style_name", *of), "ord").alias("s")).select("doc_id", "style_id", "s.*")
    maps = s.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("style_id", F.struct(*of)))).alias("all"), F.collect_list(F.struct("style_id", "style_name")).alias("names"))
    rows = maps.select("doc_id", "all", F.explode("names").alias("n")).select("doc_id", "all", "n.style_id", "n.style_name")

    def hop(acc: Column, _: Column) -> Column:
        here = lambda c: F.try_element_at("all", acc["up"])[c]
        return F.struct(here("based").alias("up"), *[F.coalesce(acc[c], here(c)).alias(c) for c in PROPERTIES])

    start = F.struct(F.col("style_id").alias("up"), *[F.lit(None).cast(t).alias(c) for c, t in PROPERTIES.items()])
    found = F.aggregate(F.sequence(F.lit(1), F.lit(HOPS)), start, hop)
    return rows.select("doc_id", "style_id", "style_name", found.alias("p")).select("doc_id", "style_id", "style_name", *[f"p.{c}" for c in PROPERTIES])


def styles(f: DataFrame) -> DataFrame:
    """doc_id, style_id, style_name, heading: the nearest outline along basedOn, else Title and Subtitle by name."""
    level = F.when(F.col("outline").between(0, 5), F.col("outline") + 1).when(F.lower("style_name") == "title", 1).when(F.lower("style_name") == "subtitle", 2)
    return style_properties(f).select("doc_id", "style_id", "style_name", F.coalesce(level, F.lit(0)).alias("heading"))


def number_window(items: DataFrame, group: list[str], order: str) -> DataFrame:
    """items (level, start, ...) and number: a counter a level, which an item of a lower level starts again."""
    seq = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    lower = F.lit(None).cast("long")
    for k in range(8, -1, -1):  # running counts of items below each level; the item's own level picks one
        lower = F.when(F.col("level") == k, F.sum((F.col("level") < k).cast("long")).over(seq)).otherwise(lower)
    counted = items.withColumn("_grp", lower)
    own = Window.partitionBy(*group, "level", "_grp").orderBy(order)
    return counted.withColumn("number", F.col("start") + F.row_number().over(own) - 1).drop("_grp")


def list_numbers(f: DataFrame) -> DataFrame:
    """doc_id, seq, list_type, list_level, list_number of paragraphs in lists; undefined levels count for nothing."""
    items = kind(f, "para", seq="seq:long", num="num", level="level:int", region="region").where("num is not null and region <> 'cell'").drop("part", "ord")
    levels = kind(f, "num_level", num="num", level="level:int", start="start:long", format="format").drop("part", "ord")
    joined = number_window(items.join(levels, ["doc_id", "num", "level"]), ["doc_id", "num"], "seq")
    numbered = F.col("format").isin("decimal", "lowerLetter", "upperLetter", "lowerRoman", "upperRoman")
    return joined.select("doc_id", "seq", F.when(numbered, "numbered").otherwise("bullet").alias("list_type"), F.col("level").alias("list_level"), F.when(numbered, F.col("number")).alias("list_number"))


def paragraphs(f: DataFrame) -> DataFrame:
    """Every paragraph of bodies, headers, footers and cells, with its style, list and resolved runs."""
    p = kind(f, "para", seq="seq:long", region="region", style_id="style", jc="jc", table_id="table", cell="cell", runs="runs", images="images")
    p = p.withColumns({"runs": runs_of(F.col("runs")), "images": F.from_json("images", IMAGES)})
    none = lambda *cols: [F.lit(None).cast(t).alias(c) for c, t in cols]
    p = p.join(styles(f), ["doc_id", "style_id"], "left") if present(f, "style") else p.select("*", *none(("style_name", "string"), ("heading", "int")))
    p = p.join(list_numbers(f), ["doc_id", "seq"], "left") if present(f, "num_level") else p.select("*", *none(("list_type", "string"), ("list_level", "int"), ("list_number", "long")))
    p = p.join(targets(f), ["doc_id", "part"], "left")
    if present(f, "note"):
        notes = kind(f, "note", kind="kind", id="id").groupBy("doc_id").agg(F.collect_set(F.concat(F.when(F.col("kind") == "endnote", "e").otherwise(""), F.col("id"))).alias("notes"))
        p = p.join(notes, "doc_id", "left")
    else:
        p = p.withColumn("notes", F.lit(None).cast("array<string>"))
    mark = lambda r: F.when(F.array_contains(F.col("notes"), r["note"]), F.concat(F.lit("[^"), r["note"], F.lit("]"))).otherwise("")
    run = lambda r: r.withField("rid", F.element_at("targets", r["rid"])).withField("t", F.when(r["note"].isNotNull(), mark(r)).otherwise(r["t"]))
    fixed = F.filter(F.transform("runs", run), lambda r: r["note"].isNull() | (r["t"] != ""))
    align = F.when(F.col("jc") == "center", "center").when(F.col("jc").isin("right", "end"), "right").when(F.col("jc").isin("both", "distribute"), "justify").otherwise("left")
    images = F.transform("images", lambda i: i.withField("rid", F.element_at(F.split(F.element_at("targets", i["rid"]), "/"), -1)))
    heading = F.when(F.col("region") == "body", F.coalesce("heading", F.lit(0))).otherwise(0)
    return p.select("doc_id", F.lit(0).alias("section_idx"), "region", "ord", "seq", fixed.alias("runs"), F.coalesce(images, F.array().cast(IMAGES)).alias("images"), heading.alias("heading"), align.alias("alignment"), "list_type", "list_level", "list_number", "style_id", "style_name", "table_id", "cell")


def cells(f: DataFrame) -> DataFrame:
    """Table cells with columns and row spans: a continuation belongs to the last origin above it."""
    c = kind(f, "cell", table_id="table", cell="cell", row="row:int", span="span:int", head="head:boolean", merge="merge")
    row = Window.partitionBy("doc_id", "table_id", "row").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("col", F.coalesce(F.sum("span").over(row), F.lit(0)).cast("int"))
    above = Window.partitionBy("doc_id", "table_id", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    origin = F.last(F.when(F.col("merge") != "continue", F.struct("cell", "merge")), ignorenulls=True).over(above)
    c = c.withColumn("_origin", origin).withColumn("_of", F.when((F.col("merge") == "continue") & (F.col("_origin.merge") == "restart"), F.col("_origin.cell")).otherwise(F.col("cell")))
    spans = c.groupBy("doc_id", F.col("_of").alias("cell")).agg((F.max("row") - F.min("row") + 1).alias("row_span"))
    kept = c.where(F.col("_of") == F.col("cell"))
    return kept.join(spans, ["doc_id", "cell"]).select("doc_id", "table_id", "cell", "row", "col", F.col("ord").alias("cell_idx"), F.col("span").alias("col_span"), "row_span", (F.col("head") | (F.col("row") == 0)).alias("is_header"))


def cell_texts(f: DataFrame, shown: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Cells with their paragraphs: a repeated neighbour goes, and the second of two equal halves. texts are plain;
    shown (of merged runs, images, and whether bold goes without saying) gives another
    rendering of each, in parts; alignment is the first one's."""
    p = paragraphs(f).where("region = 'cell'").withColumn("text", plain_text(F.col("runs")))
    w = Window.partitionBy("doc_id", "cell").orderBy("ord")
    p = p.where("text <> '' or size(images) > 0").withColumn("_before", F.lag("text").over(w)).where(~F.col("text").eqNullSafe(F.col("_before")) | (F.col("text") == ""))
    grid = cells(f)
    p = p.join(grid.select("doc_id", "cell", "is_header"), ["doc_id", "cell"])
    if shown:  # columns of their own, as each is used several times in the next
        p = p.withColumn("_merged", merge_runs(F.col("runs")))
        filled = F.filter("_merged", lambda r: F.trim(F.coalesce(r["t"], F.lit(""))) != "")
        p = p.withColumn("_plain", F.col("is_header") & (F.size(filled) > 0) & F.forall(filled, lambda r: F.coalesce(r["b"], F.lit(False))))
        p = p.withColumn("part", shown(F.col("_merged"), F.col("images"), F.col("_plain")))
    else:
        p = p.withColumn("part", F.col("text"))
    bold = F.forall("runs", lambda r: (F.trim(F.coalesce(r["t"], F.lit(""))) == "") | F.coalesce(r["b"], F.lit(False)))
    all_ = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text", "part", "alignment", bold.alias("bold")))), lambda x: x.dropFields("ord"))
    text = p.groupBy("doc_id", "cell").agg(all_.alias("all"))
    texts = lambda x: F.transform(x, lambda y: y["text"])
    half = (F.size("all") / 2).cast("int")
    twice = (F.size("all") % 2 == 0) & (F.size("all") > 0) & (texts(F.slice("all", F.lit(1), half)) == texts(F.slice("all", half + 1, half)))
    text = text.withColumn("all", F.when(twice, F.slice("all", F.lit(1), half)).otherwise(F.col("all")))
    empty = F.array().cast("array<string>")
    out = grid.join(text, ["doc_id", "cell"], "left")
    return out.withColumns({
        "texts": F.coalesce(texts(F.col("all")), empty),
        "parts": F.coalesce(F.filter(F.transform("all", lambda x: x["part"]), lambda x: x != ""), empty),
        "alignment": F.coalesce(F.get("all", F.lit(0))["alignment"], F.lit("left")),
        "bold": F.coalesce(F.forall("all", lambda x: x["bold"]), F.lit(False)),
    }).drop("all")


def note_definitions(f: DataFrame) -> DataFrame:
    """Notes in the order of kind, then of numeric id; others last."""
    n = kind(f, "note", kind="kind", id="id", text="text")
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("kind"), F.expr("try_cast(id as bigint)").asc_nulls_last(), "ord"))).drop("part", "ord")
