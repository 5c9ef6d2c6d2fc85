"""Excel facts to typed cells and trimmed tables: all lookups are joins on the document, the sheet and the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.model import column_of, is_date_format, row_of, serial_date
from ..sources.office import kind, present, relationships

#: Kinds of facts that cells reads.
CELLS = ("sheet_cell", "string", "xf", "number_format", "rel", "link", "comment", "merge", "sheet")


def sheets(f: DataFrame) -> DataFrame:
    return kind(f, "sheet", name="name", sheet="part").select("doc_id", F.col("ord").alias("sheet_idx"), "name", "sheet")


def merges(f: DataFrame) -> DataFrame:
    """Ranges by their top left: reversed corners are put right."""
    m = kind(f, "merge", ref="ref").withColumns({"a": F.split("ref", ":")[0], "b": F.coalesce(F.get(F.split("ref", ":"), F.lit(1)), F.split("ref", ":")[0])})
    c, d, r, s = column_of(F.col("a")), column_of(F.col("b")), row_of(F.col("a")), row_of(F.col("b"))
    return m.select("doc_id", F.col("part").alias("sheet"), F.least(c, d).alias("col"), F.least(r, s).alias("row"), (F.abs(c - d) + 1).alias("col_span"), (F.abs(r - s) + 1).alias("row_span"))


def level(span: Column) -> Column:
    """The least k with 2**k >= span."""
    return F.when(span <= 1, 0).otherwise(F.ceil(F.log2((span - 0.5).cast("double")))).cast("int")


def covered(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, sheet, row, col of the cells that lie in a range but not at its top left: a join of points with
    rectangles. A rectangle stands in the blocks of a grid as coarse as itself (four at most, whatever it covers), and a
    cell asks only the grids that its sheet has."""
    keys = ["doc_id", "sheet"]
    r = ranges.where("col_span > 1 or row_span > 1").select(*keys, F.col("row").alias("r0"), F.col("col").alias("c0"), (F.col("row") + F.col("row_span") - 1).alias("r1"), (F.col("col") + F.col("col_span") - 1).alias("c1"), level(F.col("row_span")).alias("rl"), level(F.col("col_span")).alias("cl"))
    side = lambda a, b, k: F.explode(F.array_distinct(F.array(F.expr(f"shiftright({a}, {k})"), F.expr(f"shiftright({b}, {k})"))))
    blocks = r.withColumn("rb", side("r0", "r1", "rl")).withColumn("cb", side("c0", "c1", "cl"))
    grids = r.groupBy(*keys).agg(F.collect_set(F.struct("rl", "cl")).alias("grids"))  # 21 by 15 at most
    points = cells.select(*keys, "row", "col").join(grids, keys).withColumn("g", F.explode("grids"))
    points = points.select(*keys, "row", "col", "g.rl", "g.cl", F.expr("shiftright(row, g.rl)").alias("rb"), F.expr("shiftright(col, g.cl)").alias("cb"))
    met = points.join(blocks, [*keys, "rl", "cl", "rb", "cb"])
    inside = met.where("row between r0 and r1 and col between c0 and c1 and not (row = r0 and col = c0)")
    return inside.select(*keys, "row", "col").distinct()


def formats(f: DataFrame) -> DataFrame:
    """doc_id, style: which cell styles are dates."""
    x = kind(f, "xf", format="format:int").select("doc_id", F.col("ord").cast("int").alias("style"), "format")
    codes = kind(f, "number_format", format="id:int", code="code").drop("part", "ord").dropDuplicates(["doc_id", "format"])
    return x.join(codes, ["doc_id", "format"], "left").select("doc_id", "style", is_date_format(F.col("format"), F.col("code")).alias("is_date"))


def cells(f: DataFrame) -> DataFrame:
    """doc_id, sheet_idx, name, row_idx (as written), ref, row, col, value, is_date, error, link, comment, spans.

    A cell without a reference follows its left neighbour; what a merge covers is dropped."""
    c = kind(f, "sheet_cell", row_idx="row:int", ref="r", type="t", style="s:int", vm="vm:int", raw="raw").withColumnRenamed("part", "sheet")
    place = Window.partitionBy("doc_id", "sheet", "row_idx").orderBy("ord")
    known = column_of(F.col("ref"))
    c = c.withColumn("_known", known).withColumn("_run", F.count("_known").over(place))
    c = c.withColumn("col", F.coalesce(F.first("_known", ignorenulls=True).over(Window.partitionBy("doc_id", "sheet", "row_idx", "_run")), F.lit(-1) + F.when(F.col("_run") == 0, 1).otherwise(0)) + F.row_number().over(Window.partitionBy("doc_id", "sheet", "row_idx", "_run").orderBy("ord")) - 1)
    c = c.withColumn("row", F.coalesce(row_of(F.col("ref")), F.col("row_idx") + 1))
    strings = kind(f, "string", value="value").select("doc_id", F.col("ord").alias("_idx"), F.col("value").alias("_string"))
    c = c.withColumn("_idx", F.when(F.col("type") == "s", F.expr("try_cast(raw as bigint)")))
    c = c.join(strings, ["doc_id", "_idx"], "left").join(formats(f), ["doc_id", "style"], "left")
    number = F.expr("try_cast(raw as double)")
    plain = F.col("type").isNull() | (F.col("type") == "n")
    date = F.when(plain & F.col("is_date"), serial_date(number))
    value = (
        F.when(F.col("type") == "s", F.coalesce("_string", F.when(F.col("_idx").isNull(), F.col("raw"))))
        .when(F.col("type") == "b", F.when(F.col("raw") == "1", "TRUE").otherwise("FALSE"))
        .when(F.col("type") == "e", F.concat(F.lit("#ERROR:"), F.col("raw")))
        .otherwise(F.coalesce(date, F.col("raw")))
    )
    bad = F.when((F.col("type") == "s") & F.col("_idx").isNotNull() & F.col("_string").isNull(), F.struct(F.lit(7).alias("kind"), F.lit("InvalidData").alias("name"), F.concat(F.lit("shared string "), F.col("raw")).alias("message"), F.col("sheet").alias("part")))
    rels = relationships(f).select("doc_id", F.col("source_part").alias("sheet"), F.col("rel_id").alias("rid"), "target")
    links = kind(f, "link", ref="ref", rid="rid").withColumnRenamed("part", "sheet").join(rels, ["doc_id", "sheet", "rid"]).select("doc_id", "sheet", "ref", F.col("target").alias("link")).dropDuplicates(["doc_id", "sheet", "ref"])
    comments = kind(f, "comment", ref="ref", comment="text").withColumnRenamed("part", "sheet").drop("ord").dropDuplicates(["doc_id", "sheet", "ref"])
    c = c.select("doc_id", "sheet", "row_idx", "ord", "ref", "type", "row", "col", "vm", value.alias("value"), F.coalesce("is_date", F.lit(False)).alias("is_date"), bad.alias("error"))
    if present(f, "link"):
        c = c.join(links, ["doc_id", "sheet", "ref"], "left")
    else:
        c = c.withColumn("link", F.lit(None).cast("string"))
    if present(f, "comment"):
        c = c.join(comments, ["doc_id", "sheet", "ref"], "left")
    else:
        c = c.withColumn("comment", F.lit(None).cast("string"))
    if not present(f, "merge"):
        return c.withColumns({"col_span": F.lit(1), "row_span": F.lit(1)}).join(sheets(f), ["doc_id", "sheet"])
    m = merges(f)
    c = c.join(m.groupBy("doc_id", "sheet", "row", "col").agg(F.max("col_span").alias("col_span"), F.max("row_span").alias("row_span")), ["doc_id", "sheet", "row", "col"], "left")
    c = c.join(covered(c, m), ["doc_id", "sheet", "row", "col"], "left_anti")
    c = c.withColumns({"col_span": F.coalesce("col_span", F.lit(1)), "row_span": F.coalesce("row_span", F.lit(1))})
    return c.join(sheets(f), ["doc_id", "sheet"])


def table_cells(f: DataFrame) -> DataFrame:
    """Cells of trimmed tables: rows after the last with content and columns after the last with content are left out."""
    c = cells(f)
    filled = (F.coalesce("value", F.lit("")) != "") | F.col("comment").isNotNull()
    sheet = Window.partitionBy("doc_id", "sheet_idx")
    c = c.withColumns({"_row": F.max(F.when(filled, F.col("row_idx"))).over(sheet), "_col": F.max(F.when(filled, F.col("col") + F.col("col_span") - 1)).over(sheet)})
    return c.where("row_idx <= _row and (col <= _col or _col is null)").drop("_row", "_col")


def rich_images(f: DataFrame) -> DataFrame:
    """doc_id, vm, image: five hops from a cell's number to a picture; a missing hop gives none."""
    vm = kind(f, "vm", v="v:int").select("doc_id", F.col("ord").alias("vm"), "v")
    rvb = kind(f, "rvb", i="i:int").select("doc_id", F.col("ord").alias("v"), "i")
    values = kind(f, "rv_value", structure="structure:int", slot="slot:int", value="value:int").select("doc_id", F.col("ord").alias("i"), "structure", "slot", "value")
    keys = kind(f, "rv_key", slot="slot:int", key="key").where("key = '_rvRel:LocalImageIdentifier'").select("doc_id", F.col("ord").alias("structure"), "slot")
    rel = kind(f, "rv_rel", rid="rid").select("doc_id", F.col("ord").alias("value"), "rid")
    target = relationships(f).where("source_part = 'xl/richData/richValueRel.xml'").select("doc_id", F.col("rel_id").alias("rid"), "target")
    hops = vm.join(rvb, ["doc_id", "v"]).join(values, ["doc_id", "i"]).join(keys, ["doc_id", "structure", "slot"]).join(rel, ["doc_id", "value"]).join(target, ["doc_id", "rid"])
    return hops.select("doc_id", "vm", F.element_at(F.split("target", "/"), -1).alias("image"))


def drawings(f: DataFrame) -> DataFrame:
    """Pictures on sheets: sheet, drawing, media."""
    d = kind(f, "drawing", drawing="drawing", rid="rid", name="name", w="w:long", h="h:long").withColumnRenamed("part", "sheet")
    rels = relationships(f).select("doc_id", F.col("source_part").alias("drawing"), F.col("rel_id").alias("rid"), "target")
    return d.join(rels, ["doc_id", "drawing", "rid"]).join(sheets(f).select("doc_id", "sheet", "sheet_idx"), ["doc_id", "sheet"]).select("doc_id", "sheet_idx", "ord", F.element_at(F.split("target", "/"), -1).alias("image"), F.col("name").alias("alt"), "w", "h")
