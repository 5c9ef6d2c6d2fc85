"""Facts to Markdown, text and JSON: a string for each block, then one ordered aggregate for each document."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.model import IMAGES, RUNS, display_width, merge_runs, plain_text
from ..operators import excel, headings, slides, word
from ..options import HeadingConfig, RenderOptions
from ..sources.office import documents, kind, present, resource_list

BLOCK = ["doc_id", "section_idx", "region", "class", "ord", "block_type", "runs", "images", "heading", "list_type", "list_level", "list_number", "style_id", "style_name", "table_id", "alignment"]

#: Kinds of facts that Markdown without front matter is made of: all but lists of parts and metadata.
MARKDOWN = ("format", "para", "table", "cell", "note", "style", "num_level", "drawing", "vm", "rvb", "rv_value", "rv_key", "rv_rel", "slide", "slide_para", "placeholder", "slide_cell", "slide_pic", "slide_note", "slide_chart", *excel.CELLS, *slides.CHARTS)


# --------------------------------------------------------------------------- blocks of all formats
def blocks(f: DataFrame) -> DataFrame:
    """Paragraphs, tables and pictures of all documents, in order (section_idx, region, class, ord)."""
    none = lambda t: F.lit(None).cast(t)

    def shaped(df: DataFrame, **have: Column) -> DataFrame:
        base = {"section_idx": F.lit(0), "region": F.lit("body"), "class": F.lit(0), "block_type": F.lit("Paragraph"), "runs": F.array().cast(RUNS), "images": F.array().cast(IMAGES), "heading": F.lit(0), "list_type": none("string"), "list_level": none("int"), "list_number": none("long"), "style_id": none("string"), "style_name": none("string"), "table_id": none("string"), "alignment": none("string")}
        cols = {c: have.get(c, F.col(c) if c in df.columns else base.get(c)) for c in BLOCK}
        return df.select(*[cols[c].alias(c) for c in BLOCK])

    text = lambda col: F.from_json(F.to_json(F.array(F.struct(col.alias("t")))), RUNS)
    picture = lambda df: F.array(F.struct(F.col("image").alias("rid"), F.col("alt"), F.col("w").cast("string").alias("w"), F.col("h").cast("string").alias("h")))

    def paras():
        return shaped(word.paragraphs(f).where("region <> 'cell'"))

    def tables():
        return shaped(kind(f, "table", table_id="table", parent="parent", region="region").where("parent = ''"), block_type=F.lit("Table"))

    def notes():
        note = F.concat(F.lit("[^"), F.when(F.col("kind") == "endnote", "e").otherwise(""), F.col("id"), F.lit("]: "), F.col("text"))
        return shaped(word.note_definitions(f), region=F.lit("notes"), ord=F.col("rank").cast("long"), runs=text(note))

    def sheet():
        rows = excel.table_cells(f).select("doc_id", "sheet_idx").distinct()
        return shaped(rows, section_idx=F.col("sheet_idx").cast("int"), ord=F.lit(0).cast("long"), block_type=F.lit("Table"), table_id=F.concat(F.lit("sheet#"), F.col("sheet_idx")))

    def sheet_pictures():
        d = excel.drawings(f)
        return shaped(d, section_idx=F.col("sheet_idx").cast("int"), **{"class": F.lit(3)}, block_type=F.lit("Image"), images=picture(d))

    def slide_paras():
        return shaped(slides.paragraphs(f), section_idx=F.col("slide_idx").cast("int"))

    def slide_tables():
        rows = slides.table_cells(f).select("doc_id", "slide_idx", "table_id", "table_ord").distinct()
        return shaped(rows, section_idx=F.col("slide_idx").cast("int"), **{"class": F.lit(1)}, ord=F.col("table_ord").cast("long"), block_type=F.lit("Table"))

    def pictures():
        d = slides.pictures(f)
        return shaped(d, section_idx=F.col("slide_idx").cast("int"), **{"class": F.lit(3)}, block_type=F.lit("Image"), images=picture(d))

    def slide_notes():
        return shaped(slides.notes(f), section_idx=F.col("slide_idx").cast("int"), region=F.lit("notes"), runs=text(F.col("text")))

    def charts():
        where = kind(f, "slide_chart", chart="chart").withColumnRenamed("part", "slide").join(slides.slides(f), ["doc_id", "slide"]).select("doc_id", "chart", "slide_idx")
        rows = slides.chart_tables(f).select("doc_id", "chart").join(where, ["doc_id", "chart"], "left")
        return shaped(rows, section_idx=F.coalesce("slide_idx", F.lit(0)).cast("int"), **{"class": F.lit(2)}, ord=F.lit(0).cast("long"), block_type=F.lit("Table"), table_id=F.col("chart"))

    branches = [(paras, "para"), (tables, "table"), (notes, "note"), (sheet, "sheet_cell"), (sheet_pictures, "drawing"), (slide_paras, "slide_para"), (slide_tables, "slide_cell"), (pictures, "slide_pic"), (slide_notes, "slide_note"), (charts, "chart")]
    return united([make() for make, which in branches if present(f, which)] or [paras()])


def united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def grid_cells(f: DataFrame, shown: Callable | None = None, prefix: str = "") -> DataFrame:
    """doc_id, table_id, row, col, text, col_span, row_span, is_header, align, bold of all tables; charts included. shown
    renders the paragraphs of Word cells (else they are plain)."""
    left = {"align": F.lit("left"), "bold": F.lit(False)}
    single = {"col_span": F.lit(1), "row_span": F.lit(1)}
    columns = ["doc_id", "table_id", "row", "col", "text", "col_span", "row_span", "is_header", "align", "bold"]

    def of_word():
        w = word.cell_texts(f, shown)
        return w.withColumns({"text": F.array_join("parts" if shown else "texts", "<br>"), "align": F.col("alignment")}).select(*columns)

    def of_excel():
        x = excel.table_cells(f)
        value = F.coalesce("value", F.lit(""))
        if present(f, "rv_rel"):  # a picture stands for the error that a cell shows in its place
            x = x.join(excel.rich_images(f).groupBy("doc_id", "vm").agg(F.min("image").alias("picture")), ["doc_id", "vm"], "left")
            value = F.when(F.col("picture").isNotNull() & (F.col("type") == "e"), "").otherwise(value)
        linked = F.concat(F.lit("["), value, F.lit("]("), link_target(F.col("link")), F.lit(")"))
        value = F.when(F.col("link").isNotNull() & (value != ""), linked).otherwise(value)
        value = F.concat(value, F.coalesce(F.concat(F.lit(" *[Comment: "), F.col("comment"), F.lit("]*")), F.lit("")))
        if present(f, "rv_rel"):
            shot = F.concat(F.lit("![image]("), link_target(F.concat(F.lit(prefix), F.col("picture"))), F.lit(")"))
            value = F.concat_ws("<br>", F.nullif(value, F.lit("")), shot)
        return x.select("doc_id", F.concat(F.lit("sheet#"), F.col("sheet_idx")).alias("table_id"), F.col("row_idx").alias("row"), "col", value.alias("text"), "col_span", "row_span", (F.col("row_idx") == 0).alias("is_header")).withColumns(left).select(*columns)

    def of_slides():
        return slides.table_cells(f).withColumns(left | single).select(*columns)

    def of_charts():
        c = slides.chart_tables(f).select("doc_id", F.col("chart").alias("table_id"), F.posexplode(F.concat(F.array("header"), F.col("rows"))).alias("row", "values")).select("doc_id", "table_id", "row", F.posexplode("values").alias("col", "text"))
        return c.withColumns(left | single | {"is_header": F.col("row") == 0}).select(*columns)

    branches = [(of_word, "cell"), (of_excel, "sheet_cell"), (of_slides, "slide_cell"), (of_charts, "chart")]
    return united([make() for make, which in branches if present(f, which)] or [of_slides()])


def with_nested(f: DataFrame, bodies: DataFrame, sep: str) -> DataFrame:
    """doc_id, table_id, body: a table's nested ones, at whatever depth, follow it in their order."""
    tree = kind(f, "table", table_id="table", root="root").select("doc_id", "table_id", "root", "ord")
    rows = bodies.join(tree, ["doc_id", "table_id"], "left")
    rows = rows.select("doc_id", F.coalesce("root", "table_id").alias("table_id"), F.coalesce("ord", F.lit(0)).alias("ord"), "body")
    return ordered(rows, ["doc_id", "table_id"], "body", sep, ["ord"])


# --------------------------------------------------------------------------- Markdown scalars
_BEFORE, _AFTER = r"(?<=[^\s\p{Z}(\[{:\-/\\])", r"(?=[^\s\p{Z})\]}:\-/\\])"


def escape(t: Column, cell: bool = False) -> Column:
    """Backslashes and backquotes always, bars in cells, stars and underscores between characters where they could open
    or close; no underscore inside a word."""
    word = r"(?:(?<![\p{L}\p{N}]_)|(?![\p{L}\p{N}]))"
    t = F.regexp_replace(t, rf"([\\`]|{_BEFORE}\*{_AFTER}|{_BEFORE}_{_AFTER}{word})", r"\\$1")
    return F.replace(t, F.lit("|"), F.lit("\\|")) if cell else t


def link_target(url: Column) -> Column:
    odd = url.rlike(r"[ <>]")
    return F.when(odd, F.concat(F.lit("<"), F.regexp_replace(url, r"([<>])", r"\\$1"), F.lit(">"))).otherwise(url)


def run_markdown(r: Column, o: RenderOptions, plain_bold: Column) -> Column:
    """A run: its marks before and after its text, from the outside in revision, link, emphasis, then strike,
    underline, sub- and superscript."""
    t = F.coalesce(r["t"], F.lit(""))
    on = lambda k: F.coalesce(r[k], F.lit(False))
    mark = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(""))
    linked, noted, shown = r["rid"].isNotNull(), r["note"].isNotNull(), ~plain_bold
    styled = on("b") | on("i") | on("s") | on("u") | on("sup") | on("sub") | linked
    core = F.when(styled, F.trim(t)).otherwise(t)
    if o.escape:
        core = F.when(noted, t).otherwise(escape(core))
    bold, italic = on("b") & shown, on("i") & shown
    stars = F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
    rev = F.coalesce(r["rev"], F.lit(""))
    before, after = [], []
    if o.revisions == "markup":
        before.append(F.when(rev == "deleted", "~~").when(rev == "inserted", "<ins>").otherwise(""))
        after.append(F.when(rev == "deleted", "~~").when(rev == "inserted", "</ins>").otherwise(""))
    before += [mark(linked, "["), stars, mark(on("s"), "~~"), mark(on("u"), "<u>"), mark(on("sub"), "<sub>"), mark(on("sup"), "<sup>")]
    after += [F.when(linked, F.concat(F.lit("]("), link_target(r["rid"]), F.lit(")"))).otherwise(""), stars, mark(on("s"), "~~"), mark(on("u"), "</u>"), mark(on("sub"), "</sub>"), mark(on("sup"), "</sup>")]
    out = F.when(F.trim(t) == "", t).otherwise(F.concat(*before, core, *reversed(after)))
    out = F.concat(out, F.when(on("pb"), "\n\n---\n\n").when(on("lb"), "  \n").otherwise(""))
    hidden = {"accept": "deleted", "reject": "inserted"}.get(o.revisions)
    return F.when(rev == hidden, F.lit("")).otherwise(out) if hidden else out


def join_runs(parts: Column) -> Column:
    """A space between runs, unless one side has one or the next begins with closing punctuation."""

    def step(a, x):
        glue = (a == "") | (x == "") | a.rlike(r"\s$") | x.rlike(r"^[\s.,;:!?)\]}’”»、。]")
        return F.when(glue, F.concat(a, x)).otherwise(F.concat(a, F.lit(" "), x))

    return F.aggregate(parts, F.lit(""), step)


def image_markdown(images: Column, prefix: str, sep: str = "\n") -> Column:
    return F.array_join(F.transform(images, lambda i: F.concat(F.lit("!["), F.coalesce(F.nullif(i["alt"], F.lit("")), F.lit("image")), F.lit("]("), link_target(F.concat(F.lit(prefix), F.coalesce(i["rid"], F.lit("")))), F.lit(")"))), sep)


def cell_markdown(o: RenderOptions) -> Callable[[Column, Column, Column], Column]:
    """A paragraph of a Word cell with its formats, links and pictures; bold as a whole is left out in a header."""

    def shown(runs: Column, images: Column, uniform: Column) -> Column:
        body = join_runs(F.transform(runs, lambda r: run_markdown(r, o, uniform)))
        if o.preserve_breaks:
            body = F.replace(body, F.lit("  \n"), F.lit("<br>"))
        return F.concat_ws("<br>", F.nullif(body, F.lit("")), F.nullif(image_markdown(images, o.image_prefix, "<br>"), F.lit("")))

    return shown


def tables_markdown(f: DataFrame, o: RenderOptions) -> DataFrame:
    """doc_id, table_id, body: pipe tables, or HTML for merged ones if that is asked for. Cells stand at their
    column, and what spans cover is empty; columns are aligned as the cells of the first row of data are."""
    c = grid_cells(f, cell_markdown(o), o.image_prefix)
    keys = ["doc_id", "table_id"]
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " ")
    size = c.groupBy(*keys).agg(F.max(F.col("col") + F.col("col_span")).alias("width"), F.max(F.greatest("col_span", "row_span")).alias("spans"))
    cell = F.struct("col", text.alias("text"), "col_span", "row_span", "is_header", "align", "bold")
    rows = c.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(cell)).alias("cells")).join(size, keys)
    barred = lambda x: F.replace(x, F.lit("|"), F.lit("\\|"))
    rows = rows.withColumn("at", F.map_from_entries(F.transform(F.array_distinct(F.transform("cells", lambda x: x["col"])), lambda k: F.struct(k, barred(F.filter("cells", lambda x: x["col"] == k)[0]["text"])))))
    columns = F.sequence(F.lit(0), F.col("width") - 1)
    line = F.concat(F.lit("| "), F.array_join(F.transform(columns, lambda k: F.coalesce(F.element_at("at", k), F.lit(""))), " | "), F.lit(" |"))
    # a column that a merge covers is aligned as the cell that covers it
    side = lambda k: F.try_element_at(F.filter("cells", lambda x: x["col"] <= k), F.lit(-1))["align"]
    mark = lambda k: F.when(side(k) == "center", ":---:").when(side(k) == "right", "---:").otherwise("---")
    rule = F.concat(F.lit("| "), F.array_join(F.transform(columns, mark), " | "), F.lit(" |"))
    html = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    attr = lambda n, x: F.when(x > 1, F.concat(F.lit(f' {n}="'), x.cast("string"), F.lit('"'))).otherwise("")
    tag = lambda x: F.when(x["is_header"], "th").otherwise("td")
    html_cell = lambda x: F.concat(F.lit("<"), tag(x), attr("colspan", x["col_span"]), attr("rowspan", x["row_span"]), F.lit(">"), html(x["text"]), F.lit("</"), tag(x), F.lit(">"))
    rows = rows.withColumns({"_md": line, "_rule": rule, "_html": F.concat(F.lit("<tr>"), F.array_join(F.transform("cells", html_cell), ""), F.lit("</tr>"))})
    joined = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("row", x))), lambda s: s[x])
    rows = rows.withColumn("_head", F.forall("cells", lambda x: x["is_header"]))
    out = rows.groupBy(*keys).agg(joined("_md").alias("md"), joined("_html").alias("html"), F.min_by("_rule", F.struct("_head", "row")).alias("rule"), F.first("spans").alias("spans"), F.count("*").alias("rows"), F.first("cells").alias("cells"))
    body = F.array_join(F.array_insert("md", 2, F.col("rule")), "\n")
    if o.table == "html":
        body = F.when(F.col("spans") > 1, F.concat(F.lit("<table>\n"), F.array_join("html", "\n"), F.lit("\n</table>"))).otherwise(body)
    if o.callouts:
        only = F.get("cells", F.lit(0))
        quoted = F.transform(F.split(only["text"], "<br>"), lambda x: F.when(F.trim(x) == "", ">").otherwise(F.concat(F.lit("> **"), F.trim(x), F.lit("**"))))
        body = F.when((F.col("rows") == 1) & (F.size("cells") == 1) & only["bold"] & (F.trim(only["text"]) != ""), F.array_join(quoted, "\n")).otherwise(body)
    return with_nested(f, out.select(*keys, body.alias("body")), "\n\n")


def frontmatter(f: DataFrame) -> DataFrame:
    d = documents(f)
    label = F.when(F.col("format") == "pptx", "slides").when(F.col("format") == "xlsx", "sheets").otherwise("pages")
    text = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    quoted = lambda name, col: F.concat(F.lit(f"{name}: "), text(F.col(col)))
    rows = [F.concat(F.lit("format: "), F.col("format")), *(F.when(F.col(c).isNotNull(), quoted(c, c)) for c in ("title", "author", "subject", "created", "modified"))]
    rows += [F.when(F.col("page_count").isNotNull(), F.concat(label, F.lit(": "), F.col("page_count").cast("string"))), F.when(F.col("word_count").isNotNull(), F.concat(F.lit("words: "), F.col("word_count").cast("string")))]
    rows += [F.when(F.size("keywords") > 0, F.concat(F.lit("keywords:\n"), F.array_join(F.transform("keywords", lambda k: F.concat(F.lit("  - "), text(k))), "\n"))), F.when(F.col("application").isNotNull(), quoted("application", "application"))]
    return d.select("doc_id", F.concat(F.lit("---\n"), F.concat_ws("\n", *rows), F.lit("\n---\n\n")).alias("front"))


def sections(f: DataFrame) -> DataFrame:
    """doc_id, section_idx, format, name."""
    named = lambda df, at, how, name: df.select("doc_id", F.col(at).cast("int").alias("section_idx"), F.lit(how).alias("format"), name.alias("name"))
    branches = [
        (lambda: named(excel.sheets(f), "sheet_idx", "xlsx", F.col("name")), "sheet"),
        (lambda: named(slides.slides(f), "slide_idx", "pptx", F.concat(F.lit("Slide "), F.col("slide_idx") + 1)), "slide"),
        (lambda: named(kind(f, "format", format="format", zero="zero").where("format = 'docx'").withColumn("zero", F.lit(0)), "zero", "docx", F.lit(None).cast("string")), "format"),
    ]
    out = united([make() for make, which in branches if present(f, which)] or [branches[2][0]()])
    if present(f, "error"):  # a document that failed as a whole has no sections, whatever was read before
        out = out.join(kind(f, "error", section="section").where("section is null").select("doc_id").distinct(), "doc_id", "left_anti")
    return out


def ordered(df: DataFrame, by: list[str], column: str, sep: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, column))), lambda x: x[column]), sep).alias(column))


def section_markdown(f: DataFrame, options: RenderOptions | None = None, resource_map: DataFrame | None = None) -> DataFrame:
    """doc_id, section_idx, format, name, markdown: every section by itself. resource_map (doc_id, resource_id,
    filename) says where pictures lie; without it they go by the names of their parts."""
    o = options or RenderOptions()
    b = blocks(f).where(F.lit(o.headers_footers) | ~F.col("region").isin("header", "footer")).where(F.lit(o.notes) | (F.col("region") != "notes"))
    b = b.withColumn("runs", merge_runs(F.coalesce("runs", F.array().cast(RUNS)))).withColumn("text", plain_text(F.col("runs")))
    b = b.withColumn("images", F.coalesce("images", F.array().cast(IMAGES)))
    if resource_map is not None:  # a map a document, of as many entries as it has pictures
        maps = resource_map.groupBy("doc_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("resource_id", "filename")))).alias("files"))
        named = lambda i: i.withField("rid", F.coalesce(F.try_element_at("files", i["rid"]), i["rid"]))
        b = b.join(maps, "doc_id", "left").withColumn("images", F.transform("images", named)).drop("files")
    config = o.headings or HeadingConfig(max_level=o.max_heading)
    if o.headings:
        b = headings.analyze(b, config).withColumn("level", F.col("decision.level"))
    else:
        b = b.withColumn("level", headings.simple_heading(F.col("heading"), F.col("text"), config))
    if present(f, "table", "sheet_cell", "slide_cell", "chart"):
        b = b.join(tables_markdown(f, o).withColumnRenamed("body", "table_body"), ["doc_id", "table_id"], "left")
    else:
        b = b.withColumn("table_body", F.lit(""))
    is_list = F.col("list_type").isNotNull()
    b = b.withColumn("level", F.when(is_list, 0).otherwise(F.col("level")))
    filled = F.filter("runs", lambda r: F.trim(F.coalesce(r["t"], F.lit(""))) != "")
    uniform = (F.col("level") > 0) & (F.size(filled) > 0) & F.forall(filled, lambda r: F.coalesce(r["b"], F.lit(False)))
    b = b.withColumn("_uniform", uniform)
    b = b.withColumns({"_body": join_runs(F.transform("runs", lambda r: run_markdown(r, o, F.col("_uniform")))), "_pictures": image_markdown(F.col("images"), o.image_prefix)})
    bullet = F.when(F.col("list_type") == "numbered", F.concat(F.col("list_number").cast("string"), F.lit(". "))).otherwise("- ")
    prefix = F.when(is_list, F.concat(F.repeat(F.lit("  "), F.col("list_level")), bullet)).when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "))).otherwise("")
    said = F.when(F.trim("_body") != "", F.concat(prefix, F.col("_body"))).otherwise("")
    gap = F.when((F.trim("_body") != "") & (F.col("_pictures") != ""), "\n\n").otherwise("")
    b = b.withColumn("shown", F.when(F.col("block_type") == "Table", F.coalesce("table_body", F.lit(""))).otherwise(F.concat(said, gap, F.col("_pictures")))).where("shown <> ''")
    if o.headers_footers and present(f, "para"):  # all paragraphs of a region are one line
        around = F.col("region").isin("header", "footer")
        lines = ordered(b.where(around), ["doc_id", "section_idx", "region"], "shown", " | ", ["class", "ord"])
        lines = lines.withColumn("shown", F.concat(F.lit("> *"), F.initcap("region"), F.lit(": "), F.col("shown"), F.lit("*")))
        lines = lines.withColumns({"class": F.lit(0), "ord": F.lit(0).cast("long"), "list_type": F.lit(None).cast("string")})
        keep = ["doc_id", "section_idx", "region", "class", "ord", "list_type", "shown"]
        b = b.where(~around).select(*keep).unionByName(lines.select(*keep))
    region = F.when(F.col("region") == "header", 0).when(F.col("region") == "body", 1).when(F.col("region") == "notes", 2).otherwise(3)
    b = b.withColumns({"_region": region, "_list": F.col("list_type").isNotNull(), "_note": (F.col("region") == "notes")})
    place = Window.partitionBy("doc_id", "section_idx").orderBy("_region", "class", "ord")
    b = b.withColumn("_next", F.lead("_list").over(place)).withColumn("_prev_note", F.lag("_note", 1, False).over(place))
    slide_note = F.col("_note") & ~F.col("shown").startswith("[^")
    b = b.withColumn("shown", F.concat(F.when(slide_note & ~F.col("_prev_note"), "> **Notes:**\n").otherwise(""), F.when(slide_note, F.concat(F.lit("> "), F.regexp_replace("shown", "\n", "\n> "))).otherwise(F.col("shown")), F.when(F.col("_list") & F.coalesce("_next", F.lit(False)), "\n").otherwise("\n\n")))
    text = ordered(b, ["doc_id", "section_idx"], "shown", "", ["_region", "class", "ord"])
    s = sections(f).join(text, ["doc_id", "section_idx"], "left")
    unit = F.when(F.col("format") == "pptx", "slide").otherwise("sheet")
    comment = F.when(F.col("name").isNotNull(), F.concat(F.lit("<!-- "), unit, F.lit(" "), (F.col("section_idx") + 1).cast("string"), F.lit(": "), F.col("name"), F.lit(" -->\n\n"))).otherwise("") if o.section_markers else F.lit("")
    rule = F.when(F.col("name").isNotNull() & (F.col("section_idx") > 0), "\n---\n\n").otherwise("")
    head = F.when(F.col("name").isNotNull(), F.concat(F.lit("## "), F.col("name"), F.lit("\n\n"))).otherwise("")
    return s.select("doc_id", "section_idx", "format", "name", F.concat(comment, rule, head, F.coalesce("shown", F.lit(""))).alias("markdown"))


def to_markdown(f: DataFrame, options: RenderOptions | None = None) -> DataFrame:
    """doc_id, markdown: the sections of a document, joined."""
    o = options or RenderOptions()
    out = ordered(section_markdown(f, o), ["doc_id"], "markdown", "", ["section_idx"])
    if o.cleanup:
        out = T.clean(out, "markdown", o.cleanup, "markdown")
    out = out.withColumn("markdown", F.regexp_replace(F.regexp_replace("markdown", "\n{3,}", "\n\n"), r"^\s+|\s+$", ""))
    if o.refine:
        out = refine(out, "markdown")
    if o.frontmatter:
        out = out.join(frontmatter(f), "doc_id", "left").withColumn("markdown", F.concat(F.coalesce("front", F.lit("")), F.col("markdown"))).drop("front")
    return out


def refine(df: DataFrame, column: str) -> DataFrame:
    """Link targets with forward slashes. What else a refiner may do is not part of this engine (approximate)."""
    return df.withColumn(column, F.regexp_replace(column, r"(?<=\]\([^)\s]{0,200})\\(?=[^)\s]*\))", "/"))


# --------------------------------------------------------------------------- text and JSON
def tables_text(f: DataFrame) -> DataFrame:
    """doc_id, table_id, body: columns as wide as their widest cell (3 at least; wide characters count twice)."""
    c = grid_cells(f).withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), "<br>|[\r\n]+", " "))
    c = c.withColumn("w", F.greatest(F.max(display_width(F.col("text"))).over(Window.partitionBy("doc_id", "table_id", "col")), F.lit(3)))
    padded = F.concat(F.col("text"), F.repeat(F.lit(" "), (F.col("w") - display_width(F.col("text"))).cast("int")))
    rows = c.withColumn("cell", padded).withColumn("rule", F.repeat(F.lit("="), F.col("w").cast("int")))
    rows = rows.groupBy("doc_id", "table_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", "cell", "rule"))).alias("x"))
    line = lambda k: F.concat(F.lit("| "), F.array_join(F.transform("x", lambda s: s[k]), " | "), F.lit(" |"))
    first = F.row_number().over(Window.partitionBy("doc_id", "table_id").orderBy("row")) == 1
    rows = rows.withColumn("line", F.concat(line("cell"), F.when(first, F.concat(F.lit("\n"), line("rule"))).otherwise("")))
    return with_nested(f, ordered(rows, ["doc_id", "table_id"], "line", "\n", ["row"]).withColumnRenamed("line", "body"), "\n")


def to_text(f: DataFrame, cleanup=None) -> DataFrame:
    """doc_id, text: names of sections, paragraphs, boxed tables, pictures by their names, notes last."""
    b = blocks(f).where(~F.col("region").isin("header", "footer")).join(tables_text(f), ["doc_id", "table_id"], "left")
    words = plain_text(merge_runs(F.coalesce("runs", F.array().cast(RUNS))))
    pictures = F.array_join(F.transform(F.coalesce("images", F.array().cast(IMAGES)), lambda i: F.concat(F.lit("[Image: "), F.coalesce(i["alt"], i["rid"], F.lit("")), F.lit("]"))), "\n")
    b = b.withColumn("shown", F.when(F.col("block_type") == "Table", F.coalesce("body", F.lit(""))).otherwise(F.concat_ws("\n", F.nullif(words, F.lit("")), F.nullif(pictures, F.lit("")))))
    b = b.withColumn("_region", F.when(F.col("region") == "body", 1).otherwise(2))
    s = sections(f).join(ordered(b, ["doc_id", "section_idx"], "shown", "\n", ["_region", "class", "ord"]), ["doc_id", "section_idx"], "left")
    s = s.withColumn("text", F.concat_ws("\n\n", "name", F.coalesce("shown", F.lit(""))))
    out = ordered(s, ["doc_id"], "text", "\n\n", ["section_idx"])
    return T.clean(out, "text", cleanup, "text") if cleanup else out.withColumn("text", F.regexp_replace("text", "^\n+|\n+$", ""))


def plain(f: DataFrame) -> DataFrame:
    """doc_id, text: paragraphs and tables of bodies only."""
    b = blocks(f).where("region = 'body'")
    c = ordered(grid_cells(f).withColumn("text", F.replace(F.coalesce("text", F.lit("")), F.lit("<br>"), F.lit("\n"))), ["doc_id", "table_id", "row"], "text", "\t", ["col"])
    bodies = with_nested(f, ordered(c, ["doc_id", "table_id"], "text", "\n", ["row"]).withColumnRenamed("text", "body"), "\n")
    b = b.join(bodies, ["doc_id", "table_id"], "left")
    b = b.withColumn("text", F.when(F.col("block_type") == "Table", F.coalesce("body", F.lit(""))).otherwise(plain_text(F.coalesce("runs", F.array().cast(RUNS)))))
    s = ordered(b, ["doc_id", "section_idx"], "text", "\n", ["class", "ord"])
    return ordered(s, ["doc_id"], "text", "\n\n", ["section_idx"]).withColumn("text", F.regexp_replace("text", "^\n+|\n+$", ""))


def to_json(f: DataFrame, pretty: bool = False) -> DataFrame:
    """doc_id, json: format, metadata and sections; defaults are left out, as nulls are by to_json."""
    on = lambda x: F.when(F.coalesce(x, F.lit(False)), True)
    run = lambda r: F.struct(r["t"].alias("text"), F.struct(on(r["b"]).alias("bold"), on(r["i"]).alias("italic"), on(r["u"]).alias("underline"), on(r["s"]).alias("strikethrough"), on(r["sup"]).alias("superscript"), on(r["sub"]).alias("subscript"), r["font"].alias("font"), r["size"].try_cast("int").alias("size"), r["color"].alias("color"), r["hl"].alias("highlight")).alias("style"), r["rid"].alias("hyperlink"), on(r["lb"]).alias("line_break"), on(r["pb"]).alias("page_break"), r["rev"].alias("revision"))
    cells = grid_cells(f).groupBy("doc_id", "table_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", F.struct(F.col("text").alias("content"), F.when(F.col("col_span") > 1, F.col("col_span")).alias("col_span"), F.when(F.col("row_span") > 1, F.col("row_span")).alias("row_span"), on(F.col("is_header")).alias("is_header")).alias("c")))).alias("cells"))
    tables = cells.groupBy("doc_id", "table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: F.struct(F.transform(r["cells"], lambda x: x["c"]).alias("cells"))).alias("rows"))
    tree = kind(f, "table", table_id="table", root="root").select("doc_id", "table_id", "root", "ord").where("root <> table_id")
    nested = tree.join(tables, ["doc_id", "table_id"]).groupBy("doc_id", F.col("root").alias("table_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "rows"))), lambda x: F.struct(x["rows"].alias("rows"))).alias("nested_tables"))
    b = blocks(f).join(tables, ["doc_id", "table_id"], "left").join(nested, ["doc_id", "table_id"], "left")
    heading = F.when(F.col("heading") > 0, F.concat(F.lit("H"), F.col("heading").cast("string")))
    listed = F.when(F.col("list_type").isNotNull(), F.struct("list_type", F.col("list_level").alias("level"), F.col("list_number").alias("number")))
    aligned = F.when(F.col("alignment") != "left", F.col("alignment"))
    block = F.struct(F.col("block_type").alias("type"), F.when(F.col("block_type") == "Paragraph", F.transform("runs", run)).alias("runs"), heading.alias("heading"), aligned.alias("alignment"), listed.alias("list_info"), "style_id", "style_name", "rows", "nested_tables", F.when(F.size("images") > 0, F.col("images")).alias("images"))
    b = b.withColumn("_block", F.struct("class", "ord", F.to_json(block).alias("j")))
    of = lambda region: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("region") == region, F.col("_block")))), lambda x: x["j"]), ",").alias(region)
    s = sections(f).join(b.groupBy("doc_id", "section_idx").agg(*(of(r) for r in ("body", "header", "footer", "notes"))), ["doc_id", "section_idx"], "left")
    name = F.when(F.col("name").isNotNull(), F.concat(F.lit(',"name":'), F.expr("substring(to_json(array(name)), 2, length(to_json(array(name))) - 2)"))).otherwise("")
    more = [F.when(F.coalesce(r, F.lit("")) != "", F.concat(F.lit(f',"{r}":['), F.col(r), F.lit("]"))).otherwise("") for r in ("header", "footer", "notes")]
    s = s.withColumn("j", F.concat(F.lit('{"index":'), F.col("section_idx").cast("string"), name, F.lit(',"content":['), F.coalesce("body", F.lit("")), F.lit("]"), *more, F.lit("}")))
    s = ordered(s, ["doc_id"], "j", ",", ["section_idx"])
    d = documents(f).withColumn("keywords", F.when(F.size("keywords") > 0, F.col("keywords")))
    meta = F.to_json(F.struct(*[c for c in d.columns if c not in ("doc_id", "format", "error")]))
    named = F.concat(F.expr("substring(to_json(array(resource_id)), 2, length(to_json(array(resource_id))) - 2)"), F.lit(":"), F.to_json(F.struct("type", "filename", "mime_type", "size")))
    r = ordered(resource_list(f).withColumn("r", named), ["doc_id"], "r", ",", ["resource_id"])
    held = F.when(F.col("r").isNotNull(), F.concat(F.lit(',"resources":{'), F.col("r"), F.lit("}"))).otherwise("")
    out = d.join(s, "doc_id").join(r, "doc_id", "left").select("doc_id", F.concat(F.lit('{"format":"'), F.col("format"), F.lit('","metadata":'), meta, F.lit(',"sections":['), F.col("j"), F.lit("]"), held, F.lit("}")).alias("json"))
    return pretty_json(out) if pretty else out


def pretty_json(df: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else json.dumps(json.loads(t), indent=2, ensure_ascii=False) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "json"])

    return df.select("doc_id", "json").mapInArrow(run, "doc_id string, json string")
