"""Queries of the office operators: round trips over the driver's tables, and the SQL of what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import model as M
from ..options import HeadingConfig, RenderOptions
from ..plans import render
from ..sources import office, synth
from . import excel, headings, slides, word


def table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def docx_facts(s, d):
    return office.stored_facts(synth.documents_as_docx(table(s, d, "documents")))


def docx_plain_text(s, d) -> DataFrame:
    return render.plain(docx_facts(s, d)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def docx_counts(s, d) -> DataFrame:
    p = word.paragraphs(docx_facts(s, d)).withColumn("text", M.plain_text(F.col("runs")))
    return p.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n_paragraphs"), F.sum(F.length("text")).alias("n_chars"))


def xlsx_cells(s, d) -> DataFrame:
    return excel.cells(office.stored_facts(synth.orders_as_xlsx(table(s, d, "orders"), table(s, d, "lineitem")), kinds=excel.CELLS))


def xlsx_totals(s, d) -> DataFrame:
    """Typed cells of the parsed books, summed by flag and year."""
    c = xlsx_cells(s, d).where("row > 1")
    rows = c.groupBy("doc_id", "sheet_idx", "row").pivot("col", [2, 3, 4]).agg(F.first("value"))
    return rows.groupBy(F.col("2").alias("flag"), F.substring("4", 1, 4).alias("year")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("3").cast("double")), 2).alias("quantity"), F.min("4").alias("first_day"), F.max("4").alias("last_day"))


def pptx_turns(s, d) -> DataFrame:
    p = slides.paragraphs(office.stored_facts(synth.conversations_as_pptx(table(s, d, "conversations")))).withColumn("text", M.plain_text(F.col("runs")))
    return p.groupBy(F.col("doc_id").cast("long").alias("conv_id"), F.col("slide_idx").cast("long").alias("slide_idx")).agg(F.max(F.when(F.col("heading") == 1, F.col("text"))).alias("title"), F.count_if(F.col("heading") == 0).alias("n_paragraphs"), F.sum(F.when(F.col("heading") == 0, F.length("text")).otherwise(0)).alias("n_chars"))


def metadata(s, d) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "lang", "source", "n_chars")

    def build(r):
        core = f'<cp:coreProperties><dc:title>{r["source"]}</dc:title><dc:creator>{r["lang"]}</dc:creator><cp:keywords>a, {r["lang"]}; b</cp:keywords><dc:title>{r["source"]}-{r["doc_id"]}</dc:title></cp:coreProperties>'
        return synth.package("docx", {"word/document.xml": f"<w:document {synth.W}><w:body/></w:document>", "docProps/core.xml": core, "docProps/app.xml": f"<Properties><Words>{r['n_chars']}</Words><Pages>3</Pages><Slides>9</Slides></Properties>"})

    m = office.documents(office.stored_facts(synth.files(docs, build, "doc_id")))
    return m.select(F.col("doc_id").cast("long").alias("doc_id"), "format", "title", "author", F.array_join("keywords", "|").alias("keywords"), "page_count", "word_count")


def lines_of_orders(s, d) -> DataFrame:
    return table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))


def list_numbers(s, d) -> DataFrame:
    items = lines_of_orders(s, d).select("l_orderkey", (F.col("l_linenumber")).alias("seq"), F.pmod("l_partkey", F.lit(3)).cast("int").alias("level"), F.lit(1).cast("long").alias("start"))
    return word.number_window(items, ["l_orderkey"], "seq").select("l_orderkey", "seq", "level", "number")


def heading_sequences(s, d) -> DataFrame:
    """Lines numbered by turn: runs of consecutive markers are demoted."""
    line = lines_of_orders(s, d).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("ord"), F.concat((F.col("l_linenumber") + F.pmod("l_partkey", F.lit(2))).cast("string"), F.lit(". item")).alias("text"), F.lit(2).alias("heading"), F.lit(None).cast("string").alias("style_id"), F.lit(None).cast("string").alias("style_name"))
    p = line.withColumn("runs", F.from_json(F.to_json(F.array(F.struct(F.col("text").alias("t")))), M.RUNS))
    out = headings.analyze(p, HeadingConfig(trust_explicit=False))
    return out.select("doc_id", "ord", "text", F.col("decision.kind").alias("kind"), F.col("decision.level").cast("long").alias("level"))


def cell_refs(s, d) -> DataFrame:
    n = table(s, d, "orders").select(F.pmod("o_orderkey", F.lit(18000)).alias("n")).distinct()
    two = F.when(F.col("n") >= 702, F.char((F.floor((F.col("n") - 702) / 676) + 65).cast("int"))).otherwise("")
    one = F.when(F.col("n") >= 26, F.char((F.pmod(F.floor((F.col("n") - 26) / 26), F.lit(26)) + 65).cast("int"))).otherwise("")
    ref = F.concat(two, one, F.char((F.pmod("n", F.lit(26)) + 65).cast("int")), F.lit("7"))
    return n.select(F.col("n").cast("long").alias("n"), M.column_of(ref).cast("long").alias("col"), M.row_of(ref).cast("long").alias("row"))


def serial_dates(s, d) -> DataFrame:
    return table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().select(F.col("day").cast("string").alias("day"), M.serial_date(F.datediff("day", F.lit("1899-12-30").cast("date")).cast("double")).alias("iso"))


def paths(s, d) -> DataFrame:
    p = table(s, d, "pages").select("page_id")
    base = F.concat(F.lit("a/b"), F.pmod("page_id", F.lit(3)).cast("string"), F.lit("/c.xml"))
    target = F.element_at(F.array(F.lit("../x/y.xml"), F.lit("/root.xml"), F.lit("./z.png"), F.lit("../../../q.xml")), (F.pmod("page_id", F.lit(4)) + 1).cast("int"))
    return p.select("page_id", M.resolve_path(base, target).alias("path"), M.rels_path(base).alias("rels"), M.mime_of(M.resolve_path(base, target)).alias("mime"))


def markdown(s, d) -> DataFrame:
    out = render.to_markdown(docx_facts(s, d), RenderOptions(escape=False))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "markdown")


def orders_of_lines(s, d) -> DataFrame:
    """Flat: l_orderkey, l_linenumber, k."""
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.pmod("l_partkey", F.lit(2)).alias("k"))


def spans(rows: DataFrame) -> DataFrame:
    """Spans of a merged grid, by order: rows of a line that continue the cell above."""

    def build(r):
        cell = lambda x, m: f"<w:tc><w:tcPr>{m}</w:tcPr><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>"
        body = "".join("<w:tr>" + cell(x["l_linenumber"], '<w:vMerge w:val="restart"/>' if x["k"] or not i else "<w:vMerge/>") + cell("v", "") + "</w:tr>" for i, x in enumerate(r["t"]))
        return synth.docx(f"<w:tbl>{body}</w:tbl>")

    c = word.cells(office.stored_facts(synth.grouped(rows, build, "l_orderkey", ["l_linenumber", "k"]), kinds=["cell"])).where("col = 0")
    return c.select(F.col("doc_id").cast("long").alias("l_orderkey"), (F.col("row") + 1).cast("long").alias("nth"), F.col("row_span").cast("long").alias("row_span"))


def table_spans_all(s, d) -> DataFrame:
    return spans(orders_of_lines(s, d))


def quality_report(s, d) -> DataFrame:
    """Counts of what all documents hold, with a total (rollup over languages)."""
    b = render.blocks(docx_facts(s, d)).join(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang"), "doc_id")
    return b.rollup("lang").agg(F.countDistinct("doc_id").alias("n_docs"), F.count_if(F.col("block_type") == "Paragraph").alias("n_paragraphs"), F.count_if(F.col("block_type") == "Table").alias("n_tables"))


QUERIES = {f.__name__: f for f in (docx_plain_text, docx_counts, xlsx_totals, pptx_turns, metadata, list_numbers, heading_sequences, cell_refs, serial_dates, paths, markdown, quality_report, table_spans_all)} | {"table_spans": table_spans_all}

LINES = "string_split(coalesce(text, ''), chr(10))"
ORACLES = {
    "docx_plain_text": "SELECT doc_id, regexp_replace(text, '^\\n+|\\n+$', '', 'g') AS text FROM documents",
    "docx_counts": f"SELECT doc_id, len({LINES}) AS n_paragraphs, (length(text) - len({LINES}) + 1)::BIGINT AS n_chars FROM documents",
    "xlsx_totals": "SELECT l_returnflag AS flag, strftime(o_orderdate::DATE, '%Y') AS year, count(*) AS n, round(sum(l_quantity::DOUBLE), 2) AS quantity, min(o_orderdate::DATE)::VARCHAR AS first_day, max(o_orderdate::DATE)::VARCHAR AS last_day FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
    "pptx_turns": f"SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) AS slide_idx, role AS title, len(list_filter({LINES}, lambda x: x <> '')) AS n_paragraphs, length(replace(coalesce(text, ''), chr(10), ''))::BIGINT AS n_chars FROM conversations",
    "metadata": "SELECT doc_id, 'docx' AS format, source || '-' || doc_id AS title, lang AS author, 'a|' || lang || '|b' AS keywords, 3::BIGINT AS page_count, n_chars AS word_count FROM documents",
    "list_numbers": "WITH i AS (SELECT l_orderkey, l_linenumber AS seq, (l_partkey % 3)::INTEGER AS level FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)), g AS (SELECT *, CASE level WHEN 0 THEN 0 WHEN 1 THEN sum((level < 1)::INT) OVER w ELSE sum((level < 2)::INT) OVER w END AS grp FROM i WINDOW w AS (PARTITION BY l_orderkey ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT l_orderkey, seq, level, row_number() OVER (PARTITION BY l_orderkey, level, grp ORDER BY seq) AS number FROM g",
    "heading_sequences": "WITH m AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS ord, l_linenumber + l_partkey % 2 AS n FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)), b AS (SELECT *, CASE WHEN n = lag(n) OVER w + 1 THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY ord)), i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS island FROM b), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, island) AS size FROM i) SELECT doc_id, ord, n || '. item' AS text, CASE WHEN size >= 2 THEN 'Demoted' ELSE 'Explicit' END AS kind, CASE WHEN size >= 2 THEN 0 ELSE 2 END::BIGINT AS level FROM c",
    "cell_refs": "SELECT DISTINCT (o_orderkey % 18000)::BIGINT AS n, (o_orderkey % 18000)::BIGINT AS col, 7::BIGINT AS row FROM orders",
    "serial_dates": "SELECT DISTINCT o_orderdate::DATE::VARCHAR AS day, o_orderdate::DATE::VARCHAR AS iso FROM orders",
    "paths": "SELECT page_id, p AS path, 'a/b' || page_id % 3 || '/_rels/c.xml.rels' AS rels, CASE WHEN p LIKE '%.png' THEN 'image/png' ELSE 'application/octet-stream' END AS mime FROM (SELECT page_id, ['a/x/y.xml', 'root.xml', 'a/b' || page_id % 3 || '/z.png', 'q.xml'][page_id % 4 + 1] AS p FROM pages)",
    "markdown": r"SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS markdown FROM documents",
    "quality_report": f"SELECT lang, count(*) AS n_docs, sum(len({LINES}))::BIGINT AS n_paragraphs, 0::BIGINT AS n_tables FROM documents GROUP BY ROLLUP (lang)",
    "table_spans_all": "WITH r AS (SELECT l_orderkey, row_number() OVER w AS nth, CASE WHEN l_partkey % 2 = 1 OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS head FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 2)), g AS (SELECT *, sum(head) OVER (PARTITION BY l_orderkey ORDER BY nth) AS grp FROM r) SELECT l_orderkey, min(nth) AS nth, count(*) AS row_span FROM g GROUP BY l_orderkey, grp",
}
ORACLES["table_spans"] = ORACLES["table_spans_all"]  # both names: every order
