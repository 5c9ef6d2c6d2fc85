"""The engine as SQL functions. Table functions of a package's bytes: doc_parts, doc_facts, doc_blocks, sheet_cells;
scalars: detect_format, and clean_text(text) with clean_text_minimal and clean_text_aggressive, which are expressions
of SQL that Spark puts in place of the call. Of facts that are there already, register_facts makes views and table
functions of SQL: doc_to_markdown, doc_to_text, doc_to_json, blocks_of, cells_of."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import OfficeError
from ..options import Cleanup, RenderOptions
from ..sources.leaves import facts_of
from ..sources.package import Package
from .text import clean_sql


def detect(data: bytes | None) -> str:
    """docx, xlsx or pptx, or the name of the error."""
    try:
        return Package(data or b"").format
    except OfficeError as e:
        return e.name


def register(spark: SparkSession) -> None:
    @F.pandas_udf("string")
    def detect_format(content: pd.Series) -> pd.Series:
        return content.map(detect)

    @F.udtf(returnType="kind string, part string, ord bigint, attrs map<string,string>")
    class DocFacts:
        def eval(self, content):
            yield from facts_of(bytes(content or b""))

    @F.udtf(returnType="part string, size bigint, bytes binary, error string")
    class DocParts:
        def eval(self, content):
            try:
                p = Package(bytes(content or b""))
            except OfficeError as e:
                yield e.part, None, None, e.name
                return
            for name in p.names:
                try:
                    body = p.bytes(name)
                    yield name, len(body), body, None
                except OfficeError as e:
                    yield name, None, None, e.name

    @F.udtf(returnType="block bigint, block_type string, region string, style_id string, text string, error string")
    class DocBlocks:
        """Paragraphs and tables of a Word package in order, as they stand in it."""

        def eval(self, content):
            for kind, _, ord_, a in facts_of(bytes(content or b"")):
                if kind == "error":
                    yield None, None, None, None, None, a["name"]
                elif kind == "para":
                    yield ord_, "Paragraph", a["region"], a.get("style"), "".join(r.get("t", "") for r in json.loads(a["runs"])), None
                elif kind == "table":
                    yield ord_, "Table", a["region"], None, None, None

    @F.udtf(returnType="sheet_part string, cell_ref string, cell_type string, value string, error string")
    class SheetCells:
        """Cells of an Excel package as written: shared strings are resolved, styles aren't."""

        def eval(self, content):
            shared: dict[str, str] = {}
            later = []
            for kind, part, ord_, a in facts_of(bytes(content or b"")):
                if kind == "error":
                    yield part, None, None, None, a["name"]
                elif kind == "string":
                    shared[str(ord_)] = a["value"]
                elif kind == "sheet_cell":
                    later.append((part, a))
            for part, a in later:
                yield part, a.get("r"), a.get("t"), shared.get(a["raw"], a["raw"]) if a.get("t") == "s" else a["raw"], None

    spark.udf.register("detect_format", detect_format)
    spark.udtf.register("doc_facts", DocFacts)
    spark.udtf.register("doc_parts", DocParts)
    spark.udtf.register("doc_blocks", DocBlocks)
    spark.udtf.register("sheet_cells", SheetCells)

    @F.pandas_udf("string")
    def text_nfc(x: pd.Series) -> pd.Series:
        return x.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")

    spark.udf.register("text_nfc", text_nfc)
    for name, how in (("clean_text", "default"), ("clean_text_minimal", "minimal"), ("clean_text_aggressive", "aggressive")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {whole_sql(how)}")


def whole_sql(how: str) -> str:
    """All stages of a preset on x: front matter off where the preset keeps it, NFC where a text can need it, the rest."""
    nfc = lambda t: f"if({t} RLIKE '[^\\\\x{{0000}}-\\\\x{{02FF}}]', text_nfc({t}), {t})"
    if not Cleanup.named(how).preserve_frontmatter:
        return clean_sql(nfc("x"), how)
    end = "locate('\\n---\\n', x, 4)"
    body = f"if(startswith(x, '---\\n') AND {end} > 0, regexp_replace(substring(x, {end} + 5), '^\\n+', ''), x)"
    front = f"if(startswith(x, '---\\n') AND {end} > 0, concat(substring(x, 1, {end} + 4), '\\n'), '')"
    return f"concat({front}, {clean_sql(nfc(body), how)})"


def register_facts(spark: SparkSession, facts: DataFrame, options: RenderOptions | None = None) -> None:
    """Views over facts, and table functions of a document's id over the views: plans that join, with no Python in them.

    Views: office_documents, office_blocks, office_cells, office_markdown, office_text, office_json.
    Functions: doc_to_markdown(id), doc_to_text(id), doc_to_json(id), blocks_of(id), cells_of(id)."""
    from ..functions.model import plain_text
    from ..plans import render
    from ..sources import office

    office.documents(facts).createOrReplaceTempView("office_documents")
    blocks = render.blocks(facts)
    blocks.select("doc_id", "section_idx", "region", "ord", "block_type", "heading", "list_type", "list_level", "list_number", "style_id", "table_id", plain_text(F.col("runs")).alias("text")).createOrReplaceTempView("office_blocks")
    render.grid_cells(facts).createOrReplaceTempView("office_cells")
    render.to_markdown(facts, options).createOrReplaceTempView("office_markdown")
    render.to_text(facts).createOrReplaceTempView("office_text")
    render.to_json(facts).createOrReplaceTempView("office_json")
    for name, view, column in (("doc_to_markdown", "office_markdown", "markdown"), ("doc_to_text", "office_text", "text"), ("doc_to_json", "office_json", "json")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(id STRING) RETURNS TABLE ({column} STRING) RETURN SELECT v.{column} FROM {view} v WHERE v.doc_id = {name}.id")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION blocks_of(id STRING) RETURNS TABLE (section_idx INT, region STRING, ord BIGINT, block_type STRING, heading INT, text STRING) RETURN SELECT v.section_idx, v.region, v.ord, v.block_type, v.heading, v.text FROM office_blocks v WHERE v.doc_id = blocks_of.id")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cells_of(id STRING) RETURNS TABLE (table_id STRING, `row` INT, col INT, text STRING) RETURN SELECT v.table_id, v.`row`, v.col, v.text FROM office_cells v WHERE v.doc_id = cells_of.id")
