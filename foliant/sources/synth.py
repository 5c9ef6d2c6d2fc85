"""Small packages from tables, for round trips: one paragraph a line, rows as cells, turns as slides."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MAIN = {"docx": ("word/document.xml", "wordprocessingml.document.main+xml"), "xlsx": ("xl/workbook.xml", "spreadsheetml.sheet.main+xml"), "pptx": ("ppt/presentation.xml", "presentationml.presentation.main+xml")}


def package(kind: str, parts: dict[str, str | bytes]) -> bytes:
    part, content = MAIN[kind]
    head = {
        "[Content_Types].xml": f'<Types><Override PartName="/{part}" ContentType="application/vnd.openxmlformats-officedocument.{content}"/></Types>',
        "_rels/.rels": f'<Relationships><Relationship Id="rId1" Type="{REL}/officeDocument" Target="{part}"/></Relationships>',
    }
    return zipped({name: body.encode() if isinstance(body, str) else body for name, body in (head | parts).items()})


@lru_cache(1024)
def headers(name: bytes) -> tuple[bytes, bytes]:
    """Of a stored entry what stands before and after its sum and sizes, in its own header and in the directory."""
    rest = struct.pack("<2H", len(name), 0)
    return rest + name, rest + bytes(6) + struct.pack("<I", 0o600 << 16)


def zipped(parts: dict[str, bytes]) -> bytes:
    """An archive of stored entries, as zipfile would write it. zipfile writes what is large or not named in ASCII."""
    if len(parts) >= 0xFFFF or sum(map(len, parts.values())) >= 1 << 30 or not all(map(str.isascii, parts)):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in parts.items():
                z.writestr(zipfile.ZipInfo(name), body)
        return out.getvalue()
    out, listed, at = [], [], 0
    for name, body in parts.items():
        own, entry = headers(raw := name.encode())
        sums = struct.pack("<3I", zlib.crc32(body), len(body), len(body))
        out += [b"PK\3\4\x14\0\0\0\0\0\0\0\x21\0", sums, own, body]
        listed += [b"PK\1\2\x14\3\x14\0\0\0\0\0\0\0\x21\0", sums, entry, struct.pack("<I", at), raw]
        at += 30 + len(raw) + len(body)
    end = struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, len(parts), len(parts), sum(map(len, listed)), at, 0)
    return b"".join([*out, *listed, end])


def rels(items: list[tuple[str, str, str]]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{REL}/{t}" Target={quoteattr(x)}{" TargetMode=" + chr(34) + "External" + chr(34) if "://" in x else ""}/>' for i, t, x in items) + "</Relationships>"


def text(s: str) -> str:
    return escape("".join(c for c in s if c in "\t\n" or ord(c) >= 32))


def docx(body: str, **parts: str | bytes) -> bytes:
    return package("docx", {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"} | {k.replace("__", "/"): v for k, v in parts.items()})


def docx_of(lines: list[str]) -> bytes:
    return docx("".join(f'<w:p><w:r><w:t xml:space="preserve">{text(s)}</w:t></w:r></w:p>' for s in lines))


def xlsx(sheets: dict[str, str], strings: list[str] = (), formats: list[int] = (0,), extra: dict[str, str] | None = None) -> bytes:
    names = list(sheets)
    parts = {
        "xl/workbook.xml": f"<workbook {S}><sheets>" + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": rels([(f"rId{i}", "worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(names) + 1)]),
        "xl/sharedStrings.xml": f"<sst {S}>" + "".join(f"<si><t>{text(s)}</t></si>" for s in strings) + "</sst>",
        "xl/styles.xml": f"<styleSheet {S}><cellXfs>" + "".join(f'<xf numFmtId="{f}"/>' for f in formats) + "</cellXfs></styleSheet>",
    }
    parts |= {f"xl/worksheets/sheet{i}.xml": f"<worksheet {S}>{sheets[n]}</worksheet>" for i, n in enumerate(names, 1)}
    return package("xlsx", parts | (extra or {}))


def pptx(slides: list[str], extra: dict[str, str] | None = None) -> bytes:
    parts = {
        "ppt/presentation.xml": f"<p:presentation {P}><p:sldIdLst>" + "".join(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>' for i in range(1, len(slides) + 1)) + "</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": rels([(f"rId{i}", "slide", f"slides/slide{i}.xml") for i in range(1, len(slides) + 1)]),
    }
    parts |= {f"ppt/slides/slide{i}.xml": f"<p:sld {P}><p:cSld><p:spTree>{s}</p:spTree></p:cSld></p:sld>" for i, s in enumerate(slides, 1)}
    return package("pptx", parts | (extra or {}))


def shape(lines: list[str], ph: str = "") -> str:
    mark = f"<p:nvSpPr><p:nvPr>{f'<p:ph type={quoteattr(ph)}/>' if ph else ''}</p:nvPr></p:nvSpPr>"
    return f"<p:sp>{mark}<p:txBody>" + "".join(f"<a:p><a:r><a:t>{text(s)}</a:t></a:r></a:p>" for s in lines) + "</p:txBody></p:sp>"


#: Packages, and bytes of packages, of a batch of rows; bytes of a table (as Spark estimates them) for a partition.
AT_ONCE, BATCH_BYTES, PIECE_BYTES = 512, 4 << 20, 4 << 20


def pieces(*sources: DataFrame) -> int:
    """Partitions for packages of tables: as many as there are cores, and more of larger tables."""
    size = sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in sources)
    size = 0 if size >= 1 << 50 else size  # what Spark says of rows that are no files
    return max(sources[0].sparkSession.sparkContext.defaultParallelism, min(-(-size // PIECE_BYTES), 4096))


def batches_of(packages: Iterable[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """doc_id and content in batches of bounded size."""
    ids, bodies, size = [], [], 0
    for doc_id, body in packages:
        ids.append(doc_id)
        bodies.append(body)
        size += len(body)
        if size >= BATCH_BYTES or len(ids) >= AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(bodies, pa.binary())], names=["doc_id", "content"])
            ids, bodies, size = [], [], 0
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(bodies, pa.binary())], names=["doc_id", "content"])


def dealt(df: DataFrame, key: str, n: int, order: list[str] = ()) -> DataFrame:
    """df in n partitions by the key as text, which doc_id is."""
    out = df.repartition(n, F.col(key).cast("string"))
    return out.sortWithinPartitions(key, *order) if order else out


def built(df: DataFrame, packages: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str, bytes]]], n: int) -> DataFrame:
    out = df.mapInArrow(lambda batches: batches_of(packages(batches)), "doc_id string, content binary")
    out._dealt = n
    return out


def files(df: DataFrame, build: Callable[[dict], bytes], key: str) -> DataFrame:
    """doc_id and content: build(row as a dict) for each row."""

    def packages(batches):
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                for r in b.slice(at, AT_ONCE).to_pylist():
                    yield str(r[key]), build(r)

    # a number of partitions that is asked for is not merged again: packages are small rows and much work
    return built(dealt(df, key, n := pieces(df)), packages, n)


def grouped(df: DataFrame, build: Callable[[dict], bytes], key: str, order: list[str], rows: str = "t", like: list[DataFrame] = ()) -> DataFrame:
    """doc_id and content: build(the key, and rows: its rows as dicts, in order) for each key. Rows come sorted, so those
    of one package are all that is held. like: tables by whose size df is dealt, if not by its own."""

    def packages(batches):
        last, held = None, []
        for b in batches:
            names, own = b.schema.names, b.schema.get_field_index(key)
            for values in zip(*(c.to_pylist() for c in b.columns)):
                if held and values[own] != last:
                    yield str(last), build({key: last, rows: held})
                    held = []
                last = values[own]
                held.append(dict(zip(names, values)))
        if held:
            yield str(last), build({key: last, rows: held})

    return built(dealt(df, key, n := pieces(*(like or [df])), order), packages, n)


def documents_as_docx(docs: DataFrame) -> DataFrame:
    return files(docs.select("doc_id", "text"), lambda r: docx_of((r["text"] or "").split("\n")), "doc_id")


def conversations_as_pptx(turns: DataFrame) -> DataFrame:
    return grouped(turns.select("conv_id", "turn", "role", "text"), lambda r: pptx([shape([x["role"]], "title") + shape((x["text"] or "").split("\n")) for x in r["t"]]), "conv_id", ["turn", "role", "text"])


def orders_as_xlsx(orders: DataFrame, lineitem: DataFrame, each: int = 512) -> DataFrame:
    """Workbooks of the line items of so many orders each: strings shared, dates as serial numbers."""
    rows = lineitem.join(orders.select("o_orderkey", "o_orderdate"), lineitem["l_orderkey"] == orders["o_orderkey"])
    serial = F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date"))
    columns = ["l_orderkey", "l_linenumber", "l_returnflag", "q", "d"]
    rows = rows.select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("double").alias("q"), serial.alias("d")).withColumn("book", F.floor(F.col("l_orderkey") / each))

    def build(r: dict) -> bytes:
        flags = sorted({x["l_returnflag"] for x in r["rows"]})
        out = ['<row r="1"><c r="A1" t="inlineStr"><is><t>order</t></is></c></row>']
        for i, x in enumerate(r["rows"], 2):
            out.append(f'<row r="{i}"><c r="A{i}"><v>{x["l_orderkey"]}</v></c><c r="B{i}"><v>{x["l_linenumber"]}</v></c><c r="C{i}" t="s"><v>{flags.index(x["l_returnflag"])}</v></c><c r="D{i}"><v>{x["q"]!r}</v></c><c r="E{i}" s="1"><v>{x["d"]}</v></c></row>')
        return xlsx({"items": f"<sheetData>{''.join(out)}</sheetData>"}, flags, [0, 14])

    return grouped(rows, build, "book", columns, "rows", [orders, lineitem])
