"""Parsing by the piece, the graph of parts, the data source and its writer, spans, predicates, SQL functions."""

import io
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.functions import model as M
from foliant.functions import sql
from foliant.operators import excel, roundtrips, tables, word
from foliant.options import RenderOptions
from foliant.plans import render
from foliant.sources import datasource, leaves, office, synth
from foliant.sources.package import Package, Puller, parse_xml


def files(spark, *contents):
    return spark.createDataFrame([(f"d{i}", bytearray(c)) for i, c in enumerate(contents)], "doc_id string, content binary")


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be"])
def test_pulling_reads_what_parsing_whole_reads(size, encoding):
    text = '<?xml version="1.0"?>\n<a><r n="1">x & y &amp; z<b/>tail\r\n</r><skip><r2/></skip><r n="2">é 한 &#x41;&#xD800;&bogus;\U0001f600</r></a>'
    data = text.encode(encoding)
    puller = Puller("p", lambda parent, name: name == "r")
    got = [n for at in range(0, len(data), size) for n in puller.feed(data[at : at + size])] + puller.feed(b"", True)
    want = [n for n in parse_xml(data).children if n.name == "r"]
    assert [(n.attrs, n.all_text()) for n in got] == [(n.attrs, n.all_text()) for n in want] and len(got) == 2


def big_sheet(rows):
    out = io.BytesIO()
    out.write(synth.xlsx({"s": ""}))
    with zipfile.ZipFile(out, "a", zipfile.ZIP_DEFLATED) as z, z.open("xl/worksheets/big.xml", "w", force_zip64=True) as f:
        f.write(b"<worksheet><sheetData>")
        for at in range(0, rows, 1000):
            f.write("".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="B{i}"><v>{i * 7}</v></c></row>' for i in range(at + 1, at + 1001)).encode())
        f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def test_a_large_sheet_in_bounded_memory_and_early_stop():
    data = big_sheet(100_000)
    p = Package(data)
    tracemalloc.start()
    n = sum(1 for _ in leaves.worksheet(p, "xl/worksheets/big.xml"))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200_000 and p.pulled > 5 << 20 and most < 4 << 20
    early = Package(data)
    next(leaves.worksheet(early, "xl/worksheets/big.xml"))
    assert early.pulled <= 1 << 16


def test_no_package_ends_the_job(spark):
    cfb = bytearray(bytes.fromhex("D0CF11E0A1B11AE1") + b"\xff" * 600)
    rows = files(spark, bytes(cfb), b"", b"PK\x03\x04", synth.docx('<w:p><w:pPr><w:numPr><w:ilvl w:val="x"/></w:numPr></w:pPr></w:p>'))
    f = office.facts(rows)
    assert {r["doc_id"]: r["error"]["name"] for r in office.errors(f).collect()} == {"d0": "UnsupportedFormat", "d1": "UnknownFormat", "d2": "ZipArchive"}


def test_a_wide_merge_costs_what_it_covers(spark):
    cells = '<sheetData><row r="1"><c r="A1"><v>1</v></c><c r="B1"><v>2</v></c></row><row r="900000"><c r="Z900000"><v>3</v></c></row></sheetData>'
    f = office.stored_facts(files(spark, synth.xlsx({"s": f'{cells}<mergeCells><mergeCell ref="A1:XFD1048576"/></mergeCells>'}), synth.xlsx({"s": cells})))
    got = {(r["doc_id"], r["ref"]): (r["col_span"], r["row_span"]) for r in excel.cells(f).collect()}
    assert got == {("d0", "A1"): (16384, 1048576), ("d1", "A1"): (1, 1), ("d1", "B1"): (1, 1), ("d1", "Z900000"): (1, 1)}


def test_covered_cells_against_every_pair(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    cells = [("d", "s", int(r), int(c)) for r, c in {tuple(x) for x in rng.integers(0, 40, (300, 2))}]
    ranges = [("d", "s", int(r), int(c), int(h), int(w)) for r, c, h, w in np.column_stack([rng.integers(0, 40, (25, 2)), rng.integers(1, 12, (25, 2))])]
    got = excel.covered(spark.createDataFrame(cells, "doc_id string, sheet string, row int, col int"), spark.createDataFrame(ranges, "doc_id string, sheet string, row int, col int, row_span int, col_span int"))
    want = {(r, c) for _, _, r, c in cells if any(a <= r < a + h and b <= c < b + w and (r, c) != (a, b) for _, _, a, b, h, w in ranges)}
    assert {(r["row"], r["col"]) for r in got.collect()} == want and got.count() == len(want)


def test_style_properties_end_in_circles(spark):
    x = f'<w:styles {synth.W}><w:style w:styleId="A"><w:basedOn w:val="B"/><w:rPr><w:b w:val="0"/></w:rPr></w:style><w:style w:styleId="B"><w:basedOn w:val="A"/><w:rPr><w:b/><w:sz w:val="30"/></w:rPr></w:style></w:styles>'
    got = {r["style_id"]: (r["bold"], r["size"]) for r in word.style_properties(office.stored_facts(files(spark, synth.docx("", **{"word__styles.xml": x})))).collect()}
    assert got == {"A": (False, 30), "B": (True, 30)}


def test_predicates_and_constructors(spark):
    p = M.paragraph(M.run("a", b=True), M.run("b", rid="http://x"), M.run(""), heading=2)
    r = spark.range(1).select(p.alias("p")).select(
        F.transform("p.runs", M.has_formatting).alias("f"), F.transform("p.runs", M.is_link).alias("l"), M.is_heading(F.col("p.heading")).alias("h"),
        M.is_empty(F.col("p.runs"), F.col("p.images")).alias("e"), M.heading_name(F.col("p.heading")).alias("n"), M.heading_number(F.lit("H4")).alias("k"), M.heading_number(F.lit("None")).alias("z"), M.plain_text(F.col("p.runs")).alias("t"),
        M.is_empty(F.array().cast(M.RUNS), F.array().cast(M.IMAGES)).alias("blank"),
    ).first()
    assert (r["f"], r["l"], r["h"], r["e"], r["n"], r["k"], r["z"], r["t"], r["blank"]) == ([True, False, False], [False, True, False], True, False, "H2", 4, 0, "ab", True)


def test_sections_go_by_a_resource_map(spark):
    shot = '<w:p><w:r><w:drawing><wp:docPr descr="d"/><a:blip r:embed="rId1"/></w:drawing></w:r></w:p>'
    f = office.stored_facts(files(spark, synth.docx(shot, **{"word___rels/document.xml.rels": synth.rels([("rId1", "image", "media/p.png")]), "word__media/p.png": b"x"})))
    where = spark.createDataFrame([("d0", "p.png", "store/1 2.png")], "doc_id string, resource_id string, filename string")
    assert render.section_markdown(f, resource_map=where).first()["markdown"].strip() == "![d](<store/1 2.png>)"
    assert render.section_markdown(f).first()["markdown"].strip() == "![d](p.png)"
    assert '"resources":{"rId1":{"type":"image","filename":"p.png","mime_type":"image/png","size":1}}' in render.to_json(f).first()["json"]


def test_data_source(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xlsx").write_bytes(synth.xlsx({"One": '<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row></sheetData>', "Two": '<sheetData><row r="1"><c r="A1"><v>7</v></c></row></sheetData>'}, ["hello"], [0]))
    (tmp_path / "in/b.docx").write_bytes(synth.docx_of(["hi"]))
    (tmp_path / "in/c.bin").write_bytes(b"nothing")
    whole = spark.read.format("office").load(str(tmp_path / "in"))
    split = spark.read.format("office").option("part_bytes", 10).load(str(tmp_path / "in"))
    key = lambda df: sorted(str((r["doc_id"], r["kind"], r["part"], r["ord"], sorted(r["attrs"].items()))) for r in df.collect())
    assert key(whole) == key(split) and split.rdd.getNumPartitions() == 5
    assert {r["kind"] for r in spark.read.format("office").option("tables", "part,rel").load(str(tmp_path / "in/*.docx")).collect()} == {"part", "rel"}
    md = render.to_markdown(whole)
    out = str(tmp_path / "out")
    rows = md.select(F.concat(F.regexp_extract("doc_id", "[^/]*$", 0), F.lit("/x.md")).alias("path"), F.col("markdown").alias("data"))
    rows.write.format("office").mode("append").save(out)
    assert (tmp_path / "out/b.docx/x.md").read_text() == "hi" and "hello" in (tmp_path / "out/a.xlsx/x.md").read_text()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.xlsx", "b.docx"]  # nothing staged is left
    for bad in ("../x", "/x", ""):
        with pytest.raises(Exception, match="outside"):
            spark.createDataFrame([(bad, "d")], "path string, data string").write.format("office").mode("append").save(out)
    # a task that was still at work when the job failed may leave its staging folder, which readers pass over
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("_")) == ["a.xlsx", "b.docx"]


def test_a_repeated_task_leaves_one_file(tmp_path):
    w = datasource.OfficeWriter(str(tmp_path / "t"), False)
    row = {"path": "f/a.txt", "data": "new"}
    w.write(iter([row]))  # an attempt that was lost: its message never arrives
    w.commit([w.write(iter([row]))])
    assert [str(p.relative_to(tmp_path / "t")) for p in (tmp_path / "t").rglob("*") if p.is_file()] == ["f/a.txt"]
    again = datasource.OfficeWriter(str(tmp_path / "t"), False)
    again.abort([again.write(iter([{"path": "f/b.txt", "data": "x"}]))])
    assert [p.name for p in (tmp_path / "t").rglob("*") if p.is_file()] == ["a.txt"]


def test_table_functions_are_plans(spark):
    sql.register_facts(spark, office.stored_facts(files(spark, synth.docx_of(["one", "two"]))), RenderOptions())
    df = spark.sql("SELECT d.doc_id, b.text FROM office_documents d, LATERAL blocks_of(d.doc_id) b")
    assert sorted(r["text"] for r in df.collect()) == ["one", "two"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "UDTF" not in plan


def test_clean_text_of_sql_is_the_engines(spark):
    from foliant.functions import text as T

    sql.register(spark)
    df = spark.createDataFrame([("---\ntitle: a\nPage 1\n---\n\nBody\nPage 1\ncafé",), ("no front\nPage 2\nx",), (None,)], "t string")
    df.createOrReplaceTempView("texts_")
    for name, how in (("clean_text", "default"), ("clean_text_minimal", "minimal"), ("clean_text_aggressive", "aggressive")):
        assert [r[0] for r in spark.sql(f"SELECT {name}(t) FROM texts_").collect()] == [r["cleaned"] for r in T.clean(df, "t", how).collect()]


@pytest.mark.parametrize("name", list(roundtrips.QUERIES))
def test_against_sql(spark, sf, against_sql, name):
    against_sql(roundtrips.QUERIES[name](spark, sf), roundtrips.ORACLES[name])


def test_grid_of_nothing(spark):
    assert tables.grid(spark.createDataFrame([], "doc_id string, table_id string, row int, col int, text string, col_span int, row_span int")).count() == 0
