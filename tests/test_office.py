import struct

import pytest
from pyspark.sql import functions as F

from foliant.functions import model as M
from foliant.operators import excel, headings, queries, slides, word
from foliant.options import HeadingConfig, RenderOptions
from foliant.plans import render
from foliant.sources import office, synth
from foliant.sources.package import OfficeError, Package, parse_xml


def facts(spark, content, doc="d"):
    return office.stored_facts(spark.createDataFrame([(doc, bytearray(content))], "doc_id string, content binary"))


def cfb(names):
    entry = lambda n: n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<H", 2 * len(n) + 2) + b"\0" * 62
    directory = b"".join(entry(n) for n in ["Root Entry", *names]).ljust(512, b"\0")
    fat = struct.pack("<2I", 0xFFFFFFFD, 0xFFFFFFFE).ljust(512, b"\xff")
    head = bytes.fromhex("D0CF11E0A1B11AE1").ljust(30, b"\0") + struct.pack("<H", 9) + b"\0" * 16 + struct.pack("<I", 1)
    return head.ljust(76, b"\0") + struct.pack("<I", 0) + b"\xff" * 432 + fat + directory


@pytest.mark.parametrize(
    "content,kind",
    [(b"\0\0\0\0", 3), (cfb(["EncryptedPackage"]), 12), (cfb(["WordDocument"]), 4), (b"PK\x03\x04garbage", 5), (synth.package("docx", {"word/document.xml": b"<a>\xe9</a>"}), 9), (synth.package("xlsx", {}), 8), (synth.package("pptx", {}), 8), (synth.docx("<w:p>"), 6)],
)
def test_error_kinds(spark, content, kind):
    assert office.errors(facts(spark, content)).first()["error"]["kind"] == kind


def test_missing_content_types():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<a/>")
    with pytest.raises(OfficeError) as e:
        Package(out.getvalue())
    assert e.value.kind == 8


@pytest.mark.parametrize("encoding", ["utf-16-le", "utf-16-be", "utf-16"])
def test_utf16(encoding):
    assert parse_xml('<?xml version="1.0" encoding="UTF-16"?><a>é 한</a>'.encode(encoding)).text == "é 한"


def test_loose_xml():
    assert parse_xml(b"<a>A & B &bogus; &amp;&#xD800;\r\nx</a>").text == "A & B &bogus; &\nx"
    with pytest.raises(OfficeError):
        parse_xml(b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>')


def test_word(spark):
    para = lambda t, pr="", rpr="": f"<w:p><w:pPr>{pr}</w:pPr><w:r><w:rPr>{rpr}</w:rPr><w:t>{t}</w:t></w:r></w:p>"
    body = (
        para("Top", '<w:pStyle w:val="H"/>')
        + "".join(para(t, f'<w:numPr><w:ilvl w:val="{k}"/><w:numId w:val="1"/></w:numPr>') for t, k in (("a", 0), ("b", 1), ("c", 1), ("d", 0), ("e", 1)))
        + '<w:p><w:hyperlink r:id="rId1"><w:r><w:t>site</w:t></w:r></w:hyperlink><w:r><w:footnoteReference w:id="2"/></w:r><w:r><w:footnoteReference w:id="9"/></w:r></w:p>'
        + para("strong", rpr="<w:b/>")
    )
    styles = f'<w:styles {synth.W}><w:style w:styleId="H" w:type="paragraph"><w:name w:val="Mine"/><w:basedOn w:val="B"/></w:style><w:style w:styleId="B"><w:name w:val="Base"/><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style></w:styles>'
    numbering = f'<w:numbering {synth.W}><w:abstractNum w:abstractNumId="5">' + "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="decimal"/></w:lvl>' for k in (0, 1)) + '</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="5"/></w:num></w:numbering>'
    notes = f'<w:footnotes {synth.W}><w:footnote w:id="2"><w:p><w:r><w:t>seen</w:t></w:r></w:p></w:footnote></w:footnotes>'
    content = synth.package("docx", {"word/document.xml": f"<w:document {synth.W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles, "word/numbering.xml": numbering, "word/footnotes.xml": notes, "word/_rels/document.xml.rels": synth.rels([("rId1", "hyperlink", "http://x.example/a b")])})
    f = facts(spark, content)
    rows = word.paragraphs(f).orderBy("ord").collect()
    assert rows[0]["heading"] == 2 and rows[0]["style_name"] == "Mine"
    assert [r["list_number"] for r in rows[1:6]] == [1, 1, 2, 2, 1]
    assert [r["t"] for r in rows[6]["runs"]] == ["site", "[^2]"]
    md = render.to_markdown(f).first()["markdown"]
    assert md.startswith("## Top\n\n1. a\n  1. b\n  2. c\n2. d\n  1. e\n\n") and "[site](<http://x.example/a b>)" in md and "**strong**" in md and md.endswith("[^2]: seen")
    assert render.to_text(f).first()["text"].startswith("Top\na\nb")
    assert '"bold":true' in render.to_json(f).first()["json"]
    assert "\n" in render.to_json(f, pretty=True).first()["json"]


def test_word_table(spark):
    cell = lambda t, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    f = facts(spark, synth.docx(f'<w:tbl><w:tr>{cell("A", "<w:vMerge w:val=%srestart%s/>" % (chr(34), chr(34)))}{cell("B")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("C")}</w:tr></w:tbl>'))
    rows = {r["texts"][0]: r for r in word.cell_texts(f).collect() if r["texts"]}
    assert rows["A"]["row_span"] == 2 and rows["C"]["col"] == 1
    assert render.to_markdown(f).first()["markdown"] == "| A | B |\n| --- | --- |\n|  | C |"
    assert 'rowspan="2"' in render.to_markdown(f, RenderOptions(table="html")).first()["markdown"]


def test_excel(spark):
    data = '<sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Quarter</t></is></c><c r="B1"/><c r="C1" t="s"><v>0</v></c></row><row r="2"><c r="A2" s="1"><v>44197</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" t="e"><v>#REF!</v></c><c r="D2" t="s"><v>7</v></c></row><row r="3"><c r="E3"/></row></sheetData><mergeCells><mergeCell ref="B1:A1"/></mergeCells>'
    f = facts(spark, synth.xlsx({"One": data}, ["shared"], [0, 14]))
    got = {r["ref"]: r for r in excel.table_cells(f).collect()}
    assert got["A1"]["col_span"] == 2 and "B1" not in got and got["C1"]["value"] == "shared"
    assert got["A2"]["value"] == "2021-01-01" and got["B2"]["value"] == "TRUE" and got["C2"]["value"] == "#ERROR:#REF!"
    assert "D2" not in got and "E3" not in got  # beyond the last column with content
    assert {r["ref"]: r for r in excel.cells(f).collect()}["D2"]["error"]["kind"] == 7
    assert render.to_markdown(f).first()["markdown"].startswith("## One\n\n| Quarter |  | shared |")


@pytest.mark.parametrize("ref,col", [("A1", 0), ("Z1", 25), ("AA1", 26), ("AZ1", 51), ("BA1", 52)])
def test_cell_refs(spark, ref, col):
    assert spark.range(1).select(M.column_of(F.lit(ref))).first()[0] == col


def test_serials(spark):
    given = [(1.0, "1900-01-01"), (59.0, "1900-02-28"), (61.0, "1900-03-01"), (60.0, "1900-03-01"), (44197.0, "2021-01-01"), (0.5, None), (44197.25, "2021-01-01T06:00:00")]
    rows = spark.createDataFrame(given, "s double, e string").select(M.serial_date(F.col("s")), "e").collect()
    assert all(a == b for a, b in rows)
    codes = spark.createDataFrame([(14, None, True), (0, None, False), (22, None, True), (200, "yyyy-mm-dd", True), (201, "#,##0", False), (202, '"day" 0', False)], "i int, c string, e boolean")
    assert all(a == b for a, b in codes.select(M.is_date_format(F.col("i"), F.col("c")), "e").collect())


def test_slides_and_charts(spark):
    chart = '<c:chartSpace><c:chart><c:title><a:t>T</a:t></c:title><c:ser><c:tx><c:v>S</c:v></c:tx><c:cat><c:pt idx="0"><c:v>x</c:v></c:pt><c:pt idx="1"><c:v>y</c:v></c:pt></c:cat><c:val><c:pt idx="1"><c:v>100</c:v></c:pt></c:val></c:ser></c:chart></c:chartSpace>'
    extra = {"ppt/slides/_rels/slide1.xml.rels": synth.rels([("rId1", "slideLayout", "../slideLayouts/l.xml"), ("rId2", "chart", "../charts/c.xml")]), "ppt/slideLayouts/l.xml": f"<p:sldLayout {synth.P}><p:cSld><p:spTree>{synth.shape(['from layout'], 'body')}</p:spTree></p:cSld></p:sldLayout>", "ppt/charts/c.xml": chart}
    f = facts(spark, synth.pptx([synth.shape(["Head"], "title") + synth.shape([], "body") + synth.shape(["no"], "sldNum")], extra))
    assert [(r["runs"][0]["t"], r["heading"]) for r in slides.paragraphs(f).orderBy("ord").collect()] == [("Head", 1), ("from layout", 0)]
    t = slides.chart_tables(f).first()
    assert t["header"] == ["T", "S"] and t["rows"] == [["x", ""], ["y", "100"]]
    assert "# Head" in render.to_markdown(f).first()["markdown"]


def test_headings(spark):
    run = lambda t, b, size: [{"t": t, "b": b, "size": size}]
    rows = [("d", i, t, h, None, None, run(t, b, s)) for i, (t, h, b, s) in enumerate([("Big", 0, True, "32"), ("plain text here", 0, False, "24"), ("more", 0, False, "24"), ("1. a", 2, False, "24"), ("2. b", 2, False, "24"), ("3. c", 2, False, "24"), ("end", 0, False, "24")])]
    p = spark.createDataFrame(rows, "doc_id string, ord long, text string, heading int, style_id string, style_name string, runs array<struct<t:string,b:boolean,size:string>>")
    got = [(r["decision"]["kind"], r["decision"]["level"]) for r in headings.analyze(p, HeadingConfig(trust_explicit=False)).orderBy("ord").collect()]
    assert got == [("Inferred", 3), ("None", 0), ("None", 0), ("Demoted", 0), ("Demoted", 0), ("Demoted", 0), ("None", 0)]


@pytest.mark.parametrize("text,m,after", [("1. x", "1", "2"), ("9) x", "9", "10"), ("(3) x", "3", "4"), ("가. x", "가", "나"), ("a. x", "a", "b"), ("각. x", None, None)])
def test_markers(spark, text, m, after):
    found = headings.marker(F.lit(text))
    assert tuple(spark.range(1).select(found, headings.next_marker(found)).first()) == (m, after)


def test_escape_and_links(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(render.escape(F.lit("a | b"), True)) == "a \\| b" and one(render.escape(F.lit("a | b"))) == "a | b"
    assert one(render.escape(F.lit("left_over"))) == "left_over" and one(render.escape(F.lit("north*east*wind"))) == "north\\*east\\*wind"
    assert one(render.link_target(F.lit("old maps/w.docx"))) == "<old maps/w.docx>"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_against_sql(spark, sf, against_sql, name):
    against_sql(queries.QUERIES[name](spark, sf), queries.ORACLES[name])


def test_table_spans_of_all_orders(spark, sf):
    """Every order's merged cells, against runs counted in Python."""
    orders = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey").collect():
        orders.setdefault(r[0], []).append((r[1], r[2] % 2))
    expected = []
    for key, lines in orders.items():
        heads = [i for i, (_, k) in enumerate(sorted(lines)) if k or not i]
        expected += [(key, i + 1, j - i) for i, j in zip(heads, [*heads[1:], len(lines)])]
    got = [(r["l_orderkey"], r["nth"], r["row_span"]) for r in queries.QUERIES["table_spans_all"](spark, sf).collect()]
    assert len({x[0] for x in got}) == len(orders) and sorted(got) == sorted(expected)


def test_events_sinks_and_functions(spark, tmp_path):
    from foliant.functions import sql
    from foliant.operators import sinks
    from foliant.streaming import ingest

    good = synth.package("docx", {"word/document.xml": f"<w:document {synth.W}><w:body><w:p><w:r><w:t>hi</w:t></w:r></w:p></w:body></w:document>", "word/media/a.png": b"png", "word/_rels/document.xml.rels": synth.rels([("rId1", "image", "media/a.png")])})
    files = spark.createDataFrame([("g", bytearray(good)), ("b", bytearray(b"nothing"))], "doc_id string, content binary")
    f = office.facts(files)
    got = [(r["doc_id"], r["event_type"]) for r in ingest.iterate(ingest.events(f, files))]
    assert [x for x in got if x[0] == "g"] == [("g", "DocumentStart"), ("g", "SectionParsed"), ("g", "DocumentEnd"), ("g", "ResourceExtracted")]
    seen = []
    assert ingest.each_event(files, lambda r: seen.append(r) or False, at_once=1) == 1
    assert len(seen) == 1 and seen[0]["doc_id"] == "b"
    with pytest.raises(Exception, match="UnknownFormat"):
        ingest.events(f, lenient=False).collect()
    assert office.resources(files).where("error is null").first()["mime_type"] == "image/png"
    sinks.convert(files.where("doc_id = 'g'"), str(tmp_path / "out"), ["md", "text", "json"])
    assert spark.read.parquet(str(tmp_path / "out/md")).first()["markdown"].endswith("hi")
    sinks.extract(files.where("doc_id = 'g'"), str(tmp_path / "media"))
    assert (tmp_path / "media/images/a.png").read_bytes() == b"png"
    sql.register(spark)
    files.createOrReplaceTempView("files_")
    assert {r[0] for r in spark.sql("SELECT detect_format(content) FROM files_").collect()} == {"docx", "UnknownFormat"}
    assert spark.sql("SELECT * FROM files_, LATERAL doc_facts(content) WHERE kind = 'para'").count() == 1


def test_extract_keeps_equal_names_of_several_documents(spark, tmp_path):
    from foliant.operators import sinks

    word = {"word/document.xml": f"<w:document {synth.W}><w:body/></w:document>", "word/_rels/document.xml.rels": synth.rels([("rId1", "image", "media/image1.png")])}
    pack = lambda x, **more: bytearray(synth.package("docx", word | {"word/media/image1.png": x} | more))
    docs = [("a/../b", pack(b"one")), ("..", pack(b"two"))]
    sinks.extract(spark.createDataFrame(docs, "doc_id string, content binary"), str(tmp_path / "m"))
    found = {str(p.relative_to(tmp_path / "m")): p.read_bytes() for p in (tmp_path / "m").rglob("*.png")}
    assert found == {"doc-a%2F..%2Fb/images/image1.png": b"one", "doc-../images/image1.png": b"two"}
    names = spark.createDataFrame([(x,) for x in (None, "", "x" * 300, "x" * 301, "None")], "d string").select(sinks.document_folder(F.col("d")))
    assert names.distinct().count() == 5


def test_stream(spark, tmp_path):
    from foliant.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(synth.docx_of(["hello", "there"]))
    ingest.stream_markdown(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["markdown"] == "hello\n\nthere"


def test_tables_in_cells(spark):
    p = lambda t, pr="", rpr="": f"<w:p><w:pPr>{pr}</w:pPr><w:r><w:rPr>{rpr}</w:rPr><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda x: f"<w:tc>{x}</w:tc>"
    inner = f"<w:tbl><w:tr>{cell(p('inner'))}</w:tr></w:tbl>"
    rows = f"<w:tr>{cell(p('Name', rpr='<w:b/>'))}{cell(p('Sum'))}</w:tr><w:tr>{cell(p('a', rpr='<w:i/>') + inner)}{cell(p('7|8', pr='<w:jc w:val=&quot;right&quot;/>'.replace('&quot;', chr(34))))}</w:tr>"
    f = facts(spark, synth.docx(f"<w:tbl>{rows}</w:tbl>"))
    md = render.to_markdown(f).first()["markdown"]
    assert md == "| Name | Sum |\n| --- | ---: |\n| *a* | 7\\|8 |\n\n| inner |\n| --- |"
    assert "inner" in render.to_text(f).first()["text"] and "inner" in render.plain(f).first()["text"]
    assert '"nested_tables":[{"rows":[{"cells":[{"content":"inner"' in render.to_json(f).first()["json"] and '"name":null' not in render.to_json(f).first()["json"]
    quote = facts(spark, synth.docx(f"<w:tbl><w:tr>{cell(p('Mind', rpr='<w:b/>') + p('the gap', rpr='<w:b/>'))}</w:tr></w:tbl>"))
    assert render.to_markdown(quote, RenderOptions(callouts=True)).first()["markdown"] == "> **Mind**\n> **the gap**"


def test_escapes(spark):
    cases = {"a*b": "a\\*b", "2 * 3": "2 * 3", "some_name_here": "some_name_here", "x_!": "x\\_!", "(*)": "(*)", "b\\c": "b\\\\c", "`q`": "\\`q\\`"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [tuple(r) for r in df.select(render.escape(F.col("t")).alias("got"), "want").where("got <> want").collect()] == []


def test_damage_is_a_row(spark):
    import io
    import zipfile

    whole = bytearray(synth.docx("<w:p><w:r><w:t>" + "text " * 400 + "</w:t></w:r></w:p>"))
    with zipfile.ZipFile(io.BytesIO(bytes(whole))) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, d in parts.items():
            z.writestr(n, d)
    broken = bytearray(out.getvalue())
    at = broken.index(b"word/document.xml") + len("word/document.xml")
    broken[at : at + 40] = b"\xff" * 40
    deep = synth.docx("<w:tbl><w:tr><w:tc>" * 3000 + "</w:tc></w:tr></w:tbl>" * 3000)
    rows = spark.createDataFrame([("broken", broken), ("deep", bytearray(deep)), ("whole", whole)], "doc_id string, content binary")
    found = {r["doc_id"]: r["error"] for r in office.documents(office.facts(rows)).collect()}
    assert found["broken"] is not None and found["deep"] is not None and found["whole"] is None


def test_facts_are_stored_once(spark):
    f = office.stored_facts(spark.createDataFrame([("d", bytearray(synth.docx("<w:p><w:r><w:t>hi</w:t></w:r></w:p>")))], "doc_id string, content binary"))
    out = render.to_markdown(f)
    assert "MapInArrow" not in out._jdf.queryExecution().toString() and out.first()["markdown"] == "hi"


def test_sql_functions(spark):
    from foliant.functions import sql

    sql.register(spark)
    spark.createDataFrame([(bytearray(synth.docx("<w:p><w:r><w:t>one</w:t></w:r></w:p>")),), (bytearray(b"nothing"),)], "content binary").createOrReplaceTempView("packages")
    rows = spark.sql("SELECT b.* FROM packages, LATERAL doc_blocks(content) b").collect()
    assert sorted((r["text"] or "", r["error"] or "") for r in rows) == [("", "UnknownFormat"), ("one", "")]
    assert spark.sql("SELECT count(*) AS n FROM packages, LATERAL doc_parts(content) p WHERE p.error IS NOT NULL").first()["n"] == 1
    book = bytearray(synth.xlsx({"s": '<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>5</v></c></row></sheetData>'}, ["hello"], [0]))
    spark.createDataFrame([(book,)], "content binary").createOrReplaceTempView("books")
    assert {(r["cell_ref"], r["value"]) for r in spark.sql("SELECT c.* FROM books, LATERAL sheet_cells(content) c").collect()} == {("A1", "hello"), ("B1", "5")}
    assert spark.sql("SELECT clean_text('a  b' || chr(10) || chr(10) || chr(10) || 'Page 3' || chr(10) || 'c') AS t").first()["t"] == "a b\n\nc"
