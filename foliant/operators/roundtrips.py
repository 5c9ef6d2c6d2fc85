"""More queries of the office operators: packages made from the driver's tables, one a row or a group of bounded size,
parsed and read again, and the SQL of what must come out, which knows only the tables."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import model as M
from ..functions import sql as S
from ..options import RenderOptions
from ..plans import render
from ..sources import office, synth
from ..streaming import ingest
from . import cleanup, excel, slides, tables, word


def table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


LINE = ["l_linenumber", "l_partkey", "l_suppkey"]


def orders_lines(s, d, *columns: str) -> DataFrame:
    """l_orderkey and its lines, in order."""
    li = table(s, d, "lineitem").select("l_orderkey", F.struct(*LINE, *columns).alias("x"))
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("t"))


def orders_files(s, d, build, *columns: str) -> DataFrame:
    """A package an order: build(l_orderkey, and t: its lines in order)."""
    return synth.grouped(table(s, d, "lineitem").select("l_orderkey", *LINE, *columns), build, "l_orderkey", [*LINE, *columns])


def key(name: str = "l_orderkey"):
    return F.col("doc_id").cast("long").alias(name)


def para(text: str, run: str = "", props: str = "") -> str:
    return f'<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def word_package(body: str, more: dict, main: str = "word/document.xml") -> bytes:
    parts = {main: f"<w:document {synth.W}><w:body>{body}</w:body></w:document>"} | more
    if main != "word/document.xml":
        parts["_rels/.rels"] = synth.rels([("r1", "officeDocument", main)])
    return synth.package("docx", parts)


# --------------------------------------------------------------------------- Word
def style_properties(s, d) -> DataFrame:
    """Six styles a document that are based on each other, in circles too."""

    def build(r):
        i, out = r["doc_id"], []
        for k in range(6):
            based = "" if k == 0 and i % 2 == 0 else f'<w:basedOn w:val="S{(k * 7 + i) % 6}"/>'
            outline = f'<w:pPr><w:outlineLvl w:val="{k}"/></w:pPr>' if (i + k) % 4 == 1 else ""
            run = f'<w:b w:val="{(i + k) % 2}"/>' if (i + k) % 3 == 0 else ""
            run += f'<w:sz w:val="{20 + k}"/>' if (i * k) % 5 == 2 else ""
            run += f'<w:color w:val="00000{k}"/>' if (i + k) % 7 == 3 else ""
            out.append(f'<w:style w:type="paragraph" w:styleId="S{k}"><w:name w:val="n{k}"/>{based}{outline}<w:rPr>{run}</w:rPr></w:style>')
        return word_package("", {"word/styles.xml": f"<w:styles {synth.W}>{''.join(out)}</w:styles>"})

    p = word.style_properties(office.stored_facts(synth.files(table(s, d, "documents").select("doc_id"), build, "doc_id")))
    return p.select(key("doc_id"), "style_id", "style_name", "outline", "bold", "size", "color")


def formatted_runs(s, d) -> DataFrame:
    """A paragraph a line, formatted and linked by its flags: Markdown, and what the predicates count."""

    def build(r):
        def one(x):
            run = "<w:b/>" * (x["l_returnflag"] == "R") + "<w:i/>" * (x["l_linestatus"] == "O")
            p = f'<w:r><w:rPr>{run}</w:rPr><w:t>i{x["l_linenumber"]}</w:t></w:r>'
            return f'<w:p><w:hyperlink r:id="rId1">{p}</w:hyperlink></w:p>' if x["l_linenumber"] % 3 == 0 else f"<w:p>{p}</w:p>"

        return word_package("".join(map(one, r["t"])), {"word/_rels/document.xml.rels": synth.rels([("rId1", "hyperlink", "http://h.example/")])})

    f = office.stored_facts(orders_files(s, d, build, "l_returnflag", "l_linestatus"), kinds=render.MARKDOWN)
    p = word.paragraphs(f).groupBy("doc_id").agg(F.sum(F.size(F.filter("runs", M.has_formatting))).cast("long").alias("n_formatted"), F.sum(F.size(F.filter("runs", M.is_link))).cast("long").alias("n_links"), F.count_if(M.is_heading(F.col("heading"))).alias("n_headings"), F.count_if(M.is_empty(F.col("runs"), F.col("images"))).alias("n_empty"))
    return render.to_markdown(f).join(p, "doc_id").select(key(), "markdown", "n_formatted", "n_links", "n_headings", "n_empty")


def notes_and_regions(s, d) -> DataFrame:
    """A supplier's document with a header of two paragraphs, a footer and a footnote; its notes' and regions' parts."""

    def build(r):
        k = r["s_suppkey"]
        refs = '<w:sectPr><w:headerReference r:id="rId1"/><w:footerReference r:id="rId2"/><w:headerReference r:id="rId1"/></w:sectPr>'
        body = f'<w:p><w:r><w:t>body {k}</w:t></w:r><w:r><w:footnoteReference w:id="2"/></w:r><w:r><w:footnoteReference w:id="7"/></w:r></w:p>{refs}'
        wrap = lambda tag, x: f"<w:{tag} {synth.W}>{x}</w:{tag}>"
        notes = f'<w:footnote w:id="0" w:type="separator">{para("no")}</w:footnote><w:footnote w:id="2">{para(f"seen {k}")}</w:footnote>'
        more = {"word/_rels/document.xml.rels": synth.rels([("rId1", "header", "h.xml"), ("rId2", "footer", "f.xml"), ("rId3", "footnotes", "notes/n.xml")]), "word/h.xml": wrap("hdr", para(f"top {k}") + para("second")), "word/f.xml": wrap("ftr", para(f"end {k}")), "word/notes/n.xml": wrap("footnotes", notes)}
        return word_package(body, more)

    f = office.stored_facts(synth.files(table(s, d, "supplier").select("s_suppkey"), build, "s_suppkey"))
    return render.to_markdown(f, RenderOptions(headers_footers=True)).select(key("s_suppkey"), "markdown")


def shaped_tables(s, d) -> DataFrame:
    def build(r):
        def row(i, x):
            cell = lambda n, t: f'<w:tc><w:tcPr><w:gridSpan w:val="{n}"/></w:tcPr>{para(t)}</w:tc>'
            blank = x["l_partkey"] % 5 == 0
            head = "<w:trPr><w:tblHeader/></w:trPr>" if i < 2 and r["l_orderkey"] % 2 else ""
            return f"<w:tr>{head}{cell(1 + x['l_partkey'] % 3, '' if blank else f'a{i}')}{cell(1 + x['l_suppkey'] % 2, '' if blank else 'b')}</w:tr>"

        return synth.docx(f"<w:tbl>{''.join(row(i, x) for i, x in enumerate(r['t']))}</w:tbl>")

    return office.stored_facts(orders_files(s, d, build), kinds=render.MARKDOWN)


def table_shapes(s, d) -> DataFrame:
    return tables.tables(render.grid_cells(shaped_tables(s, d))).select(key(), "row_count", "column_count", "has_merged_cells", "header_rows", "data_rows", "empty_rows")


def html_tables(s, d) -> DataFrame:
    return render.to_markdown(shaped_tables(s, d), RenderOptions(table="html")).select(key(), "markdown")


def grid_rows(s, d) -> DataFrame:
    """Cells of an order's lines; where the part number is even, a line goes on below for as many rows as its supplier's
    number says, and the lines it covers have one cell less."""
    li = orders_lines(s, d).select("l_orderkey", F.posexplode("t").alias("i", "x"))
    left = li.where("x.l_partkey % 2 = 0").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit("t").alias("table_id"), F.col("i").alias("row"), F.lit(0).alias("col"), F.concat(F.lit("a"), F.col("i")).alias("text"), F.lit(2).alias("col_span"), (F.col("x.l_suppkey") % 4 + 1).cast("int").alias("row_span"))
    right = li.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit("t").alias("table_id"), F.col("i").alias("row"), F.lit(2).alias("col"), F.lit("z").alias("text"), F.lit(1).alias("col_span"), F.lit(1).alias("row_span"))
    g = tables.grid(left.unionByName(right))
    return g.select(key(), F.col("row").cast("long").alias("row"), "carried", F.col("width").cast("long").alias("width"), F.array_join(F.transform("slots", lambda x: F.coalesce(x, F.lit("-"))), "|").alias("slots"))


# --------------------------------------------------------------------------- packages
def carrying(s, d) -> DataFrame:
    """Documents with pictures by relationship, one elsewhere, one that nothing leads to; every fifth lies elsewhere."""

    def build(r):
        i = r["doc_id"]
        home = "docs" if i % 5 == 0 else "word"
        named = [(f"rId{j}", "image", f"media/p{j}.{('png', 'jpeg', 'emf', 'bin')[j % 4]}") for j in range(i % 4)]
        more = {f"{home}/{t}": b"x" * (i % 7 + j) for j, (_, _, t) in enumerate(named)}
        more |= {f"{home}/_rels/main.xml.rels": synth.rels([*named, ("rIdX", "image", "http://h.example/x.png")])}
        more |= {f"{home}/media/lost.png": b"lost"} if i % 2 else {}
        return word_package(para("hi"), more, f"{home}/main.xml")

    return office.stored_facts(synth.files(table(s, d, "documents").select("doc_id"), build, "doc_id"))


def document_resources(s, d) -> DataFrame:
    r = office.resource_list(carrying(s, d))
    named = M.suggested_name(F.lit(None).cast("string"), F.col("resource_id"), F.col("mime_type"), F.col("type"))
    return r.select(key("doc_id"), "resource_id", "part", "filename", "type", "mime_type", "size", named.alias("suggested"))


def package_parts(s, d) -> DataFrame:
    f = carrying(s, d)
    main = f.where("kind = 'format'").select("doc_id", F.col("part").alias("main"))
    p = office.reachable(f).groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.count_if(F.col("hops").isNull()).alias("n_unreachable"), F.max("hops").cast("long").alias("hops"))
    return main.join(p, "doc_id").select(key("doc_id"), "main", "n_parts", "n_unreachable", "hops")


def json_resources(s, d) -> DataFrame:
    j = render.to_json(carrying(s, d))
    get = lambda path: F.get_json_object("json", path)
    return j.select(key("doc_id"), get("$.format").alias("format"), get("$.sections[0].content[0].runs[0].text").alias("first"), get("$.resources.rId1.filename").alias("one"), get("$.resources.rId1.size").alias("size"), get("$.resources.rId1.type").alias("type"))


def media_names(s, d) -> DataFrame:
    ends = ["png", "JPG", "jpeg", "gif", "bmp", "tif", "svg", "wmf", "emf", "mp3", "wav", "ogg", "m4a", "mp4", "avi", "mov", "webm", "xyz", "longext"]
    p = table(s, d, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"))
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit("."), F.element_at(F.lit(ends), (F.col("p_partkey") % len(ends) + 1).cast("int")))
    p = p.withColumn("name", name).withColumns({"mime": M.mime_of(F.col("name")), "type": M.resource_type_of(F.col("name"))})
    given = F.when(F.col("p_partkey") % 6 != 0, F.col("name"))
    return p.select("p_partkey", "mime", "type", M.mime_in(F.col("name"), F.lit("docx")).alias("in_word"), M.mime_in(F.col("name"), F.lit("pptx")).alias("in_slides"), M.suggested_name(given, F.lit("id"), F.col("mime"), F.col("type")).alias("suggested"), M.is_image(F.col("type")).alias("is_image"), M.is_media(F.col("type")).alias("is_media"))


# --------------------------------------------------------------------------- Excel
def covered_cells(s, d) -> DataFrame:
    """Lines of an order as rows of a sheet with merged ranges, some of a whole column or of most of the sheet."""

    def build(r):
        rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{x["l_linenumber"]}</v></c><c r="B{i}"><v>{x["l_partkey"]}</v></c><c r="C{i}"><v>{x["l_suppkey"]}</v></c></row>' for i, x in enumerate(r["t"], 1))
        ranges = [f"B{i}:C{i + x['l_suppkey'] % 3}" for i, x in enumerate(r["t"], 1) if x["l_partkey"] % 4 == 0]
        ranges += [["A1:A1048576"], ["E1:XFD1048576"], []][r["l_orderkey"] % 3]
        return synth.xlsx({"s": f"<sheetData>{rows}</sheetData><mergeCells>{''.join(f'<mergeCell ref={chr(34)}{x}{chr(34)}/>' for x in ranges)}</mergeCells>"})

    c = excel.cells(office.stored_facts(orders_files(s, d, build), kinds=excel.CELLS))
    return c.groupBy(key()).agg(F.count("*").alias("n_cells"), F.sum(F.col("value").cast("long")).alias("total"), F.sum("col_span").cast("long").alias("columns"), F.sum("row_span").cast("long").alias("rows"))


def sheet_values(s, d) -> DataFrame:
    """A truth value, an error, a point in time, a linked text and a note, as the cells of a table show them."""

    def build(r):
        k = r["o_orderkey"]
        row = f'<row r="1"><c r="A1" t="b"><v>{k % 2}</v></c><c r="B1" t="e"><v>#N/A</v></c><c r="C1" s="1"><v>{r["d"]}.25</v></c><c r="D1" t="inlineStr"><is><t>o{k}</t></is></c></row>'
        link = '<hyperlinks><hyperlink ref="D1" r:id="rId1"/></hyperlinks>' if k % 3 == 0 else ""
        extra = {"xl/worksheets/_rels/sheet1.xml.rels": synth.rels([("rId1", "hyperlink", "http://h.example/"), ("rId2", "comments", "../comments1.xml")])}
        note = f'<comment ref="A1"><text><t>n{k}</t></text></comment>' if k % 4 == 0 else ""
        extra["xl/comments1.xml"] = f"<comments {synth.S}><commentList>{note}</commentList></comments>"
        return synth.xlsx({"s": f"<sheetData>{row}</sheetData>{link}"}, [], [0, 22], extra)

    days = table(s, d, "orders").groupBy("o_orderkey").agg(F.min(F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date"))).alias("d"))
    c = render.grid_cells(office.stored_facts(synth.files(days, build, "o_orderkey"), kinds=render.MARKDOWN))
    return c.groupBy(key("o_orderkey")).agg(*[F.max(F.when(F.col("col") == i, F.col("text"))).alias(n) for i, n in enumerate(("truth", "error", "moment", "linked"))])


# --------------------------------------------------------------------------- PowerPoint
def decks(s, d, broken: bool = False) -> DataFrame:
    def build(r):
        extra = {f"ppt/media/m{r['conv_id'] % 3}.png": b"x"}
        if broken and r["conv_id"] % 10 == 3:
            extra["ppt/slides/slide2.xml"] = "<p:sld>"
        return synth.pptx([synth.shape([x["role"]], "title") + synth.shape((x["text"] or "").split("\n")) for x in r["t"]], extra)

    return synth.grouped(table(s, d, "conversations").select("conv_id", "turn", "role", "text"), build, "conv_id", ["turn", "role", "text"])


def parse_events(s, d) -> DataFrame:
    files = decks(s, d, True)
    e = ingest.events(office.stored_facts(files), files)
    return e.select(key("conv_id"), F.col("seq").cast("long").alias("seq"), "event_type", F.col("section_idx").cast("long").alias("section_idx"), "name", "section_count", F.array_join(F.map_keys("image_map"), ",").alias("images"), F.col("error.name").alias("error"))


def slide_sections(s, d) -> DataFrame:
    out = render.section_markdown(office.stored_facts(decks(s, d)), RenderOptions(escape=False))
    return out.select(key("conv_id"), F.col("section_idx").cast("long").alias("section_idx"), "name", "markdown")


def chart_tables(s, d) -> DataFrame:
    """A chart an order: the lines are categories, part and supplier numbers two series, some points missing."""

    def build(r):
        pt = lambda i, v: f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>'
        cats = "".join(pt(i, f"l{x['l_linenumber']}") for i, x in enumerate(r["t"]))
        series = "".join(f"<c:ser><c:tx><c:v>{n}</c:v></c:tx><c:cat>{cats}</c:cat><c:val>{''.join(pt(i, x[c]) for i, x in enumerate(r['t']) if x[c] % 4)}</c:val></c:ser>" for n, c in (("part", "l_partkey"), ("supplier", "l_suppkey")))
        extra = {"ppt/slides/_rels/slide1.xml.rels": synth.rels([("rId2", "chart", "../charts/c.xml")]), "ppt/charts/c.xml": f"<c:chartSpace><c:chart><c:title><a:t>o{r['l_orderkey']}</a:t></c:title>{series}</c:chart></c:chartSpace>"}
        return synth.pptx([""], extra)

    t = slides.chart_tables(office.stored_facts(orders_files(s, d, build), kinds=slides.CHARTS))
    return t.select(key(), F.array_join("header", ",").alias("header"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("rows"))


def slide_parts(s, d) -> DataFrame:
    """An empty title that its layout fills, a table, a picture and notes on a slide."""

    def build(r):
        k = r["conv_id"]
        cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
        grid = f"<p:graphicFrame><a:graphic><a:tbl><a:tr>{cell('n')}{cell('v')}</a:tr><a:tr>{cell('conv')}{cell(k)}</a:tr></a:tbl></a:graphic></p:graphicFrame>"
        shot = f'<p:pic><p:nvPicPr><p:cNvPr name="shot {k}"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId3"/></p:blipFill></p:pic>'
        tree = lambda tag, x: f"<p:{tag} {synth.P}><p:cSld><p:spTree>{x}</p:spTree></p:cSld></p:{tag}>"
        extra = {
            "ppt/slides/_rels/slide1.xml.rels": synth.rels([("rId1", "slideLayout", "../slideLayouts/l.xml"), ("rId2", "notesSlide", "../notesSlides/n.xml"), ("rId3", "image", "../media/m.png")]),
            "ppt/slideLayouts/l.xml": tree("sldLayout", synth.shape([f"layout {k}"], "title")),
            "ppt/notesSlides/n.xml": tree("notes", synth.shape([f"note {k}"], "body") + synth.shape(["9"], "sldNum")),
            "ppt/media/m.png": b"x",
        }
        return synth.pptx([synth.shape([], "title") + synth.shape(["line"]) + grid + shot], extra)

    f = office.stored_facts(synth.files(table(s, d, "conversations").select("conv_id").distinct(), build, "conv_id"))
    return render.to_markdown(f).select(key("conv_id"), "markdown")


# --------------------------------------------------------------------------- lists, revisions, metadata, files
def listed_items(s, d) -> DataFrame:
    """Lines as items of a list: numbers from 3 on the first level, points on the second."""

    def build(r):
        level = lambda k, how, start: f'<w:lvl w:ilvl="{k}"><w:start w:val="{start}"/><w:numFmt w:val="{how}"/></w:lvl>'
        numbers = f'<w:numbering {synth.W}><w:abstractNum w:abstractNumId="4">{level(0, "decimal", 3)}{level(1, "bullet", 1)}</w:abstractNum><w:num w:numId="8"><w:abstractNumId w:val="4"/></w:num></w:numbering>'
        body = "".join(para(f"i{i}", "", f'<w:numPr><w:ilvl w:val="{x["l_partkey"] % 2}"/><w:numId w:val="8"/></w:numPr>') for i, x in enumerate(r["t"]))
        return word_package(body, {"word/numbering.xml": numbers})

    return render.to_markdown(office.stored_facts(orders_files(s, d, build), kinds=render.MARKDOWN)).select(key(), "markdown")


def revisions(s, d) -> DataFrame:
    """Lines inserted, deleted or left, as all three ways of showing them have it."""

    def build(r):
        def one(i, x):
            tag = ("", "ins", "del")[x["l_partkey"] % 3]
            run = f"<w:r><w:t>i{i}</w:t></w:r>"
            return f"<w:p><w:r><w:t>p </w:t></w:r>{f'<w:{tag}>{run}</w:{tag}>' if tag else run}</w:p>"

        return synth.docx("".join(one(i, x) for i, x in enumerate(r["t"])))

    f = office.stored_facts(orders_files(s, d, build), kinds=render.MARKDOWN)
    out = None
    for how in ("accept", "reject", "markup"):
        m = render.to_markdown(f, RenderOptions(revisions=how)).withColumnRenamed("markdown", how)
        out = m if out is None else out.join(m, "doc_id")
    return out.select(key(), "accept", "reject", "markup")


def front_matter(s, d) -> DataFrame:
    """Metadata in front of the text, some with quotes and backslashes, keywords as a list."""

    def build(r):
        core = f'<cp:coreProperties><dc:title>t "{r["doc_id"]}" \\</dc:title><dc:creator>{r["lang"]}</dc:creator><cp:keywords>{r["source"]}; "k"</cp:keywords><dcterms:created>2020-01-01</dcterms:created></cp:coreProperties>'
        return word_package(para("hi"), {"docProps/core.xml": core, "docProps/app.xml": f"<Properties><Words>{r['n_chars']}</Words><Application>A</Application></Properties>"})

    f = office.stored_facts(synth.files(table(s, d, "documents").select("doc_id", "lang", "source", "n_chars"), build, "doc_id"))
    return render.to_markdown(f, RenderOptions(frontmatter=True)).select(key("doc_id"), "markdown")


def document_info(s, d) -> DataFrame:
    from . import sinks

    i = sinks.info(office.stored_facts(synth.documents_as_docx(table(s, d, "documents"))))
    return i.select(key("doc_id"), "format", "n_sections", F.col("n_words").cast("long").alias("n_words"), F.col("n_bytes").cast("long").alias("n_bytes"))


def text_files(s, d) -> DataFrame:
    """Markdown of all documents written as files, and the files that are there afterwards."""
    from . import sinks
    from ..work import workspace

    target = workspace(s)
    sinks.convert(synth.documents_as_docx(table(s, d, "documents")), target, ["md"], RenderOptions(escape=False), as_files=True)
    found = sinks.written(s, f"{target}/md")
    return found.select(F.regexp_extract("path", "/doc-([0-9]+)[.]md$", 1).cast("long").alias("doc_id"), F.col("length").alias("n_bytes"), F.md5("content").alias("md5"))


# --------------------------------------------------------------------------- SQL functions
def sql_markdown(s, d) -> DataFrame:
    """doc_to_markdown, a table function of SQL, for documents of all three formats at once."""
    name = lambda df, x: df.select(F.concat(F.lit(x), F.col("doc_id")).alias("doc_id"), "content")

    def book(r):
        rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{x["l_linenumber"]}</v></c><c r="B{i}"><v>{x["l_partkey"]}</v></c></row>' for i, x in enumerate(r["t"], 1))
        return synth.xlsx({"items": f"<sheetData>{rows}</sheetData>"})

    files = name(synth.documents_as_docx(table(s, d, "documents")), "d").unionByName(name(orders_files(s, d, book), "x")).unionByName(name(decks(s, d), "p"))
    S.register_facts(s, office.stored_facts(files, kinds=render.MARKDOWN), RenderOptions(escape=False))
    return s.sql("SELECT f.doc_id, m.markdown FROM office_documents f, LATERAL doc_to_markdown(f.doc_id) m")


def sql_clean(s, d) -> DataFrame:
    S.register(s)
    cleanup.with_triggers(table(s, d, "documents")).createOrReplaceTempView("office_texts")
    return s.sql("SELECT doc_id, clean_text(text) AS text FROM office_texts")


QUERIES = {f.__name__: f for f in (style_properties, formatted_runs, notes_and_regions, table_shapes, html_tables, grid_rows, document_resources, package_parts, json_resources, media_names, covered_cells, sheet_values, parse_events, slide_sections, slide_parts, chart_tables, listed_items, revisions, front_matter, document_info, text_files, sql_markdown, sql_clean)}

T = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem)"
HOME = "CASE WHEN doc_id % 5 = 0 THEN 'docs' ELSE 'word' END"
SECTION = "CASE WHEN n > 0 THEN chr(10) || '---' || chr(10) || chr(10) ELSE '' END || '## Slide ' || (n + 1) || chr(10) || chr(10) || '# ' || role || chr(10) || chr(10) || array_to_string(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> ''), lambda x: x || chr(10) || chr(10)), '')"
TURNS = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS n FROM conversations)"
TRIMMED = r"regexp_replace(regexp_replace({}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
ORACLES = {
    "style_properties": """WITH RECURSIVE s AS (SELECT doc_id, k, CASE WHEN k > 0 OR doc_id % 2 = 1 THEN (k * 7 + doc_id) % 6 END AS based, CASE WHEN (doc_id + k) % 4 = 1 THEN k END AS outline, CASE WHEN (doc_id + k) % 3 = 0 THEN (doc_id + k) % 2 = 1 END AS bold, CASE WHEN (doc_id * k) % 5 = 2 THEN 20 + k END AS size, CASE WHEN (doc_id + k) % 7 = 3 THEN '00000' || k END AS color FROM documents, range(6) r(k)),
        c AS (SELECT doc_id, k AS style, 1 AS hop, k AS up FROM s UNION ALL SELECT c.doc_id, style, hop + 1, s.based FROM c JOIN s ON s.doc_id = c.doc_id AND s.k = c.up WHERE hop < 11 AND s.based IS NOT NULL)
        SELECT c.doc_id, 'S' || style AS style_id, 'n' || style AS style_name, (arg_min(outline, hop) FILTER (WHERE outline IS NOT NULL))::INTEGER AS outline, arg_min(bold, hop) FILTER (WHERE bold IS NOT NULL) AS bold, (arg_min(size, hop) FILTER (WHERE size IS NOT NULL))::INTEGER AS size, arg_min(color, hop) FILTER (WHERE color IS NOT NULL) AS color FROM c JOIN s ON s.doc_id = c.doc_id AND s.k = c.up GROUP BY c.doc_id, style""",
    "formatted_runs": f"""WITH r AS (SELECT l_orderkey, i, l_returnflag = 'R' AS b, l_linestatus = 'O' AS it, l_linenumber % 3 = 0 AS k, 'i' || l_linenumber AS t FROM {T}),
        m AS (SELECT *, CASE WHEN b AND it THEN '***' || t || '***' WHEN b THEN '**' || t || '**' WHEN it THEN '*' || t || '*' ELSE t END AS s FROM r)
        SELECT l_orderkey, string_agg(CASE WHEN k THEN '[' || s || '](http://h.example/)' ELSE s END, chr(10) || chr(10) ORDER BY i) AS markdown, count_if(b OR it)::BIGINT AS n_formatted, count_if(k)::BIGINT AS n_links, 0::BIGINT AS n_headings, 0::BIGINT AS n_empty FROM m GROUP BY l_orderkey""",
    "notes_and_regions": "SELECT s_suppkey::BIGINT AS s_suppkey, '> *Header: top ' || s_suppkey || ' | second*' || chr(10) || chr(10) || 'body ' || s_suppkey || '[^2]' || chr(10) || chr(10) || '[^2]: seen ' || s_suppkey || chr(10) || chr(10) || '> *Footer: end ' || s_suppkey || '*' AS markdown FROM supplier",
    "table_shapes": f"SELECT l_orderkey, count(*) AS row_count, max(2 + l_partkey % 3 + l_suppkey % 2)::BIGINT AS column_count, bool_or(l_partkey % 3 > 0 OR l_suppkey % 2 > 0) AS has_merged_cells, (CASE WHEN l_orderkey % 2 = 1 THEN least(2, count(*)) ELSE 1 END)::BIGINT AS header_rows, (count(*) - CASE WHEN l_orderkey % 2 = 1 THEN least(2, count(*)) ELSE 1 END)::BIGINT AS data_rows, count_if(l_partkey % 5 = 0)::BIGINT AS empty_rows FROM {T} GROUP BY l_orderkey",
    "html_tables": f"""WITH r AS (SELECT l_orderkey, i, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'a' || (i - 1) END AS a, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'b' END AS b, 1 + l_partkey % 3 AS x, 1 + l_suppkey % 2 AS y, i = 1 OR (i = 2 AND l_orderkey % 2 = 1) AS head, max(greatest(l_partkey % 3, l_suppkey % 2)) OVER (PARTITION BY l_orderkey) > 0 AS merged FROM {T}),
        h AS (SELECT *, CASE WHEN head THEN 'th' ELSE 'td' END AS tag FROM r)
        SELECT l_orderkey, CASE WHEN any_value(merged) THEN '<table>' || chr(10) || string_agg('<tr><' || tag || CASE WHEN x > 1 THEN ' colspan="' || x || '"' ELSE '' END || '>' || a || '</' || tag || '><' || tag || CASE WHEN y > 1 THEN ' colspan="' || y || '"' ELSE '' END || '>' || b || '</' || tag || '></tr>', chr(10) ORDER BY i) || chr(10) || '</table>' ELSE string_agg('| ' || a || ' | ' || b || ' |' || CASE WHEN i = 1 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY i) END AS markdown FROM h GROUP BY l_orderkey""",
    "grid_rows": f"""WITH r AS (SELECT l_orderkey, i - 1 AS i, l_partkey % 2 = 0 AS own, l_suppkey % 4 + 1 AS span FROM {T}), w AS (SELECT l_orderkey, i, own, (SELECT coalesce(sum(2), 0) FROM r a WHERE a.l_orderkey = r.l_orderkey AND a.own AND a.i < r.i AND r.i < a.i + a.span)::BIGINT AS carried FROM r)
        SELECT l_orderkey, i AS row, carried, 3::BIGINT AS width, CASE WHEN own THEN 'a' || i ELSE '-' END || '|-|z' AS slots FROM w""",
    "document_resources": f"SELECT doc_id, 'rId' || j AS resource_id, {HOME} || '/media/p' || j || '.' || e AS part, 'p' || j || '.' || e AS filename, CASE e WHEN 'bin' THEN 'other' ELSE 'image' END AS type, CASE e WHEN 'png' THEN 'image/png' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'emf' THEN 'image/x-emf' END AS mime_type, (doc_id % 7 + j)::BIGINT AS size, 'rId' || j || '.' || CASE e WHEN 'jpeg' THEN 'jpg' ELSE e END AS suggested FROM (SELECT doc_id, j, ['png', 'jpeg', 'emf', 'bin'][j % 4 + 1] AS e FROM (SELECT doc_id, unnest(range(0, doc_id % 4)) AS j FROM documents))",
    "package_parts": f"SELECT doc_id, {HOME} || '/main.xml' AS main, 1 + doc_id % 4 + doc_id % 2 AS n_parts, doc_id % 2 AS n_unreachable, CASE WHEN doc_id % 4 > 0 THEN 2 ELSE 1 END::BIGINT AS hops FROM documents",
    "json_resources": "SELECT doc_id, 'docx' AS format, 'hi' AS first, CASE WHEN doc_id % 4 > 1 THEN 'p1.jpeg' END AS one, CASE WHEN doc_id % 4 > 1 THEN (doc_id % 7 + 1)::VARCHAR END AS size, CASE WHEN doc_id % 4 > 1 THEN 'image' END AS type FROM documents",
    "media_names": """WITH n AS (SELECT p_partkey::BIGINT AS k, ['png', 'jpg', 'jpeg', 'gif', 'bmp', 'tif', 'svg', 'wmf', 'emf', 'mp3', 'wav', 'ogg', 'm4a', 'mp4', 'avi', 'mov', 'webm', 'xyz', 'longext'][p_partkey % 19 + 1] AS e, ['image/png', 'image/jpeg', 'image/jpeg', 'image/gif', 'image/bmp', 'image/tiff', 'image/svg+xml', 'image/x-wmf', 'image/x-emf', 'audio/mpeg', 'audio/wav', 'audio/ogg', 'audio/mp4', 'video/mp4', 'video/x-msvideo', 'video/quicktime', 'video/webm'][p_partkey % 19 + 1] AS m FROM part),
        t AS (SELECT *, CASE WHEN k % 19 < 9 THEN 'image' WHEN k % 19 < 13 THEN 'audio' WHEN k % 19 < 17 THEN 'video' ELSE 'other' END AS type FROM n)
        SELECT k AS p_partkey, coalesce(m, 'application/octet-stream') AS mime, type, CASE WHEN type = 'image' THEN m END AS in_word, CASE WHEN type = 'image' OR e IN ('mp3', 'wav', 'mp4', 'avi') THEN m END AS in_slides, CASE WHEN k % 6 <> 0 THEN 'f' || k || '.' || CASE e WHEN 'jpg' THEN 'JPG' ELSE e END ELSE 'id.' || CASE type WHEN 'image' THEN CASE e WHEN 'jpeg' THEN 'jpg' WHEN 'tif' THEN 'tiff' ELSE e END WHEN 'audio' THEN 'mp3' WHEN 'video' THEN 'mp4' ELSE 'bin' END END AS suggested, type = 'image' AS is_image, type IN ('audio', 'video') AS is_media FROM t""",
    "covered_cells": f"""WITH r AS (SELECT l_orderkey AS k, i, l_linenumber, l_partkey, l_suppkey FROM {T}), c AS (SELECT k, i, 1 AS col, l_linenumber AS v FROM r UNION ALL SELECT k, i, 2, l_partkey FROM r UNION ALL SELECT k, i, 3, l_suppkey FROM r),
        m AS (SELECT k, i AS r0, i + l_suppkey % 3 AS r1, 2 AS c0, 3 AS c1 FROM r WHERE l_partkey % 4 = 0 UNION ALL SELECT DISTINCT k, 1, 1048576, 1, 1 FROM r WHERE k % 3 = 0)
        SELECT c.k AS l_orderkey, count(*) AS n_cells, sum(v)::BIGINT AS total, sum(coalesce(o.c1 - o.c0 + 1, 1))::BIGINT AS columns, sum(coalesce(o.r1 - o.r0 + 1, 1))::BIGINT AS rows FROM (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.k = c.k AND c.i BETWEEN r0 AND r1 AND c.col BETWEEN c0 AND c1 AND NOT (c.i = r0 AND c.col = c0))) c LEFT JOIN m o ON o.k = c.k AND o.r0 = c.i AND o.c0 = c.col GROUP BY c.k""",
    "sheet_values": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN 'TRUE' ELSE 'FALSE' END || CASE WHEN o_orderkey % 4 = 0 THEN ' *[Comment: n' || o_orderkey || ']*' ELSE '' END AS truth, '#ERROR:#N/A' AS error, min(o_orderdate::DATE)::VARCHAR || 'T06:00:00' AS moment, CASE WHEN o_orderkey % 3 = 0 THEN '[o' || o_orderkey || '](http://h.example/)' ELSE 'o' || o_orderkey END AS linked FROM orders GROUP BY o_orderkey",
    "parse_events": """WITH n AS (SELECT conv_id, count(*) AS n, 'm' || conv_id % 3 || '.png' AS m FROM conversations GROUP BY conv_id)
        SELECT conv_id, 0::BIGINT AS seq, 'DocumentStart' AS event_type, NULL::BIGINT AS section_idx, 'pptx' AS name, n AS section_count, m AS images, NULL AS error FROM n
        UNION ALL SELECT conv_id, i + 1, CASE WHEN conv_id % 10 = 3 AND i = 1 THEN 'SectionFailed' ELSE 'SectionParsed' END, i, 'Slide ' || (i + 1), NULL, NULL, CASE WHEN conv_id % 10 = 3 AND i = 1 THEN 'XmlParse' END FROM (SELECT conv_id, unnest(range(0, n)) AS i FROM n)
        UNION ALL SELECT conv_id, n + 1, 'DocumentEnd', NULL, NULL, NULL, NULL, NULL FROM n UNION ALL SELECT conv_id, n + 2, 'ResourceExtracted', NULL, m, NULL, NULL, NULL FROM n""",
    "slide_sections": f"SELECT conv_id, n AS section_idx, 'Slide ' || (n + 1) AS name, {SECTION} AS markdown FROM {TURNS}",
    "chart_tables": f"SELECT l_orderkey, 'o' || l_orderkey || ',part,supplier' AS header, string_agg('l' || l_linenumber || ',' || CASE WHEN l_partkey % 4 > 0 THEN l_partkey::VARCHAR ELSE '' END || ',' || CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey::VARCHAR ELSE '' END, ';' ORDER BY i) AS rows FROM {T} GROUP BY l_orderkey",
    "sql_markdown": f"""SELECT 'd' || doc_id AS doc_id, {TRIMMED.format("array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10) || chr(10))")} AS markdown FROM documents
        UNION ALL SELECT 'x' || l_orderkey, '## items' || chr(10) || chr(10) || string_agg('| ' || l_linenumber || ' | ' || l_partkey || ' |' || CASE WHEN i = 1 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY i) FROM {T} GROUP BY l_orderkey
        UNION ALL SELECT 'p' || conv_id, {TRIMMED.format(f"string_agg({SECTION}, '' ORDER BY n)")} FROM {TURNS} GROUP BY conv_id""",
    "slide_parts": "SELECT DISTINCT conv_id, '## Slide 1' || chr(10) || chr(10) || '# layout ' || conv_id || chr(10) || chr(10) || 'line' || chr(10) || chr(10) || '| n | v |' || chr(10) || '| --- | --- |' || chr(10) || '| conv | ' || conv_id || ' |' || chr(10) || chr(10) || '![shot ' || conv_id || '](m.png)' || chr(10) || chr(10) || '> **Notes:**' || chr(10) || '> note ' || conv_id AS markdown FROM conversations",
    "listed_items": f"WITH r AS (SELECT l_orderkey, i, l_partkey % 2 AS deep, 2 + sum(1 - l_partkey % 2) OVER (PARTITION BY l_orderkey ORDER BY i ROWS UNBOUNDED PRECEDING) AS n FROM {T}) SELECT l_orderkey, ltrim(string_agg(CASE WHEN deep = 1 THEN '  - ' ELSE n::BIGINT || '. ' END || 'i' || (i - 1), chr(10) ORDER BY i)) AS markdown FROM r GROUP BY l_orderkey",
    "revisions": f"WITH r AS (SELECT l_orderkey, i, 'i' || (i - 1) AS t, l_partkey % 3 AS how FROM {T}) SELECT l_orderkey, rtrim(string_agg('p ' || CASE WHEN how = 2 THEN '' ELSE t END, chr(10) || chr(10) ORDER BY i)) AS accept, rtrim(string_agg('p ' || CASE WHEN how = 1 THEN '' ELSE t END, chr(10) || chr(10) ORDER BY i)) AS reject, string_agg('p ' || CASE how WHEN 1 THEN '<ins>' || t || '</ins>' WHEN 2 THEN '~~' || t || '~~' ELSE t END, chr(10) || chr(10) ORDER BY i) AS markup FROM r GROUP BY l_orderkey",
    "front_matter": r"""SELECT doc_id, concat_ws(chr(10), '---', 'format: docx', 'title: "t \"' || doc_id || '\" \\"', 'author: "' || lang || '"', 'created: "2020-01-01"', 'words: ' || n_chars, 'keywords:', '  - "' || source || '"', '  - "\"k\""', 'application: "A"', '---', '', 'hi') AS markdown FROM documents""",
    "document_info": r"SELECT doc_id, 'docx' AS format, 1::BIGINT AS n_sections, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS n_words, strlen(regexp_replace(text, '^\n+|\n+$', '', 'g'))::BIGINT AS n_bytes FROM documents",
    "text_files": f"SELECT doc_id, strlen(m)::BIGINT AS n_bytes, md5(m) AS md5 FROM (SELECT doc_id, {TRIMMED.format("array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10) || chr(10))")} AS m FROM documents)",
    "sql_clean": cleanup.oracle_sql()["clean_default"],
}
