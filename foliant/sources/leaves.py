"""Packages to facts: flat rows (kind, part, ord, attrs) that the operators join. A leaf decides nothing that a join,
a window or an aggregate can: ids stay ids, styles, numbers, shared strings and spans are resolved later."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

from ..errors import OfficeError
from .package import Node, Package

Fact = tuple[str, str, int, dict]
#: What is not there, to read from.
NOTHING = Node("", {})


def flag(node: Node | None, attr: str = "w:val") -> bool:
    return node is not None and node.attrs.get(attr, "1") not in ("0", "false")


def metadata(p: Package) -> Iterator[Fact]:
    core = {"dc:title": "title", "dc:creator": "author", "dc:subject": "subject", "dc:description": "description", "cp:keywords": "keywords", "dcterms:created": "created", "dcterms:modified": "modified", "cp:lastModifiedBy": "last_modified_by"}
    n = 0
    root = {r["type"].rpartition("/")[2]: r["target"] for r in reversed(p.rels("")) if not r["external"]}
    usual = lambda kind, name: root[kind] if root.get(kind) in p.known else name
    for part, names in ((usual("core-properties", "docProps/core.xml"), core), (usual("extended-properties", "docProps/app.xml"), {"Application": "application", "Pages": "page_count", "Slides": "page_count", "Words": "word_count"})):
        root = p.tree(part)
        for node in root.children if root else ():
            if node.name in names:
                yield "meta", part, (n := n + 1), {"name": names[node.name], "value": node.all_text(), "app": str(names is not core).lower()}


def manifest(p: Package) -> Iterator[Fact]:
    """All parts, and all relationships by the part they start from ("": the package). A relationship part that can't be
    read counts for nothing here; whoever needs it says so."""
    for i, (name, size) in enumerate(p.sizes()):
        if not name.endswith("/"):
            yield "part", name, i, {"size": str(size)}
    for name in p.names:
        folder, _, file = name.rpartition("/")
        if not file.endswith(".rels") or folder.rpartition("/")[2] != "_rels":
            continue
        above = folder.rpartition("/")[0]
        source = file[:-5] if not above else f"{above}/{file[:-5]}"
        with contextlib.suppress(OfficeError):
            for i, r in enumerate(p.rels(source)):
                yield "rel", source, i, {"id": r["id"], "type": r["type"], "target": r["target"], "external": str(r["external"]).lower()}


def index(point: Node, part: str) -> int:
    value = point.attrs.get("idx", "0")
    if not value.isascii() or not value.isdigit():
        raise OfficeError("InvalidData", f"chart index {value!r}", part)
    return int(value)


def chart(p: Package, part: str, ord_: int) -> Iterator[Fact]:
    """Long rows: the title, and a row for each point of each series, by its idx."""
    root = p.tree(part, required=True)
    title = root.at("c:chart", "c:title")
    yield "chart", part, ord_, {"title": "".join(t.all_text() for t in title.walk() if t.name == "a:t") if title else ""}
    series = [n for n in root.walk() if n.name == "c:ser"]
    cats: dict[int, str] = {}
    for s in series:
        if not cats and (c := s.first("c:cat")):
            cats = {index(n, part): (n.first("c:v") or n).all_text() for n in c.walk() if n.name == "c:pt"}
    for i, c in cats.items():
        yield "category", part, i, {"value": c}
    for i, s in enumerate(series):
        tx = s.first("c:tx")
        name = next((n.all_text() for n in tx.walk() if n.name == "c:v"), "") if tx else ""
        yield "series", part, i, {"name": name or f"Series {i + 1}"}
        for n in (s.first("c:val") or NOTHING).walk():
            if n.name == "c:pt":
                value = (n.first("c:v") or n).all_text()
                try:
                    float(value)
                except ValueError as e:
                    raise OfficeError("InvalidData", f"chart value {value!r}", part) from e
                yield "point", part, i, {"idx": str(index(n, part)), "value": value}


# --------------------------------------------------------------------------- Word
def word_run(r: Node, hidden: list) -> Iterator[dict]:
    """Runs of a w:r: its text, split at breaks. hidden: whether a field code is open."""
    style: dict = {}
    if (pr := r.first("w:rPr")) is not None and pr.children:
        said = {c.name: c for c in reversed(pr.children)}  # the first of each
        style = {k: True for k, n in (("b", "w:b"), ("i", "w:i"), ("u", "w:u"), ("s", "w:strike")) if flag(said.get(n)) and not (n == "w:u" and said[n].attrs.get("w:val") == "none")}
        align = said.get("w:vertAlign", NOTHING).attrs.get("w:val")
        style |= {"sup": True} if align == "superscript" else {"sub": True} if align == "subscript" else {}
        for k, n, a in (("font", "w:rFonts", "w:ascii"), ("size", "w:sz", "w:val"), ("color", "w:color", "w:val"), ("hl", "w:highlight", "w:val")):
            if (x := said.get(n)) is not None and a in x.attrs:
                style[k] = x.attrs[a]
    text = ""
    for c in r.children:
        if c.name == "w:fldChar":
            hidden[0] = {"begin": True, "separate": False, "end": False}.get(c.attrs.get("w:fldCharType"), hidden[0])
        elif hidden[0]:
            continue
        elif c.name == "w:t":
            text += c.all_text()
        elif c.name in ("w:tab", "w:noBreakHyphen", "w:softHyphen", "w:noBreakSpace"):
            text += {"w:tab": "\t", "w:noBreakHyphen": "‑", "w:softHyphen": "­", "w:noBreakSpace": " "}[c.name]
        elif c.name in ("w:br", "w:cr"):
            yield style | {"t": text, ("pb" if c.attrs.get("w:type") == "page" else "lb"): True}
            text = ""
        elif c.name in ("w:footnoteReference", "w:endnoteReference"):
            if text:
                yield style | {"t": text}
                text = ""
            yield {"t": "", "note": ("" if c.name == "w:footnoteReference" else "e") + c.attrs.get("w:id", "")}
    if text:
        yield style | {"t": text}


def word_images(p: Node) -> list[dict]:
    out = []
    for n in outside(p, {"mc:Fallback", "w:txbxContent"}):
        if n.name == "w:drawing":
            props = next((x for x in n.walk() if x.name == "wp:docPr"), NOTHING)
            size = next((x for x in n.walk() if x.name == "wp:extent"), NOTHING)
            out += [{"rid": x.attrs["r:embed"], "alt": props.attrs.get("descr"), "w": size.attrs.get("cx"), "h": size.attrs.get("cy")} for x in n.walk() if x.name == "a:blip" and "r:embed" in x.attrs]
        elif n.name == "v:imagedata" and "r:id" in n.attrs:
            out.append({"rid": n.attrs["r:id"], "alt": n.attrs.get("o:title")})
    return out


def outside(node: Node, closed: set[str]):
    todo = node.children[::-1]
    while todo:
        c = todo.pop()
        if c.name not in closed:
            yield c
            todo.extend(reversed(c.children))


def word_paragraph(p: Node, rich: bool = True) -> dict:
    """rich: whether there may be pictures in it."""
    runs: list[dict] = []
    hidden = [False]

    def go(node: Node, more: dict):
        for c in node.children:
            if c.name == "w:r":
                runs.extend(x | more for x in word_run(c, hidden))
            elif c.name == "w:hyperlink":
                go(c, more | ({"rid": c.attrs["r:id"]} if "r:id" in c.attrs else {}))
            elif c.name in ("w:ins", "w:del"):
                go(c, more | {"rev": "inserted" if c.name == "w:ins" else "deleted"})
            elif c.name in ("w:smartTag", "w:sdt", "w:sdtContent", "w:fldSimple"):
                go(c, more)

    go(p, {})
    pr = p.first("w:pPr") or NOTHING
    num = pr.first("w:numPr")
    images = word_images(p) if rich else []
    out = {"runs": json.dumps(runs) if runs else "[]", "images": json.dumps(images) if images else "[]"}
    if not pr.children:
        return out
    for k, node, a in (("style", pr.first("w:pStyle"), "w:val"), ("jc", pr.first("w:jc"), "w:val"), ("num", num and num.first("w:numId"), "w:val"), ("level", num and num.first("w:ilvl"), "w:val")):
        if node is not None and a in node.attrs:
            out[k] = node.attrs[a]
    if "num" in out:
        out.setdefault("level", "0")
    return out


def style(n: Node) -> dict:
    """A style's own properties; what it does not say is absent, so that the styles it is based on can."""
    a = {"id": n.attrs.get("w:styleId", ""), "type": n.attrs.get("w:type", "paragraph"), "default": str(n.attrs.get("w:default") in ("1", "true")).lower()}
    for k, x in (("name", n.first("w:name")), ("based", n.first("w:basedOn")), ("outline", n.at("w:pPr", "w:outlineLvl"))):
        if x is not None:
            a[k] = x.attrs.get("w:val", "")
    run = n.first("w:rPr") or NOTHING
    for k, tag in (("bold", "w:b"), ("italic", "w:i"), ("strike", "w:strike")):
        if (x := run.first(tag)) is not None:
            a[k] = str(flag(x)).lower()
    if (x := run.first("w:u")) is not None:
        a["underline"] = str(x.attrs.get("w:val", "single") != "none").lower()
    for k, tag, name in (("font", "w:rFonts", "w:ascii"), ("size", "w:sz", "w:val"), ("color", "w:color", "w:val"), ("highlight", "w:highlight", "w:val")):
        if (x := run.first(tag)) is not None and name in x.attrs:
            a[k] = x.attrs[name]
    return a


REFERENCES = ("w:headerReference", "w:footerReference")


class Word:
    """Facts of a body, in the order of blocks; seq is the order of parsing, which numbering follows."""

    def __init__(self, p: Package):
        self.p, self.block, self.seq, self.tables = p, 0, 0, 0
        self.rich = True  # whether boxes or pictures may be in what is read

    def paragraph(self, node: Node, part: str, region: str, where: dict) -> Iterator[Fact]:
        boxes = [q for t in outside(node, {"mc:Fallback"}) if t.name == "w:txbxContent" for q in t.each("w:p")] if self.rich else []
        inner = []
        for q in boxes:  # parsed before their host, placed after it
            a = word_paragraph(q)
            self.seq += 1
            if a["runs"] != "[]" or a["images"] != "[]":
                inner.append(a | {"seq": str(self.seq), "region": region} | where)
        a = word_paragraph(node, self.rich)
        self.seq += 1
        for x in [a | {"seq": str(self.seq), "region": region} | where, *inner]:
            self.block += 1
            yield "para", part, self.block, x

    def table(self, node: Node, part: str, region: str, parent: str = "", root: str = "") -> Iterator[Fact]:
        self.tables += 1
        table = f"{part}#{self.tables}"
        self.block += 1
        yield "table", part, self.block, {"table": table, "parent": parent, "root": root or table, "region": region}
        for r, row in enumerate(node.each("w:tr")):
            head = flag((row.first("w:trPr") or NOTHING).first("w:tblHeader")) if row.first("w:trPr") else False
            for c, cell in enumerate(row.each("w:tc")):
                pr = cell.first("w:tcPr") or NOTHING
                merge = pr.first("w:vMerge")
                span = (pr.first("w:gridSpan") or NOTHING).attrs.get("w:val", "1")
                name = f"{table}.{r}.{c}"
                yield "cell", part, c, {"table": table, "cell": name, "row": str(r), "span": span if span.isdigit() else "1", "head": str(head).lower(), "merge": "" if merge is None else "restart" if merge.attrs.get("w:val", "continue") != "continue" else "continue"}
                for child in cell.children:
                    if child.name == "w:p":
                        yield from self.paragraph(child, part, "cell", {"cell": name, "table": table})
                    elif child.name == "w:tbl":
                        yield from self.table(child, part, region, name, root or table)

    def body(self, node: Node, part: str, region: str) -> Iterator[Fact]:
        for c in node.children:
            if c.name == "w:p":
                yield from self.paragraph(c, part, region, {})
            elif c.name == "w:tbl":
                yield from self.table(c, part, region)
            elif c.name in ("w:sdt", "w:sdtContent", "mc:AlternateContent", "mc:Choice"):
                yield from self.body(c, part, region)

    def facts(self) -> Iterator[Fact]:
        """The body is pulled child by child; regions follow in the order in which they are first named."""
        p, main = self.p, self.p.main
        rels = {r["id"]: r for r in p.rels(main)}
        regions: dict[str, str] = {}
        for child in p.pull(main, lambda parent, name: parent == "w:body", required=True):
            nodes = [child, *child.walk()]
            names = {n.name for n in nodes}
            self.rich = not names.isdisjoint(("w:txbxContent", "w:drawing", "v:imagedata"))
            yield from self.body(Node("w:body", {}, [child]), main, "body")
            if not names.isdisjoint(REFERENCES):
                for n in nodes:
                    if n.name in REFERENCES:
                        regions.setdefault(n.attrs.get("r:id", ""), n.name[2:8])
        self.rich = True
        for rid, region in regions.items():
            if rid in rels and (tree := p.tree(rels[rid]["target"])):
                p.rels(rels[rid]["target"])
                yield from self.body(tree, rels[rid]["target"], region)
        for kind in ("footnote", "endnote"):
            part = p.related(f"{kind}s", f"word/{kind}s.xml")
            for i, n in enumerate(p.pull(part, lambda parent, name: name == f"w:{kind}")):  # noqa: B023
                text = "\n".join("".join(t.all_text() for t in q.walk() if t.name == "w:t") for q in n.walk() if q.name == "w:p").strip()
                if text and n.attrs.get("w:type") not in ("separator", "continuationSeparator"):
                    yield "note", part, i, {"kind": kind, "id": n.attrs.get("w:id", ""), "text": text}
        part = p.related("styles", "word/styles.xml")
        for i, n in enumerate(p.pull(part, lambda parent, name: name == "w:style")):
            yield "style", part, i, style(n)
        numbering = p.tree(p.related("numbering", "word/numbering.xml")) or NOTHING
        levels = {a.attrs.get("w:abstractNumId"): list(a.each("w:lvl")) for a in numbering.each("w:abstractNum")}
        for i, n in enumerate(numbering.each("w:num")):
            for lvl in levels.get((n.first("w:abstractNumId") or NOTHING).attrs.get("w:val"), ()):
                get = lambda name, d: (lvl.first(name) or NOTHING).attrs.get("w:val", d)  # noqa: B023, E731
                yield "num_level", "word/numbering.xml", i, {"num": n.attrs.get("w:numId", ""), "level": lvl.attrs.get("w:ilvl", "0"), "start": get("w:start", "1"), "format": get("w:numFmt", "decimal")}
        charts = [r for r in p.rels(main) if "chart" in r["type"] and not r["external"]]
        for i, r in enumerate(charts):
            yield from chart(p, r["target"], i)


# --------------------------------------------------------------------------- Excel
def excel(p: Package, but_sheets: bool = False) -> Iterator[Fact]:
    main = p.main
    root = p.tree(main, required=True)
    rels = {r["id"]: r for r in p.rels(main, required=True)}
    sheets = [n for n in (root.first("sheets") or NOTHING).each("sheet") if n.attrs.get("name")]
    for i, n in enumerate(sheets):
        part = rels.get(n.attrs.get("r:id"), {}).get("target", "")
        yield "sheet", main, i, {"name": n.attrs["name"], "id": n.attrs.get("sheetId", ""), "rid": n.attrs.get("r:id", ""), "part": part}
    strings = p.related("sharedStrings", "xl/sharedStrings.xml")
    for i, n in enumerate(p.pull(strings, lambda parent, name: name == "si")):
        yield "string", strings, i, {"value": "".join(t.all_text() for t in n.walk() if t.name == "t")}
    part = p.related("styles", "xl/styles.xml")
    styles = p.tree(part) or NOTHING
    for i, n in enumerate((styles.first("numFmts") or NOTHING).each("numFmt")):
        yield "number_format", part, i, {"id": n.attrs.get("numFmtId", ""), "code": n.attrs.get("formatCode", "")}
    for i, n in enumerate((styles.first("cellXfs") or NOTHING).each("xf")):
        yield "xf", part, i, {"format": n.attrs.get("numFmtId", "0")}
    for part in dict.fromkeys(r["target"] for n in sheets if (r := rels.get(n.attrs.get("r:id")))):
        if part not in p.known:
            continue
        if not but_sheets:
            yield from worksheet(p, part)
        for r in p.rels(part):
            kind = r["type"].rpartition("/")[2]
            if kind == "comments" and (tree := p.tree(r["target"])):
                for i, n in enumerate((tree.first("commentList") or NOTHING).each("comment")):
                    yield "comment", part, i, {"ref": n.attrs.get("ref", ""), "text": " ".join(t.all_text() for t in n.walk() if t.name == "t")}
            elif kind == "drawing" and (tree := p.tree(r["target"])):
                p.rels(r["target"])
                for i, n in enumerate(x for x in tree.walk() if x.name == "xdr:pic"):
                    get = lambda name: next((x.attrs for x in n.walk() if x.name == name), {})  # noqa: B023, E731
                    yield "drawing", part, i, {"drawing": r["target"], "rid": get("a:blip").get("r:embed", ""), "name": get("xdr:cNvPr").get("descr") or get("xdr:cNvPr").get("name", ""), "w": get("a:ext").get("cx", ""), "h": get("a:ext").get("cy", "")}
    yield from rich_values(p)


def worksheet(p: Package, part: str) -> Iterator[Fact]:
    """Rows, merges and links of a sheet, as they are pulled: a row is all that is held."""
    rows = merges = links = 0
    for n in p.pull(part, lambda parent, name: (parent, name) in (("sheetData", "row"), ("mergeCells", "mergeCell"), ("hyperlinks", "hyperlink"))):
        if n.name == "row":
            for c, cell in enumerate(n.each("c")):
                inline = cell.first("is")
                raw = "".join(t.all_text() for t in inline.walk() if t.name == "t") if inline else (cell.first("v") or NOTHING).all_text()
                a = {k: cell.attrs[k] for k in ("r", "t", "s", "vm") if k in cell.attrs}
                yield "sheet_cell", part, c, a | {"row": str(rows), "raw": raw}
            rows += 1
        elif n.name == "mergeCell":
            yield "merge", part, merges, {"ref": n.attrs.get("ref", "")}
            merges += 1
        else:
            if "r:id" in n.attrs:
                yield "link", part, links, {"ref": n.attrs.get("ref", ""), "rid": n.attrs["r:id"]}
            links += 1


def rich_values(p: Package) -> Iterator[Fact]:
    """The hops from a cell's vm to a picture, each as rows."""
    meta = p.tree("xl/metadata.xml") or NOTHING
    for i, n in enumerate((meta.first("valueMetadata") or NOTHING).each("bk")):
        if rc := n.first("rc"):
            yield "vm", "xl/metadata.xml", i + 1, {"v": rc.attrs.get("v", "")}
    for i, n in enumerate(b for f in meta.each("futureMetadata") for b in f.each("bk")):
        if rvb := next((x for x in n.walk() if x.name == "xlrd:rvb"), None):
            yield "rvb", "xl/metadata.xml", i, {"i": rvb.attrs.get("i", "")}
    for i, s in enumerate((p.tree("xl/richData/rdrichvaluestructure.xml") or NOTHING).each("s")):
        for slot, k in enumerate(s.each("k")):
            yield "rv_key", "xl/richData/rdrichvaluestructure.xml", i, {"slot": str(slot), "key": k.attrs.get("n", "")}
    for i, rv in enumerate((p.tree("xl/richData/rdrichvalue.xml") or NOTHING).each("rv")):
        for slot, v in enumerate(rv.each("v")):
            yield "rv_value", "xl/richData/rdrichvalue.xml", i, {"structure": rv.attrs.get("s", ""), "slot": str(slot), "value": v.all_text()}
    rel_part = "xl/richData/richValueRel.xml"
    for i, r in enumerate((p.tree(rel_part) or NOTHING).each("rel")):
        yield "rv_rel", rel_part, i, {"rid": r.attrs.get("r:id", "")}


# --------------------------------------------------------------------------- PowerPoint
def slide_paragraphs(shape: Node) -> list[str]:
    out = []
    for q in (shape.first("p:txBody", "a:txBody") or NOTHING).each("a:p"):
        runs = []
        for r in q.each("a:r"):
            pr = r.first("a:rPr") or NOTHING
            x = {"t": (r.first("a:t") or NOTHING).all_text()}
            x |= {k: True for k, a in (("b", "b"), ("i", "i")) if pr.attrs.get(a) in ("1", "true")}
            x |= {"u": True} if pr.attrs.get("u", "none") != "none" else {}
            x |= {"s": True} if pr.attrs.get("strike", "noStrike") != "noStrike" else {}
            if (h := pr.first("a:hlinkClick")) is not None and h.attrs.get("r:id"):
                x["rid"] = h.attrs["r:id"]
            runs.append(x)
        out.append(json.dumps(runs))
    return out


def placeholder(shape: Node) -> dict | None:
    ph = next((n for n in (shape.first("p:nvSpPr") or NOTHING).walk() if n.name == "p:ph"), None)
    return None if ph is None else {"type": ph.attrs.get("type", ""), "idx": ph.attrs.get("idx", "")}


def shapes(node: Node):
    for c in node.children:
        if c.name in ("p:sp", "p:graphicFrame", "p:pic"):
            yield c
        elif c.name in ("p:grpSp", "p:spTree", "p:cSld", "mc:AlternateContent", "mc:Choice"):
            yield from shapes(c)


def slide(p: Package, part: str) -> Iterator[Fact]:
    tree = p.tree(part, required=True)
    tables = 0
    for i, s in enumerate(shapes(tree)):
        if s.name == "p:sp":
            ph = placeholder(s)
            paras = slide_paragraphs(s)
            texts = [j for j in paras if any(r["t"] for r in json.loads(j))]
            base = {"ph": "true", **ph} if ph else {"ph": "false"}
            for k, runs in enumerate(texts or ["[]"]):
                yield "slide_para", part, (i << 32) + k, base | {"runs": runs}
        elif s.name == "p:graphicFrame":
            for t in (n for n in s.walk() if n.name == "a:tbl"):
                rows = [[" ".join("".join(x.all_text() for x in q.walk() if x.name == "a:t") for q in c.walk() if q.name == "a:p").strip() for c in r.each("a:tc")] for r in t.each("a:tr")]
                for r, row in enumerate(x for x in rows if any(x)):
                    for c, text in enumerate(row):
                        yield "slide_cell", part, c, {"table": f"{part}#{tables}", "n": str(tables), "row": str(r), "text": text}
                tables += 1
        else:
            get = lambda name: next((x.attrs for x in s.walk() if x.name == name), {})  # noqa: B023, E731
            yield "slide_pic", part, i, {"rid": get("a:blip").get("r:embed", ""), "name": get("p:cNvPr").get("descr") or get("p:cNvPr").get("name", ""), "w": get("a:ext").get("cx", ""), "h": get("a:ext").get("cy", "")}


def layout(p: Package, part: str, level: str, slide_part: str) -> Iterator[Fact]:
    tree = p.tree(part)
    for i, s in enumerate(shapes(tree) if tree else ()):
        if s.name == "p:sp" and (ph := placeholder(s)):
            text = "\n".join(filter(None, ("".join(r["t"] for r in json.loads(j)) for j in slide_paragraphs(s))))
            yield "placeholder", part, i, {"level": level, "slide": slide_part, "text": text, **ph}


def powerpoint(p: Package) -> Iterator[Fact]:
    main = p.main
    root = p.tree(main, required=True)
    rels = {r["id"]: r for r in p.rels(main, required=True)}
    for i, n in enumerate((root.first("p:sldIdLst") or NOTHING).each("p:sldId")):
        part = rels.get(n.attrs.get("r:id"), {}).get("target")
        if not part:
            continue
        yield "slide", main, i, {"part": part}
        try:
            yield from slide(p, part)
            own = p.rels(part)
            for r in own:
                kind = r["type"].rpartition("/")[2]
                if kind == "slideLayout":
                    yield from layout(p, r["target"], "layout", part)
                    for m in p.rels(r["target"]):
                        if m["type"].endswith("/slideMaster"):
                            yield from layout(p, m["target"], "master", part)
                elif "chart" in kind and not r["external"]:
                    yield "slide_chart", part, 0, {"chart": r["target"]}
                    yield from chart(p, r["target"], i)
            notes = next((r["target"] for r in own if r["type"].endswith("/notesSlide")), part.replace("slides/slide", "notesSlides/notesSlide"))
            tree = p.tree(notes) if notes != part else None
            k = 0
            for s in shapes(tree) if tree else ():
                if s.name == "p:sp" and (placeholder(s) or {}).get("type") not in ("sldNum", "sldImg", "dt", "hdr", "ftr"):
                    for runs in slide_paragraphs(s):
                        if any(r["t"] for r in json.loads(runs)):
                            yield "slide_note", part, (k := k + 1), {"runs": runs}
        except OfficeError as e:
            yield "error", e.part or part, i, {"kind": str(e.kind), "name": e.name, "message": e.message, "section": str(i)}


def units_of(p: Package) -> list[str]:
    """Sheets of a book, by which a large one can be read in pieces; what else there is is one piece."""
    if p.format != "xlsx":
        return []
    rels = {r["id"]: r["target"] for r in p.rels(p.main)}
    sheets = (p.tree(p.main, required=True).first("sheets") or NOTHING).each("sheet")
    return list(dict.fromkeys(t for n in sheets if (t := rels.get(n.attrs.get("r:id"))) in p.known))


def unit_facts(data, unit: str) -> Iterator[Fact]:
    """The facts of one sheet."""
    try:
        yield from worksheet(Package(data), unit)
    except Exception as e:
        yield from failure(e)


def failure(e: Exception) -> Iterator[Fact]:
    if isinstance(e, RecursionError):
        e = OfficeError("InvalidData", "elements are nested too deeply")
    elif not isinstance(e, OfficeError):
        e = OfficeError("Other", f"{type(e).__name__}: {e}")
    yield "error", e.part, 0, {"kind": str(e.kind), "name": e.name, "message": e.message}


def facts_of(data, only_manifest: bool = False, but_sheets: bool = False, kinds: set[str] | None = None) -> Iterator[Fact]:
    """All facts of a package (of some kinds); a failure, whatever it is, is a last fact of its own."""
    found = all_facts(data, only_manifest, but_sheets, kinds is not None and kinds.isdisjoint(("part", "rel")))
    return found if kinds is None else (x for x in found if x[0] in kinds)


def all_facts(data, only_manifest: bool, but_sheets: bool, unlisted: bool) -> Iterator[Fact]:
    try:
        p = Package(data)
        yield "format", p.main, 0, {"format": p.format}
        if not unlisted:
            yield from manifest(p)
        if only_manifest:
            return
        yield from metadata(p)
        yield from {"docx": lambda: Word(p).facts(), "xlsx": lambda: excel(p, but_sheets), "pptx": lambda: powerpoint(p)}[p.format]()
    except Exception as e:  # one package must not end a job over all of them
        yield from failure(e)
