"""The leaf of every source: bytes of a package to parts, and XML parts to trees. Standard library only."""

from __future__ import annotations

import codecs
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from typing import NamedTuple
from xml.parsers import expat

from ..errors import OfficeError

ZIP_MAGIC, CFB_MAGIC = b"PK\x03\x04", bytes.fromhex("D0CF11E0A1B11AE1")
# Main content types, and what a compound file's root entries say.
CONTENT_TYPES = [("docx", "wordprocessingml.document.main"), ("xlsx", "spreadsheetml.sheet.main"), ("pptx", "presentationml.presentation.main")]
FOLDERS = [("docx", "word/"), ("xlsx", "xl/"), ("pptx", "ppt/")]
LEGACY = {"WordDocument": "Word 97-2003", "Workbook": "Excel 97-2003", "Book": "Excel 97-2003", "PowerPoint Document": "PowerPoint 97-2003"}
#: Bytes of a part that is read whole (pulled parts have no bound), parts of a package, bytes pulled at a time.
MOST_PART, MOST_PARTS, PULL = 512 << 20, 100_000, 1 << 16
#: Bytes of a part whose tree is kept for the packages that follow: lists of types and relationships are often alike.
ALIKE = 1 << 12
CENTRAL = struct.Struct("<4s6H3I5H2I")
MAINS = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml", "pptx": "ppt/presentation.xml"}


def cfb_names(data: bytes) -> set[str]:
    """Names in the directory of a compound file."""
    shift = struct.unpack_from("<H", data, 30)[0]
    if shift not in (9, 12):  # the two sector sizes there are
        raise OfficeError("UnsupportedFormat", "compound file with sectors of an unknown size")
    size, first = 1 << shift, struct.unpack_from("<I", data, 48)[0]
    fat: list[int] = []
    for s in struct.unpack_from("<109I", data, 76):
        if s < 0xFFFFFFFA:
            fat += struct.unpack_from(f"<{size // 4}I", data, (s + 1) * size)
    names, sector, seen = set(), first, set()
    while sector < 0xFFFFFFFA and sector not in seen:
        seen.add(sector)
        for at in range((sector + 1) * size, (sector + 2) * size, 128):
            n = struct.unpack_from("<H", data, at + 64)[0]
            if 2 <= n <= 64:
                names.add(data[at : at + n - 2].decode("utf-16-le", "replace"))
        sector = fat[sector] if sector < len(fat) else 0xFFFFFFFF
    return names


def check_container(data: bytes) -> None:
    """Only ZIP goes on; compound files say what they are."""
    if data[:8] == CFB_MAGIC:
        try:
            names = cfb_names(data)
        except (struct.error, IndexError) as e:
            raise OfficeError("UnsupportedFormat", "compound file with an unreadable directory") from e
        if "EncryptedPackage" in names:
            raise OfficeError("Encrypted", "the package is encrypted")
        kind = next((LEGACY[n] for n in LEGACY if n in names), "an unknown compound file")
        raise OfficeError("UnsupportedFormat", kind)
    if data[:4] != ZIP_MAGIC:
        raise OfficeError("UnknownFormat", "neither a ZIP nor a compound file")


class Entry(NamedTuple):
    """A part by the directory of its package; end: where the next one begins."""

    file_size: int
    packed: int
    method: int
    crc: int
    at: int
    end: int


def directory(data: bytes) -> dict[str, Entry] | None:
    """Parts of a plain package in memory by their names; None for whatever needs a closer look (comments, zip64, extra
    fields, names beyond ASCII, repeated names): zipfile takes that."""
    end = len(data) - 22
    if end < 0 or data[end : end + 4] != b"PK\5\6":
        return None
    *disks, here, n, size, start, comment = struct.unpack_from("<4H2IH", data, end + 4)
    if disks != [0, 0] or here != n or n == 0xFFFF or start + size != end or comment:
        return None
    found, at = [], start
    for _ in range(n):
        if at + 46 > end:
            return None
        sig, _, needs, flags, method, _, _, crc, packed, size, length, extra, note, disk, _, _, offset = CENTRAL.unpack_from(data, at)
        name = data[at + 46 : at + 46 + length]
        if sig != b"PK\1\2" or needs > 20 or flags & ~0x080E or method not in (0, 8) or extra or note or disk or not name.isascii() or b"\0" in name or offset >= start:
            return None
        found.append((offset, name.decode(), size, packed, method, crc))
        at += 46 + length
    found_at = sorted(x[0] for x in found)
    ends = dict(zip(found_at, [*found_at[1:], start]))
    out = {name: Entry(size, packed, method, crc, offset, ends[offset]) for offset, name, size, packed, method, crc in found}
    return out if at == end and len(out) == len(ends) == n else None


class Package:
    """A package in bytes, or in a file that can be sought in (then only what is read is fetched)."""

    def __init__(self, data):
        self.entries = None
        if isinstance(data, bytes):
            check_container(data)
            self.entries = directory(data)
            self.data, data = data, io.BytesIO(data)
        else:
            head = data.read(8)
            data.seek(0)
            check_container(head if head[:8] != CFB_MAGIC else data.read())
        self.stream = data
        self.names = list(self.entries) if self.entries is not None else self.zip.namelist()
        if len(self.names) > MOST_PARTS:
            raise OfficeError("InvalidData", "too many parts")
        self.known = set(self.names)
        self.pulled = 0
        self._rels: dict[str, list[dict]] = {}
        self.format = self.detect()
        self.main = self.main_part()

    @cached_property
    def zip(self) -> zipfile.ZipFile:
        try:
            return zipfile.ZipFile(self.stream)
        except (zipfile.BadZipFile, EOFError, ValueError) as e:
            raise OfficeError("ZipArchive", str(e)) from e

    def sizes(self) -> Iterator[tuple[str, int]]:
        """Names and sizes of parts, folders included."""
        return ((name, e.file_size) for name, e in self.entries.items()) if self.entries is not None else ((i.filename, i.file_size) for i in self.zip.infolist())

    def plain(self, name: str) -> bytes | None:
        """A part of a plain package; None if it is anything but what the directory says, which zipfile then names."""
        e, n = self.entries[name], len(name)
        start = e.at + 30 + n
        if self.data[e.at : e.at + 4] != ZIP_MAGIC or self.data[e.at + 26 : start] != struct.pack("<2H", n, 0) + name.encode() or self.data[e.at + 6] & 1 or start + e.packed > e.end:
            return None
        body = self.data[start : start + e.packed]
        if e.method == 8:
            reader = zlib.decompressobj(-15)
            try:
                body = reader.decompress(body, e.file_size + 1)
            except zlib.error:
                return None
            if not reader.eof:
                return None
        return body if len(body) == e.file_size and zlib.crc32(body) == e.crc else None

    def bytes(self, name: str) -> bytes | None:
        """None if the part is absent; damage is an error."""
        if name not in self.known:
            return None
        try:
            if (self.entries[name] if self.entries is not None else self.zip.getinfo(name)).file_size > MOST_PART:
                raise OfficeError("InvalidData", "part is too large", name)
            if self.entries is not None and (body := self.plain(name)) is not None:
                return body
            return self.zip.read(name)
        except KeyError:
            return None
        except (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError) as e:
            raise OfficeError("ZipArchive", str(e), name) from e

    def main_part(self) -> str:
        """The target of the package's own relationship to its document, else where it usually is."""
        usual = MAINS[self.format]
        try:
            found = [r["target"] for r in self.rels("") if r["type"].endswith("/officeDocument") and not r["external"]]
        except OfficeError:
            if usual in self.known:
                return usual
            raise
        return next((t for t in found if t in self.known), usual)

    def related(self, kind: str, usual: str) -> str:
        """The part that the main one names for a kind of relationship, else where it usually is."""
        found = (r["target"] for r in self.rels(self.main) if r["type"].endswith(f"/{kind}") and not r["external"])
        return next((t for t in found if t in self.known), usual)

    def pull(self, name: str, wanted: Callable[[str, str], bool], required: bool = False) -> Iterator[Node]:
        """Elements of a part for which wanted(name of the parent, own name) holds, one after another, each as a tree of
        its own: the part is unzipped, decoded and parsed by the piece, and no further than the caller goes on."""
        if name not in self.known:
            if required:
                raise OfficeError("MissingComponent", f"{name} is missing", name)
            return
        reader = Puller(name, wanted)
        if self.entries is not None and self.entries[name].file_size <= PULL and (data := self.plain(name)) is not None:
            self.pulled += len(data)
            yield from reader.feed(data)
            yield from reader.feed(b"", True)
            return
        try:
            with self.zip.open(name) as stream:
                while data := stream.read(PULL):
                    self.pulled += len(data)
                    yield from reader.feed(data)
                yield from reader.feed(b"", True)
        except (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError) as e:
            raise OfficeError("ZipArchive", str(e), name) from e

    def tree(self, name: str, required: bool = False) -> Node | None:
        data = self.bytes(name)
        if data is None:
            if required:
                raise OfficeError("MissingComponent", f"{name} is missing", name)
            return None
        return (alike if len(data) <= ALIKE else parse_xml)(data, name)

    def detect(self) -> str:
        data = self.bytes("[Content_Types].xml")
        if data is None:
            raise OfficeError("MissingComponent", "[Content_Types].xml is missing", "[Content_Types].xml")
        text = decode_xml(data, "[Content_Types].xml")
        for kind, mark in CONTENT_TYPES:
            if mark in text:
                return kind
        found = [k for k, folder in FOLDERS if any(n.startswith(folder) for n in self.names)]
        if len(found) != 1:
            raise OfficeError("UnknownFormat", "no main content type and no single main folder")
        return found[0]

    def rels(self, part: str, required: bool = False) -> list[dict]:
        """Relationships of a part ("": the package), targets resolved against it."""
        name = rels_path(part)
        if part in self._rels and (self._rels[part] or not required):
            return self._rels[part]
        data = self.bytes(name)
        if data is None:
            self.tree(name, required)  # says so if it is required
            out = []
        else:
            out = (alike_rels if len(data) <= ALIKE else relationships)(data, name, part)
        self._rels[part] = out
        return out


def relationships(data: bytes, name: str, part: str) -> list[dict]:
    out = []
    for n in parse_xml(data, name).children:
        if n.name.split(":")[-1] == "Relationship":
            a = n.attrs
            if not {"Id", "Type", "Target"} <= set(a):
                raise OfficeError("XmlParse", "relationship without Id, Type or Target", name)
            external = a.get("TargetMode", "").lower() == "external"
            out.append({"id": a["Id"], "type": a["Type"], "raw": a["Target"], "target": a["Target"] if external else resolve(part, a["Target"]), "external": external})
    return out


def rels_path(part: str) -> str:
    folder, _, name = part.rpartition("/")
    return f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels" if name else "_rels/.rels"


def resolve(base: str, target: str) -> str:
    """Path of a relative target; a leading slash is the root."""
    out = [] if target.startswith("/") else base.split("/")[:-1]
    for p in target.split("/"):
        if p == "..":
            out = out[:-1]
        elif p not in ("", "."):
            out.append(p)
    return "/".join(out)


def encoding_of(data: bytes) -> tuple[str, int]:
    """The encoding, by its mark, else by its zero bytes, else UTF-8; and the length of the mark."""
    if data[:3] == b"\xef\xbb\xbf":
        return "utf-8", 3
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return ("utf-16-le" if data[:1] == b"\xff" else "utf-16-be"), 2
    if data[:1] == b"<" and data[1:2] == b"\0":
        return "utf-16-le", 0
    if data[:1] == b"\0" and data[1:2] == b"<":
        return "utf-16-be", 0
    return "utf-8", 0


def decode_xml(data: bytes, part: str = "") -> str:
    """By its mark, else by its zero bytes, else UTF-8; strictly."""
    name, skip = encoding_of(data)
    try:
        return data[skip:].decode(name)
    except UnicodeDecodeError as e:
        raise OfficeError("Encoding", str(e), part) from e


@dataclass(slots=True)
class Node:
    name: str
    attrs: dict
    children: list = field(default_factory=list)
    text: str = ""

    def each(self, *names: str):
        return (c for c in self.children if c.name in names)

    def first(self, *names: str):
        for c in self.children:
            if c.name in names:
                return c
        return None

    def walk(self):
        """All nodes below, in the order of the text."""
        todo = self.children[::-1]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.children))

    def at(self, *path: str):
        node = self
        for p in path:
            node = node.first(p) if node else None
        return node

    def all_text(self) -> str:
        out, todo = [self.text], self.children[::-1]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
                continue
            out.append(node.text)
            todo.append(node.attrs.get("\0tail", ""))
            todo.extend(reversed(node.children))
        return "".join(out)


_LOOSE = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)")
_NUMERIC = re.compile(r"&#([^;&<>\s]{0,12});")


def _valid(m: re.Match) -> str:
    """The reference if it is one to a character; nothing if it is not."""
    digits = m[1][1:] if m[1][:1] == "x" else m[1]
    if not re.fullmatch("[0-9A-Fa-f]+" if m[1][:1] == "x" else "[0-9]+", digits):
        return ""
    n = int(digits, 16 if m[1][0] == "x" else 10)
    ok = n in (9, 10, 13) or 0x20 <= n <= 0xD7FF or 0xE000 <= n <= 0xFFFD or 0x10000 <= n <= 0x10FFFF
    return m[0] if ok else ""


def parse_xml(data: bytes, part: str = "") -> Node:
    """A tree with names as written. Loose ampersands stand for themselves, numeric references to no character are
    dropped, line ends become \\n; document types are refused, so nothing is expanded."""
    text = decode_xml(data, part)
    if "<!DOCTYPE" in text:
        raise OfficeError("XmlParse", "document types are not accepted", part)
    text = _LOOSE.sub("&amp;", _NUMERIC.sub(_valid, text))
    text = re.sub(r"^\s*<\?xml[^>]*\?>", "", text)
    root = Node("", {})
    stack = [root]

    def start(name, attrs):
        node = Node(name, attrs)
        stack[-1].children.append(node)
        stack.append(node)

    def chars(s):
        top = stack[-1]
        if top.children:
            last = top.children[-1]
            last.attrs["\0tail"] = last.attrs.get("\0tail", "") + s
        else:
            top.text += s

    p = expat.ParserCreate("utf-8")
    p.buffer_text = True
    p.StartElementHandler, p.CharacterDataHandler = start, chars
    p.EndElementHandler = lambda name: stack.pop()
    try:
        p.Parse(text.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as e:
        raise OfficeError("XmlParse", str(e), part) from e
    return root.children[0]


#: Trees and lists are only read, so those of equal small parts are the same object.
alike, alike_rels = lru_cache(256)(parse_xml), lru_cache(256)(relationships)


class Puller:
    """Bytes of an XML part, as they come, to trees of the elements that are wanted. The rules are those of parse_xml."""

    def __init__(self, part: str, wanted: Callable[[str, str], bool]):
        self.part, self.wanted = part, wanted
        self.decoder: codecs.IncrementalDecoder | None = None
        self.first, self.rest, self.begun = b"", "", False
        self.path: list[str] = [""]
        self.stack: list[Node] = []
        self.ready: list[Node] = []
        p = self.parser = expat.ParserCreate("utf-8")
        p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.chars
        p.StartDoctypeDeclHandler = self.doctype

    def doctype(self, *_) -> None:
        raise OfficeError("XmlParse", "document types are not accepted", self.part)

    def start(self, name: str, attrs: dict) -> None:
        if self.stack:
            node = Node(name, attrs)
            self.stack[-1].children.append(node)
            self.stack.append(node)
        elif self.wanted(self.path[-1], name):
            self.stack.append(Node(name, attrs))
        self.path.append(name)

    def end(self, name: str) -> None:
        self.path.pop()
        if self.stack:
            node = self.stack.pop()
            if not self.stack:
                self.ready.append(node)

    def chars(self, s: str) -> None:
        if not self.stack:
            return
        top = self.stack[-1]
        if top.children:
            last = top.children[-1]
            last.attrs["\0tail"] = last.attrs.get("\0tail", "") + s
        else:
            top.text += s

    def feed(self, data: bytes, final: bool = False) -> list[Node]:
        try:
            if self.decoder is None:
                self.first += data
                if len(self.first) < 4 and not final:
                    return []
                name, skip = encoding_of(self.first)
                self.decoder, data = codecs.getincrementaldecoder(name)(), self.first[skip:]
            text = self.rest + self.decoder.decode(data, final)
        except UnicodeDecodeError as e:
            raise OfficeError("Encoding", str(e), self.part) from e
        at = text.rfind("&", max(0, len(text) - 16))  # what may be a reference waits for its end
        cut = len(text) if final or at < 0 or ";" in text[at:] else at
        self.rest, text = text[cut:], text[:cut]
        if not self.begun:
            if "?>" not in text and text.lstrip()[:5] in "<?xml" and not final:
                self.rest = text + self.rest
                return []
            text, self.begun = re.sub(r"^\s*<\?xml[^>]*\?>", "", text), True
        try:
            self.parser.Parse(_LOOSE.sub("&amp;", _NUMERIC.sub(_valid, text)).encode("utf-8", "surrogatepass"), final)
        except expat.ExpatError as e:
            raise OfficeError("XmlParse", str(e), self.part) from e
        out, self.ready = self.ready, []
        return out
