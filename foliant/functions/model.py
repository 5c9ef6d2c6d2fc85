"""Scalars of the document model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = "struct<t:string,b:boolean,i:boolean,u:boolean,s:boolean,sup:boolean,sub:boolean,code:boolean,font:string,size:string,color:string,hl:string,rid:string,lb:boolean,pb:boolean,rev:string,note:string>"
RUNS, IMAGES = f"array<{RUN}>", "array<struct<rid:string,alt:string,w:string,h:string>>"
STYLE = ["b", "i", "u", "s", "sup", "sub", "code", "font", "size", "color", "hl"]
# Media types by extension, extensions by media type, kinds of resources by extension.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tiff": "image/tiff", "tif": "image/tiff", "svg": "image/svg+xml", "wmf": "image/x-wmf", "emf": "image/x-emf", "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg", "m4a": "audio/mp4", "mp4": "video/mp4", "avi": "video/x-msvideo", "mov": "video/quicktime", "webm": "video/webm"}
PICTURES = ("png", "jpg", "jpeg", "gif", "bmp", "tiff", "tif", "svg", "emf", "wmf")
SLIDE_MEDIA = {"webp": "image/webp", "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4", "avi": "video/x-msvideo", "wmv": "video/x-ms-wmv"}
EXTENSION = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/bmp": "bmp", "image/tiff": "tiff", "image/svg+xml": "svg", "image/x-wmf": "wmf", "image/x-emf": "emf", "audio/mpeg": "mp3", "audio/wav": "wav", "video/mp4": "mp4"}
AUDIO, VIDEO = ("mp3", "wav", "ogg", "m4a", "wma"), ("mp4", "avi", "mov", "wmv", "webm")


def runs_of(json: Column) -> Column:
    return F.from_json(json, RUNS)


def plain_text(runs: Column) -> Column:
    """Texts of runs; a line break is a new line, a page break a rule."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.coalesce(r["t"], F.lit("")), F.when(r["pb"], "\n---\n").when(r["lb"], "\n").otherwise(""))), "")


def is_empty(runs: Column, images: Column) -> Column:
    return (F.coalesce(F.size(images), F.lit(0)) <= 0) & F.forall(F.coalesce(runs, F.array().cast(RUNS)), lambda r: F.coalesce(r["t"], F.lit("")) == "")


def merge_runs(runs: Column) -> Column:
    """Neighbours of one style, link and revision become one run, unless a break lies between."""

    def same(a: Column, b: Column) -> Column:
        out = ~F.coalesce(a["lb"], F.lit(False)) & ~F.coalesce(a["pb"], F.lit(False))
        for c in [*STYLE, "rid", "rev"]:
            out = out & a[c].eqNullSafe(b[c])
        return out

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = r.withField("t", F.concat(F.coalesce(last["t"], F.lit("")), F.coalesce(r["t"], F.lit(""))))
        return F.when((F.size(acc) > 0) & same(F.get(acc, F.size(acc) - 1), r), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined.cast(RUN)))).otherwise(F.concat(acc, F.array(r)))

    first = F.slice(runs, 1, 1)
    return F.when(F.size(runs) <= 1, runs).otherwise(F.aggregate(F.slice(runs, F.lit(2), F.size(runs)), first, step))


def column_of(ref: Column) -> Column:
    """0-based column of a cell reference."""
    letters = F.upper(F.regexp_extract(ref, "^\\$?([A-Za-z]+)", 1))
    return F.when(letters != "", F.aggregate(F.split(letters, ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1)


def row_of(ref: Column) -> Column:
    """1-based row of a cell reference."""
    return F.regexp_extract(ref, "([0-9]+)$", 1).try_cast("int")


def is_date_code(code: Column) -> Column:
    """d or y outside quotes and brackets, or m if there is a d or y anywhere."""
    bare = F.lower(F.regexp_replace(code, r'"[^"]*"|\[[^\]]*\]', ""))
    return bare.rlike("[dy]") | (F.contains(bare, F.lit("m")) & F.lower(code).rlike("[dy]"))


def is_date_format(format_id: Column, code: Column) -> Column:
    return F.coalesce(format_id.between(14, 22) | format_id.between(45, 47), F.lit(False)) | F.coalesce(is_date_code(code), F.lit(False))


def serial_date(serial: Column) -> Column:
    """ISO date (and time) of a serial number in the 1900 system; null before day 1."""
    day = F.floor(serial).cast("int")
    days = F.when(serial > 60, day - 1).otherwise(day)
    date = F.date_format(F.date_add(F.lit("1899-12-31").cast("date"), days), "yyyy-MM-dd")
    rest = serial - F.floor(serial)
    secs = F.round(rest * 86400).cast("long")
    time = F.format_string("T%02d:%02d:%02d", (secs / 3600).cast("long"), ((secs % 3600) / 60).cast("long"), secs % 60)
    return F.when((serial >= 1) & (serial < 2958466), F.when(rest > 0.0001, F.concat(date, time)).otherwise(date))


def resolve_path(base: Column, target: Column) -> Column:
    """A relative target against the part it stands in."""
    begin = F.when(target.startswith("/"), F.array().cast("array<string>")).otherwise(F.slice(F.split(base, "/"), F.lit(1), F.size(F.split(base, "/")) - 1))
    step = lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(p.isin("", "."), a).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(F.split(target, "/"), begin, step), "/")


def rels_path(part: Column) -> Column:
    return F.when(F.contains(part, F.lit("/")), F.regexp_replace(part, "^(.*)/([^/]*)$", "$1/_rels/$2.rels")).when(part == "", "_rels/.rels").otherwise(F.concat(F.lit("_rels/"), part, F.lit(".rels")))


def extension(name: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(name, r"\.([A-Za-z0-9]{1,5})$", 1), F.lit("")))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def mime_of(name: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(MIME), extension(name)), F.lit("application/octet-stream"))


def mime_in(name: Column, format: Column) -> Column:
    """Media type of a part in a package of a format, null where that format's documents have none: pictures in all,
    sound and film in presentations."""
    pictures = {e: MIME[e] for e in PICTURES}
    e = extension(name)
    return F.when(format == "pptx", F.try_element_at(_map(pictures | SLIDE_MEDIA), e)).otherwise(F.try_element_at(_map(pictures), e))


def resource_type(mime: Column) -> Column:
    m = F.lower(mime)
    return F.when(m.startswith("image/"), "image").when(m.startswith("audio/"), "audio").when(m.startswith("video/"), "video").when(F.contains(m, F.lit("chart")), "chart").when(F.contains(m, F.lit("ole")), "ole").otherwise("other")


def resource_type_of(name: Column) -> Column:
    """The kind of a resource by the extension of its name."""
    e = extension(name)
    return F.when(e.isin(*PICTURES), "image").when(e.isin(*AUDIO), "audio").when(e.isin(*VIDEO), "video").otherwise("other")


def is_image(type_: Column) -> Column:
    return type_.isin("image", "chart")


def is_media(type_: Column) -> Column:
    return type_.isin("audio", "video")


def suggested_name(filename: Column, resource_id: Column, mime: Column, type_: Column | None = None) -> Column:
    """The file name, else the id with the extension of its media type if it is a picture, else of its kind."""
    type_ = resource_type(mime) if type_ is None else type_
    picture = F.coalesce(F.try_element_at(_map(EXTENSION), mime), F.lit("png"))
    end = F.when(type_ == "image", picture).when(type_ == "audio", "mp3").when(type_ == "video", "mp4").when(type_ == "chart", "png").otherwise("bin")
    return F.coalesce(filename, F.concat(resource_id, F.lit("."), end))


# --------------------------------------------------------------------------- predicates and constructors
def heading_name(level: Column) -> Column:
    return F.when(level.between(1, 6), F.concat(F.lit("H"), level.cast("string"))).otherwise("None")


def heading_number(name: Column) -> Column:
    """The level of a heading's name, 0 for none."""
    return F.coalesce(F.regexp_extract(name, "^H([1-6])$", 1).try_cast("int"), F.lit(0))


def is_heading(level: Column) -> Column:
    return F.coalesce(level, F.lit(0)) > 0


def is_list_item(list_type: Column) -> Column:
    return list_type.isNotNull()


def is_link(run: Column) -> Column:
    return run["rid"].isNotNull()


def has_formatting(run: Column) -> Column:
    """Whether a run is anything but plain; fonts, sizes and colours don't count."""
    out = F.lit(False)
    for c in ("b", "i", "u", "s", "sup", "sub", "code"):
        out = out | F.coalesce(run[c], F.lit(False))
    return out


def run(text: Column | str, rid: Column | str | None = None, **style: bool) -> Column:
    """A run of that text, linked and styled as said."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    given = {"t": lit(text), "rid": lit(rid)} | {k: F.lit(v) for k, v in style.items()}
    types = dict(x.split(":") for x in RUN[len("struct<") : -1].split(","))
    return F.struct(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def paragraph(*runs: Column, heading: int = 0) -> Column:
    """A paragraph of those runs."""
    return F.struct((F.array(*runs) if runs else F.array().cast(RUNS)).alias("runs"), F.array().cast(IMAGES).alias("images"), F.lit(heading).alias("heading"))


def display_width(s: Column) -> Column:
    """Wide East Asian characters count twice."""
    wide = r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1F64F}\x{20000}-\x{3FFFD}]"
    return F.length(s) + F.regexp_count(s, F.lit(wide))
