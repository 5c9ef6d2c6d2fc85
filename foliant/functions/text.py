"""Cleanup of text as column expressions: each stage is one function from a string column to a string column.

Whitespace is Unicode White_Space wherever lines are trimmed; lines end at \\n, drop one \\r before it, and an empty
last line does not count.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import Cleanup

# White_Space, the characters that normalisation maps, and the phrases and patterns of the line rules.
SPACE = r"\t\n\x0B\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BULLETS = "•◦▪▫●○■□"
DASHES = "–—−‒"
SINGLE_QUOTES = "‘’"
DOUBLE_QUOTES = "“”„«»"
SPACES = "      "
NOTHING = "​‌‍﻿"
FOOTERS = ["all rights reserved", "confidential", "proprietary", "copyright ©", "copyright (c)", "© ", "(c) "]
CONTENTS = ["table of contents", "contents"]
ORPHANS = "|-_=*#~"
MOJIBAKE = [
    ("â€“", "em-dash"),
    ("â€™", "apostrophe"),
    ("â€œ", "left quote"),
    ("Ã©", "e-acute"),
    ("Ã¨", "e-grave"),
    ("Ã ", "a-grave"),
    ("Ã¢", "a-circumflex"),
    ("Â ", "non-breaking space"),
    ("Ã§", "c-cedilla"),
]
PAGE = rf"^([Pp]age [{SPACE}]*[0-9]+|[-\x{{2014}}][{SPACE}]*[0-9]+[{SPACE}]*[-\x{{2014}}]|[0-9]+[{SPACE}]*[-\x{{2014}}]|[0-9]{{1,5}})$"

_FROM = BULLETS + DASHES + SINGLE_QUOTES + DOUBLE_QUOTES + SPACES + NOTHING
_TO = "•" * len(BULLETS) + "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + " " * len(SPACES)


#: White space that a line can hold.
INNER = SPACE.replace(r"\n", "")


def trim(x: Column) -> Column:
    """Without White_Space at both ends."""
    return F.regexp_replace(x, f"^[{SPACE}]+|(?<![{SPACE}])[{SPACE}]+$", "")


def lines(x: Column) -> Column:
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(replaced(x, ENDS), "\n"))


def blank(x: Column) -> Column:
    return trim(x) == ""


# Stages are lists of replacements over the whole text, so they run in generated code and take linear time however many
# lines there are: a pattern neither starts again inside a run of white space nor repeats a group.
#: Line ends are \n and the last one goes.
ENDS = [(r"\r(?=\n|\z)", ""), (r"\n\z", "")]


def without_lines(*patterns: str) -> list[tuple[str, str]]:
    """Lines that match a pattern as a whole go; every line gets an end for that."""
    return [*ENDS, (r"\z", "\n"), ("(?md)^(?:" + "|".join(patterns) + r")\n", ""), (r"\n\z", "")]


def replaced(x: Column, stage: list[tuple[str, str]]) -> Column:
    for pattern, by in stage:
        x = F.regexp_replace(x, pattern, by)
    return x


def replaced_sql(x: str, stage: list[tuple[str, str]]) -> str:
    """The same in SQL."""
    for pattern, by in stage:
        x = "regexp_replace({}, r'{}', {})".format(x, pattern, "'\\n'" if by == "\n" else f"r'{by}'")
    return x


def _nfc(x: Column) -> Column:
    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")

    return nfc(x)


def plain_characters(x: Column) -> Column:
    """Plain bullets, dashes, quotes and spaces; zero-width characters go."""
    return F.translate(x, _FROM, _TO)


def nfc(x: Column) -> Column:
    """All code points below U+0300 are NFC already, so only texts with others go to Python."""
    return F.when(x.rlike("[^\\x{0000}-\\x{02FF}]"), _nfc(x)).otherwise(x)


def normalize_unicode(x: Column) -> Column:
    return plain_characters(nfc(x))


def remove_private_use(x: Column) -> Column:
    return F.regexp_replace(x, "[\\x{E000}-\\x{F8FF}\\x{F0000}-\\x{FFFFD}\\x{100000}-\\x{10FFFD}]", "")


def is_page_number(line: Column) -> Column:
    t = trim(line)
    return t.rlike(PAGE)


def is_footer(line: Column) -> Column:
    low = F.lower(trim(line))
    out = F.lit(False)
    for phrase in FOOTERS:
        out = out | F.contains(low, F.lit(phrase))
    return out


def is_contents(line: Column) -> Column:
    t = trim(line)
    dotted = (F.contains(t, F.lit("...")) | F.contains(t, F.lit("…"))) & (F.regexp_count(t, F.lit("\\.")) > 3)
    return dotted | F.lower(t).isin(*CONTENTS)


def line_of(pattern: str) -> str:
    return f"[{INNER}]*+(?:{pattern})[{INNER}]*"


PRIVATE = [("[\\x{E000}-\\x{F8FF}\\x{F0000}-\\x{FFFFD}\\x{100000}-\\x{10FFFD}]", "")]
FURNITURE = without_lines(
    line_of(PAGE[1:-1].replace(SPACE, INNER)),
    r"[^\n]*(?i:" + "|".join(re.escape(f) for f in FOOTERS) + r")[^\n]*",
    line_of("(?i:" + "|".join(CONTENTS) + ")"),
    r"(?=[^\n]*(?:\.\.\.|…))(?:[^\n.]*\.){4}[^\n]*",
)
COLLAPSE = [*ENDS, (rf"(?md)^([{INNER}]*+)\n[{INNER}\n]*(?=\n|\z)", "$1")]
MARKS = [*without_lines(line_of("[" + re.escape(ORPHANS) + "]")), *COLLAPSE]
FINAL = [*ENDS, (rf"(?<![{INNER}])[{INNER}]++(?=\n|\z)", ""), (rf"(?<=[^{INNER}\n])[{INNER}]+", " "), (r"\A\n+|(?<!\n)\n+\z", "")]


def clean_lines(x: Column) -> Column:
    """Without page numbers, footer phrases and lines of contents; blank lines stay."""
    return replaced(x, FURNITURE)


def collapse_blank_lines(x: Column) -> Column:
    """One blank line of several."""
    return replaced(x, COLLAPSE)


def filter_structure(x: Column) -> Column:
    """Without lines that are a single mark; then blank lines are collapsed."""
    return replaced(x, MARKS)


def final_normalize(x: Column) -> Column:
    """Indents stay; runs of space inside become one, ends of lines and blank lines at both ends go."""
    return replaced(x, FINAL)


def clean_sql(x: str, how: Cleanup | str) -> str:
    """The stages after NFC as an expression of SQL."""
    how = Cleanup.named(how) if isinstance(how, str) else how
    if how.normalize:
        x = f"translate({x}, '{_FROM.replace(chr(39), chr(92) + chr(39))}', '{_TO.replace(chr(39), chr(92) + chr(39))}')"
    for on, stage in ((how.private_use, PRIVATE), (how.lines, FURNITURE), (how.structure, MARKS), (how.final, [*FINAL, *COLLAPSE])):
        x = replaced_sql(x, stage) if on else x
    return x


def split_frontmatter(x: Column) -> tuple[Column, Column]:
    """(frontmatter with its fences or null, body)."""
    at = F.locate("\n---\n", x, 4)
    has = x.startswith("---\n") & (at > 0)
    front = F.when(has, F.substring(x, F.lit(1), at + 4))
    body = F.when(has, F.regexp_replace(F.substring(x, at + 5, F.length(x)), "^\n+", "")).otherwise(x)
    return front, body


def clean_body(x: Column, how: Cleanup) -> Column:
    """The stages after NFC, on a text without its frontmatter."""
    if how.normalize:
        x = plain_characters(x)
    if how.private_use:
        x = remove_private_use(x)
    if how.lines:
        x = clean_lines(x)
    if how.structure:
        x = filter_structure(x)
    if how.final:
        x = collapse_blank_lines(final_normalize(x))
    return x


def clean_text(x: Column, how: Cleanup | str = "default") -> Column:
    """All stages that `how` asks for, in their fixed order, of a text that is NFC; `clean` does NFC too."""
    how = Cleanup.named(how) if isinstance(how, str) else how
    if not how.preserve_frontmatter:
        return clean_body(x, how)
    front, body = split_frontmatter(x)
    return F.when(front.isNotNull(), F.concat(front, F.lit("\n"), clean_body(body, how))).otherwise(clean_body(body, how))


def clean(df: DataFrame, text: str, how: Cleanup | str = "default", to: str = "cleaned") -> DataFrame:
    """df and the cleaned text: frontmatter off, NFC, the other stages, frontmatter on again. Every stage is a column
    of its own, as each is used several times in the next."""
    how = Cleanup.named(how) if isinstance(how, str) else how
    front, body = split_frontmatter(F.col(text)) if how.preserve_frontmatter else (F.lit(None).cast("string"), F.col(text))
    df = df.withColumns({"_front": front, "_body": body})
    if how.normalize:
        df = df.withColumn("_body", nfc(F.col("_body"))).withColumn("_body", plain_characters(F.col("_body")))
    stages = [remove_private_use] * how.private_use + [clean_lines] * how.lines + [filter_structure] * how.structure + [final_normalize, collapse_blank_lines] * how.final
    for stage in stages:
        df = df.withColumn("_body", stage(F.col("_body")))
    joined = F.when(F.col("_front").isNotNull(), F.concat("_front", F.lit("\n"), "_body")).otherwise(F.col("_body"))
    return df.withColumn(to, joined).drop("_front", "_body")


def mojibake(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), message: every pattern of every line; the patterns are few, so they are broadcast."""
    spark = df.sparkSession
    patterns = F.broadcast(spark.createDataFrame(MOJIBAKE, "pattern string, message string"))
    rows = df.select(key, F.posexplode(lines(F.col(text))).alias("at", "content"))
    return rows.join(patterns, F.contains("content", "pattern")).select(key, (F.col("at") + 1).alias("line"), F.format_string("Possible mojibake: %s (%s)", "pattern", "message").alias("message"))


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, f"[{SPACE}]+"), lambda w: w != ""))


def counts(x: Column) -> Column:
    """Words and bytes."""
    return F.struct(word_count(x).alias("words"), F.octet_length(x).alias("bytes"))
