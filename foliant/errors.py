"""Error kinds as a stable numbering; parse failures are rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of errors.
KINDS = {
    "Other": 1,
    "Io": 2,
    "UnknownFormat": 3,
    "UnsupportedFormat": 4,
    "ZipArchive": 5,
    "XmlParse": 6,
    "InvalidData": 7,
    "MissingComponent": 8,
    "Encoding": 9,
    "StyleNotFound": 10,
    "ResourceNotFound": 11,
    "Encrypted": 12,
    "Render": 13,
}


class OfficeError(Exception):
    def __init__(self, name: str, message: str, part: str = ""):
        super().__init__(message)
        self.name, self.message, self.part = name, message, part
        self.kind = KINDS[name]


def strict(df: DataFrame, error: str = "error") -> DataFrame:
    """Fail the query at the first row with an error; without it, such rows stay (lenient)."""
    message = F.concat_ws(": ", F.col(f"{error}.name"), F.col(f"{error}.message"), F.col(f"{error}.part"))
    checked: Column = F.when(F.col(error).isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return df.where(checked)
