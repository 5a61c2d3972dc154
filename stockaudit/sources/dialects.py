"""How each CSV file of an extract is written: separator, decimal sign, encoding and header.

A file's beginning tells. Files of one dialect and one header are read together, so an extract may mix them.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, SparkSession, functions as F

# Separators an extract may have, the likeliest first.
SEPARATORS = (",", ";", "\t", "|")
# Bytes of a file that are looked at, and files that are looked at together.
HEAD_BYTES = 1 << 16
OPEN_FILES = 16
BYTE_ORDER_MARK = "\ufeff"
# A fraction written with one sign or the other, thousands apart or not.
COMMA_FRACTION = re.compile(r"\s*[+-]?(\d+|\d{1,3}(\.\d{3})+),\d+\s*")
POINT_FRACTION = re.compile(r"\s*[+-]?(\d+|\d{1,3}(,\d{3})+)\.\d+\s*")
# Thousands apart, by the decimal sign that goes with them, and the sign between them.
GROUPED = {".": r"^[+-]?\d{1,3}(,\d{3})+(\.\d*)?$", ",": r"^[+-]?\d{1,3}(\.\d{3})+(,\d*)?$"}
OTHER_SIGN = {".": ",", ",": "."}


@dataclass(frozen=True)
class Dialect:
    """What a file needs to be read, and its column names."""

    separator: str
    decimal: str
    encoding: str
    header: tuple[str, ...]


def separator_of(line: str) -> str:
    """The separator that occurs most often in a header line, outside quotes; a comma if none does."""
    bare = re.sub(r'"[^"]*"', "", line)
    return max(SEPARATORS, key=bare.count)


def _encoding_of(head: bytes) -> str:
    for cut in range(4):
        # The last character of the head may be cut off.
        try:
            head[: len(head) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    return "ISO-8859-1"


def _decimal_of(rows: list[list[str]], separator: str) -> str:
    """The sign that more fields of the head are written with; a tie goes by what the separator leaves."""
    fields = [field for row in rows for field in row]
    commas = sum(COMMA_FRACTION.fullmatch(field) is not None for field in fields)
    points = sum(POINT_FRACTION.fullmatch(field) is not None for field in fields)
    if commas == points:
        return "," if separator == ";" else "."
    return "," if commas > points else "."


def dialect_of(head: bytes, separator: str | None = None, encoding: str | None = None, decimal: str | None = None) -> Dialect:
    """The dialect of a file that begins with ``head``, with what the caller knows taken as given."""
    encoding = encoding or _encoding_of(head)
    lines = head.decode(encoding, errors="ignore").removeprefix(BYTE_ORDER_MARK).splitlines()
    separator = separator or separator_of(lines[0] if lines else "")
    # The last line of a full head may be cut off.
    whole = lines[:-1] if len(head) >= HEAD_BYTES and len(lines) > 1 else lines
    rows = [row for row in csv.reader(whole, delimiter=separator) if row]
    return Dialect(separator, decimal or _decimal_of(rows[1:], separator), encoding, tuple(rows[0]) if rows else ())


def _heads(spark: SparkSession, paths: Sequence[str]) -> list[bytes]:
    """The first bytes of each file, read through the file system that Spark reads it with."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def head(path: str) -> bytes:
        file = jvm.org.apache.hadoop.fs.Path(path)
        stream = file.getFileSystem(conf).open(file)
        try:
            return bytes(stream.readNBytes(HEAD_BYTES))
        finally:
            stream.close()

    with ThreadPoolExecutor(OPEN_FILES) as pool:
        return list(pool.map(head, paths))


def files_by_dialect(
    spark: SparkSession, path: str | Sequence[str], separator: str | None = None, encoding: str | None = None,
    decimal: str | None = None,
) -> dict[Dialect, list[str]]:
    """The files below ``path`` (files, folders or patterns), grouped by how they are written; empty files are left out."""
    # Spark lists them, so folders, patterns and hidden files mean what they mean to its readers.
    files = sorted(unquote(file) for file in spark.read.text(path).inputFiles())
    groups: dict[Dialect, list[str]] = {}
    for file, head in zip(files, _heads(spark, files)):
        dialect = dialect_of(head, separator, encoding, decimal)
        if dialect.header:
            groups.setdefault(dialect, []).append(file)
    return groups


def plain_number(text: Column, decimal: str) -> Column:
    """A number as written with ``decimal``, with a point and without signs between thousands.

    A field that has no ``decimal`` stays as it is, unless its other signs part thousands.
    """
    bare = F.trim(text)
    joined = F.replace(bare, F.lit(OTHER_SIGN[decimal]), F.lit(""))
    grouped = F.when(bare.rlike(GROUPED[decimal]), joined).otherwise(bare)
    return F.replace(grouped, F.lit(","), F.lit(".")) if decimal == "," else grouped
