"""ARFF text: header lines to a schema, data lines through the CSV reader."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTRIBUTE = r"(?i)^\s*@attribute\s+('[^']+'|\"[^\"]+\"|[^\s{]+)\s*(\{[^}]*\}|[^\s\[]+)"
NUMERIC = ("numeric", "real", "integer")
CSV_OPTIONS = {"quote": "'", "mode": "FAILFAST", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
HEADER_LINES = 100_000  # a longer header is an error


def arff_header(spark: SparkSession, path: str) -> list[tuple[str, str, list[str]]]:
    """(name, kind, declared values) per attribute, in header order, from the beginning of the first file up to @data."""
    first = min(spark.read.text(path).inputFiles())
    found = []
    for n, r in enumerate(spark.read.text(first).limit(HEADER_LINES + 1).toLocalIterator()):
        if n == HEADER_LINES and found:
            raise ValueError(f"no @data in the first {HEADER_LINES} lines of {first}")
        line = r["value"].strip()
        if line.lower().startswith("@data"):
            break
        attribute = re.match(ATTRIBUTE, line)
        if attribute:
            kind = attribute[2].strip()
            values = [_unquoted(v) for v in _split_values(kind[1:-1])] if kind.startswith("{") else []
            found.append((_unquoted(attribute[1]), "numeric" if kind.lower() in NUMERIC else "nominal", values))
    if not found:
        raise ValueError(f"no @attribute lines at the beginning of {first}; name the header file")
    return found


def _unquoted(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value


def _split_values(values: str) -> list[str]:
    """Comma-separated values, where quotes may hold commas."""
    return [m[0] for m in re.finditer(r"\s*(?:'[^']*'|\"[^\"]*\"|[^,]+)", values) if m[0].strip()]


def arff_schema(spark: SparkSession, path: str) -> T.StructType:
    """numeric, real and integer become double, everything else string."""
    return T.StructType(
        [T.StructField(n, T.DoubleType() if k == "numeric" else T.StringType(), True) for n, k, _ in arff_header(spark, path)]
    )


def read_arff(spark: SparkSession, path: str, null_value: str = "?", header: str | None = None) -> DataFrame:
    """Data lines of an ARFF file (or of a folder of them, with the header in a file of its own)."""
    schema = arff_schema(spark, header or path)
    # Header lines, % comments and empty lines are no data.
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(?:[@%]|$)"))
    return parse_stream_lines(lines, schema, null_value)


def parse_stream_lines(lines: DataFrame, schema: T.StructType, null_value: str = "?", keep: tuple[str, ...] = ()) -> DataFrame:
    """``value`` lines to typed columns; works on batch and streaming DataFrames, nothing is collected."""
    parsed = F.from_csv("value", schema.toDDL(), {"nullValue": null_value, **CSV_OPTIONS})
    out = lines.select(*keep, parsed.alias("__r"))
    plain = lambda c: F.regexp_replace(c, '^"(.*)"$', "$1")  # noqa: E731  the other kind of quotes
    fields = [(F.col("__r").getField(f.name), f) for f in schema.fields]
    return out.select(*keep, *[(plain(c) if isinstance(f.dataType, T.StringType) else c).alias(f.name) for c, f in fields])


def class_column(schema: T.StructType) -> str:
    """The class is the last attribute."""
    return schema.fieldNames()[-1]
