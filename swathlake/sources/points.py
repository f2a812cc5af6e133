"""Point files: delimiter and header are told from the first lines, columns are named by position."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sniff(sample: str) -> tuple[str, bool]:
    """(delimiter, whether the first line is a header) of the beginning of a file."""
    try:
        delimiter = csv.Sniffer().sniff(sample, ", ;\t|").delimiter
    except csv.Error:
        delimiter = ","
    first = next(csv.reader(io.StringIO(sample), delimiter=delimiter), [])

    def number(x: str) -> bool:
        try:
            float(x)
        except ValueError:
            return False
        return True

    return delimiter, bool(first) and not any(number(x) for x in first)


def read_points(spark: SparkSession, path: str, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Points of text files that share one layout; rows that aren't numbers are left out."""
    lines = [r[0] for r in spark.read.text(path).limit(20).collect()]
    delimiter, header = sniff("\n".join(lines))
    t = spark.read.option("sep", delimiter).option("header", False).schema(", ".join(f"{c} string" for c in columns)).csv(path)
    t = t.select(*[F.col(c).try_cast("double").alias(c) for c in columns])
    return t.where(" and ".join(f"{c} is not null" for c in columns[:3])) if header or columns else t


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """A table of already decoded records (pings, soundings, attitude, navigation) in Parquet."""
    return spark.read.parquet(path)


def validate(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """What is wrong with a decoded record table: missing columns and other types."""
    have = dict(df.dtypes)
    return [f"{c} is missing" for c in expected if c not in have] + [f"{c} is {have[c]}, not {t}" for c, t in expected.items() if c in have and have[c] != t]
