"""Expressions and storage shared by the corpus operators.

Conventions of all operators here: a null text counts as the empty text; rows without an id are
kept; input columns that an operator does not name are ignored or carried unchanged, so extra
columns never clash with the columns it adds; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from candela.sources.sinks import new_folder

SPACES = r"[\x20\x09-\x0D]+"
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACES), "")


def unit(*parts: Column) -> Column:
    """Uniform number in (0, 1) from the first 52 bits of an MD5; the same in any engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def free_names(df: DataFrame, n: int) -> list[str]:
    """Column names that the rows don't have."""
    taken = {c.lower() for c in df.columns}
    return [name for name in (f"_c{i}" for i in range(n + len(taken))) if name not in taken][:n]


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the cluster's shared folder and read back: a lost executor repeats only the read."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
