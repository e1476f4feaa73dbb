"""Text and JSON sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from candela.sources.json_arrays import read_json_array

# fixed values: the white space characters
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of JSONL files: ``source_file, value``.

    Blank lines are dropped before parsing, so they are never counted.  Bytes that are
    not UTF-8 come out as replacement characters.
    """
    return clean_lines(spark.read.text(path).withColumn("source_file", F.col("_metadata.file_name")))


def clean_lines(raw: DataFrame) -> DataFrame:
    """Trim lines and drop blank ones; expects ``value`` and keeps the other columns."""
    return raw.withColumn("value", F.btrim("value", F.lit(BLANKS))).filter(F.col("value") != "")


def read_documents_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """One JSON object per line, typed by ``ddl``; the raw line stays in ``value``."""
    return parse_typed(read_lines(spark, path), ddl)


def parse_typed(lines: DataFrame, ddl: str) -> DataFrame:
    """Typed columns from the JSON in ``value``."""
    record = F.from_json("value", ddl, {"mode": "PERMISSIVE"})
    return lines.withColumn("_rec", record).select(*lines.columns, "_rec.*")


def parse_cast(lines: DataFrame, ddl: str) -> DataFrame:
    """Like ``parse_typed``, but text is cast to the declared type; what does not cast is null."""
    record = F.expr(f"try_variant_get(try_parse_json(value), '$', 'STRUCT<{ddl}>')")
    return lines.withColumn("_rec", record).select(*lines.columns, "_rec.*")


def read_documents_json_array(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Typed elements of JSON array files."""
    return parse_typed(read_json_array(spark, path), ddl)
