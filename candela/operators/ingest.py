"""Validation, quarantine and load summary of raw JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from candela.sources.contract import (MAX_MESSAGES, RULES, Obj, add_violations, candidate_contract,
                                      messages_sql, model_contract)
from candela.sources.readers import parse_cast, parse_typed
from candela.sources.schema import SIGNALS_KEY, candidate_ddl

# fixed values: names of the error types
JSON_ERROR = "JSONDecodeError"
STRUCTURE_ERROR = "StructureError"
SCHEMA_ERROR = "SchemaValidation"
MODEL_ERROR = "PydanticValidation"


def parse_json(lines: DataFrame) -> DataFrame:
    """Add ``v``: the VARIANT of ``value``, null when it is not JSON.

    Of a repeated key the last value counts, as in most JSON readers; Spark takes this from the session, where it is set.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return lines.withColumn("v", F.try_parse_json("value"))


def check_root_object(parsed: DataFrame) -> DataFrame:
    """Add ``root_type`` (null when unparsed) and ``is_object``."""
    opener = F.substring(F.ltrim("value"), 1, 1)  # telling kinds apart needs no walk through the document
    kind = F.when(F.col("v").isNotNull(), F.when(opener == "{", "OBJECT").when(opener == "[", "ARRAY")
                  .otherwise(F.regexp_extract(F.schema_of_variant("v"), r"^[A-Z]+", 0)))
    return parsed.withColumn("root_type", kind).withColumn("is_object", F.coalesce(kind == "OBJECT", F.lit(False)))


def with_violations(parsed: DataFrame, contract: Obj, rules: tuple[str, ...] = RULES,
                    lenient: bool = False, name: str = "violations") -> DataFrame:
    """Add the array of violated rules; empty for anything that is no object."""
    return add_violations(parsed, contract, lenient, rules, name)


def collect_violations(checked: DataFrame, max_errors: int = MAX_MESSAGES) -> DataFrame:
    """Add ``messages``: ``[path] text`` in path order, at most ``max_errors``."""
    return checked.withColumn("messages", F.expr(messages_sql("violations", max_errors)))


def classify(lines: DataFrame, validate: bool = True, max_errors: int = MAX_MESSAGES,
             signals_key: str = SIGNALS_KEY) -> DataFrame:
    """One row per line with ``candidate_id, error_type, messages, n_violations``; valid rows have a null type.

    ``messages`` holds the first ``max_errors``, ``n_violations`` counts all.

    The first failing stage decides: JSON, then root object, then contract (or, with
    ``validate=False``, only the looser record model with lenient casts).
    """
    contract = candidate_contract(signals_key) if validate else model_contract(signals_key)
    checked = collect_violations(
        with_violations(check_root_object(parse_json(lines)), contract, lenient=not validate), max_errors)
    stage = (F.when(F.col("v").isNull(), JSON_ERROR)
             .when(~F.col("is_object"), STRUCTURE_ERROR)
             .when(F.size("violations") > 0, SCHEMA_ERROR if validate else MODEL_ERROR))
    text = (F.when(F.col("v").isNull(), F.array(F.lit("line is not valid JSON")))
            .when(~F.col("is_object"), F.array(F.concat(F.lit("Expected JSON object, got "), F.lower("root_type"))))
            .otherwise(F.coalesce("messages", F.array().cast("array<string>"))))
    ident = F.when(F.col("is_object"), F.expr("try_variant_get(v, '$.candidate_id', 'string')"))
    # One generated row per line: a later filter on these columns stays above it.  As a plain
    # projection it would be pushed down and repeat every check inside the filter.
    verdict = F.struct(ident.alias("candidate_id"), stage.alias("error_type"), text.alias("messages"),
                       F.coalesce(F.size("violations"), F.lit(0)).alias("n_violations"))
    return checked.select(*lines.columns, F.inline_outer(F.array(verdict)))


def split_valid_quarantine(classified: DataFrame, signals_key: str = SIGNALS_KEY, validate: bool = True,
                           keep_raw: bool = False) -> tuple[DataFrame, DataFrame]:
    """(typed valid documents, quarantine rows) of a classified table.

    With ``validate=False``, as given to ``classify``, text that stands for a number or a flag is cast. ``keep_raw``
    keeps the line in ``value``, with keys that the contract does not name.

    Both sides filter the same input; write the classified table once (see
    ``sinks.write_ingest``) when both are needed.
    """
    passed = classified.filter(F.col("error_type").isNull()).select("value")
    typed = (parse_typed if validate else parse_cast)(passed, candidate_ddl(signals_key))
    valid = apply_defaults(typed, signals_key)
    valid = valid if keep_raw else valid.drop("value")
    return valid, classified.filter(F.col("error_type").isNotNull())


def load_summary(classified: DataFrame) -> DataFrame:
    """Total, valid and invalid lines, and the success rate (0 when there are none)."""
    ok = F.col("error_type").isNull()
    counts = classified.agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"),
                            F.count_if(~ok).alias("invalid"))
    rate = F.coalesce(F.try_divide(F.col("valid"), F.col("total")), F.lit(0.0))
    return counts.withColumn("success_rate", rate)


def apply_defaults(docs: DataFrame, signals_key: str = SIGNALS_KEY) -> DataFrame:
    """Missing optional lists become empty, a missing assessment map too."""
    lists = {c: F.coalesce(F.col(c), F.expr(f"cast(array() AS {dict(docs.dtypes)[c]})"))
             for c in ("education", "skills", "certifications", "languages")}
    scores = F.coalesce(F.col(f"{signals_key}.skill_assessment_scores"),
                        F.expr("cast(map() AS map<string,double>)"))
    return docs.withColumns({
        **lists,
        signals_key: F.col(signals_key).withField("skill_assessment_scores", scores),
    })


def limit_valid(docs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` valid documents in id order (a top-n, no global sort)."""
    return docs.orderBy("candidate_id").limit(n)


def sample_errors(quarantine: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` error rows by file and line text, for a report."""
    return quarantine.orderBy("source_file", "value").limit(n)


def errors_left(quarantine: DataFrame, n: int = 20) -> DataFrame:
    """``shown, more``: how many error rows :func:`sample_errors` gives, and how many more there are."""
    total = F.count(F.lit(1))
    return quarantine.agg(F.least(total, F.lit(n)).cast("long").alias("shown"), F.greatest(total - n, F.lit(0)).cast("long").alias("more"))
