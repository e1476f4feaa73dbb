"""Education features of candidate documents, computed inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from candela.functions import scoring as S
from candela.functions.text import short_any_sql
from candela.functions.vocab import DEFAULT_VOCAB, Vocabulary

WORST_TIER = 4


def tier_rank_sql(ref: str) -> str:
    """``tier_1`` .. ``tier_4`` to 1 .. 4; anything else is 4."""
    return f"(CASE {ref} WHEN 'tier_1' THEN 1 WHEN 'tier_2' THEN 2 WHEN 'tier_3' THEN 3 ELSE 4 END)"


def best_entry() -> Column:
    """struct(tier, pos, degree, field): the first entry of the best tier."""
    return F.expr(f"array_min(transform(education, (e, i) -> named_struct('tier', {tier_rank_sql('e.tier')}, "
                  f"'pos', i, 'degree', e.degree, 'field', e.field_of_study)))")


def with_education_facts(df: DataFrame, vocab: Vocabulary = DEFAULT_VOCAB) -> DataFrame:
    """Best tier with its degree and field, the two flags and the education score.

    Expects ``has_ai_certification``.
    """
    lowered = df.withColumns({
        "_best": best_entry(),
        "_fields": F.expr("transform(education, e -> lower(e.field_of_study))"),
        "_degrees": F.expr("transform(education, e -> lower(e.degree))"),
    })
    ranked = F.coalesce(F.col("_best.tier") < WORST_TIER, F.lit(False))
    none = F.size("education") == 0
    facts = lowered.withColumns({
        "best_tier": F.coalesce(F.col("_best.tier"), F.lit(WORST_TIER)),
        "highest_degree": F.when(none, "Unknown").when(ranked, F.col("_best.degree")).otherwise(""),
        "field_of_study": F.when(ranked, F.col("_best.field")).otherwise(""),
        "has_stem_degree": F.expr(f"exists(_fields, f -> {short_any_sql('f', vocab.stem)})"),
        "has_advanced_degree": F.expr(f"exists(_degrees, d -> {short_any_sql('d', vocab.advanced_degree)})"),
    })
    return facts.withColumn("education_score", S.education_score(
        F.size("education"), F.col("best_tier"), F.col("has_stem_degree"),
        F.col("has_advanced_degree"), F.col("has_ai_certification"))).drop("_best", "_fields", "_degrees")
