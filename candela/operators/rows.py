"""The nested-array aggregates over flat tables.

Same results as the document form in ``skills``, ``career`` and ``education``, for data that
is already one row per skill, job or school.  All are plain aggregates with partial merge,
so a key that holds a third of the rows is reduced before the shuffle; nothing is ever
collected into a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from candela.functions.scoring import PROFICIENCY_DEPTH
from candela.functions.text import vocab_any
from candela.functions.vocab import DEFAULT_VOCAB, Vocabulary
from candela.operators.skills import FULL_DEPTH, MONTHS_BONUS_CAP


def _sum_if(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value).otherwise(F.lit(0.0)))


def skill_rollup(rows: DataFrame, key: str, name: str, proficiency: str, months: str,
                 vocab: Vocabulary = DEFAULT_VOCAB) -> DataFrame:
    """``ai_skill_depth`` and ``stuffing_skills`` per key."""
    low = rows.withColumn("_n", F.lower(name))
    flagged = low.withColumns({"_deep": vocab_any("_n", vocab.depth_terms), "_ai": vocab_any("_n", vocab.stuffing_terms)})
    level = F.lit(0.25)
    for word, weight in PROFICIENCY_DEPTH.items():
        level = F.when(F.col(proficiency) == word, F.lit(weight)).otherwise(level)
    bonus = F.least(F.lit(MONTHS_BONUS_CAP), F.coalesce(F.col(months), F.lit(0)) / 60.0)
    return flagged.groupBy(key).agg(
        F.least(F.lit(1.0), _sum_if(F.col("_deep"), level + bonus) / FULL_DEPTH).alias("ai_skill_depth"),
        F.count_if("_ai").alias("stuffing_skills"))


def certification_rollup(rows: DataFrame, key: str, name: str, vocab: Vocabulary = DEFAULT_VOCAB) -> DataFrame:
    low = rows.withColumn("_n", F.lower(name)).withColumn("_c", vocab_any("_n", vocab.certifications))
    return low.groupBy(key).agg(F.bool_or("_c").alias("has_ai_certification"))


def career_rollup(rows: DataFrame, key: str, company: str, title: str, industry: str, months: str,
                  size: str, vocab: Vocabulary = DEFAULT_VOCAB) -> DataFrame:
    """All career features per key."""
    low = rows.withColumns({"_t": F.lower(title), "_i": F.lower(industry), "_f": F.lower(F.trim(company)),
                            "_m": F.coalesce(F.col(months).cast("double"), F.lit(0.0))})
    flagged = low.withColumns({
        "_ai": vocab_any("_t", vocab.ai_title) | vocab_any("_i", vocab.ai_industry),
        "_con": vocab_any("_f", vocab.consulting),
        "_prod": vocab_any("_f", vocab.product),
        "_start": F.coalesce(F.col(size).isin(*vocab.startup_sizes), F.lit(False)) | vocab_any("_f", vocab.startup),
        "_lead": vocab_any("_t", vocab.leadership),
    })
    m = F.col("_m")
    product = (F.col("_prod") | ~F.col("_con")) & F.coalesce(F.col(size) != "1-10", F.lit(True))
    return flagged.groupBy(key).agg(
        F.sum(m).alias("career_months"),
        F.round(_sum_if(F.col("_ai"), m) / 12.0, 1).alias("ai_years"),
        _sum_if(product, m).alias("product_months"),
        F.bool_and("_con").alias("consulting_only"),
        F.bool_or("_start").alias("startup_experience"),
        F.bool_or("_lead").alias("leadership_role"))


def education_rollup(rows: DataFrame, key: str, tier: str, pos: str, degree: str, field: str,
                     vocab: Vocabulary = DEFAULT_VOCAB) -> DataFrame:
    """Best tier with its degree and field, and the two flags, per key."""
    rank = F.when(F.col(tier) == "tier_1", 1).when(F.col(tier) == "tier_2", 2).when(F.col(tier) == "tier_3", 3).otherwise(4)
    low = rows.withColumns({"_d": F.lower(degree), "_f": F.lower(field), "_rank": rank})
    flagged = low.withColumns({"_stem": vocab_any("_f", vocab.stem), "_adv": vocab_any("_d", vocab.advanced_degree)})
    best = flagged.groupBy(key).agg(
        F.min(F.struct("_rank", F.col(pos).alias("p"), F.col(degree).alias("d"), F.col(field).alias("f"))).alias("_b"),
        F.bool_or("_stem").alias("has_stem_degree"), F.bool_or("_adv").alias("has_advanced_degree"))
    ranked = F.col("_b._rank") < 4
    return best.select(key, F.col("_b._rank").alias("best_tier"),
                       F.when(ranked, F.col("_b.d")).otherwise("").alias("highest_degree"),
                       F.when(ranked, F.col("_b.f")).otherwise("").alias("field_of_study"),
                       "has_stem_degree", "has_advanced_degree")
