"""Career features of candidate documents, computed inside the row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from candela.functions import scoring as S
from candela.functions.text import short_any_sql, sql_string
from candela.functions.vocab import DEFAULT_VOCAB, Vocabulary

TINY_SIZE = "1-10"  # fixed value: size that never counts as product company


def with_career_facts(df: DataFrame, vocab: Vocabulary = DEFAULT_VOCAB) -> DataFrame:
    """Months, AI years, product months and the three career flags."""
    sizes = ", ".join(sql_string(s) for s in vocab.startup_sizes)
    lowered = df.withColumn("_jobs", F.expr(
        "transform(career_history, j -> named_struct('title', lower(j.title), 'industry', lower(j.industry), "
        "'firm', lower(trim(j.company)), 'months', coalesce(j.duration_months, 0D), 'size', j.company_size))")
    ).withColumn("_title", F.lower("profile.current_title"))
    facts = lowered.withColumn("_jobs", F.expr(f"""transform(_jobs, j -> named_struct(
        'ai', {short_any_sql('j.title', vocab.ai_title)} OR {short_any_sql('j.industry', vocab.ai_industry)},
        'consulting', {short_any_sql('j.firm', vocab.consulting)},
        'product', {short_any_sql('j.firm', vocab.product)},
        'startup', coalesce(j.size IN ({sizes}), false) OR {short_any_sql('j.firm', vocab.startup)},
        'lead', {short_any_sql('j.title', vocab.leadership)},
        'tiny', coalesce(j.size = '{TINY_SIZE}', false),
        'months', j.months))"""))
    months = lambda cond: f"aggregate(_jobs, 0D, (a, j) -> a + CASE WHEN {cond} THEN j.months ELSE 0D END)"
    return facts.withColumns({
        "career_months": F.expr(months("true")),
        "ai_years": F.round(F.expr(months("j.ai")) / 12.0, 1),
        "product_months": F.expr(months("(j.product OR NOT j.consulting) AND NOT j.tiny")),
        "consulting_only": F.expr("size(_jobs) > 0 AND forall(_jobs, j -> j.consulting)"),
        "startup_experience": F.expr("exists(_jobs, j -> j.startup)"),
        "leadership_role": F.expr(f"{short_any_sql('_title', vocab.leadership)} OR exists(_jobs, j -> j.lead)"),
    }).drop("_jobs", "_title")


def with_ai_role_now(df: DataFrame, vocab: Vocabulary = DEFAULT_VOCAB) -> DataFrame:
    """TRUE when the current title or industry is an AI one."""
    lowered = df.withColumns({"_t": F.lower("profile.current_title"), "_i": F.lower("profile.current_industry")})
    test = f"{short_any_sql('_t', vocab.ai_title)} OR {short_any_sql('_i', vocab.ai_industry)}"
    return lowered.withColumn("ai_role_now", F.expr(test)).drop("_t", "_i")


def with_company_scores(df: DataFrame) -> DataFrame:
    """Ratio of AI years, company quality and progression from the career facts."""
    years = F.col("profile.years_of_experience")
    return df.withColumns({
        "ai_year_ratio": S.ai_year_ratio(F.col("ai_years"), years),
        "company_quality": S.company_quality(F.col("consulting_only"), F.col("startup_experience"), F.col("product_months")),
        "career_progression": S.progression(F.col("leadership_role"), F.col("consulting_only")),
    })
