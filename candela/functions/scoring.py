"""Scalar scoring expressions (numbers and dates)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: scoring constants
UNKNOWN_DAYS = 999
TIER_SCORE = {1: 1.0, 2: 0.8, 3: 0.55, 4: 0.35}
PROFICIENCY_DEPTH = {"beginner": 0.25, "intermediate": 0.50, "advanced": 0.85, "expert": 1.0}
PROFICIENCY_REPEAT = {"beginner": 1, "intermediate": 2, "advanced": 3, "expert": 4}
SCORE_BANDS = ((0.75, "excellent"), (0.55, "good"), (0.35, "fair"))
LAST_BAND = "low"


def one() -> Column:
    return F.lit(1.0)


def cap(col: Column) -> Column:
    return F.least(one(), col)


def as_flag(col: Column) -> Column:
    """Boolean to 0.0 / 1.0, null to 0.0."""
    return F.when(col, one()).otherwise(F.lit(0.0))


def years_score(years: Column, lo: Column, hi: Column,
                rec_lo: Column | None = None, rec_hi: Column | None = None) -> Column:
    """Trapezoid over the recommended (else stated) range of years."""
    low = F.coalesce(rec_lo, lo) if rec_lo is not None else lo
    high = F.coalesce(rec_hi, hi) if rec_hi is not None else hi
    short = F.greatest(F.lit(0.0), one() - (low - years) / F.greatest(low, F.lit(3.0)))
    over = F.greatest(F.lit(0.5), one() - (years - high) * F.lit(0.06))
    return F.when((years >= low) & (years <= high), one()).when(years < low, short).otherwise(over)


def parse_day(col: Column) -> Column:
    """ISO day text to DATE, null when it is no such day."""
    return F.try_to_date(col, "yyyy-M-d")


def days_since(day_text: Column, as_of: Column) -> Column:
    """Whole days before ``as_of``; 999 when the text is no date."""
    return F.coalesce(F.datediff(as_of, parse_day(day_text)), F.lit(UNKNOWN_DAYS))


def recency_score(days: Column, half_life: float = 90.0) -> Column:
    return F.exp(-F.ln(F.lit(2.0)) * days / F.lit(float(half_life)))


def notice_score(days: Column, preferred: int = 30, longest: int = 150) -> Column:
    slope = one() - (days - F.lit(preferred)) / F.lit(float(longest - preferred) or 1.0)
    return F.when(days <= preferred, one()).when(days >= longest, F.lit(0.0)).otherwise(slope)


def behavior_score(response: Column, interview: Column, recency: Column,
                   notice: Column, open_to_work: Column) -> Column:
    return cap(0.25 * response + 0.20 * interview + 0.25 * recency
               + 0.20 * notice + 0.10 * as_flag(open_to_work))


def github_norm(raw: Column) -> Column:
    """Sentinel -1 (not linked) scores 0."""
    return F.when(raw >= 0, raw / 100.0).otherwise(F.lit(0.0))


def trust_score(completeness: Column, verified: Column, github: Column, endorsements: Column) -> Column:
    """``completeness`` and ``github`` are already in [0, 1]; ``verified`` counts 0-3."""
    social = endorsements / F.greatest(endorsements + 10.0, F.lit(10.0))
    return cap(0.35 * completeness + 0.25 * (verified / 3.0) + 0.25 * github + 0.15 * social)


def company_quality(consulting_only: Column, startup: Column, product_months: Column) -> Column:
    grown = 0.55 + F.least(F.lit(0.30), product_months / 120.0)
    return cap(F.when(consulting_only, F.lit(0.25)).when(startup, F.lit(0.70)).otherwise(grown))


def progression(leadership: Column, consulting_only: Column) -> Column:
    base = F.when(leadership, F.lit(0.85)).otherwise(F.lit(0.6))
    return F.when(consulting_only, base * 0.6).otherwise(base)


def technical_score(req_ratio: Column, domain_mean: Column, depth: Column,
                    pref_ratio: Column, cert: Column) -> Column:
    return cap(0.45 * req_ratio + 0.30 * domain_mean + 0.15 * depth
               + 0.10 * pref_ratio + 0.05 * as_flag(cert))


def experience_score(years: Column, ai_ratio: Column, quality: Column,
                     progress: Column, consulting_only: Column) -> Column:
    blend = 0.40 * years + 0.25 * ai_ratio + 0.20 * quality + 0.15 * progress
    return cap(F.when(consulting_only, blend * 0.65).otherwise(blend))


def ai_year_ratio(ai_years: Column, total_years: Column) -> Column:
    return cap(ai_years / F.greatest(total_years, F.lit(0.1)))


def education_score(entries: Column, tier: Column, stem: Column, advanced: Column, cert: Column) -> Column:
    """0.3 flat without any entry."""
    by_tier = F.element_at(F.create_map(*[F.lit(x) for kv in TIER_SCORE.items() for x in kv]), tier)
    full = (0.55 * by_tier + F.when(stem, F.lit(0.20)).otherwise(F.lit(0.0))
            + F.when(advanced, F.lit(0.15)).otherwise(F.lit(0.0))
            + F.when(cert, F.lit(0.10)).otherwise(F.lit(0.0)))
    return F.when(entries == 0, F.lit(0.3)).otherwise(full)


def salary_inverted(low: Column, high: Column) -> Column:
    return F.coalesce(low > high, F.lit(False))


def date_inverted(signup: Column, last_active: Column) -> Column:
    return F.coalesce(parse_day(signup) > parse_day(last_active), F.lit(False))


def experience_anomaly(career_months: Column, declared_years: Column) -> Column:
    return career_months / 12.0 > declared_years + 2.5


def keyword_stuffing(ai_skills: Column, ai_role_now: Column) -> Column:
    return F.when((ai_skills >= 8) & ~ai_role_now, cap((ai_skills - 6) / 10.0)).otherwise(F.lit(0.0))


def honeypot_probability(salary: Column, dates: Column, anomaly: Column, stuffing: Column) -> Column:
    return cap(0.40 * as_flag(salary) + 0.35 * as_flag(dates) + 0.15 * as_flag(anomaly) + 0.10 * stuffing)


def score_band(score: Column) -> Column:
    ladder = F.when(score >= SCORE_BANDS[0][0], SCORE_BANDS[0][1])
    for floor, name in SCORE_BANDS[1:]:
        ladder = ladder.when(score >= floor, name)
    return ladder.otherwise(LAST_BAND)
