"""Human-readable notes and the one-line reasoning of shortlisted rows.

Each rule gives struct(dimension, sentiment, message, impact) or null.  Run these after
the top-k, so they touch only the shortlisted rows.  All impacts are rounded to 4 places;
equal impacts keep rule order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from candela.config import EngineConfig
from candela.functions.text import fixed, percent

NOTE_DDL = "array<struct<dimension: string, sentiment: string, message: string, impact: double>>"
SHOWN_NAMES = 4
POSITIVE, NEUTRAL, NEGATIVE = "positive", "neutral", "negative"

# fixed values: note texts
DOMAIN_NOTES = {
    "has_python": "Strong Python skills",
    "has_embeddings": "Embeddings / semantic search experience",
    "has_retrieval": "Information retrieval / ranking experience",
    "has_vector_db": "Vector database experience",
    "has_llm": "LLM / generative AI experience",
    "has_evaluation_metrics": "Experience with ranking evaluation metrics",
}
DASH = " — "


def text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def note(dimension: str, sentiment: str, message: Column | str, impact: Column) -> Column:
    return F.struct(F.lit(dimension).alias("dimension"), F.lit(sentiment).alias("sentiment"),
                    text(message).alias("message"), F.round(impact, 4).cast("double").alias("impact"))


def ladder(*arms: tuple[Column | None, Column]) -> Column:
    """First arm whose condition holds; a final arm without condition is the default, else null."""
    out = None
    for cond, value in arms:
        if cond is None:
            return value if out is None else out.otherwise(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out
    return out


def notes(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def base(dimension: str, weights: dict[str, float]) -> Column:
    return F.round(F.col(dimension) * F.lit(weights[dimension]), 4)


def whole(col: Column) -> Column:
    return col.cast("bigint").cast("string")


def semantic_notes(w: dict[str, float]) -> Column:
    s, b = F.col("semantic"), base("semantic", w)
    d = "semantic"
    return notes(ladder(
        (s >= 0.80, note(d, POSITIVE, "Very high semantic similarity to the job profile", b)),
        (s >= 0.65, note(d, POSITIVE, "Good semantic alignment with the job requirements", b)),
        (s >= 0.50, note(d, NEUTRAL, "Moderate semantic match to the job profile", b)),
        (None, note(d, NEGATIVE, text("Low semantic similarity (", percent(s), f"){DASH}profile language diverges from JD"), -b))))


def technical_notes(w: dict[str, float]) -> Column:
    d, b = "technical", base("technical", w)
    hit = F.size("matched_required")
    total = F.greatest(hit + F.size("unmatched_required"), F.lit(1))
    share = lambda part: hit >= total * part
    counted = text("Matched ", whole(hit), " of ", whole(total), " required skills")
    names = lambda c: F.array_join(F.slice(c, 1, SHOWN_NAMES), ", ")
    missing = text("Only ", whole(hit), "/", whole(total), " required skills matched; missing: ", names("unmatched_required"))
    required = ladder(
        (hit == total, note(d, POSITIVE, text("Matched all ", whole(hit), " required skills"), b)),
        (share(0.75), note(d, POSITIVE, counted, b * 0.8)),
        (share(0.5), note(d, NEUTRAL, counted, b * 0.5)),
        (None, note(d, NEGATIVE, missing, -b * 0.5)))
    extra = F.size("matched_preferred")
    preferred = F.when(extra > 0, note(d, POSITIVE, text(
        "Also has ", whole(extra), " preferred skill(s): ", names("matched_preferred")), b * 0.2))
    domains = [F.when(F.col(flag) > 0, note(d, POSITIVE, label, b * 0.08)) for flag, label in DOMAIN_NOTES.items()]
    cert = F.when(F.col("has_ai_certification"), note(d, POSITIVE, "Holds an AI/ML certification", b * 0.05))
    return notes(required, preferred, *domains, cert)


def experience_notes(w: dict[str, float]) -> Column:
    d, b, e = "experience", base("experience", w), F.col("experience")
    years = fixed(F.col("total_years"), 1)
    ai = F.col("ai_years")
    ai_text = fixed(ai, 1)
    return notes(
        ladder((e >= 0.85, note(d, POSITIVE, text("Experience (", years, " yrs) closely matches target range"), b)),
               (e >= 0.65, note(d, NEUTRAL, text("Experience (", years, " yrs) is within acceptable range"), b)),
               (None, note(d, NEGATIVE, text("Experience (", years, " yrs) may be outside the ideal range"), -b * 0.5))),
        ladder((ai >= 3.0, note(d, POSITIVE, text("Strong applied AI/ML experience (", ai_text, " years)"), b * 0.6)),
               (ai >= 1.0, note(d, NEUTRAL, text("Some AI/ML experience (", ai_text, " years)"), b * 0.25))),
        F.when(F.col("consulting_only"), note(
            d, NEGATIVE, "Entire career at consulting / services firms (negative signal for this role)", -b * 0.55)),
        F.when(F.col("startup_experience"), note(d, POSITIVE, "Has startup / early-stage company experience", b * 0.15)),
        F.when(F.col("leadership_role"), note(
            d, POSITIVE, "Has held or currently holds a leadership / senior role", b * 0.12)))


def behavior_notes(w: dict[str, float], config: EngineConfig = EngineConfig()) -> Column:
    d, b = "behavior", base("behavior", w)
    rate, days, notice = F.col("recruiter_response_rate"), F.col("days_since_active"), F.col("notice_period_days")
    ago, wait = whole(days), whole(notice)
    return notes(
        ladder((rate >= 0.7, note(d, POSITIVE, text("Excellent recruiter response rate (", percent(rate), ")"), b)),
               (rate >= 0.4, note(d, NEUTRAL, text("Moderate recruiter response rate (", percent(rate), ")"), b * 0.5)),
               (None, note(d, NEGATIVE, text("Low recruiter response rate (", percent(rate), f"){DASH}may be hard to reach"), -b * 0.4))),
        ladder((days <= 7, note(d, POSITIVE, "Active on platform within the last 7 days", b * 0.3)),
               (days <= 30, note(d, POSITIVE, text("Recently active (", ago, " days ago)"), b * 0.3)),
               (days <= 90, note(d, NEUTRAL, text("Last active ", ago, " days ago"), b * 0.3)),
               (None, note(d, NEGATIVE, text("Inactive for ", ago, f" days{DASH}availability uncertain"), -b * 0.3))),
        F.when(F.col("open_to_work"), note(d, POSITIVE, "Actively open to work", b * 0.2)),
        ladder((notice <= config.notice_preferred_days, note(
                   d, POSITIVE, text("Short notice period (", wait, f" days){DASH}can join quickly"), b * 0.2)),
               (notice > 90, note(d, NEGATIVE, text("Long notice period (", wait, " days)"), -b * 0.15))))


def trust_notes(w: dict[str, float]) -> Column:
    d, b = "trust", base("trust", w)
    full, seen, git = F.col("profile_completeness"), F.col("verifications"), F.col("github_score")
    return notes(
        ladder((full >= 0.85, note(d, POSITIVE, text("High profile completeness (", percent(full), ")"), b * 0.4)),
               (full < 0.50, note(d, NEGATIVE, text("Low profile completeness (", percent(full), ")"), -b * 0.3))),
        ladder((seen == 3, note(d, POSITIVE, "Fully verified (email, phone, LinkedIn)", b * 0.35)),
               (seen >= 2, note(d, NEUTRAL, text("Partially verified (", whole(seen), "/3 signals)"), b * 0.15))),
        ladder((F.col("has_github") & (git >= 0.5), note(
                   d, POSITIVE, text("Active GitHub presence (score: ", percent(git), ")"), b * 0.25)),
               (~F.col("has_github"), note(d, NEUTRAL, "No GitHub linked", F.lit(0.0)))))


def risk_notes() -> Column:
    d, p, hp, stuffed = "risk", F.col("risk_penalty"), F.col("honeypot_probability"), F.col("stuffing_score")
    flags = text("Flags: ", F.array_join("risk_flags", "; "))
    clean = (p == 0.0) & (F.size("risk_flags") == 0)
    calm = notes(note(d, POSITIVE, f"Low risk profile{DASH}no anomalies detected", F.lit(0.02)))
    raised = notes(
        ladder((hp >= 0.7, note(d, NEGATIVE, text("High honeypot probability (", percent(hp), "). ", flags), -p)),
               (hp >= 0.3, note(d, NEGATIVE, text("Moderate risk flags detected (", percent(hp), "). ", flags), -p * 0.6))),
        F.when(stuffed > 0.3, note(d, NEGATIVE, text(
            "Possible keyword stuffing (score: ", fixed(stuffed, 2),
            f"){DASH}AI skills listed but career history shows non-AI roles"), -p * 0.3)))
    return F.when(clean, calm).otherwise(raised)


def merge_notes(*groups: Column) -> Column:
    """All notes by falling absolute impact; equal impacts keep rule order."""
    keyed = F.transform(F.concat(*groups), lambda n, i: F.struct(
        F.negative(F.abs(n["impact"])).alias("k"), i.alias("i"), n.alias("n")))
    return F.transform(F.array_sort(keyed), lambda x: x["n"])


def reasoning(notes_col: str = "notes", score: str = "final_score") -> Column:
    """``Score x.xx: p1; p2; p3. Concerns: n1.``"""
    pick = lambda s, n: F.slice(F.filter(notes_col, lambda x: x["sentiment"] == s), 1, n)
    good = F.array_join(F.transform(pick(POSITIVE, 3), lambda x: x["message"]), "; ")
    bad = F.get(pick(NEGATIVE, 1), F.lit(0))["message"]
    tail = F.coalesce(F.concat(F.lit(" Concerns: "), bad, F.lit(".")), F.lit(""))
    return F.concat(F.lit("Score "), fixed(F.col(score), 2), F.lit(": "), good, F.lit("."), tail)


def explain(shortlist: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Add ``notes`` and ``reasoning`` to scored rows."""
    w = config.weights()
    groups = (semantic_notes(w), technical_notes(w), experience_notes(w),
              behavior_notes(w, config), trust_notes(w), risk_notes())
    noted = shortlist.withColumn("notes", merge_notes(*groups))
    return noted.withColumn("reasoning", reasoning())


def notes_by_sentiment(explained: DataFrame) -> DataFrame:
    """Count and summed impact per dimension and sentiment."""
    flat = explained.select(F.explode("notes").alias("n")).select("n.*")
    return flat.groupBy("dimension", "sentiment").agg(F.count("*").alias("n_notes"), F.sum("impact").alias("impact"))


def reasoning_alt(df: DataFrame, name: str = "reasoning_alt") -> DataFrame:
    """The report's fact template with its concern rules.

    Columns: ``current_title, total_years, skill_count, top_skills, recruiter_response_rate,
    days_since_active, location, notice_period_days, open_to_work, consulting_only, github_raw``.
    """
    rate, days, wait = F.col("recruiter_response_rate"), F.col("days_since_active"), F.col("notice_period_days")
    facts = text(F.col("current_title"), " with ", fixed(F.col("total_years"), 1), "yr experience; ",
                 whole(F.col("skill_count")), " core AI skills (", F.col("top_skills"), "); recruiter response ",
                 percent(rate), "; ", whole(days), "d since last active; ", F.col("location"), "; notice period ",
                 whole(wait), "d; ", F.when(F.col("open_to_work"), "open to work").otherwise("not open to work"), ".")
    return df.withColumn(name, F.concat_ws(
        " ", facts,
        F.when(wait > 60, text("Concern: ", whole(wait), "d notice period.")),
        F.when(days > 90, text("Concern: inactive ", whole(days), "d on platform.")),
        F.when(rate < 0.20, text("Concern: low recruiter response rate (", percent(rate), ").")),
        F.when(F.col("consulting_only"), "Note: entire career in services firms."),
        F.when(F.col("github_raw") > 50, text("Strong GitHub activity (", fixed(F.col("github_raw"), 0), "/100)."))))
