import math

import pytest
from pyspark.sql import functions as F

from candela.config import EngineConfig
from candela.functions import scoring as S


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize("years,expected", [(3.9, 0.975), (4, 1.0), (8, 1.0), (8.1, 0.994), (17, 0.5), (0, 0.0)])
def test_years_score(spark, years, expected):
    col = S.years_score(F.lit(float(years)), F.lit(5.0), F.lit(9.0), F.lit(4.0), F.lit(8.0))
    assert value(spark, col) == pytest.approx(expected)


def test_years_score_without_recommendation(spark):
    none = F.lit(None).cast("double")
    assert value(spark, S.years_score(F.lit(4.0), F.lit(5.0), F.lit(9.0), none, none)) == pytest.approx(0.8)
    assert value(spark, S.years_score(F.lit(1.0), F.lit(2.0), F.lit(9.0))) == pytest.approx(1 - 1 / 3)


@pytest.mark.parametrize("days,expected", [(30, 1.0), (31, 1 - 1 / 120), (149, 1 - 119 / 120), (150, 0.0), (0, 1.0), (180, 0.0)])
def test_notice(spark, days, expected):
    assert value(spark, S.notice_score(F.lit(days))) == pytest.approx(expected)


@pytest.mark.parametrize("text,expected", [("2024-02-15", 0), ("2024-2-5", 10), ("2024-02-30", 999), ("", 999), ("x", 999), ("2024-02-16", -1)])
def test_days_since(spark, text, expected):
    assert value(spark, S.days_since(F.lit(text), F.lit("2024-02-15").cast("date"))) == expected


def test_recency_half_life(spark):
    assert value(spark, S.recency_score(F.lit(90))) == pytest.approx(0.5)
    assert value(spark, S.recency_score(F.lit(0))) == 1.0
    assert value(spark, S.recency_score(F.lit(999))) == pytest.approx(math.exp(-math.log(2) * 999 / 90))


@pytest.mark.parametrize("raw,expected", [(-1.0, 0.0), (0.0, 0.0), (100.0, 1.0)])
def test_github(spark, raw, expected):
    assert value(spark, S.github_norm(F.lit(raw))) == expected


@pytest.mark.parametrize("n,now,expected", [(7, False, 0.0), (8, False, 0.2), (16, False, 1.0), (20, False, 1.0), (20, True, 0.0)])
def test_stuffing(spark, n, now, expected):
    assert value(spark, S.keyword_stuffing(F.lit(n), F.lit(now))) == pytest.approx(expected)


def test_risk_parts(spark):
    t, f = F.lit(True), F.lit(False)
    assert value(spark, S.honeypot_probability(t, t, t, F.lit(1.0))) == 1.0
    assert value(spark, S.honeypot_probability(t, f, f, F.lit(0.5))) == pytest.approx(0.45)
    assert value(spark, S.salary_inverted(F.lit(5.0), F.lit(5.0))) is False
    assert value(spark, S.salary_inverted(F.lit(6.0), F.lit(5.0))) is True
    assert value(spark, S.date_inverted(F.lit("bad"), F.lit("2024-01-01"))) is False
    assert value(spark, S.date_inverted(F.lit("2024-01-02"), F.lit("2024-01-01"))) is True
    assert value(spark, S.experience_anomaly(F.lit(102.0), F.lit(6.0))) is False
    assert value(spark, S.experience_anomaly(F.lit(103.0), F.lit(6.0))) is True


def test_company_and_progression(spark):
    t, f = F.lit(True), F.lit(False)
    assert value(spark, S.company_quality(t, t, F.lit(500.0))) == 0.25
    assert value(spark, S.company_quality(f, t, F.lit(500.0))) == 0.70
    assert value(spark, S.company_quality(f, f, F.lit(500.0))) == pytest.approx(0.85)
    assert value(spark, S.progression(t, f)) == 0.85
    assert value(spark, S.progression(t, t)) == pytest.approx(0.51)


@pytest.mark.parametrize("score,band", [(0.75, "excellent"), (0.7499, "good"), (0.55, "good"), (0.35, "fair"), (0.3499, "low")])
def test_bands(spark, score, band):
    assert value(spark, S.score_band(F.lit(score))) == band


def test_weights():
    w = EngineConfig().weights()
    assert sum(w.values()) == pytest.approx(1.0)
    scaled = EngineConfig(*[10 * v for v in EngineConfig().raw_weights().values()]).weights()
    assert all(w[k] == pytest.approx(scaled[k]) for k in w)
    with pytest.raises(ValueError):
        EngineConfig(0, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        EngineConfig(weight_trust=-1)
