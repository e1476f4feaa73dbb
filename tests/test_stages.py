import pytest
from pyspark.sql import functions as F

from candela.sources import stages


def test_digest_ignores_order_and_sees_every_change(spark):
    rows = [(i, f"t{i % 3}", {"a": i}, [1.0, None]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, t string, m map<string, long>, v array<double>")
    first = stages.rows_digest(df)
    assert first == stages.rows_digest(df.orderBy(F.desc("id")).repartition(7).select("v", "t", "m", "id"))
    for other in (df.limit(49), df.unionByName(df.limit(1)), df.withColumn("t", F.when(F.col("id") == 7, None).otherwise(F.col("t"))), df.withColumnRenamed("t", "u")):
        assert stages.rows_digest(other) != first
    assert stages.rows_digest(df.limit(0)) == stages.rows_digest(df.filter("id < 0"))


def test_stages_follow_their_inputs(spark, tmp_path):
    root, built = str(tmp_path / "run"), []

    def run(pool, job, config):
        def features():
            built.append("features")
            return pool.withColumn("y", F.col("x") * 2)

        def shortlist():
            built.append("shortlist")
            return stages.read_stage(spark, root, "features", made).withColumn("job", F.lit(job.first().job)).limit(config)
        made = stages.stage_key({"pool": pool})
        asked = stages.stage_key({"features": made, "job": job}, config)
        stages.fresh_stage(spark, root, "features", made, features)
        rows = stages.fresh_stage(spark, root, "shortlist", asked, shortlist).count()
        now, built[:] = list(built), []
        return now, rows, {r.stage: r.fresh for r in stages.state(spark, root, {"features": made, "shortlist": asked, "none": "x"}).collect()}

    pool, job = spark.range(9).withColumnRenamed("id", "x"), spark.createDataFrame([("j",)], "job string")
    all_fresh = {"features": True, "shortlist": True, "none": False}
    assert run(pool, job, 4) == (["features", "shortlist"], 4, all_fresh)
    assert run(pool.repartition(3), job, 4) == ([], 4, all_fresh)
    assert run(pool, job, 5) == (["shortlist"], 5, all_fresh)
    assert run(pool, job.withColumn("job", F.lit("k")), 5) == (["shortlist"], 5, all_fresh)
    assert run(pool.filter("x < 3"), job, 5) == (["features", "shortlist"], 3, all_fresh)


def test_a_crash_before_the_swap_leaves_the_former_rows(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "run")
    stages.fresh_stage(spark, root, "a", "k1", lambda: spark.range(3))
    with monkeypatch.context() as m:
        m.setattr(stages, "point", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            stages.fresh_stage(spark, root, "a", "k2", lambda: spark.range(99))
    assert stages.read_stage(spark, root, "a", "k1").count() == 3
    with pytest.raises(stages.StaleStage, match="other inputs"):
        stages.read_stage(spark, root, "a", "k2")
    with pytest.raises(stages.StaleStage, match="never stored"):
        stages.read_stage(spark, root, "b", "k2")
    assert stages.fresh_stage(spark, root, "a", "k2", lambda: spark.range(5)).count() == 5
