from pyspark.sql import functions as F

from candela.operators import sketches as S


def profiled(rows):
    return S.profile_runs(rows, F.col("r"), {"id": F.col("id"), "word": F.col("w")})


def test_runs_merge_without_their_rows(spark, tmp_path):
    """Runs stored one by one give what all rows give, within the stated errors."""
    n = 40_000
    rows = spark.range(n).select("id", F.concat(F.lit("w"), F.col("id") % 500).alias("w"), F.when(F.col("id") < 30_000, "a").otherwise("b").alias("r"))
    path = str(tmp_path / "profiles")
    for run in ("a", "b"):
        profiled(rows.filter(F.col("r") == run)).write.mode("append").parquet(path)
    got = {r.column: r for r in S.estimates(S.merge_runs(spark.read.parquet(path)), (0.1, 0.5, 0.9)).collect()}
    one = got["id"]
    assert (one.rows, one["values"], one.numbers, one.least, one.greatest) == (n, n, n, 0, n - 1)
    assert abs(one.n_distinct - n) <= S.DISTINCT_ERROR * n and abs(got["word"].n_distinct - 500) <= S.DISTINCT_ERROR * 500
    assert all(abs(one[f"q{q}"] / n - q / 100) <= S.RANK_ERROR for q in (10, 50, 90))
    assert got["word"].numbers == 0 and got["word"].q50 is None


def test_overlap(spark):
    rows = spark.range(20_000).select("id", F.col("id").cast("string").alias("w"), F.lit("a").alias("r"))
    late = spark.range(15_000, 30_000).select("id", F.col("id").cast("string").alias("w"), F.lit("b").alias("r"))
    profiles = profiled(rows.unionByName(late))
    assert abs(S.run_overlap(profiles, "id", "a", "b").first().n_shared - 5000) <= S.OVERLAP_ERROR * 20_000
    assert S.run_overlap(profiles, "id", "a", "gone").first().n_shared == 0


def test_nulls_and_empty_tables(spark):
    schema = "id long, w string, r string"
    none = spark.createDataFrame([], schema)
    assert S.estimates(S.merge_runs(profiled(none))).count() == 0
    odd = spark.createDataFrame([(None, None, "a"), (None, "x", None), (None, "", "a")], schema)
    got = {(r.run, r.column): r for r in S.estimates(profiled(odd)).collect()}
    assert (got["a", "id"].rows, got["a", "id"]["values"], got["a", "id"].n_distinct, got["a", "id"].q50) == (2, 0, 0, None)
    assert got[None, "word"]["values"] == 1
    assert {r.column: r.rows for r in S.merge_runs(profiled(odd)).collect()} == {"id": 3, "word": 3}
