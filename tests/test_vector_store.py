import numpy as np
from pyspark.sql import functions as F

from candela.operators.semantic import embed_with_model
from candela.sources import vector_store as VS


def model(calls):
    """A model that says how many passages it was given, by a Spark accumulator."""
    def make_predict():
        def predict(texts):
            calls.add(len(texts))
            return np.array([[len(t), t.count("a")] for t in texts], dtype="float32")
        return predict
    return make_predict


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def embedded(spark, path, rows, name="m"):
    calls = spark.sparkContext.accumulator(0)
    VS.add_to_store(rows, "text", path, name, model(calls), batch_size=2)
    return calls.value


def test_passages_are_embedded_once(spark, tmp_path):
    path = str(tmp_path / "store")
    first = docs(spark, ["banana", "banana", "", None, "kiwi"])
    assert VS.read_store(spark, path, "m").count() == 0
    assert VS.missing_passages(first, "text", path, "m").count() == 3
    assert embedded(spark, path, first) == 3
    assert embedded(spark, path, first) == 0
    assert embedded(spark, path, docs(spark, ["kiwi", "plum", "plum"])) == 1
    got = {r.id: r.embedding for r in VS.with_stored_vectors(first, "text", path, "m").collect()}
    assert got == {0: [6, 3], 1: [6, 3], 2: [0, 0], 3: [0, 0], 4: [4, 0]}


def test_models_are_kept_apart(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = docs(spark, ["fig"])
    assert embedded(spark, path, rows) == 1
    assert VS.with_stored_vectors(rows, "text", path, "other").first().embedding is None
    assert embedded(spark, path, rows, "other") == 1 and embedded(spark, path, rows) == 0


def test_repeated_parts_and_empty_inputs(spark, tmp_path):
    path = str(tmp_path / "store")
    none = docs(spark, ["x"]).filter("false")
    assert embedded(spark, path, none) == 0 and VS.with_stored_vectors(none, "text", path, "m").count() == 0
    assert embedded(spark, path, docs(spark, ["fig"])) == 1
    # a second writer stored the same passage at the same time
    spark.read.schema(VS.STORE).parquet(path).coalesce(1).write.mode("append").partitionBy("model").parquet(path)
    rows = docs(spark, ["fig", "fig", "long " * 50_000]).withColumn("embedding", F.lit("clashing"))
    assert VS.read_store(spark, path, "m").count() == 1
    assert embedded(spark, path, rows) == 1
    assert [r.embedding for r in VS.with_stored_vectors(rows, "text", path, "m").orderBy("id").collect()] == [[3, 0], [3, 0], [250_000, 0]]


def test_only_a_slice_of_a_batch_becomes_python_objects(spark):
    """The model sees how many objects the worker holds: with ten thousand rows in a batch not many more than with ten."""
    def make_predict():
        import sys
        return lambda texts: np.full((len(texts), 2), [sys.getallocatedblocks(), len(texts)], dtype="float32")

    def held(n):
        rows = spark.range(0, n, 1, 1).selectExpr("concat('passage ', id) AS text")
        out = embed_with_model(rows, "text", make_predict, batch_size=100).selectExpr("embedding[0] AS blocks", "embedding[1] AS size")
        return out.agg(F.max("blocks"), F.max("size"), F.count("size")).first()

    few, many = held(10), held(10_000)
    assert (few[1], few[2], many[1], many[2]) == (10, 10, 100, 10_000) and many[0] - few[0] < 5000
