import json
import random

import pytest
from pyspark.sql import functions as F

from candela.sources import readers


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    text = lambda: "".join(rng.choices('ab{}[],:"\\ \né]', k=rng.randint(0, 9)))
    if kind < 2:
        return text()
    if kind < 4:
        return rng.choice([0, -1.5, True, None])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {text(): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


@pytest.mark.parametrize("indent", [None, 2])
def test_elements_over_many_ranges(spark, tmp_path, small_ranges, indent):
    rng = random.Random(7)
    files = {f"{i}.json": [value(rng) for _ in range(n)] for i, n in enumerate([0, 1, 2, 400, 900])}
    files["long.json"] = [{"a": "x{}\"\\" * 900, "b": [{}] * 300}, "]" * 3000, {"c": {"d": {}}}]
    files["blank.json"] = []
    for name, held in files.items():
        (tmp_path / name).write_text(json.dumps(held, indent=indent, ensure_ascii=False))
    (tmp_path / "blank.json").write_text(" [" + " \n" * 2000 + "] \n")
    (tmp_path / "mark.json").write_text("﻿[1, {}]")
    files["mark.json"] = [1, {}]
    read = readers.read_json_array(spark, str(tmp_path))
    got = {}
    for r in read.collect():
        got.setdefault(r.source_file, {})[r.pos] = json.loads(r.value)
    assert got == {name: dict(enumerate(held)) for name, held in files.items() if held}
    tasks = spark.read.option("lineSep", "}").text(str(tmp_path / "4.json")).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 4


@pytest.mark.parametrize("text", ["", "  \n", "{}", '{"a": [1]}', "5", '"[]"', "[1, 2", '[{"a": "}]', "[1]]", "[1] 5", '[{"a": 1}'])
def test_roots_that_are_no_whole_array(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    if text:
        with pytest.raises(Exception, match="JSON array"):
            readers.read_json_array(spark, str(tmp_path)).collect()
    else:
        assert readers.read_json_array(spark, str(tmp_path)).collect() == []


def test_three_hundred_megabytes(spark, tmp_path):
    """One minified file, one line: at least four tasks, and the elements of the same documents as lines."""
    docs = [json.dumps({"id": i, "text": f"{{{i}}}, \"é\" [" + "lorem ipsum, " * (i % 90)}) for i in range(20_000)]
    (tmp_path / "array").mkdir()
    with open(tmp_path / "array" / "a.json", "w") as f:
        f.write("[" + ",".join(docs * 25) + "]")
    assert (tmp_path / "array" / "a.json").stat().st_size > 300_000_000
    read = readers.read_json_array(spark, str(tmp_path / "array"))
    whole = read.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("value"), F.lit(1 << 40))), F.min("pos"), F.max("pos")).first()
    lines = spark.createDataFrame([(d,) for d in docs], "value string").agg(25 * F.count("*"), 25 * F.sum(F.pmod(F.xxhash64("value"), F.lit(1 << 40)))).first()
    assert tuple(whole) == (*lines, 0, 499_999)
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "array")).select(F.spark_partition_id()).distinct().count() >= 4


def test_marks_against_a_walk():
    from candela.sources.json_arrays import marks, tokens
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice('[]{},"\\ax') for _ in range(rng.randrange(40)))
        for inside in (False, True):
            want = list(tokens(text, inside))
            places, adds, ends = marks(text.encode())(inside)
            assert [(text[p], p) for p in places] == [(t, p) for t, p in want if t != '"'] and ends == any(t == '"' for t, _ in want)
            assert adds.tolist() == [1 if text[p] in "[{" else -1 if text[p] in "]}" else 0 for p in places]


def test_a_range_goes_through_in_few_python_steps(spark):
    import pyarrow as pa
    from candela.sources import json_arrays
    n = 200_000
    rows = pa.RecordBatch.from_arrays([pa.array(["f"] * n), pa.array([0] * n), pa.array(["[" + '{"a":1' if i == 0 else ',{"a":1' for i in range(n - 1)] + ["]"])], ["file", "start", "value"])
    import time
    begin = time.process_time()
    out, = json_arrays.summarise(iter([rows]))
    assert time.process_time() - begin < 1
    assert dict(out.to_pylist()[0]["states"][0]["commas"]) == {1: n - 2}
