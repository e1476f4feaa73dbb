import json

import pytest
from pyspark.sql import functions as F

from candela.config import EngineConfig
from candela.operators import ingest as I
from candela.sources import readers, sinks
from candela.sources.contract import RULES, TEXT, _Checks, candidate_contract
from candela.sources.schema import candidate_ddl
from candela.streaming import ingest as ST
from tests.conftest import JOB, SCHOOL, SKILL, lines, make


def outcome(spark, doc, **options):
    row = I.classify(lines(spark, [doc]), **options).first()
    return row.error_type, row.messages


STRICT = [
    ("{bad", I.JSON_ERROR), ("[1]", I.STRUCTURE_ERROR), ("3", I.STRUCTURE_ERROR), ("null", I.STRUCTURE_ERROR),
    (make(), None), (make(**{"extra": 1, "profile.extra": "x"}), None),
    (make(**{"career_history.0.end_date": KeyError}), I.SCHEMA_ERROR), (make(**{"career_history.0.end_date": "2021-01-01"}), None),
    (make(**{"profile.years_of_experience": -0.1}), I.SCHEMA_ERROR), (make(**{"profile.years_of_experience": 0}), None),
    (make(**{"profile.years_of_experience": 50}), None), (make(**{"profile.years_of_experience": 50.1}), I.SCHEMA_ERROR),
    (make(**{"signals.recruiter_response_rate": 1.0}), None), (make(**{"signals.recruiter_response_rate": 1.01}), I.SCHEMA_ERROR),
    (make(**{"profile.current_company_size": "1-11"}), I.SCHEMA_ERROR), (make(candidate_id="CAND_123"), I.SCHEMA_ERROR),
    (make(career_history=[]), I.SCHEMA_ERROR), (make(career_history=[JOB] * 10), None), (make(career_history=[JOB] * 11), I.SCHEMA_ERROR),
    (make(education=[SCHOOL] * 5), None), (make(education=[SCHOOL] * 6), I.SCHEMA_ERROR), (make(education=[]), None),
    (make(**{"skills.0.endorsements": 5.0}), None), (make(**{"skills.0.endorsements": 5.5}), I.SCHEMA_ERROR),
    (make(**{"skills.0.duration_months": KeyError}), None), (make(**{"education.0.tier": None}), I.SCHEMA_ERROR),
    (make(**{"education.0.grade": None}), None), (make(certifications=KeyError), None), (make(skills=KeyError), I.SCHEMA_ERROR),
    (make(**{"signals.verified_email": "yes"}), I.SCHEMA_ERROR), (make(**{"signals.verified_email": 1}), I.SCHEMA_ERROR),
    (make(**{"signals.skill_assessment_scores": {"a": 101}}), I.SCHEMA_ERROR), (make(**{"signals.skill_assessment_scores": {"a": 100}}), None),
    (make(profile=3), I.SCHEMA_ERROR), (make(skills="x"), I.SCHEMA_ERROR), (make(skills=[3]), I.SCHEMA_ERROR),
    (make(**{"signals.expected_salary_range_inr_lpa": {"min": 1}}), I.SCHEMA_ERROR),
    (make(**{"signals.github_activity_score": -1}), None), (make(**{"signals.github_activity_score": -2}), I.SCHEMA_ERROR),
    (make(**{"signals.last_active_date": "never"}), None),
]
MODEL = [
    (make(**{"profile.years_of_experience": "5"}), None), (make(**{"profile.years_of_experience": "x"}), I.MODEL_ERROR),
    (make(**{"education.0.tier": None}), None), (make(education=[SCHOOL] * 6), None), (make(skills=KeyError), None),
    (make(**{"signals.verified_email": "yes"}), None), (make(**{"signals.verified_email": "maybe"}), I.MODEL_ERROR),
    (make(**{"career_history.0.end_date": KeyError}), None), (make(career_history=[]), I.MODEL_ERROR),
    (make(**{"signals.skill_assessment_scores": {"a": 101}}), None), (make(candidate_id="CAND_123"), I.MODEL_ERROR),
]


@pytest.mark.parametrize("cases,validate", [(STRICT, True), (MODEL, False)])
def test_outcome_of_each_document(spark, cases, validate):
    texts = [d if isinstance(d, str) else json.dumps(d) for d, _ in cases]
    rows = spark.createDataFrame([(t, str(i)) for i, t in enumerate(texts)], "value string, source_file string")
    got = {int(r.source_file): (r.error_type, r.messages) for r in I.classify(rows, validate).collect()}
    wrong = [(texts[i][:300], kind, got[i]) for i, (_, kind) in enumerate(cases) if got[i][0] != kind]
    assert not wrong


def test_messages_are_ordered_and_capped(spark):
    bad = {**SKILL, "endorsements": -1}
    kind, messages = outcome(spark, make(skills=[bad] * 12, candidate_id="x"))
    assert kind == I.SCHEMA_ERROR and len(messages) == 10
    assert messages[0] == "[candidate_id] value does not match the pattern"
    assert messages[1] == "[skills.0.endorsements] value is less than the minimum of 0"
    assert messages[9] == "[skills.8.endorsements] value is less than the minimum of 0"
    kind, messages = outcome(spark, make(profile=KeyError, skills=[bad] * 12), max_errors=20)
    assert messages[0] == "[root] missing required key profile"
    assert messages[-1].startswith("[skills.11.")


def test_split_summary_and_defaults(spark):
    docs = [make(), "{bad", "[1]", make(candidate_id="CAND_0000002", certifications=KeyError, languages=KeyError)]
    classified = I.classify(lines(spark, docs))
    valid, quarantine = I.split_valid_quarantine(classified)
    rows = {r.candidate_id: r for r in valid.collect()}
    assert sorted(rows) == ["CAND_0000001", "CAND_0000002"]
    assert rows["CAND_0000002"].certifications == [] and rows["CAND_0000002"].signals.skill_assessment_scores == {}
    assert sorted(r.error_type for r in quarantine.collect()) == [I.JSON_ERROR, I.STRUCTURE_ERROR]
    summary = I.load_summary(classified).first()
    assert (summary.total, summary.valid, summary.invalid, summary.success_rate) == (4, 2, 2, 0.5)
    assert I.load_summary(classified.filter("false")).first().success_rate == 0.0
    assert [r.candidate_id for r in I.limit_valid(valid, 1).collect()] == ["CAND_0000001"]
    assert I.sample_errors(quarantine, 1).count() == 1


def test_jsonl_skips_blank_lines_and_replaces_bad_bytes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"\n  \r\n" + json.dumps(make()).encode() + b"\r\n\n{\"candidate_id\": \"\xff\"}\n")
    found = readers.read_lines(spark, str(tmp_path))
    assert found.count() == 2
    docs = readers.read_documents_jsonl(spark, str(tmp_path), candidate_ddl()).collect()
    assert sorted(d.candidate_id for d in docs)[0] == "CAND_0000001"
    assert "�" in [d.candidate_id for d in docs]


def test_json_array_source(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([make(), 5, make(candidate_id="CAND_0000009")], indent=2))
    kinds = I.classify(readers.read_json_array(spark, str(tmp_path))).orderBy("pos").collect()
    assert [k.error_type for k in kinds] == [None, I.STRUCTURE_ERROR, None]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text("{}")
    with pytest.raises(Exception, match="not a JSON array"):
        readers.read_json_array(spark, str(tmp_path / "b")).collect()


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        docs = [json.dumps(make(candidate_id=f"CAND_000000{i}")), "{bad", "", json.dumps(make(career_history=[]))]
        (source / f"{i}.jsonl").write_text("\n".join(docs))
    ST.write_classified(ST.stream_lines(spark, str(source), 1), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = I.classify(readers.read_lines(spark, str(source)))
    key = lambda df: sorted((r.value, r.error_type or "") for r in df.select("value", "error_type").collect())
    assert key(streamed) == key(batch) and streamed.count() == 9
    assert streamed.filter("error_type IS NULL").count() == 3


def test_stream_resumes_after_a_stop(spark, tmp_path):
    """Stopped after one micro-batch, resumed, and resumed again without new files: every line once."""
    source, out, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    source.mkdir()
    for i in range(4):
        (source / f"{i}.jsonl").write_text("\n".join([json.dumps(make(candidate_id=f"CAND_000000{i}")), f"{{bad {i}"]))
    start = lambda **how: ST.write_classified(ST.stream_lines(spark, str(source), 1), out, log, **how)
    ST.stop_after(start(interval="2 seconds"), 1)
    stopped = spark.read.parquet(out)
    assert 2 <= stopped.count() <= 8 and stopped.filter("error_type IS NULL").count() * 2 == stopped.count()
    start().awaitTermination()
    start().awaitTermination()
    rows = spark.read.parquet(out)
    assert (rows.count(), rows.select("value").distinct().count()) == (8, 8)


def test_batch_that_fails_is_repeated_once(spark, tmp_path):
    """The scoring of the second batch fails after the first was stored; the resumed run gives the batch result."""
    source, store, log = tmp_path / "in", str(tmp_path / "best"), str(tmp_path / "log")
    source.mkdir()
    for i in range(3):
        (source / f"{i}.csv").write_text(f"j,{i},{i}.5\nk,{i},{-i}.0\n")
    schema = "job_id string, candidate_id string, final_score double"
    feed = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).csv(str(source))
    seen = []

    def failing(batch):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("lost")
        return batch

    config = EngineConfig(top_k=2)
    with pytest.raises(Exception, match="lost"):
        ST.stream_shortlist(failing, feed(), store, log, config).awaitTermination()
    ST.stream_shortlist(failing, feed(), store, log, config).awaitTermination()
    best = {(r.job_id, r["rank"]): r.candidate_id for r in ST.latest_shortlist(spark, store).collect()}
    assert best == {("j", 1): "2", ("j", 2): "1", ("k", 1): "0", ("k", 2): "1"} and len(seen) == 4


def test_filters_do_not_repeat_the_checks(spark):
    plan = I.classify(lines(spark, [make()])).filter("error_type IS NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json") + plan.count("parse_json") <= 2


def test_snapshot_and_submission(spark, tmp_path):
    path = str(tmp_path / "snap")
    sinks.write_snapshot(spark.range(3), path, "r1")
    sinks.write_snapshot(spark.range(5), path, "r2")
    sinks.write_snapshot(spark.range(1), path, "r1")
    assert sinks.read_snapshot(spark, path).count() == 5
    assert sinks.read_snapshot(spark, path, "r1").count() == 1
    sinks.write_snapshot(spark.range(7), path, "r10")
    assert sinks.read_snapshot(spark, path).count() == 7
    best = spark.createDataFrame([("b", 2, 0.5, "x, y"), ("a", 1, 0.75, 'say "hi"')], "candidate_id string, rank int, final_score double, reasoning string")
    out = tmp_path / "sub"
    sinks.write_submission(best, str(out))
    text = next(out.glob("part-*")).read_text().splitlines()
    assert text[0] == "candidate_id,rank,score,reasoning" and text[1].startswith("a,1,0.7500,") and text[2] == 'b,2,0.5000,"x, y"'


def test_stream_inputs_keep_their_partitions(spark):
    from workload import q_ingest
    wide = q_ingest._in_batches(spark.range(0, 100, 1, 12))
    assert wide.rdd.getNumPartitions() == 12 and "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()
    assert q_ingest._in_batches(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 3


def test_a_document_is_opened_by_one_cast(spark):
    """Lists were cast to VARIANT elements and these to maps, a copy of every value each time; texts were read for no rule."""
    checked = I.with_violations(I.parse_json(lines(spark, [make()])), candidate_contract())
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrayType(VariantType" not in plan and "array<variant>" not in plan
    assert candidate_contract().fields["profile"].fields["summary"] == TEXT and "try_variant_get" not in _Checks(False, RULES).look("y", TEXT)


def test_absent_and_wrong_kinds_stay_apart(spark):
    cases = [(make(**{"signals.skill_assessment_scores": 3}), "[signals.skill_assessment_scores] value is not of type object"),
             (make(**{"signals.skill_assessment_scores": KeyError}), "[signals] missing required key skill_assessment_scores"),
             (make(**{"signals.expected_salary_range_inr_lpa": None}), "[signals.expected_salary_range_inr_lpa] value is not of type object"),
             (make(skills=None), "[skills] value is not of type array"), (make(skills=KeyError), "[root] missing required key skills"),
             (make(skills=[SKILL, None]), "[skills.1] value is not of type object"),
             (make(profile=[]), "[profile] value is not of type object"), (make(candidate_id=None), "[candidate_id] value is not of type string")]
    assert [outcome(spark, doc)[1] for doc, _ in cases] == [[message] for _, message in cases]
