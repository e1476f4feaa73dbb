"""Source, contract, quarantine, sink and stream queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from candela.config import EngineConfig
from candela.operators import ingest as I, ranking as R, serving as SV
from candela.plans import shortlist as PL
from candela.sources import contract as C, readers, sinks, stages
from candela.sources.schema import candidate_ddl
from candela.streaming import ingest as ST
from workload import tables as T
from workload.q_ranking import TOP10
from workload.registry import register
from workload.sql import cte, pick, query, r, s

# --- the same faults as rows: one row per broken rule -----------------------------

X1 = "chr(1)"
cte("kind", ("doc",), f"""SELECT d, n, lang, source,
    CASE WHEN lang = 'es' AND n % 5 = 0 THEN 'JSONDecodeError' WHEN lang = 'de' AND source = 'src13' THEN 'StructureError' END AS broken,
    NOT (lang = 'de' AND source = 'src13') AND NOT (lang = 'es' AND n % 5 = 0) AS plain,
    CASE WHEN source = 'src5' THEN 'CAND_' || d ELSE 'CAND_' || lpad(CAST(d AS VARCHAR), 7, '0') END AS id,
    CASE WHEN source = 'src9' THEN (n % 600) / 10.0::DOUBLE ELSE (n % 180) / 10.0::DOUBLE END AS years, len(lines) AS n_lines FROM doc""")
cte("bad", ("kind", "line", "clause"), f"""
    SELECT d, '' AS path, 0 AS ord, 'required' AS rule, 'missing required key education' AS message FROM kind WHERE plain AND source = 'src7'
    UNION ALL SELECT d, 'candidate_id', 5, 'pattern', 'value does not match the pattern' FROM kind WHERE plain AND NOT regexp_full_match(id, 'CAND_[0-9]{{7}}')
    UNION ALL SELECT d, 'profile' || {X1} || 'years_of_experience', 1, 'type', 'value is not of type number' FROM kind WHERE plain AND source = 'src4'
    UNION ALL SELECT d, 'profile' || {X1} || 'years_of_experience', 3, 'range', 'value is greater than the maximum of 50' FROM kind WHERE plain AND source <> 'src4' AND years > 50
    UNION ALL SELECT d, 'career_history', 2, 'cardinality', 'array has fewer than 1 items' FROM kind WHERE plain AND n_lines = 0
    UNION ALL SELECT d, 'career_history', 3, 'cardinality', 'array has more than 10 items' FROM kind WHERE plain AND n_lines > 10
    UNION ALL SELECT d, 'education', 3, 'cardinality', 'array has more than 5 items' FROM (SELECT d, count(*) AS c FROM line WHERE l % 3 = 0 GROUP BY d) JOIN kind USING (d) WHERE plain AND source <> 'src7' AND c > 5
    UNION ALL SELECT d, 'career_history' || {X1} || lpad(CAST(i AS VARCHAR), 9, '0'), 0, 'required', 'missing required key end_date' FROM line JOIN kind USING (d) WHERE plain AND kind.source = 'src17'
    UNION ALL SELECT d, 'career_history' || {X1} || lpad(CAST(i AS VARCHAR), 9, '0') || {X1} || 'company_size', 4, 'enum', 'value is not one of the allowed values' FROM line JOIN kind USING (d) WHERE plain AND kind.lang = 'fr' AND {pick(T.SIZES + ['1-11'], 'l')} = '1-11'
    UNION ALL SELECT d, 'skills' || {X1} || lpad(CAST(i AS VARCHAR), 9, '0') || {X1} || 'endorsements', 2, 'range', 'value is less than the minimum of 0' FROM clause JOIN kind USING (d) WHERE plain AND kind.source = 'src11' AND l % 5 - 1 < 0""")
cte("msgs", ("bad",), f"""SELECT d, count(*) AS n, string_agg('[' || CASE WHEN path = '' THEN 'root' ELSE replace(regexp_replace(path, chr(1) || '0*([0-9]+)(' || chr(1) || '|$)', '.\\1\\2'), {X1}, '.') END || '] ' || message, ' | ' ORDER BY path, ord, rule, message) FILTER (k <= 10) AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY path, ord, rule, message) AS k FROM bad) GROUP BY d""")
cte("classified", ("kind", "msgs"), """SELECT k.d, CASE WHEN plain THEN id END AS candidate_id, coalesce(broken, CASE WHEN m.d IS NOT NULL THEN 'SchemaValidation' END) AS error_type,
    CASE broken WHEN 'JSONDecodeError' THEN 'line is not valid JSON' WHEN 'StructureError' THEN 'Expected JSON object, got array' ELSE coalesce(m.text, '') END AS messages, source
    FROM kind k LEFT JOIN msgs m USING (d)""")


def _parsed(spark, sf) -> DataFrame:
    return I.check_root_object(I.parse_json(T.raw_lines(spark, sf)))


def _rule(spark, sf, rule: str) -> DataFrame:
    """Violations of one rule, one row each."""
    checked = I.with_violations(_parsed(spark, sf), C.candidate_contract(), (rule,))
    flat = checked.select("d", F.inline_outer("violations")).filter(F.col("message").isNotNull())
    return flat.select("d", F.regexp_replace("path", "\\u0001", "/").alias("path"), "message")


def _stored_lines(spark, sf) -> str:
    """The raw lines as JSONL text files in the shared folder, blank lines between."""
    path = sinks.new_folder(spark, "lines")
    T.raw_lines(spark, sf).select(F.concat("value", F.lit("\n")).alias("value")).write.text(path)
    return path


def _classified(spark, sf, **options) -> DataFrame:
    return I.classify(T.raw_lines(spark, sf), **options)


@register("scan_jsonl", query("""SELECT CASE WHEN broken IS NULL THEN id END AS candidate_id, CASE WHEN broken IS NULL AND source <> 'src4' THEN years END AS years_of_experience,
    broken IS NULL AS is_object FROM kind""", "kind"))
def scan_jsonl(spark, sf) -> DataFrame:
    """Write the lines as text and scan every one of them back typed; a line that is no object has nulls."""
    docs = readers.read_documents_jsonl(spark, _stored_lines(spark, sf), candidate_ddl())
    whole = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).like("OBJECT%"), F.lit(False))
    kept = lambda c: F.when(whole, F.col(c))     # noqa: E731
    return docs.select(kept("candidate_id").alias("candidate_id"), kept("profile.years_of_experience").alias("years_of_experience"), whole.alias("is_object"))


@register("scan_json_array", query("SELECT candidate_id, years AS years_of_experience, title AS current_title FROM prof", "prof"))
def scan_json_array(spark, sf) -> DataFrame:
    """Every document as an element of a JSON array file, read back element by element."""
    docs = T.candidates(spark, sf)
    path = sinks.new_folder(spark, "arrays")
    _write_arrays(docs, path)
    back = readers.read_documents_json_array(spark, path, candidate_ddl())
    return back.select("candidate_id", "profile.years_of_experience", "profile.current_title")


def _write_arrays(docs: DataFrame, path: str) -> None:
    """Every task writes its documents as one pretty-printed JSON array file, batch by batch."""
    body = docs.select(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).alias("value"))

    def bracket(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        mark = "["
        for batch in batches:
            marks = pa.array([mark] * min(batch.num_rows, 1) + [","] * (batch.num_rows - 1), pa.string())
            mark = "," if batch.num_rows else mark
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(marks, batch.column(0).cast(pa.string()), "")], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"], pa.string())], ["value"])

    body.mapInArrow(bracket, "value string").write.text(path)


@register("parse_errors", query("SELECT d, CASE broken WHEN 'JSONDecodeError' THEN 'unparsed' WHEN 'StructureError' THEN 'ARRAY' ELSE 'OBJECT' END AS root_type FROM kind", "kind"))
def parse_errors(spark, sf) -> DataFrame:
    return _parsed(spark, sf).select("d", F.coalesce("root_type", F.lit("unparsed")).alias("root_type"))


for _rule_name in ("required", "range", "enum", "pattern", "cardinality", "type"):
    def _run(spark, sf, rule=_rule_name) -> DataFrame:
        return _rule(spark, sf, rule)

    register("validate_types" if _rule_name == "type" else f"validate_{_rule_name}", query(
        f"SELECT d, replace(path, chr(1), '/') AS path, message FROM bad WHERE rule = '{_rule_name}'", "bad"))(_run)


@register("violations", query("SELECT d, error_type, messages FROM classified WHERE error_type = 'SchemaValidation'", "classified"))
def violations(spark, sf) -> DataFrame:
    rows = _classified(spark, sf).filter(F.col("error_type") == I.SCHEMA_ERROR)
    return rows.select("d", "error_type", F.array_join("messages", " | ").alias("messages"))


@register("quarantine", query("SELECT d, candidate_id, error_type, messages FROM classified WHERE error_type IS NOT NULL", "classified"))
def quarantine(spark, sf) -> DataFrame:
    _, bad = I.split_valid_quarantine(_classified(spark, sf))
    return bad.select("d", "candidate_id", "error_type", F.array_join("messages", " | ").alias("messages"))


@register("load_summary", query("""SELECT count(*) AS total, CAST(sum(CASE WHEN error_type IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS valid,
    CAST(sum(CASE WHEN error_type IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS invalid, round(avg(CASE WHEN error_type IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS success_rate FROM classified""", "classified"))
def load_summary(spark, sf) -> DataFrame:
    return I.load_summary(_classified(spark, sf)).withColumn("success_rate", F.round("success_rate", 6))


@register("limit_valid", query("SELECT candidate_id FROM classified WHERE error_type IS NULL ORDER BY candidate_id LIMIT 50", "classified"))
def limit_valid(spark, sf) -> DataFrame:
    valid, _ = I.split_valid_quarantine(_classified(spark, sf))
    return I.limit_valid(valid, 50).select("candidate_id")


@register("validate_off", query("""SELECT d, CASE WHEN broken IS NOT NULL THEN broken WHEN NOT regexp_full_match(id, 'CAND_[0-9]{7}') OR n_lines NOT BETWEEN 1 AND 10 OR years > 50
      OR d IN (SELECT d FROM bad WHERE rule IN ('enum', 'range') AND path NOT LIKE 'profile%') THEN 'PydanticValidation' ELSE 'valid' END AS outcome FROM kind""", "kind", "bad"))
def validate_off(spark, sf) -> DataFrame:
    """Without the contract stage only the looser record model decides; text numbers are cast."""
    return _classified(spark, sf, validate=False).select("d", F.coalesce("error_type", F.lit("valid")).alias("outcome"))


@register("validate_off_values", query("""SELECT id AS candidate_id, years AS years_of_experience, 'value' AS extra FROM kind WHERE broken IS NULL AND regexp_full_match(id, 'CAND_[0-9]{7}')
    AND n_lines BETWEEN 1 AND 10 AND years <= 50 AND d NOT IN (SELECT d FROM bad WHERE rule IN ('enum', 'range') AND path NOT LIKE 'profile%')""", "kind", "bad"))
def validate_off_values(spark, sf) -> DataFrame:
    """Text numbers keep their value without the contract, a repeated key its last one, and unknown keys stay in the raw line."""
    lines = T.raw_lines(spark, sf)
    twice = F.regexp_replace("value", r'\}\s*$', ',"extra":"first","extra":"value"}')
    lines = lines.withColumn("value", F.when(F.substring("value", 1, 1) == "{", twice).otherwise(F.col("value")))
    valid, _ = I.split_valid_quarantine(I.classify(lines, validate=False), validate=False, keep_raw=True)
    return valid.select("candidate_id", "profile.years_of_experience", F.expr("try_variant_get(try_parse_json(value), '$.extra', 'string')").alias("extra"))


@register("defaults", query("""SELECT id AS candidate_id, CASE WHEN source = 'src7' THEN 0 ELSE (SELECT count(*) FROM line l WHERE l.d = k.d AND l.l % 3 = 0) END AS n_education,
    CASE WHEN n % 5 = 0 THEN 2 ELSE 0 END AS n_assessments FROM kind k WHERE broken IS NULL""", "kind", "line"))
def defaults(spark, sf) -> DataFrame:
    lines = _parsed(spark, sf).filter("is_object").select("value")
    docs = I.apply_defaults(readers.parse_typed(lines, candidate_ddl()))
    return docs.select("candidate_id", F.size("education").cast("bigint").alias("n_education"),
                       F.size("signals.skill_assessment_scores").cast("bigint").alias("n_assessments"))


@register("sample_errors", query("SELECT source AS source_file, d, error_type FROM classified WHERE error_type IS NOT NULL ORDER BY source, d LIMIT 20", "classified"))
def sample_errors(spark, sf) -> DataFrame:
    _, bad = I.split_valid_quarantine(_classified(spark, sf))
    keyed = bad.withColumn("value", F.lpad(F.col("d").cast("string"), 12, "0"))
    return I.sample_errors(keyed, 20).select("source_file", "d", "error_type")


@register("errors_left", query("SELECT least(count(*), 20) AS shown, greatest(count(*) - 20, 0) AS more FROM classified WHERE error_type IS NOT NULL", "classified"))
def errors_left(spark, sf) -> DataFrame:
    """What a report adds to its sample of errors: "and N more"."""
    _, bad = I.split_valid_quarantine(_classified(spark, sf))
    return I.errors_left(bad, 20)


@register("stream_ingest", query("SELECT coalesce(error_type, 'valid') AS outcome, count(*) AS n_rows FROM classified GROUP BY 1", "classified"))
def stream_ingest(spark, sf) -> DataFrame:
    """The stored lines as a stream, classified and appended, then counted."""
    source, out = _stored_lines(spark, sf), sinks.new_folder(spark, "stream")
    done = ST.write_classified(ST.stream_lines(spark, source), f"{out}/rows", f"{out}/log")
    done.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.groupBy(F.coalesce("error_type", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n_rows"))


@register("stream_restart", query("SELECT coalesce(error_type, 'valid') AS outcome, count(*) AS n_rows, count(DISTINCT candidate_id) AS n_ids FROM classified GROUP BY 1", "classified"))
def stream_restart(spark, sf) -> DataFrame:
    """The lines in several micro-batches, stopped after the first and resumed from the checkpoint; no row is lost or repeated."""
    source, out = _stored_lines(spark, sf), sinks.new_folder(spark, "restart")
    start = lambda **how: ST.write_classified(ST.stream_lines(spark, source, 3), f"{out}/rows", f"{out}/log", **how)
    ST.stop_after(start(interval="0 seconds"), 1)
    start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.groupBy(F.coalesce("error_type", F.lit("valid")).alias("outcome")).agg(
        F.count("*").alias("n_rows"), F.count_distinct("candidate_id").alias("n_ids"))


BATCHES = 3


def _in_batches(rows: DataFrame) -> DataFrame:
    """Rows to be written as enough files for several micro-batches; a larger input keeps its own partitions and is not shuffled."""
    return rows if rows.rdd.getNumPartitions() >= BATCHES else rows.repartition(BATCHES)


def _per_batch(files: DataFrame) -> int:
    """Files a micro-batch takes, so that the stream has ``BATCHES`` of them, each shared by many tasks."""
    return max(1, -(-len(files.inputFiles()) // BATCHES))


@register("stream_rank", query("""SELECT job_id, candidate_id, final AS final_score, CAST(rnk AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY final DESC, candidate_id) AS rnk FROM sc
    WHERE candidate_id NOT IN (SELECT 'CAND_' || lpad(CAST(d AS VARCHAR), 7, '0') FROM line GROUP BY d HAVING count(*) > 10 OR count(*) FILTER (l % 3 = 0) > 5)) WHERE rnk <= 10""", "sc", "line"))
def stream_rank(spark, sf) -> DataFrame:
    """Documents arrive as JSON lines; what meets the contract of a micro-batch is scored and merged into the running top-k per job."""
    out = sinks.new_folder(spark, "ranked")
    lines = T.candidates(spark, sf).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    _in_batches(lines).write.text(f"{out}/in")
    each = _per_batch(spark.read.text(f"{out}/in"))
    vectors, jobs = T.vectors(spark, sf), T.jobs(spark, sf)
    score = lambda batch: ST.score_lines(batch, vectors, jobs, T.AS_OF).select("job_id", "candidate_id", "final_score")
    ST.stream_shortlist(score, ST.stream_lines(spark, f"{out}/in", each), f"{out}/best", f"{out}/log", TOP10).awaitTermination()
    return ST.latest_shortlist(spark, f"{out}/best")


@register("stream_topk", query("SELECT job_id, candidate_id, final AS final_score, CAST(rnk AS INTEGER) AS rank FROM top10", "top10"))
def stream_topk(spark, sf) -> DataFrame:
    """Scored rows arrive as files; a running top-k per job is kept across micro-batches."""
    out = sinks.new_folder(spark, "running")
    _in_batches(T.scored(spark, sf).select("job_id", "candidate_id", "final_score")).write.parquet(f"{out}/in")
    stored = spark.read.parquet(f"{out}/in")
    feed = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", _per_batch(stored)).parquet(f"{out}/in")
    ST.stream_shortlist(lambda batch: batch, feed, f"{out}/best", f"{out}/log", TOP10).awaitTermination()
    return ST.latest_shortlist(spark, f"{out}/best")


@register("snapshot_roundtrip", query("SELECT candidate_id, years AS total_years, title AS current_title FROM prof", "prof"))
def snapshot_roundtrip(spark, sf) -> DataFrame:
    """Two runs are stored, the first is rewritten, the latest is read back."""
    path = sinks.new_folder(spark, "snapshot")
    slim = T.candidates(spark, sf).select("candidate_id", F.col("profile.years_of_experience").alias("total_years"), "profile.current_title")
    sinks.write_snapshot(slim.withColumn("total_years", F.lit(0.0)), path, "run-1")
    sinks.write_snapshot(slim, path, "run-2")
    sinks.write_snapshot(slim.withColumn("total_years", F.lit(1.0)), path, "run-1")
    return sinks.read_snapshot(spark, path)


@register("stale_stages", """SELECT * FROM (VALUES ('nothing', 'features', true), ('nothing', 'shortlist', true), ('configuration', 'features', true), ('configuration', 'shortlist', false),
    ('pool', 'features', false), ('pool', 'shortlist', false)) v(changed, stage, fresh), (SELECT count(*) AS n_features FROM documents)""")
def stale_stages(spark, sf) -> DataFrame:
    """Features and a shortlist are stored; then nothing, the configuration or one document of the pool changes."""
    root = sinks.new_folder(spark, "stages")
    pool = T.candidates(spark, sf).select("candidate_id", F.col("profile.years_of_experience").alias("years"), "profile.headline")
    other = pool.withColumn("headline", F.when(F.col("candidate_id") == "CAND_0000001", "Other").otherwise(F.col("headline")))

    def keys(rows, config):
        made = stages.stage_key({"pool": rows})
        return {"features": made, "shortlist": stages.stage_key({"features": made}, config)}

    now = keys(pool, TOP10)
    features = stages.fresh_stage(spark, root, "features", now["features"], lambda: pool)
    stages.fresh_stage(spark, root, "shortlist", now["shortlist"], lambda: R.top_k(features, 10, score="years"))
    n = features.agg(F.count("*")).scalar()
    asked = {"nothing": now, "configuration": keys(pool, EngineConfig(top_k=11)), "pool": keys(other, TOP10)}
    rows = [stages.state(spark, root, k).select(F.lit(changed).alias("changed"), "stage", "fresh") for changed, k in asked.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("n_features", n)


@register("submission", query("""SELECT candidate_id, CAST(rnk AS INTEGER) AS rank, printf('%.4f', final) AS score, 'Best at ' || job_id AS reasoning FROM
    (SELECT *, row_number() OVER (ORDER BY final DESC, candidate_id) AS rnk FROM best) WHERE rnk <= 100""", "best"))
def submission(spark, sf) -> DataFrame:
    """The best hundred as a CSV file, read back as text."""
    from workload.q_ranking import _one_job
    best = R.top_k(_one_job(spark, sf), 100).withColumn("reasoning", F.concat(F.lit("Best at "), F.col("job_id")))
    path = sinks.new_folder(spark, "submission")
    sinks.write_submission(best, path)
    return spark.read.csv(path, header=True, schema="candidate_id string, rank int, score string, reasoning string")
