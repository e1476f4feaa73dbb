"""The given tables in candidate, posting and job shape.

A row of ``documents`` is one candidate document: its lines become jobs and schools, its
clauses skills, its whole text the summary.  Everything is a map over the row, so nested
lists are never collected across rows.  Names come from the small catalogues below, chosen
by text length; the SQL in ``workload.sql`` states the same mapping for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from candela.config import EngineConfig
from candela.functions.text import normalise_text, sql_string
from candela.plans.features import base_features
from candela.plans.shortlist import score_pairs
from candela.sources.schema import candidate_ddl

AS_OF = "2024-02-15"

COMPANIES = ["Northwind Traders", "Google India", "Infosys Ltd", "Acme Stealth Labs", "Wipro Digital",
             "Razorpay", "Seed Garden", "Contoso", "Accenture AI"]
SERVICES = ["TCS", "Cognizant", "HCL Technologies"]
TITLES = ["Senior ML Engineer", "Data Scientist", "Accountant", "Content Writer", "Sales Officer",
          "Lead Developer", "Research Scientist", "Nurse", "NLP Engineer", "Civil Surveyor"]
INDUSTRIES = ["Fintech", "Robotics", "IT Services", "Food", "Data Science"]
SIZES = ["1-10", "11-50", "51-200", "201-500", "501-1000", "1001-5000", "5001-10000", "10001+"]
SKILLS = ["Python", "FAISS", "Figma", "PyTorch", "Kafka", "RAG", "Excel", "NLP", "Docker", "Sales",
          "BM25", "Tally", "LoRA", "Spark", "Photoshop", "XGBoost", "MLflow", "Welding", "NDCG",
          "Sentence Transformers", "Six Sigma", "BERT", "Milvus", "SEO"]
LEVELS = ["beginner", "intermediate", "advanced", "expert"]
DEGREES = ["B.Tech", "M.Tech", "Ph.D", "BA", "MBA"]
FIELDS = ["Computer Science", "History", "Statistics", "Law", "Data Science", "Fine Arts"]
TIER_NAMES = ["tier_1", "tier_2", "tier_3", "tier_4", "unknown"]
CERTIFICATES = ["Scrum Master Certified", "NLP Specialization", "Six Sigma Green Belt", "AWS Certified ML"]
TONGUES = ["basic", "conversational", "professional", "native"]
PLACES = ["Pune, Maharashtra", "Noida, UP", "Berlin", "Lyon", "Hyderabad, Telangana", "Madrid"]
COUNTRIES = {"en": "India", "de": "Germany", "fr": "France", "es": "Spain"}
MODES = ["remote", "hybrid", "onsite", "flexible"]
REQUIRED = [
    ["Embeddings-based retrieval", "Vector database / hybrid search", "Python (production quality)", "Quantum chemistry"],
    ["PyTorch", "Kafka streaming", "XGBoost", "Haskell", "Spark"],
    ["Management accounting", "Welding", "Cobol"],
]
PREFERRED = [["LLM fine-tuning (LoRA, QLoRA, PEFT)", "Learning-to-rank models"], ["Docker", "ISO-9001", "A/B testing"]]
TOOLS = ["faiss", "milvus", "spark"]
YARDSTICKS = ["NDCG", "MRR"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _list(values) -> str:
    return "array(" + ", ".join(sql_string(v) for v in values) + ")"


def _pick(values, index: str) -> str:
    """SQL: the catalogue entry at ``index`` modulo its size."""
    return f"element_at({_list(values)}, cast(pmod({index}, {len(values)}) AS int) + 1)"


def spread(df: DataFrame) -> DataFrame:
    """Spread an input of fewer splits than cores before heavy per-row work.

    A small file is a single split and would keep one core busy.  Any input with enough
    files or splits, so every large one, passes through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores
    return df.repartition(cores) if small else df


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` with its non-blank lines and clauses."""
    return spread(table(spark, sf, "documents")).selectExpr(
        "doc_id AS d", "n_chars AS n", "lang", "source", "text",
        "filter(split(text, '\\n'), x -> trim(x) <> '') AS lines",
        "filter(split(text, ','), x -> trim(x) <> '') AS clauses")


def _nested(sizes: str, endorsements: str, years: str, ident: str) -> list[str]:
    country = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COUNTRIES.items()) + " END"
    firm = f"CASE WHEN source IN ('src1', 'src2', 'src3') THEN {_pick(SERVICES, 'length(x)')} ELSE {_pick(COMPANIES, 'length(x)')} END"
    return [
        f"{ident} AS candidate_id",
        f"""named_struct('anonymized_name', concat('Person ', d),
            'headline', concat({_pick(SKILLS, 'n')}, ' ', {_pick(TITLES, 'n')}), 'summary', text,
            'location', {_pick(PLACES, 'n')}, 'country', {country}, 'years_of_experience', {years},
            'current_title', {_pick(TITLES, 'n')}, 'current_company', {_pick(COMPANIES, 'n')},
            'current_company_size', {_pick(SIZES, 'n')}, 'current_industry', {_pick(INDUSTRIES, 'n')}) AS profile""",
        f"""transform(lines, (x, i) -> named_struct('company', {firm}, 'title', {_pick(TITLES, 'length(x)')},
            'start_date', cast(date_add(DATE'2010-01-01', length(x)) AS string),
            'end_date', CASE WHEN i > 0 THEN cast(date_add(DATE'2012-01-01', length(x)) AS string) END,
            'duration_months', cast(length(x) % 48 AS double), 'is_current', i = 0,
            'industry', {_pick(INDUSTRIES, 'length(x)')}, 'company_size', {sizes}, 'description', x)) AS career_history""",
        f"""transform(filter(lines, x -> length(x) % 3 = 0), x -> named_struct('institution', source,
            'degree', {_pick(DEGREES, 'length(x)')}, 'field_of_study', {_pick(FIELDS, 'length(x)')},
            'start_year', cast(1990 + length(x) % 30 AS double), 'end_year', cast(1994 + length(x) % 30 AS double),
            'grade', CASE WHEN length(x) % 2 = 1 THEN cast(length(x) % 10 AS string) END,
            'tier', {_pick(TIER_NAMES, 'length(x)')})) AS education""",
        f"""transform(clauses, x -> named_struct('name', {_pick(SKILLS, 'length(x)')},
            'proficiency', {_pick(LEVELS, 'length(x)')}, 'endorsements', {endorsements},
            'duration_months', cast(length(x) % 72 AS double))) AS skills""",
        f"""transform(filter(lines, x -> length(x) % 6 = 0), x -> named_struct('name', {_pick(CERTIFICATES, 'length(x) div 6')},
            'issuer', source, 'year', cast(2010 + length(x) % 14 AS double))) AS certifications""",
        f"array(named_struct('language', lang, 'proficiency', {_pick(TONGUES, 'n')})) AS languages",
        f"""named_struct('profile_completeness_score', cast(n % 101 AS double),
            'signup_date', cast(date_add(DATE'2022-01-01', cast(n % 900 AS int)) AS string),
            'last_active_date', CASE WHEN n % 41 = 0 THEN 'unknown'
                ELSE cast(date_add(DATE'2023-01-01', cast((n * 7 + d) % 420 AS int)) AS string) END,
            'open_to_work_flag', n % 3 = 0, 'profile_views_received_30d', cast(n % 195 AS double),
            'applications_submitted_30d', cast(n % 17 AS double), 'recruiter_response_rate', (n % 101) / 100.0D,
            'avg_response_time_hours', (n % 480) / 2.0D,
            'skill_assessment_scores', CASE WHEN n % 5 = 0 THEN map('NLP', cast(n % 101 AS double), 'Excel', cast(d % 101 AS double))
                ELSE cast(map() AS map<string, double>) END,
            'connection_count', cast(n % 485 AS double), 'endorsements_received', cast(n % 51 AS double),
            'notice_period_days', cast((n * 37) % 181 AS double),
            'expected_salary_range_inr_lpa', named_struct('min', cast(5 + n % 23 AS double), 'max', cast(4 + d % 40 AS double)),
            'preferred_work_mode', {_pick(MODES, 'n')}, 'willing_to_relocate', d % 2 = 0,
            'github_activity_score', CASE WHEN n % 3 = 0 THEN -1.0D ELSE cast(d % 101 AS double) END,
            'search_appearance_30d', cast(n % 778 AS double), 'saved_by_recruiters_30d', cast(n % 10 AS double),
            'interview_completion_rate', (d % 101) / 100.0D,
            'offer_acceptance_rate', CASE WHEN n % 3 = 1 THEN -1.0D ELSE (n % 101) / 100.0D END,
            'verified_email', n % 9 <> 0, 'verified_phone', d % 3 <> 0, 'linkedin_connected', n % 3 = 0) AS signals""",
    ]


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """One candidate document per row of ``documents``; a pure map."""
    shape = _nested(_pick(SIZES, "length(x)"), "cast((length(x) * 7) % 60 AS double)",
                    "(n % 180) / 10.0D", "concat('CAND_', lpad(d, 7, '0'))")
    return documents(spark, sf).selectExpr(*shape)


def raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same documents as JSON text with faults of every kind, chosen by language and source."""
    sizes = f"CASE WHEN lang = 'fr' THEN {_pick(SIZES + ['1-11'], 'length(x)')} ELSE {_pick(SIZES, 'length(x)')} END"
    votes = "CASE WHEN source = 'src11' THEN cast(length(x) % 5 - 1 AS double) ELSE cast((length(x) * 7) % 60 AS double) END"
    years = "CASE WHEN source = 'src9' THEN (n % 600) / 10.0D ELSE (n % 180) / 10.0D END"
    ident = "CASE WHEN source = 'src5' THEN concat('CAND_', d) ELSE concat('CAND_', lpad(d, 7, '0')) END"
    fields = _nested(sizes, votes, years, ident)
    packed = documents(spark, sf).selectExpr("d", "n", "lang", "source", *fields)
    body = F.to_json(F.struct("candidate_id", "profile", "career_history", "education", "skills", "certifications",
                              "languages", "signals"), {"ignoreNullFields": "false"})
    lines = packed.select("d", "n", "lang", "source", body.alias("j"))
    faults = (F.when((F.col("lang") == "es") & (F.col("n") % 5 == 0), F.expr("substring(j, 1, length(j) - 1)"))
              .when((F.col("lang") == "de") & (F.col("source") == "src13"), F.concat(F.lit("["), "j", F.lit("]")))
              .when(F.col("source") == "src7", F.replace("j", F.lit('"education":'), F.lit('"schooling":')))
              .when(F.col("source") == "src17", F.replace("j", F.lit('"end_date":'), F.lit('"ended":')))
              .when(F.col("source") == "src4", F.regexp_replace(
                  "j", r'"years_of_experience":([0-9.]+)', r'"years_of_experience":"$1"'))
              .otherwise(F.col("j")))
    return lines.select(faults.alias("value"), F.col("source").alias("source_file"), "d")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr("concat('CAND_', lpad(vec_id, 7, '0')) AS candidate_id", "embedding")


def _skill_items(groups: list[list[str]], index: str) -> str:
    lists = ", ".join(_list(g) for g in groups)
    return (f"transform(element_at(array({lists}), cast(pmod({index}, {len(groups)}) AS int) + 1), s -> named_struct("
            f"'original', s, 'canonical', lower(s), 'category', 'other', "
            f"'tokens', filter(split(lower(s), '[\\\\s/\\\\-,]+'), t -> length(t) > 2)))")


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """One job per embedding label; its vector is the label's first one."""
    first = table(spark, sf, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("job_vec"))
    return first.selectExpr(
        "concat('JOB_', label) AS job_id", "concat('Role ', label) AS job_title", "'Contoso' AS company",
        "cast(label AS double) AS min_years", "label + 3.0D AS max_years",
        "CASE WHEN label % 2 = 1 THEN label + 1.0D END AS recommended_min",
        "CASE WHEN label % 2 = 1 THEN label + 2.0D END AS recommended_max",
        f"{_pick(['Hybrid', 'Remote', 'Onsite'], 'label')} AS work_mode",
        f"{_skill_items(REQUIRED, 'label')} AS required_skills",
        f"{_skill_items(PREFERRED, 'label')} AS preferred_skills",
        f"{_list(TOOLS)} AS ai_technologies", f"{_list(YARDSTICKS)} AS evaluation_metrics",
        "array(concat('Own area ', label), 'Ship it') AS responsibilities", "job_vec")


def base(spark: SparkSession, sf: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return base_features(candidates(spark, sf), AS_OF, keep=keep)


def scored(spark: SparkSession, sf: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """All (job, candidate) rows with every score."""
    return score_pairs(base(spark, sf), vectors(spark, sf), jobs(spark, sf), config)


# --- postings -------------------------------------------------------------------

HEADINGS = ["Things you absolutely need:", "Things we'd like you to have but won't reject you for",
            "Things we explicitly do NOT want.", "What you'd actually be doing", "On location, comp, and logistics",
            "The vibe check", "How to read between the lines", "About us"]
PHRASES = ["", " (Pinecone, FAISS, or similar)", " We'd love sub-30-day notice and can buy out up to 45 days.",
           " Our office is in Pune and Bangalore, relocation welcome.", " Apply from India; we don't sponsor a visa.",
           " You own the mandate (vector db and Learning to Rank)", " 60+ day notice is fine, mentoring too.",
           " Apply at any location, visa possible — NCR → Mumbai."]
SHORT_LINE = 60


def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as a posting: header lines, a title, then headings and bullets."""
    body = (f"transform(lines, (x, i) -> named_struct("
            f"'style', CASE WHEN i = 0 THEN 'Title' WHEN length(x) < {SHORT_LINE} THEN 'Heading 1' "
            f"WHEN length(x) % 5 = 0 THEN 'Normal' ELSE 'List Bullet' END, "
            f"'text', CASE WHEN i = 0 THEN concat('Job Description: ', x) "
            f"WHEN length(x) < {SHORT_LINE} THEN {_pick(HEADINGS, 'length(x)')} "
            f"ELSE concat(x, {_pick(PHRASES, 'length(x)')}) END))")
    head = ("array(named_struct('style', 'Normal', 'text', concat('Company: ', source, ' (', lang, ')')), "
            "named_struct('style', 'Normal', 'text', CASE WHEN n % 4 = 0 THEN 'Experience Required: open' "
            "WHEN n % 4 = 1 THEN concat('Experience Required: ', n % 9, ' years') "
            "WHEN n % 4 = 2 THEN concat('Experience Required: ', n % 9, '–', n % 9 + 3, ' years') "
            "ELSE concat('Experience Required: ', n % 9 + 3, '–', n % 9, ' years') END), "
            f"named_struct('style', 'Normal', 'text', concat('Location:  ', {_pick(PLACES, 'n')}, ' - ', {_pick(MODES, 'n')})))")
    return documents(spark, sf).selectExpr(
        "concat('POST_', d) AS job_id", f"posexplode(concat({head}, {body})) AS (para_no, p)").select(
        "job_id", "para_no", "p.style", "p.text")


def posting_text(spark: SparkSession, sf: str) -> DataFrame:
    """Whole text of each posting, one row per posting."""
    return spread(table(spark, sf, "documents")).select(
        F.concat(F.lit("POST_"), F.col("doc_id")).alias("job_id"), normalise_text(F.col("text")).alias("full_text"))
