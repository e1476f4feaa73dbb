"""Query of ranked lexical search, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from candela.llm import lexical
from candela.llm.common import table


def op11_block_max_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT count(*) FILTER (len(t) > 0) AS n, coalesce(sum(len(t)), 0)::BIGINT AS l FROM d),
p AS (SELECT r, doc_id, 50 + (50 * len(t) * c.n) // c.l AS m, unnest(t) AS term FROM d, c),
tf AS (SELECT r, doc_id, m, term, count(*) AS tf FROM p SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(c.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST))::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 50"""

QUERIES = {"op11_block_max_maxscore": op11_block_max_maxscore}
ORACLES = {"op11_block_max_maxscore": OP11_SQL}
