"""The jobs as queries: each runs twice into one new folder and gives the whole output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import annotate_texts, score_feed
from jobs.common import default_config
from kinfold.plans.tables import new_path
from kinfold.queries import NBS_SQL


def job1_score_feed(spark: SparkSession, d: str) -> DataFrame:
    out, config = new_path(spark, "score-feed"), default_config(score_feed.__file__, score_feed.Config)
    for _ in range(2):  # the table may be a file, which a stream takes as a pattern only
        score_feed.run(spark, f"{d}/lineitem.parque[t]", f"{d}/part.parquet", f"{out}/output", f"{out}/checkpoint", config)
    return score_feed.read_scores(spark, f"{out}/output").withColumn("nbs", F.round("nbs", 6))


JOB1_SQL = f"""WITH last AS (SELECT * FROM (
  SELECT l_partkey AS q, l_suppkey AS r, l_extendedprice AS bitscore, l_quantity * 2 AS identity,
         row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) AS nth
  FROM lineitem WHERE l_partkey <> l_suppkey AND l_extendedprice IS NOT NULL AND l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL) WHERE nth = 1),
hits AS MATERIALIZED (SELECT a.p_type AS q_genome, b.p_type AS r_genome, q, r, bitscore, identity, CAST(a.p_size AS BIGINT) * b.p_size AS len_product
  FROM last JOIN part a ON q = a.p_partkey JOIN part b ON r = b.p_partkey WHERE a.p_type IS NOT NULL AND b.p_type IS NOT NULL),{NBS_SQL}
SELECT q_genome, r_genome, q, r, bitscore, identity, round(nbs, 6) AS nbs FROM nbs"""


def job2_annotate_texts(spark: SparkSession, d: str) -> DataFrame:
    out, config = new_path(spark, "annotate-texts"), default_config(annotate_texts.__file__, annotate_texts.Config)
    for _ in range(2):
        annotate_texts.run(spark, f"{d}/documents.parquet", f"{d}/benchmark.parquet", out, config)
    shown = annotate_texts.read_annotations(spark, out)
    return shown.withColumn("identity", F.round("identity", 6)).withColumn("coverage", F.round("coverage", 6))


_LIST = f"regexp_extract_all(translate(text, '{annotate_texts.CAPITALS}', '{annotate_texts.SMALL}'), '{annotate_texts.WORD}')"


def _runs_sql(rows: str, key: str) -> str:
    """The runs of the word lists ``w`` of ``rows``: each word with the next four, as far as the list has them."""
    following = ", ".join(f"lead(x, {k}) OVER o" for k in range(1, 5))
    return f"""SELECT {key}, least(n, 5) AS n, run, first FROM (
  SELECT {key}, n, i - 1 AS first, concat_ws(' ', x, {following}) AS run FROM (
    SELECT {key}, r, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT *, row_number() OVER () AS r FROM {rows})) WINDOW o AS (PARTITION BY r ORDER BY i))
 WHERE first <= greatest(n - 5, 0)"""


JOB2_SQL = f"""WITH rec AS MATERIALIZED (SELECT source, doc_id, {_LIST} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
fam AS MATERIALIZED (SELECT item_id, {_LIST} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
recruns AS ({_runs_sql("rec", "source, doc_id")}),
famruns AS MATERIALIZED (SELECT item_id, run, min(first) AS f, max(first + n - 1) AS l FROM ({_runs_sql("fam", "item_id")}) GROUP BY 1, 2),
shared AS (SELECT source, doc_id, item_id, count(DISTINCT run) AS n, min(first) AS qs, max(first + n - 1) AS qe, min(f) AS ss, max(l) AS se
  FROM recruns JOIN famruns USING (run) GROUP BY 1, 2, 3),
hit AS (SELECT s.*, s.n * CAST(100 AS DOUBLE) / c.n_runs AS pident, a.q_len, b.s_len
  FROM shared s JOIN (SELECT source, doc_id, sum(len(w)) AS q_len FROM rec GROUP BY 1, 2) a ON a.source IS NOT DISTINCT FROM s.source AND a.doc_id = s.doc_id
  JOIN (SELECT item_id, sum(len(w)) AS s_len FROM fam GROUP BY 1) b ON b.item_id = s.item_id JOIN (SELECT item_id, count(*) AS n_runs FROM famruns GROUP BY 1) c ON c.item_id = s.item_id),
good AS (SELECT *, least((qe - qs) / CAST(q_len AS DOUBLE), (se - ss) / CAST(s_len AS DOUBLE)) * 100 AS cov FROM hit)
SELECT source, doc_id, item_id AS family, round(pident, 6) AS identity, round(cov, 6) AS coverage, CAST(n AS BIGINT) AS shared_runs, CAST(q_len AS BIGINT) AS n_words
FROM (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY pident DESC, n DESC, item_id) AS nth FROM good WHERE pident >= 40 AND cov >= 1) WHERE nth = 1"""

QUERIES = {"job1_score_feed": job1_score_feed, "job2_annotate_texts": job2_annotate_texts}
ORACLES = {"job1_score_feed": JOB1_SQL, "job2_annotate_texts": JOB2_SQL}
