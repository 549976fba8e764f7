"""Queries of problem 3, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.table_diff import parity_differences
from .session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every difference between a harness run and the run it repeats."""
    found = parity_differences(table(spark, sf_dir, "runs"), table(spark, sf_dir, "example_results"))
    return found.select("run_id", "example_id", "field").distinct()


def p3_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences by field, over all pairs of runs."""
    found = parity_differences(table(spark, sf_dir, "runs"), table(spark, sf_dir, "example_results"))
    return found.groupBy("field").agg(F.count("*").alias("n_examples"), F.countDistinct("harness").alias("n_pairs"))


QUERIES = {"p3_found": p3_found, "p3_field_counts": p3_field_counts}

_FOUND = """cur AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY recorded_at DESC) = 1),
 pair AS (SELECT run_id AS harness, json_extract_string(config_json, '$.parity_of') AS base FROM cur WHERE status = 'done' AND framework = 'lm_eval_harness'
          AND json_extract_string(config_json, '$.parity_of') IN (SELECT run_id FROM cur WHERE status = 'done' AND framework = 'ladder')),
 v AS (SELECT * FROM example_results WHERE run_id IS NOT NULL AND example_id IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY run_id, example_id ORDER BY recorded_at DESC) = 1),
 a AS (SELECT harness, base, v.* FROM pair JOIN v ON v.run_id = base),
 b AS (SELECT harness, base, v.* FROM pair JOIN v ON v.run_id = harness),
 j AS (SELECT coalesce(a.harness, b.harness) AS harness, coalesce(a.base, b.base) AS run_id, coalesce(a.example_id, b.example_id) AS example_id,
         a.example_id IS NULL AS no_a, b.example_id IS NULL AS no_b, a.correct AS c1, b.correct AS c2, a.score AS s1, b.score AS s2, a.detail_json::JSON AS d1, b.detail_json::JSON AS d2
       FROM a FULL JOIN b ON a.harness = b.harness AND a.example_id = b.example_id),
 f AS (SELECT harness, run_id, example_id, d1, d2, unnest(list_distinct(list_concat(coalesce(json_keys(d1), []), coalesce(json_keys(d2), [])))) AS field FROM j WHERE NOT no_a AND NOT no_b),
 e AS (SELECT harness, run_id, example_id, field, json_extract(d1, '$."' || field || '"') AS x, json_extract(d2, '$."' || field || '"') AS y FROM f),
 t AS (SELECT *, coalesce(json_type(x), 'NULL') AS tx, coalesce(json_type(y), 'NULL') AS ty FROM e),
 n AS (SELECT *, CASE WHEN tx IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND ty IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN abs(x::DOUBLE - y::DOUBLE) <= 1.000000001e-6
         WHEN tx = 'ARRAY' AND ty = 'ARRAY' THEN json_array_length(x) = json_array_length(y)
           AND coalesce(list_bool_and(list_transform(list_zip(x::DOUBLE[], y::DOUBLE[]), lambda z: abs(z[1] - z[2]) <= 1.000000001e-6)), true)
         ELSE tx = ty AND (tx = 'NULL' OR x::VARCHAR = y::VARCHAR) END AS same FROM t),
 found AS (
   SELECT harness, run_id, example_id, CASE WHEN no_b THEN 'only_ladder' ELSE 'only_harness' END AS field FROM j WHERE no_a OR no_b
   UNION SELECT harness, run_id, example_id, 'correct' FROM j WHERE NOT no_a AND NOT no_b AND c1 IS DISTINCT FROM c2
   UNION SELECT harness, run_id, example_id, 'score' FROM j WHERE NOT no_a AND NOT no_b AND (s1 IS NULL) IS DISTINCT FROM (s2 IS NULL)
   UNION SELECT harness, run_id, example_id, 'score' FROM j WHERE NOT no_a AND NOT no_b AND abs(s1 - s2) > 1.000000001e-6
   UNION SELECT harness, run_id, example_id, field FROM n WHERE NOT same)"""

ORACLE = {
    "p3_found": f"WITH {_FOUND} SELECT DISTINCT run_id, example_id, field FROM found",
    "p3_field_counts": f"WITH {_FOUND} SELECT field, count(*) AS n_examples, count(DISTINCT harness) AS n_pairs FROM found GROUP BY field",
}
