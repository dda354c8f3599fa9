"""The registered queries of this subpackage and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from shelfmark.llm import (
    ball_tree, fill_middle, filter_audit, licenses, lsh_forest, mixing, packing, quality, simhash_search, simple8b, space_curves, substring_dedup, warc,
)
from shelfmark.llm.ship import ship

WARC_DATE = "2026-01-01T00:00:00Z"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeated(table(spark, folder, "documents"))


def op2_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, folder, "pages"), WARC_DATE), keep=("page_id",))


def op3_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return ball_tree.top_k_of_table(table(spark, folder, "embeddings"))


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return lsh_forest.join(table(spark, folder, "documents"))


def op5_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return space_curves.nearest(table(spark, folder, "embeddings"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).drop("spans")


def op9_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return simple8b.round_trip(table(spark, folder, "documents"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.digests(table(spark, folder, "documents"))


def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_search.near_duplicates(table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Query] = {
    q.__name__: q for q in (
        op1_substring_dedup, op2_warc_derivatives, op3_exact_top_k, op4_ngram_jaccard_join, op5_nearest_neighbours, op6_packing,
        op7_quality_classifier, op8_license_scan, op9_token_ids, op10_mixing, op11_filter_audit, op12_fill_middle, op13_simhash, pipeline,
    )
}


# op2 resolves all of HTML's entities, which SQL has no table of; tests compare it with brute force.
ORACLES: dict[str, str] = {
    "op3_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x AS double))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, cast(rank AS integer) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id, cast(list_inner_product(q.e, c.e) AS bigint) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) s) r
WHERE rank <= 10
""",
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
             100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
             coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e
      FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
n AS (SELECT part, a, b, c, d, e, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
      WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
k AS (SELECT part, filter_order, step, n, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda y, i: [a, b, c, d, e][i]) AS fails,
             filter_order[step] AS own, filter_order[1:step - 1] AS earlier
      FROM n, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
m AS (SELECT *, list_contains(fails, own) AS here, len(list_filter(fails, lambda y: contains(earlier, y))) > 0 AS gone FROM k),
g AS (SELECT part, filter_order, step, own, sum(if(NOT gone AND NOT here, n, 0)) AS kept, sum(if(NOT gone AND here, n, 0)) AS removed, sum(if(gone AND here, n, 0)) AS redundant,
             sum(if(here AND len(fails) = 1, n, 0)) AS unique_fails, sum(if(NOT gone AND here, good, 0)) AS good_lost, sum(if(NOT gone AND here, toxic, 0)) AS toxic_lost
      FROM m GROUP BY ALL)
SELECT part, filter_order, cast(step AS integer) AS step, cast(kept AS bigint) AS kept, cast(removed AS bigint) AS removed, cast(redundant AS bigint) AS redundant,
       cast(unique_fails AS bigint) AS unique_fails, cast(good_lost AS bigint) AS good_lost, cast(toxic_lost AS bigint) AS toxic_lost,
       cast(sum(removed) OVER (PARTITION BY part, own) AS bigint) AS shapley FROM g
""",
    "op12_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                  sha256('42:' || coalesce(cast(doc_id AS varchar), '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, [cast('0x' || h[8 * i + 1:8 * i + 8] AS bigint) FOR i IN [0, 1, 2, 3]] AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, cast(n AS bigint) AS n, form, if(form = 'plain', NULL, length(prefix)) AS prefix_chars, if(form = 'plain', NULL, length(middle)) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
""",
}
