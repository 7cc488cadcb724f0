"""Profiling keys over documents / labels / pages / events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.profile import (DESCRIBE, availability, coverage, describe, fetch_stats, to_long,
                                 value_counts)
from .q_text import LANGUAGE_SQL, detected_languages
from .registry import Tables, register

# "has image": the document appears in labels; evidence image: labels.toxic = 0
_SQL_IMG = """img AS (SELECT d.doc_id, d.source, d.lang, l.doc_id AS claim_image,
                     CASE WHEN l.toxic = 0 THEN l.doc_id END AS evidence_image
              FROM documents d LEFT JOIN (SELECT doc_id, min(toxic) AS toxic FROM labels GROUP BY doc_id) l
              ON l.doc_id = d.doc_id)"""


def _img(t):
    lab = t.labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    lab = lab.select(F.col("doc_id").alias("_l"), "toxic")
    d = t.documents.select("doc_id", "source", "lang", "text")
    j = d.join(lab, d.doc_id == lab._l, "left")
    return j.select("doc_id", "source", "lang", "text", F.col("_l").alias("claim_image"),
                    F.when(F.col("toxic") == 0, F.col("_l")).alias("evidence_image"))


@register("profile_category_counts", """
SELECT 'source' AS field, source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source
UNION ALL
SELECT 'lang', lang, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY lang""", "A1")
def q_profile_category_counts(spark, sf_dir):
    return value_counts(Tables(spark, sf_dir).documents, ["source", "lang"])


@register("profile_image_availability", f"""WITH {_SQL_IMG}
SELECT source, count(doc_id) AS total, count(claim_image) AS claim_images,
       count(evidence_image) AS evidence_images,
       round(100.0 * count(claim_image) / nullif(count(doc_id), 0), 6) AS claim_images_pct,
       round(100.0 * count(evidence_image) / nullif(count(doc_id), 0), 6) AS evidence_images_pct
FROM img GROUP BY source""", "A2 F12 J15")
def q_profile_image_availability(spark, sf_dir):
    j = _img(Tables(spark, sf_dir))
    return availability(j, "source", "doc_id", {"claim_images": F.col("claim_image"),
                                                "evidence_images": F.col("evidence_image")})


_SQL_DESCRIBE = """count({v}) AS count, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std,
round(min({v})::DOUBLE, 6) AS min, round(quantile_cont({v}, 0.25), 6) AS p25,
round(quantile_cont({v}, 0.5), 6) AS p50, round(quantile_cont({v}, 0.75), 6) AS p75,
round(max({v})::DOUBLE, 6) AS max"""


@register("profile_text_lengths", f"""SELECT lang, {_SQL_DESCRIBE.format(v='len')}
FROM (SELECT lang, length(coalesce(text, '')) AS len FROM documents) GROUP BY lang""", "A3 F10 P3")
def q_profile_text_lengths(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return describe(d, F.length(F.coalesce("text", F.lit(""))), ["lang"])


@register("profile_multimodal_coverage", f"""WITH {_SQL_IMG}
SELECT count(doc_id) AS rows, count(claim_image) AS with_a, count(evidence_image) AS with_b,
       count(*) FILTER (WHERE claim_image IS NOT NULL AND evidence_image IS NOT NULL) AS both,
       round(100.0 * count(*) FILTER (WHERE claim_image IS NOT NULL AND evidence_image IS NOT NULL)
             / nullif(count(doc_id), 0), 6) AS both_pct
FROM img""", "A4")
def q_profile_multimodal_coverage(spark, sf_dir):
    j = _img(Tables(spark, sf_dir))
    return coverage(j, "doc_id", F.col("claim_image"), F.col("evidence_image"))


@register("profile_length_diff", f"""SELECT {_SQL_DESCRIBE.format(v='diff')}
FROM (SELECT length(coalesce(html, '')) - length(coalesce(url, '')) AS diff FROM pages)""", "A5")
def q_profile_length_diff(spark, sf_dir):
    p = Tables(spark, sf_dir).pages
    return describe(p, F.length(F.coalesce("html", F.lit(""))) - F.length(F.coalesce("url", F.lit(""))))


# fetch status bound to events: category = event_type, role by hour of day,
# ok = value >= 50
def fetch_status_from_events(ev):
    return ev.select(F.col("event_id").alias("id"), F.col("event_type").alias("category"),
                     F.when(F.hour("ts") < 12, "claim").otherwise("evidence").alias("role"),
                     (F.col("value") >= 50).alias("ok"))


@register("fetch_stats_by_category", """
WITH s AS (SELECT event_type AS category, CASE WHEN hour(ts) < 12 THEN 'claim' ELSE 'evidence' END AS role,
                  value >= 50 AS ok FROM events)
SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category,
       count(*) FILTER (WHERE role = 'claim') AS total_claim,
       count(*) FILTER (WHERE role = 'claim' AND ok) AS successful_claim,
       count(*) FILTER (WHERE role = 'evidence') AS total_evidence,
       count(*) FILTER (WHERE role = 'evidence' AND ok) AS successful_evidence,
       count(*) FILTER (WHERE ok) AS successful
FROM s GROUP BY ROLLUP (category)""", "A20")
def q_fetch_stats(spark, sf_dir):
    return fetch_stats(fetch_status_from_events(Tables(spark, sf_dir).events))


_AVAILABLE = ["total", "claim_images", "evidence_images", "claim_images_pct", "evidence_images_pct"]


@register("profile_report", f"""WITH {_SQL_IMG},
av AS (SELECT source, count(doc_id)::DOUBLE AS total, count(claim_image)::DOUBLE AS claim_images,
              count(evidence_image)::DOUBLE AS evidence_images,
              round(100.0 * count(claim_image) / nullif(count(doc_id), 0), 6)::DOUBLE AS claim_images_pct,
              round(100.0 * count(evidence_image) / nullif(count(doc_id), 0), 6)::DOUBLE AS evidence_images_pct
       FROM img GROUP BY source),
dl AS (SELECT lang_pred, count(*) AS n FROM ({LANGUAGE_SQL}) GROUP BY lang_pred),
cc AS (SELECT 'category_counts' AS section, field || ':' || value AS key, 'n' AS stat, n::DOUBLE AS value
       FROM (SELECT 'source' AS field, source AS value, count(*) AS n FROM documents GROUP BY source
             UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang)),
tl AS (SELECT lang, {_SQL_DESCRIBE.format(v='len')}
       FROM (SELECT lang, length(coalesce(text, '')) AS len FROM documents) GROUP BY lang),
cv AS (SELECT count(doc_id) AS rows, count(claim_image) AS with_a, count(evidence_image) AS with_b,
              count(*) FILTER (WHERE claim_image IS NOT NULL AND evidence_image IS NOT NULL) AS both
       FROM img),
ld AS (SELECT {_SQL_DESCRIBE.format(v='diff')}
       FROM (SELECT length(coalesce(html, '')) - length(coalesce(url, '')) AS diff FROM pages))
SELECT * FROM cc
UNION ALL SELECT 'detected_language', lang_pred, 'n', n FROM dl
UNION ALL SELECT 'image_availability', source, stat, value FROM
  (UNPIVOT (SELECT * FROM av) ON total, claim_images, evidence_images, claim_images_pct, evidence_images_pct
   INTO NAME stat VALUE value)
UNION ALL SELECT 'text_lengths', lang, stat, value FROM
  (UNPIVOT (SELECT lang, count::DOUBLE AS count, mean, std, min, p25, p50, p75, max FROM tl)
   ON count, mean, std, min, p25, p50, p75, max INTO NAME stat VALUE value)
UNION ALL SELECT 'coverage', 'documents', stat, value FROM
  (UNPIVOT (SELECT rows::DOUBLE AS rows, with_a::DOUBLE AS with_a, with_b::DOUBLE AS with_b,
                   "both"::DOUBLE AS "both" FROM cv) ON rows, with_a, with_b, "both" INTO NAME stat VALUE value)
UNION ALL SELECT 'length_diff', 'pages', stat, value FROM
  (UNPIVOT (SELECT count::DOUBLE AS count, mean, std, min, p25, p50, p75, max FROM ld)
   ON count, mean, std, min, p25, p50, p75, max INTO NAME stat VALUE value)""", "R9 P3 A1-A5 R5 F12")
def q_profile_report(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cc = value_counts(t.documents, ["source", "lang"])
    cc = cc.select(F.lit("category_counts").alias("section"),
                   F.concat_ws(":", "field", "value").alias("key"), F.lit("n").alias("stat"),
                   F.col("n").cast("double").alias("value"))
    tl = to_long(describe(t.documents, F.length(F.coalesce("text", F.lit(""))), ["lang"]),
                 "text_lengths", F.col("lang"), DESCRIBE)
    cv = to_long(coverage(_img(t), "doc_id", F.col("claim_image"), F.col("evidence_image")),
                 "coverage", F.lit("documents"), ["rows", "with_a", "with_b", "both"])
    p = t.pages
    ld = to_long(describe(p, F.length(F.coalesce("html", F.lit(""))) - F.length(F.coalesce("url", F.lit("")))),
                 "length_diff", F.lit("pages"), DESCRIBE)
    av = to_long(availability(_img(t), "source", "doc_id", {"claim_images": F.col("claim_image"),
                                                            "evidence_images": F.col("evidence_image")}),
                 "image_availability", F.col("source"), _AVAILABLE)
    dl = to_long(detected_languages(t).groupBy("lang_pred").agg(F.count("*").alias("n")),
                 "detected_language", F.col("lang_pred"), ["n"])
    return cc.unionByName(dl).unionByName(av).unionByName(tl).unionByName(cv).unionByName(ld)
