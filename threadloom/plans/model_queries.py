"""Queries that send a part of their rows to a model. The model here goes by the length of its input, so that SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import annotation, models
from ..sources.staging import staged
from .registry import WORDS, query, table

LINES = "l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))"
CLEAN = r"trim(regexp_replace(coalesce({}, ''), '<CODE>|\[[^\]]+\]', '', 'g'), ' ')"


def _by_length(labels: tuple[str, ...]):
    """A model: the label and the confidence follow from the input's length."""

    def make():
        return lambda texts: [(labels[len(t) % len(labels)], 0.3 + (len(t) % 71) / 100) for t in texts]

    return make


def _lines(spark, sf_dir):
    d = staged(table(spark, sf_dir, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("row_")), "numbered")
    rows = text.piece_rows(d, "row_", F.col("text"), "\n").join(d.select("row_", "doc_id"), "row_")
    return rows.select("doc_id", F.col("n").cast("long").alias("line_no"), F.col("piece").alias("line"), ((F.length("piece") % 97) / 96).alias("lexicon"))


@query(rf"""WITH {LINES}, s AS (SELECT doc_id, i - 1 AS line_no, line, (length(line) % 97)::DOUBLE / 96 AS lexicon FROM l),
b AS (SELECT *, CASE WHEN trim(line, ' ') = '' THEN 'objective' WHEN lexicon >= 0.75 THEN 'subjective' WHEN lexicon <= 0.2 THEN 'objective' ELSE 'model' END AS band,
      left(coalesce(nullif({CLEAN.format("line")}, ''), '.'), 1500) AS seen FROM s),
p AS (SELECT *, 0.3::DOUBLE + (length(seen) % 71)::DOUBLE / 100 AS c FROM b)
SELECT doc_id, line_no, band, CASE WHEN band = 'model' THEN 'model' ELSE 'lexicon' END AS method,
    round(CASE WHEN trim(line, ' ') = '' THEN 0 WHEN band = 'model' THEN 0.4::DOUBLE * lexicon + 0.6::DOUBLE * (CASE WHEN length(seen) % 2 = 0 THEN c ELSE 1 - c END) ELSE lexicon END, 6) AS score
FROM p""")
def model_bands(spark, sf_dir):
    """Every line of every document; those between the bounds go to the model, each distinct one once, and are blended."""
    rows = models.route_subjectivity(_lines(spark, sf_dir), "line", "lexicon", models.Model(_by_length(("SUBJ", "OBJ")), {"SUBJ": "subjective", "OBJ": "objective"}))
    return rows.select("doc_id", "line_no", "band", "method", F.round("score", 6).alias("score"))


@query(rf"""WITH d AS (SELECT doc_id, text, {WORDS} AS w, ((doc_id % 11)::DOUBLE / 10) AS lexicon, {CLEAN.format("text")} AS clean FROM documents),
r AS (SELECT *, CASE WHEN len(w) < 60 THEN 'lexicon' WHEN len(w) > 400 THEN 'chunks' ELSE 'model' END AS route, list_filter(regexp_split_to_array(clean, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS cw FROM d),
k AS (SELECT doc_id, array_to_string(cw[j * 250 + 1 : j * 250 + 300], ' ') AS input, greatest(0, least(300, len(cw) - j * 250)) AS weight
      FROM r, unnest(range(0, 1 + greatest(0, ceil((len(cw) - 300)::DOUBLE / 250)::INT))) AS t(j) WHERE route = 'chunks' AND len(cw) > 0
      UNION ALL SELECT doc_id, clean, len(cw) FROM r WHERE route = 'model' AND clean <> ''),
v AS (SELECT doc_id, weight, length(left(input, 1500)) % 3 AS l, 0.3::DOUBLE + (length(left(input, 1500)) % 71)::DOUBLE / 100 AS c FROM k),
g AS (SELECT doc_id, count(*) AS n, sum(weight * CASE WHEN l = 0 AND c >= 0.85 * 0.5 THEN c WHEN l = 1 AND c >= 0.5 THEN -c ELSE 0 END) / sum(weight) AS mean FROM v GROUP BY doc_id),
m AS (SELECT r.*, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean FROM r LEFT JOIN g USING (doc_id)),
o AS (SELECT *, CASE route WHEN 'lexicon' THEN CASE WHEN lexicon >= 0.65 THEN 'positive' WHEN lexicon <= 0.35 THEN 'negative' ELSE 'neutral' END
      WHEN 'chunks' THEN CASE WHEN mean >= 0.2 THEN 'positive' WHEN mean <= -0.2 THEN 'negative' ELSE 'neutral' END
      ELSE CASE WHEN mean > 0 THEN 'positive' WHEN mean < 0 THEN 'negative' ELSE 'neutral' END END AS label FROM m)
SELECT doc_id, route, n::BIGINT AS n_inputs, CASE WHEN route <> 'lexicon' THEN round(mean, 6) + 0.0 END AS mean, label,
    round(CASE label WHEN 'neutral' THEN 0 WHEN 'positive' THEN 1 ELSE -1 END * CASE WHEN route = 'lexicon' THEN 2 * abs(lexicon - 0.5) ELSE abs(mean) END, 6) + 0.0 AS score
FROM o""")
def model_routes(spark, sf_dir):
    """Documents by length: short ones by the lexicon's score, others by the model, long ones as the mean of their chunks."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", text.word_count(F.col("text")).alias("n"), ((F.col("doc_id") % 11) / 10).alias("lexicon"))
    rows = models.route_polarity(d, "doc_id", "text", "n", "lexicon", models.Model(_by_length(("positive", "negative", "neutral"))))
    return rows.select("doc_id", "route", "n_inputs", (F.round("mean", 6) + 0.0).alias("mean"), "label", (F.round("score", 6) + 0.0).alias("score"))


@query(None)
def annotate_with_models(spark, sf_dir):
    """S15 with models for subjectivity, sarcasm and polarity: every document, of which the models see what the rules leave to them
    (tests compare its routes with plain versions; model_bands and model_routes have SQL)."""
    lexicon = spark.createDataFrame([("the", 0.5), ("of", -0.25), ("der", 1.0), ("heon", -2.0)], "word string, polarity double")
    phrases = spark.createDataFrame([("the", "AI_TOOL"), ("in the", "ORG"), ("que", "AI_TOOL")], "phrase string, label string")
    kinds = {"subjectivity": ("subjective", "objective"), "sarcasm": ("sarcastic", "plain"), "polarity": ("positive", "negative", "neutral")}
    config = annotation.PipelineConfig(models={k: models.Model(_by_length(v), cap=600 if k == "sarcasm" else 1500) for k, v in kinds.items()})
    return annotation.annotate_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", lexicon, phrases, config)
