"""Queries over the given tables, one or more per operator, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicons, text, urls
from ..functions.dates import year_month
from ..operators import analytics, dedupe, entities, evaluation, filters, joins, sampling, scoring, search, threads
from ..sources.staging import staged_path
from . import label_queries, model_queries, record_queries, search_queries  # noqa: F401  register their queries
from .registry import DOCS, QUERIES, TOKENS, WORDS, query, search_docs, table

TERMS = ["the", "of", "thntre", "heon", "der", "que"]
QUERY = "the of thntre"
STAR = r"[\x20\x09-\x0D]+"


def _in(terms):
    return ", ".join("'" + t.replace("'", "''") + "'" for t in terms)


# Ranked search

BM25 = f"""
d AS (SELECT doc_id, text, lang, source, {TOKENS} AS t FROM documents), z AS (SELECT count(*)::DOUBLE AS n_docs, avg(len(t)) AS avgdl FROM d),
h AS (SELECT doc_id, lang, source, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d, (SELECT DISTINCT term FROM q) WHERE list_contains(t, term)),
f AS (SELECT term, count(*)::DOUBLE AS df FROM h GROUP BY term)"""
SCORE = "sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))"


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"WITH q AS (SELECT unnest(['the', 'of', 'thntre']) AS term), {BM25}, {DOCS}, s AS (SELECT doc_id, round({SCORE}, 6) AS score FROM h JOIN f USING (term), z GROUP BY doc_id), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20) SELECT doc_id, score, rank, label, length(text) AS full_length, CASE WHEN length(text) > 600 THEN left(text, 600) || '...' ELSE text END AS preview, length(text) > 600 AS truncated FROM k JOIN docs USING (doc_id)")
def bm25_topk(spark, sf_dir):
    """The 20 best documents for a query, from the stored index."""
    index = search_queries.stored_index(spark, sf_dir)
    best = search.top_k(search.lookup(index, QUERY).withColumn("query_id", F.lit(0)), "doc_id", 20)
    return search.result_view(search.fetch(index, best)).select("doc_id", "score", "rank", "label", "full_length", "preview", "truncated")


@query(f"WITH q AS (SELECT unnest(['the', 'of', 'thntre']) AS term), {BM25}, s AS (SELECT doc_id, round({SCORE}, 6) AS score FROM h JOIN f USING (term), z WHERE source = 'src3' AND lang = 'en' GROUP BY doc_id) SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20")
def bm25_filtered(spark, sf_dir):
    """Search within a source, from the stored index; filters do not score."""
    index = search_queries.stored_index(spark, sf_dir)
    scores = search.lookup(index, QUERY, (F.col("source") == "src3") & (F.col("lang") == "en"))
    return search.top_k(scores.withColumn("query_id", F.lit(0)), "doc_id", 20).select("doc_id", "score", "rank")


@query(f"WITH q AS (SELECT item_id AS query_id, unnest(list_distinct({TOKENS})) AS term FROM benchmark), {BM25}, s AS (SELECT query_id, doc_id, round({SCORE}, 6) AS score FROM h JOIN f USING (term) JOIN q USING (term), z GROUP BY ALL) SELECT query_id, max(score) AS top_score, count(*) AS hits FROM s GROUP BY query_id")
def top_score_per_query(spark, sf_dir):
    """every benchmark text as a query by keyword, from the stored index; best score and hits of each. (experiment_matrix has
    all methods of I8.)"""
    s = search.indexed_scores(search_queries.stored_index(spark, sf_dir), search.query_terms(_queries(spark, sf_dir)))
    return s.groupBy("query_id").agg(F.max(F.round("score", 6)).alias("top_score"), F.count("*").alias("hits"))


@query(f"WITH q AS (SELECT unnest(['the', 'of', 'thntre']) AS term), {BM25}, s AS (SELECT doc_id, {SCORE} AS k FROM h JOIN f USING (term), z WHERE strftime(DATE '2024-01-01' + (doc_id % 400)::INT, '%Y-%m-%d') BETWEEN '2024-03-01' AND '2024-08-31' GROUP BY doc_id), qv AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT query_id, vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) + 1 AS c FROM embeddings, qv) SELECT query_id, doc_id, round(0.5 * c + 0.5 * k, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(0.5 * c + 0.5 * k, 6) DESC, doc_id) AS rank FROM s JOIN v USING (doc_id) QUALIFY rank <= 20")
def hybrid_topk(spark, sf_dir):
    """Keyword matches of one text within a window of days, ranked by both scores, for each of the query vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    k = search.lookup(search_queries.stored_index(spark, sf_dir), QUERY, F.col("day").between("2024-03-01", "2024-08-31")).select("doc_id", F.col("score").alias("k"))
    found = vectors.withColumnRenamed("vec_id", "doc_id").join(k, "doc_id")
    return search.nearest(found, search_queries.vector_queries(vectors), 20, "doc_id", plus=0.5 * F.col("k"), alpha=0.5).select("query_id", "doc_id", "score", "rank")


@query("WITH qv AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) + 1, 6) AS score FROM embeddings, qv) SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM v QUALIFY rank <= 10")
def semantic_topk_all(spark, sf_dir):
    """Nearest vectors of every query, the rows whose vec_id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return search.nearest(vectors, search_queries.vector_queries(vectors), 10).select("query_id", "vec_id", "score", "rank")


@query(f"WITH q AS (SELECT unnest(['the', 'of', 'thntre']) AS term), {BM25}, s AS (SELECT doc_id, {SCORE} AS k FROM h JOIN f USING (term), z GROUP BY doc_id), qv AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT query_id, vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) + 1 AS c FROM embeddings, qv) SELECT query_id, doc_id, round(0.5 * c + 0.5 * k, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(0.5 * c + 0.5 * k, 6) DESC, doc_id) AS rank FROM s JOIN v USING (doc_id) QUALIFY rank <= 20")
def hybrid_topk_all(spark, sf_dir):
    """Keyword matches of one text ranked by both scores, for each of these query vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    k = search.lookup(search_queries.stored_index(spark, sf_dir), QUERY).select("doc_id", F.col("score").alias("k"))
    found = vectors.withColumnRenamed("vec_id", "doc_id").join(k, "doc_id")
    return search.nearest(found, search_queries.vector_queries(vectors), 20, "doc_id", plus=0.5 * F.col("k"), alpha=0.5).select("query_id", "doc_id", "score", "rank")


@query("WITH qv AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 3) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS relevance FROM embeddings, qv")
def relevance_to_target(spark, sf_dir):
    """Cosine of every vector to a target."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 3").select(F.col("embedding").alias("q"))
    return v.crossJoin(F.broadcast(q)).select("vec_id", F.round(search.cosine(F.col("embedding"), F.col("q")), 6).alias("relevance"))


@query(f"WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY ALL) GROUP BY term")
def posting_stats(spark, sf_dir):
    """Document and collection frequency of every term."""
    p = search.postings(table(spark, sf_dir, "documents"))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


# Counts and timelines

@query(f"WITH {DOCS}, u AS (SELECT 'source' AS facet, source AS value, count(*) AS n FROM docs GROUP BY source UNION ALL SELECT 'lang', lang, count(*) FROM docs GROUP BY lang UNION ALL SELECT 'label', label, count(*) FROM docs GROUP BY label) SELECT facet, value, n, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS place FROM u QUALIFY place <= CASE facet WHEN 'source' THEN 20 ELSE 10 END")
def facets(spark, sf_dir):
    """Top values of three columns."""
    return analytics.facets(search_docs(spark, sf_dir), {"source": 20, "lang": 10, "label": 10})


@query("SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source")
def heatmap(spark, sf_dir):
    """Source by language."""
    return analytics.cross_counts(table(spark, sf_dir, "documents"), "source", "lang", ["de", "en", "es", "fr"])


@query("SELECT strftime(o_orderdate, '%Y-%m') AS bucket, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY bucket")
def match_timeline(spark, sf_dir):
    """Rows per month from date strings."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return analytics.timeline(o, year_month(F.col("o_orderdate").cast("string")))


@query("SELECT year(o_orderdate)::INT AS bucket, count(*) AS n FROM orders GROUP BY bucket")
def timeline_year(spark, sf_dir):
    """Rows per year."""
    return analytics.timeline(table(spark, sf_dir, "orders"), F.year("o_orderdate"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS bucket, count(*) AS n FROM orders GROUP BY bucket ORDER BY n DESC, bucket LIMIT 5")
def peak_periods(spark, sf_dir):
    """The five busiest months."""
    return analytics.timeline(table(spark, sf_dir, "orders"), year_month(F.col("o_orderdate").cast("string"))).orderBy(F.desc("n"), "bucket").limit(5)


TREND = ", ".join(f"round(100.0::DOUBLE * {x} / total, 1) AS {x}_pct" for x in ("positive", "negative", "neutral"))


@query(f"WITH t AS (SELECT strftime(o_orderdate, '%Y-%m') AS bucket, count(*) FILTER (o_orderstatus = 'F') AS positive, count(*) FILTER (o_orderstatus = 'O') AS negative, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS neutral, count(*) AS total FROM orders GROUP BY bucket) SELECT *, {TREND} FROM t")
def sentiment_trend(spark, sf_dir):
    """E5: labels per month with percentages."""
    o = table(spark, sf_dir, "orders").withColumn("label", F.when(F.col("o_orderstatus") == "F", "positive").when(F.col("o_orderstatus") == "O", "negative").otherwise("neutral"))
    return analytics.sentiment_trend(o, year_month(F.col("o_orderdate").cast("string")), "label")


@query(f"WITH {DOCS}, a AS (SELECT * FROM (VALUES ('the', 'A'), ('of', 'A'), ('der', 'B'), ('que', 'C')) AS v(alias, tool)), t AS (SELECT DISTINCT doc_id, label, tool FROM docs, a WHERE list_contains({TOKENS}, alias)), g AS (SELECT tool, count(*) AS total, count(*) FILTER (label = 'positive') AS positive, count(*) FILTER (label = 'negative') AS negative, count(*) FILTER (label = 'neutral') AS neutral FROM t GROUP BY tool) SELECT *, {TREND} FROM g")
def tool_comparison(spark, sf_dir):
    """Labels of documents that mention any alias of a name."""
    d = search_docs(spark, sf_dir).withColumn("tools", F.array_intersect(text.tokens(F.col("text")), F.array(*map(F.lit, ["the", "of", "der", "que"]))))
    return analytics.tool_comparison(d, "doc_id", "tools", "label", {"the": "A", "of": "A", "der": "B", "que": "C"})


@query(f"WITH t AS (SELECT unnest({TOKENS}) AS term FROM documents), k AS (SELECT term, count(*) AS n FROM t GROUP BY term ORDER BY n DESC, term LIMIT 60) SELECT term, n, round(CASE WHEN max(n) OVER () > min(n) OVER () THEN 10.0::DOUBLE + 40.0::DOUBLE * (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) ELSE 50.0 END, 6) AS weight FROM k")
def term_cloud(spark, sf_dir):
    """Most common terms with weights."""
    t = table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("term"))
    return analytics.term_cloud(t, "term", 60)


@query(f"SELECT count(DISTINCT term) AS vocabulary FROM (SELECT unnest({TOKENS}) AS term FROM documents)")
def vocabulary_size(spark, sf_dir):
    """Distinct terms; counted over a per-term aggregate, so no set is gathered."""
    t = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    return t.groupBy("term").agg(F.lit(1).alias("one")).agg(F.count("*").alias("vocabulary"))


@query(f"WITH {DOCS} SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS english, count(DISTINCT source) AS sources, round(avg(length(text)), 6) AS avg_chars, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) FILTER (label = 'positive') AS positive FROM docs")
def corpus_stats(spark, sf_dir):
    """One-row summary."""
    d = search_docs(spark, sf_dir)
    return d.agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("english"), F.count_distinct("source").alias("sources"), F.round(F.avg(F.length("text")), 6).alias("avg_chars"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count_if(F.col("label") == "positive").alias("positive"))


@query(f"WITH {DOCS}, g AS (SELECT label AS class, count(*) AS n FROM docs WHERE label <> 'unlabeled' GROUP BY label), c AS (SELECT unnest(['positive', 'negative', 'neutral', 'irrelevant']) AS class), b AS (SELECT class, coalesce(n, 0)::BIGINT AS n FROM c LEFT JOIN g USING (class)) SELECT class, n, round(100.0::DOUBLE * n / sum(n) OVER (), 1) AS pct FROM b")
def class_distribution(spark, sf_dir):
    """Labels with absent classes as zero."""
    return analytics.class_distribution(search_docs(spark, sf_dir), "label", ["positive", "negative", "neutral", "irrelevant"])


@query("SELECT 'lang' AS column_name, count(*) AS rows, count(*) FILTER (lang IS NULL) AS n_nulls, count(DISTINCT lang) AS n_distinct FROM documents UNION ALL SELECT 'source', count(*), count(*) FILTER (source IS NULL), count(DISTINCT source) FROM documents UNION ALL SELECT 'text', count(*), count(*) FILTER (text IS NULL), count(DISTINCT text) FROM documents")
def profile(spark, sf_dir):
    """Rows, nulls and distinct values of columns."""
    return analytics.profile(table(spark, sf_dir, "documents"), ["lang", "source", "text"])


@query("SELECT 'lang' AS column_name, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT 'toxic', toxic::VARCHAR, count(*) FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL GROUP BY toxic")
def value_lists(spark, sf_dir):
    """All values of columns with their counts."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return analytics.value_counts(d, ["lang", "source", "toxic"])


@query("SELECT c AS column_name, count(*) AS rows, count(*) FILTER (v IS NULL) AS n_nulls, true AS close FROM (SELECT 'lang' AS c, lang AS v FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'text', text FROM documents) GROUP BY c")
def kept_profile(spark, sf_dir):
    """A profile kept by source and put together again; whether its numbers of values are within the sketches' error of the exact ones."""
    d, columns = table(spark, sf_dir, "documents"), ["lang", "source", "text"]
    path = staged_path(spark)
    analytics.profile_parts(d, columns, [F.coalesce("source", F.lit("")).alias("part")]).write.parquet(path)
    both = analytics.merged_profile(spark.read.parquet(path)).join(analytics.profile(d, columns).select("column_name", F.col("n_distinct").alias("exact")), "column_name")
    close = F.abs(F.col("n_distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), analytics.SKETCH_ERROR * F.col("exact"))
    return both.select("column_name", "rows", "n_nulls", close.alias("close"))


@query("WITH r AS (SELECT CASE WHEN length(trim(text)) < 200 THEN 'short' WHEN lang <> 'en' THEN 'language' ELSE 'kept' END AS reason FROM documents), g AS (SELECT reason, count(*) AS n FROM r GROUP BY reason) SELECT reason, n, round(100.0::DOUBLE * n / sum(n) OVER (), 2) AS pct FROM g")
def step_report(spark, sf_dir):
    """Rows by reason of removal."""
    return analytics.step_report(table(spark, sf_dir, "documents"), F.when(F.length(F.trim("text")) < 200, "short").when(F.col("lang") != "en", "language"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, min(ts)::DATE::VARCHAR AS first_day, max(ts)::DATE::VARCHAR AS last_day FROM events GROUP BY event_type")
def tweet_stats(spark, sf_dir):
    """Counts, sums and date range per group."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


@query("SELECT doc_id % 5 AS labeler, count(*) AS total, count(quality) AS labelled, count(*) - count(quality) AS remaining FROM documents LEFT JOIN labels USING (doc_id) GROUP BY labeler")
def labeler_progress(spark, sf_dir):
    """Labelled and remaining per labeler."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy((F.col("doc_id") % 5).alias("labeler")).agg(F.count("*").alias("total"), F.count("quality").alias("labelled"), (F.count("*") - F.count("quality")).alias("remaining"))


@query("SELECT CASE WHEN source IN ('src1', 'src2') THEN 'reddit' WHEN source = 'src3' THEN 'twitter' ELSE 'other' END AS name, count(*) AS n FROM documents GROUP BY name")
def source_distribution(spark, sf_dir):
    """Normalised source names."""
    name = F.when(F.col("source").isin("src1", "src2"), "reddit").when(F.col("source") == "src3", "twitter").otherwise("other")
    return table(spark, sf_dir, "documents").groupBy(name.alias("name")).agg(F.count("*").alias("n"))


@query("SELECT event_type, least(greatest(floor(value / 200.0::DOUBLE * 10), 0), 9)::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL")
def score_histogram(spark, sf_dir):
    """Binned values per group."""
    return analytics.score_histogram(table(spark, sf_dir, "events"), "value", 0.0, 200.0, 10, ["event_type"])


@query("WITH s AS (SELECT l_orderkey, l_discount * 10 AS s FROM lineitem), b AS (SELECT l_orderkey, 0.4::DOUBLE * avg(s) + 0.6::DOUBLE * max(s) AS b FROM s GROUP BY l_orderkey) SELECT l_orderkey, round(b, 6) AS blend, CASE WHEN b >= 0.42 THEN 'subjective' ELSE 'objective' END AS label FROM b")
def blend_mean_max(spark, sf_dir):
    """Mean and maximum of a group's scores."""
    return analytics.blend_mean_max(table(spark, sf_dir, "lineitem").withColumn("s", F.col("l_discount") * 10), "l_orderkey", "s")


@query("WITH s AS (SELECT l_orderkey, l_returnflag AS p, (l_discount - 0.05) * 10 AS s FROM lineitem), g AS (SELECT l_orderkey, avg(s) AS m, min(s) AS lo, max(s) AS hi, max(struct_pack(a := abs(s), p := p)).p AS path FROM s GROUP BY l_orderkey), v AS (SELECT *, 0.6::DOUBLE * m + 0.4::DOUBLE * CASE WHEN abs(hi) > abs(lo) THEN hi ELSE lo END AS v FROM g) SELECT l_orderkey, round(v, 6) AS blend, CASE WHEN v > 0.1 THEN 'positive' WHEN v < -0.1 THEN 'negative' ELSE 'neutral' END AS label, path FROM v")
def blend_mean_extreme(spark, sf_dir):
    """Mean and stronger pole."""
    return analytics.blend_mean_extreme(table(spark, sf_dir, "lineitem").withColumn("s", (F.col("l_discount") - 0.05) * 10), "l_orderkey", "s", "l_returnflag")


@query("WITH v AS (SELECT l_orderkey, sum((l_discount - 0.05) * 10 * l_quantity) / sum(l_quantity) AS v FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, round(v, 6) + 0.0 AS mean, CASE WHEN v > 0.2 THEN 'positive' WHEN v < -0.2 THEN 'negative' ELSE 'neutral' END AS label FROM v")
def length_weighted_mean(spark, sf_dir):
    """Mean weighted by length."""
    return analytics.length_weighted_mean(table(spark, sf_dir, "lineitem").withColumn("s", (F.col("l_discount") - 0.05) * 10), "l_orderkey", "s", "l_quantity")


# Evaluation

PRED = "p AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS y_true, CASE WHEN length(text) % 3 = 0 THEN 'positive' WHEN length(text) % 3 = 1 THEN 'negative' ELSE 'neutral' END AS y_pred, lang FROM labels l JOIN documents USING (doc_id))"
CLASSES = ["negative", "neutral", "positive"]


def _pairs(spark, sf_dir):
    d = search_docs(spark, sf_dir).where("label <> 'unlabeled'")
    n = F.length("text") % 3
    truth = d.select("doc_id", "label")
    pred = d.select("doc_id", F.when(n == 0, "positive").when(n == 1, "negative").otherwise("neutral").alias("label"))
    return joins.align_labels(pred, truth, "doc_id").join(d.select("doc_id", "lang"), "doc_id")


@query(f"WITH {PRED} SELECT doc_id, y_true, y_pred, lang FROM p")
def align_labels(spark, sf_dir):
    """True and predicted labels by id."""
    return _pairs(spark, sf_dir)


@query(f"WITH {PRED} SELECT y_true, count(*) FILTER (y_pred = 'negative') AS negative, count(*) FILTER (y_pred = 'neutral') AS neutral, count(*) FILTER (y_pred = 'positive') AS positive FROM p GROUP BY y_true")
def confusion_matrix(spark, sf_dir):
    """Counts by true and predicted class."""
    return evaluation.confusion_matrix(_pairs(spark, sf_dir), CLASSES)


@query(f"WITH {PRED}, c AS (SELECT y_true, count(*)::DOUBLE AS n FROM p GROUP BY y_true) SELECT p.y_true, round(count(*) FILTER (y_pred = 'negative') / max(n), 6) AS negative, round(count(*) FILTER (y_pred = 'neutral') / max(n), 6) AS neutral, round(count(*) FILTER (y_pred = 'positive') / max(n), 6) AS positive FROM p JOIN c USING (y_true) GROUP BY p.y_true")
def confusion_matrix_normalised(spark, sf_dir):
    """Shares of the true class."""
    return evaluation.confusion_matrix(_pairs(spark, sf_dir), CLASSES, normalise=True)


REPORT = "c AS (SELECT unnest(['negative', 'neutral', 'positive']) AS class), {g} AS (SELECT {by}class, count(*) FILTER (y_true = class AND y_pred = class)::DOUBLE AS tp, count(*) FILTER (y_true = class)::DOUBLE AS t, count(*) FILTER (y_pred = class)::DOUBLE AS q FROM p, c GROUP BY ALL), m AS (SELECT *, CASE WHEN q > 0 THEN tp / q ELSE 0 END AS pr, CASE WHEN t > 0 THEN tp / t ELSE 0 END AS re FROM {g} WHERE t + q > 0), r AS (SELECT {by}class, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, t::BIGINT AS support FROM m)"


@query(f"WITH {PRED}, {REPORT.format(g='g', by='')} SELECT * FROM r")
def classification_report(spark, sf_dir):
    """Precision, recall and f1 per class."""
    return evaluation.classification_report(_pairs(spark, sf_dir), CLASSES)


@query(f"WITH {PRED}, {REPORT.format(g='g', by='lang, ')} SELECT * FROM r")
def report_by(spark, sf_dir):
    """The same per language."""
    return evaluation.classification_report(_pairs(spark, sf_dir), CLASSES, ["lang"])


@query(f"WITH {PRED}, {REPORT.format(g='g', by='')} SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM r")
def report_averages(spark, sf_dir):
    """Macro and weighted averages."""
    return evaluation.report_averages(evaluation.classification_report(_pairs(spark, sf_dir), CLASSES))


@query(f"WITH {PRED} SELECT y_true, y_pred, count(*) AS n FROM p WHERE y_true <> y_pred GROUP BY ALL ORDER BY n DESC, y_true, y_pred LIMIT 10")
def error_pairs(spark, sf_dir):
    """Commonest confusions."""
    return evaluation.error_pairs(_pairs(spark, sf_dir))


@query(f"WITH {PRED}, n AS (SELECT count(*) AS total, count(*) FILTER (y_true = y_pred) AS eq FROM p), a AS (SELECT y_true AS k, count(*) AS r FROM p GROUP BY 1), b AS (SELECT y_pred AS k, count(*) AS c FROM p GROUP BY 1), e AS (SELECT sum(r * c)::DOUBLE AS rc FROM a JOIN b USING (k)) SELECT total, round(eq::DOUBLE / total, 6) AS agreement, round((eq::DOUBLE / total - rc / (total * total)) / (1 - rc / (total * total)), 6) AS kappa FROM n, e")
def agreement(spark, sf_dir):
    """Agreement and kappa of two annotators."""
    return evaluation.agreement(_pairs(spark, sf_dir), "y_true", "y_pred")


@query("WITH r AS (SELECT label AS query_id, vec_id, (vec_id % 3 = 0)::INT AS relevant, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings), c AS (SELECT query_id, rank, sum(relevant) OVER (PARTITION BY query_id ORDER BY rank)::DOUBLE / rank AS p, coalesce(sum(relevant) OVER (PARTITION BY query_id ORDER BY rank)::DOUBLE / nullif(sum(relevant) OVER (PARTITION BY query_id), 0), 0) AS q FROM r) SELECT query_id, rank, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1 FROM c")
def pr_at_k(spark, sf_dir):
    """precision and recall at every rank."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), (F.col("vec_id") % 3 == 0).cast("int").alias("relevant"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rank"))
    return evaluation.precision_recall_at(e)


@query("SELECT lang, count(*) AS total, count(quality) AS checked, count(*) FILTER (quality = 1) AS accepted, count(*) FILTER (quality = 0) AS rejected, count(*) FILTER (quality IS NOT NULL AND toxic IS DISTINCT FROM quality) AS changed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def review_stats(spark, sf_dir):
    """Checked, accepted, rejected, changed per group."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("decision", F.when(F.col("quality") == 1, "accept").when(F.col("quality") == 0, "reject"))
    return evaluation.review_stats(d, "lang", "decision", "quality", "toxic")


# Joins and set operations

@query("SELECT d.doc_id, lang FROM documents d SEMI JOIN labels USING (doc_id)")
def semi_join(spark, sf_dir):
    """D3: documents that have labels."""
    return joins.semi(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT d.doc_id, lang FROM documents d ANTI JOIN labels USING (doc_id)")
def anti_join(spark, sf_dir):
    """Documents that have none."""
    return joins.anti(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT coalesce(a.doc_id, b.vec_id) AS doc_id, CASE WHEN b.vec_id IS NULL THEN 'left' ELSE 'right' END AS side FROM documents a FULL JOIN embeddings b ON a.doc_id = b.vec_id WHERE a.doc_id IS NULL OR b.vec_id IS NULL")
def unmatched_ids(spark, sf_dir):
    """Ids on one side only."""
    return joins.unmatched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents")
def is_member(spark, sf_dir):
    """Whether each id is known."""
    return joins.is_member(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query(f"SELECT coalesce(l.doc_id, u.doc_id) AS doc_id, coalesce(u.quality, l.quality) AS quality, l.toxic FROM labels l FULL JOIN (SELECT doc_id, CASE WHEN len({WORDS}) >= 300 THEN 1 ELSE 0 END AS quality FROM documents WHERE len({WORDS}) >= 100) u USING (doc_id)")
def apply_labels(spark, sf_dir):
    """Updates of known keys, and new ones: a label by length for every document of 100 words or more."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("n"))
    return joins.upsert(table(spark, sf_dir, "labels"), d.where("n >= 100").select("doc_id", F.when(F.col("n") >= 300, 1).otherwise(0).alias("quality")), "doc_id")


@query("SELECT d.doc_id, l.v AS verdict, CASE WHEN l.v IS NULL THEN 'pending' WHEN l.v = 'yes' THEN 'relevant' ELSE 'dropped' END AS status FROM documents d LEFT JOIN (SELECT doc_id, CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS v FROM labels) l USING (doc_id)")
def verdict_cache(spark, sf_dir):
    """Cached verdicts and what is pending."""
    cache = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("verdict"))
    return joins.with_verdict(table(spark, sf_dir, "documents").select("doc_id"), cache, "doc_id", "verdict")


@query("SELECT toxic, count(*) FILTER (quality = 0) AS \"0\", count(*) FILTER (quality = 1) AS \"1\" FROM labels GROUP BY toxic")
def gate_diagnostic(spark, sf_dir):
    """True labels per predicted gate."""
    l = table(spark, sf_dir, "labels")
    return joins.gate_diagnostic(l.select("doc_id", "toxic"), l.select("doc_id", "quality"), "doc_id", "toxic", "quality", [0, 1])


@query("SELECT doc_id, source, 'doc' AS kind FROM documents UNION ALL SELECT page_id, url, 'page' FROM pages")
def union_sources(spark, sf_dir):
    """H1: a bag union of two sources."""
    a = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit("doc").alias("kind"))
    return a.unionByName(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("source"), F.lit("page").alias("kind")))


@query("SELECT min(n_name) AS name FROM (SELECT n_name FROM nation UNION ALL SELECT lower(r_name) FROM region) GROUP BY lower(trim(n_name))")
def merge_distinct_ci(spark, sf_dir):
    """H2: case-insensitive distinct union."""
    return joins.merge_distinct_ci(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), table(spark, sf_dir, "region").select(F.lower("r_name").alias("name")), "name").select("name")


@query("SELECT DISTINCT vec_id::VARCHAR AS key, vec_id NOT IN (SELECT doc_id FROM labels) AS is_new FROM embeddings")
def add_new_keys(spark, sf_dir):
    """H6: which keys of a batch are new: ids of vectors against those that have labels."""
    state = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key"))
    return joins.add_new_keys(state, table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("key")), "key")


@query("SELECT count(*) AS overlap FROM (SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings)")
def overlap(spark, sf_dir):
    """H4: size of an intersection."""
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))).agg(F.count("*").alias("overlap"))


@query(r"WITH u AS (SELECT page_id AS ord, url, rtrim(lower(regexp_replace(trim(url), '#.*$', '')), '/') AS norm FROM pages) SELECT norm, arg_min(url, ord) AS original_url, arg_min(CASE ord % 2 WHEN 0 THEN 'web' ELSE 'forum' END, ord) AS method, list_distinct(list('q' || (ord % 3)::VARCHAR)) AS queries, min('2024-01-' || lpad((ord % 28 + 1)::VARCHAR, 2, '0')) AS discovered_at, count(*) AS n_merged FROM u GROUP BY norm")
def url_merge(spark, sf_dir):
    """Discoveries of one page merged."""
    p = table(spark, sf_dir, "pages").select(urls.normalize_url(F.col("url")).alias("norm"), F.col("page_id").alias("ord"), F.col("url").alias("original_url"), F.when(F.col("page_id") % 2 == 0, "web").otherwise("forum").alias("method"), F.array(F.concat(F.lit("q"), (F.col("page_id") % 3).cast("string"))).alias("queries"), F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")).alias("discovered_at"))
    return joins.merge_url_state(p)


# Deduplication

@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedupe_first(spark, sf_dir):
    """first row per text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return dedupe.dedupe_keep(d, ["h"], ["doc_id"]).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY sha1(lower(trim(text))) ORDER BY doc_id DESC) = 1")
def dedupe_last(spark, sf_dir):
    """Last row per text hash."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", text.text_hash(F.col("text")).alias("h"))
    return dedupe.dedupe_keep(d, ["h"], ["doc_id"], "last").select("doc_id", "source")


@query(r"SELECT page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY rtrim(lower(regexp_replace(trim(url), '#.*$', '')), '/') ORDER BY page_id) = 1")
def dedupe_urls(spark, sf_dir):
    """H3: first page per normalised URL."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", urls.normalize_url(F.col("url")).alias("n"))
    return dedupe.dedupe_keep(p, ["n"], ["page_id"]).select("page_id", "url")


# Threads

THREAD = "t AS (SELECT conv_id AS post_id, conv_id * 1000 + turn AS doc_id, turn, role, text, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN 'post' ELSE 'comment' END AS doc_type FROM conversations)"


def _thread(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") == F.min("turn").over(Window.partitionBy("conv_id")), "post").otherwise("comment")
    return c.select(F.col("conv_id").alias("post_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "turn", "role", "text", kind.alias("doc_type"))


@query(f"WITH {THREAD} SELECT a.post_id, a.doc_id, b.doc_id AS sibling_id FROM t a JOIN t b ON a.post_id = b.post_id AND a.doc_id <> b.doc_id")
def siblings(spark, sf_dir):
    """Other documents of the same thread, as pairs (thread_of_doc and sorted_threads give threads in order)."""
    return threads.siblings(_thread(spark, sf_dir))


@query(f"WITH {THREAD} SELECT p.post_id, p.text, coalesce((SELECT list(c.role ORDER BY c.turn) FROM t c WHERE c.post_id = p.post_id AND c.doc_type = 'comment'), []) AS roles FROM t p WHERE p.doc_type = 'post'")
def nest_comments(spark, sf_dir):
    """Threads rebuilt."""
    t = _thread(spark, sf_dir)
    out = threads.nest_comments(t.where("doc_type = 'post'").select("post_id", "text"), t.where("doc_type = 'comment'").select("post_id", "turn", "role"), "post_id", "post_id", "turn")
    return out.select("post_id", "text", F.col("comments.role").alias("roles"))


@query(f"WITH {THREAD} SELECT post_id::VARCHAR AS post_id, doc_type, row_number() OVER (PARTITION BY post_id ORDER BY turn) - 1 AS pos, text AS \"Text\" FROM t WHERE length(trim(text)) >= 11 OR false QUALIFY true")
def flatten_threads(spark, sf_dir):
    """B1: nested threads flattened."""
    t = _thread(spark, sf_dir)
    c = t.where("doc_type = 'comment'").select("post_id", "turn", F.col("doc_id").cast("string").alias("comment_id"), F.lit("").alias("Source"), F.col("role").alias("Author"), F.col("text").alias("Text"), F.lit(0).alias("Score"), F.lit("").alias("Date"))
    n = threads.nest_comments(t.where("doc_type = 'post'").select(F.col("post_id").cast("string").alias("ID"), F.lit("src").alias("Source"), F.col("role").alias("Author"), F.col("text").alias("Text"), F.lit(0).alias("Score"), F.lit("").alias("Date"), F.lit(None).cast("string").alias("Title")), c.withColumn("post_id", F.col("post_id").cast("string")), "ID", "post_id", "turn")
    return threads.flatten_threads(n.withColumnRenamed("comments", "Comments")).select("post_id", "doc_type", F.col("pos").cast("long").alias("pos"), "Text")


@query(f"WITH {THREAD} SELECT post_id, doc_id FROM t QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY turn) <= 3")
def cap_per_group(spark, sf_dir):
    """at most three rows per thread."""
    return threads.cap_per_group(_thread(spark, sf_dir).select("post_id", "doc_id", "turn"), "post_id", ["turn"], 3).select("post_id", "doc_id")


@query(f"WITH {THREAD} SELECT c.doc_id, left(p.text, 200) || ' | ' || c.text AS context FROM t c JOIN t p USING (post_id) WHERE c.doc_type = 'comment' AND p.doc_type = 'post'")
def parent_context(spark, sf_dir):
    """The post's beginning before each comment."""
    t = _thread(spark, sf_dir)
    return threads.parent_context(t.where("doc_type = 'comment'").select("post_id", "doc_id", "text"), t.where("doc_type = 'post'").select("post_id", "text")).select("doc_id", "context")


@query(f"WITH {THREAD} SELECT doc_id, last_value(CASE WHEN role = 'user' THEN doc_id END IGNORE NULLS) OVER (ORDER BY doc_id) AS parent_id FROM t")
def ffill_parent(spark, sf_dir):
    """Last user turn at or before each row, across the whole file."""
    return threads.forward_fill_parent(_thread(spark, sf_dir).select("doc_id", "role"), "doc_id", F.col("role") == "user", "doc_id").drop("role")


@query(rf"WITH {THREAD} SELECT count(*) FILTER (doc_type = 'post') AS posts, count(*) FILTER (doc_type = 'comment') AS comments, sum(len({WORDS}))::BIGINT AS words, count(DISTINCT role) AS authors, round(sum(len({WORDS})) / count(*), 6) AS words_per_record FROM t")
def thread_stats(spark, sf_dir):
    """Totals over threads."""
    t = _thread(spark, sf_dir).withColumn("w", text.word_count(F.col("text")))
    return t.agg(F.count_if(F.col("doc_type") == "post").alias("posts"), F.count_if(F.col("doc_type") == "comment").alias("comments"), F.sum("w").alias("words"), F.count_distinct("role").alias("authors"), F.round(F.sum("w") / F.count("*"), 6).alias("words_per_record"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM documents WHERE lang = 'de'")
def number_missing_ids(spark, sf_dir):
    """Running numbers without a global window."""
    return dedupe.number_rows(table(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id"), "doc_id", "number")


@query(r"SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1) AS host, row_number() OVER (PARTITION BY regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1) ORDER BY page_id) AS turn FROM pages")
def interleave_by(spark, sf_dir):
    """round-robin over hosts."""
    p = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return threads.interleave(p, "host", ["page_id"]).withColumn("turn", F.col("turn").cast("long"))


@query("WITH s AS (SELECT l_discount AS s, l_quantity AS q FROM lineitem), b AS (SELECT unnest(range(0, 11)) * 1 AS percent), c AS (SELECT percent, count(*) AS rows, sum(q) AS words FROM b JOIN s ON s.s * 100 + 1e-9 >= percent GROUP BY percent) SELECT percent::INT AS percent, rows, words FROM c WHERE rows >= 20000 AND words >= 100000 ORDER BY percent DESC LIMIT 1")
def threshold_sweep(spark, sf_dir):
    """F8: highest threshold that keeps enough rows."""
    return threads.threshold_sweep(table(spark, sf_dir, "lineitem"), "l_discount", "l_quantity", lo=0, hi=10, step=1, min_rows=20_000, min_words=100_000)


# Filters and text

def _sql_terms(terms):
    return "(" + " OR ".join(f"contains(lower(text), '{t}')" for t in terms) + ")"


@query(f"SELECT doc_id FROM documents WHERE {_sql_terms(['thntre'])} OR ({_sql_terms(['heon', 'thre'])} AND {_sql_terms(['edble'])})")
def keyword_relevant(spark, sf_dir):
    """Strong terms, or two kinds together."""
    return table(spark, sf_dir, "documents").where(filters.keyword_relevant(F.col("text"), ["thntre"], ["heon", "thre"], ["edble"])).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE NOT {_sql_terms(['thntre', 'heon', 'licensed'])}")
def keyword_blacklist(spark, sf_dir):
    """Rows without listed terms."""
    return filters.keyword_blacklist(table(spark, sf_dir, "documents"), "text", ["thntre", "heon", "licensed"]).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)https?://[^\x20\x09-\x0D]+') OR " + "(" + " OR ".join("contains(lower(text), '" + t.replace("'", "''") + "')" for t in lexicons.ADVERT_TERMS) + ")")
def ad_filter(spark, sf_dir):
    """Advertisements."""
    return table(spark, sf_dir, "documents").where(filters.is_advertisement(F.col("text"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE length(trim(text)) < 200 OR " + "(" + " OR ".join("contains(lower(text), '" + t.replace("'", "''") + "')" for t in lexicons.PAYWALL_TERMS) + ")")
def paywall(spark, sf_dir):
    """Short or paywalled texts."""
    return table(spark, sf_dir, "documents").where(filters.is_paywalled(F.col("text"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE length(trim(text)) >= 500")
def min_length(spark, sf_dir):
    """Texts of enough characters."""
    return filters.min_length(table(spark, sf_dir, "documents"), "text", 500).select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE lang = 'fr'")
def language_filter(spark, sf_dir):
    """C4: rows of one language, by column."""
    return filters.language_filter(table(spark, sf_dir, "documents"), "fr", column="lang").select("doc_id", "source")


@query("WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT doc_id, " + ", ".join(f"len(list_filter(w, lambda x: x IN ({_in(ws)}))) AS {k}" for k, ws in lexicons.STOP_WORDS.items()) + " FROM w), u AS (SELECT doc_id, unnest([struct_pack(n := en, lang := 'en'), struct_pack(n := de, lang := 'de'), struct_pack(n := es, lang := 'es'), struct_pack(n := fr, lang := 'fr')]) AS u FROM n) SELECT doc_id, max(u).lang AS found FROM u WHERE u.n > 0 GROUP BY doc_id")
def language_detect(spark, sf_dir):
    """C4: language by stop words; undetectable rows are left out."""
    return table(spark, sf_dir, "documents").select("doc_id", text.stop_word_language(F.col("text"), lexicons.STOP_WORDS).alias("found")).where("found IS NOT NULL")


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderdate::DATE::VARCHAR BETWEEN '1995-01-01' AND '1995-06-30'")
def date_range(spark, sf_dir):
    """Inclusive bounds on date strings."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return filters.date_range(o, "day", "1995-01-01", "1995-06-30")


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE starts_with(o_orderdate::DATE::VARCHAR, '1996-03')")
def period_filter(spark, sf_dir):
    """One month by prefix."""
    return filters.period(table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), "day", "1996-03")


@query(f"SELECT doc_id FROM documents WHERE list_has_any({TOKENS}, ['heon', 'thntre'])")
def match_filter(spark, sf_dir):
    """C11: any term of a query."""
    return filters.match(table(spark, sf_dir, "documents"), "text", "Heon thntre").select("doc_id")


@query(f"SELECT doc_id, CASE WHEN list_has_any({TOKENS}, ['heon', 'thntre']) THEN 'Relevant' ELSE 'Irrelevant' END AS relevance FROM documents")
def domain_gate(spark, sf_dir):
    """Domain terms."""
    return filters.domain_gate(table(spark, sf_dir, "documents"), "text", ["heon", "thntre"]).select("doc_id", "relevance")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 5")
def optional_equals(spark, sf_dir):
    """Only the given conditions."""
    return filters.optional_equals(table(spark, sf_dir, "events"), event_type="click", user_id=5, props=None).select("event_id")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus' WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'o_orderpriority' END AS violation FROM orders")
def enum_check(spark, sf_dir):
    """First column with a value that is not allowed."""
    return filters.violations(table(spark, sf_dir, "orders"), o_orderstatus=["F", "O"], o_orderpriority=["1-URGENT", "2-HIGH"]).select("o_orderkey", "violation")


OPINION = " + ".join("len(regexp_extract_all(lower(coalesce(text, '')), '" + p.replace("'", "''") + "'))" for p in lexicons.OPINION_PATTERNS)
RELEVANCE = {c: " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in ws) for c, ws in lexicons.RELEVANCE_TERMS.items()}


@query(f"WITH c AS (SELECT doc_id, ({OPINION})::DOUBLE AS m, len({WORDS}) AS n FROM documents), s AS (SELECT doc_id, round(CASE WHEN n > 0 THEN least(m / n * 100 / 100, 1.0) ELSE 0 END, 3) AS score FROM c) SELECT doc_id, score, CASE WHEN score >= 0.3 THEN 'high' WHEN score >= 0.1 THEN 'medium' ELSE 'low' END AS level FROM s")
def opinion_score(spark, sf_dir):
    """Opinion cues per word, and levels."""
    d = table(spark, sf_dir, "documents").select("doc_id", scoring.opinion_score(F.col("text")).alias("score"))
    return d.withColumn("level", scoring.opinion_level(F.col("score")))


@query("WITH h AS (SELECT doc_id, " + ", ".join(f"({s}) AS {c}" for c, s in RELEVANCE.items()) + " FROM documents) SELECT doc_id, round(0.6::DOUBLE * (" + " + ".join(f"({c} > 0)::INT" for c in RELEVANCE) + ") / 5 + 0.4::DOUBLE * least((" + " + ".join(RELEVANCE) + ") / 5, 1.0::DOUBLE), 3) AS relevance FROM h")
def relevance_score(spark, sf_dir):
    """Categories and terms hit."""
    return table(spark, sf_dir, "documents").select("doc_id", scoring.relevance_score(F.col("text")).alias("relevance"))


@query("SELECT doc_id, list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{c}' END" for c, ws in lexicons.TOPIC_TERMS.items()) + "], lambda x: x IS NOT NULL) AS tags FROM documents")
def topic_tags(spark, sf_dir):
    """S3: tags by substrings."""
    return table(spark, sf_dir, "documents").select("doc_id", scoring.topic_tags(F.col("text")).alias("tags"))


@query("WITH t AS (SELECT unnest(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{c}' END" for c, ws in lexicons.TOPIC_TERMS.items()) + "], lambda x: x IS NOT NULL)) AS tag FROM documents) SELECT tag, count(*) AS n FROM t GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
def topic_distribution(spark, sf_dir):
    """Most common tags."""
    t = table(spark, sf_dir, "documents").select(F.explode(scoring.topic_tags(F.col("text"))).alias("tag"))
    return analytics.top_counts(t, "tag", 20)


@query(f"WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents) SELECT doc_id, i AS chunk, array_to_string(w[i * 250 + 1 : i * 250 + 300], ' ') AS words FROM w, unnest(range(0, greatest(ceil((len(w) - 300) / 250.0), 0)::BIGINT + 1)) AS r(i) WHERE len(w) > 0")
def chunk_words(spark, sf_dir):
    """overlapping chunks."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.chunk_words(F.col("text"))).alias("chunk", "words"))
    return d.withColumn("chunk", F.col("chunk").cast("long"))


@query("SELECT doc_id, sha1(lower(trim(text))) AS h, left(text, 200) AS prefix FROM documents")
def text_hashes(spark, sf_dir):
    """Hash and prefix keys."""
    return table(spark, sf_dir, "documents").select("doc_id", text.text_hash(F.col("text")).alias("h"), F.substring("text", 1, 200).alias("prefix"))


@query(rf"SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1) AS host, left(sha256(url), 16) AS url_id, left(md5(rtrim(lower(regexp_replace(trim(url), '#.*$', '')), '/')), 12) AS url_hash, regexp_extract(url, '([^./:?#]+\.[^./:?#]+)([/:?#]|$)', 1) AS domain, 'personal' AS source_type FROM pages")
def url_parts(spark, sf_dir):
    """Hosts, domains, ids and source types."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), urls.url_id(u).alias("url_id"), urls.url_hash(u).alias("url_hash"), urls.domain(u).alias("domain"), urls.source_type(u).alias("source_type"))


@query(rf"SELECT doc_id, array_to_string(({WORDS})[1:50], ' ') AS head, len({WORDS}) AS n_words FROM documents")
def truncate_words(spark, sf_dir):
    """First words, word count."""
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_words(F.col("text"), 50).alias("head"), text.word_count(F.col("text")).cast("long").alias("n_words"))


@query(f"SELECT doc_id, avg(p) AS polarity FROM (SELECT doc_id, unnest({TOKENS}) AS t FROM documents) JOIN (VALUES ('the', 0.5::DOUBLE), ('of', -0.25::DOUBLE), ('der', 1.0::DOUBLE)) AS v(w, p) ON t = w GROUP BY doc_id")
def lexicon_mean(spark, sf_dir):
    """Mean polarity of lexicon words; documents without are left out."""
    lex = spark.createDataFrame([("the", 0.5), ("of", -0.25), ("der", 1.0)], "word string, polarity double")
    return scoring.lookup_mean(table(spark, sf_dir, "documents"), "doc_id", "text", lex).where("polarity IS NOT NULL")


@query(None)
def normalize_text(spark, sf_dir):
    """The normalisation stages in order, and sentences."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text"), {"imo": "in my opinion", "btw": "by the way"}, {":)": "smile"}).alias("normalized"))
    return d.withColumn("sentences", text.split_sentences(F.col("normalized")))


@query(r"""WITH x AS (SELECT doc_id, text, lower(replace(coalesce(text, ''), 'İ', ' ')) AS low FROM documents),
e AS (SELECT doc_id, text, regexp_extract_all(low, '<code>|\[[a-z0-9_ ]+\]|[a-z0-9][a-z0-9+#.-]*') AS el, regexp_split_to_array(low, '<code>|\[[a-z0-9_ ]+\]|[a-z0-9][a-z0-9+#.-]*') AS gap FROM x),
u AS (SELECT doc_id, text, generate_subscripts(el, 1) AS k, unnest(el) AS w, unnest(gap[1 : len(el)]) AS g FROM e),
p AS (SELECT doc_id, text, w, sum(length(g)) OVER o + coalesce(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
t AS (SELECT *, s + length(w) AS f, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS i FROM p WHERE w[1] NOT IN ('<', '[')),
b AS (SELECT a.doc_id, a.text, a.i, a.s, z.f FROM t a JOIN t z ON z.doc_id = a.doc_id AND z.i = a.i + 1 WHERE a.w || ' ' || z.w IN ('of the', 'in the')),
m AS (SELECT doc_id, text, 'X' AS label, s, f, 2 AS n FROM b UNION ALL
      SELECT doc_id, text, CASE w WHEN 'the' THEN 'Y' ELSE 'Z' END, s, f, 1 FROM t WHERE w IN ('the', 'que') AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = t.doc_id AND b.i + 1 = t.i))
SELECT doc_id, text[s + 1 : f] AS entity, label, s::INT AS start, f::INT AS "end", n::INT AS n_tokens FROM m""")
def entity_spans(spark, sf_dir):
    """Dictionary entities, longest first without overlaps, with their places (tests compare it with a plain version)."""
    phrases = spark.createDataFrame([("of the", "X"), ("the", "Y"), ("in the", "X"), ("que", "Z")], "phrase string, label string")
    return entities.gazetteer(table(spark, sf_dir, "documents"), "doc_id", "text", phrases)


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY left(text, 200) ORDER BY doc_id) = 1")
def greedy_dedupe(spark, sf_dir):
    """the sequential rule; over one key it is keep-first (over two keys: tests)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 200).alias("prefix"))
    return dedupe.greedy_dedupe(d, "doc_id", ["prefix"]).select("doc_id")


# Samples

@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '|s1'), doc_id LIMIT 100")
def sample_n(spark, sf_dir):
    """L1: a repeatable sample of 100."""
    return sampling.sample_n(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, "s1")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || '|s2'), doc_id) <= CASE lang WHEN 'en' THEN 50 WHEN 'de' THEN 30 ELSE 0 END")
def stratified_sample(spark, sf_dir):
    """L2: targets per level."""
    return sampling.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", {"en": 50, "de": 30}, "s2")


@query("SELECT doc_id, (('0x' || left(md5(doc_id::VARCHAR || '|s3'), 1))::INT % 2)::INT AS half FROM documents")
def split_half(spark, sf_dir):
    """L3: two halves by a hash bit."""
    return sampling.split_half(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "s3")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50")
def paginate(spark, sf_dir):
    """One page."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id").offset(50).limit(25)


@query("SELECT doc_id, (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS remaining FROM documents ANTI JOIN labels USING (doc_id) ORDER BY doc_id LIMIT 1")
def next_pending(spark, sf_dir):
    """The first unlabelled document, and how many remain."""
    left = joins.anti(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")
    return left.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("remaining"))


def queries() -> dict:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in QUERIES.items() if s}
