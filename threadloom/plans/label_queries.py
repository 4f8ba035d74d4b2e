"""Queries over labels and verdicts, statistics, threads, samples, text functions, scores and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, lexicons, text, urls
from ..operators import analytics, dedupe, entities, evaluation, filters, joins, models, sampling, scoring, threads
from ..sources import records
from ..sources.staging import staged, staged_path
from ..streaming import ingest
from .registry import DOCS, WORDS, query, search_docs, table

THREAD = "t AS (SELECT conv_id AS post_id, conv_id * 1000 + turn AS doc_id, turn, role, text, turn = min(turn) OVER (PARTITION BY conv_id) AS is_post FROM conversations)"
STRIP = r"[\x20\x09-\x0D]+"


def _thread(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    first = F.col("turn") == F.min("turn").over(Window.partitionBy("conv_id"))
    return c.select(F.col("conv_id").alias("post_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "turn", "role", "text", first.alias("is_post"))


# Readers and sinks

@query("SELECT doc_id, text, source FROM documents")
def jsonl_round_trip(spark, sf_dir):
    """A2, A10: a record per line, written and read back."""
    path = staged_path(spark)
    records.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path)
    return records.read_jsonl(spark, path, "doc_id long, text string, source string")


@query("SELECT source, lang, count(*)::VARCHAR AS n FROM documents GROUP BY ALL")
def tsv_summary(spark, sf_dir):
    """A summary table, tab-separated, written and read back."""
    path = staged_path(spark)
    records.write_tsv(table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")), path)
    return spark.read.option("sep", "\t").option("header", True).schema("source string, lang string, n string").csv(path)


@query("SELECT doc_id::VARCHAR AS \"ID\", 'Post' AS \"Type\", text AS \"Text\", (doc_id % 50)::INT AS \"Score\" FROM documents")
def csv_rows_round_trip(spark, sf_dir):
    """A3: rows with quotes and line breaks as CSV, written and read back."""
    path = staged_path(spark)
    d = table(spark, sf_dir, "documents").select(F.lit("s").alias("Source"), F.col("doc_id").alias("ID"), F.lit("Post").alias("Type"), F.lit("a").alias("Author"), F.col("text").alias("Text"), (F.col("doc_id") % 50).alias("Score"), F.lit("2024-01-01").alias("Date"))
    records.write_csv(d, path, d.columns)
    return records.read_rows_csv(spark, path).select("ID", "Type", "Text", "Score")


@query("SELECT lower(p_name || p_partkey::VARCHAR) AS key, CASE WHEN p_size % 3 = 0 THEN 'b of ' || p_brand ELSE 'a' END AS meaning FROM part WHERE p_size % 5 <> 0")
def slang_lexicon(spark, sf_dir):
    """A4: an object of strings with alternatives, written and read back; one meaning per key, a hint word decides."""
    path = staged_path(spark)
    p = table(spark, sf_dir, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("key"), F.concat(F.lit("a -or- b "), F.when(F.col("p_size") % 3 == 0, "of").otherwise("x"), F.lit(" "), "p_brand").alias("meaning"), (F.col("p_size") % 5 == 0).alias("out"))
    p.where("NOT out").select(F.to_json(F.create_map("key", "meaning")).alias("value")).write.text(path)
    return records.resolve_slang(records.read_lexicon(spark, path), [], {}, ["of"])


@query("SELECT p_partkey::VARCHAR AS word, CASE p_size % 2 WHEN 0 THEN 'strongsubj' ELSE 'weaksubj' END AS type, 'noun' AS pos, 'positive' AS polarity FROM part")
def mpqa_lexicon(spark, sf_dir):
    """A5: lines of key=value tokens."""
    path = staged_path(spark)
    kind = F.when(F.col("p_size") % 2 == 0, "strongsubj").otherwise("weaksubj")
    table(spark, sf_dir, "part").select(F.concat(F.lit("type="), kind, F.lit(" len=1 word1="), F.col("p_partkey").cast("string"), F.lit(" pos1=noun priorpolarity=positive")).alias("value")).write.text(path)
    return records.read_mpqa(spark, path)


@query("SELECT coalesce(try_cast(nullif(props, '') AS INT), -1) AS props, coalesce(try_cast(event_type AS DOUBLE), 0.5)::DOUBLE AS event_type, coalesce(nullif(user_id::VARCHAR, ''), 'nobody') AS user_id, floor(value)::BIGINT AS value FROM (SELECT CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN event_id::VARCHAR ELSE 'x' END AS props, event_type, user_id, value FROM events)")
def coerced_fields(spark, sf_dir):
    """Fields of the store's fixed mapping, with defaults for what is null, empty or unreadable."""
    i = F.col("event_id") % 3
    e = table(spark, sf_dir, "events").select(F.when(i == 0, "").when(i == 1, F.col("event_id").cast("string")).otherwise("x").alias("props"), "event_type", "user_id", F.floor("value").cast("string").alias("value"))
    return records.coerce_fields(e, {"props": ("int", -1), "event_type": ("double", 0.5), "user_id": ("string", "nobody"), "value": ("bigint", 0)})


@query(f"WITH {DOCS}, l AS (SELECT label, count(*) AS n FROM docs GROUP BY label), t AS (SELECT lang, count(*) AS n FROM docs GROUP BY lang ORDER BY n DESC, lang LIMIT 3) SELECT (SELECT count(*) FROM docs) AS documents, ['doc_id', 'label', 'lang', 'source', 'text', 'tools'] AS fields, (SELECT max(len(embedding))::INT FROM embeddings) AS dims, (SELECT list(lang ORDER BY n DESC, lang) FROM t) AS top_tools, (SELECT list(label || '=' || n::VARCHAR ORDER BY label) FROM l) AS labels")
def dataset_manifest(spark, sf_dir):
    """One row on the data set."""
    d = search_docs(spark, sf_dir).withColumn("tools", F.array("lang"))
    return records.manifest(d, "tools", "label", table(spark, sf_dir, "embeddings"), k=3)


@query("SELECT (SELECT count(*) FROM documents) AS documents, max(len(embedding))::INT AS dims FROM embeddings")
def index_stats(spark, sf_dir):
    """Number of documents and length of vectors."""
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("documents")).join(table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding")).alias("dims")))


# Threads

LABELLED = "CASE WHEN conv_id % 3 = 0 THEN 'negative' WHEN conv_id % 3 = 1 THEN 'neutral' ELSE 'bucket' END"


@query(f"WITH {THREAD}, k AS (SELECT post_id, list('c' || turn::VARCHAR || '=' || CASE WHEN role = 'user' THEN 'positive' WHEN turn % 2 = 0 THEN 'neutral' ELSE 'bucket' END ORDER BY turn) AS comments FROM t WHERE NOT is_post GROUP BY post_id) SELECT post_id::VARCHAR AS \"ID\", text AS \"Text\", {LABELLED.replace('conv_id', 'post_id')} AS label, coalesce(comments, []) AS comments FROM t LEFT JOIN k USING (post_id) WHERE is_post")
def labelled_threads(spark, sf_dir):
    """Reviewed items as threads, posts and comments labelled by reviewer, model or bucket."""
    t = _thread(spark, sf_dir)
    c = t.where("NOT is_post").select("post_id", "turn", F.struct(F.concat(F.lit("c"), F.col("turn").cast("string")).alias("comment_id"), F.col("text").alias("Text"), F.when(F.col("role") == "user", "POSITIVE").alias("final_label"), F.when(F.col("turn") % 2 == 0, "neutral").alias("llm_label")).alias("c"))
    nested = threads.nest_comments(t.where("is_post").select("post_id", "text"), c, "post_id", "post_id", "turn")
    i = F.col("post_id") % 3
    items = nested.select(F.struct(F.col("post_id").cast("string").alias("ID"), F.col("text").alias("Text")).alias("post"), F.struct(F.when(i == 0, "Negative").alias("final_label")).alias("review"), F.struct(F.when(i == 1, "neutral").alias("label")).alias("llm"), F.lit("bucket").alias("assigned_bucket"), F.col("comments.c").alias("comments"))
    out = records.labelled_item_to_thread(items)
    return out.select("ID", "Text", "label", F.transform("Comments", lambda x: F.concat(x["comment_id"], F.lit("="), x["label"])).alias("comments"))


@query("SELECT CASE doc_id % 4 WHEN 0 THEN 'Text: missing' WHEN 1 THEN 'Score: wrong type' ELSE 'valid' END AS violation, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY violation")
def schema_summary(spark, sf_dir):
    """How many records each violation has."""
    from .record_queries import validate_schema

    return records.violations_summary(validate_schema(spark, sf_dir))


@query(f"WITH {THREAD}, n AS (SELECT *, row_number() OVER (PARTITION BY is_post ORDER BY doc_id) - 1 AS i FROM t) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (CASE WHEN is_post THEN 'post_' ELSE 'comment_' END) || i::VARCHAR ELSE 'own' || doc_id::VARCHAR END AS id FROM n")
def fallback_ids(spark, sf_dir):
    """Rows without an id get one from their place among posts or comments."""
    t = _thread(spark, sf_dir).select("doc_id", "is_post", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("own"), F.col("doc_id").cast("string"))).alias("id"))
    return dedupe.fallback_ids(t.where("is_post"), "id", "doc_id", "post_").unionByName(dedupe.fallback_ids(t.where("NOT is_post"), "id", "doc_id", "comment_")).select("doc_id", "id")


PROFILES = {"x": ["is", "the", "how"], "y": ["a", "to", "please"]}
HITS = ", ".join(f"len(list_filter(w, lambda z: z IN ({', '.join(repr(x) for x in ws)}))) AS {k}" for k, ws in PROFILES.items())


@query(f"WITH {THREAD}, w AS (SELECT *, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{STRIP}'), lambda z: z <> '') AS w FROM t), n AS (SELECT *, {HITS} FROM w), o AS (SELECT *, len(w) = 0 OR (x > y) AS ours FROM n) SELECT doc_id FROM o WHERE ours AND post_id NOT IN (SELECT post_id FROM o WHERE is_post AND NOT ours)")
def language_threads(spark, sf_dir):
    """C4: a post of another language takes its thread with it; comments go one by one."""
    return filters.language_threads(_thread(spark, sf_dir), "x", profiles=PROFILES).select("doc_id")


TOKENS_OF = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
DOMAIN = ["the", "heon", "que"]


@query(f"WITH {THREAD}, p AS (SELECT post_id, CASE WHEN list_has_any({TOKENS_OF}, {DOMAIN}) THEN 'Relevant' ELSE 'Irrelevant' END AS relevance FROM t WHERE is_post) SELECT doc_id, relevance FROM t JOIN p USING (post_id)")
def domain_threads(spark, sf_dir):
    """Comments inherit the relevance of their post."""
    return filters.domain_gate_threads(_thread(spark, sf_dir), DOMAIN).select("doc_id", "relevance")


@query("WITH s AS (SELECT event_id, value / 200 AS r, (user_id % 20) / 100.0::DOUBLE AS o FROM events) SELECT event_id, r >= 0.15 AND o >= 0.05 AS is_relevant FROM s")
def score_gate(spark, sf_dir):
    """Both scores at or above their thresholds; all rows stay."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 200).alias("relevance_score"), ((F.col("user_id") % 20) / 100.0).alias("opinion_score"))
    return filters.score_gate(e).select("event_id", "is_relevant")


@query("SELECT event_id, CASE WHEN value >= 100 THEN [event_type] ELSE [] END AS aspects FROM events")
def subjective_only(spark, sf_dir):
    """C17: rows that are not subjective have no aspects."""
    e = table(spark, sf_dir, "events").select("event_id", F.array("event_type").alias("aspects"), F.when(F.col("value") >= 100, "subjective").otherwise("objective").alias("subjectivity"))
    return filters.subjective_only(e, "aspects").select("event_id", "aspects")


@query("WITH p AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'irrelevant' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS y_true, CASE WHEN length(text) % 2 = 0 THEN 'positive' ELSE 'irrelevant' END AS y_pred FROM labels JOIN documents USING (doc_id)) SELECT * FROM p WHERE y_true <> 'irrelevant'")
def align_labels_relevant(spark, sf_dir):
    """Rows whose true label is irrelevant are left out; predicted ones stay."""
    d = search_docs(spark, sf_dir).where("label <> 'unlabeled'")
    truth = d.select("doc_id", F.when(F.col("label") == "negative", "irrelevant").otherwise(F.col("label")).alias("label"))
    pred = d.select("doc_id", F.when(F.length("text") % 2 == 0, "positive").otherwise("irrelevant").alias("label"))
    return joins.align_labels_relevant(pred, truth, "doc_id")


SIDE = "CASE WHEN {x} THEN 'irrelevant' ELSE 'positive' END"


@query(f"WITH {THREAD}, a AS (SELECT t.*, (SELECT min(length(p.text)) FROM t p WHERE p.post_id = t.post_id AND p.is_post) AS n FROM t) SELECT doc_id, CASE WHEN n % 2 = 0 OR length(text) % 2 = 0 THEN 'irrelevant' ELSE 'positive' END AS y_true, CASE WHEN n % 3 = 0 OR length(text) % 3 = 0 THEN 'irrelevant' ELSE 'positive' END AS y_pred FROM a")
def align_labels_inherited(spark, sf_dir):
    """Comments of a post that is irrelevant on a side are irrelevant there."""
    t = _thread(spark, sf_dir)
    t = t.withColumn("up", F.min(F.when(F.col("is_post"), F.col("doc_id"))).over(Window.partitionBy("post_id")))
    side = lambda k: t.select("doc_id", "up", F.when(F.length("text") % k == 0, "irrelevant").otherwise("positive").alias("label"))
    return joins.align_labels(side(3), side(2), "doc_id", parent="up")


@query(f"WITH {THREAD}, p AS (SELECT post_id, left('Title ' || role || post_id::VARCHAR, 200) AS title FROM t WHERE is_post) SELECT doc_id, CASE WHEN len({WORDS}) <= 10 THEN title || ' | ' || text ELSE text END AS context FROM t JOIN p USING (post_id) WHERE NOT is_post")
def parent_title_context(spark, sf_dir):
    """The post's title before short comments only."""
    t = _thread(spark, sf_dir)
    posts = t.where("is_post").select("post_id", F.concat(F.lit("Title "), "role", F.col("post_id").cast("string")).alias("title"))
    return threads.parent_context(t.where("NOT is_post").select("post_id", "doc_id", "text"), posts, short=10).select("doc_id", "context")


# Updates

UPDATES = f"""{THREAD}, c AS (SELECT post_id, list(turn::VARCHAR ORDER BY turn) FILTER (NOT is_post) AS ids FROM t GROUP BY post_id),
u AS (SELECT post_id AS item_id, 'new' AS label, CASE WHEN post_id % 3 = 0 THEN list_slice(coalesce(ids, []), 2, 99) ELSE coalesce(ids, []) END AS given, coalesce(ids, []) AS ids FROM c WHERE post_id % 2 = 0
      UNION ALL SELECT post_id + 1000000, 'new', [], [] FROM c WHERE post_id % 7 = 0)"""


def _updates(spark, sf_dir):
    t = _thread(spark, sf_dir)
    ids = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_post"), F.col("turn")))), lambda x: x.cast("string"))
    items = t.groupBy(F.col("post_id").alias("item_id")).agg(ids.alias("comment_ids")).withColumn("label", F.lit("old"))
    given = F.when(F.col("item_id") % 3 == 0, F.slice("comment_ids", 2, 99)).otherwise(F.col("comment_ids"))
    as_map = F.map_from_entries(F.transform(given, lambda x: F.struct(x.alias("k"), F.lit("positive").alias("v"))))
    known = items.where("item_id % 2 = 0").select("item_id", F.lit("new").alias("label"), as_map.alias("comment_labels"))
    other = items.where("item_id % 7 = 0").select((F.col("item_id") + 1_000_000).alias("item_id"), F.lit("new").alias("label"), F.create_map().cast("map<string,string>").alias("comment_labels"))
    return items, known.unionByName(other)


@query(f"WITH {UPDATES} SELECT item_id, CASE WHEN item_id >= 1000000 THEN 'unknown id' WHEN len(given) < len(ids) THEN 'comment without label' END AS reason FROM u")
def checked_updates(spark, sf_dir):
    """Updates of unknown items, or that leave out a comment, are rejected with the reason."""
    return joins.checked_updates(*_updates(spark, sf_dir)).select("item_id", "reason")


@query(f"WITH {UPDATES} SELECT post_id AS item_id, CASE WHEN post_id IN (SELECT item_id FROM u WHERE len(given) = len(ids)) THEN 'new' ELSE 'old' END AS label FROM c")
def applied_updates(spark, sf_dir):
    """Labels after the updates that pass."""
    return joins.apply_checked(*_updates(spark, sf_dir)).select("item_id", "label")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete_ids(spark, sf_dir):
    """Rows deleted by id."""
    return joins.delete_ids(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").where("quality = 0"), "doc_id")


@query("SELECT d.doc_id, coalesce(l.source, d.source) AS source, d.lang FROM documents d LEFT JOIN (SELECT doc_id, CASE quality WHEN 1 THEN 'good' END AS source FROM labels) l USING (doc_id)")
def patch_records(spark, sf_dir):
    """Fields overwritten where the patch has a value."""
    patch = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("source"))
    return joins.upsert(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), patch, "doc_id")


@query("WITH s AS (SELECT doc_id AS article_id, CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS verdict, NULL::VARCHAR AS reason, 1 AS seen, 0 AS side FROM labels UNION ALL SELECT doc_id, CASE WHEN lang = 'de' THEN 'skipped' ELSE 'no' END, CASE WHEN doc_id % 2 = 0 THEN 'language' END, doc_id % 3, 1 FROM documents WHERE lang IN ('de', 'fr')), k AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY seen DESC, side DESC) AS rn FROM s) SELECT article_id, verdict, CASE WHEN verdict = 'skipped' THEN coalesce(reason, 'no reason') END AS reason, seen, source FROM k JOIN documents ON doc_id = article_id WHERE rn = 1")
def record_verdicts(spark, sf_dir):
    """Verdicts and skips with reasons over the state, the last of each article."""
    d = table(spark, sf_dir, "documents")
    state = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("verdict"), F.lit(None).cast("string").alias("reason"), F.lit(1).cast("long").alias("seen"))
    new = d.where("lang IN ('de', 'fr')").select(F.col("doc_id").alias("article_id"), F.when(F.col("lang") == "de", "skipped").otherwise("no").alias("verdict"), F.when(F.col("doc_id") % 2 == 0, "language").alias("reason"), (F.col("doc_id") % 3).alias("seen"))
    return joins.record_verdicts(state, new, d.select(F.col("doc_id").alias("article_id"), "source"), "article_id", "seen")


@query("SELECT doc_id, doc_id IN (SELECT vec_id FROM embeddings) AS known FROM labels")
def known_vectors(spark, sf_dir):
    """Keys of one table that another has, and those that are new; both occur."""
    return joins.is_member(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")


@query("SELECT DISTINCT o_custkey::VARCHAR AS key, o_custkey % 3 <> 0 AS is_new FROM orders")
def new_customer_keys(spark, sf_dir):
    """H6: which keys of a batch are not in the state yet: customers of orders against every third customer."""
    state = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("key"))
    return joins.add_new_keys(state, table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key")), "key")


# Statistics

@query("WITH r AS (SELECT CASE WHEN length(trim(text)) < 200 THEN 'short' WHEN lang <> 'en' THEN 'language' END AS r FROM documents), g AS (SELECT r, count(*) AS n FROM r GROUP BY r) SELECT sum(n)::BIGINT AS input, sum(n) FILTER (r = 'short')::BIGINT AS short, sum(n) FILTER (r = 'language')::BIGINT AS language, sum(n) FILTER (r IS NULL)::BIGINT AS output, round(100.0::DOUBLE * sum(n) FILTER (r IS NULL) / sum(n), 2) AS retention FROM g")
def retention(spark, sf_dir):
    """What a step took in, removed by reason, gave out, and the share that stayed."""
    r = analytics.retention(table(spark, sf_dir, "documents"), F.when(F.length(F.trim("text")) < 200, "short").when(F.col("lang") != "en", "language"))
    return r.select("input", F.col("removed")["short"].alias("short"), F.col("removed")["language"].alias("language"), "output", "retention")


@query(f"WITH {THREAD}, r AS (SELECT NOT is_post AS c, len({WORDS}) AS w, role AS a, strftime(DATE '2024-01-01' + (post_id % 700)::INT, '%Y-%m') AS m FROM t) SELECT count(*) FILTER (NOT c) AS posts, count(*) FILTER (c) AS comments, count(*) AS records, sum(w)::BIGINT AS words, count(DISTINCT a) AS authors, min(m) AS first_month, max(m) AS last_month, round(count(*) FILTER (c) / count(*) FILTER (NOT c), 2) AS comments_per_post, round(sum(w) FILTER (c) / count(*) FILTER (c), 2) AS words_per_comment, round(sum(w) / count(*), 2) AS words_per_record FROM r")
def thread_totals(spark, sf_dir):
    """Totals over threads with the range of months and averages."""
    t = _thread(spark, sf_dir)
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("post_id") % 700).cast("int")), "yyyy-MM-dd")
    return analytics.thread_totals(t.withColumn("kind", F.when(F.col("is_post"), "post").otherwise("comment")), "kind", text.word_count(F.col("text")), "role", day)


@query("WITH k AS (SELECT unnest(['click', 'view', 'nosuch']) AS event_type) SELECT coalesce(k.event_type, g.event_type) AS event_type, coalesce(n, 0)::BIGINT AS n FROM k FULL JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) g ON k.event_type = g.event_type")
def keyword_counts(spark, sf_dir):
    """Rows a keyword, those without any as zero."""
    return analytics.counts_of(table(spark, sf_dir, "events"), "event_type", ["click", "view", "nosuch"])


@query("SELECT count(DISTINCT event_id) AS n, sum(floor(value)::BIGINT)::BIGINT AS likes, round(avg(floor(value)), 4) AS mean_likes, round(avg((user_id % 10)::DOUBLE), 4) AS mean_retweets, round(100.0::DOUBLE * count(*) FILTER (event_id % 4 = 0) / count(*), 1) AS retweet_pct, min(ts)::DATE::VARCHAR AS first_day, max(ts)::DATE::VARCHAR AS last_day FROM events")
def tweet_totals(spark, sf_dir):
    """Distinct messages, likes, retweets and the range of days."""
    e = table(spark, sf_dir, "events").withColumn("likes", F.floor("value"))
    return e.agg(F.count_distinct("event_id").alias("n"), F.sum("likes").alias("likes"), F.round(F.avg("likes"), 4).alias("mean_likes"), F.round(F.avg(F.col("user_id") % 10), 4).alias("mean_retweets"), analytics.percent(F.count_if(F.col("event_id") % 4 == 0), F.count("*")).alias("retweet_pct"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 5")
def top_languages(spark, sf_dir):
    """The commonest languages."""
    return analytics.top_counts(table(spark, sf_dir, "documents"), "lang", 5)


@query("WITH d AS (SELECT regexp_extract(url, '([^./:?#]+\\.[^./:?#]+)([/:?#]|$)', 1) AS domain FROM pages) SELECT domain, count(*) AS n FROM d GROUP BY domain ORDER BY n DESC, domain LIMIT 10")
def top_domains(spark, sf_dir):
    """The commonest domains."""
    return analytics.top_counts(table(spark, sf_dir, "pages").select(urls.domain(F.col("url")).alias("domain")), "domain", 10)


@query("WITH s AS (SELECT CASE WHEN value >= 120 THEN 'subjective' WHEN value >= 20 THEN 'objective' ELSE 'Irrelevant' END AS s, CASE WHEN value < 120 THEN 'neutral' WHEN user_id % 2 = 0 THEN 'positive' ELSE 'negative' END AS p, CASE WHEN event_id % 3 = 0 THEN 'lexicon_rules' ELSE 'model' END AS r FROM events) SELECT count(*) AS total, count(*) FILTER (s = 'subjective') AS subjective, count(*) FILTER (s = 'objective') AS objective, count(*) FILTER (s = 'Irrelevant') AS irrelevant, count(*) FILTER (p = 'positive') AS positive, count(*) FILTER (p = 'negative') AS negative, count(*) FILTER (p = 'neutral') AS neutral, count(*) FILTER (p = 'positive' AND contains(r, 'lexicon')) AS positive_lexicon, count(*) FILTER (p = 'positive' AND contains(r, 'model')) AS positive_model, round(100.0::DOUBLE * count(*) FILTER (s = 'subjective') / count(*), 1) AS subjective_pct FROM s")
def pipeline_summary(spark, sf_dir):
    """Annotated records by subjectivity, polarity and route."""
    v = F.col("value")
    e = table(spark, sf_dir, "events").select(F.when(v >= 120, "subjective").when(v >= 20, "objective").otherwise("Irrelevant").alias("s"), F.when(v < 120, "neutral").when(F.col("user_id") % 2 == 0, "positive").otherwise("negative").alias("p"), F.when(F.col("event_id") % 3 == 0, "lexicon_rules").otherwise("model").alias("r"))
    return analytics.pipeline_summary(e, "s", "p", "r")


@query("WITH s AS (SELECT d.doc_id, CASE quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS v, CASE toxic WHEN 0 THEN 'yes' ELSE 'no' END AS o, lang = 'fr' AS k FROM documents d LEFT JOIN labels USING (doc_id)) SELECT count(*) AS total, count(v) AS classified, count(*) FILTER (v IS NULL AND k) AS skipped, count(*) FILTER (v IS NULL AND NOT k) AS pending, count(*) FILTER (v = 'yes') AS relevant, count(*) FILTER (v = 'no') AS not_relevant, count(*) FILTER (v IS NOT NULL AND o = 'yes') AS with_opinion, count(*) FILTER (v IS NOT NULL AND o = 'no') AS without_opinion, count(*) FILTER (v = 'yes' AND o = 'yes') AS relevant_with_opinion FROM s")
def verdict_stats(spark, sf_dir):
    """Classified, skipped and pending articles, and verdicts by kind."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    d = d.select(F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "no").alias("v"), F.when(F.col("toxic") == 0, "yes").otherwise("no").alias("o"), (F.col("lang") == "fr").alias("k"))
    return analytics.verdict_stats(d, "v", "o", "k")


PRED = "p AS (SELECT CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS y_true, CASE WHEN length(text) % 3 = 0 THEN 'positive' WHEN length(text) % 3 = 1 THEN 'negative' ELSE 'neutral' END AS y_pred FROM labels l JOIN documents USING (doc_id))"


@query(f"WITH {PRED} SELECT count(*) AS support, round(count(*) FILTER (y_true = y_pred) / count(*), 6) AS accuracy FROM p")
def accuracy(spark, sf_dir):
    """Share of right predictions."""
    from .queries import CLASSES, _pairs

    return evaluation.accuracy(_pairs(spark, sf_dir), CLASSES)


RANKS = "r AS (SELECT label AS query_id, (vec_id % 3 = 0)::INT AS relevant, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings), c AS (SELECT query_id, rank, round(sum(relevant) OVER w::DOUBLE / rank, 6) AS p, round(coalesce(sum(relevant) OVER w::DOUBLE / nullif(sum(relevant) OVER (PARTITION BY query_id), 0), 0), 6) AS q, sum(relevant) OVER w::DOUBLE / rank AS pp, coalesce(sum(relevant) OVER w::DOUBLE / nullif(sum(relevant) OVER (PARTITION BY query_id), 0), 0) AS qq FROM r WINDOW w AS (PARTITION BY query_id ORDER BY rank)), f AS (SELECT *, round(CASE WHEN pp + qq > 0 THEN 2 * pp * qq / (pp + qq) ELSE 0 END, 6) AS f1 FROM c)"


@query(f"WITH {RANKS} SELECT query_id, max(p) FILTER (rank = 10) AS p_at_k, max(q) FILTER (rank = 10) AS r_at_k, max(f1) AS peak_f1, arg_min(rank, (-f1, rank)) AS peak_rank, round(avg(p), 4) AS mean_precision, round(avg(q), 4) AS mean_recall FROM f GROUP BY query_id")
def rank_summary(spark, sf_dir):
    """precision and recall at 10, the peak of f1 and its rank, and means."""
    from .queries import pr_at_k

    return evaluation.rank_summary(pr_at_k(spark, sf_dir))


@query(f"WITH {THREAD}, s AS (SELECT *, (length(text) % 41)::DOUBLE / 100 AS s FROM t), e AS (SELECT a.doc_id, CASE WHEN a.is_post THEN a.s ELSE least(a.s, p.s) END AS e, len(regexp_split_to_array(a.text, ' ')) AS w FROM s a JOIN s p ON p.post_id = a.post_id AND p.is_post), b AS (SELECT unnest(range(10, 41, 2)) AS percent), c AS (SELECT percent, count(*) AS rows, sum(w)::BIGINT AS words FROM b JOIN e ON e.e * 100 + 1e-9 >= percent GROUP BY percent) SELECT percent::INT AS percent, rows, words FROM c WHERE rows >= 50 AND words >= 500 ORDER BY percent DESC LIMIT 1")
def thread_threshold(spark, sf_dir):
    """F8: the highest threshold that keeps enough rows and words, comments only with their post."""
    t = _thread(spark, sf_dir).select("doc_id", ((F.length("text") % 41) / 100).alias("s"), F.size(F.split("text", " ")).alias("w"), "post_id", "is_post")
    t = t.withColumn("up", F.when(~F.col("is_post"), F.min(F.when(F.col("is_post"), F.col("doc_id"))).over(Window.partitionBy("post_id"))))
    rows = threads.effective_score(t, "doc_id", "up", "s")
    return threads.threshold_sweep(rows, "effective", "w", min_rows=50, min_words=500)


# Sorts

@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 3")
def n_largest(spark, sf_dir):
    """The three rows of the highest score."""
    return table(spark, sf_dir, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(3)


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (ORDER BY ts DESC, event_id) AS place FROM events QUALIFY place <= 50")
def sort_newest(spark, sf_dir):
    """The newest messages first, by their parsed dates."""
    said = F.date_format("ts", "'Xxx 'MMM dd HH:mm:ss +0000 yyyy")
    e = table(spark, sf_dir, "events").select("event_id", said.alias("created_at"), "ts")
    newest = e.orderBy(F.desc("ts"), "event_id").limit(50)
    place = F.row_number().over(Window.orderBy(F.desc("ts"), "event_id"))
    return newest.select("event_id", dates.tweet_date(F.col("created_at")).alias("day"), place.alias("place"))


@query("SELECT doc_id, source, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50")
def paginate_total(spark, sf_dir):
    """One page and the number of all rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.orderBy("doc_id").offset(50).limit(25).join(d.agg(F.count("*").alias("total")))


# Text functions

@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), 'https?://[^\x20\x09-\x0D]+', '[URL]', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS clean FROM (SELECT doc_id, '<b>' || replace(coalesce(text, ''), '&', ' and ') || '</b> see https://a.b/c?d x' AS t FROM documents)")
def clean_html_texts(spark, sf_dir):
    """Tags stripped, URLs marked, white space collapsed."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("&lt;b&gt;"), F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit(" and ")), F.lit("</b> see https://a.b/c?d x")).alias("t"))
    return d.select("doc_id", text.clean_html_text(F.col("t")).alias("clean"))


@query("WITH r AS (SELECT conv_id, turn, '@' || role || ' says #T' || turn::VARCHAR || ' ' || coalesce(text, '') AS t FROM conversations) SELECT conv_id, turn, regexp_extract_all(t, '@[A-Za-z0-9_]+') AS mentions, regexp_extract_all(t, '#[A-Za-z0-9_]+') AS hashtags FROM r")
def mentions_hashtags(spark, sf_dir):
    """Mentions and hashtags."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("@"), "role", F.lit(" says #T"), F.col("turn").cast("string"), F.lit(" "), F.coalesce("text", F.lit(""))).alias("t"))
    return c.select("conv_id", "turn", text.mentions(F.col("t")).alias("mentions"), text.hashtags(F.col("t")).alias("hashtags"))


@query("SELECT conv_id, turn, coalesce(text, '') || CASE turn % 3 WHEN 0 THEN ' [grinning_face]!' WHEN 1 THEN 'x[rocket][rocket]' ELSE '' END AS t FROM conversations")
def demojize(spark, sf_dir):
    """Emoji anywhere in a text become their names."""
    tail = F.when(F.col("turn") % 3 == 0, " \U0001f600!").when(F.col("turn") % 3 == 1, "x\U0001f680\U0001f680").otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.demojize(F.concat(F.coalesce("text", F.lit("")), tail)).alias("t"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND source IS NOT NULL AND doc_id % 3 = 0 THEN source ELSE CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END END AS t, CASE WHEN doc_id % 4 = 0 AND source IS NOT NULL AND doc_id % 3 = 0 THEN 'title' ELSE 'text' END AS text_source FROM documents")
def pick_text(spark, sf_dir):
    """The title instead of an empty text, for one source."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.pick_text(F.when(F.col("doc_id") % 3 == 0, "HackerNews").otherwise("reddit"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("text")), F.col("source")).alias("p"))
    return d.select("doc_id", F.col("p.text").alias("t"), F.col("p.text_source").alias("text_source"))


STOP = ["the", "and", "der", "que", "of"]


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(coalesce(text, '')), 'https?://[^\x20\x09-\x0D]+', ' ', 'g'), '[!-/:-@\[-`{-~]', ' ', 'g'), '[\x20\x09-\x0D]+'), lambda w: w <> '' AND w NOT IN ('the', 'and', 'der', 'que', 'of') AND (length(w) > 2 OR regexp_matches(w, '[^\x00-\x7F]'))), ' ') AS t FROM documents")
def clean_tokens(spark, sf_dir):
    """Lower case, no URLs, punctuation or stop words."""
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_tokens(F.col("text"), STOP).alias("t"))


@query(r"SELECT doc_id, list_filter(regexp_extract_all('<CODE> [smile] ' || coalesce(text, ''), '<CODE>|\[[A-Za-z0-9_ ]+\]|[A-Za-z0-9]+'), lambda w: lower(w) NOT IN ('the', 'and', 'der', 'que', 'of')) AS t FROM documents")
def content_tokens(spark, sf_dir):
    """Words that are no function words; marks stay whole."""
    return table(spark, sf_dir, "documents").select("doc_id", text.content_tokens(F.concat(F.lit("<CODE> [smile] "), F.coalesce("text", F.lit(""))), STOP).alias("t"))


@query(r"WITH r AS (SELECT conv_id, turn, 'a <CODE> ' || coalesce(text, '') || ' [wink] <CODE>' AS t FROM conversations) SELECT conv_id, turn, regexp_replace(t, '<CODE>|\[[A-Za-z0-9_ ]+\]', 'XSPECIALX', 'g') AS protected, regexp_extract_all(t, '<CODE>|\[[A-Za-z0-9_ ]+\]') AS found, t AS restored FROM r")
def protect_special(spark, sf_dir):
    """Code marks and [names] kept apart and put back."""
    p = text.protect_special(F.concat(F.lit("a <CODE> "), F.coalesce("text", F.lit("")), F.lit(" [wink] <CODE>")))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", p.alias("p"))
    return c.select("conv_id", "turn", F.col("p.text").alias("protected"), F.col("p.found").alias("found"), text.restore_special(F.col("p.text"), F.col("p.found")).alias("restored"))


@query("SELECT doc_id, left(replace(coalesce(text, ''), chr(13), ' '), 5000) AS t FROM documents")
def clean_for_index(spark, sf_dir):
    """What the store keeps of a text: its first 5,000 characters, no carriage returns or NULs."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(""), F.coalesce("text", F.lit(""))).alias("t"))
    return d.select("doc_id", text.clean_for_index(F.col("t")).alias("t"))


@query(r"WITH u AS (SELECT page_id, 'HTTP://Www.A.b/Path/?Q=' || page_id::VARCHAR || '#frag' AS u FROM pages) SELECT page_id, lower(regexp_replace(regexp_extract(split_part(u, '#', 1), '^([^?]*)', 1), '/+$', '') || regexp_extract(split_part(u, '#', 1), '(\?.*)$', 1)) AS norm FROM u")
def normalize_url_path(spark, sf_dir):
    """The form that keeps the query and strips the path's slash."""
    u = F.concat(F.lit("HTTP://Www.A.b/Path/?Q="), F.col("page_id").cast("string"), F.lit("#frag"))
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url_keep_query(u).alias("norm"))


HOSTS = ["x.medium.com", "a.substack.com", "stackoverflow.com", "openai.com", "eng.uber.com", "my.blog.org"]


@query(f"SELECT page_id, (['medium', 'substack', 'stackoverflow', 'corporate', 'corporate', 'personal'])[(page_id % 6 + 1)::INT] AS source_type, (['a', 'b'])[1] AS k FROM pages")
def source_types(spark, sf_dir):
    """Every type of source, by hosts put in place of the pages' own."""
    host = F.element_at(F.array(*map(F.lit, HOSTS)), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", urls.source_type(F.concat(F.lit("https://"), host, F.lit("/p"))).alias("source_type"), F.lit("a").alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS at, strftime(ts, '%Y-%m-%d') AS day FROM events")
def iso_and_epoch(spark, sf_dir):
    """ISO times, null where they cannot be read; epoch seconds to days."""
    iso = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("no date")
    e = table(spark, sf_dir, "events").select("event_id", iso.alias("iso"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    return e.select("event_id", F.date_format(dates.iso_or_null(F.col("iso")), "yyyy-MM-dd'T'HH:mm:ss").alias("at"), dates.epoch_to_date(F.col("s")).alias("day"))


NAMED = "CASE event_id % 4 WHEN 0 THEN 'Claude' WHEN 1 THEN 'claude ' WHEN 2 THEN 'X' ELSE event_type END"


@query("SELECT event_id, CASE event_id % 4 WHEN 2 THEN [lower(event_type)] WHEN 3 THEN [lower(event_type)] ELSE ['claude', lower(event_type)] END AS names, CASE WHEN event_id % 4 < 2 THEN ['claude'] ELSE [] END AS tools, 'a: ' || event_type || '; b: ' || user_id::VARCHAR AS said FROM events")
def entity_names(spark, sf_dir):
    """Distinct names of more than one character, tools among them, aspects with their polarity as text."""
    name = F.expr(NAMED)
    label = F.when(F.col("event_id") % 4 < 2, "AI_TOOL").otherwise("ORG")
    nested = F.array(F.array(F.struct(name.alias("name"), label.alias("label"))), F.array(F.struct(F.upper("event_type").alias("name"), F.lit("ORG").alias("label"))))
    found = F.flatten(nested)
    said = F.array(F.struct(F.lit("a").alias("aspect"), F.col("event_type").alias("polarity")), F.struct(F.lit("b").alias("aspect"), F.col("user_id").cast("string").alias("polarity")))
    return table(spark, sf_dir, "events").select("event_id", entities.distinct_ci(F.transform(found, lambda x: x["name"])).alias("names"), entities.ai_tools(found).alias("tools"), entities.aspect_string(said).alias("said"))


@query("SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'irrelevant' WHEN quality = 1 THEN 'positive' WHEN lang = 'en' THEN 'negative' ELSE 'unknown' END AS label FROM documents d LEFT JOIN labels USING (doc_id)")
def resolved_labels(spark, sf_dir):
    """Irrelevant, else polarity, else the fallback, else unknown."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", joins.resolve_label(F.coalesce(F.col("toxic") == 1, F.lit(False)), F.when(F.col("quality") == 1, "positive"), F.when(F.col("lang") == "en", "negative").otherwise("")).alias("label"))


# Entities

LINES = "l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)), p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS s FROM l)"


@query(f"WITH {LINES} SELECT doc_id, line AS sentence, s AS s_start, (s + length(line))::INT AS s_end FROM p WHERE line <> ''")
def sentence_places(spark, sf_dir):
    """Where each sentence (here: each line) stands in its text."""
    d = staged(table(spark, sf_dir, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("row_")), "numbered")
    rows = text.piece_rows(d, "row_", F.col("text"), "\n").where("piece <> ''")
    return rows.join(d.select("row_", "doc_id"), "row_").select("doc_id", F.col("piece").alias("sentence"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))


@query(f"WITH {LINES}, e AS (SELECT doc_id, line, s, unnest([split_part(line, ' ', 1), split_part(line, ' ', 1), 'ORG-' || i::VARCHAR]) AS entity, unnest(['AI_TOOL', 'AI_TOOL', 'PERSON']) AS label FROM p WHERE line <> '' AND split_part(line, ' ', 1) <> '') SELECT doc_id, entity AS aspect, label AS type, line AS sentence, len({WORDS.replace('text', 'line')})::INT AS n_words FROM (SELECT DISTINCT * FROM e WHERE label = 'AI_TOOL')")
def line_aspects(spark, sf_dir):
    """Entities of aspect types with the sentence that holds them, once a sentence; here the first word of every line."""
    lines = sentence_places(spark, sf_dir)
    first = F.substring_index("sentence", " ", 1)
    found = lines.where(first != "").select("doc_id", "s_start", F.inline(F.array(*(F.struct(e.alias("entity"), F.lit(l).alias("label")) for e, l in ((first, "AI_TOOL"), (first, "AI_TOOL"), (F.concat(F.lit("ORG-"), F.col("s_start").cast("string")), "PERSON"))))))
    found = found.select("doc_id", "entity", "label", F.col("s_start").alias("start"), (F.col("s_start") + F.when(F.col("label") == "AI_TOOL", F.length("entity")).otherwise(0)).alias("end"))
    return entities.extract_aspects(found, lines, "doc_id")


SAID = "coalesce(text, '') || CASE turn % 3 WHEN 0 THEN ' uses Zed' || turn::VARCHAR || ' plugin' WHEN 1 THEN ' the Grok API and Nova Two editor' ELSE ' a model or editor' END"
NAMES = "list_transform(regexp_extract_all({}, '((?:[A-Z][A-Za-z0-9]+ )+)(?i:{})\\b', 1), lambda x: trim(x))"


@query(f"WITH c AS (SELECT conv_id, turn, {SAID} AS said FROM conversations), n AS (SELECT *, {NAMES.format('said', 'model|api|extension|plugin')} AS a, {NAMES.format('said', 'editor')} AS b FROM c) SELECT conv_id, turn, a || b AS names, list_transform(a, lambda x: 'AI_TOOL') || list_transform(b, lambda x: 'EDITOR') AS labels FROM n")
def contextual_entities(spark, sf_dir):
    """Capitalised words before model, api, plugin or editor, with their labels, in every turn's whole text and an ending that names some."""
    more = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" uses Zed"), F.col("turn").cast("string"), F.lit(" plugin"))).when(F.col("turn") % 3 == 1, " the Grok API and Nova Two editor").otherwise(" a model or editor")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", entities.contextual(F.concat(F.coalesce("text", F.lit("")), more)).alias("e"))
    return c.select("conv_id", "turn", F.col("e.name").alias("names"), F.col("e.label").alias("labels"))


# Scores

LINE = "x AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS d, l_tax * 12.5 AS t, l_returnflag AS f, l_quantity AS q FROM lineitem)"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 12.5).alias("t"), F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("q"))


@query(f"WITH {LINE}, b AS (SELECT *, 0.4::DOUBLE * d + 0.6::DOUBLE * t AS b FROM x) SELECT l_orderkey, l_linenumber, CASE WHEN d >= 0.75 THEN 'subjective' WHEN d <= 0.2 THEN 'objective' ELSE 'model' END AS band, round(b, 6) AS blend, CASE WHEN b >= 0.5 OR (f = 'R' AND t < 0.6 AND q > 20 AND q <= 40) THEN 'subjective' ELSE 'objective' END AS label FROM b")
def subjectivity_rules(spark, sf_dir):
    """Bands of the lexicon's score, its blend with a model's, and the flip of unsure objective sentences."""
    b = _lines(spark, sf_dir).withColumn("b", scoring.blend_model_score(F.col("d"), F.col("t")))
    label = scoring.model_subjectivity(F.col("b"), F.when(F.col("f") == "R", "objective").otherwise("subjective"), F.col("t"), F.col("q") > 20, F.col("q") <= 40)
    return b.select("l_orderkey", "l_linenumber", scoring.subjectivity_band(F.col("d")).alias("band"), F.round("b", 6).alias("blend"), label.alias("label"))


@query(f"WITH {LINE}, v AS (SELECT *, CASE WHEN f = 'N' THEN (d + 1) / 2 ELSE 0.55::DOUBLE * (d + 1) / 2 + 0.45::DOUBLE * (2 * t - 1 + 1) / 2 END AS s FROM x) SELECT l_orderkey, l_linenumber, round(s, 6) AS score, CASE WHEN s >= 0.65 THEN 'positive' WHEN s <= 0.35 THEN 'negative' ELSE 'neutral' END AS label, round(2 * abs(s - 0.5), 6) AS confidence FROM v")
def fused_polarity(spark, sf_dir):
    """Valence and lexicon polarity in one score, its label and confidence; many stand on a bound."""
    s = scoring.fuse_polarity(F.col("d"), F.when(F.col("f") != "N", 2 * F.col("t") - 1))
    v = _lines(spark, sf_dir).withColumn("s", s)
    return v.select("l_orderkey", "l_linenumber", F.round("s", 6).alias("score"), scoring.polarity_label(F.col("s")).alias("label"), F.round(scoring.polarity_confidence(F.col("s")), 6).alias("confidence"))


@query(f"WITH {LINE}, r AS (SELECT *, CASE f WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'neutral' END AS l FROM x), c AS (SELECT *, CASE WHEN l = 'positive' AND d + 1e-9 >= 0.85 * 0.6 THEN d WHEN l = 'negative' AND d + 1e-9 >= 0.6 THEN -d ELSE 0 END AS s FROM r) SELECT l_orderkey, l_linenumber, CASE WHEN q < 10 THEN 'lexicon' WHEN q > 40 THEN 'chunks' ELSE 'model' END AS route, round(s, 6) + 0.0 AS score, round(CASE WHEN q % 2 = 0 AND t > 0.99 THEN -s ELSE s END, 6) + 0.0 AS final FROM c")
def model_polarity(spark, sf_dir):
    """The route by length, the model's label with its confidence floor as a signed score, turned by sarcasm."""
    r = _lines(spark, sf_dir).withColumn("l", F.when(F.col("f") == "A", "positive").when(F.col("f") == "R", "negative").otherwise("neutral"))
    r = r.withColumn("s", scoring.confidence_floor(F.col("l"), F.col("d") + 1e-9, 0.6))
    final = scoring.apply_sarcasm(F.col("s"), F.col("q") % 2 == 0, F.col("t"))
    return r.select("l_orderkey", "l_linenumber", scoring.route_by_length(F.col("q"), 10, 40).alias("route"), (F.round("s", 6) + 0.0).alias("score"), (F.round(final, 6) + 0.0).alias("final"))


@query(f"WITH {LINE}, o AS (SELECT l_orderkey, round(avg(CASE f WHEN 'A' THEN d ELSE -d END), 9) AS m, CASE WHEN l_orderkey % 3 = 0 THEN 'positive' ELSE 'neutral' END AS l FROM x GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN l <> 'neutral' THEN l WHEN m >= 0.25 THEN 'positive' WHEN m <= -0.25 THEN 'negative' ELSE 'neutral' END AS polarity FROM o")
def document_polarity(spark, sf_dir):
    """The model's label of the document; a neutral one gives way to a clear mean of its aspects."""
    o = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.round(F.avg(F.when(F.col("f") == "A", F.col("d")).otherwise(-F.col("d"))), 9).alias("m"))
    label = F.when(F.col("l_orderkey") % 3 == 0, "positive").otherwise("neutral")
    return o.select("l_orderkey", scoring.document_polarity(label, F.col("m")).alias("polarity"))


@query(f"WITH {LINE}, s AS (SELECT l_orderkey, l_linenumber, CASE WHEN q > 45 THEN NULL WHEN f = 'R' THEN d ELSE 1 - d END AS p FROM x), g AS (SELECT l_orderkey, count(*) FILTER (p > 0.5 AND p >= 0.85) >= 2 OR count(*) FILTER (p > 0.5 AND p >= 0.95) >= 1 AS has FROM s GROUP BY l_orderkey) SELECT l_orderkey, has AS has_sarcasm, (SELECT round(sum(coalesce(p, 0)), 4) FROM s WHERE s.l_orderkey = g.l_orderkey) AS total FROM g")
def sarcasm(spark, sf_dir):
    """The probability of sarcasm of every aspect (none where the model was bypassed), and whether a document has any."""
    s = _lines(spark, sf_dir).select("l_orderkey", scoring.sarcasm(F.when(F.col("f") == "R", "sarcastic").otherwise("plain"), F.col("d"), F.col("q") > 45).alias("a"))
    g = s.groupBy("l_orderkey").agg(F.collect_list("a").alias("a"), F.round(F.sum("a.confidence"), 4).alias("total"))
    return g.select("l_orderkey", scoring.has_sarcasm(F.col("a")).alias("has_sarcasm"), "total")


@query("SELECT doc_id, length(left(coalesce(text, ''), 600))::DOUBLE AS model_score FROM documents")
def scored_by_model(spark, sf_dir):
    """A caller's model over distinct inputs, in batches; here one that gives the length of what it sees."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return models.score_with_model(d, "text", lambda: lambda texts: [float(len(t)) for t in texts], cap=600).select("doc_id", "model_score")


VALENCE = [("the", 0.5), ("of", -0.25), ("der", 1.0), ("heon", -2.0)]


LAGS = " OR ".join(f"coalesce(lag(w, {k}) OVER (PARTITION BY doc_id ORDER BY i), '') IN ('and', 'is')" for k in (1, 2, 3))


@query(f"WITH t AS (SELECT doc_id, generate_subscripts(t, 1) AS i, unnest(t) AS w FROM (SELECT doc_id, {TOKENS_OF} AS t FROM documents)), n AS (SELECT doc_id, w, {LAGS} AS negated FROM t), s AS (SELECT doc_id, sum(CASE w WHEN 'the' THEN 0.5 WHEN 'of' THEN -0.25 WHEN 'heon' THEN -2.0 END::DOUBLE * CASE WHEN negated THEN -0.74 ELSE 1.0 END::DOUBLE) AS s FROM n GROUP BY doc_id) SELECT d.doc_id, round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15), 5) AS valence FROM documents d LEFT JOIN s USING (doc_id)")
def valences(spark, sf_dir):
    """Signed lexicon scores with negation, domain words neutralised."""
    lexicon = spark.createDataFrame(VALENCE, "word string, polarity double")
    v = scoring.valence(table(spark, sf_dir, "documents"), "doc_id", "text", lexicon, ["and", "is"], neutral=("der",))
    return v.select("doc_id", F.round("valence", 5).alias("valence"))


TAGS = {"a": ["heon", "thntre"], "b": ["que"], "c": ["der "], "d": ["nosuchterm"]}


@query("SELECT doc_id, list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{c}' END" for c, ws in TAGS.items()) + "], lambda x: x IS NOT NULL) AS tags FROM documents")
def tagged_topics(spark, sf_dir):
    """S3: tags by terms of the corpus; some documents have several, some none."""
    return table(spark, sf_dir, "documents").select("doc_id", scoring.topic_tags(F.col("text"), TAGS).alias("tags"))


@query("WITH t AS (SELECT unnest(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{c}' END" for c, ws in TAGS.items()) + "], lambda x: x IS NOT NULL)) AS tag FROM documents) SELECT tag, count(*) AS n FROM t GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
def tagged_distribution(spark, sf_dir):
    """The commonest tags."""
    return analytics.top_counts(table(spark, sf_dir, "documents").select(F.explode(scoring.topic_tags(F.col("text"), TAGS)).alias("tag")), "tag", 20)


@query("SELECT doc_id, doc_id % 5 = 0 OR doc_id % 7 = 0 AS advert FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '(?i)https?://')")
def advert_flags(spark, sf_dir):
    """Advertisements by phrase and by URL, put into some texts; both outcomes occur."""
    said = F.when(F.col("doc_id") % 5 == 0, " Sign up NOW for it").when(F.col("doc_id") % 7 == 0, " see https://a.b/c").otherwise("")
    d = table(spark, sf_dir, "documents").where(~F.coalesce(F.col("text").rlike("(?i)https?://"), F.lit(False)))
    return d.select("doc_id", filters.is_advertisement(F.concat(F.coalesce("text", F.lit("")), said)).alias("advert"))


# Samples

OPINION_LEVEL = "CASE WHEN length(text) % 10 < 2 THEN 'high' WHEN length(text) % 10 < 5 THEN 'medium' ELSE 'low' END"


def _levels(spark, sf_dir):
    n = F.length("text") % 10
    return table(spark, sf_dir, "documents").select("doc_id", F.when(n < 2, "high").when(n < 5, "medium").otherwise("low").alias("level"))


@query(f"WITH d AS (SELECT doc_id, {OPINION_LEVEL} AS level FROM documents), c AS (SELECT level, count(*) AS there FROM d GROUP BY level), g AS (SELECT level, least(greatest(CASE level WHEN 'high' THEN 100 WHEN 'medium' THEN 60 ELSE 40 END, CASE level WHEN 'low' THEN 50 ELSE 100 END), there) AS goal FROM c), s AS (SELECT doc_id, d.level FROM d JOIN g ON d.level = g.level QUALIFY row_number() OVER (PARTITION BY d.level ORDER BY md5(doc_id::VARCHAR || '|s4'), doc_id) <= max(goal) OVER (PARTITION BY d.level)) SELECT * FROM s ORDER BY md5(doc_id::VARCHAR || '|s4|cut'), doc_id LIMIT 200")
def stratified_cut(spark, sf_dir):
    """L2: shares by level with minima, capped by what there is, cut to the size."""
    return sampling.stratified_cut(_levels(spark, sf_dir), "doc_id", "level", 200, {"high": 0.5, "medium": 0.3, "low": 0.2}, {"high": 100, "medium": 100, "low": 50}, "s4")


@query("SELECT doc_id, (row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|s5') || '|' || doc_id::VARCHAR) > (count(*) OVER () + 1) // 2)::INT AS half FROM documents")
def split_exact(spark, sf_dir):
    """L3: two shuffled halves of exact size."""
    return sampling.split_exact(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "s5")


@query(f"WITH d AS (SELECT doc_id, {OPINION_LEVEL} AS class FROM documents) SELECT doc_id, class, row_number() OVER (PARTITION BY class ORDER BY md5(doc_id::VARCHAR || '|s6'), doc_id) AS place FROM d WHERE class <> 'low' QUALIFY place <= 3")
def class_examples(spark, sf_dir):
    """L4: three examples a class."""
    d = _levels(spark, sf_dir)
    return sampling.examples(d, "doc_id", F.when(F.col("level") != "low", F.col("level")), "s6").select("doc_id", "class", "place")


FAILED = "CASE WHEN page_id % 5 = 0 THEN 'fetch' WHEN length(html) < 1500 THEN 'short' END"


@query(f"WITH f AS (SELECT page_id, url, {FAILED} AS reason FROM pages) SELECT page_id, reason, reason IS NOT NULL AS skipped_next_time FROM f")
def extraction_failures(spark, sf_dir):
    """Pages that failed, kept as a table with the reason; the next run leaves them out."""
    p = table(spark, sf_dir, "pages").withColumn("reason", F.when(F.col("page_id") % 5 == 0, "fetch").when(F.length("html") < 1500, "short"))
    path = staged_path(spark)
    p.where("reason IS NOT NULL").select("page_id", "url", "reason").write.parquet(path)
    failures = spark.read.schema("page_id long, url string, reason string").parquet(path)
    left = joins.anti(p.select("page_id"), failures, "page_id").select("page_id", F.lit(False).alias("skipped_next_time"), F.lit(None).cast("string").alias("reason"))
    return left.unionByName(failures.select("page_id", F.lit(True).alias("skipped_next_time"), "reason"))


# Streams

@query("SELECT event_type || (user_id % 50)::VARCHAR AS norm, min(event_id) AS ord, arg_min(user_id::VARCHAR, event_id) AS original_url, count(*) AS n_merged, min(strftime(ts, '%Y-%m-%d')) AS discovered_at, len(list_distinct(list('q' || (event_id % 4)::VARCHAR))) AS n_queries FROM events GROUP BY norm")
def stream_url_state(spark, sf_dir):
    """M2: discoveries that arrive as a stream, folded into the state of their pages."""
    from .record_queries import _events

    rows = _events(spark, sf_dir).select(F.concat("event_type", (F.col("user_id") % 50).cast("string")).alias("norm"), F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("original_url"), F.lit("web").alias("method"), F.array(F.concat(F.lit("q"), (F.col("event_id") % 4).cast("string"))).alias("queries"), F.date_format("ts", "yyyy-MM-dd").alias("discovered_at"))
    state = ingest.stream_url_state(rows, staged_path(spark), staged_path(spark), buckets=16)
    return state.select("norm", "ord", "original_url", F.col("n_merged").cast("long").alias("n_merged"), "discovered_at", F.size("queries").alias("n_queries"))
