"""Readers, record mappings and sinks. Schemas are explicit; every function is lazy but the writers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.dates import epoch_to_date, tweet_date
from ..functions.text import collapse, word_count
from .json_arrays import read_json_objects

COMMENT = "comment_id string, parent_id string, Source string, Author string, Text string, Score int, Date string, Word_Count int"
THREAD = f"ID string, Source string, Type string, Author string, Title string, Text string, Score int, Date string, Word_Count int, Comments array<struct<{COMMENT.replace(' string', ':string').replace(' int', ':int')}>>"
ROW = "Source string, ID string, Type string, Author string, Text string, Score int, Date string"


def read_threads(spark: SparkSession, path: str, schema: str = THREAD, lines: bool = False) -> DataFrame:
    """A1: files of one array or one object of threads each, both of any size; lines: of a thread per line."""
    return spark.read.schema(schema).json(path) if lines else read_json_objects(spark, path, schema)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A2: a record per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_rows_csv(spark: SparkSession, path: str, schema: str = ROW) -> DataFrame:
    """A3: CSV with a header; row_idx increases in file order. Stage it before any shuffle."""
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.withColumn("row_idx", F.monotonically_increasing_id())


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A4: a JSON object of strings as rows key, meaning."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "meaning"))


def resolve_slang(lexicon: DataFrame, keep: list[str], overrides: dict[str, str], hints: list[str]) -> DataFrame:
    """A4: one meaning per key: keys in keep go; an override, else the first meaning with a hint word, else the first."""
    key = F.lower("key")
    options = F.transform(F.split("meaning", "-or-"), lambda m: F.trim(m))
    fixed = F.create_map(*(F.lit(x) for kv in overrides.items() for x in kv))[key] if overrides else F.lit(None).cast("string")
    hinted = F.filter(options, lambda m: F.arrays_overlap(F.split(F.lower(m), " "), F.array(*map(F.lit, hints)))) if hints else F.array().cast("array<string>")
    return lexicon.where(~key.isin(keep)).select(key.alias("key"), F.coalesce(fixed, F.try_element_at(hinted, F.lit(1)), options[0]).alias("meaning"))


def read_mpqa(spark: SparkSession, path: str) -> DataFrame:
    """A5: lines of key=value tokens as word, type, pos, polarity; of a word's lines the last in the file wins."""
    lines = spark.read.text(path).select(F.expr("str_to_map(trim(value), ' ', '=')").alias("m"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    rows = lines.select(F.col("m")["word1"].alias("word"), F.col("m")["type"].alias("type"), F.col("m")["pos1"].alias("pos"), F.col("m")["priorpolarity"].alias("polarity"), "file", "at").where("word IS NOT NULL")
    last = F.struct("file", "at")
    return rows.groupBy("word").agg(*(F.max_by(c, last).alias(c) for c in ("type", "pos", "polarity")))


def from_hn_hits(hits: DataFrame) -> DataFrame:
    """hits(objectID, author, created_at, created_at_i, title, url, text, comment_text, story_id, parent_id, points) -> records.
    A hit with comment_text is a comment, else a story; hits without text go."""
    comment = F.col("comment_text").isNotNull()
    text = F.when(comment, F.col("comment_text")).otherwise(F.coalesce("text", "title"))
    return hits.where(F.coalesce(F.trim(text), F.lit("")) != "").select(
        F.lit("hackernews").alias("source"), F.when(comment, "comment").otherwise("story").alias("type"), F.col("objectID").alias("item_id"),
        F.col("parent_id"), F.coalesce("story_id", "objectID").alias("story_id"), "author", "created_at", "created_at_i",
        F.concat(F.lit("https://news.ycombinator.com/item?id="), "objectID").alias("url"), F.col("title").alias("story_title"), F.col("url").alias("story_url"),
        text.alias("text_raw"), F.coalesce("points", F.lit(0)).alias("points"), F.sha1(F.concat(F.lit("hackernews_"), "objectID")).alias("source_hash"),
    )


def from_reddit_posts(posts: DataFrame, source: str) -> DataFrame:
    """posts(id, author, title, selftext, score, created_utc) -> rows; title and body joined, line breaks to spaces."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("selftext", F.lit("")))
    return posts.select(F.lit(source).alias("Source"), F.col("id").alias("ID"), F.lit("Post").alias("Type"), F.col("author").alias("Author"), F.trim(F.translate(text, "\r\n", "  ")).alias("Text"), F.col("score").alias("Score"), epoch_to_date(F.col("created_utc")).alias("Date"))


def from_reddit_comments(comments: DataFrame, source: str, fetched: str) -> DataFrame:
    """comments(id, author, body, score) -> rows; empty, deleted and texts of 20 characters or fewer go."""
    body = F.trim(F.translate(F.coalesce("body", F.lit("")), "\r\n", "  "))
    return comments.where((body != "[deleted]") & (F.length(body) > 20)).select(F.lit(source).alias("Source"), F.col("id").alias("ID"), F.lit("Comment").alias("Type"), F.col("author").alias("Author"), body.alias("Text"), F.col("score").alias("Score"), F.lit(fetched).alias("Date"))


def from_search_results(results: DataFrame, method: str, discovered_at: str) -> DataFrame:
    """results(query, links array) -> one row per link that begins with http."""
    return results.select("query", F.explode("links").alias("url")).where(F.col("url").startswith("http")).select("url", "query", F.lit(method).alias("method"), F.lit(discovered_at).alias("discovered_at"))


def article_to_thread(articles: DataFrame) -> DataFrame:
    """B2: articles(article_id, source_type, author, title, text, date) -> threads without comments."""
    return articles.select(F.concat(F.lit("article_"), F.col("article_id").cast("string")).alias("ID"), F.coalesce("source_type", F.lit("unknown")).alias("Source"), F.lit("Article").alias("Type"), F.coalesce("author", F.lit("")).alias("Author"), F.col("title").alias("Title"), F.coalesce("text", F.lit("")).alias("Text"), F.lit(0).alias("Score"), F.coalesce("date", F.lit("")).alias("Date"), word_count(F.col("text")).alias("Word_Count"), F.expr(f"cast(array() AS {THREAD.split('Comments ')[1]})").alias("Comments"))


def tweet_to_thread(tweets: DataFrame) -> DataFrame:
    """tweets(tweet_id, username, tweet_text, created_at, like_count) -> threads: lower case, white space collapsed."""
    text = F.lower(collapse(F.col("tweet_text")))
    return tweets.select(F.col("tweet_id").cast("string").alias("ID"), F.lit("Twitter").alias("Source"), F.lit("Post").alias("Type"), F.col("username").alias("Author"), F.lit(None).cast("string").alias("Title"), text.alias("Text"), F.col("like_count").cast("int").alias("Score"), tweet_date(F.col("created_at")).alias("Date"))


def final_label(review: Column, llm: Column, bucket: Column) -> Column:
    """The reviewer's label in lower case, else the model's, else the bucket."""
    return F.coalesce(F.lower(F.nullif(review, F.lit(""))), F.nullif(llm, F.lit("")), bucket)


def labelled_item_to_thread(items: DataFrame) -> DataFrame:
    """items(post struct<ID, Text>, review struct<final_label>, llm struct<label>, assigned_bucket, comments array<struct<comment_id,
    Text, final_label, llm_label>>) -> ID, Text, label, Comments with label: the reviewer's, else the model's, else the bucket."""
    comment = lambda c: F.struct(c["comment_id"].alias("comment_id"), c["Text"].alias("Text"), final_label(c["final_label"], c["llm_label"], F.col("assigned_bucket")).alias("label"))
    return items.select(
        F.col("post.ID").alias("ID"), F.col("post.Text").alias("Text"), final_label(F.col("review.final_label"), F.col("llm.label"), F.col("assigned_bucket")).alias("label"),
        F.transform(F.coalesce("comments", F.expr("slice(comments, 1, 0)")), comment).alias("Comments"),
    )


def violations_summary(checked: DataFrame) -> DataFrame:
    """Records by violation ('valid' for none), with the least id of each."""
    return checked.groupBy(F.coalesce("violation", F.lit("valid")).alias("violation")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def coerce_fields(raw: DataFrame, mapping: dict[str, tuple[str, object]]) -> DataFrame:
    """The fixed mapping of the search store: name -> (type, default); null, empty and unreadable values take the default."""
    return raw.select(*(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")).try_cast(kind), F.lit(default)).alias(c) for c, (kind, default) in mapping.items()))


def validate_schema(raw: DataFrame, column: str, required: dict[str, str], nullable: tuple[str, ...] = ("Title",)) -> DataFrame:
    """Adds violation: the first key of required (name -> Spark type) that the JSON in column lacks or has of another type; null if valid."""
    v = F.try_parse_json(F.col(column))
    found = F.when(v.isNull(), "not JSON")
    for name, kind in required.items():
        got = F.try_variant_get(v, f"$.{name}", "variant")
        type_ = F.schema_of_variant(got)
        absent = got.isNull()
        wrong = (type_ != "VOID") & (type_ != kind.upper()) if name in nullable else type_ != kind.upper()
        found = found.when(absent, f"{name}: missing").when(wrong, f"{name}: wrong type")
    return raw.withColumn("violation", found)


def doc_view(docs: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """The columns of defaults, with a default for null and empty values."""
    return docs.select(*(F.coalesce(F.nullif(F.col(c), F.lit("")) if isinstance(d, str) else F.col(c), F.lit(d)).alias(c) for c, d in defaults.items()))


def review_view(threads: DataFrame) -> DataFrame:
    """A narrow projection of threads, comments numbered."""
    return threads.select("ID", "Text", F.transform("Comments", lambda c, i: F.struct(i.alias("index"), c["Author"].alias("Author"), c["Text"].alias("Text"))).alias("Comments"))


def write_threads(threads: DataFrame, path: str) -> None:
    """One nested record per line, accents kept."""
    threads.write.mode("overwrite").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A10: a record per line, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """A13."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Chosen columns."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


#: Fields of the search store with their types and defaults.
STORE = {
    "id": ("string", ""), "text": ("string", ""), "source": ("string", "unknown"), "author": ("string", ""), "date": ("string", ""), "score": ("int", 0), "title": ("string", ""),
    "type": ("string", "post"), "post_id": ("string", ""), "label": ("string", "neutral"), "subjectivity": ("string", "objective"), "subjectivity_score": ("double", 0.0),
    "aspect_sentiments": ("string", ""), "has_sarcasm": ("boolean", False),
}


def write_search_store(docs: DataFrame, path: str, buckets: int = 64, mapping: dict[str, tuple[str, object]] | None = None, id_: str = "id") -> DataFrame:
    """The search store below path, by a fixed mapping: absent, null, empty and unreadable fields take their defaults, other columns
    (lists, vectors) stay as they are. Rows lie in buckets of their id, in order, so that look-ups read one bucket, and joins of
    stores with as many buckets by id move no rows. Returns the store."""
    mapping = STORE if mapping is None else mapping
    whole = docs.withColumns({c: F.lit(None).cast("string") for c in mapping if c not in docs.columns})
    typed = {c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")).try_cast(kind), F.lit(default).cast(kind)) for c, (kind, default) in mapping.items()}
    rows = whole.select(*(v.alias(c) for c, v in typed.items()), *(c for c in docs.columns if c not in mapping))
    spark = docs.sparkSession
    rows.repartition(buckets, id_).sortWithinPartitions(id_).write.mode("overwrite").bucketBy(buckets, id_).sortBy(id_).option("path", f"{path}/rows").saveAsTable(_store_name(path))
    spark.createDataFrame([(buckets, id_, rows.schema.json())], "buckets int, id string, fields string").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    return spark.table(_store_name(path))


def _store_name(path: str) -> str:
    return "store_" + hashlib.md5(path.encode()).hexdigest()[:16]


def open_search_store(spark: SparkSession, path: str) -> DataFrame:
    """A store that write_search_store wrote, also in another application."""
    if not spark.catalog.tableExists(_store_name(path)):
        r = spark.read.parquet(f"{path}/layout").first()
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(r["fields"])))
        spark.sql(f"CREATE TABLE {_store_name(path)} ({fields}) USING parquet CLUSTERED BY (`{r['id']}`) SORTED BY (`{r['id']}`) INTO {r['buckets']} BUCKETS LOCATION '{path}/rows'")
    return spark.table(_store_name(path))


def save_search_table(docs: DataFrame, path: str, partition: str = "source") -> None:
    """The search store, laid out by source so that source filters prune folders."""
    docs.write.mode("overwrite").partitionBy(partition).parquet(path)


def attach_embeddings(docs: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Vectors by key, never by position; documents without one keep a null."""
    return docs.join(vectors, key, "left")


def annotation_template(df: DataFrame, label_columns: list[str], text: str = "text") -> DataFrame:
    """All columns, empty label columns and text_length."""
    return df.select("*", *(F.lit("").alias(c) for c in label_columns), F.length(text).alias("text_length"))


def manifest(docs: DataFrame, tools: str, label: str, vectors: DataFrame, vector: str = "embedding", k: int = 5) -> DataFrame:
    """One row on a data set: number of documents, length of vectors, column names, the k commonest tools, documents by label."""
    top = docs.select(F.explode(tools).alias("t")).groupBy("t").count().orderBy(F.desc("count"), "t").limit(k)
    names = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "t"))), lambda x: x["t"]).alias("top_tools"))
    labels = docs.groupBy(label).count().agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), "count"))), lambda x: F.concat(x["l"], F.lit("="), x["count"].cast("string"))).alias("labels"))
    size = vectors.agg(F.max(F.size(vector)).alias("dims"))
    one = docs.agg(F.count("*").alias("documents")).select("documents", F.array(*map(F.lit, sorted(docs.columns))).alias("fields"))
    return one.join(size).join(names).join(labels)


def append_snapshot(old: DataFrame, new: DataFrame, key: str, newest: str) -> DataFrame:
    """Rows of both, of each key the newest; on ties the new snapshot's row."""
    both = old.withColumn("side_", F.lit(0)).unionByName(new.withColumn("side_", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(newest), F.desc("side_")))
    return both.withColumn("rn_", last).where("rn_ = 1").drop("rn_", "side_")
