"""Dictionary entities, their sentences and aspects."""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import SPACE, word_count
from ..sources.staging import staged


#: Words, and marks that are no words: code and named emoticons.
ELEMENT = r"<code>|\[[a-z0-9_ ]+\]|[a-z0-9][a-z0-9+#.-]*"
_ELEMENT = re.compile(f"({ELEMENT})")
CUT, REST = "\u0002", "\u0003"


def _once(value: Column, f) -> Column:
    """f(value), with value evaluated once for all its uses in f."""
    return F.transform(F.array(value), f)[0]


def _low(text: Column) -> Column:
    """In lower case, character for character."""
    return F.lower(F.translate(F.coalesce(text.cast("string"), F.lit("")), "İ" + CUT + REST, "   "))


def _is_word(x: Column) -> Column:
    return ~(x.startswith("<") | x.startswith("["))


def _words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(_low(text), F.lit(f"({ELEMENT})"), F.lit(1)), _is_word)


def _grams(words: Column, n: int) -> Column:
    """All runs of n words, joined by a space."""
    runs = words
    for k in range(1, n):
        size = F.greatest(F.size(words) - k, F.lit(0))
        runs = F.zip_with(F.slice(runs, 1, size), F.slice(words, k + 1, size), lambda a, b: F.concat_ws(" ", a, b))
    return runs


def first_words(table: dict[str, str]) -> set[str]:
    """The words with which the phrases of table begin."""
    return {p.partition(" ")[0] for p in table}


def low_text(body: str) -> str:
    """_low of one text."""
    return body.replace("\u0130", " ").replace(CUT, " ").replace(REST, " ").lower()


def spans(low: str, table: dict[str, str], lengths: list[int], first: set[str]) -> list[tuple[int, int, int, str]]:
    """start, end, number of words and label of the phrases of table in a text of lower case: the longest first, then from the left.
    first: first_words(table)."""
    parts = _ELEMENT.split(low)  # gaps and elements in turn
    names, words = parts[1::2], list(accumulate(map(len, parts)))[::2]
    if "<" in low or "[" in low:
        plain = [k for k, w in enumerate(names) if w[0] not in "<["]
        names, words = [names[k] for k in plain], [words[k] for k in plain]
    begins, taken, kept = [i for i, w in enumerate(names) if w in first], bytearray(len(names)), []
    for n in lengths:
        for i in begins:
            label = table.get(names[i] if n == 1 else " ".join(names[i : i + n])) if i + n <= len(names) else None
            if label is not None and not any(taken[i : i + n]):
                taken[i : i + n] = b"\1" * n
                kept.append((words[i], words[i + n - 1] + len(names[i + n - 1]), n, label))
    return kept


def _known(phrases: DataFrame, allowed: list[str] | None) -> DataFrame:
    """The phrases with the least of their labels and n_, their number of words."""
    known = phrases if allowed is None else phrases.where(F.col("label").isin(allowed))
    known = known.where("phrase IS NOT NULL AND label IS NOT NULL").groupBy("phrase").agg(F.min("label").alias("label"))
    return known.withColumn("n_", F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)


def sent_phrases(phrases: DataFrame, longest: int = 3) -> dict[str, str] | None:
    """phrase -> label of a dictionary of up to SENT phrases, for spans; None for a larger one."""
    known = _known(phrases, None).where(F.col("n_") <= longest).select("phrase", "label").limit(SENT + 1).toArrow()
    return None if known.num_rows > SENT else dict(zip(*(known.column(i).to_pylist() for i in (0, 1)), strict=True))


#: Entities that a task hands on at once.
FOUND = 1 << 16
#: A dictionary of up to so many phrases is sent to all tasks; beyond that the engine decides.
SENT = 10_000


def gazetteer(df: DataFrame, id_: str, text: str, phrases: DataFrame, longest: int = 3, allowed: list[str] | None = None) -> DataFrame:
    """phrases(phrase lower case, label), of any size -> id, entity (as in the text), label, start, end (characters from 0), n_tokens:
    longest match first, then from the left, no overlaps. allowed: labels that count. Code marks and [names] are no words.

    Hashes of all runs of words that are as long as some phrase meet the phrases' in a join, map-side for a dictionary of up to SENT
    phrases; texts that have none go no further. Each of the others is read once with the phrases that it has: work in proportion
    to the text. A phrase with several labels has the least. Rows are numbered and staged, so null and repeated ids are texts of
    their own; null texts have no entities."""
    known = staged(_known(phrases, allowed), "phrases")
    sizes = known.where(F.col("n_") <= longest).groupBy("n_").agg(F.count("*").alias("c")).orderBy(F.desc("n_")).collect()  # at most longest rows
    lengths, small = [r["n_"] for r in sizes], sum(r["c"] for r in sizes) <= SENT
    rows = staged(df.select(F.monotonically_increasing_id().alias("row_"), F.col(id_).alias("id_"), F.col(text).cast("string").alias("text_")), "texts")
    none = F.array().cast("array<string>")
    grams = _once(_words(F.col("text_")), lambda w: F.array_distinct(F.concat(none, *(_grams(w, n) for n in lengths))))
    grams = rows.select("row_", F.explode(grams).alias("gram_")).select("row_", F.xxhash64("gram_").alias("hash_"))
    known = known.where(F.col("n_") <= longest).select("phrase", "label", F.xxhash64("phrase").alias("hash_"))
    met = grams.join(F.broadcast(known) if small else known, "hash_").groupBy("row_").agg(F.map_from_entries(F.collect_set(F.struct("phrase", "label"))).alias("table_"))
    held = rows.join(met, "row_").select("id_", "text_", _low(F.col("text_")).alias("low_"), F.map_keys("table_").alias("phrases_"), F.map_values("table_").alias("labels_"))

    def found(batches):
        for batch in batches:
            at, got = [], []
            for i in range(batch.num_rows):
                body, low, names, labels = (batch.column(c)[i].as_py() for c in (1, 2, 3, 4))
                table = dict(zip(names, labels, strict=True))
                new = spans(low, table, lengths, first_words(table))
                at += [i] * len(new)
                got += [(body[start:end], label, start, end, n) for start, end, n, label in new]
                if len(got) >= FOUND or i == batch.num_rows - 1:
                    values = list(zip(*got, strict=True)) or [[]] * 5
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], [id_, "entity", "label", "start", "end", "n_tokens"])
                    at, got = [], []

    kinds = (("entity", StringType()), ("label", StringType()), ("start", IntegerType()), ("end", IntegerType()), ("n_tokens", IntegerType()))
    return held.mapInArrow(found, StructType([StructField(id_, rows.schema["id_"].dataType), *(StructField(n, k) for n, k in kinds)]))


def contextual(text: Column) -> Column:
    """Capitalised words before model, api, extension, plugin (AI_TOOL) or editor (EDITOR): array of structs name, label."""
    found = lambda ends: F.regexp_extract_all(text, F.lit(rf"((?:[A-Z][A-Za-z0-9]+ )+)(?i:{ends})\b"), F.lit(1))
    named = lambda ends, label: F.transform(found(ends), lambda x: F.struct(F.trim(x).alias("name"), F.lit(label).alias("label")))
    return F.concat(named("model|api|extension|plugin", "AI_TOOL"), named("editor", "EDITOR"))


def locate_sentences(text: Column, sentences: Column) -> Column:
    """Start and end (0-based) of each sentence, searched onwards from the last. For a few sentences from elsewhere: the array is copied
    at each step. Sentences of text.sentence_rows and pieces of text.piece_rows come with their places."""
    return F.aggregate(
        sentences, F.array().cast("array<struct<text:string,start:int,end:int>>"),
        lambda done, s: F.concat(done, F.array(_place(text, s, F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0))))),
    )


def _place(text: Column, s: Column, after: Column) -> Column:
    """Where the sentence stands: onwards, else from the beginning, else with its white space collapsed; else empty at 0."""
    short = F.trim(F.regexp_replace(s, SPACE, " "))
    ahead, back, loose = F.position(s, text, after + 1), F.position(s, text, F.lit(1)), F.position(short, text, F.lit(1))
    at = F.when(ahead > 0, ahead).otherwise(F.when(back > 0, back).otherwise(loose))
    found = F.when((ahead > 0) | (back > 0), s).otherwise(F.when(loose > 0, short).otherwise(F.lit("")))
    at = F.greatest(at - 1, F.lit(0))
    return F.struct(found.alias("text"), at.cast("int").alias("start"), (at + F.length(found)).cast("int").alias("end"))


#: Characters of a document whose ends are swept in one window.
BLOCK = 1 << 16


def holding_sentence(entities: DataFrame, sentences: DataFrame, id_: str, block: int = BLOCK) -> DataFrame:
    """entities(id, start, end, ...), sentences(id, sentence, s_start, s_end) -> the entities that a sentence holds, each with the first
    one (least s_start, then s_end): columns sentence, s_start, s_end.

    A sweep from the end of the text: of all sentences that end at an entity's end or later the one that begins first is its
    sentence if it begins at the entity's start or before; if it does not, none does. So sentence and entity ends are put in
    one order and the first sentence so far is carried along, within blocks of places, and over blocks by their minima. Work
    and rows follow the number of entities and sentences, whatever their nesting. Null ids match nothing."""
    rest = [c for c in entities.columns if c != id_]
    kind = dict(sentences.dtypes)
    struct = f"struct<s_start:{kind['s_start']},s_end:{kind['s_end']},sentence:{kind['sentence']}>"
    ends = sentences.where(F.col(id_).isNotNull()).select(id_, F.col("s_end").cast("long").alias("at_"), F.struct("s_start", "s_end", "sentence").cast(struct).alias("s_"), F.lit(None).cast(entities.select(F.struct(*rest)).schema[0].dataType).alias("e_"))
    events = ends.unionByName(entities.where(F.col(id_).isNotNull()).select(id_, F.col("end").cast("long").alias("at_"), F.lit(None).cast(struct).alias("s_"), F.struct(*rest).alias("e_")))
    events = events.withColumn("block_", F.floor(F.col("at_") / block))
    sweep = Window.partitionBy(id_, "block_").orderBy(F.col("at_").desc(), F.col("e_").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("own_", F.min("s_").over(sweep)).where(F.col("e_").isNotNull()).select(id_, "block_", "e_", "own_")
    later = Window.partitionBy(id_).orderBy(F.col("block_").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = events.groupBy(id_, "block_").agg(F.min("s_").alias("m_")).select(id_, "block_", F.min("m_").over(later).alias("later_"))
    first = swept.join(blocks, [id_, "block_"]).select(id_, "e_.*", F.least("own_", "later_").alias("s_"))
    return first.where("s_.s_start <= start").select(id_, *rest, "s_.sentence", "s_.s_start", "s_.s_end")


def entity_sentence(entities: DataFrame, sentences: DataFrame, id_: str) -> DataFrame:
    """entities(id, entity, start, end), sentences(id, sentence, s_start, s_end) -> the first sentence that holds each entity."""
    both = holding_sentence(entities.select(id_, "entity", "start", "end"), sentences, id_)
    return both.groupBy(id_, "entity", "start").agg(F.min_by("sentence", "s_start").alias("sentence"))


ASPECT_TYPES = ("AI_TOOL", "EDITOR", "PL", "ORG", "TECH_CONCEPT", "PRODUCT")


def placed_aspects(entities: DataFrame, sentences: DataFrame, id_: str, types: tuple[str, ...] | None = ASPECT_TYPES) -> DataFrame:
    """extract_aspects with the place of the sentence: id, s_start, aspect, type, sentence, n_words. types None: all of them."""
    wanted = F.lit(True) if types is None else F.col("label").isin(list(types))
    first = holding_sentence(entities.where(wanted).select(id_, "entity", "label", "start", "end"), sentences, id_)
    once = first.groupBy(id_, F.lower("entity").alias("low_"), "s_start").agg(F.min(F.struct("start", F.col("entity").alias("aspect"), F.col("label").alias("type"), "sentence")).alias("r"))
    return once.select(id_, "s_start", "r.aspect", "r.type", "r.sentence", word_count(F.col("r.sentence")).alias("n_words"))


def extract_aspects(entities: DataFrame, sentences: DataFrame, id_: str, types: tuple[str, ...] = ASPECT_TYPES) -> DataFrame:
    """entities(id, entity, label, start, end), sentences(id, sentence, s_start, s_end) of subjective texts -> id, aspect, type,
    sentence, n_words: entities of the given types with the first sentence that holds them, each once a sentence whatever its
    case (the first as it stands)."""
    return placed_aspects(entities, sentences, id_, types).drop("s_start")


def ai_tools(names: Column) -> Column:
    """Names in lower case, once each, of the entities labelled AI_TOOL in array<struct<name, label>>."""
    return distinct_ci(F.transform(F.filter(names, lambda x: x["label"] == "AI_TOOL"), lambda x: x["name"]))


def distinct_ci(names: Column) -> Column:
    """Values of more than one character, each case-insensitive value once, lower case."""
    return F.array_distinct(F.transform(F.filter(names, lambda x: F.length(F.trim(x)) > 1), lambda x: F.lower(F.trim(x))))


def aspect_string(aspects: Column) -> Column:
    """'aspect: polarity; ...' of array<struct<aspect, polarity>>."""
    return F.array_join(F.transform(aspects, lambda a: F.concat(a["aspect"], F.lit(": "), a["polarity"])), "; ")
