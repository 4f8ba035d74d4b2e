"""All stages of annotation as one plan: text, sentences, entities, subjectivity, aspects, sarcasm, polarity."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import ABBREVIATIONS, normalize_text, placed_sentences, sentence_cut, sentence_rows, tokens, word_count
from ..sources.staging import packed
from . import entities
from .models import Model, route_polarity, route_subjectivity, with_verdicts
from .scoring import FIRST_PERSON, HEDGES, INTENSIFIERS, TOKEN, apply_sarcasm, document_polarity, fuse_polarity, lexicon_subjectivity, polarity_confidence, polarity_label, route_by_length, sarcasm, sent_lexicon, squashed, subjectivity_band, with_lexicon, word_scores


def annotate(df: DataFrame, id_: str, text: str, lexicon: DataFrame, negations: list[str], strong: list[str] = (), weak: list[str] = ()) -> DataFrame:
    """Normalised text, valence, subjectivity, polarity and route of every row by the lexicon rules; texts in the middle band and
    long ones are marked for the caller's model (models.py). lexicon(word, polarity). Rows are numbered and staged first, so rows
    without an id and repeated ids come out one by one."""
    d = packed(df.select(F.monotonically_increasing_id().alias("row_"), id_, normalize_text(F.col(text)).alias("normalized")), "normalized")
    t = tokens(F.col("normalized"))
    flag = lambda ws: F.arrays_overlap(t, F.array(*map(F.lit, ws)))
    count = lambda ws: F.size(F.filter(t, lambda w: w.isin(list(ws)))) if ws else F.lit(0)
    d = with_lexicon(d, "row_", "normalized", lexicon, negations)
    score = lexicon_subjectivity(F.col("valence"), flag(FIRST_PERSON), F.exists(t, lambda w: w.endswith("ly")), flag(HEDGES), flag(INTENSIFIERS), count(strong), count(weak), F.contains(F.col("normalized"), F.lit("!")))
    d = d.withColumn("subjectivity_score", score)
    return d.select(id_, "normalized", "valence", "subjectivity_score", subjectivity_band(F.col("subjectivity_score")).alias("subjectivity"), fuse_polarity(F.col("valence"), F.col("polarity")).alias("polarity_score"), polarity_label(fuse_polarity(F.col("valence"), F.col("polarity"))).alias("polarity"), route_by_length(word_count(F.col("normalized"))).alias("route"))


@dataclass(frozen=True)
class PipelineConfig:
    """Switches, lists, models and plug-ins of annotate_corpus."""

    slang: dict[str, str] = field(default_factory=dict)
    emoticons: dict[str, str] = field(default_factory=dict)
    keep: tuple[str, ...] = ()
    abbreviations: tuple[str, ...] = ABBREVIATIONS
    negations: tuple[str, ...] = ("not", "no", "never")
    neutral: tuple[str, ...] = ()
    tech_words: tuple[str, ...] = ("buggy", "slow", "fast", "useful", "useless", "intuitive")
    strong: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    lower: float = 0.20
    upper: float = 0.75
    aspects: bool = True
    #: Classifiers by task: subjectivity (labels subjective, objective), polarity (positive, negative, neutral), sarcasm (sarcastic, plain).
    models: dict[str, Model] = field(default_factory=dict)
    #: Column plug-ins by stage (after 'normalize', say): texts -> texts, run once per distinct text.
    plugins: dict[str, Callable[[], Callable]] = field(default_factory=dict)


#: Characters that a tagger gets at once: its results, an object for every word, are many times as large.
TAGGED = 1 << 18


def bounded(texts: list[str], size: int, characters: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most so many texts and characters; a longer text is a range of its own."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        if i > at and (i - at >= size or n + len(t) > characters):
            yield at, i
            at, n = i, 0
        n += len(t)
    if at < len(texts):
        yield at, len(texts)


def tag_distinct(df: DataFrame, column: str, make: Callable[[], Callable], kind: str, name: str, only: Column | None = None, batch: int = 256) -> DataFrame:
    """Adds name: what a caller's function makes of the distinct values of a text column, of any type (kind, in DDL: an array of structs
    for tags and lemmas, say). make() gives list[str] -> list of values once per task; every value is given to it once, in batches,
    and put back by its sha256. A task holds what is made of one batch (at most TAGGED characters, or one text) and no more. Rows
    outside only (a condition on the source, say) and nulls get null."""

    def run(batches):
        f = make()
        for pdf in batches:
            keys, values = pdf["key_"].tolist(), pdf["value_"].tolist()
            for at, to in bounded(values, batch, TAGGED):
                yield pd.DataFrame({"key_": keys[at:to], "made_": list(f(values[at:to]))})

    wanted = F.col(column).isNotNull() if only is None else F.col(column).isNotNull() & F.coalesce(only, F.lit(False))
    asked = df.withColumn("asked_", F.when(wanted, F.sha2(F.col(column), 256)))
    values = asked.where(F.col("asked_").isNotNull()).groupBy(F.col("asked_").alias("key_")).agg(F.any_value(column).alias("value_"))
    made = packed(values.mapInPandas(run, f"key_ string, made_ {kind}"), "tags")
    return asked.join(made, F.col("asked_") == F.col("key_"), "left").select(*df.columns, F.col("made_").alias(name))


def apply_distinct(df: DataFrame, column: str, make: Callable[[], Callable], only: Column | None = None) -> DataFrame:
    """A caller's function over the distinct values of a text column, in batches, put back by value; rows outside only keep theirs.
    make() gives list[str] -> list[str] once per task: spell correction."""
    tagged = tag_distinct(df, column, make, "string", "replaced_", only)
    wanted = F.col(column).isNotNull() if only is None else F.col(column).isNotNull() & F.coalesce(only, F.lit(False))
    return tagged.withColumn(column, F.when(wanted, F.col("replaced_")).otherwise(F.col(column))).drop("replaced_")


def _scored_sentences(rows: DataFrame, lexicon: DataFrame, c: PipelineConfig) -> DataFrame:
    """rows(key_, sentence, ...) with lexicon_score, p (polarity, 0 to 1) and n_words."""
    t = tokens(F.col("sentence"))
    flag = lambda t, ws: F.arrays_overlap(t, F.array(*map(F.lit, ws))) if ws else F.lit(False)
    count = lambda t, ws: F.size(F.filter(t, lambda w: w.isin(list(ws)))) if ws else F.lit(0)
    scored = with_lexicon(rows, "key_", "sentence", lexicon, list(c.negations), neutral=c.neutral)
    adverb = F.lower(F.coalesce("sentence", F.lit(""))).rlike("ly(?![a-z0-9])")
    # The words are made once for all cues that look at them.
    cues = F.transform(F.array(t), lambda t: lexicon_subjectivity(F.col("valence"), flag(t, FIRST_PERSON), adverb, flag(t, HEDGES), flag(t, INTENSIFIERS), count(t, c.strong), count(t, c.weak), F.contains(F.col("sentence"), F.lit("!")), flag(t, c.tech_words) & flag(t, FIRST_PERSON), F.col("sentence").rlike(r"\[[a-z_ ]+\]")))[0]
    return scored.select(*rows.columns, cues.alias("lexicon_score"), fuse_polarity(F.col("valence"), F.col("polarity")).alias("p"), word_count(F.col("sentence")).alias("n_words"))


#: What is known of a sentence when it is read; the flags are the cues of lexicon_subjectivity.
_READ = "s_start int, sentence string, n_words int, s_ double, polarity double, first boolean, adverb boolean, hedge boolean, intensifier boolean, strong int, weak int, exclaims boolean, tech boolean, emoticon boolean, found array<string>"
_ADVERB, _EMOTICON = re.compile("ly(?![a-z0-9])"), re.compile(r"\[[a-z_ ]+\]")
#: Sentences that a task hands on at once.
SENTENCES = 1 << 13


def _read_once(docs: DataFrame, lexicon: dict[str, list[float]], phrases: dict[str, str], c: PipelineConfig) -> DataFrame:
    """docs(row_, context_, normalized) -> a row for each sentence: row_, context_, s_start, sentence, lexicon_score, p (polarity, 0 to 1),
    n_words and found, the entities that it holds, in order; and one with s_start null for the entities of a text that none holds.

    Lexicon and dictionary are sent to the texts, each of which is read once, where it lies: nothing is moved."""
    sent = docs.sparkSession.sparkContext.broadcast((lexicon, phrases))
    turns, skipped, tech_words, strong, weak = set(c.negations), set(c.neutral), set(c.tech_words), set(c.strong), set(c.weak)
    first_person, hedges, intensifiers = set(FIRST_PERSON), set(HEDGES), set(INTENSIFIERS)
    every = first_person | hedges | intensifiers | tech_words | strong | weak

    def sentence_row(sentence: str, start: int, found: list[str], known: dict[str, list[float]]) -> tuple:
        low = sentence.lower()
        words = TOKEN.findall(low)
        hits = every.intersection(words)
        some = lambda ws: bool(hits) and not ws.isdisjoint(hits)
        count = lambda ws: sum(w in ws for w in words) if some(ws) else 0
        first = some(first_person)
        adverb, emoticon = "ly" in low and _ADVERB.search(low) is not None, "[" in sentence and _EMOTICON.search(sentence) is not None
        cues = (first, adverb, some(hedges), some(intensifiers), count(strong), count(weak), "!" in sentence, first and some(tech_words), emoticon)
        return (start, sentence, sentence.count(" ") + 1, *word_scores(words, known, turns, skipped), *cues, found)

    def rows(parts: list[str], body: str, known: dict, table: dict, lengths: list[int], first: set[str]) -> Iterator[tuple]:
        places = sorted((start, end) for start, end, _, _ in entities.spans(entities.low_text(body), table, lengths, first))
        at, loose = 0, []
        for sentence, start, end in placed_sentences(parts):
            held = []
            while at < len(places) and places[at][1] <= end:
                (held if places[at][0] >= start else loose).append(body[slice(*places[at])])
                at += 1
            yield sentence_row(sentence, start, held, known)
        loose += [body[start:end] for start, end in places[at:]]
        if loose:
            yield (*[None] * 14, loose)

    def run(batches):
        known, table = sent.value
        lengths, first = sorted({p.count(" ") + 1 for p in table}, reverse=True), entities.first_words(table)
        for batch in batches:
            owner, got = [], []
            for i, (body, parts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                for row in rows(parts, body or "", known, table, lengths, first):
                    owner.append(i), got.append(row)
                    if len(got) >= SENTENCES:
                        yield made(batch, owner, got)
                        owner, got = [], []
            if got:
                yield made(batch, owner, got)

    kinds = StructType.fromDDL(_READ)

    def made(batch, owner, got):
        at = pa.array(owner, pa.int64())
        columns = [pa.array(v, t) for v, t in zip(zip(*got, strict=True), to_arrow_schema(kinds).types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], ["row_", "context_", *kinds.names])

    cut = docs.select("row_", "context_", "normalized", sentence_cut(F.col("normalized"), c.abbreviations).alias("cut_"))
    read = cut.mapInArrow(run, StructType([*cut.schema.fields[:2], *kinds])).withColumn("valence", squashed(F.col("s_")))
    score = lexicon_subjectivity(*map(F.col, ("valence", "first", "adverb", "hedge", "intensifier", "strong", "weak", "exclaims", "tech", "emoticon")))
    return read.select("row_", "context_", "s_start", "sentence", score.alias("lexicon_score"), fuse_polarity(F.col("valence"), F.col("polarity")).alias("p"), "n_words", "found")


def _read_apart(docs: DataFrame, lexicon: DataFrame, phrases: DataFrame, c: PipelineConfig) -> DataFrame:
    """_read_once with a lexicon or a dictionary of any size, which words and sentences meet in joins."""
    rows = sentence_rows(docs, "row_", F.col("normalized"), c.abbreviations).withColumnsRenamed({"start": "s_start", "end": "s_end"})
    rows = packed(rows.withColumn("key_", F.concat_ws("|", "row_", "n")), "sentences")
    entity = packed(entities.gazetteer(docs, "row_", "normalized", phrases).select("row_", "entity", "start", "end"), "entities")
    held = entities.holding_sentence(entity, rows.select("row_", "s_start", "s_end", F.lit("").alias("sentence")), "row_")
    held = held.groupBy("row_", "s_start").agg(F.array_sort(F.collect_list(F.struct("start", "entity")))["entity"].alias("found"))
    scored = _scored_sentences(rows, lexicon, c).join(held, ["row_", "s_start"], "left").join(docs.select("row_", "context_"), "row_")
    none = F.array().cast("array<string>")
    scored = scored.select("row_", "context_", "s_start", "sentence", "lexicon_score", "p", "n_words", F.coalesce("found", none).alias("found"))
    return scored.unionByName(entity.groupBy("row_").agg(F.collect_set("entity").alias("found")), allowMissingColumns=True)


def annotate_corpus(df: DataFrame, id_: str, text: str, lexicon: DataFrame, phrases: DataFrame, config: PipelineConfig | None = None, context: str | None = None) -> DataFrame:
    """All stages as one plan: normalised text, sentences, entities, subjectivity of every sentence, its aspects, polarity: id,
    normalized, n_sentences, entities, aspects, subjectivity, polarity, route; with models also n_by_model, document_score,
    aspect_sentiments and n_failed.

    lexicon(word, polarity), phrases(phrase, label). A document is subjective if the blend of mean and maximum of its sentences is;
    others have no aspects. Without models, sentences between the bounds count with their lexicon score, polarity is the mean of the
    sentences by their words, and objective documents are neutral. With them (config.models):
    - subjectivity: sentences between the bounds go to it, short ones after their context (a column of df: the parent's text);
    - sarcasm: sentences of aspects, after 200 characters of the context, 600 in all;
    - polarity: sentences of aspects from 60 words on, and every document's whole text, those of more than 400 words in chunks. A sure
      sarcastic aspect counts turned, and a neutral document gives way to a clear mean of its aspects.
    Every model sees each distinct input once. n_failed counts inputs that got a model's default. Rows are numbered and staged, so
    rows without an id and repeated ids are annotated one by one; null texts are empty, objective and neutral.

    Texts are staged once and read once where they lie, with a lexicon of up to scoring.SENT entries and a dictionary of up to
    entities.SENT phrases. Sentences are staged if a model may be asked about them; only inputs of models move as texts, and verdicts
    come back by key."""
    c = config or PipelineConfig()
    ahead = F.col(context) if context is not None else F.lit(None).cast("string")
    docs = df.select(F.monotonically_increasing_id().alias("row_"), id_, normalize_text(F.col(text), c.slang, c.emoticons, c.keep).alias("normalized"), F.substring(ahead, 1, 200).alias("context_"))
    if "normalize" in c.plugins:
        docs = apply_distinct(packed(docs, "normalized"), "normalized", c.plugins["normalize"])
    docs = packed(docs.withColumn("words_", word_count(F.col("normalized"))), "normalized")
    known, table = sent_lexicon(lexicon), entities.sent_phrases(phrases)
    read = _read_apart(docs, lexicon, phrases, c) if known is None or table is None else _read_once(docs, known, table, c)
    asked = (subjectivity_band(F.col("lexicon_score"), c.lower, c.upper) == "model") if "subjectivity" in c.models else F.lit(False)
    needed = F.coalesce(asked, F.lit(False)) | (F.size("found") > 0) if c.models and c.aspects else asked
    scored = packed(read.select("row_", F.when(needed, F.col("context_")).alias("context_"), "s_start", F.when(needed, F.col("sentence")).alias("sentence"), "lexicon_score", "p", "n_words", asked.alias("asked"), "found"), "scored")
    sentences = scored.where("s_start IS NOT NULL")
    judged = sentences.where("NOT asked").select("row_", "p", "n_words", F.col("lexicon_score").alias("score"), F.lit(False).alias("by_model"), F.lit(False).alias("failed"))
    if "subjectivity" in c.models:
        routed = route_subjectivity(sentences.where("asked"), "sentence", "lexicon_score", c.models["subjectivity"], "context_", c.lower, c.upper)
        judged = judged.unionByName(routed.select("row_", "p", "n_words", "score", F.lit(True).alias("by_model"), "failed"))
    by_doc = judged.groupBy("row_").agg(
        F.count("*").alias("n_sentences"), (0.4 * F.avg("score") + 0.6 * F.max("score")).alias("blend"), (F.sum(F.col("p") * F.col("n_words")) / F.nullif(F.sum("n_words"), F.lit(0))).alias("p"),
        F.sum("n_words").alias("n"), F.count_if("by_model").alias("n_by_model"), F.count_if("failed").alias("n_failed"),
    )
    by_doc = packed(by_doc.withColumn("subjective_", F.coalesce(F.col("blend") >= 0.42, F.lit(False))), "subjectivity")
    names = scored.select("row_", F.explode("found").alias("entity")).groupBy("row_").agg(F.array_sort(F.collect_set(F.lower("entity"))).alias("entities"))
    out = docs.drop("context_", "words_").join(names, "row_", "left").join(by_doc, "row_", "left").withColumn("subjective_", F.coalesce("subjective_", F.lit(False)))
    aspects = None
    if c.aspects:
        held = sentences.where(F.size("found") > 0).select("row_", "context_", "s_start", "sentence", "p", "n_words", "found")
        aspects = held.join(by_doc.where("subjective_").select("row_"), "row_", "left_semi").withColumn("aspect", F.explode(_first_of_each("found"))).drop("found")
        aspects = packed(aspects if c.models else aspects.select("row_", "aspect"), "aspects")
        out = out.join(aspects.groupBy("row_").agg(F.array_sort(F.collect_set(F.lower("aspect"))).alias("aspects")), "row_", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"entities": F.coalesce("entities", none), "aspects": F.coalesce("aspects", none) if c.aspects else none, "n_sentences": F.coalesce("n_sentences", F.lit(0)).cast("int")})
    first = [id_, "normalized", "n_sentences", "entities", "aspects", F.when(F.col("subjective_"), "subjective").otherwise("objective").alias("subjectivity")]
    if not c.models:
        return out.select(*first, F.when(F.col("subjective_"), polarity_label(F.col("p"))).otherwise("neutral").alias("polarity"), route_by_length(F.coalesce("n", F.lit(0))).alias("route"))
    said, whole = _aspect_sentiments(docs, aspects, c)
    out = out.join(said, "row_", "left").join(whole, "row_", "left")
    own = polarity_label(F.col("p")) if "polarity" not in c.models else document_polarity(F.coalesce("label", F.lit("neutral")), F.col("aspect_mean"))
    polarity = own if "polarity" in c.models else F.when(F.col("subjective_"), own).otherwise("neutral")
    route = F.coalesce("route", F.lit("none")) if "polarity" in c.models else route_by_length(F.coalesce("n", F.lit(0)))
    total = lambda *names: sum(F.coalesce(n, F.lit(0)) for n in names)
    return out.select(
        *first, polarity.alias("polarity"), route.alias("route"), F.coalesce("n_by_model", F.lit(0)).alias("n_by_model"), F.col("document_score"),
        F.coalesce("aspect_sentiments", F.array().cast(_SENTIMENTS)).alias("aspect_sentiments"), total("n_failed", "aspects_failed", "document_failed").alias("n_failed"),
    )


def _first_of_each(names: str) -> Column:
    """The first spelling of each name in an array, whatever its case."""
    low = F.transform(names, F.lower)
    return F.transform(F.array_distinct(low), lambda x: F.element_at(names, F.array_position(low, x).cast("int")))


_SENTIMENTS = "array<struct<aspect:string,route:string,polarity:string,score:double,sarcastic:boolean,sarcasm_confidence:double>>"
#: Sentences of fewer words are judged by the lexicon.
SHORT = 60


def _aspect_sentiments(docs: DataFrame, aspects: DataFrame | None, c: PipelineConfig) -> tuple[DataFrame, DataFrame]:
    """Per row: aspect_sentiments, aspect_mean and aspects_failed; and label, document_score, route and document_failed of the whole text.
    Texts stay behind: only sentences of SHORT words or more go on to the model of polarity."""
    kinds = "item_ string, row_ long, aspect string, text_ string, words_ int, p double, sarcastic boolean, sarcasm_confidence double, fails_ long"
    items = docs.sparkSession.createDataFrame([], kinds)
    if aspects is not None:
        ahead = F.when(F.coalesce("context_", F.lit("")) != "", F.concat("context_", F.lit(" | "))).otherwise("")
        item = F.concat_ws("|", F.col("row_"), F.col("s_start"), F.lower("aspect")).alias("item_")
        long = F.when(F.col("n_words") >= SHORT, F.col("sentence")).alias("text_")
        asked = aspects.select(item, "row_", "aspect", long, F.col("n_words").alias("words_"), "p", F.concat(ahead, "sentence").alias("input_"))
        if "sarcasm" in c.models:
            asked = with_verdicts(asked, c.models["sarcasm"], "input_", "v_")
            verdict = sarcasm(F.col("v_.label"), F.col("v_.confidence"), F.col("v_").isNull())
            asked = asked.select("*", verdict["sarcastic"].alias("sarcastic"), verdict["confidence"].alias("sarcasm_confidence"), F.col("v_.failed").cast("long").alias("fails_"))
        else:
            asked = asked.select("*", F.lit(False).alias("sarcastic"), F.lit(0.0).alias("sarcasm_confidence"), F.lit(0).cast("long").alias("fails_"))
        items = packed(asked.select(*items.columns), "items")
    by_lexicon = lambda df: df.select("*", F.lit("lexicon").alias("route"), polarity_label(F.col("p")).alias("label"), F.lit(0).cast("long").alias("n_failed"))
    if "polarity" in c.models:
        whole = docs.where("normalized <> ''").select(F.col("row_").cast("string").alias("item_"), "row_", F.col("normalized").alias("text_"), "words_")
        both = items.where(F.col("words_") >= SHORT).unionByName(whole, allowMissingColumns=True).withColumn("whole", F.col("words_").isNotNull() & F.col("aspect").isNull())
        floor, short = F.when(F.col("whole"), 0.25).otherwise(0.50), F.when(F.col("whole"), 0).otherwise(SHORT)
        got = route_polarity(both, "item_", "text_", "words_", "p", c.models["polarity"], floor, short)
        brief = by_lexicon(items.where(F.col("words_") < SHORT)).withColumn("whole", F.lit(False))
        brief = brief.withColumn("score", F.when(F.col("label") == "positive", polarity_confidence(F.col("p"))).when(F.col("label") == "negative", -polarity_confidence(F.col("p"))).otherwise(0.0))
        names = ["row_", "whole", "aspect", "sarcastic", "sarcasm_confidence", "fails_", "route", "label", "score", "n_failed"]
        got = got.select(*names).unionByName(brief.select(*names))
    else:
        got = by_lexicon(items).select("*", F.lit(False).alias("whole"), F.when(F.col("label") == "neutral", 0.0).otherwise(2 * F.col("p") - 1).alias("score"))
    final = apply_sarcasm(F.col("score"), F.coalesce("sarcastic", F.lit(False)), F.coalesce("sarcasm_confidence", F.lit(0.0)))
    polarity = F.when(final > 0, "positive").when(final < 0, "negative").otherwise("neutral")
    one = F.struct("aspect", "route", polarity.alias("polarity"), final.alias("score"), "sarcastic", "sarcasm_confidence")
    got = packed(got.select("row_", "whole", "label", "score", "route", "n_failed", "fails_", final.alias("final_"), F.when(~F.col("whole"), one).alias("one_")), "sentiments")
    said = got.where("NOT whole").groupBy("row_").agg(F.array_sort(F.collect_list("one_")).cast(_SENTIMENTS).alias("aspect_sentiments"), F.avg("final_").alias("aspect_mean"), F.sum(F.col("n_failed") + F.col("fails_")).alias("aspects_failed"))
    return said, got.where("whole").select("row_", "label", F.col("score").alias("document_score"), "route", F.col("n_failed").alias("document_failed"))
