"""Lexicon scores and the rules that fuse them with those of models."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import lexicons
from ..functions.text import WORD, tokens


TOKEN = re.compile("[a-z0-9]+")


def _one_of(words: set[str]) -> str:
    """A pattern for any of the words, by common beginnings, so that a place in a text is tried against one branch only."""
    tails: dict[str, set[str]] = {}
    for w in words:
        if w:
            tails.setdefault(w[0], set()).add(w[1:])
    branches = [re.escape(c) + (_one_of(t) if t != {""} else "") for c, t in sorted(tails.items())]
    return f"(?:{'|'.join(branches)}){'?' if '' in words else ''}"


def _listed(patterns: list[str]) -> str | None:
    """One pattern for all words of patterns that are lists of whole words, None if some are not; a listed word with an apostrophe
    counts by its part that is listed, or else by itself."""
    lists = [re.fullmatch(r"\\b\(([a-z'|]+)\)\\b", p) for p in patterns]
    if not all(lists):
        return None
    words = {w for m in lists for w in m[1].split("|")}
    plain = {w for w in words if "'" not in w}
    return _one_of(plain | {w for w in words - plain if plain.isdisjoint(w.split("'"))})


def _matches(low: Column, patterns: list[str]) -> Column:
    """Matches of all patterns in a text of lower case. Patterns that are lists of whole words are looked for in one pass by one pattern."""
    pattern = _listed(patterns)
    if pattern is None:
        return sum(F.regexp_count(low, F.lit(p)) for p in patterns)
    return F.regexp_count(low, F.lit(rf"(?<![a-z0-9_]){pattern}(?![a-z0-9_])"))


def _opinion(total: Column, n: Column) -> Column:
    return F.round(F.when(n > 0, F.least(total / n * 100 / 100, F.lit(1.0))).otherwise(0.0), 3)


def opinion_score(text: Column, patterns: list[str] = lexicons.OPINION_PATTERNS) -> Column:
    """Matches of the patterns per 100 words, at most 1; 0 without words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return _opinion(_matches(low, patterns), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)))


def with_opinion(df: DataFrame, text: str, name: str = "opinion", patterns: list[str] = lexicons.OPINION_PATTERNS) -> DataFrame:
    """Adds opinion_score of a text column. Lists of whole words are counted in Arrow batches, by an automaton in one pass over the text;
    other patterns as opinion_score does."""
    pattern = _listed(patterns)
    if pattern is None:
        return df.withColumn(name, opinion_score(F.col(text), patterns))

    def f(batches):
        for batch in batches:
            low, whole = batch.column(batch.num_columns - 1), batch.column(batch.schema.get_field_index(text))
            counts = [pc.count_substring_regex(x, p).cast(pa.int64()) for x, p in ((low, rf"\b{pattern}\b"), (whole, WORD))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pc.fill_null(c, 0) for c in counts)], [*batch.schema.names[:-1], "hits_", "words_"])

    schema = StructType([*df.schema.fields, StructField("hits_", LongType()), StructField("words_", LongType())])
    counted = df.withColumn("low_", F.lower(F.coalesce(text, F.lit("")))).mapInArrow(f, schema)
    return counted.select(*df.columns, _opinion(F.col("hits_"), F.col("words_")).alias(name))


def relevance_score(text: Column, terms: dict[str, list[str]] = lexicons.RELEVANCE_TERMS) -> Column:
    """0.6 x share of categories hit + 0.4 x min(terms hit / 5, 1)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = {c: sum(F.contains(low, F.lit(w)).cast("int") for w in ws) for c, ws in terms.items()}
    some = sum((h > 0).cast("int") for h in hits.values())
    return F.round(0.6 * some / len(terms) + 0.4 * F.least(sum(hits.values()) / 5, F.lit(1.0)), 3)


def matched_categories(text: Column, terms: dict[str, list[str]]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda ws: F.coalesce(low.rlike("|".join(map(re.escape, ws))), F.lit(False))
    return F.array_compact(F.array(*(F.when(hit(ws), F.lit(c)) for c, ws in terms.items())))


def topic_tags(text: Column, terms: dict[str, list[str]] = lexicons.TOPIC_TERMS) -> Column:
    return matched_categories(text, terms)


def opinion_level(score: Column) -> Column:
    return F.when(score >= 0.3, "high").when(score >= 0.1, "medium").otherwise("low")


def lookup_mean(df: DataFrame, id_: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Mean polarity of the tokens found in lexicon(word, polarity); null if none."""
    hits = df.select(id_, F.explode(tokens(F.col(text))).alias("word")).join(lexicon, "word").groupBy(id_).agg(F.avg("polarity").alias("polarity"))
    return df.select(id_).join(hits, id_, "left")


def valence(df: DataFrame, id_: str, text: str, lexicon: DataFrame, negations: list[str], window: int = 3, neutral: tuple[str, ...] = ()) -> DataFrame:
    """Sum of token valences, turned by -0.74 if a negation stands among the window tokens before, as s / sqrt(s^2 + 15). Words in
    neutral (those of the domain) count 0 whatever the lexicon says."""
    lexicon = lexicon.where(~F.col("word").isin(list(neutral))) if neutral else lexicon
    negation = F.array(*map(F.lit, negations))

    def placed(w: Column, at: Column) -> Column:
        before = F.slice(F.col("t"), F.greatest(at - window + 1, F.lit(1)), F.least(at, F.lit(window)))
        return F.struct(w.alias("word"), F.arrays_overlap(before, negation).alias("negated"))

    # Most texts have no negation, and their words need no look at those before them.
    plain = lambda w: F.struct(w.alias("word"), F.lit(False).alias("negated"))
    t = df.select(id_, tokens(F.col(text)).alias("t"))
    each = F.when(F.arrays_overlap("t", negation), F.transform("t", placed)).otherwise(F.transform("t", plain))
    t = t.select(id_, F.inline(each)).join(lexicon, "word")
    turned = F.when(F.col("negated"), -0.74 * F.col("polarity")).otherwise(F.col("polarity"))
    s = t.groupBy(id_).agg(F.sum(turned).alias("s"))
    return df.select(id_).join(s, id_, "left").select(id_, F.coalesce(F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15), F.lit(0.0)).alias("valence"))


#: A lexicon of up to so many entries is sent to all tasks.
SENT = 100_000


def sent_lexicon(lexicon: DataFrame) -> dict[str, list[float]] | None:
    """The polarities of each word of a lexicon of up to SENT entries; None for a larger one."""
    some = lexicon.select("word", F.col("polarity").cast("double").alias("polarity")).where("word IS NOT NULL AND polarity IS NOT NULL")
    known = some.limit(SENT + 1).toArrow()
    if known.num_rows > SENT:
        return None
    table: dict[str, list[float]] = {}
    for w, x in zip(known.column(0).to_pylist(), known.column(1).to_pylist(), strict=True):
        table.setdefault(w, []).append(x)
    return table


def word_scores(words: list[str], known: dict[str, list[float]], turns: set[str], skipped: set[str], window: int = 3) -> tuple[float | None, float | None]:
    """Sum of turned valences (of words that are not skipped) and mean polarity of a text's words; None where it has none."""
    found = [(i, w) for i, w in enumerate(words) if w in known]
    if not found:
        return None, None
    means, plain = [x for _, w in found for x in known[w]], turns.isdisjoint(words)
    turned = [x if plain or turns.isdisjoint(words[max(0, i - window) : i]) else -0.74 * x for i, w in found if w not in skipped for x in known[w]]
    return (sum(turned) if turned else None), sum(means) / len(means)


def squashed(s: Column) -> Column:
    """A sum of valences as s / sqrt(s^2 + 15); 0 if there is none."""
    return F.coalesce(s / F.sqrt(s * s + 15), F.lit(0.0))


def with_lexicon(df: DataFrame, id_: str, text: str, lexicon: DataFrame, negations: list[str], window: int = 3, neutral: tuple[str, ...] = ()) -> DataFrame:
    """Adds valence and polarity (lookup_mean) of a text to each row. A lexicon of up to SENT entries is sent to the rows, which are
    read once and not moved; for a larger one words meet it in joins, by id_, which must be unique then."""
    table = sent_lexicon(lexicon)
    if table is None:
        return df.join(valence(df, id_, text, lexicon, negations, window, neutral), id_).join(lookup_mean(df, id_, text, lexicon), id_)
    sent, turns, skipped = df.sparkSession.sparkContext.broadcast(table), set(negations), set(neutral)

    def f(batches):
        known = sent.value
        for batch in batches:
            got = [word_scores(TOKEN.findall(t), known, turns, skipped, window) for t in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array([g[i] for g in got], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "s_", "polarity"])

    schema = StructType([*df.schema.fields, StructField("s_", DoubleType()), StructField("polarity", DoubleType())])
    scored = df.withColumn("low_", F.lower(F.coalesce(text, F.lit("")))).mapInArrow(f, schema)
    return scored.select(*df.columns, squashed(F.col("s_")).alias("valence"), "polarity")


def lexicon_subjectivity(valence_: Column, first_person: Column, adverb: Column, hedge: Column, intensifier: Column, strong: Column, weak: Column, exclaims: Column, tech: Column | None = None, emoticon: Column | None = None) -> Column:
    """Clamped sum of cues; the flags are boolean, strong and weak counts. tech: an opinion on technology; emoticon: one in brackets."""
    flag = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    s = F.abs(valence_) + flag(first_person, 0.12) + flag(adverb, 0.08) + flag(hedge, 0.06) + flag(intensifier, 0.05) + F.least(0.08 * strong + 0.04 * weak, F.lit(0.15)) + flag(exclaims, 0.03)
    s = s + (flag(tech, 0.10) if tech is not None else F.lit(0.0)) + (flag(emoticon, 0.04) if emoticon is not None else F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def subjectivity_band(score: Column, lower: float = 0.20, upper: float = 0.75) -> Column:
    return F.when(score >= upper, "subjective").when(score <= lower, "objective").otherwise("model")


def blend_model_score(lexicon: Column, model: Column) -> Column:
    return 0.4 * lexicon + 0.6 * model


def model_subjectivity(blend: Column, model_label: Column, confidence: Column, personal: Column, stance: Column, least: float = 0.5, sure: float = 0.6) -> Column:
    """Subjective from least on; a sentence that the model calls objective with less than sure confidence turns subjective if it is in
    the first person and has stance words."""
    flips = (model_label == "objective") & (confidence < sure) & personal & stance
    return F.when(flips | (blend >= least), "subjective").otherwise("objective")


def fuse_polarity(valence_: Column, polarity: Column) -> Column:
    """Score in 0..1 of valence and lexicon polarity, valence alone where the lexicon has no word."""
    v = (valence_ + 1) / 2
    return F.when(polarity.isNull(), v).otherwise(0.55 * v + 0.45 * (polarity + 1) / 2)


def polarity_confidence(score: Column) -> Column:
    """How far a score of 0 to 1 is from the middle, as 0 to 1."""
    return 2 * F.abs(score - 0.5)


def polarity_label(score: Column, hi: float = 0.65, lo: float = 0.35) -> Column:
    return F.when(score >= hi, "positive").when(score <= lo, "negative").otherwise("neutral")


def route_by_length(n: Column, short: int = 60, long: int = 400) -> Column:
    return F.when(n < short, "lexicon").when(n > long, "chunks").otherwise("model")


def confidence_floor(label: Column, confidence: Column, floor: float) -> Column:
    """Signed score: positive needs 0.85 of the floor, negative the floor, else 0."""
    return F.when((label == "positive") & (confidence >= 0.85 * floor), confidence).when((label == "negative") & (confidence >= floor), -confidence).otherwise(0.0)


def apply_sarcasm(score: Column, sarcastic: Column, confidence: Column, least: float = 0.99) -> Column:
    return F.when(sarcastic & (confidence > least), -score).otherwise(score)


def document_polarity(model_label: Column, aspect_mean: Column, least: float = 0.25) -> Column:
    """The model's label; a neutral one gives way to a clear mean of the aspects."""
    return F.when(model_label != "neutral", model_label).when(aspect_mean >= least, "positive").when(aspect_mean <= -least, "negative").otherwise("neutral")


def sarcasm(label: Column, confidence: Column, bypassed: Column) -> Column:
    """P(sarcastic) whatever label the model gave: its confidence, or one less it; a row that the model did not see has 0 and is not
    sarcastic. A struct of sarcastic and confidence."""
    p = F.when(label == "sarcastic", confidence).otherwise(1 - confidence)
    seen = ~F.coalesce(bypassed, F.lit(False)) & label.isNotNull()
    return F.struct(F.when(seen, p > 0.5).otherwise(False).alias("sarcastic"), F.when(seen, p).otherwise(0.0).alias("confidence"))


def has_sarcasm(aspects: Column) -> Column:
    """Two sarcastic aspects of confidence 0.85, or one of 0.95. aspects: array<struct<sarcastic, confidence>>."""
    return (F.size(F.filter(aspects, lambda a: a["sarcastic"] & (a["confidence"] >= 0.85))) >= 2) | F.exists(aspects, lambda a: a["sarcastic"] & (a["confidence"] >= 0.95))


# Cue words of subjectivity.
FIRST_PERSON = "i me my mine we us our ours myself".split()
HEDGES = "maybe perhaps probably possibly seems might guess".split()
INTENSIFIERS = "very really extremely totally absolutely quite".split()
