"""A caller's classifiers in the plan: which rows need one is decided first, and every distinct input is classified once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import WORD, word_count
from ..sources.staging import packed
from .scoring import blend_model_score, confidence_floor, polarity_confidence, polarity_label, subjectivity_band


@dataclass(frozen=True)
class Model:
    """make() gives, once per task, a function list[str] -> list of (label, confidence). labels maps its labels to ours (others stay);
    a batch in which it raises gets default (ours) and is marked as failed. Inputs are cut to cap characters."""

    make: Callable[[], Callable[[list[str]], list[tuple[str, float]]]]
    labels: dict[str, str] = field(default_factory=dict)
    default: tuple[str, float] = ("neutral", 1.0)
    cap: int = 1500
    batch: int = 32


def in_batches(values: list, size: int) -> Iterator[list]:
    for at in range(0, len(values), size):
        yield values[at : at + size]


def _key(seen: Column) -> Column:
    return F.unhex(F.sha2(seen, 256))


def classify(inputs: DataFrame, model: Model, column: str = "input") -> DataFrame:
    """The distinct non-null values of a column, classified once and staged: key (the bytes of its sha256, as the model sees it), label,
    confidence, failed. Later steps join it; a lost executor does not call the model again for what is staged."""

    def run(batches):
        call = model.make()
        for pdf in batches:
            out = []
            for some in in_batches(pdf["input"].tolist(), model.batch):
                try:
                    got = [(model.labels.get(l, l), float(c), False) for l, c in call(some)]
                    if len(got) != len(some):
                        raise ValueError("as many results as inputs")
                except Exception:  # noqa: BLE001  the caller's model; the rows say so
                    got = [(*model.default, True)] * len(some)
                out += got
            yield pd.DataFrame({"key": pdf["key"]} | {c: [x[i] for x in out] for i, c in enumerate(("label", "confidence", "failed"))})

    seen = F.substring(F.col(column), 1, model.cap)
    asked = inputs.where(F.col(column).isNotNull()).select(_key(seen).alias("key"), seen.alias("input")).groupBy("key").agg(F.any_value("input").alias("input"))
    return packed(asked.mapInPandas(run, "key binary, label string, confidence double, failed boolean"), "verdicts")


def with_verdicts(rows: DataFrame, model: Model, column: str = "input", name: str = "verdict") -> DataFrame:
    """Adds name, a struct of label, confidence and failed: what the model says of the column; null where the input is null."""
    verdicts = classify(rows, model, column).select(F.col("key").alias("verdict_key_"), F.struct("label", "confidence", "failed").alias(name))
    keyed = rows.withColumn("asked_key_", _key(F.substring(F.col(column), 1, model.cap)))
    return keyed.join(verdicts, F.col("asked_key_") == F.col("verdict_key_"), "left").drop("asked_key_", "verdict_key_")


def without_marks(text: Column) -> Column:
    """A text as classifiers get it: no code marks and [names]."""
    held = F.contains(text, F.lit("[")) | F.contains(text, F.lit("<CODE>"))
    return F.trim(F.when(held, F.regexp_replace(text, r"<CODE>|\[[^\]]+\]", "")).otherwise(text))


def route_subjectivity(rows: DataFrame, sentence: str, lexicon: str, model: Model | None, context: str | None = None, lower: float = 0.20, upper: float = 0.75) -> DataFrame:
    """Adds band (subjective, objective, model), method (lexicon, model), score and failed to rows of sentences with a lexicon score.

    Sentences between the bounds go to the model and no others; their score is 0.4 of the lexicon's and 0.6 of the probability that
    the model calls them subjective (labels subjective, objective). Sentences of up to ten words are put after 200 characters
    of their context, if there is one; a sentence of marks only is asked as '.'. Blank sentences are objective, score 0. Without a model
    the lexicon's score stands."""
    blank = F.coalesce(F.trim(F.col(sentence)), F.lit("")) == ""
    rows = rows.withColumn("band", F.when(blank, "objective").otherwise(subjectivity_band(F.col(lexicon), lower, upper)))
    score = F.when(blank, F.lit(0.0)).otherwise(F.col(lexicon))
    if model is None:
        return rows.select("*", F.lit("lexicon").alias("method"), score.alias("score"), F.lit(False).alias("failed"))
    plain = F.coalesce(F.nullif(without_marks(F.col(sentence)), F.lit("")), F.lit("."))
    if context is not None:
        ahead = F.coalesce(F.substring(F.col(context), 1, 200), F.lit(""))
        plain = F.when((ahead != "") & (word_count(plain) <= 10), F.concat(ahead, F.lit(" | "), plain)).otherwise(plain)
    # What follows from the sentence is made before the verdicts are met, so that the sentence need not move to them.
    asked = with_verdicts(rows.withColumns({"input_": F.when(F.col("band") == "model", plain), "own_": score}), model, "input_", "verdict_")
    v = F.col("verdict_")
    p = F.when(v["label"] == "subjective", v["confidence"]).otherwise(1 - v["confidence"])
    by_model = F.col("band") == "model"
    return asked.select(*rows.columns, F.when(by_model, "model").otherwise("lexicon").alias("method"), F.when(by_model, blend_model_score(F.col(lexicon), p)).otherwise(F.col("own_")).alias("score"), F.coalesce(v["failed"], F.lit(False)).alias("failed"))


#: Inputs that a task hands on at once.
INPUTS = 1 << 12
_WORD = re.compile(WORD)


def _inputs(given: DataFrame, size: int, overlap: int, cap: int) -> DataFrame:
    """given(asked_row_, floor_, cut_, clean_) -> asked_row_, floor_, input_, weight_: the text or, with cut_, its chunk_words, each cut
    to cap characters, and their number of words before."""

    def pieces(clean: str, cut: bool) -> Iterator[tuple[str, int]]:
        words = _WORD.findall(clean)
        if not cut:
            yield from [(clean, len(words))] if clean else []
        elif words:
            for i in range(max(0, -((size - len(words)) // (size - overlap))) + 1):
                some = words[i * (size - overlap) : i * (size - overlap) + size]
                yield " ".join(some), len(some)

    def run(batches):
        for batch in batches:
            owner, got, weights = [], [], []
            for i, (cut, clean) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                for x, n in pieces(clean, cut):
                    owner.append(i), got.append(x[:cap]), weights.append(n)
                    if len(got) >= INPUTS:
                        yield made(batch, owner, got, weights)
                        owner, got, weights = [], [], []
            yield made(batch, owner, got, weights)

    def made(batch, owner, got, weights):
        at = pa.array(owner, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(got, pa.string()), pa.array(weights, pa.int32())], ["asked_row_", "floor_", "input_", "weight_"])

    kinds = [StructField("input_", StringType()), StructField("weight_", IntegerType())]
    return given.mapInArrow(run, StructType([*given.schema.fields[:2], *kinds]))


def route_polarity(rows: DataFrame, row: str, text: str, words: str, lexicon: str, model: Model, floor: Column | float = 0.5, short: Column | int = 60, long: int = 400, size: int = 300, overlap: int = 50, clear: float = 0.20) -> DataFrame:
    """Adds route, n_inputs, mean (of the model's signed scores), label, score (-1 to 1) and n_failed to rows(row, text, words, lexicon): row unique, words the number the
    route goes by, lexicon a score of 0 to 1 (null if the row never takes that route).

    lexicon: fewer than short words; the label at 0.65 and 0.35, the score its distance from the middle. model: one input. chunks: more
    than long words; overlapping chunks of size words, the mean of their signed scores by their number of words, the label at clear.
    The model's confidence counts as in confidence_floor. A text of marks only is neutral and no input. All inputs of all
    rows and routes are classified together, each distinct one once; chunks of one text are summed up before they meet."""
    n, s = F.col(words), F.col(lexicon)
    short = F.lit(short) if isinstance(short, int) else short
    floor = F.lit(float(floor)) if isinstance(floor, (int, float)) else floor
    rows = rows.withColumn("route", F.when(n < short, "lexicon").when(n > long, "chunks").otherwise("model"))
    clean = without_marks(F.coalesce(F.col(text), F.lit("")))
    given = rows.where("route <> 'lexicon'").select(F.col(row).alias("asked_row_"), floor.cast("double").alias("floor_"), (F.col("route") == "chunks").alias("cut_"), clean.alias("clean_"))
    asked = with_verdicts(_inputs(given, size, overlap, model.cap), model, "input_", "v_")
    v = F.col("v_")
    signed = asked.select("asked_row_", "weight_", confidence_floor(v["label"], v["confidence"], F.col("floor_")).alias("signed_"), v["failed"].cast("long").alias("failed_"))
    met = signed.groupBy("asked_row_").agg((F.sum(F.col("signed_") * F.col("weight_")) / F.sum("weight_")).alias("asked_mean_"), F.count("*").alias("asked_inputs_"), F.sum("failed_").alias("asked_fails_"))
    both = rows.join(met, F.col(row) == F.col("asked_row_"), "left")
    mean, from_lexicon = F.coalesce("asked_mean_", F.lit(0.0)), polarity_label(s)
    bound = F.when(F.col("route") == "chunks", F.lit(clear)).otherwise(F.lit(1e-300))
    label = F.when(F.col("route") == "lexicon", from_lexicon).when(mean >= bound, "positive").when(mean <= -bound, "negative").otherwise("neutral")
    confidence = F.when(F.col("route") == "lexicon", polarity_confidence(s)).otherwise(F.abs(mean))
    score = F.when(F.col("label") == "positive", F.col("asked_c_")).when(F.col("label") == "negative", -F.col("asked_c_")).otherwise(0.0)
    out = both.withColumn("label", label).withColumn("asked_c_", confidence)
    return out.select(*rows.columns, F.coalesce("asked_inputs_", F.lit(0)).cast("long").alias("n_inputs"), F.when(F.col("route") != "lexicon", mean).alias("mean"), "label", score.alias("score"), F.coalesce("asked_fails_", F.lit(0)).cast("long").alias("n_failed"))


def score_with_model(df: DataFrame, text: str, make_model: Callable[[], Callable], default: float = 0.0, cap: int = 1500, name: str = "model_score", batch: int = 1000) -> DataFrame:
    """Scores distinct inputs in batches and joins them back. make_model() gives list[str] -> list[float] once per task; a batch in which
    it raises gets the default, and <name>_failed says so. A null text is an empty one."""
    scorer = Model(lambda: (lambda call: lambda texts: [("", x) for x in call(texts)])(make_model()), default=("", default), cap=cap, batch=batch)
    out = with_verdicts(df.withColumn("input_", F.coalesce(text, F.lit(""))), scorer, "input_", "v_")
    return out.select(*df.columns, F.col("v_.confidence").alias(name), F.col("v_.failed").alias(f"{name}_failed"))
