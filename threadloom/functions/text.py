"""Text functions as Column expressions. Character classes are ASCII unless stated."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
URL = r"https?://[^\x20\x09-\x0D]+"


def _once(value: Column, f) -> Column:
    """f(value), with value evaluated once for all its uses in f."""
    return F.transform(F.array(value), f)[0]


def _holds(text: Column, some: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(k)) for k in some))


#: What a text with more white space than single spaces contains.
WIDE = ("  ", *"\t\n\v\f\r")


def _replaced(text: Column, needs: tuple[str, ...], *steps: tuple[str, str]) -> Column:
    """The texts that contain one of needs with all steps (pattern, replacement) applied; others, in which no step finds anything, as they are."""
    return _once(text, lambda t: F.when(_holds(t, needs), reduce(lambda x, step: F.regexp_replace(x, *step), steps, t)).otherwise(t))


def words(text: Column) -> Column:
    """Whitespace-separated words; none for null and blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of words; from that of spaces where there are single ones only."""
    plain = lambda t: F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)
    return _once(F.trim(F.coalesce(text, F.lit(""))), lambda t: F.when(_holds(t, WIDE), F.size(words(t))).otherwise(plain(t)))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(_replaced(F.coalesce(text, F.lit("")), WIDE, (SPACE, " ")))


def any_of(terms: list[str]) -> str:
    """Case-insensitive alternation of literal terms, longest first."""
    return "(?i)(" + "|".join(re.escape(t).replace(r"\ ", " ").replace(r"\-", "-").replace(r"\'", "'") for t in sorted(terms, key=lambda t: (-len(t), t))) + ")"


def protect_code(text: Column) -> Column:
    """Fenced blocks and inline code become one placeholder."""
    return _replaced(text, ("`", "~~"), (r"(?s)```.*?```|~~~.*?~~~", " XCODEX "), (r"`[^`\n]+`", " XCODEX "))


def restore_code(text: Column) -> Column:
    return _replaced(text, ("XCODEX",), (r"XCODEX(?:\s+XCODEX)*", "<CODE>"))


def strip_markdown(text: Column) -> Column:
    for needs, pattern, to in ((("**", "__"), r"(\*\*|__)(.+?)\1", "$2"), ("*", r"\*([^*\n]+)\*", "$1"), (("~~",), r"~~(.+?)~~", "$1"), ("#", r"(?m)^#{1,6}[ \t]+", ""), (">", r"(?m)^>[ \t]?", ""), ("-*+", r"(?m)^[ \t]*[-*+][ \t]+", ""), ((". ", ".\t"), r"(?m)^[ \t]*\d+\.[ \t]+", ""), ("-*_", r"(?m)^(?:[-*_][ \t]*){3,}$", "")):
        text = _replaced(text, tuple(needs), (pattern, to))
    return text


def unescape(text: Column) -> Column:
    """The named character references of HTML's reserved characters, the ampersand last. unescape_all knows all references."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _named_references() -> str:
    """HTML's named character references with their semicolon, as JSON."""
    from html.entities import html5

    return json.dumps({name: char for name, char in html5.items() if name.endswith(";")})


def unescape_all(text: Column) -> Column:
    """All character references, once: the named ones of HTML (with semicolon), decimal and hexadecimal ones. Numbers 128 to 159 are
    read as Windows-1252, as browsers do; zero, surrogates and numbers beyond Unicode give U+FFFD, other control characters nothing.
    Names that HTML does not have stay."""
    mark = "\u0001"
    refs = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)"
    names = F.from_json(F.lit(_named_references()), "map<string,string>")
    old = F.from_json(F.lit(json.dumps({str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)})), "map<string,string>")

    def char(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^&#[xX]?0*([0-9a-fA-F]*)", 1)
        n = F.when(F.length(digits) > 7, F.lit(0)).when(p.rlike("^&#[xX]"), F.conv(digits, 16, 10).cast("int")).otherwise(F.conv(digits, 10, 10).cast("int"))
        n = F.coalesce(n, F.lit(0))
        none = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        control = n.between(1, 8) | (n == 11) | n.between(14, 31) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(none, F.lit("�")).when(n.between(128, 159), old[n.cast("string")]).when(control, F.lit("")).otherwise(plain)

    def made(t: Column) -> Column:
        pieces = F.split(F.regexp_replace(F.translate(t, mark, " "), f"({refs})", f"{mark}$1{mark}"), mark)
        return F.transform(pieces, lambda p: F.when(p.rlike("^&#"), F.when(p.rlike(f"^(?:{refs})$"), char(p)).otherwise(p)).when(p.rlike("^&[A-Za-z][A-Za-z0-9]*;$"), F.coalesce(names[F.substring(p, 2, 100)], p)).otherwise(p))

    return _once(text, lambda t: F.when(F.contains(t, F.lit("&")), F.when(t.rlike(refs), F.array_join(made(t), "")).otherwise(F.translate(t, mark, " "))).otherwise(t))


def clean_html_text(text: Column) -> Column:
    """Unescape, strip tags, mark URLs, collapse white space."""
    return collapse(F.regexp_replace(F.regexp_replace(unescape(text), r"<[^>]+>", " "), URL, "[URL]"))


def structural_clean(text: Column) -> Column:
    """Drop URLs, decode character references, strip tags, keep paragraph breaks."""
    text = _replaced(unescape_all(_replaced(text, ("http",), (URL, " "))), ("<",), (r"<[^>]+>", " "))
    return F.trim(_replaced(_replaced(text, ("  ", "\t"), (r"[ \t]+", " ")), ("\n\n\n",), (r"\n{3,}", "\n\n")))


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("@[A-Za-z0-9_]+"), F.lit(0))


def hashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("#[A-Za-z0-9_]+"), F.lit(0))


def split_camel(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[A-Z](?<=[a-z0-9][A-Z])", " $0"), "([A-Z]+)([A-Z][a-z])", "$1 $2")


def squeeze_elongated(text: Column) -> Column:
    """Three or more of a character in a row become two."""
    return F.regexp_replace(text, r"(.)\1{2,}", "$1$1")


def replace_tokens(text: Column, table: dict[str, str], keep: tuple[str, ...] = ()) -> Column:
    """Whitespace tokens found in table, apart from trailing punctuation and case, are replaced; those in keep are not."""
    if not table:
        return collapse(text)
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))

    def one(w: Column) -> Column:
        stem, tail = F.regexp_extract(w, r"^(.*?)([.,!?;:]*)$", 1), F.regexp_extract(w, r"^(.*?)([.,!?;:]*)$", 2)
        known = F.when(~F.lower(stem).isin(*keep) if keep else F.lit(True), pairs[F.lower(stem)])
        return F.when(w.startswith("XPROTX"), w).otherwise(F.coalesce(F.concat(known, tail), w))

    # Most texts hold none of the table: one pattern tells, and their words are not looked at one by one.
    some = rf"(?:^|[\x20\x09-\x0D])(?:{'|'.join(re.escape(k) for k in sorted(table, key=len, reverse=True))})[.,!?;:]*(?:[\x20\x09-\x0D]|\z)"
    return _once(text, lambda t: F.when(F.lower(t).rlike(some), F.array_join(F.transform(words(t), one), " ")).otherwise(collapse(t)))


def replace_emoticons(text: Column, table: dict[str, str]) -> Column:
    """Whitespace-bounded emoticons become [description]."""
    pairs = F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, f"[{v}]")))
    held = lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(k)) for k in table))
    return _once(text, lambda t: F.when(held(t), F.array_join(F.transform(words(t), lambda w: F.coalesce(pairs[w], w)), " ")).otherwise(collapse(t)))


def normalize_text(text: Column, slang: dict[str, str] | None = None, emoticons: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> Column:
    """The normalisation stages in order: code, markdown, structure, mentions, hashtags, emoticons, elongation, slang, code back."""
    text = structural_clean(strip_markdown(protect_code(F.coalesce(text, F.lit("")))))
    text = _replaced(text, ("@",), ("@[A-Za-z0-9_]+", " "))
    text = split_camel(_replaced(text, ("#",), ("#([A-Za-z0-9_]+)", "$1")))
    if emoticons:
        text = replace_emoticons(text, emoticons)
    text = replace_tokens(squeeze_elongated(text), slang or {}, keep)
    return restore_code(text)


# Abbreviations that end no sentence.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "vs", "etc", "e.g", "i.e", "cf", "approx", "fig", "no", "vol", "ver", "v")


GUARD, CUT, REST = "\u0001", "\u0002", "\u0003"
_BEGINS = r"""[\p{Lu}\d<\["']"""
#: White space after which a sentence begins: one of at least two words, as a fragment of one word joins the sentence before it.
SENTENCE_GAP = rf"(?<=[.!?])\s+(?={_BEGINS})(?!\S+(?:\s*\z|(?<=[.!?])\s+{_BEGINS}))"


def _abbreviated(abbreviations: tuple[str, ...]) -> tuple[str, str]:
    """Pattern and replacement for the dots after abbreviations: looked for from the dot, unless an abbreviation may end within another,
    as then the match of the first hides the other."""
    words = "|".join(re.escape(a) for a in abbreviations)
    inner = {p for a in abbreviations for p in re.split(r"\W+", a.lower())[:-1]}
    if inner & {re.split(r"\W+", a.lower())[-1] for a in abbreviations}:
        return rf"(?i)\b({words})\.", f"$1{GUARD}"
    return rf"(?i)\.(?<=\b(?:{words})\.)", GUARD


def _guarded(text: Column, abbreviations: tuple[str, ...]) -> Column:
    """Dots that end no sentence as GUARD, one for one: after abbreviations and in ellipses. Those within versions and domains have no
    white space after them, so no sentence ends there anyway."""
    return _replaced(F.regexp_replace(text, *_abbreviated(abbreviations)), ("...",), (r"\.{3}", GUARD * 3))


def split_sentences(text: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """Sentences end at . ! or ? before white space and an upper-case letter, digit or bracket, but not within code marks, versions,
    domains, ellipses or after abbreviations; a fragment of one word joins the sentence before it. Time in proportion to the text."""
    pieces = F.filter(F.split(_guarded(collapse(text), abbreviations), SENTENCE_GAP), lambda s: s != "")
    return F.transform(pieces, lambda s: F.replace(s, F.lit(GUARD), F.lit(".")))


#: Pieces that a task hands on at once.
PIECES = 1 << 15


def _cut(text: Column, gap: str) -> Column:
    """The text cut before each match of gap, which REST ends: an array that placed reads."""
    clean = F.translate(F.coalesce(text, F.lit("")), CUT + REST, "  ")
    return F.split(F.regexp_replace(clean, f"({gap})", f"{CUT}$1{REST}"), CUT)


def placed(parts: list[str]) -> Iterator[tuple[str, int, int]]:
    """piece, start and end of each part of a text that _cut has cut."""
    at = 0
    for k, part in enumerate(parts):
        before, _, piece = part.partition(REST) if k else ("", "", part)
        at += len(before)
        yield piece, at, at + len(piece)
        at += len(piece)


_BLANKS = "\t\n\v\f\r "


def sentence_cut(text: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """The text cut into sentences: an array that placed_sentences reads."""
    return _cut(_guarded(F.translate(F.coalesce(text, F.lit("")), GUARD, " "), abbreviations), SENTENCE_GAP)


def placed_sentences(parts: list[str]) -> Iterator[tuple[str, int, int]]:
    """sentence, start and end: sentence_rows of one text that sentence_cut has cut."""
    for piece, start, end in placed(parts):
        body = piece.strip(_BLANKS)
        if body:
            start += len(piece) - len(piece.lstrip(_BLANKS))
            wide = "  " in body or not body.isprintable()
            yield (re.sub(SPACE, " ", body) if wide else body).replace(GUARD, "."), start, start + len(body)


def piece_rows(df: DataFrame, row: str, text: Column, gap: str) -> DataFrame:
    """The text of each row cut at all matches of gap: row, n (0, 1, ...), piece, start, end (characters from 0; the gaps are between
    pieces). Places are running sums of lengths within the row: no shuffle, and time in proportion to the text. U+0001 to U+0003 in a text count as spaces; a null text is empty: one empty piece."""

    def run(batches):
        for batch in batches:
            owner, n, pieces, starts, ends = [], [], [], [], []
            for i, parts in enumerate(batch.column(1).to_pylist()):
                for k, (piece, start, end) in enumerate(placed(parts)):
                    owner.append(i), n.append(k), pieces.append(piece), starts.append(start), ends.append(end)
                    if len(pieces) >= PIECES:
                        yield made(batch, owner, n, pieces, starts, ends)
                        owner, n, pieces, starts, ends = [], [], [], [], []
            yield made(batch, owner, n, pieces, starts, ends)

    def made(batch, owner, n, pieces, starts, ends):
        columns = [pa.array(n, pa.int32()), pa.array(pieces, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], [row, "n", "piece", "start", "end"])

    kind = df.schema[row].dataType.simpleString()
    return df.select(row, _cut(text, gap).alias("cut_")).mapInArrow(run, f"`{row}` {kind}, n int, piece string, start int, end int")


def sentence_rows(df: DataFrame, row: str, text: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> DataFrame:
    """split_sentences as rows with their places: row, n, sentence, start, end. The places are those in the text as it is; the
    sentence has its white space collapsed."""
    clean = F.translate(F.coalesce(text, F.lit("")), GUARD, " ")
    rows = piece_rows(df, row, _guarded(clean, abbreviations), SENTENCE_GAP)
    body = F.regexp_replace(F.regexp_replace("piece", f"^{SPACE}", ""), f"{SPACE}\\z", "")
    lead = F.length("piece") - F.length(F.regexp_replace("piece", f"^{SPACE}", ""))
    rows = rows.select(row, "n", F.replace(collapse(body), F.lit(GUARD), F.lit(".")).alias("sentence"), (F.col("start") + lead).alias("start"), F.length(body).alias("size_"))
    return rows.where("sentence <> ''").select(row, "n", "sentence", "start", (F.col("start") + F.col("size_")).alias("end"))


def pick_text(source: Column, text: Column, title: Column, titled: tuple[str, ...] = ("hackernews",)) -> Column:
    """Title instead of an empty text for sources that have such records: a struct of text and text_source ('text' or 'title')."""
    swap = F.lower(source).isin(*titled) & (F.coalesce(F.trim(text), F.lit("")) == "") & (F.coalesce(F.trim(title), F.lit("")) != "")
    return F.struct(F.when(swap, title).otherwise(F.coalesce(text, F.lit(""))).alias("text"), F.when(swap, "title").otherwise("text").alias("text_source"))


#: Ranges of emoji: symbols and pictographs, emoticons, transport, dingbats, flags.
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F1E6}-\\x{1F1FF}]"


def emoji_names() -> dict[str, str]:
    """Names of all emoji in EMOJI, by Unicode, in lower case with underscores."""
    import unicodedata

    places = [*range(0x1F300, 0x1FB00), *range(0x2600, 0x27C0), *range(0x1F1E6, 0x1F200)]
    return {chr(c): name.lower().replace(" ", "_").replace("-", "_") for c in places if (name := unicodedata.name(chr(c), ""))}


def demojize(text: Column, table: dict[str, str] | None = None) -> Column:
    """Emoji anywhere in the text become [name]; those that the table (default: emoji_names) lacks stay."""
    names = emoji_names() if table is None else table
    pairs = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    # Put apart by a mark, each emoji is a piece of its own.
    pieces = F.split(F.regexp_replace(text, f"({EMOJI})", "\u0001$1\u0001"), "\u0001")
    named = F.transform(pieces, lambda p: F.when(F.length(p) == 1, F.coalesce(F.concat(F.lit("["), pairs[p], F.lit("]")), p)).otherwise(p))
    return F.when(text.rlike(EMOJI), F.array_join(named, "")).otherwise(text)


SPECIAL = r"<CODE>|\[[A-Za-z0-9_ ]+\]"


def protect_special(text: Column) -> Column:
    """Code marks and [names] as placeholders: a struct of text, in which each is XSPECIALX, and found, what they were, in order."""
    return F.struct(F.regexp_replace(text, SPECIAL, "XSPECIALX").alias("text"), F.regexp_extract_all(text, F.lit(f"({SPECIAL})"), F.lit(1)).alias("found"))


def restore_special(text: Column, found: Column) -> Column:
    """The text with its placeholders put back in order."""
    parts = F.split(text, "XSPECIALX", -1)
    return F.array_join(F.zip_with(parts, found, lambda p, f: F.concat(F.coalesce(p, F.lit("")), F.coalesce(f, F.lit("")))), "")


def content_tokens(text: Column, function_words: list[str]) -> Column:
    """Words that are no function words; code marks and [names] stay whole."""
    found = F.regexp_extract_all(text, F.lit(f"({SPECIAL}|[A-Za-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda w: ~F.lower(w).isin(function_words))


def clean_tokens(text: Column, stop: list[str]) -> Column:
    """Lower case, no URLs or punctuation, no stop words, longer than two characters unless non-ASCII; joined by spaces."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), URL, " "), r"[!-/:-@\[-`{-~]", " ")
    return F.array_join(F.filter(words(text), lambda w: ~w.isin(stop) & ((F.length(w) > 2) | w.rlike("[^\\x00-\\x7F]"))), " ")


def clean_for_index(text: Column, limit: int = 5000) -> Column:
    return F.substring(F.translate(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit(" ")), "\u0000", ""), 1, limit)


def truncate_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def text_hash(text: Column) -> Column:
    return F.sha1(F.lower(F.trim(F.coalesce(text, F.lit("")))))


def chunk_words(text: Column, size: int = 300, overlap: int = 50) -> Column:
    """Overlapping chunks of words; the last is the first that reaches the end."""

    def chunks(w: Column) -> Column:
        n = F.greatest(F.ceil((F.size(w) - size) / F.lit(size - overlap)), F.lit(0)).cast("int")
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(w, i * (size - overlap) + 1, size), " ")))

    return _once(words(text), chunks)


def stop_word_language(text: Column, profiles: dict[str, list[str]]) -> Column:
    """Language with the most stop words in the text, ties by name; null if it has none."""
    t = words(F.lower(text))

    def hits(stop: list[str]) -> Column:
        return F.size(F.filter(t, lambda w: w.isin(stop)))

    best = F.array_max(F.array(*(F.struct(hits(stop).alias("n"), F.lit(lang).alias("lang")) for lang, stop in sorted(profiles.items()))))
    return F.when(best["n"] > 0, best["lang"])
