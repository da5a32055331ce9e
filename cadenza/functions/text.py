"""Words: timestamped text, normalisation, sentence ends, transcripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that end a sentence, and words before a full stop that do not.
SENTENCE_END = ".?!…؟。！？"
ABBREVIATIONS = [
    "dr", "prof", "assoc", "mr", "mrs", "ms", "no", "bil", "hj", "hjh", "en", "pn", "tn",
    "tuan", "puan", "dato", "datuk", "datin", "tan", "sri", "ir", "ustaz", "ustazah",
    "yb", "yab", "ybhg", "st", "jln", "kg", "vs", "etc", "e.g", "i.e", "a.m", "p.m",
]
STAMP = r"<\|(\d+(?:\.\d+)?)\|>"
BLANK = " \t\n\x0b\f\r"
WORD_TYPE = "array<struct<word:string,start:double,end:double>>"


def sentence_end(word: Column) -> Column:
    """Does this word end a sentence: a final mark, not after an initial or an abbreviation."""
    token = F.trim(word)
    core = F.trim(F.regexp_replace(token, f"[{SENTENCE_END}]+$", ""))
    bare = F.regexp_replace(F.lower(core), r"^\.+|\.+$", "")
    letters = F.length(F.replace(core, F.lit("."), F.lit("")))
    # most words end in no mark, and only the others need the patterns
    return F.when(F.substring(token, -1, 1).isin(list(SENTENCE_END)), (letters > 1) & ~bare.isin(ABBREVIATIONS)).otherwise(F.lit(False))


def parse_timestamped(text: Column) -> Column:
    """Words of ``<|start|> text<|end|>`` strings, in text order; blank and dangling parts are dropped."""
    return F.transform(timestamped(text), said)


def timestamped(text: Column) -> Column:
    """``parse_timestamped`` as strings (s, w, e), which ``said`` makes words of, also after an explode, where that is compiled.

    Each mark closes one word and opens the next, so the text between two marks is a word if it is not blank.
    """
    whole = F.struct(F.regexp_extract_all(text, F.lit(STAMP), F.lit(1)).alias("stamps"), F.split(text, STAMP, -1).alias("parts"))

    def zipped(x):
        inner = F.greatest(F.size(x["stamps"]) - 1, F.lit(0))
        return F.arrays_zip(F.slice(x["stamps"], F.lit(1), inner).alias("s"), F.slice(x["parts"], F.lit(2), inner).alias("w"), F.slice(x["stamps"], F.lit(2), inner).alias("e"))

    once = F.element_at(F.transform(F.array(whole), zipped), 1)  # else the patterns would be matched at each use
    return F.filter(once, lambda r: F.btrim(r["w"], F.lit(BLANK)) != "")


def said(r: Column) -> Column:
    start, end = (r[x].cast("double") for x in ("s", "e"))
    return F.struct(F.btrim(r["w"], F.lit(BLANK)).alias("word"), start.alias("start"), F.greatest(start, end).alias("end"))


def escaped(word: Column) -> Column:
    r"""A word in which nothing reads as a stamp: a backslash more after each < that only backslashes part from a |."""
    return F.when(F.contains(word, F.lit("<")), F.regexp_replace(word, r"<(\\*)\|", r"<\\$1|")).otherwise(word)


def unescaped(word: Column) -> Column:
    """What ``escaped`` was given."""
    return F.when(F.contains(word, F.lit("<")), F.regexp_replace(word, r"<\\(\\*)\|", r"<$1|")).otherwise(word)


def normalized(items: Column, names: tuple[str, ...] = ("word", "text", "token")) -> Column:
    """Clean words from structs of strings: first alias present, castable times, no blanks, end >= start, by time.

    A struct cannot tell a missing key from a null one: the first alias that is not null counts.
    """

    def clean(x):
        word = F.trim(F.coalesce(*(x[n] for n in names)))
        start, end = (x[n].try_cast("double") for n in ("start", "end"))
        return F.struct(start.alias("start"), F.greatest(start, end).alias("end"), word.alias("word"), (start.isNull() | end.isNull() | F.isnan(start) | F.isnan(end) | word.isNull() | (word == "")).alias("bad"))

    good = F.filter(F.transform(F.filter(items, lambda x: x.isNotNull()), clean), lambda x: ~x["bad"])
    ordered = F.array_sort(F.transform(good, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), i.alias("i"), x["word"].alias("word"))))
    return F.transform(ordered, lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end")))


def rezeroed(words: Column) -> Column:
    """Times counted from the first word's start."""
    return F.transform(words, lambda w: F.struct(w["word"].alias("word"), (w["start"] - words[0]["start"]).alias("start"), (w["end"] - words[0]["start"]).alias("end")))


def transcript(words: Column) -> Column:
    return F.trim(F.array_join(F.transform(words, lambda w: w["word"]), " "))


def char_codes(text: Column) -> Column:
    """The simplest tokeniser: one id per character."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def audio_tokens(frames: Column) -> Column:
    """Audio tokens of so many valid feature frames after a convolution of stride 2."""
    return F.when(frames <= 0, F.lit(0)).otherwise(F.floor((frames - 1) / 2) + 1).cast("long")
