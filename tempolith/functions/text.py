"""Text column functions: normal forms, readability, markers, answer scores."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..vocabulary import MARKERS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda in ``body`` reads it for each element."""
    return F.transform(F.array(value), body)[0]


def norm(value: Column) -> Column:
    return F.lower(F.trim(value))


def snake(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(norm(value), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def tokens(value: Column) -> Column:
    """Lower-case runs of at least two letters or digits."""
    return F.regexp_extract_all(F.lower(value), F.lit(r"\b\w\w+\b"), F.lit(0))


def word_pairs(words: Column) -> Column:
    """Neighbours in an array of words, joined by a blank."""
    return let(words, lambda ws: F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(ws, i + 1))))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def syllables(text: Column) -> Column:
    """Groups of vowels in the letters of all words; what is no letter inside a word does not part a group.  The total is raised
    to one as soon as a word has passed without any vowel group so far, which only the first word that has letters can do."""
    low = F.lower(text)
    first_is_bare = low.rlike(r"\A[^a-z]*+(?=[a-z])[^\saeiou]*+(?:\s|\z)")
    return F.regexp_count(low, F.lit(r"[aeiou](?:[^a-z\s]*+[aeiou])*+")) + first_is_bare.cast("int")


def sentences(text: Column) -> Column:
    return F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1))


def readability(text: Column) -> Column:
    """struct(flesch, density), from one count of words, sentences and syllables: reading ease, held to 0..100 and 50 for
    a text without words; syllables by one and a half times the words, at most 1."""
    counts = F.struct(word_count(text).alias("n"), syllables(text).alias("s"), sentences(text).alias("k"))

    def scores(c: Column) -> Column:
        ease = F.lit(206.835) - 1.015 * (c["n"] / c["k"]) - 84.6 * F.try_divide(c["s"], c["n"])
        held = F.when(c["n"] == 0, 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), ease)))
        dense = F.when(c["n"] == 0, 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(c["s"], c["n"] * 1.5)))
        return F.struct(held.alias("flesch"), dense.alias("density"))

    return let(counts, scores)


def flesch(text: Column) -> Column:
    return readability(text)["flesch"]


def density(text: Column) -> Column:
    return readability(text)["density"]


def has_marker(text: Column, kind: str) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for m in MARKERS[kind]:
        out = out | low.contains(m)
    return out


def answer_form(value: Column) -> Column:
    """Lower case, no punctuation, single blanks, no leading articles."""
    plain = F.regexp_replace(F.regexp_replace(norm(value), r"[^a-z0-9\s]", " "), r"\s+", " ")
    return F.regexp_replace(F.trim(plain), r"^((the|a|an) ){1,4}", "")


def exact_score(answer: Column, gold: Column) -> Column:
    return (answer_form(answer) == answer_form(gold)).cast("double")


def contains_score(answer: Column, gold: Column) -> Column:
    a, g = answer_form(answer), answer_form(gold)
    return F.when((a == "") | (g == ""), (a == g).cast("double")).otherwise((a.contains(g) | g.contains(a)).cast("double"))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(x, y)), union))


def mermaid_id(label: Column) -> Column:
    return F.regexp_replace(label, "[^A-Za-z0-9_]", "_")


def join_and(items: Column, last: str = " and ") -> Column:
    """a; a and b; a, b and c (or with ``last`` in place of the last "and" of three and more)."""
    items = F.filter(items, lambda x: x != "")
    n = F.size(items)
    head = lambda sep: F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(1))), sep)
    return (
        F.when(n == 0, "")
        .when(n == 1, F.get(items, F.lit(0)))
        .when(n == 2, F.concat(head(", "), F.lit(" and "), F.element_at(items, -1)))
        .otherwise(F.concat(head(", "), F.lit(last), F.element_at(items, -1)))
    )


def truncate(text: Column, most: int) -> Column:
    """The first ``most`` words; a text that has no more stays as it is."""
    words = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    return F.when(F.size(words) <= most, text).otherwise(F.array_join(F.slice(words, 1, most), " "))


def stylised(text: Column, style: Column) -> Column:
    """A text in the manner of a generator."""
    said = F.when(style == "hybrid", F.concat(text, F.lit(" This highlights the main temporal relationship."))).when(style == "seq2seq", F.concat(F.lit("Summary: "), text)).otherwise(text)
    return F.when(F.coalesce(text, F.lit("")) == "", text).otherwise(said)


def at_granularity(text: Column, scale: Column) -> Column:
    """A text told at a scale; at decades, each run of four digits becomes its decade."""
    told = F.when(scale == "decades", F.regexp_replace(text, r"(\d{3})\d", "$10s")).otherwise(text)
    said = F.concat(F.lit("At "), F.when(scale == "decades", "decade").otherwise(scale), F.lit(" granularity, "), told)
    return F.when(F.coalesce(text, F.lit("")) == "", text).otherwise(said)


def token_estimate(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), word_count(text)))


def percent_encoded(text: Column) -> Column:
    """Characters that addresses and S-expressions may hold; all others as their bytes."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def clean_answer(raw: Column) -> Column:
    """The short answer in what a model says: no thinking, no preamble, first line, bare yes or no,
    no wrapping marks, the year of a full date, ten words or the first sentence of more."""
    t = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?is)<think>.*?</think>", ""))
    t = F.regexp_replace(t, r"(?i)^\s*(?:the answer is|answer|final answer|output)[:\s]+", "")
    t = F.regexp_extract(t, r"^\s*([^\n\r]*)", 1)
    answer = F.initcap(F.regexp_extract(t, r"(?i)^\s*(yes|no)\b", 1))
    edge = r"""[\s"'`.,;:()\[\]{}]+"""
    bare = F.regexp_replace(t, f"^{edge}|{edge}$", "")
    year = F.regexp_extract(bare, r"^(\d{4})[-/\s]\d{1,2}[-/\s]\d{1,2}$", 1)
    sentence = F.regexp_replace(F.regexp_extract(bare, r"^(.*?[.!?])", 1), r"[.!?\s]+$", "")
    short = F.when(word_count(bare) <= 10, bare).when(sentence != "", sentence).otherwise(truncate(bare, 8))
    return F.when(answer != "", answer).when(year != "", year).otherwise(short)


def _nfkd(value: Column) -> Column:
    # a local function travels by value, so executors need not have this package
    def f(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize("NFKD", v) if isinstance(v, str) else None)

    return F.pandas_udf(f, StringType())(value)


def folded(value: Column) -> Column:
    """Compatibility decomposition, lower case, trimmed.  Only texts beyond ASCII leave the JVM for it."""
    return F.lower(F.trim(F.when(value.rlike(r"[^\x00-\x7F]"), _nfkd(F.when(value.rlike(r"[^\x00-\x7F]"), value))).otherwise(value)))


def fold_key(*parts: Column) -> Column:
    """A digest that is the same for parts that differ in case, outer blanks and compatible forms only."""
    return F.md5(F.concat_ws("|", *[folded(x) for x in parts]))
