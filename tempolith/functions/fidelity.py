"""How faithful a text is to the facts that it tells, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import word_count
from .timefn import date_tier, years_in

# Words that show that a text speaks of time, and those that show each kind of relation.
TEMPORAL_WORDS = ("century", "decade", "period", "era", "age", "epoch", "before", "after", "during", "while", "when", "until")
RELATION_WORDS = {
    "causal": ("because", "caused", "led to", "resulted in", "due to"),
    "sequence": ("then", "next", "after", "before", "followed by"),
    "interval": ("from", "to", "between", "until", "during"),
    "overlap": ("while", "during", "simultaneously", "at the same time"),
}
# Names of scopes in source records and the buckets that they fall in; all others are "other".
SCOPES = {
    "point": ("point", "timestamp", "date"),
    "interval": ("interval", "range", "duration"),
    "sequence": ("sequence", "ordering", "order"),
    "causal": ("causal", "causality"),
    "overlap": ("overlap",),
}
_NUMBER = r"^[+-]?\d+(?:\.\d+)?$"


def bucket(scope: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(scope, F.lit(""))))
    out = F.lit("other")
    for name, words in SCOPES.items():
        out = F.when(s.isin(*words), name).otherwise(out)
    return out


def _any(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def distinct_years(text: Column) -> Column:
    return F.array_distinct(years_in(F.coalesce(text, F.lit(""))))


def share(part: Column, whole: Column, empty: float = 1.0) -> Column:
    """Size of one array over that of another; ``empty`` if the other is empty."""
    return F.when(F.size(whole) == 0, F.lit(empty)).otherwise(F.try_divide(F.size(part), F.size(whole)))


def date_preservation(fact: Column, text: Column) -> Column:
    """The share of the fact's years in the text, and a tenth more where the text speaks of time."""
    own = distinct_years(fact)
    rate = share(F.filter(own, lambda y: text.contains(y.cast("string"))), own)
    return F.when(F.size(own) == 0, 1.0).when(_any(text, TEMPORAL_WORDS), F.least(F.lit(1.0), rate + 0.1)).otherwise(rate)


def entity_preservation(entity: Column, text: Column) -> Column:
    """1 for the whole name, 0.7 for its first or last word, 1 if there is no name."""
    low, name = F.lower(text), F.lower(F.coalesce(entity, F.lit("")))
    words = F.split(F.trim(name), r"\s+")
    part = (F.size(words) > 1) & (low.contains(F.element_at(words, 1)) | low.contains(F.element_at(words, -1)))
    return F.when(name == "", 1.0).when(low.contains(name), 1.0).when(part, 0.7).otherwise(0.0)


def relation_preservation(kind: Column, text: Column) -> Column:
    """1 if the text has a word of its kind of relation, else 0.3; 0.7 for kinds without words, 0.5 for none."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    out = F.lit(0.7)
    for name, words in reversed(RELATION_WORDS.items()):
        out = F.when(low.contains(name), F.when(_any(text, words), 1.0).otherwise(0.3)).otherwise(out)
    return F.when(low == "", 0.5).otherwise(out)


def hallucinated(fact: Column, text: Column) -> Column:
    """Years that the fact does not have, or more than fifty words."""
    return (F.size(F.array_except(distinct_years(text), distinct_years(fact))) > 0) | (word_count(text) > 50)


def fact_entities(facts: Column) -> Column:
    """Distinct names in facts (subject, object, value), lower case, no plain numbers, 25 at most."""
    names = F.flatten(F.transform(facts, lambda f: F.array(f["subject"], f["object"], f["value"])))
    told = F.filter(F.transform(F.array_compact(names), lambda n: F.lower(F.trim(n))), lambda n: (n != "") & ~n.rlike(_NUMBER))
    return F.slice(F.array_distinct(told), 1, 25)


def fact_atoms(facts: Column) -> Column:
    """What a text about facts should mention: names, relations and years of dates; 50 at most."""

    def atoms(f: Column) -> Column:
        names = F.filter(F.transform(F.array(f["subject"], f["object"], f["value"]), lambda n: F.lower(F.trim(F.coalesce(n, F.lit(""))))), lambda n: (n != "") & ~n.rlike(_NUMBER))
        relation = F.lower(F.trim(F.coalesce(f["relation"], F.lit(""))))
        rel = F.when(~relation.isin("", "none", "n/a"), F.array(relation)).otherwise(F.array().cast("array<string>"))
        years = F.transform(F.array_compact(F.array(iso_date(f["start"]), iso_date(f["end"]))), lambda d: F.year(d).cast("string"))
        return F.concat(names, rel, years)

    return F.slice(F.array_distinct(F.flatten(F.transform(facts, atoms))), 1, 50)


def mentioned(parts: Column, text: Column) -> Column:
    """The share of parts that occur in a text."""
    low = F.lower(text)
    return share(F.filter(parts, lambda p: low.contains(p)), parts)


def extra_year_ratio(text: Column, gold_years: Column) -> Column:
    own = distinct_years(text)
    return share(F.array_except(own, gold_years), own, 0.0)


def confidence_signal(text: Column, hedge: Column, certain: Column) -> Column:
    """-1 for texts that only hedge, 1 for those that only assert, else 0."""
    return F.when(hedge & ~certain, -1.0).when(certain & ~hedge, 1.0).otherwise(0.0)


def iso_date(value: Column) -> Column:
    v = F.trim(value)
    return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(v, 1, 10).try_cast("date"))


def best_date_match(found: Column, gold: Column, found_years: Column) -> Column:
    """The best tier of all pairs of dates; half for a year alone; 1 if there is no date to match."""
    pairs = F.flatten(F.transform(found, lambda p: F.transform(gold, lambda g: date_tier(F.datediff(p, g)))))
    gold_years = F.transform(gold, lambda g: F.year(g).cast("bigint"))
    return F.when(F.size(gold) == 0, 1.0).when(F.size(found) > 0, F.array_max(pairs)).when(F.arrays_overlap(found_years, gold_years), 0.5).otherwise(0.0)


def pair_ranges(dates: Column) -> Column:
    """All ranges between two dates of a text."""
    return F.flatten(F.transform(dates, lambda a, i: F.transform(F.slice(dates, i + 2, F.size(dates)), lambda b: F.struct(F.least(a, b).alias("s"), F.greatest(a, b).alias("e")))))


def boundary_accuracy(found: Column, gold: Column) -> Column:
    """The mean, over gold ranges that any range comes near, of the best mean tier of both ends; else 0."""
    best = lambda g: F.array_max(F.transform(found, lambda p: 0.5 * (date_tier(F.datediff(p["s"], g["s"])) + date_tier(F.datediff(p["e"], g["e"])))))
    return array_mean(F.filter(F.transform(gold, best), lambda x: x > 0))


def duration_correctness(found: Column, days: Column, gold: Column) -> Column:
    """How near the closest told duration comes to each gold range: the explicit ones, and that of the last range told."""
    last = F.try_element_at(found, F.lit(-1))
    told = F.concat(F.when(last.isNotNull(), F.array(F.abs(F.datediff(last["e"], last["s"])).cast("double"))).otherwise(F.array().cast("array<double>")), days)

    def tier(g: Column) -> Column:
        length = F.abs(F.datediff(g["e"], g["s"]))
        return F.when(length > 0, date_tier(F.bround(F.array_min(F.transform(told, lambda d: F.abs(d - length))))))

    return array_mean(F.array_compact(F.transform(gold, tier)))


def array_mean(values: Column) -> Column:
    """The mean of an array, 0 if it is empty."""
    return F.coalesce(F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values)), F.lit(0.0))


def mean_of_present(*values: Column) -> Column:
    """The mean of the values that are there (neither null nor NaN); null if none is."""
    there = F.filter(F.array(*[safe_float(v) for v in values]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.size(there))


def safe_float(value: Column) -> Column:
    v = value.try_cast("double")
    return F.when(~F.isnan(v), v)


def order_accuracy(items: Column, text: Column) -> Column:
    """Of the pairs of items that a text mentions, the share that it mentions first in the given order."""
    low = F.lower(text)
    places = F.filter(F.transform(items, lambda x: F.instr(low, x)), lambda p: p > 0)
    pairs = F.flatten(F.transform(places, lambda a, i: F.transform(F.slice(places, i + 2, F.size(places)), lambda b: (a < b).cast("int"))))
    return F.when(F.size(items) < 2, F.lit(None).cast("double")).when(F.size(pairs) == 0, 0.0).otherwise(F.try_divide(F.aggregate(pairs, F.lit(0), lambda a, x: a + x), F.size(pairs)))


def lcs_length(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence of two arrays, row by row of the table."""
    zero = F.transform(b, lambda _: F.lit(0))

    def row(last: Column, x: Column) -> Column:
        # cell j: what is above, what is left, or the diagonal and one more
        return F.aggregate(
            F.arrays_zip(b.alias("y"), last.alias("up")),
            F.array().cast("array<int>"),
            lambda done, c: F.concat(
                done,
                F.array(
                    F.when(c["y"].eqNullSafe(x), 1 + F.when(F.size(done) > 0, F.get(last, F.size(done) - 1)).otherwise(0)).otherwise(
                        F.greatest(c["up"], F.when(F.size(done) > 0, F.element_at(done, -1)).otherwise(0))
                    )
                ),
            ),
        )

    return F.coalesce(F.array_max(F.aggregate(a, zero, row)), F.lit(0))


def slot_form(value: Column) -> Column:
    """A slot's value for comparison: lower case, no leading article, words joined by underscores."""
    bare = F.regexp_replace(F.lower(F.trim(value)), r"^(?:the|a|an)\s+", "")
    return F.replace(F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), F.lit("fine_tuning"), F.lit("finetuning"))


# Words of a slot that do not tell its value.
SLOT_STOP = (
    "the", "a", "an", "of", "in", "on", "at", "by", "for", "with", "about", "to", "from", "and", "or", "signing", "signed", "built", "founded", "launched", "opened", "invented",
    "completed", "declared", "announced", "established", "occur", "happen", "start", "end", "begin", "finish", "take", "place",
)


def slots_match(a: Column, b: Column) -> Column:
    """Equal values, or one within the other word by word, or half of all their words shared."""
    x, y = slot_form(F.coalesce(a, F.lit(""))), slot_form(F.coalesce(b, F.lit("")))
    words = lambda v: F.array_distinct(F.filter(F.split(v, "_"), lambda w: ~w.isin(*SLOT_STOP)))
    p, g = words(x), words(y)
    shared = F.size(F.array_intersect(p, g))
    near = (shared == F.size(p)) | (shared == F.size(g)) | (F.try_divide(shared, F.size(F.array_union(p, g))) >= 0.5)
    return (x == y) | ((x != "") & (y != "") & (F.size(p) > 0) & (F.size(g) > 0) & near)


def slots_cover(predicted: Column, gold: Column, skip: Column) -> Column:
    """Every slot of the gold map (but one that may be skipped) is matched in the predicted one."""
    entries = F.filter(F.map_entries(gold), lambda e: ~e["key"].eqNullSafe(skip))
    return F.forall(entries, lambda e: slots_match(F.try_element_at(predicted, e["key"]), e["value"]))
