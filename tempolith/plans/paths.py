"""Explanations of linear paths, and justifications of beliefs, as column expressions.

A path is an array of steps, struct(source, relation, target, time).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_HOPS = 8
OPENERS = ("Here is the chain:", "The path is:", "It went this way:")
# How a narrative begins, tells its path and ends, by style and by domain.
INTRO = {"novice": "Here is the timeline in plain terms.", "expert": "Tracing the dependency path:"}
OUTRO = {"novice": "That is the key takeaway.", "expert": "Summary complete."}
BODY = {"medical": "Clinical sequence: {path}. Interpretation: {summary}", "finance": "Event flow: {path}. Impact: {summary}", "novice": "Step by step: {path}. It means {summary}", "expert": "Path {path}. Implication: {summary}"}
PLAIN_INTRO, PLAIN_BODY = "Timeline overview:", "Path {path}. {summary}"


def _timed(text: Column, time: Column, mark: str) -> Column:
    return F.when(F.coalesce(time, F.lit("")) != "", F.concat(text, F.lit(mark), time)).otherwise(text)


def path_error(steps: Column) -> Column:
    """Why an array of steps is no linear path of at most MAX_HOPS; null if it is one."""
    n = F.size(steps)
    broken = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n) & ~F.get(steps, i)["source"].eqNullSafe(F.get(steps, i - 1)["target"]))
    return F.when(F.coalesce(n, F.lit(0)) < 1, "a path has at least one step").when(n > MAX_HOPS, "a path has too many steps").when(broken, "the steps do not follow each other")


def path_text(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s: F.concat(s["source"], F.lit(" -["), _timed(F.trim(s["relation"]), s["time"], " @"), F.lit("]-> "), s["target"])), " | ")


def summary(steps: Column) -> Column:
    relations = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(steps, lambda s: F.trim(s["relation"])), lambda r: r != ""))), ", ")
    via = F.when(relations == "", "related").otherwise(relations)
    return F.concat(F.lit("Connection from "), F.element_at(steps, 1)["source"], F.lit(" to "), F.element_at(steps, -1)["target"], F.lit(" via "), via, F.lit("."))


def justification(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s: _timed(F.concat_ws(" ", s["source"], s["relation"], s["target"]), s["time"], " at ")), "; ")


def narrative(steps: Column, style: str = "neutral", domain: str = "general", evidence: Column | None = None) -> Column:
    """The path told in a style for a domain, with the chain of evidence where there is one."""
    body = BODY.get(domain) or BODY.get(style) or PLAIN_BODY
    told = F.replace(F.replace(F.lit(body), F.lit("{path}"), path_text(steps)), F.lit("{summary}"), summary(steps))
    text = F.concat_ws(" ", F.lit(INTRO.get(style, PLAIN_INTRO)), told, F.lit(OUTRO.get(style)))
    if evidence is None:
        return text
    return F.when(F.coalesce(F.size(evidence), F.lit(0)) > 0, F.concat(text, F.lit(" Evidence chain: "), F.array_join(evidence, ", "), F.lit("."))).otherwise(text)


def compact(steps: Column, path_id: Column) -> Column:
    """The steps as short clauses behind an opener that follows from the path's id."""
    clause = lambda s: F.trim(F.concat_ws(" ", *[F.when(F.coalesce(s[c], F.lit("")) != "", s[c]) for c in ("source", "relation", "target")], F.when(F.coalesce(s["time"], F.lit("")) != "", F.concat(F.lit("("), s["time"], F.lit(")")))))
    opener = F.get(F.array(*map(F.lit, OPENERS)), F.pmod(F.crc32(path_id.cast("binary")), F.lit(len(OPENERS))).cast("int"))
    return F.concat(opener, F.lit(" "), F.array_join(F.transform(steps, clause), " then "), F.lit("."))


def belief_text(belief_id: Column, supports: Column, evidence: Column) -> Column:
    """What a belief rests on; evidence is an array of struct(source, snippet, weight)."""
    some = F.array_join(F.transform(evidence, lambda e: F.concat(F.lit("["), F.coalesce(e["source"], F.lit("unknown")), F.lit("] "), F.coalesce(e["snippet"], F.lit("")), F.lit(" (w="), e["weight"].cast("string"), F.lit(")"))), "; ")
    rests = F.when(F.coalesce(F.size(supports), F.lit(0)) > 0, F.array_join(supports, ", ")).otherwise("none")
    told = F.when(F.coalesce(F.size(evidence), F.lit(0)) > 0, some).otherwise("no direct evidence")
    return F.concat(F.lit("Belief "), belief_id, F.lit(" is supported by "), rests, F.lit(". Evidence: "), told, F.lit("."))


def claim_text(claim: Column, confidence: Column, evidence: Column) -> Column:
    """A claim with its evidence, an array of struct(source, snippet, weight, time)."""
    head = F.concat(F.lit("Claim '"), claim, F.lit("' (conf "), F.format_number(confidence, 2), F.lit(")"))
    one = lambda e: F.concat(F.lit("["), _timed(e["source"], e["time"], " @"), F.lit("] "), e["snippet"], F.lit(" (w="), F.format_number(e["weight"], 1), F.lit(")"))
    return F.when(F.coalesce(F.size(evidence), F.lit(0)) > 0, F.concat(head, F.lit(": "), F.array_join(F.transform(evidence, one), "; "))).otherwise(F.concat(head, F.lit(" with no evidence.")))
