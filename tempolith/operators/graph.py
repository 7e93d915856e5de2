"""Lookups, expansion, paths and checks on a graph of nodes and edges.

Nodes: node_uid, label, category.  Edges: edge_uid, source_uid, target_uid,
relation, start_year, end_year, edge_type, support_count.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm
from ..functions.timefn import overlaps_year
from ..session import written
from ..vocabulary import CATEGORIES, OTHER_CATEGORY


def canonical_category(raw: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in itertools.chain.from_iterable(CATEGORIES.items())])
    return F.coalesce(F.try_element_at(table, norm(raw)), F.lit(OTHER_CATEGORY))


def scan_nodes(raw: DataFrame) -> DataFrame:
    """Nodes with uid and label, categories in their canonical form."""
    return raw.where("coalesce(node_uid, '') <> '' and coalesce(label, '') <> ''").withColumn("category", canonical_category(F.col("category")))


def scan_edges(raw: DataFrame) -> DataFrame:
    """Edges with all ids, defaults filled in."""
    ids = ("edge_uid", "source_uid", "target_uid")
    out = raw.where(" and ".join(f"coalesce({c}, '') <> ''" for c in ids))
    return out.withColumns(
        {
            "relation": F.coalesce("relation", F.lit("related_to")),
            "edge_type": F.coalesce("edge_type", F.lit("base")),
            "support_count": F.coalesce("support_count", F.lit(1)).cast("bigint"),
        }
    )


def labelled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the labels and categories of both ends; an unknown end is called by its uid."""
    out = edges
    for end in ("source", "target"):
        n = nodes.select(F.col("node_uid").alias(f"{end}_uid"), F.col("label").alias(f"{end}_label"), F.col("category").alias(f"{end}_category"))
        out = out.join(n, f"{end}_uid", "left")
        out = out.withColumns({f"{end}_label": F.coalesce(f"{end}_label", f"{end}_uid"), f"{end}_category": F.coalesce(f"{end}_category", F.lit(OTHER_CATEGORY))})
    return out


def resolve(questions: DataFrame, nodes: DataFrame, max_hits: int = 5) -> DataFrame:
    """Questions (q_id, mention) -> q_id, node_uid, label, rank: equal labels, in order of uid.

    The nodes of a label are ranked and cut to ``max_hits`` before they meet the
    mentions (a limit that Spark applies ahead of its shuffle), so a common label
    costs each mention no more than it can return.
    """
    q = questions.withColumn("key", norm(F.col("mention")))
    n = capped(nodes.select("node_uid", "label", norm(F.col("label")).alias("key")), ["key"], ["node_uid"], max_hits)
    order = Window.partitionBy("q_id").orderBy("node_uid")
    return q.join(n, "key").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_hits).select("q_id", "node_uid", "label", "rank")


def resolve_by_part(questions: DataFrame, nodes: DataFrame, max_hits: int = 5) -> DataFrame:
    """Labels that contain the mention as a run of words, or are such a run of it; shortest first.

    A label and a mention meet by their words (an equi-join), so the number of
    candidates follows the postings of the mention's words, not the product of
    both tables; the containment test comes after.
    """
    q = questions.withColumn("key", norm(F.col("mention")))
    n = nodes.select("node_uid", "label", norm(F.col("label")).alias("label_key"))
    words = n.select("node_uid", "label", "label_key", F.explode(F.array_distinct(F.split("label_key", r"\s+"))).alias("word"))
    asked = q.select("q_id", "key", F.explode(F.array_distinct(F.split("key", r"\s+"))).alias("word"))
    met = asked.join(words, "word").where(F.col("label_key").contains(F.col("key")) | F.col("key").contains(F.col("label_key")))
    met = met.dropDuplicates(["q_id", "node_uid"])
    order = Window.partitionBy("q_id").orderBy(F.length("label"), "label", "node_uid")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_hits).select("q_id", "node_uid", "label", "rank")


def incident(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges at either end of the seeds (node_uid), with the seed; loops once."""
    out = edges.join(seeds, edges["source_uid"] == seeds["node_uid"])
    back = edges.join(seeds, edges["target_uid"] == seeds["node_uid"]).where("source_uid <> target_uid")
    return out.unionByName(back)


def capped(edges: DataFrame, by: list[str], order: list, cap: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return edges.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def merged(told: DataFrame, most: int = 1000) -> DataFrame:
    """Triples (source_uid, relation, target_uid, row_id) as edges: how often each was told, and the rows that told it,
    in order, ``most`` of them at the most."""
    # each row once, numbered inside its triple, so that no array grows with a frequent triple
    triple = ["source_uid", "relation", "target_uid"]
    counts = told.groupBy(*triple).agg(F.count(F.lit(1)).alias("support_count"))
    rows = capped(told.distinct(), triple, ["row_id"], most)
    ids = rows.groupBy(*triple).agg(F.sort_array(F.collect_list("row_id")).alias("source_row_ids"))
    return counts.join(ids, triple).withColumn("edge_uid", F.concat_ws("|", "relation", "source_uid", "target_uid"))


def degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source_uid", "target_uid")).alias("node_uid"))
    return ends.groupBy("node_uid").agg(F.count(F.lit(1)).alias("degree"))


def reach(edges: DataFrame, starts: DataFrame, max_hops: int = 4, year: int | None = None) -> DataFrame:
    """start_uid, node_uid, hops: nodes a directed walk of at most ``max_hops`` edges leads to.
    A node counts at its least distance; the start itself only ever as such."""
    step = edges if year is None else edges.where(overlaps_year(F.col("start_year"), F.col("end_year"), F.lit(year)))
    step = step.select("source_uid", "target_uid").distinct()
    front = starts.select(F.col("node_uid").alias("start_uid"), "node_uid").distinct()
    seen = front.withColumn("hops", F.lit(0))
    for hop in range(1, max_hops + 1):
        new = front.join(step, front["node_uid"] == step["source_uid"]).select("start_uid", F.col("target_uid").alias("node_uid")).distinct()
        front = written(new.join(seen.select("start_uid", "node_uid"), ["start_uid", "node_uid"], "left_anti"), "front")
        seen = seen.unionByName(front.withColumn("hops", F.lit(hop)))
    return seen.where("hops > 0")


def witness_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 4) -> DataFrame:
    """(q_id, start_uid, end_uid) -> q_id, hops, nodes, edges (uids): a shortest simple path for each
    pair, of several the first in order of its edges; nulls where there is none of ``max_hops``.

    Breadth first, all questions at once: a question keeps one path to each node that it has
    reached, so its table grows by nodes, never by paths.  Questions whose end is reached walk no further.
    """
    step = edges.select(F.col("source_uid").alias("at"), F.col("target_uid").alias("to"), "edge_uid")
    ends = pairs.select("q_id", "end_uid")
    front = pairs.select("q_id", F.col("start_uid").alias("at"), F.array("start_uid").alias("nodes"), F.array().cast("array<string>").alias("path"))
    seen, found = front.select("q_id", "at"), None
    for _ in range(max_hops):
        grown = front.join(step, "at").groupBy("q_id", F.col("to").alias("at")).agg(F.min(F.struct(F.concat("path", F.array("edge_uid")).alias("path"), F.concat("nodes", F.array("to")).alias("nodes"))).alias("b"))
        grown = written(grown.join(seen, ["q_id", "at"], "left_anti").select("q_id", "at", "b.nodes", "b.path").join(ends, "q_id"), "front")
        hit = grown.where("at = end_uid").select("q_id", F.size("path").alias("hops"), "nodes", F.col("path").alias("edges"))
        found = hit if found is None else found.unionByName(hit)
        front = grown.join(hit.select("q_id"), "q_id", "left_anti").drop("end_uid")
        seen = seen.unionByName(front.select("q_id", "at"))
    return pairs.select("q_id").join(found, "q_id", "left")


def path_steps(paths: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """q_id, steps: found paths as arrays of struct(source, relation, target, time) with labels."""
    each = paths.where("edges is not null").select("q_id", F.posexplode("edges").alias("k", "edge_uid"))
    told = each.join(labelled(edges, nodes), "edge_uid")
    step = F.struct("k", F.struct(F.col("source_label").alias("source"), "relation", F.col("target_label").alias("target"), F.col("start_year").cast("string").alias("time")).alias("s"))
    return told.groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["s"]).alias("steps"))


#: Years that one row of a long interval is unfolded to; intervals beyond it are dealt out in pieces first.
YEARS_AT_ONCE = 1000


def year_hierarchy(edges: DataFrame) -> DataFrame:
    """One inferred edge from each dated edge's source to each year it touches.

    Geological intervals touch millions of years: an interval is first cut into
    pieces of ``YEARS_AT_ONCE``, which are spread over the tasks before they are unfolded.
    """
    dated = edges.where("start_year is not null or end_year is not null")
    lo, hi = F.least("start_year", "end_year"), F.greatest("start_year", "end_year")
    kind = F.when(lo == hi, "within_year").otherwise("spans_year").alias("relation")
    pieces = dated.select("edge_uid", "source_uid", kind, hi.alias("hi"), F.explode(F.sequence(lo, hi, F.lit(YEARS_AT_ONCE).cast("bigint"))).alias("lo"))
    spread = pieces.hint("rebalance", "edge_uid", "lo")
    return spread.select("edge_uid", "source_uid", F.explode(F.sequence("lo", F.least("hi", F.col("lo") + (YEARS_AT_ONCE - 1)))).alias("year"), "relation")


def entity_parents(nodes: DataFrame) -> DataFrame:
    """child_uid, parent_uid where the parent's label is a proper word prefix of the child's."""
    n = nodes.withColumn("words", F.split(norm(F.col("label")), r"\s+"))
    prefixes = n.select(F.col("node_uid").alias("child_uid"), F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - 1, F.lit(1)))).alias("k"), "words")
    prefixes = prefixes.where("k < size(words)").select("child_uid", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("key"))
    parents = n.select(F.col("node_uid").alias("parent_uid"), F.array_join("words", " ").alias("key"))
    return prefixes.join(parents, "key").select("child_uid", "parent_uid")


def tag_relations(tags: DataFrame, nodes: DataFrame) -> DataFrame:
    """tag_uid, node_uid, shared: pairs that share a word of at least three letters."""
    words = lambda c: F.array_distinct(F.filter(F.split(norm(F.col(c)), r"[^a-z0-9]+"), lambda w: F.length(w) >= 3))
    t = tags.select("tag_uid", F.explode(words("tag")).alias("word"))
    n = nodes.select("node_uid", F.explode(words("label")).alias("word"))
    return t.join(n, "word").groupBy("tag_uid", "node_uid").agg(F.count(F.lit(1)).alias("shared"))


def issues(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge_uid, code: one row for each violation."""
    known = nodes.select(F.col("node_uid"))
    missing = lambda end: edges.join(known, edges[f"{end}_uid"] == known["node_uid"], "left_anti").select("edge_uid", F.lit(f"edge_{end}_not_found").alias("code"))
    reversed_ = edges.where("start_year > end_year").select("edge_uid", F.lit("edge_interval_reversed").alias("code"))
    weight = edges.where("support_count < 0").select("edge_uid", F.lit("edge_negative_weight").alias("code"))
    return missing("source").unionByName(missing("target")).unionByName(reversed_).unionByName(weight)


def match_pattern(edges: DataFrame, pattern: dict[str, str]) -> DataFrame:
    """Bindings of a triple pattern over source, relation, target, time.  Values that begin
    with ``$`` are variables; a repeated variable must bind equal values; others are constants."""
    out, bound = edges, {}
    for column, term in pattern.items():
        if not term.startswith("$"):
            out = out.where(F.col(column) == F.lit(term))
        elif term[1:] in bound:
            out = out.where(F.col(column) == F.col(bound[term[1:]]))
        else:
            bound[term[1:]] = column
    return out.select(*[F.col(c).alias(v) for v, c in bound.items()]).distinct() if bound else out


def match_all(edges: DataFrame, patterns: list[dict[str, str]]) -> DataFrame:
    """Patterns joined on the variables that they share."""
    out = match_pattern(edges, patterns[0])
    for p in patterns[1:]:
        more = match_pattern(edges, p)
        shared = [c for c in more.columns if c in out.columns]
        out = out.join(more, shared) if shared else out.crossJoin(more)
    return out
