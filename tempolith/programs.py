"""Programs of S-expressions over a session: facts, patterns, rewrites, named operations, SQL functions.

A program is a text of expressions.  ``(edge uid src rel tgt time)`` adds an edge to the space, ``(match
(edge ...) ... template)`` joins its patterns on their variables and gives the template's rows,
``(transform (, p ...) (, t ...))`` adds to the space what the templates make of them, ``!(name argument ...)``
calls a named operation.  Variables begin with ``$``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .engine import OPERATIONS, Engine
from .operators.graph import match_all
from .session import written

ATOM = "edge_uid string, source_uid string, relation string, target_uid string, time string"
FIELDS = ("edge_uid", "source_uid", "relation", "target_uid", "time")
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[()]|[^\s()";]+|;[^\n]*')
Expression = "str | list"


def parse(text: str) -> list:
    """The expressions of a program: nested lists of texts; comments run from ``;`` to the end of the line."""
    stack: list[list] = [[]]
    for token in _TOKEN.findall(text):
        if token.startswith(";"):
            continue
        if token == "(":
            stack.append([])
        elif token == ")":
            if len(stack) == 1:
                raise ValueError("a closing bracket too many")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(token[1:-1].replace('\\"', '"') if token.startswith('"') else token)
    if len(stack) > 1:
        raise ValueError("a bracket is not closed")
    return stack[0]


def show(expression) -> str:
    if isinstance(expression, list):
        return f"({' '.join(map(show, expression))})"
    return expression if re.fullmatch(r'[^\s()";]+', expression) else '"' + expression.replace('"', '\\"') + '"'


class Space:
    """Atoms of a program, as a table that grows; copies, counts and clears."""

    def __init__(self, spark: SparkSession, atoms: DataFrame | None = None):
        self.spark = spark
        self.atoms = atoms if atoms is not None else spark.createDataFrame([], ATOM)

    def add(self, rows: DataFrame) -> None:
        self.atoms = written(self.atoms.unionByName(rows.select(*FIELDS)).distinct(), "space")

    def count(self) -> int:
        return self.atoms.count()

    def copy(self) -> "Space":
        return Space(self.spark, self.atoms)

    def clear(self) -> None:
        self.atoms = self.spark.createDataFrame([], ATOM)

    def explore(self, node: str) -> DataFrame:
        """The atoms at a node."""
        return self.atoms.where((F.col("source_uid") == node) | (F.col("target_uid") == node))

    def _pattern(self, expression: list) -> dict[str, str]:
        if not expression or expression[0] != "edge" or len(expression) not in (5, 6):
            raise ValueError(f"no pattern of an edge: {show(expression)}")
        names = FIELDS if len(expression) == 6 else FIELDS[1:]
        return dict(zip(names, expression[1:], strict=True))

    def match(self, patterns: list[list], template: list | str) -> DataFrame:
        """One text for each binding of the patterns' variables: the template with them put in."""
        found = match_all(self.atoms, [self._pattern(p) for p in patterns])
        put = lambda x: F.col(x[1:]) if x.startswith("$") and x[1:] in found.columns else F.lit(x)
        if isinstance(template, str):
            return found.select(put(template).alias("result")).distinct()
        return found.select(F.concat(F.lit("("), F.concat_ws(" ", *[put(x) for x in template]), F.lit(")")).alias("result")).distinct()

    def transform(self, patterns: list[list], templates: list[list]) -> DataFrame:
        """New atoms, added to the space: what the templates make of each binding."""
        found, out = match_all(self.atoms, [self._pattern(p) for p in patterns]), None
        for t in templates:
            fields = self._pattern(t)
            put = lambda x, found=found: F.col(x[1:]) if x.startswith("$") and x[1:] in found.columns else F.lit(x)
            cols = {n: put(v) for n, v in fields.items()}
            cols.setdefault("edge_uid", F.concat_ws("|", cols["relation"], cols["source_uid"], cols["target_uid"]))
            rows = found.select(*[cols[n].alias(n) for n in FIELDS]).distinct()
            out = rows if out is None else out.unionByName(rows)
        self.add(out)
        return out


class Runner:
    """Runs programs; each result is a list of texts, one for each row."""

    def __init__(self, engine: Engine, space: Space | None = None):
        self.engine, self.space = engine, space or Space(engine.spark)
        self.tables: dict[str, DataFrame] = {}

    def table(self, name: str, rows: DataFrame) -> None:
        """A table that programs may hand to operations, by name."""
        self.tables[name] = rows

    def run(self, program: str) -> list[list[str]]:
        expressions = parse(program)
        facts = [e for e in expressions if isinstance(e, list) and e and e[0] == "edge"]
        if facts:
            rows = [(e[1], e[2], e[3], e[4], e[5] if len(e) > 5 else "") for e in facts]
            self.space.add(self.engine.spark.createDataFrame(rows, ATOM))
        return [r for e in self._calls(expressions) if (r := self._call(e)) is not None]

    def _calls(self, expressions: list) -> Iterator[list]:
        for i, e in enumerate(expressions):
            if isinstance(e, list) and e and e[0] != "edge" and (e[0] in ("match", "transform") or (i and expressions[i - 1] == "!")):
                yield e

    def _call(self, e: list) -> list[str] | None:
        name, args = e[0], e[1:]
        if name == "match":
            args = args[1:] if args[0] == "&self" else args
            patterns = args[0][1:] if args[0][0] == "," else args[:-1]
            return [r["result"] for r in self.space.match(patterns, args[-1]).orderBy("result").collect()]  # what a caller asked to see
        if name == "transform":
            self.space.transform(args[0][1:], args[1][1:])
            return [str(self.space.count())]
        if name in WRAPPERS:
            return [show([WRAPPERS[name][0], *r]) for r in zip(*[self._call([op, *(args if not k else [])]) for k, op in enumerate(WRAPPERS[name][1])], strict=False)]
        if name not in OPERATIONS:
            raise ValueError(f"unknown operation {name}")
        given = [self.tables.get(a, a) if isinstance(a, str) else a for a in args]
        out = OPERATIONS[name](self.engine, *given)
        if isinstance(out, DataFrame):
            return [r["j"] for r in out.select(F.to_json(F.struct("*")).alias("j")).collect()]  # what a caller asked to see
        return None if out is None else [str(out)]


#: Operations that put others' results side by side under a name; the first of them gets the arguments.
WRAPPERS = {"temporal-QA": ("Answer", ["graph-answer", "graph-mermaid"]), "justify": ("Justification", ["tms-explain"]), "contradiction-status": ("Contradictions", ["tms-contradictions"])}


@udtf(returnType="source string, relation string, target string, time string")
class EdgesFromJson:
    """Edges of a JSON array as rows, for SQL."""

    def eval(self, text: str):
        import json

        try:
            edges = json.loads(text or "[]")
        except ValueError:
            return
        for e in edges if isinstance(edges, list) else []:
            if isinstance(e, dict):
                pick = lambda *names, e=e: next((str(e[n]) for n in names if e.get(n) is not None), "")
                row = (pick("source", "src", "subject"), pick("relation", "rel", "predicate"), pick("target", "tgt", "object"), pick("time", "year", "start"))
            elif isinstance(e, list):
                row = tuple([*map(str, e[:4]), "", "", "", ""][:4])
            else:
                continue
            if row[0] and row[2]:
                yield row


def register(spark: SparkSession) -> None:
    """Names for SQL: the table function ``edges_from_json`` and functions on texts and years."""
    spark.udtf.register("edges_from_json", EdgesFromJson)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION overlaps_year(s BIGINT, e BIGINT, y BIGINT) RETURNS BOOLEAN RETURN CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN least(s, e) <= y AND y <= greatest(s, e) WHEN s IS NOT NULL THEN s = y WHEN e IS NOT NULL THEN e = y ELSE false END")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION norm_label(x STRING) RETURNS STRING RETURN lower(trim(x))")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION parse_year(x STRING) RETURNS BIGINT RETURN CASE WHEN x RLIKE '^-?[0-9]{1,12}$' THEN try_cast(x AS BIGINT) WHEN x RLIKE '^-?[0-9]{1,12}-[0-9]{2}-[0-9]{2}$' THEN try_cast(regexp_extract(x, '^(-?[0-9]{1,12})-', 1) AS BIGINT) END")
