"""Marks and edges folded in their order at any size: ranges of facts are summed up each in a task, and the summaries, which
are associative, are merged in a tree.

The state of a variable is a set of labels: TAINT, and the types that it is cleaned of. A fact changes one variable: a
source adds TAINT, a sanitizer its types, one of everything leaves nothing but `all`, and an edge adds the labels that its
source has at that moment. What a range of facts does to a variable is therefore a set of labels and a set of variables
whose labels before the range it takes: long rows of (variable, label or input). Two neighbouring ranges merge by a join of
the later one's inputs with the earlier one's rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut
from .relational import first_wins

TAINT = "#taint"
#: Facts that a task sums up.
RANGE_FACTS = 20_000


def numbered(rows: DataFrame, key: str, order: list[str], name: str = "pos") -> DataFrame:
    """Adds `name`: the row's number within its key, from 0 by `order` (nulls first).

    A range sort deals a key of any size over many tasks; what stands before a task's rows of a key is a running sum over
    one row per task and key, so no window orders a key's rows in one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    at = F.monotonically_increasing_id()
    ordered = cut(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__task", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    runs = ordered.groupBy(F.col(key).alias("__key"), F.col("__task").alias("__of")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy("__key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("__before", F.coalesce(before, F.lit(0)))
    met = ordered.join(runs, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__task") == F.col("__of")))
    return met.withColumn(name, F.col("__before") + F.col("__at") - F.col("__first")).drop("__task", "__at", "__key", "__of", "__n", "__first", "__before")


def steps(marks: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, path, seq, step, kind, a, b, types): marks of variable a, and edges a to b, which come behind marks of the
    same place. A sanitizer counts only if its variable is known by then: a source, a sink or an edge has named it."""
    m = marks.select("project_id", "path", "seq", F.lit(0).alias("step"), "kind", F.col("var").alias("a"), F.lit("").alias("b"), "types")
    e = edges.select("project_id", "path", "seq", F.lit(1).alias("step"), F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(None).cast("array<string>").alias("types"))
    place = F.struct("path", "seq", "step")
    named = m.where("kind <> 'sanitize'").select("project_id", "a", place.alias("at")).unionByName(e.select("project_id", F.explode(F.array("a", "b")).alias("a"), place.alias("at")))
    known = named.groupBy("project_id", "a").agg(F.min("at").alias("known"))
    clean = m.where("kind = 'sanitize'").join(known, ["project_id", "a"]).where(F.col("known") < place).drop("known")
    return m.where("kind = 'source'").unionByName(clean).unionByName(e)


def _summary(rows: list[tuple]) -> dict[str, tuple[set[str], set[str]]]:
    """{variable: (labels, inputs)} of facts (kind, a, b, types) in order."""
    state: dict[str, tuple[set[str], set[str]]] = {}
    for kind, a, b, types in rows:
        labels, inputs = state.setdefault(b if kind == "edge" else a, (set(), {b if kind == "edge" else a}))
        if kind == "edge":
            more, other = state.get(a, ((), (a,)))
            labels.update(more)
            inputs.update(other)
        elif kind == "source":
            labels.add(TAINT)
        elif "all" in types:
            labels.clear()
            inputs.clear()
            labels.add("all")
        else:
            labels.update(types)
    return state


def merged(parts: DataFrame) -> DataFrame:
    """Summaries of ranges 2k and 2k + 1 as that of range k. Nothing lies before the first range, so its inputs go.

    A later range's input that the earlier one changed becomes what that made of it, any other stays; variables that the
    later range leaves alone keep the earlier one's rows.
    """
    half = F.shiftright("part", 1).alias("part")
    odd = F.col("part") % 2 == 1
    early = parts.where(~odd).select("project_id", half, "node", "label", "input")
    late = parts.where(odd).select("project_id", half, "node", "label", "input")
    own = late.where("input is null")
    taken = late.where("input is not null").select("project_id", "part", F.col("node").alias("of"), F.col("input").alias("node"))
    met = taken.join(early.withColumn("there", F.lit(True)), ["project_id", "part", "node"], "left")
    met = met.select("project_id", "part", F.col("of").alias("node"), "label", F.when(F.col("there"), F.col("input")).otherwise(F.col("node")).alias("input"))
    alone = early.join(late.select("project_id", "part", "node").distinct(), ["project_id", "part", "node"], "left_anti")
    out = own.unionByName(met).unionByName(alone.select(*own.columns)).where("label is not null or input is not null")
    return out.where("part > 0 or input is null").distinct()


def folded(marks: DataFrame, edges: DataFrame, range_facts: int = RANGE_FACTS) -> DataFrame:
    """(project_id, node, label): the labels that each variable has once all facts are folded in order of path, seq, marks
    before edges; a variable without labels has no row. Columns as in `steps`.

    Each range of `range_facts` facts is one task, whatever the project's size; the tree over ranges has as many levels
    as the largest project has doublings of them, each one join that is checkpointed.
    """
    facts = numbered(steps(marks, edges), "project_id", ["path", "seq", "step", "a", "b", "kind"])
    facts = facts.withColumn("part", F.floor(F.col("pos") / range_facts).cast("long"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        project, part = frame["project_id"].iloc[0], int(frame["part"].iloc[0])
        ordered = frame.sort_values("pos")
        state = _summary(list(ordered[["kind", "a", "b", "types"]].itertuples(index=False, name=None)))
        rows = [(project, part, n, label, None) for n, (labels, _) in state.items() for label in labels]
        rows += [(project, part, n, None, u) for n, (_, inputs) in state.items() for u in inputs if part]
        return pd.DataFrame(rows, columns=["project_id", "part", "node", "label", "input"])

    kind = marks.schema["project_id"].dataType.simpleString()
    parts = cut(facts.groupBy("project_id", "part").applyInPandas(run, f"project_id {kind}, part long, node string, label string, input string"))
    last = facts.agg(F.max("part")).first()[0] or 0
    while last:
        parts = cut(merged(parts))
        last >>= 1
    return parts.select("project_id", "node", "label")


def last_sources(marks: DataFrame, edges: DataFrame) -> DataFrame:
    """The source mark of each variable that has one behind its last cleaning of everything: marks' columns, one a variable."""
    place = F.struct("path", "seq")
    gone = steps(marks, edges).where(F.col("kind") == "sanitize").where(F.array_contains("types", "all"))
    gone = gone.groupBy("project_id", F.col("a").alias("var")).agg(F.max(place).alias("gone"))
    rows = marks.where("kind = 'source'").join(gone, ["project_id", "var"], "left").where(F.col("gone").isNull() | (F.col("gone") <= place))
    return first_wins(rows.drop("gone"), ["project_id", "var"], [F.col("path").desc(), F.col("seq").desc()])


def spread(tainted: DataFrame, closed: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(project_id, node): variables tainted after taint has run from the sources (project_id, node) along edges; it stops at
    variables that are tainted already and at `closed` ones. A frontier meets the edges until nothing is new."""
    seen = cut(tainted.select("project_id", "node").distinct())
    frontier = sources.select("project_id", "node").distinct()
    steps_ = edges.select("project_id", F.col("src").alias("node"), F.col("dst").alias("next"))
    while True:
        found = frontier.join(steps_, ["project_id", "node"]).select("project_id", F.col("next").alias("node")).distinct()
        found = found.join(closed.select("project_id", "node"), ["project_id", "node"], "left_anti")
        frontier = cut(found.join(seen, ["project_id", "node"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
