"""Relational operators of the analysis: first-wins dedup, keyed unions, band and interval joins, suffix and pattern joins.

Order matters to first-wins rules and a DataFrame has none, so every operator takes the columns that order rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key. Spark limits each group to one row before the shuffle, so hot keys stay small."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def supplement(existing: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """`existing` and those rows of `more` whose key isn't among its keys; null key parts compare as equal. Columns that
    one side lacks become null."""
    keys = existing.select(*(F.col(k).alias(f"__{k}") for k in key)).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    cond = on[0]
    for c in on[1:]:
        cond &= c
    return existing.unionByName(more.join(keys, cond, "left_anti"), allowMissingColumns=True)


def without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Set difference by key: the distinct keys of `rows` that `gone` hasn't; nulls are equal."""
    return rows.select(*key).subtract(gone.select(*key))


def band_covered(rows: DataFrame, spots: DataFrame, key: list[str], line: str, spot_line: str, width: int) -> DataFrame:
    """Adds boolean `covered`: some spot of the same key lies within `width` lines.

    Whether a row is covered depends on its key and line only, so each of those is looked up once. Lines fall into
    buckets of `width` + 1 and a line looks into three of them: an equi-join on (key, bucket) instead of a join of all
    lines of a key with each other.
    """
    size = width + 1
    bucket = F.floor(F.col(line) / size).cast("long")
    probes = rows.select(*key, line).distinct().withColumn("__bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    near = spots.select(*key, F.col(spot_line).alias("__at"), F.floor(F.col(spot_line) / size).cast("long").alias("__bucket")).distinct()
    hit = probes.join(near, [*key, "__bucket"]).where(F.abs(F.col(line) - F.col("__at")) <= width).select(*key, line).distinct().withColumn("__hit", F.lit(True))
    return rows.join(hit, [*key, line], "left").withColumn("covered", F.coalesce("__hit", F.lit(False))).drop("__hit")


def proximity_first(a: DataFrame, b: DataFrame, key: list[str], at: str, width: int) -> DataFrame:
    """Per key the smallest place of `a` that has a place of `b` within `width`: (key, at). Equi-join on buckets."""
    size = width + 1
    bucket = F.floor(F.col(at) / size).cast("long")
    left = a.select(*key, at, F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__bucket"))
    right = b.select(*key, F.col(at).alias("__b"), bucket.alias("__bucket")).distinct()
    near = left.join(right, [*key, "__bucket"]).where(F.abs(F.col(at) - F.col("__b")) <= width)
    return near.groupBy(*key).agg(F.min(at).alias(at))


def whole_number(c: Column, kind: str) -> Column:
    """A long that keeps the order of numbers, dates and times (numbers and times are rounded down)."""
    if kind == "date":
        return F.unix_date(c).cast("long")
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    return F.floor(c).cast("long")


def within_spans(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str) -> DataFrame:
    """Inner join of points with the spans of their key that hold them (start <= at <= end), on numbers, dates or times.

    A span belongs to the size class 2^k that is its length or more, and covers at most two blocks of that width. A point
    looks into one block of each class that occurs (at most 64, counted first), so it is an equi-join on (key, class,
    block) whose pairs are bounded by those of spans near the point, not by all spans of its key. A key with very many
    spans and points is dealt out by blocks. Spans with a null bound or that end before they start hold nothing.
    """
    kind = lambda df, c: df.schema[c].dataType.typeName()
    low, high = whole_number(F.col(start), kind(spans, start)), whole_number(F.col(end), kind(spans, end))
    wide = F.try_subtract(F.col("__high"), F.col("__low"))
    size = F.when(wide == 0, 0).otherwise(F.coalesce(F.length(F.bin(wide)), F.lit(63))).cast("int")  # binary digits
    block = lambda c, k: F.shiftright(c, k) if isinstance(k, int) else F.call_function("shiftright", c, k)
    held = spans.where(F.col(start) <= F.col(end)).withColumns({"__low": low, "__high": high}).withColumn("__k", size)
    held = held.withColumn("__block", F.explode(F.array_distinct(F.array(block(F.col("__low"), F.col("__k")), block(F.col("__high"), F.col("__k")))))).drop("__low", "__high")
    sizes = sorted(r[0] for r in held.select("__k").distinct().collect())
    if not sizes:
        return points.join(spans, key).where("1 = 0")
    p = whole_number(F.col(at), kind(points, at))
    places = F.array(*(F.struct(F.lit(k).alias("__k"), block(p, k).alias("__block")) for k in sizes))
    asked = points.where(F.col(at).isNotNull()).withColumn("__place", F.explode(places)).select(*points.columns, "__place.*")
    met = asked.join(held, [*key, "__k", "__block"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    return met.drop("__k", "__block")


#: Rows of a key that one task orders; keys with more are dealt over KEY_BLOCKS blocks of their range.
KEY_ROWS, KEY_BLOCKS = 1_000_000, 64


def counted_within_spans(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, by: list[str], name: str = "n") -> DataFrame:
    """(by, name): for each value of `by`, columns of `spans`, how many pairs `within_spans` has, where it has any; no pair is made.

    Points up to a span's end less those before its start: a running count over points and bounds of a key in order, so
    each row is shuffled once, whatever the spans' lengths. Keys with more than KEY_ROWS rows (counted first; there are few at
    any size) are dealt out by blocks of their range, to which the points of the blocks before are added.
    """
    ids = [f"__by{k}" for k in range(len(by))]
    held = spans.where(F.col(start) <= F.col(end)).select(*key, F.explode(F.array(*(F.struct(F.col(c).alias("at"), F.lit(k).alias("kind")) for c, k in ((start, 0), (end, 2))))).alias("__e"), *(F.col(b).alias(i) for b, i in zip(by, ids, strict=True)))
    bounds = held.select(*key, F.col("__e.at").alias("__at"), F.col("__e.kind").alias("__kind"), *ids)
    places = points.where(F.col(at).isNotNull()).select(*key, F.col(at).alias("__at"), F.lit(1).alias("__kind"))
    rows = places.unionByName(bounds, allowMissingColumns=True).dropna(subset=key)
    v = whole_number(F.col("__at"), rows.schema["__at"].dataType.typeName())
    large = rows.groupBy(*key).agg(F.count("*").alias("__n"), F.min(v).alias("__low"), F.max(v).alias("__high")).where(F.col("__n") > KEY_ROWS)
    large = [tuple(r) for r in large.select(*key, "__low", F.floor((F.col("__high") - F.col("__low")) / KEY_BLOCKS + 1).alias("__width")).collect()]
    is_point, block = (F.col("__kind") == 1).cast("long"), F.lit(0)
    if large:
        known = F.broadcast(rows.sparkSession.createDataFrame(large, ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key), "__low long", "__width long"])))
        rows, block = rows.join(known, key, "left"), F.coalesce(F.floor((v - F.col("__low")) / F.col("__width")), F.lit(0))
    rows = rows.withColumn("__block", block.cast("long"))
    order = Window.partitionBy(*key, "__block").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("__seen", F.sum(is_point).over(order)).where("__kind <> 1")
    if large:
        sums = rows.where(F.col("__width").isNotNull()).groupBy(*key, "__block").agg(F.sum(is_point).alias("__n"))
        before = F.sum("__n").over(Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
        seen = seen.join(F.broadcast(sums.select(*key, "__block", before.alias("__before"))), [*key, "__block"], "left").withColumn("__seen", F.col("__seen") + F.coalesce("__before", F.lit(0)))
    counted = seen.groupBy(*ids).agg(F.sum(F.when(F.col("__kind") == 2, F.col("__seen")).otherwise(-F.col("__seen"))).alias(name))
    return counted.where(F.col(name) > 0).select(*(F.col(i).alias(b) for b, i in zip(by, ids, strict=True)), name)


def longest_suffix(rows: DataFrame, suffixes: DataFrame | list[tuple[str, int]], text: str, suffix: str, order: str = "", most: int = 0) -> DataFrame:
    """Left join of each row with the longest suffix that its text ends with; ties go to the smaller `order`.

    A list of (suffix, order) is a literal that each row searches, without a join. A table of any size is an equi-join: a
    text gives as many keys as suffixes have lengths (the lengths are collected; there are few of them at any number of
    suffixes), each the end of the text of that length. Texts are looked up once each, and the best is a minimum, summed
    map-side. Null texts and texts without a suffix get null; null suffixes are none. most: tables of at most so many rows,
    which are counted, are searched as a literal instead, with the same rows.
    """
    if most and not isinstance(suffixes, list):
        few = suffixes.where(F.col(suffix).isNotNull()).select(suffix, order).limit(most + 1).collect()
        suffixes = [tuple(r) for r in few] if len(few) <= most else suffixes
    if isinstance(suffixes, list):
        ranked = sorted(suffixes, key=lambda r: (-len(r[0]), r[1]))
        found = F.filter(F.array(*(F.lit(s) for s, _ in ranked)), lambda s: F.endswith(F.col(text), s)) if ranked else F.array().cast("array<string>")
        return rows.withColumn(suffix, F.get(found, F.lit(0)))
    table = suffixes.where(F.col(suffix).isNotNull()).groupBy(F.col(suffix).alias("__s")).agg(F.min(order).alias("__o"))
    lengths = sorted(r[0] for r in table.select(F.length("__s")).distinct().collect())
    ends = F.array_compact(F.array(*(F.when(F.length(text) >= n, F.right(F.col(text), F.lit(n))) for n in lengths))) if lengths else F.array().cast("array<string>")
    keys = rows.select(text).where(F.col(text).isNotNull()).distinct().withColumn("__s", F.explode(ends))
    best = keys.join(table, "__s").groupBy(text).agg(F.min_by("__s", F.struct(-F.length("__s"), F.col("__o"))).alias(suffix))
    return rows.join(best, text, "left")


def lines(files: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, line_no from 1, code) of every line; the text itself goes no further."""
    return files.select(*key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("__pos", "code")).select(*key, (F.col("__pos") + 1).alias("line_no"), "code")


def pattern_hits(rows: DataFrame, rules: list[tuple[str, str]], text: str = "code") -> DataFrame:
    """Rows with the first rule (id, Java regular expression) that their text holds, as `rule_id`; others go.

    Rules are literals: one alternation filters lines first, then a `coalesce` chain finds the first rule of the hits.
    Nothing is joined, and all of it stays in generated code.
    """
    any_rule = "|".join(f"(?:{p})" for _, p in rules)
    first = F.coalesce(*(F.when(F.col(text).rlike(p), F.lit(r)) for r, p in rules))
    return rows.where(F.col(text).rlike(any_rule)).withColumn("rule_id", first)


def rule_join(rows: DataFrame, rules: DataFrame | list[tuple[str, str]], text: str = "code") -> DataFrame:
    """Every (row, rule) pair whose pattern the text holds. Rules of a list (rule_id, pattern) are literals: one alternation
    filters rows, and each that is left gives its rules as an array. A table (with `pattern`) goes by `literals.indexed_join`."""
    if not isinstance(rules, list):
        from .literals import indexed_join

        return indexed_join(rows, rules, text)
    any_rule = "|".join(f"(?:{p})" for _, p in rules)
    held = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.lit(r)) for r, p in rules)))
    return rows.where(F.col(text).rlike(any_rule)).withColumn("rule_id", F.explode(held))


def blocks(rows: DataFrame, key: list[str], starts: Column, line: str = "line_no", whole: bool = True) -> DataFrame:
    """(key, block_start, block_end): from each line that starts a block to the line before the next one, or the last line. A
    key without a start is one block, or none if not `whole`."""
    last = rows.groupBy(*key).agg(F.max(line).alias("__last"), F.min(line).alias("__first"))
    begun = rows.where(starts).select(*key, F.col(line).alias("block_start")).withColumn("__next", F.lead("block_start").over(Window.partitionBy(*key).orderBy("block_start")))
    some = last.join(begun, key, "left" if whole else "inner")
    return some.select(*key, F.coalesce("block_start", "__first").alias("block_start"), F.coalesce(F.col("__next") - 1, "__last").alias("block_end"))


def brace_blocks(rows: DataFrame, key: list[str], starts: Column, line: str = "line_no", code: str = "code") -> DataFrame:
    """(key, block_start, block_end) in languages with braces: a block runs from a line that starts one to the line before the
    next, if all braces since its start are closed there; the last block runs to the last line. Closing braces without an
    opening one don't count. A key without a start is one block."""
    at = Window.partitionBy(*key).orderBy(line)
    braces = F.length(F.regexp_replace(code, r"[^{]", "")) - F.length(F.regexp_replace(code, r"[^}]", ""))
    counted = rows.select(*key, line, starts.alias("__start"), braces.alias("__b")).withColumn("__block", F.sum(F.col("__start").cast("int")).over(at))
    inside = Window.partitionBy(*key, "__block").orderBy(line)
    depth = counted.withColumn("__s", F.sum("__b").over(inside)).withColumn("__d", F.col("__s") - F.least(F.lit(0), F.min("__s").over(inside)))
    each = depth.groupBy(*key, "__block").agg(F.min(line).alias("block_start"), F.max(line).alias("block_end"), F.max_by("__d", line).alias("__d"))
    last = F.max("__block").over(Window.partitionBy(*key))
    return each.withColumn("__last", last).where(((F.col("__block") > 0) & ((F.col("__d") == 0) | (F.col("__block") == F.col("__last")))) | (F.col("__last") == 0)).select(*key, "block_start", "block_end")


def first_found(rows: DataFrame, lookups: list[tuple[DataFrame, list[str], str]], name: str, default: Column | None = None) -> DataFrame:
    """Adds `name`: the value of the first of several lookups (table with unique keys, keys, value) that has one."""
    found = []
    for k, (table, keys, value) in enumerate(lookups):
        rows = rows.join(table.select(*keys, F.col(value).alias(f"__v{k}")), keys, "left")
        found.append(F.col(f"__v{k}"))
    out = rows.withColumn(name, F.coalesce(*found, *([default] if default is not None else [])))
    return out.drop(*(f"__v{k}" for k in range(len(lookups))))


def with_first(rows: DataFrame, table: DataFrame, value: str, name: str) -> DataFrame:
    """Adds `name`: the smallest `value` of a table, on every row. A join with an aggregate, which is one row."""
    return rows.crossJoin(F.broadcast(table.agg(F.min(value).alias(name))))


def by_position(left: DataFrame, right: DataFrame, key: list[str], args: str, params: str) -> DataFrame:
    """(key, pos, src, dst): elements of two arrays that meet by key and position; both sides are exploded with their
    positions, so it is an equi-join."""
    a = left.select(*key, F.posexplode(args).alias("pos", "src"))
    b = right.select(*key, F.posexplode(params).alias("pos", "dst"))
    return a.join(b, [*key, "pos"]).select(*key, "pos", "src", "dst")


def has_flag(rows: DataFrame, key: str, condition: Column, name: str = "has_flag") -> DataFrame:
    """(key, flag): does any row of the key meet the condition? Partial sums make it one small row per key and task."""
    return rows.groupBy(key).agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias(name))


def running_state(rows: DataFrame, key: str, order: str, opens: Column, closes: Column) -> DataFrame:
    """Adds `inside`: openings so far, this row's too, minus closings before this row, are over zero."""
    w = Window.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    o, c = F.sum(opens.cast("int")).over(upto), F.coalesce(F.sum(closes.cast("int")).over(before), F.lit(0))
    return rows.withColumn("inside", (o - c) > 0)
