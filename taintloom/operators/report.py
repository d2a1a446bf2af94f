"""Listings, filters, counts and sinks over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taintloom.functions.catalog import severity_rank

from .graph import cut

# Defaults of a stored finding.
DEFAULTS = {"severity": "medium", "pipeline_stage": "taint", "status": "pending"}


def optional_filter(rows: DataFrame, **wanted: object) -> DataFrame:
    """Equality on every column whose value is given; None and the empty string are not given."""
    for name, value in wanted.items():
        if value is not None and value != "":
            rows = rows.where(F.col(name) == F.lit(value))
    return rows


def analysed(rows: DataFrame, column: str, yes: bool = True) -> DataFrame:
    return rows.where(F.col(column).isNotNull() if yes else F.col(column).isNull())


def ranked(rows: DataFrame, severity: str = "severity", line: str = "line_number", tie: tuple[str, ...] = ("finding_id",)) -> DataFrame:
    """Findings by severity rank, line and a unique tie-break."""
    return rows.orderBy(severity_rank(F.col(severity)), F.col(line), *tie)


def top_with_total(rows: DataFrame, order: list[str | Column], most: int) -> DataFrame:
    """The first `most` rows and, on each, how many there are in all: the limit is the listing's, the total counts all."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(most).join(F.broadcast(total))


def counts(rows: DataFrame, key: list[str], **conditions: Column) -> DataFrame:
    """Rows and rows that meet each condition, per key (no key: one row)."""
    aggs = [F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in conditions.items())]
    return rows.groupBy(*key).agg(*aggs) if key else rows.agg(*aggs)


def most_common(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most frequent value per key, the smaller one of equals, with its count."""
    n = rows.groupBy(*key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key).orderBy(F.desc("n"), value)
    return n.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def stored(findings: DataFrame) -> DataFrame:
    """Findings with the defaults that storing fills in; the line falls back to the sink's line."""
    out = findings
    for name, value in DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out.withColumn("line_number", F.coalesce(F.nullif(F.col("line_number"), F.lit(0)), F.col("sink_line"), F.lit(0)))


def persist(findings: DataFrame, path: str, partition: str = "project_id") -> None:
    """Appends findings to a table of Parquet files, a folder for each project. Spark's commit protocol replaces retries."""
    stored(findings).write.mode("append").partitionBy(partition).parquet(path)


def replace_partitions(rows: DataFrame, path: str, partition: str = "project_id") -> None:
    """Writes rows over the folders of the partitions that they have; others aren't touched. The rows may come from the table
    itself: they are checkpointed before it is written."""
    cut(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def store_verdicts(spark: SparkSession, path: str, verdicts: DataFrame, key: str = "finding_id", partition: str = "project_id") -> None:
    """Verdicts (key, partition, columns) put into the stored findings that have their key. Only the partitions that verdicts
    name are read (their values prune the scan as the join runs) and written; verdicts that find nothing change nothing."""
    stored_rows = spark.read.parquet(path)
    touched = verdicts.select(partition).distinct()
    mine = stored_rows.join(touched, partition, "left_semi")
    judged = with_verdicts(mine, verdicts.drop(partition), key)
    replace_partitions(judged.select(*stored_rows.columns), path, partition)


def delete_partitions(spark: SparkSession, path: str, gone: DataFrame, partition: str = "project_id") -> int:
    """Deletes the folders of the partitions that `gone` names, and gives their number: no other file is read or written."""
    files = spark.read.parquet(path).select(partition, F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).distinct()
    folders = files.join(gone.select(partition).distinct(), partition, "left_semi").select("folder").distinct()
    found = [r["folder"] for r in folders.collect()]  # one for each deleted project
    for folder in found:
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(found)


def with_verdicts(findings: DataFrame, verdicts: DataFrame, key: str = "finding_id") -> DataFrame:
    """Verdict columns of the report that has the finding's key; findings without one keep theirs."""
    fresh = [c for c in verdicts.columns if c != key]
    joined = findings.join(verdicts.select(key, *(F.col(c).alias(f"__{c}") for c in fresh)), key, "left")
    for c in fresh:
        joined = joined.withColumn(c, F.coalesce(F.col(f"__{c}"), F.col(c)) if c in findings.columns else F.col(f"__{c}")).drop(f"__{c}")
    return joined


def without_projects(rows: DataFrame, gone: DataFrame, key: str = "project_id") -> DataFrame:
    """Cascading delete: rows whose project isn't among those deleted."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def as_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(F.to_json(F.struct(*columns)).alias("json"))


def replaced_lines(lines: DataFrame, path: object, first: int, last: int, code: list[str]) -> DataFrame:
    """A file's lines first..last replaced, numbered anew; other files are untouched, and so is one without line `first`.
    path None: in every file. Nothing is written."""
    shift = len(code) - (last - first + 1)
    here = F.lit(True) if path is None else F.col("path") == F.lit(path)
    keys = [c for c in lines.columns if c not in ("line_no", "code")]
    kept = lines.where(~here | ~F.col("line_no").between(first, last))
    moved = kept.withColumn("line_no", F.when(here & (F.col("line_no") > last), F.col("line_no") + shift).otherwise(F.col("line_no")))
    if not code:
        return moved
    new = lines.where(here & (F.col("line_no") == first)).select(*keys, F.posexplode(F.array(*(F.lit(c) for c in code))).alias("__p", "code"))
    new = new.withColumn("line_no", (F.col("__p") + first).cast("int")).drop("__p")
    return moved.unionByName(new)


def region(lines: DataFrame, path: object, first: int, last: int) -> DataFrame:
    """A file's lines first..last as `   n | code`; path None: every file's."""
    here = F.lit(True) if path is None else F.col("path") == F.lit(path)
    part = lines.where(here & F.col("line_no").between(first, last))
    return part.select("path", "line_no", F.format_string("%4d | %s", F.col("line_no"), F.col("code")).alias("shown"))


def context(lines: DataFrame, findings: DataFrame, around: int) -> DataFrame:
    """(finding_id, line_no, code, tag): lines within `around` of a finding's source or sink line, tagged SOURCE or SINK;
    SOURCE wins where both are one line."""
    spots = findings.select("finding_id", F.col("file_path").alias("path"), "source_line", "sink_line")
    low, high = F.least("source_line", "sink_line") - around, F.greatest("source_line", "sink_line") + around
    near = spots.withColumn("line_no", F.explode(F.sequence(F.greatest(low, F.lit(1)), F.greatest(high, F.lit(1)))))
    near = near.where((F.abs(F.col("line_no") - F.col("source_line")) <= around) | (F.abs(F.col("line_no") - F.col("sink_line")) <= around))
    tag = F.when(F.col("line_no") == F.col("source_line"), "SOURCE").when(F.col("line_no") == F.col("sink_line"), "SINK")
    return near.withColumn("line_no", F.col("line_no").cast("int")).join(lines, ["path", "line_no"]).select("finding_id", "line_no", "code", tag.alias("tag"))


def scores(findings: DataFrame, truth: DataFrame, tolerance: int = 10) -> DataFrame:
    """(tp, fp, labels, trap_hits, precision, recall, f2): a label is found by a finding in its file with one of its
    weakness numbers within `tolerance` lines; a finding that meets no true label is false.

    truth: label_id, file_path, line_start, line_end, cwes array<string>, is_trap. findings: finding_id, file_path,
    line_number, cwe. The join's keys are file and weakness number, so lines are compared within those only.
    """
    labels = truth.select("label_id", "file_path", "line_start", "line_end", F.explode("cwes").alias("cwe"), "is_trap")
    near = F.col("line_number").between(F.col("line_start") - tolerance, F.col("line_end") + tolerance)
    met = findings.select("finding_id", "file_path", "line_number", "cwe").join(labels, ["file_path", "cwe"]).where(near)
    found = met.where(~F.col("is_trap")).agg(F.countDistinct("label_id").alias("tp"), F.countDistinct("finding_id").alias("good"))
    traps = met.where("is_trap").agg(F.countDistinct("finding_id").alias("trap_hits"))
    total = findings.agg(F.countDistinct("finding_id").alias("n"))
    wanted = truth.where(~F.col("is_trap")).agg(F.countDistinct("label_id").alias("labels"))
    parts = found.unionByName(traps, True).unionByName(total, True).unionByName(wanted, True)  # four rows
    one = parts.agg(*(F.max(c).alias(c) for c in ("tp", "good", "trap_hits", "n", "labels")))
    fp = F.col("n") - F.col("good")
    p, r = F.col("tp") / F.nullif(F.col("tp") + fp, F.lit(0)), F.col("tp") / F.nullif(F.col("labels"), F.lit(0))
    return one.select("tp", fp.alias("fp"), "labels", "trap_hits", p.alias("precision"), r.alias("recall"), (5 * p * r / F.nullif(4 * p + r, F.lit(0.0))).alias("f2"))


def listed_files(files: DataFrame, key: list[str], path: str = "path", most: int = 200) -> DataFrame:
    """(key, ext, n_files, files): files by suffix with the first `most` of their names; the limit is the listing's, the number
    counts all. Names are cut per task before they meet, so no suffix's files are collected."""
    ext = F.lower(F.regexp_extract(path, r"\.[^./]*$", 0)).alias("ext")
    rows = files.select(*key, ext, F.col(path).alias("__path"))
    n = rows.groupBy(*key, "ext").agg(F.count("*").alias("n_files"))
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key, "ext").orderBy("__path"))).where(F.col("__r") <= most)
    shown = first.groupBy(*key, "ext").agg(F.array_sort(F.collect_list("__path")).alias("files"))
    return n.join(shown, [*key, "ext"])


def resolved_paths(asked: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(asked, path): the file that each asked path means: the path itself, else below `root`, else the first file in order
    that ends with it, in lower case and with forward slashes. Three lookups; the last is an equi-join on ends of paths,
    of the lengths that were asked."""
    from .relational import first_found, first_wins

    plain = lambda c: F.lower(F.replace(c, F.lit("\\"), F.lit("/")))
    want = asked.select("asked").distinct().withColumn("__below", F.concat(F.lit(root.rstrip("/") + "/"), F.ltrim(F.col("asked"), F.lit("/")))).withColumn("__end", plain(F.col("asked")))
    known = files.select("path").distinct()
    lengths = want.select(F.length("__end").alias("__n")).distinct().where("__n > 0")
    ends = known.join(lengths, F.length("path") >= F.col("__n")).select("path", F.right(plain(F.col("path")), F.col("__n")).alias("__end"))
    ends = first_wins(ends.join(want.select("__end").distinct(), "__end", "left_semi"), ["__end"], ["path"])
    exact = known.select(F.col("path").alias("asked"), F.col("path").alias("p"))
    below = known.select(F.col("path").alias("__below"), F.col("path").alias("p"))
    return first_found(want, [(exact, ["asked"], "p"), (below, ["__below"], "p"), (ends.withColumnRenamed("path", "p"), ["__end"], "p")], "path").select("asked", "path")


def normalised(path: Column) -> Column:
    """An absolute path without `.`, `..` and empty parts; `..` at the root stays there. Backslashes are slashes."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    step = lambda kept, x: F.when(x.isin("", "."), kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, x))
    return F.aggregate(parts, F.array().cast("array<string>"), step, lambda kept: F.concat(F.lit("/"), F.array_join(kept, "/")))


def contained(asked: DataFrame, files: DataFrame, root: str, column: str = "asked") -> DataFrame:
    """`asked` with `path`, the normalised path that may be read, and `fault`: why none may (`empty`; `outside` of the root
    once `..` is resolved; `missing`, no file of `files` (path) is there), or null. Paths are text here: links of a file
    system aren't followed. Files are looked up by an equi-join."""
    base = "/" + "/".join(p for p in root.split("/") if p)
    clean = F.when(F.coalesce(F.col(column), F.lit("")) != "", normalised(F.col(column)))
    known = files.select(normalised(F.col("path")).alias("__path")).distinct().withColumn("__there", F.lit(True))
    met = asked.withColumn("__path", clean).join(known, "__path", "left")
    inside = (F.col("__path") == base) | F.startswith(F.col("__path"), F.lit(base.rstrip("/") + "/"))
    fault = F.when(F.col("__path").isNull(), "empty").when(~inside, "outside").when(F.col("__there").isNull(), "missing")
    return met.withColumn("fault", fault).withColumn("path", F.when(F.col("fault").isNull(), F.col("__path"))).drop("__path", "__there")


#: Files that an answer may quote beside a finding's own, headers of an answer that are shown.
MOST_FILES, MOST_HEADERS = 3, 10
NAMED_FILE = r"([\w./-]+\.(?:php|py|c|cpp|h))\b"


def referenced_files(findings: DataFrame, files: DataFrame, root: str, most: int = MOST_FILES) -> DataFrame:
    """(finding_id, path): the files that a finding's flow or sink names, below the root or else beside the finding's file, but
    for its own source and sink files: the first `most` by name (the listing's limit). Names meet files by equi-joins."""
    text = F.concat_ws("\n", "data_flow", "sink_code")
    named = findings.select("finding_id", "file_path", "source_file", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(NAMED_FILE), F.lit(1)))).alias("name"))
    folder = F.regexp_replace("file_path", "/?[^/]*$", "")
    tried = named.select("*", F.posexplode(F.array(normalised(F.concat(F.lit(root + "/"), "name")), normalised(F.concat(folder, F.lit("/"), "name")))).alias("place", "path"))
    there = tried.join(files.select("path").distinct(), "path")
    first = there.groupBy("finding_id", "name").agg(F.min_by(F.struct("path", "file_path", "source_file"), "place").alias("f")).select("finding_id", "f.*")
    other = first.where(~F.col("path").eqNullSafe(F.col("file_path")) & ~F.col("path").eqNullSafe(F.col("source_file"))).select("finding_id", "path").distinct()
    order = Window.partitionBy("finding_id").orderBy("path")
    return other.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def first_entries(entries: Column, most: int = MOST_HEADERS) -> Column:
    """A map's first entries."""
    return F.map_from_entries(F.slice(F.map_entries(entries), 1, most))


def parse_failures(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text, failed_at): answers that hold no JSON even after repair; append them to a table with `append_failures`."""
    from taintloom.functions.text import json_repair

    bad = answers.where(F.col(text).isNotNull() & (F.col(text) != "")).withColumn("__json", json_repair(F.col(text))).where("__json is null")
    return bad.select(key, F.col(text).alias("text"), F.current_timestamp().alias("failed_at"))


def append_failures(failures: DataFrame, path: str) -> None:
    failures.write.mode("append").parquet(path)
