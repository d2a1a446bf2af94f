"""Stores, archives and streams: what is touched, what is left, and what comes out over several batches."""

import io
import os
import tarfile
import zipfile

from pyspark.sql import functions as F

from taintloom.operators import relational, report
from taintloom.sources import corpus
from taintloom.streaming import first_wins


def stamps(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_verdicts_and_deletes_touch_their_partitions_only(spark, tmp_path):
    path = str(tmp_path / "findings")
    rows = spark.createDataFrame([(k, f"p {k % 4}" if k % 4 else "a/b=c", None if k % 2 else "open", k, k) for k in range(40)], "finding_id long, project_id string, status string, line_number int, sink_line int")
    report.persist(rows.withColumns({"severity": F.lit("low"), "pipeline_stage": F.lit("ast")}), path)
    before = stamps(path)
    verdicts = spark.createDataFrame([(5, "p 1", "confirmed"), (9, "p 1", "false_positive"), (999, "p 1", "confirmed")], "finding_id long, project_id string, status string")
    report.store_verdicts(spark, path, verdicts)
    after = stamps(path)
    assert {f for f in before if after.get(f) == before[f]} == {f for f in before if "project_id=p 1" not in f and "p%201" not in f}
    got = {r.finding_id: r.status for r in spark.read.parquet(path).collect()}
    assert got == {k: {5: "confirmed", 9: "false_positive"}.get(k, "pending" if k % 2 else "open") for k in range(40)}
    assert report.delete_partitions(spark, path, spark.createDataFrame([("a/b=c",), ("none",)], "project_id string")) == 1
    left = spark.read.parquet(path)
    assert {r.project_id for r in left.select("project_id").distinct().collect()} == {"p 1", "p 2", "p 3"} and left.count() == 30


def packed(kind, texts):
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, t in texts.items():
                z.writestr(n, t)
    else:
        with tarfile.open(fileobj=out, mode=f"w:{kind}") as t:
            for n, x in texts.items():
                info = tarfile.TarInfo(n)
                info.size = len(x)
                t.addfile(info, io.BytesIO(x))
    return out.getvalue()


def test_members_come_in_frames_and_by_name(spark, monkeypatch):
    monkeypatch.setattr(corpus, "FRAME_BYTES", 10)
    texts = {f"d/{k}.{'py' if k % 2 else 'c'}": b"x" * k for k in range(9)}
    broken = bytearray(packed("zip", {"a.py": b"hello " * 100, "b.py": b"bye " * 100}))
    at = broken.index(b"b.py") + 10
    broken[at : at + 8] = b"\xff" * 8
    df = spark.createDataFrame([("a.zip", packed("zip", texts)), ("b.tar.bz2", packed("bz2", texts)), ("bad.zip", bytes(broken))], "path string, content binary")
    rows = corpus.unpacked(df).collect()
    for a in ("a.zip", "b.tar.bz2"):
        assert {r.name: bytes(r.content) for r in rows if r.archive == a} == texts
    assert [(r.name, r.fault is not None) for r in rows if r.archive == "bad.zip"] == [(None, True)]
    some = corpus.unpacked(df.where("path <> 'bad.zip'"), r"\.py$").collect()
    assert sorted(r.name for r in some) == sorted([n for n in texts if n.endswith("py")] * 2)


def run(spark, stream, out, check):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and not q.isActive


def test_first_wins_over_batches(spark, sf, tmp_path):
    """Events in three batches, each after the other, give the rows of the batch operator."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type", "event_id", "value")
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    n = events.count()
    for k in range(3):
        events.where((F.col("event_id") >= k * n // 3) & (F.col("event_id") < (k + 1) * n // 3)).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        run(spark, first_wins.first_wins(stream, ["user_id", "event_type"], ["event_id"]), out, check)
    want = relational.first_wins(events, ["user_id", "event_type"], ["event_id"])
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.select(*events.columns).collect()))


def test_keys_expire(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "k string, n long, at timestamp"
    day = lambda d: F.expr(f"timestamp'2024-01-01' + interval {d} days")
    for n, (k, d) in enumerate([("a", 0), ("a", 1), ("b", 9), ("a", 9), ("b", 10)]):
        spark.range(1).select(F.lit(k).alias("k"), F.lit(n).cast("long").alias("n"), day(d).alias("at")).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        run(spark, first_wins.first_wins(stream, ["k"], ["n"], "at", "2 days"), out, check)
    assert sorted((r.k, r.n) for r in spark.read.parquet(out).collect()) == [("a", 0), ("a", 3), ("b", 2)]


def test_first_hits_of_files_that_come_twice(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "project_id string, path string, language string, line_no int, code string"
    for code in (["exec(a)", "x = 1"], ["exec(a)", "os.system(b)"]):
        spark.createDataFrame([("p", "a.py", "python", k + 1, c) for k, c in enumerate(code)], schema).coalesce(1).write.mode("append").parquet(folder)
        run(spark, first_wins.first_hits(spark.readStream.schema(schema).parquet(folder)), out, check)
    assert sorted(r.line_no for r in spark.read.parquet(out).collect()) == [1, 2]
