"""Line rules over a folder that files arrive in: a micro-batch form of the rule scan (an extension of the batch engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from taintloom.operators import rules

FILES = "project_id string, path string, language string, text string"


def scan_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, most_files: int = 1000) -> StreamingQuery:
    """Scans new Parquet files of FILES rows as they arrive and appends hits to `out`.

    Lines and rule hits are stateless, so batches need no watermark. A batch that is run again after a failure overwrites
    its own folder (batch=<id>) instead of appending twice.
    """
    files = spark.readStream.schema(FILES).option("maxFilesPerTrigger", most_files).parquet(folder)
    lines = files.select("project_id", "path", "language", F.posexplode(F.split("text", "\n", -1)).alias("__p", "code")).select("project_id", "path", "language", (F.col("__p") + 1).alias("line_no"), "code")

    def store(batch: DataFrame, number: int) -> None:
        hits = rules.scan(batch).dropDuplicates(["project_id", "path", "line_no", "rule_id"])
        hits.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
