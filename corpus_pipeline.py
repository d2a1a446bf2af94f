"""The training-data pipeline: toxicity, language ID, SimHash near-dedup, substring dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs. All
but the last return the columns of `documents`, and those that `docs` has beside them. For all stages: rows that repeat a
key are one document, rows without a key are judged by their text alone, and an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintloom.llm import langcrf, linededup, packing, simhash, toxicity
from taintloom.llm.common import remove, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go. Null and empty texts stay, and so does everything if `labels`
    has not both classes; equal texts are judged alike, repeated rows each by themselves."""
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), on_executor=True)
    return _same_columns(docs, lambda d: toxicity.toxicity(d, chain).where(~F.col("toxic")))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.35) -> DataFrame:
    """Documents without a letter (null and empty texts too), or whose most likely language has a mean marginal below
    `least`, go. Without any language to learn from all go, since none can be identified. Ties of languages go to the
    first name; repeated rows are judged each by themselves."""
    model = langcrf.fit(docs, on_executor=True)
    return _same_columns(docs, lambda d: langcrf.identified(d, model).where((F.col("lang_pred") != "und") & (F.col("lang_score") >= least)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or similar texts (five words, 0.8) the document with the smallest doc_id stays, with all its
    rows. Null, empty and blank texts and rows without a doc_id stay: they are copies of nothing."""
    copies = simhash.near_copies(docs).where("doc_id <> root").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and passages that stand earlier in the corpus are cut out of the texts; n_chars follows. Every row stays, null
    texts as they are (with a null n_chars), texts that repeat whole as empty ones."""
    cut = _same_columns(docs, linededup.deduplicated)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's text (null: empty) as pieces with their sequences; see `packing.packed_documents`."""
    return packing.packed_documents(docs)


def _same_columns(docs: DataFrame, stage) -> DataFrame:
    """A stage's rows with all columns of `docs`: those that an operator could make itself have other names in it."""
    own = ("doc_id", "text", "lang", "source", "n_chars")
    names = {c: c if c in own else f"__of_docs_{k}" for k, c in enumerate(docs.columns)}
    out = stage(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())))
    return out.select(*(F.col(n).alias(c) for c, n in names.items()))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the models and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder and read again. A stage's table goes when the next
    one's is written, or if a stage fails; the last is the result."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    done = None
    try:
        for k, (name, stage) in enumerate(STAGES):
            path = f"{folder}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if done is not None:
                remove(spark, done)
            done = path
    except BaseException:
        remove(spark, folder)
        raise
    return docs
