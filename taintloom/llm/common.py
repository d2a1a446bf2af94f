"""What the operators of this package share: the tokenizer folder, bounded memos, checkpoints and bounded cells."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's vocabulary file; the package that holds it is the only thing that knows it."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Keys of a table that may be broadcast after they are counted.
FEW = 20_000


class Memo(dict):
    """A word's value, made once by `make` and kept while there are at most `limit` words.

    It starts anew when it is full, so memory is bounded; a value never depends on what is kept.
    """

    def __init__(self, make: Callable, limit: int = 400_000) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value

    def make_room(self, more: int) -> None:
        if len(self) + more > self.limit:
            self.clear()


_HOLDERS: dict[str, Callable[[], None]] = {}


def sole_holder(name: str, clear: Callable[[], None]) -> None:
    """Python workers serve one operator after another; what an earlier one keeps in memos goes when the next begins."""
    for other in [n for n in _HOLDERS if n != name]:
        _HOLDERS.pop(other)()
    _HOLDERS[name] = clear


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "64m") -> None:
    """Whole texts can be long: Arrow batches of few rows and bytes bound what a Python worker holds.

    The settings are read when a plan runs, after the operator that built it has returned, so they can't be put back
    here; they stay with the session. A smaller number of rows that a user has set is kept.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    spark.conf.set(name, str(min(now, rows) if now > 0 else rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def free_name(columns: list[str], name: str) -> str:
    """`name`, with underscores before it until it is none of the columns."""
    while name in columns:
        name = "_" + name
    return name


def chunks(texts: list, chars: int = 8_000_000) -> Iterator[list]:
    """Runs of texts with at most `chars` characters together, or one longer text."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > chars:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local session may leave it unset, as in tests: its folder is then one
    of this machine, which on a cluster no other executor would see."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or os.path.join(tempfile.gettempdir(), "taintloom-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: its files are in spark.checkpoint.dir, which all executors share, so a lost executor
    costs no recomputation of what came before."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of rounds in the shared folder. Reading them back gives plans that know true sizes: a checkpoint keeps the
    size that was estimated for its plan, and a loop of joins multiplies such estimates until planning never ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.n = spark, 0
        self.folder = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def drop(self) -> None:
        remove(self.spark, self.folder)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop()


def in_task(rows: DataFrame, make: Callable[[list[dict]], object]) -> object:
    """What `make` gives for `rows`, a bounded sample, made in one task: the driver gets the result only, not the rows and
    what it takes to work on them, and a lost executor's task is run again."""

    def run(batches):
        got = [r for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(make(got))], pa.binary())], names=["made"])

    out = rows.repartition(1).mapInArrow(run, "made binary").first()
    return make([]) if out is None else pickle.loads(out["made"])


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(rows: DataFrame, table: DataFrame, key: list[str], weight: str, total: int, hot_keys: int = 20_000) -> DataFrame:
    """Inner join of `rows` with `table`, which holds each key once with the number of its rows in `weight`; `total` is the
    number of all rows. No key's rows meet in one task.

    A key with over total / hot_keys rows is hot, so there are fewer than `hot_keys` of those at any size: they are
    broadcast and meet their rows where these lie. Each other key has at most that share of the rows and is joined by a
    shuffle. `rows` is read twice, so it should be a table or a checkpoint.
    """
    bound = total / hot_keys
    hot = cut(table.where(F.col(weight) > bound).drop(weight))
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(table.where(F.col(weight) <= bound).drop(weight), key)
    return near.unionByName(far)


def cells(df: DataFrame, key: list[str], member: list[str], most: int) -> DataFrame:
    """Adds `cell_i` and `cell_j` so that every two rows of a key share a cell (key, cell_i, cell_j) and no cell has
    much more than 2 * most rows. Rows of a key with n <= most rows stay in the one cell (0, 0); larger keys are cut
    into b = ceil(n / most) blocks by a hash of `member`, and a block meets each other block in a cell of their own.
    """
    large = df.groupBy(*key).count().where(F.col("count") > most).withColumn("blocks", F.ceil(F.col("count") / F.lit(most)).cast("int")).drop("count")
    large = cut(large)
    n = large.count()
    if not n:
        return df.withColumns({c: F.lit(0) for c in ("own_block", "cell_i", "cell_j")})
    b = F.coalesce(F.col("blocks"), F.lit(1))
    own = F.pmod(F.xxhash64(F.lit(7), *member), b).cast("int")
    met = df.join(F.broadcast(large) if n <= FEW else large, key, "left").withColumn("own_block", own).withColumn("met", F.explode(F.sequence(F.lit(0), b - 1)))
    return met.withColumn("cell_i", F.least("own_block", "met")).withColumn("cell_j", F.greatest("own_block", "met")).drop("blocks", "met")
