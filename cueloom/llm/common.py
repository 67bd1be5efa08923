"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir.

    A local session (one machine, as in tests) that names none gets one folder of its own; any other
    is told to name one, as a machine's own folder wouldn't be seen by its executors.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
        root = context.getCheckpointDir()
    path = f"{root.rstrip('/')}/cueloom-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Paths given out by shared_dir() that clearing() or clear() hasn't deleted.
_made: list[str] = []


def clear(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the tables that settled() has written, once no DataFrame that reads them is in use any more."""
    context = spark.sparkContext
    for path in [p for p in _made[since:] if p not in keep]:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        _made.remove(path)


@contextmanager
def clearing(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what settled() and shared_dir() made inside, but for the last table: the result, settled."""
    since = len(_made)
    yield _made
    clear(spark, since, tuple(_made[-1:]))


def settled(df: DataFrame, parts: int | None = None) -> DataFrame:
    """df, written as Parquet (by `parts` tasks at most) to the shared folder and read again: a short lineage that outlives executors."""
    path = shared_dir(df.sparkSession)
    df = df.coalesce(parts) if parts else df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most bytes of rows that small_batches() has handed to Python at a time (one row at least).
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of BATCH_BYTES at most: a batch is held by the JVM and by the Python worker, twice over while it grows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Gives memory that this process has freed back to the machine: Python workers are used again by later stages, and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


#: A key counts as frequent from this number of rows, and from this share of all rows, so that frequent keys are few (SHARE at most).
HOT_ROWS, HOT_SHARE = 64, 20_000


def frequent_keys(rows: DataFrame, *keys: str, n: int | None = None, size: str | None = None, bound: int | None = None) -> DataFrame | None:
    """__key, __salts of the values of these columns in more than `bound` rows (by default a HOT_SHARE-th of n, or of all, if n isn't given), and over how many salts each is to be dealt; None if there is none.

    With `size` rows has a row for each key and that column says how many it stands for. Keys are
    counted by partial sums on the map side. len(keys) * HOT_SHARE rows at most, or as many as `bound`
    allows, which are broadcast.
    """
    bound = bound or max(HOT_ROWS, (rows.count() if n is None else n) // HOT_SHARE)
    many = F.sum(size) if size else F.count("*")
    key = F.explode(F.array(*keys)) if len(keys) > 1 else F.col(keys[0])
    hot = rows.select(key.alias("__key"), *filter(None, [size])).groupBy("__key").agg(many.alias("__n")).where(F.col("__n") > bound)
    found = hot.select("__key", F.ceil(F.col("__n") / bound).cast("int").alias("__salts"))
    some = found.collect()
    return F.broadcast(rows.sparkSession.createDataFrame(some, found.schema)) if some else None


def spread_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """many joined with one (a row for each key at most), where no frequent key's rows lie in one task.

    hot (frequent_keys() of many or of a table that it is a part of): rows of these keys are dealt
    over several tasks by a salt, and one's rows for them are repeated for each.
    """
    if hot is None:
        return many.join(one, key, how)
    salts = F.coalesce(F.col("__salts"), F.lit(1))
    of = lambda side: side.join(hot, side[key] == hot["__key"], "left")
    left = of(many).withColumn("__salt", F.pmod(F.xxhash64(*many.columns), salts).cast("int")).drop("__key", "__salts")
    right = of(one).withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__key", "__salts")
    return left.join(right, [key, "__salt"], how).drop("__salt")


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with pos, each row's place (from 0) in its group by `order` (nulls first), and n, the size of the group; null is a group of its own.

    All rows are sorted by ranges of (group, order), so that a large group lies in many tasks; where
    its part in each task begins follows from counts. rows should be a written table, as it is sampled first.
    """
    keys = [*group, *order]
    placed = settled(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()))
    task = F.shiftright("__id", 33)
    runs = placed.groupBy(*group, task.alias("__task")).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = settled(runs.select(*(F.col(g).alias(f"__{g}") for g in group), "__task", "__first", before.alias("__before"), F.sum("__n").over(whole).alias("n")))  # a row for each group and task
    few = F.broadcast(runs) if runs.count() <= BROADCAST_IDS // 16 else runs
    same = [placed[g].eqNullSafe(few[f"__{g}"]) for g in group]
    both = placed.join(few, reduce(and_, same, task == few["__task"]))
    return both.select(*rows.columns, (F.col("__before") + F.col("__id") - F.col("__first")).alias("pos"), "n")


#: Ids up to this number are broadcast (a quarter of it with a digest each); more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def free_name(names: list[str], name: str) -> str:
    """name, with as many underscores before it as it takes to be none of names."""
    taken = {n.lower() for n in names}
    while name in taken:
        name = "_" + name
    return name


def among(docs: DataFrame, rows: DataFrame, keys: dict[str, str], how: str) -> DataFrame:
    """docs, all columns, whose keys are (left_semi) or aren't (left_anti) those of one of rows; null equals null.

    keys: names of columns of rows by those of docs.
    """
    few = settled(rows.select(*(F.col(r).alias(f"key{i}") for i, r in enumerate(keys.values()))).distinct())
    side = F.broadcast(few) if few.count() <= BROADCAST_IDS // len(keys) ** 2 else few
    return docs.join(side, reduce(and_, (docs[d].eqNullSafe(side[f"key{i}"]) for i, d in enumerate(keys))), how)


def without(docs: DataFrame, rows: DataFrame, keys: dict[str, str]) -> DataFrame:
    """docs, all columns, but for those whose keys are in rows."""
    return among(docs, rows, keys, "left_anti")


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def crc_bucket(col: str, mod: int):
    """crc32 of an id written as text, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lengths[i]] for every i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total, dtype=np.int64) + np.repeat(starts - ends + lengths, lengths)]


def text_pieces(text: str, cut, size: int = 1 << 20) -> Iterator[str]:
    """text in pieces of about `size` characters, each of which begins where the pattern `cut` matches; whole where it never does."""
    at = 0
    while len(text) - at > size and (m := cut.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class Numbered(dict):
    """Numbers words in the order they are met. fresh: those met since the last call of learn().

    When `limit` words are held, those met once are forgotten and the others numbered anew (or all
    are forgotten, if hardly any was met once).
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.fresh: list = []
        self.met = np.zeros(1 << 16, np.int64)

    def __missing__(self, word):
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def numbers(self, words: list) -> np.ndarray:
        if len(self) >= self.limit:
            often = np.flatnonzero(self.met[: len(self)] > 1)
            often = often if len(often) < 0.7 * self.limit else often[:0]
            names = list(self)
            self.clear()
            self.update((names[i], n) for n, i in enumerate(often.tolist()))
            self.met = np.resize(self.met[often] // 2, len(self.met)) if len(often) else np.zeros(1 << 16, np.int64)
            self.met[len(often) :] = 0
            self.keep(often)
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.met) < len(self):
            self.met = np.concatenate((self.met, np.zeros(2 * len(self) - len(self.met), np.int64)))
        self.met[: len(self)] += np.bincount(out, minlength=len(self))
        return out

    def keep(self, often: np.ndarray) -> None:
        """What is stored by number is now only for these old numbers, in this order."""


class WordStore(Numbered):
    """Numbered words with each one's ids in one flat array."""

    def __init__(self, limit: int):
        super().__init__(limit)
        self.flat, self.starts, self.lengths = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32)
        self.used = 0

    def keep(self, often: np.ndarray) -> None:
        ids, lengths = self.ids(often)
        self.used = 0
        self._put(0, ids, lengths)

    def learn(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of the fresh words, in their order."""
        self._put(len(self) - len(self.fresh), ids, lengths)
        self.fresh = []

    def _put(self, at: int, ids: np.ndarray, lengths: np.ndarray) -> None:
        to = at + len(lengths)
        while len(self.starts) < to:
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while len(self.flat) < self.used + len(ids):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.lengths[at:to] = lengths
        self.starts[at:to] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words, and how many each has."""
        lengths = self.lengths[numbers].astype(np.int64)
        return gather(self.flat, self.starts[numbers], lengths), lengths
