"""Shared places and batch sizes that the operators of this folder use."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

#: Rows in one Arrow batch. Batches hold whole texts, so the default of 10,000 rows would not bound memory.
BATCH_ROWS = 256
#: Bytes in one Arrow batch, at which it ends even with fewer rows; one longer text is a batch of its own.
BATCH_BYTES = 16 << 20
#: Tables of ids or counts with up to so many rows are broadcast, larger ones are shuffled.
BROADCAST_ROWS = 500_000

_own: list[tempfile.TemporaryDirectory] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A local session that names none gets a folder of this
    process, as in tests; on a cluster the folder must be named, because executors do not share local folders."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.conf.get("spark.master", "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.TemporaryDirectory(prefix="siftwork-"))
    return f"file://{_own[0].name}"


@contextlib.contextmanager
def _without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go when these end; what is written does not need them any more."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read back: short lineage that survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _without_leftovers(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that kept() wrote and that no plan still to run reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def tidy(run):
    """run, a function over Arrow batches, that gives the memory it no longer uses back to the system when it ends.

    Workers wait for their next task beside the executor; what they have freed but not given back counts against it.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """The set-up of a session for functions over Arrow batches: bounds of rows and bytes of a batch, unless the session
    has smaller ones already, and a path by which workers can import this package. The settings stay with the session."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(re.sub(r"\D", "", spark.conf.get(key)))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame) -> bool:
    """Whether a count shows that df, a narrow table that is cheap to count, may be broadcast."""
    return df.count() <= BROADCAST_ROWS


def held(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is small()."""
    return F.broadcast(df) if small(df) else df


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def evenly(rows: DataFrame, by: str, order: list[str], each: int, groups: int) -> DataFrame:
    """At most each rows of each group, of the groups most frequent ones, with their number _turn in the group; written.

    Rows are taken by a hash of the first column of order, then by the others; rows that are equal in all of them count
    one by one. A group's count gives the hash range that holds about four times each rows, so that no task sorts a
    whole group. Where that range holds too few, because ids repeat, the group is looked at again as a whole; then a
    task still passes on no more than each rows.
    """
    counts = kept(rows.groupBy(by).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), by).limit(groups).withColumnRenamed(by, "_by"), "counts")
    mark = F.pmod(F.xxhash64(order[0], F.lit("fit")), F.lit(2**31)).cast("double")
    turn = F.row_number().over(Window.partitionBy(by).orderBy(mark, *order))

    def chosen(of: DataFrame, share: float) -> DataFrame:
        few = rows.join(F.broadcast(of), rows[by].eqNullSafe(of["_by"])).where(mark * F.col("_n") < share).drop("_n", "_by")
        return kept(few.withColumn("_turn", turn).where(F.col("_turn") <= each), "sample")

    found = chosen(counts, 4.0 * each * 2**31)
    got = {r[by]: r["count"] for r in found.groupBy(by).count().collect()}
    short = [r["_by"] for r in counts.collect() if got.get(r["_by"], 0) < min(each, r["_n"])]
    if short:
        named = lambda c: F.coalesce(F.col(c).isin([x for x in short if x is not None]), F.lit(None in short))
        first, more = found, chosen(counts.where(named("_by")), float("inf"))
        found = kept(first.where(~named(by)).unionByName(more), "sample")
        dropped(first, more)
    dropped(counts)
    return found


def within(rows: DataFrame, order: list[str], size: Column, most: int) -> DataFrame:
    """The first rows in the order of two columns, at least one, whose sizes add up to most; rows is a bounded sample."""
    told = sorted((*key, n) for *key, n in rows.select(*order, size.cast("long")).collect())
    total, last = 0, None
    for a, b, n in told:
        total += n
        if last is not None and total > most:
            return rows.where((F.col(order[0]) < last[0]) | (F.col(order[0]) == last[0]) & (F.col(order[1]) <= last[1]))
        last = (a, b)
    return rows
