"""Tables between the steps of a job, in the folder that driver and executors share, and joins on keys with hot values."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows (of ids and a few numbers) up to which a counted table is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of a stored table up to which Spark may plan a broadcast by the size of its files.
FILED_ROWS = 20_000
#: A key with more rows than this, and than this part of all rows, is split in joins; so there are fewer than HOT_PARTS of them.
HOT_ROWS, HOT_PARTS = 1_000, 10_000
#: Bytes of a table that is small enough to be shuffled once more.
SMALL_BYTES = 1 << 30
#: Repeats of a row that one step writes out at a time.
REPEATS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local master gets a temporary one; a cluster an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            at = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(at)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder, with its lineage cut; it survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """A job's tables as compressed Parquet in a folder of its own. Each is deleted as soon as it was used for the last
    time; what a lazily evaluated result still reads stays until `clean`."""

    made_here: list[tuple[str, str]] = []  # (session, folder)

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.made = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4()}", 0
        Scratch.made_here.append((_session(spark), self.folder))
        self.at: dict[int, str] = {}
        self.held: list[DataFrame] = []

    def put(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(out)] = path
        self.held.append(out)  # an id is not given to another frame while this one lives
        return out

    def clear(self, *but: DataFrame) -> None:
        """Drops all tables but those given."""
        keep = {id(df) for df in but}
        for i in [i for i in self.at if i not in keep]:
            delete(self.spark, self.at.pop(i))

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            delete(self.spark, self.at.pop(id(df)))


def _session(spark: SparkSession) -> str:
    return spark._jsparkSession.sessionUUID()


def clean(spark: SparkSession) -> None:
    """Deletes all tables that this session has left in the shared folder. Results that still read them end with it;
    tables of other sessions stay."""
    own = _session(spark)
    for folder in [f for s, f in Scratch.made_here if s == own]:
        delete(spark, folder)
    Scratch.made_here[:] = [x for x in Scratch.made_here if x[0] != own]


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Spark's own file systems, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """df, which the caller says is a plain scan of files, dealt over as many tasks as run at once if it has less than
    SMALL_BYTES in fewer files than that: a file is often one row group, which one task reads. Larger scans stay as they
    are. Only the placing of rows changes, so no result may depend on it."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_BYTES:
        return df
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if 0 < len(df.inputFiles()) < n else df


def told(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, marked for a broadcast if it has at most BROADCAST_ROWS rows (counted unless given)."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def sorted_join(df: DataFrame) -> DataFrame:
    """df, marked for joins by sorting, so that Spark does not broadcast it by the size of the compressed files that it is
    read from: the driver would hold its rows, which take many times as much, for each join of a plan at once."""
    return df.hint("merge")


def filed(df: DataFrame) -> DataFrame:
    """df, a stored table, for joins by sorting if it has more than FILED_ROWS rows."""
    return df if df.limit(FILED_ROWS + 1).count() <= FILED_ROWS else sorted_join(df)


def join_hot(many: DataFrame, one: DataFrame, key: str | list[str], salt: Column, counts: DataFrame | None = None, how: str = "inner", rows: int | None = None) -> DataFrame:
    """many joined with one on key, where values of key may hold any share of many; one has each value once, nulls match nothing.

    Values with more rows than HOT_ROWS and 1 / HOT_PARTS of all are split into parts of that size by salt, an
    expression over many, and their row of one goes to each part. The list of such values is the only broadcast; it has
    fewer than HOT_PARTS rows. counts: (key, _rows) of many, if known already.
    """
    key = [key] if isinstance(key, str) else key
    total = many.count() if rows is None else rows
    limit = max(HOT_ROWS, total // HOT_PARTS)
    counts = many.groupBy(*key).agg(F.count("*").alias("_rows")) if counts is None else counts
    hot = F.broadcast(counts.filter(F.col("_rows") > limit).select(*key, F.ceil(F.col("_rows") / limit).cast("int").alias("_parts")))
    left = many.withColumn("_salt", salt).join(hot, key, "left").withColumn("_part", F.coalesce(F.pmod(F.col("_salt"), F.col("_parts")), F.lit(0)).cast("int")).drop("_salt", "_parts")
    right = one.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*key, "_part"], how).drop("_part")


def multiplied(df: DataFrame, times: str, index: str, keys: list[str]) -> DataFrame:
    """Each row of df as often as its `times` says, numbered by `index` from 0; repeats of one row are spread over tasks
    by keys and number."""
    n, step = F.col(times).cast("long"), F.lit(REPEATS).cast("long")
    begin = df.filter(n > 0).withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, step))).repartition(*keys, "_lo")
    return begin.withColumn(index, F.explode(F.sequence(F.col("_lo"), F.least(n, F.col("_lo") + step) - 1))).drop("_lo")


def numbered(df: DataFrame, order: list[Column], out: str, store: Scratch, value: str | None = None, running: str = "running") -> DataFrame:
    """df with its rows numbered from 0 in an order, without a window over all of them: rows go to ranges, ranges are
    counted, and numbers follow from the counts, of which there is one a partition. With value, also its running sum."""
    ranged = store.put(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    own = F.sum(value) if value else F.lit(0)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"), own.alias("_s"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    before = counts.select("_range", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(as_) for c, as_ in (("_n", "_before"), ("_s", "_had"))])
    upto = Window.partitionBy("_range").orderBy(*order)
    rows = ranged.withColumn("_i", F.row_number().over(upto) - 1)
    if value:
        rows = rows.withColumn("_run", F.sum(value).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(F.broadcast(before), "_range").withColumn(out, (F.col("_i") + F.col("_before")).cast("long"))
    if value:
        rows = rows.withColumn(running, F.col("_run") + F.col("_had"))
    return rows.drop("_i", "_before", "_range", "_had", "_run")
