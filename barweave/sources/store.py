"""Stored bars that are loaded through, and tables that streams merge into.

Both write before they record what was written: a bar store its bars before their ranges, a merged table its files before
the commit that names them. What a lost driver leaves half done is written again or never read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.schema import BARS

RANGES = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("start", T.DateType()), T.StructField("end", T.DateType())])


# --- interval sets ----------------------------------------------------------------------------------------


def _coverage(ranges: DataFrame, name: str) -> DataFrame:
    """(ticker, at, name): by how much the number of ranges over a day changes at it. Ranges include both ends; those that
    end before they start, or lack an end, cover nothing."""
    known = ranges.where(F.col("ticker").isNotNull() & (F.col("start") <= F.col("end")))
    edges = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("change")), F.struct(F.date_add("end", 1).alias("at"), F.lit(-1).alias("change")))
    return known.select("ticker", F.explode(edges).alias("x")).groupBy("ticker", "x.at").agg(F.sum("x.change").alias(name))


def subtract_ranges(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(ticker, start, end): the days in ranges of ``wanted`` and in none of ``held``, as maximal ranges. A sweep over the
    edges of both: what a ticker costs is the number of its ranges, however they overlap."""
    edges = _coverage(wanted, "wants").join(_coverage(held, "has"), ["ticker", "at"], "full_outer").na.fill(0, ["wants", "has"])
    order = Window.partitionBy("ticker").orderBy("at")
    open_ = (F.sum("wants").over(order) > 0) & (F.sum("has").over(order) <= 0)
    pieces = edges.select("ticker", "at", open_.alias("open"), F.lead("at").over(order).alias("next"))
    pieces = pieces.withColumn("starts", (F.col("open") & ~F.coalesce(F.lag("open").over(order), F.lit(False))).cast("int"))
    runs = pieces.withColumn("run", F.sum("starts").over(order)).where("open")
    return runs.groupBy("ticker", "run").agg(F.min("at").alias("start"), F.date_sub(F.max("next"), 1).alias("end")).drop("run")


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """The same days in as few ranges as possible."""
    return subtract_ranges(ranges, ranges.where("false"))


# --- bars, loaded through ---------------------------------------------------------------------------------


def newest(bars: DataFrame) -> DataFrame:
    """One row for each (ticker, ts): the one that was cached last."""
    rest = [c for c in bars.columns if c not in ("ticker", "ts")]
    last = bars.groupBy("ticker", "ts").agg(F.max_by(F.struct(*rest), F.struct("cached_at", *[c for c in rest if c != "cached_at"])).alias("_x"))
    return last.select("ticker", "ts", *[F.col("_x")[c].alias(c) for c in rest])


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


class BarStore:
    """Bars below a path, with the ranges of days that were asked for: a day without a bar is not asked for twice."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        schema = T.StructType([*schema.fields, T.StructField("cached_at", T.TimestampType())])
        path = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(path) if _exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def ranges(self, max_age_hours: int | None = None) -> DataFrame:
        """(ticker, start, end) of what is stored; ranges cached longer ago do not count."""
        rows = self._read("ranges", RANGES)
        if max_age_hours is not None:
            rows = rows.where(F.col("cached_at") >= F.current_timestamp() - F.make_interval(hours=F.lit(max_age_hours)))
        return merge_ranges(rows)

    def missing(self, wanted: DataFrame, max_age_hours: int | None = None) -> DataFrame:
        return subtract_ranges(wanted, self.ranges(max_age_hours))

    def read(self) -> DataFrame:
        return newest(self._read("bars", BARS))

    def load(self, wanted: DataFrame, fetch: Callable[[DataFrame], DataFrame], max_age_hours: int | None = None) -> DataFrame:
        """Bars of the ``wanted`` ranges (ticker, start, end). ``fetch`` gets the ranges that are not stored and returns
        their bars, which are stored, and then the ranges. A load of what is stored fetches and writes nothing."""
        now = F.current_timestamp()
        # Written first: what is fetched and what is recorded must be the same ranges.
        asked = f"{self.path}/asked"
        self.missing(wanted, max_age_hours).write.mode("overwrite").parquet(asked)
        missing = self.spark.read.schema(RANGES).parquet(asked)
        if not missing.isEmpty():
            bars = fetch(missing).select(*BARS.fieldNames()).withColumn("cached_at", now)
            by = ("ticker", F.date_trunc("year", "ts"))
            bars.repartition(*by).sortWithinPartitions("ticker", "ts").write.mode("append").parquet(f"{self.path}/bars")
            missing.withColumn("cached_at", now).write.mode("append").parquet(f"{self.path}/ranges")
        return in_ranges(self.read(), wanted)


def in_ranges(bars: DataFrame, ranges: DataFrame) -> DataFrame:
    """Bars on a day of some range of their ticker. Ranges are cut at years and meet bars by equality on (ticker, year)."""
    years = F.explode(F.sequence(F.year("start"), F.year("end"))).alias("_year")
    cut = merge_ranges(ranges).select("ticker", "start", "end", years)
    held = bars.withColumn("_year", F.year("ts")).join(cut, ["ticker", "_year"]).where(F.col("ts").between(F.col("start"), F.col("end")))
    return held.select(*bars.columns)


# --- tables that streams merge into -----------------------------------------------------------------------


class MergedTable:
    """A table of one row per key, cut into parts, that micro-batches merge into exactly once.

    A merge writes new files for the parts that its batch touches, from their rows before and those of the batch, below
    ``data/version=<batch>``; then a commit, which names the version of each part. A batch whose commit exists is left
    alone; one without is written again from the commit before, so a replay changes nothing. Readers see whole commits."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: tuple[str, ...], part: str):
        """``part``: an SQL expression of the key that gives a string, the same for all rows of a key."""
        self.spark, self.path, self.key, self.part = spark, path.rstrip("/"), key, part
        self.schema = spark.createDataFrame([], schema).schema
        placed = [T.StructField("version", T.LongType()), T.StructField("part", T.StringType())]
        self._stored, self._commit = T.StructType([*self.schema.fields, *placed]), T.StructType(placed)

    def commits(self) -> list[int]:
        """Ids of the batches whose commit is complete."""
        context = self.spark.sparkContext
        top = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        files = top.getFileSystem(context._jsc.hadoopConfiguration())
        if not files.exists(top):
            return []
        names = [s.getPath().getName() for s in files.listStatus(top)]
        whole = [n for n in names if n.isdigit() and files.exists(context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{n}/_SUCCESS"))]
        return sorted(map(int, whole))

    def _versions(self, commit: int | None) -> DataFrame:
        if commit is None:
            return self.spark.createDataFrame([], self._commit)
        return self.spark.read.schema(self._commit).parquet(f"{self.path}/commits/{commit}")

    def _rows(self, versions: DataFrame) -> DataFrame:
        """Rows of the named versions; the join prunes the folders of all others."""
        if not _exists(self.spark, f"{self.path}/data"):
            return self.spark.createDataFrame([], self._stored)
        stored = self.spark.read.schema(self._stored).parquet(f"{self.path}/data")
        return stored.join(versions, ["version", "part"], "left_semi").select(*self._stored.fieldNames())

    def read(self, from_part: str = "") -> DataFrame:
        """The rows of the parts from ``from_part`` on, in the order of their names."""
        done = self.commits()
        versions = self._versions(done[-1] if done else None).where(F.col("part") >= from_part)
        return self._rows(versions).where(F.col("part") >= from_part).select(*self.schema.fieldNames())

    def version(self, batch_id: int) -> DataFrame:
        """The rows of the parts that a batch touched, as it left them."""
        versions = self._versions(batch_id).where(F.col("version") == batch_id)
        return self._rows(versions).select(*self.schema.fieldNames())

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: rows of the batch replace those of their key; of rows that share a key within the batch
        the one that is greatest in all columns stays."""
        done = self.commits()
        if batch_id in done:
            # A replay still has to be computed: the stream's own state is stored while it is.
            batch.write.format("noop").mode("overwrite").save()
            return
        # Read for its parts and for its rows, but computed once.
        batch = batch.persist()
        try:
            self._merge(batch, batch_id, done)
        finally:
            batch.unpersist()

    def _merge(self, batch: DataFrame, batch_id: int, done: list[int]) -> None:
        before = max((n for n in done if n < batch_id), default=None)
        held = self._versions(before)
        rows = batch.select(*self.schema.fieldNames()).withColumn("part", F.expr(self.part))
        touched = rows.select("part").distinct()
        old = self._rows(held.join(touched, "part", "left_semi")).drop("version")
        rest = [c for c in self.schema.fieldNames() if c not in self.key]
        both = rows.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
        last = both.groupBy("part", *self.key).agg(F.max(F.struct("_new", *rest)).alias("_x"))
        merged = last.select(*self.key, *[F.col("_x")[c].alias(c) for c in rest], "part")
        target = f"{self.path}/data/version={batch_id}"
        merged.select(*self.schema.fieldNames(), "part").repartition("part").write.mode("overwrite").partitionBy("part").parquet(target)
        written = self.spark.read.schema(self._stored).parquet(f"{self.path}/data").where(F.col("version") == batch_id)
        now = written.select("part").distinct().withColumn("version", F.lit(batch_id).cast("long"))
        commit = held.join(now, "part", "left_anti").unionByName(now)
        commit.select("version", "part").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{batch_id}")
