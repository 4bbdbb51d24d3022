"""Helpers that keep plans safe on a cluster: tables in the shared folder, lookups that split hot keys, split lags."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key is hot if it holds at least 1/HOT_SHARE of all rows; so there are never more than HOT_SHARE hot keys.
HOT_SHARE = 1000


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="callscape-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder for data between stages: the one the session names in spark.checkpoint.dir.

    Only a session on one machine (master local) may name none, and then gets a temporary folder of its own; on a
    cluster that is an error, as executors would write where no other reads.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or _own_folder()


def _file_system(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete the folder, then there, when the application ends."""
    files, place = _file_system(spark, path)
    if not files.exists(place):
        files.mkdirs(place)
    files.deleteOnExit(place)


def cut_lineage(df: DataFrame, *apart: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there, so that no executor is needed for them any more.

    Rows that differ in the columns `apart` are kept in files apart, for parts_of(). The table is deleted by let_go(), or
    else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/callscape-{uuid.uuid4().hex}.parquet"
    df.write.partitionBy(*apart).parquet(path)
    delete_at_end(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._callscape_path = path
    return table


def parts_of(tables: Sequence[DataFrame], part: str) -> DataFrame:
    """The rows of one part (column=value, of which each of the tables has rows) of several tables, in a single scan."""
    first = tables[0]
    return first.sparkSession.read.schema(first.drop(part.split("=")[0]).schema).parquet(*[f"{t._callscape_path}/{part}" for t in tables])


def let_go(*tables: DataFrame) -> None:
    """Delete tables of cut_lineage() that nothing reads any more (others than these are passed over)."""
    for t in tables:
        if path := getattr(t, "_callscape_path", None):
            files, place = _file_system(t.sparkSession, path)
            files.delete(place, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores, for what is costly in each row.

    Only an input that would leave half of the cores idle (one small file, say) is shuffled, by its key; a large one
    has more partitions and stays as it is read. No result depends on it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if 2 * df.rdd.getNumPartitions() <= cores else df


def _same(a: str, b: str, on: Sequence[str]) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in on]


def split_lookup(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """big joined (inner or left) to small, which has one row per key; nulls in a key are a value.

    Rows of hot keys would all go to a few tasks. There are at most HOT_SHARE such keys, whatever the size of big, so
    their rows of small are broadcast and those of big stay where they are; all others are joined by shuffle, where no key
    holds more than 1/HOT_SHARE of the rows. big is read up to four times. counts (on, _n) are rows per key, if they
    are known already and written down: of big, or in proportion to them.
    """
    rows = big.count() if counts is None else counts.agg(F.sum("_n")).first()[0]
    if counts is None:
        counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") * HOT_SHARE >= rows).select(*on).collect() if rows else []
    more = [c for c in small.columns if c not in on]
    shape = [*[F.col(f"b.{c}").alias(c) for c in big.columns], *[F.col(f"s.{c}").alias(c) for c in more]]
    if not hot:
        return big.alias("b").join(small.alias("s"), _same("b", "s", on), how).select(*shape)
    keys = F.broadcast(big.sparkSession.createDataFrame(hot, big.select(*on).schema))
    few = F.broadcast(small.alias("b").join(keys.alias("h"), _same("b", "h", on), "left_semi"))
    if how == "left":
        few = F.broadcast(keys.alias("b").join(few.alias("s"), _same("b", "s", on), "left").select(*[F.col(f"b.{c}").alias(c) for c in on], *[F.col(f"s.{c}") for c in more]))
    near = big.alias("b").join(few.alias("s"), _same("b", "s", on)).select(*shape)
    rest = big.alias("b").join(keys.alias("h"), _same("b", "h", on), "left_anti").alias("b")
    return near.unionByName(rest.join(small.alias("s"), _same("b", "s", on), how).select(*shape))


def lag_in_periods(df: DataFrame, group: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """df with `out`: the value of the row before, in its group's order.

    A window over the whole group would put a hot group into one task. Rows are ordered within each day
    instead; the last value of each day is then carried over the group's days, of which there are few.
    Rows of equal order within a group follow in the order of their values.
    """
    d = df.withColumn("_day", F.to_date(order))
    keys = [*group, "_day"]
    rank = F.struct(F.col(order), F.xxhash64(value))
    inner = d.withColumn("_near", F.lag(value).over(Window.partitionBy(*keys).orderBy(F.col(order), F.xxhash64(value))))
    ends = d.groupBy(*keys).agg(F.max_by(value, rank).alias("_last"))
    ends = ends.select(*keys, F.lag("_last").over(Window.partitionBy(*group).orderBy("_day")).alias("_far"))
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = inner.alias("a").join(ends.alias("b"), cond, "left")
    return joined.select("a.*", F.coalesce("a._near", "b._far").alias(out)).drop("_day", "_near")
