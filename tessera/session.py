"""Sessions and the storage that driver and executors share."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with over 1/HEAVY of all rows is heavy; so fewer than HEAVY keys are.
HEAVY = 1000
#: Rows of ids or hashes that a side may have to be broadcast; always counted first.
BROADCAST_ROWS = 200_000


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as tests and the benchmark use it."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName("tessera").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def carried(module: str) -> None:
    """Functions of this module travel to executors by value, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (local sessions only) one of our own."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder once; later plans start from there and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame, what: str) -> DataFrame:
    """As cut(), as a columnar table, for wide or often pruned rows."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Shelf:
    """Tables in the shared folder that are needed for the length of a `with` block, and deleted at its end.

    Nothing lazy may leave the block that still reads them.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.path, self.n = spark, scratch(spark, what), 0

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def put(self, df: DataFrame) -> DataFrame:
        """df, written once and read from there."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast, if a count shows that it has at most `rows` rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def looked_up(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined with facts, which has one row for each key and in column `n` how many of the `total` rows have that key.

    Heavy keys, fewer than `HEAVY` whatever the size, are looked up in a broadcast, so no task gets all rows of one;
    the others shuffle. Both inputs are read twice and should be written tables.
    """
    heavy = F.broadcast(facts.where(F.col(n) * HEAVY > total))
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(facts.where(F.col(n) * HEAVY <= total), key)
    return rows.join(heavy, key).unionByName(light)


def dealt_by(df: DataFrame, *keys: str) -> DataFrame:
    """df with equal keys in one partition, for functions that go through whole partitions.

    A repartition by the very columns that a join below has dealt by may be planned away, and that join's sides then be
    read without a shuffle once one proves small, which scatters the keys. A hash of the keys is an expression of its own.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))
