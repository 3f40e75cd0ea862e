"""Intermediate tables in storage that every executor can read.

A table written here cuts the lineage: a lost executor costs a re-read, not a
re-computation.  The folder is ``spark.checkpoint.dir`` of the session; only a
session in one process (tests, a notebook) may do without and gets a local
folder, on a cluster that is an error.  Operators drop their own intermediate
tables; what a result still reads goes when the program ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kinspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one operator call, dropped together by :meth:`drop`."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/kinspark-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[str] = []
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str, in_file: int = 0) -> DataFrame:
        """Write ``df``, with up to ``in_file`` rows in a file if that is not 0, and read it again."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        schema = df.schema
        df.write.option("compression", "zstd").option("maxRecordsPerFile", in_file).parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def keep_bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """Write ``df`` in buckets of ``key``, one for each shuffle partition, and read it again.

        Joins on ``key`` alone then leave this table where it is.
        """
        self.count += 1
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"kinspark_{uuid.uuid4().hex}"
        path = f"{self.root}/{self.count:03d}-{name}"
        df.repartition(n, key).write.bucketBy(n, key).option("compression", "zstd").format("parquet").option("path", path).saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def child(self) -> Scratch:
        """Another folder, for tables that the result of an operator does not read."""
        return Scratch(self.spark)

    def drop(self) -> None:
        """Delete all tables; only once no DataFrame on them is needed."""
        atexit.unregister(self.drop)
        context = self.spark.sparkContext
        if not self.count:
            return
        if context._jsc is None:  # the session has ended
            if self.root.startswith("file://"):
                shutil.rmtree(self.root.removeprefix("file://"), ignore_errors=True)
            return
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = context._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
