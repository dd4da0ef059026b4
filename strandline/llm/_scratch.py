"""Tables written to the folder that all executors share, to cut lineage and to survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where it is unset and one machine runs all."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="strandline-"))


class Scratch:
    """A run's own folder of Parquet tables."""

    def __init__(self, spark: SparkSession):
        self.spark, self.dir = spark, f"{root(spark)}/strandline-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def save(self, df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
        """Write and read again; ``parts`` bounds the files of a table whose size is known to be small."""
        path = f"{self.dir}/{name}"
        df = df if parts is None else df.coalesce(parts)
        df.write.mode("overwrite").parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.names = [n for n in self.names if n != name]

    def keep(self, *names: str) -> None:
        """Delete all tables but those that the result still reads."""
        for name in set(self.names) - set(names):
            self.drop(name)
