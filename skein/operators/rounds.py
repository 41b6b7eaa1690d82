"""Iterated plans: every round is written to the shared folder, so lineage stays short and survives lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder if driver and workers are one process, else an error:
    executors would each write where nobody else can read."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='skein-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Rounds:
    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(path := f"{self.base}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, what: Column) -> tuple[DataFrame, object]:
        """put(), and an aggregate of the rows that is taken while they are written, so it costs no job of its own."""
        seen = Observation()
        out = self.put(df.observe(seen, what.alias("n")))
        return out, seen.get["n"]
