"""Tables of intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class SharedTables:
    """Parquet tables below spark.checkpoint.dir (a folder of our own where the session names none)."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named:
            context = spark.sparkContext
            if context._jsc.sc().getCheckpointDir().isEmpty():
                if not context.master.startswith("local"):
                    raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
                context.setCheckpointDir(tempfile.mkdtemp(prefix="corpuscle-"))
            named = context._jsc.sc().getCheckpointDir().get()
        self.spark, self.root = spark, f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
