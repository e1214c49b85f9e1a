"""Tables that are computed once and read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from the folder named by ``spark.checkpoint.dir``, which all executors share.

    Steps that read them again need not compute them again, also after an executor is lost. In local mode a temporary
    folder is taken where the setting is missing. It is a Parquet table, so each step reads only the columns that it needs.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{folder or tempfile.mkdtemp(prefix='gleanspark-')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
