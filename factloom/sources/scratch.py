"""Tables that a job reads more than once, written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factloom.streaming.jobs import shared_folder


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: what it took to make it is done once, and survives a lost executor."""
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
