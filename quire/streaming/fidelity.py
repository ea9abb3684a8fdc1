"""The same scores for pairs that arrive as a stream. Each pair is scored by itself, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quire.operators import fidelity


def read_pairs(spark: SparkSession, path: str, schema: StructType | str = "doc_id long, source string, target string", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_scores(pairs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Score all pairs there are, append the rows as Parquet, and stop; a restart goes on behind them."""
    writer = fidelity.scores(pairs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).outputMode("append").start()
