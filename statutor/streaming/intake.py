"""New documents as a stream: the same stateless pass as in a batch, written as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from statutor.functions import fixed as X
from statutor.operators.audit import audit


def stream(spark: SparkSession, source: str, schema: StructType | str, files_per_trigger: int = 64) -> DataFrame:
    """Files of documents that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)


def audit_stream(documents: DataFrame, out: str, checkpoint: str, window: tuple[int, int] = X.STUDY_WINDOW, once: bool = True) -> StreamingQuery:
    """Audits a stream into a table, each document exactly once; with ``once`` it ends when all that is there is done."""
    writer = audit(documents, window).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
