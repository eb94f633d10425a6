"""An extension: pages that arrive as JSON lines, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stores import Stores


def page_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def upsert_stream(stream: DataFrame, stores: Stores, name: str, order: str, checkpoint: str):
    """Keeps in a table of stores the last row of each key. A batch rewrites the buckets that it hits, in one commit; one that runs again changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        stores.merge(name, batch, [F.desc(order)], number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
