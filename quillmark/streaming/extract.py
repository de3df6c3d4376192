"""Feature extraction over files as they arrive.

Extraction is map-only, so the batch expressions run unchanged on a stream:
no state, no watermark.  With ``available_now`` a run picks up only files added
since the last one, which makes it an incremental feature cache.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillmark.functions.features import add_features


def extract_stream(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema,
    names: Iterable[str] | None = None, preset: str = "BASE9", text: str = "code",
    available_now: bool = True,
) -> StreamingQuery:
    """Append the features of every new parquet file under ``source`` to ``target``."""
    features = add_features(spark.readStream.schema(schema).parquet(source), names, preset, text)
    writer = features.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(target)
