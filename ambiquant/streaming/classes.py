"""An extension: equivalence classes of reads that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ambiquant.operators.classes import equivalence_classes


def class_stream(reads: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Running class counts of a stream of (read, transcripts), in the memory table `name`."""
    w = equivalence_classes(reads).writeStream.outputMode("complete").format("memory").queryName(name)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
