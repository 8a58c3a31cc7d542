"""Ontology files as they arrive: each micro-batch is parsed and appended, so a restart resumes by its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.sources import rdf


def stream_triples(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the triples of new files of ``folder`` to the table at ``out``; processes what is there and stops."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", rdf.ONTOLOGY_FILES).load(folder)

    def batch(df: DataFrame, number: int) -> None:
        at = f"{out}/batch={number}"
        rows = df.select("path", "content").mapInArrow(_parse_batches, rdf.TRIPLES)
        rows.write.mode("overwrite").parquet(at)  # the same batch again replaces itself

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parse_batches(batches):
    import pyarrow as pa

    names = [f.split(" ")[0] for f in rdf.TRIPLES.split(", ")]
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows = rdf.parsed_rows(path.rsplit("/", 1)[-1], content.as_py())  # a broken file is one row with its error
            if rows:
                yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Event counts by type in tumbling windows, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
