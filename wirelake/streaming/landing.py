"""A folder where capture files land, ingested as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import ingest
from ..plans.store import ParquetStore

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, store: ParquetStore, checkpoint: str, glob: str = "*.{pcap,pcapng}", sensor: str = "", files_per_batch: int = 100, clean: str = "off", archive: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Ingest new files batch by batch. A batch that runs again writes the same rows under a higher sequence number, of which readers keep the last.

    clean: off, delete or archive what has been read. trigger: of writeStream, such as {"availableNow": True} to drain and stop.
    """
    source = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).option("cleanSource", clean)
    if archive:
        source = source.option("sourceArchiveDir", archive)

    def take(batch: DataFrame, number: int) -> None:
        files = batch.select("path", "content")
        if not files.isEmpty():
            ingest(store, files, sensor=sensor)

    return source.load(folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
