"""When a stream runs: options of ``DataStreamWriter.trigger``, or nothing to run on without a pause."""

from pyspark.sql.streaming import DataStreamWriter

#: take what has arrived, then stop; e.g. ``{"processingTime": "10 seconds"}`` or ``{}`` keep running
ONCE = {"availableNow": True}


def triggered(writer: DataStreamWriter, trigger: dict) -> DataStreamWriter:
    return writer.trigger(**trigger) if trigger else writer
