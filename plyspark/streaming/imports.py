"""PGN folders as a stream: each new file is imported once, and a restart goes on where the last run ended."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import ImportSummary, import_pgn
from ..sources.bundle import Bundle

FILES = "path string, modificationTime timestamp, length long, content binary"


def start_import(spark: SparkSession, folder: str, bundle_path: str, checkpoint: str, files_per_batch: int = 100, on_progress: Callable[[dict], None] | None = None) -> StreamingQuery:
    """Imports the .pgn files of a folder that the checkpoint has not seen, then stops.

    The stream tells only which files are new; their bytes are read in ranges.  A batch that was cut off is
    run again, and what it had committed counts as duplicates.  on_progress gets a row after each batch.
    """
    totals = {"attempted": 0, "committed": 0, "skipped": 0, "errors": 0, "files": 0}

    def batch(df: DataFrame, number: int) -> None:
        paths = sorted(r.path for r in df.select("path").collect())  # files_per_batch at most
        if not paths:
            return
        done = import_pgn(Bundle.open_or_create(spark, bundle_path), paths)
        for k in ("attempted", "committed", "skipped", "errors"):
            totals[k] += getattr(done, k)
        totals["files"] += len(paths)
        if on_progress:
            on_progress({"batch": number, "at": datetime.now(timezone.utc).isoformat(), "phase": "running"} | totals)

    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.pgn").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select("path").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_import(spark: SparkSession, folder: str, bundle_path: str, checkpoint: str, **options) -> ImportSummary:
    """`start_import` to its end; what was imported in this run."""
    seen: list[dict] = []
    query = start_import(spark, folder, bundle_path, checkpoint, on_progress=seen.append, **options)
    query.awaitTermination()
    last = seen[-1] if seen else {}
    return ImportSummary(*(last.get(k, 0) for k in ("attempted", "committed", "skipped", "errors")))
