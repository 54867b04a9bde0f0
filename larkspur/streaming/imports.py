"""The import as a restartable stream of micro-batches: each reads its files once and leaves its rows and one audit row.

A batch is a bounded number of files, taken in the order of their time of change. Its rows are judged, counted while they are written (``observe``), and
replace what an earlier attempt of the same batch left; so does its audit row, which is ``running`` until the rows
are there. A run that is killed anywhere and started again leaves what an undisturbed run leaves.

Under the folder lie ``rows/batch_id=N/outcome=...`` and ``batches/batch_id=N``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.lifecycle import latest
from larkspur.sources import gzip_lines, raw

#: What a batch's audit row holds beside its number.
AUDIT = "source string, started_at timestamp, finished_at timestamp, status string, read long, accepted long, filtered long, rejected long, read_bytes long"


def judged_places(lines: DataFrame, areas: list | None = None) -> DataFrame:
    """Lines of places with outcome and reason; only accepted rows keep their fields, so no text of a rejected line is stored."""
    scanned = raw.parsed_lines(lines, raw.PLACE, "path", "read_bytes", "file_bytes")
    curated = raw.curate_places(scanned.select("line_no", "record.*", F.struct("path", "read_bytes", "file_bytes", "reason").alias("_line")), areas, "_line")
    return _judged(curated)


def judged_reviews(lines: DataFrame, least_chars: int = 1) -> DataFrame:
    scanned = raw.parsed_lines(lines, raw.REVIEW, "path", "read_bytes", "file_bytes")
    curated = raw.curate_reviews(scanned.select("line_no", "record.*", F.struct("path", "read_bytes", "file_bytes", "reason").alias("_line")), least_chars, "_line")
    return _judged(curated)


def _judged(curated: DataFrame) -> DataFrame:
    bad = F.col("_line.reason").isNotNull()
    outcome, reason = F.when(bad, "reject").otherwise(F.col("outcome")), F.when(bad, F.col("_line.reason")).otherwise(F.col("reason"))
    own = [c for c in curated.columns if c not in ("line_no", "outcome", "reason", "_line")]
    marked = curated.select(F.col("_line.path").alias("path"), "line_no", F.col("_line.read_bytes").alias("read_bytes"), outcome.alias("outcome"), reason.alias("reason"), *own)
    return marked.select("path", "line_no", "read_bytes", "outcome", "reason", *[F.when(F.col("outcome") == "accept", F.col(c)).alias(c) for c in own])


def _audit(spark: SparkSession, folder: str, number: int, **values) -> None:
    names = [f.split()[0] for f in AUDIT.split(", ")]
    row = [values.get(n) if n not in ("started_at", "finished_at") else None for n in names]
    times = {n: (F.current_timestamp() if values.get(n) is True else F.lit(values.get(n)).cast("timestamp")) for n in ("started_at", "finished_at")}
    spark.createDataFrame([row], AUDIT).withColumns(times).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batches/batch_id={number}")


def import_batches(spark: SparkSession, source: str, folder: str, judge: Callable[[DataFrame], DataFrame], files_per_batch: int = 8) -> None:
    """Import all gzip files of a folder that have not been imported yet; returns when they are.

    ``judge`` makes judged rows of lines, as ``judged_places`` does.
    """

    def one(files: DataFrame, number: int) -> None:
        session = files.sparkSession
        _audit(session, folder, number, source=source, started_at=True, status="running")
        began = session.read.parquet(f"{folder}/batches/batch_id={number}").first()["started_at"]
        counts = Observation(f"import-{number}")
        rows = judge(gzip_lines.lines_of_files(files).where(F.trim("value") != ""))
        is_ = lambda outcome: F.count_if(F.col("outcome") == outcome)
        watched = rows.observe(counts, F.count(F.lit(1)).alias("read"), is_("accept").alias("accepted"), is_("filter").alias("filtered"), is_("reject").alias("rejected"))
        watched.write.mode("overwrite").partitionBy("outcome").parquet(f"{folder}/rows/batch_id={number}")
        size = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]  # sizes from the listing; no file is read for it
        finish(session, folder, number, source, began, counts.get, size)

    stream = gzip_lines.stream_files(spark, source, files_per_batch)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def finish(spark: SparkSession, folder: str, number: int, source: str, began, counts: dict, size: int) -> None:
    """The batch's audit row once its rows are there."""
    _audit(spark, folder, number, source=source, started_at=began, finished_at=True, status="success", read_bytes=size, **counts)


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """One audit row for each batch: batch_id and the columns of AUDIT."""
    return spark.read.parquet(f"{folder}/batches")


def rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{folder}/rows")


def rejected(spark: SparkSession, folder: str) -> DataFrame:
    """batch_id, path, line_no and reason of what was turned away, never the text."""
    return rows(spark, folder).where("outcome IN ('reject', 'filter')").select("batch_id", "path", "line_no", "outcome", "reason")


def current(spark: SparkSession, folder: str, *key: str) -> DataFrame:
    """Accepted rows, one for each key: the last line of the last batch wins. Only the folders of accepted rows are read."""
    accepted = rows(spark, folder).where("outcome = 'accept'").drop("outcome", "reason", "read_bytes")
    return latest(accepted, list(key), [F.col("batch_id").desc(), F.col("path").desc(), F.col("line_no").desc()])
