"""Jobs over time: admission, recovery, progress. Batch forms beside streaming ones of the same rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def _admit(times: list[float], log: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Whether hits are let in, in order of time. Only hits let in count, and one of exactly `window` ago still does."""
    out = []
    for t in times:
        log = [x for x in log if t - x <= window]
        out.append(len(log) < limit)
        if out[-1]:
            log.append(t)
    return out, log


def rate_limited(hits: DataFrame, limit: int, window: float = 60.0) -> DataFrame:
    """Hits (client, ts, ...) with allowed: admission feeds back, so no window function gives it.

    A task takes its clients' hits in order, batch by batch, and holds no more than the log of the client at
    hand. Equal times come in order of the other columns.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema)
    rest = [c for c in hits.columns if c not in ("client", "ts")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, log = (), []
        for frame in frames:
            out = []
            for own, part in frame.groupby("client", sort=False, dropna=False):
                own = None if pd.isna(own) else own
                log = log if own == client else []
                client = own
                allowed, log = _admit((part["ts"] - pd.Timestamp(0)).dt.total_seconds().tolist(), log, limit, window)
                out.append(part.assign(allowed=allowed))
            if out:
                yield pd.concat(out)

    return hits.repartition("client").sortWithinPartitions("client", "ts", *rest).mapInPandas(run, f"{kinds}, allowed boolean")


def rate_limited_stream(hits: DataFrame, limit: int, window: float = 60.0, late: str = "10 seconds") -> DataFrame:
    """The same over a stream of (client, ts): the log of each client's admitted hits is its state, which goes once the watermark passes the window. Rows must come in order within a client."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = pd.concat(list(frames)).sort_values("ts")
        seconds = (own["ts"] - pd.Timestamp(0)).dt.total_seconds().tolist()
        allowed, log = _admit(seconds, list(state.get[0]) if state.exists else [], limit, window)
        state.update((log,))
        state.setTimeoutTimestamp(max(int((seconds[-1] + window) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"client": key[0], "ts": own["ts"], "allowed": allowed})

    rows = hits.select("client", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("client").applyInPandasWithState(fold, "client string, ts timestamp, allowed boolean", "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def recovered(records: DataFrame, most: int = 3) -> DataFrame:
    """Interrupted records (status starting with PROCESSING) go back to the queue, or fail after `most` attempts or without their file."""
    running = F.col("status").startswith("PROCESSING")
    attempts = F.coalesce("processing_attempts", F.lit(0)) + F.when(running, 1).otherwise(0)
    failed = (attempts > most) | ~F.coalesce("file_exists", F.lit(False))
    return records.withColumns({"status": F.when(running & failed, "FAILED").when(running, "QUEUED").otherwise(F.col("status")), "processing_attempts": attempts})


def progress_stream(pages: DataFrame) -> DataFrame:
    """Pages done of each document, kept up by a stream of (document_id, page_number)."""
    return pages.groupBy("document_id").agg(F.count("*").alias("pages_done"), F.max("page_number").alias("last_page"))


def key_touches(uses: DataFrame, watermark: str = "2 minutes") -> DataFrame:
    """One use of each key (key_hash, ts) a minute, of a stream or a batch."""
    rows = uses.withColumn("minute", F.date_trunc("minute", "ts"))
    return rows.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["key_hash", "minute"]) if uses.isStreaming else rows.dropDuplicates(["key_hash", "minute"])


def usage_by_window(uses: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Hits of each client and window; rows later than the watermark go."""
    rows = uses.withWatermark("ts", late) if uses.isStreaming else uses
    return rows.groupBy("client", F.window("ts", width)).agg(F.count("*").alias("hits")).select("client", F.col("window.start").alias("start"), "hits")


def ingest(spark: SparkSession, landing: str, target: str, checkpoint: str):
    """A running query that appends new text files of a folder to a table: one row a file."""
    files = spark.readStream.format("text").option("wholetext", True).load(landing).select(F.col("_metadata.file_name").alias("original_filename"), F.col("value").alias("raw_text"), F.current_timestamp().alias("created_at"))
    return files.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)


def pruned_snapshots(snapshots: DataFrame, keep: int = 14) -> DataFrame:
    """Backups with kept: the newest of each kind. Only each task's newest of a kind are sorted together."""
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("created_at"), F.desc("name")))
    newest = snapshots.withColumn("_rank", rank).where(F.col("_rank") <= keep).select("kind", "created_at", "name").distinct().withColumn("_kept", F.lit(True))
    return snapshots.join(newest, ["kind", "created_at", "name"], "left").select(*snapshots.columns, F.coalesce("_kept", F.lit(False)).alias("kept"))


def write_snapshot(records: DataFrame, path: str, taken_at: str) -> str:
    """A dump of records as a table of its own under path; its folder's name, which pruned_snapshots() takes."""
    name = f"{path}/{re.sub('[^0-9]', '', taken_at)}"
    records.write.mode("errorifexists").parquet(name)
    return name
