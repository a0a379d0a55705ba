"""Structured Streaming jobs over the feeds (STR-1..6)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from blocklens.functions import rules
from blocklens.operators import acquire, carve, fsmeta, ledger


def health_alerts(telemetry: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """STR-1: worst status per device and tumbling window; later than the watermark is dropped."""
    rank = rules.health_rank(rules.health_status())
    timed = telemetry.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return (timed.groupBy("device_id", F.window("ts", window)).agg(F.max(rank).alias("worst"), F.count(F.lit(1)).alias("readings"))
            .select("device_id", F.col("window.start").alias("window_start"), rules.health_name(F.col("worst")).alias("status"), "readings"))


def custody_stream(attempts: DataFrame, key: str = "evidence_id") -> DataFrame:
    """STR-2: CUS-3 on a stream; the state is the last accepted event and outlives a terminal one.

    A trigger's rows of one item are ordered by event id; the trigger size bounds them.
    """
    small = ledger.attempts_of(attempts, [key])
    kind = small.schema[key].dataType.simpleString()

    def step(keys, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = None
        if state.exists:
            name, at = state.get
            last = (name, at)
        rows = pd.concat(list(batches)).sort_values("event_id")
        reasons, last = ledger.fold_attempts(rows, last)
        if last is not None:
            state.update(last)
        yield pd.DataFrame({key: rows[key], "event_id": rows["event_id"], "event_type": rows["event_type"], "reason": reasons,
                            "accepted": [r is None for r in reasons]})

    return small.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, event_id bigint, event_type string, reason string, accepted boolean", "kind string, at bigint",
        "append", GroupStateTimeout.NoTimeout)


def _in_order(numbered: DataFrame, key: str, number: Column | str, *fields: Column | str) -> DataFrame:
    """``key`` and one array of texts, the number first: what a chain costs in a trigger is mostly its columns and frames, not its rows."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in (number, *fields)]
    return numbered.select(key, F.array(*texts).alias("_row"))


def _rows(batches: Iterator[pd.DataFrame]) -> list[tuple]:
    """The arrays of one chain, ordered by their number, then by the texts behind it; nulls come last."""
    rows = [(None if r[0] is None else int(r[0]), *r[1:]) for pdf in batches for r in pdf["_row"]]
    rows.sort(key=lambda r: [(v is None, 0 if v is None else v) for v in r[:2]])
    return rows


def audit_stream(entries: DataFrame, key: str = "case_id") -> DataFrame:
    """STR-3: AUD-2 continuously. Hashes are recomputed in the JVM; the state is (seq, head hash)."""
    small = _in_order(entries, key, "seq", "entry_hash", "prev_hash", ledger.entry_hash(F.col("prev_hash")))
    kind = small.schema[key].dataType.simpleString()

    def step(keys, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, head = state.get if state.exists else (0, ledger.GENESIS)
        rows, out = _rows(batches), []
        for s, mine, prev, again in rows:
            seq += 1
            out.append("gap" if s != seq else "broken" if prev != head else "mismatch" if mine != again else None)
            head = mine
        state.update((seq, head))
        yield pd.DataFrame({key: [keys[0]] * len(rows), "seq": [r[0] for r in rows], "failure": out})

    return small.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, seq bigint, failure string", "seq bigint, head string", "append", GroupStateTimeout.NoTimeout)


def append_stream(events: DataFrame, key: str = "case_id") -> DataFrame:
    """AUD-4 on a stream: numbers and links new events behind the head kept as state."""
    small = _in_order(events, key, "event_id", ledger.json_tail())
    kind = small.schema[key].dataType.simpleString()

    def step(keys, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, head = state.get if state.exists else (0, ledger.GENESIS)
        rows = _rows(batches)
        links = ledger.chain_fold(head, [f'{{"seq":{seq + 1 + i}{r[1]}' for i, r in enumerate(rows)])
        state.update((seq + len(rows), links[-1][1]))
        yield pd.DataFrame({key: [keys[0]] * len(rows), "event_id": [r[0] for r in rows], "seq": range(seq + 1, seq + 1 + len(rows)),
                            "prev_hash": [a for a, _ in links], "entry_hash": [b for _, b in links]})

    return small.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, event_id bigint, seq bigint, prev_hash string, entry_hash string", "seq bigint, head string",
        "append", GroupStateTimeout.NoTimeout)


def progress_stream(progress: DataFrame) -> DataFrame:
    """STR-4: latest position, bytes and bad blocks per job, with percent; for update mode."""
    latest = F.max_by(F.struct("current_lba", "total_blocks", "bytes_written"), F.struct("current_lba", "event_id"))
    return (progress.groupBy("job_id").agg(latest.alias("_l"), F.sum("bad_blocks").alias("bad_blocks"))
            .select("job_id", "_l.*", "bad_blocks", acquire.percent_done(F.col("_l.current_lba"), F.col("_l.total_blocks")).alias("percent")))


def deletion_stream(usn: DataFrame, keys: Sequence[str] = ("volume",), delay: str = "1 hour") -> DataFrame:
    """STR-5: FSC-7 deletions, every usn once within the watermark."""
    timed = fsmeta.journal_flags(usn).where("is_deletion").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.dropDuplicatesWithinWatermark([*keys, "usn"])


def carve_stream(chunks: DataFrame, signatures: DataFrame, totals: DataFrame, store: str, checkpoint: str,
                 keys: Sequence[str] = ("image_id",), window_blocks: int = carve.FIRST_WINDOW, head_bytes: int | None = None) -> DataStreamWriter:
    """STR-6: CRV-1 and CRV-2 on chunks as they land, in block order per image.

    Every trigger writes folders named by its batch id (landed chunks, positions of open
    candidates, verdicts), so a repeated batch overwrites its own output. A candidate whose
    window is not wholly covered by landed blocks stays open until a later chunk completes it.
    """
    keys = list(keys)
    head_bytes = carve.head_reach(signatures) if head_bytes is None else head_bytes
    on = [*keys, "lba", "sig_order"]
    fields = [*keys, "lba", "sig_order", "file_type", "validator_id", "max_size_bytes", "limit_blocks", "window_blocks"]

    def trigger(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/chunks/batch={epoch}")
        new = spark.read.parquet(f"{store}/chunks/batch={epoch}")
        landed = spark.read.option("basePath", f"{store}/chunks").parquet(f"{store}/chunks").where(F.col("batch") <= epoch).drop("batch")
        hits = carve.candidates(carve.block_heads(new, keys, head_bytes), signatures, keys)
        sized = carve.windowed(hits, totals, keys, window_blocks).select(*fields)
        sized.write.mode("overwrite").parquet(f"{store}/candidates/batch={epoch}")
        every = spark.read.option("basePath", f"{store}/candidates").parquet(f"{store}/candidates").where(F.col("batch") <= epoch).drop("batch")
        done = _verdicts(spark, store, epoch)
        open_ = every if done is None else every.join(done.select(*on), on, "left_anti")
        end = landed.groupBy(*keys).agg(F.max(F.col("start_lba") + F.col("n")).alias("_end"))
        ready = open_.join(end, keys).where(F.col("lba") + F.col("window_blocks") <= F.col("_end"))
        w = carve.candidate_windows(ready, landed, keys, carry=["file_type", "validator_id"])
        got = carve.validate_candidates(w).select(*on, "file_type", "verdict", "length")
        got.write.mode("overwrite").parquet(f"{store}/verdicts/batch={epoch}")

    return chunks.writeStream.foreachBatch(trigger).option("checkpointLocation", checkpoint)


def _verdicts(spark, store: str, before: int) -> DataFrame | None:
    if before == 0:
        return None
    return spark.read.option("basePath", f"{store}/verdicts").parquet(f"{store}/verdicts").where(F.col("batch") < before)
