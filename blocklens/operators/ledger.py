"""Hash-chained audit ledgers and evidence custody (AUD-1..6, JN-10, CUS-1..6).

A chain is keyed (by case, or one constant key for a single global chain). Checking needs
each row's predecessor only, so it runs in slices of the sequence axis and a hot chain is
spread. Appending is sequential inside one chain by definition; it streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from blocklens.operators import slices
from blocklens.session import cut_lineage

# fixed values: predecessor of the first entry, order of the hashed fields
GENESIS = "0" * 64
HASHED = ["seq", "timestamp_utc", "operator_id", "case_id", "operation", "target_descriptor", "result"]
SEQ_SLICE = 1 << 16


def canonical_json() -> Column:
    """The hashed fields as compact JSON; they must not be null."""
    return F.to_json(F.struct(*HASHED))


def entry_hash(prev: Column) -> Column:
    """AUD-1."""
    return F.sha2(F.concat(canonical_json(), F.lit("||"), prev), 256)


def _first_failure(checked: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per chain: size, bounds, head and the first failure if any."""
    bad = F.when(F.col("failure").isNotNull(), F.struct(order, "failure", "seq"))
    return checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"), F.min("seq").alias("first_seq"), F.max("seq").alias("latest_seq"),
        F.max_by("entry_hash", order).alias("latest_hash"), F.min(bad).alias("_f")).select(
        *keys, "entries", "first_seq", "latest_seq", "latest_hash", F.col("_f").isNull().alias("is_valid"),
        F.col("_f.failure").alias("failure"), F.col("_f.seq").alias("failed_seq"))


def check_entries(entries: DataFrame, keys: Sequence[str], seq_slice: int = SEQ_SLICE) -> DataFrame:
    """AUD-2 per entry: gap, then broken link, then hash mismatch."""
    cut = slices.by_width("seq", seq_slice)
    rows = slices.row_numbers(entries, keys, ["seq", "entry_hash"], cut, "_pos")
    rows = slices.previous_row(rows, keys, ["seq", "entry_hash"], cut, {"_ph": "entry_hash"})
    failure = (F.when(F.col("seq") != F.col("_pos"), "gap")
               .when(F.col("prev_hash") != F.coalesce("_ph", F.lit(GENESIS)), "broken")
               .when(F.col("entry_hash") != entry_hash(F.col("prev_hash")), "mismatch"))
    return rows.withColumn("failure", failure).drop("_ph")


def verify_chain(entries: DataFrame, keys: Sequence[str], seq_slice: int = SEQ_SLICE) -> DataFrame:
    """AUD-2: first failure of every chain; a chain without rows is valid and has no row."""
    return _first_failure(check_entries(entries, keys, seq_slice), keys, "_pos")


def verify_segment(reports: DataFrame, segment: str = "audit_chain_segment") -> DataFrame:
    """AUD-3: a report's nested segment: may start anywhere, first link free, empty fails."""
    rows = reports.select("report_id", F.posexplode(segment).alias("_i", "_e")).select("report_id", F.col("_i").cast("bigint").alias("_i"), "_e.*")
    prev = slices.previous_row(rows, ["report_id"], ["_i"], slices.by_width("_i", SEQ_SLICE), {"_ph": "entry_hash", "_ps": "seq"})
    failure = (F.when((F.col("seq") != F.col("_i") + 1) & (F.col("_i") > 0) & (F.col("seq") != F.col("_ps") + 1), "gap")
               .when((F.col("_i") > 0) & (F.col("prev_hash") != F.col("_ph")), "broken")
               .when(F.col("entry_hash") != entry_hash(F.col("prev_hash")), "mismatch"))
    got = _first_failure(prev.withColumn("failure", failure), ["report_id"], "_i").select("report_id", "is_valid", "failure", "failed_seq")
    out = reports.select("report_id").join(got, "report_id", "left")
    return (out.withColumn("failure", F.when(F.col("is_valid").isNull(), "empty").otherwise(F.col("failure")))
            .withColumn("is_valid", F.coalesce("is_valid", F.lit(False))))


def link(prev: str, body: str) -> str:
    """AUD-1 of one canonical body, outside the JVM."""
    return hashlib.sha256(f"{body}||{prev}".encode()).hexdigest()


def json_tail() -> Column:
    """``canonical_json`` behind its sequence number."""
    rest = F.to_json(F.struct(*HASHED[1:]))
    return F.when(rest == "{}", "}").otherwise(F.concat(F.lit(","), F.substring(rest, 2, 1 << 30)))


def chain_fold(prev: str, bodies) -> list[tuple[str, str]]:
    """``(prev_hash, entry_hash)`` of consecutive canonical bodies."""
    out = []
    for body in bodies:
        mine = link(prev, body)
        out.append((prev, mine))
        prev = mine
    return out


def append_chain(events: DataFrame, keys: Sequence[str], order: Sequence[str], cut: Column | None = None, heads: DataFrame | None = None) -> DataFrame:
    """AUD-4: sequence numbers and linked hashes for new events, in ``order`` per chain.

    JSON is made in parallel; only the hash itself is sequential, and the numbers are counted beside it. Rows pass the fold as they are,
    in one shuffle, and stream through sorted partitions, so a long chain costs time in one task but no memory. ``cut`` is not
    needed for that and only taken for its callers. ``heads`` (AUD-5) continues existing chains.
    """
    keys = list(keys)
    rows = events.drop("seq")
    rest = [c for c in rows.columns if c not in keys]
    if heads is not None:
        rows = rows.join(heads.select(*keys, F.col("latest_seq").alias("_s"), F.col("latest_hash").alias("_h")), keys, "left")
    else:
        rows = rows.withColumns({"_s": F.lit(None).cast("bigint"), "_h": F.lit(None).cast("string")})
    small = rows.select(*keys, *rest, "_s", "_h", json_tail().alias("_tail"))
    kept = [f for f in small.schema.fields if f.name not in ("_s", "_h", "_tail")]
    schema = StructType([*kept, StructField("seq", LongType()), StructField("prev_hash", StringType()), StructField("entry_hash", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seq, prev = None, 0, GENESIS
        for batch in batches:
            chains = zip(*[batch.column(k).to_pylist() for k in keys])
            seqs, before, after = [], [], []
            for chain, s, h, tail in zip(chains, *[batch.column(c).to_pylist() for c in ("_s", "_h", "_tail")]):
                if chain != current:
                    current, seq, prev = chain, s or 0, h or GENESIS
                seq += 1
                seqs.append(seq)
                before.append(prev)
                prev = link(prev, f'{{"seq":{seq}{tail}')
                after.append(prev)
            new = [pa.array(seqs, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *new], names=schema.names)

    linked = small.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
    return linked.select(*keys, "seq", *rest, "prev_hash", "entry_hash")


def chain_head(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AUD-5."""
    return entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"), F.min("seq").alias("first_seq"), F.max("seq").alias("latest_seq"),
        F.max_by("entry_hash", "seq").alias("latest_hash"))


def audit_trail(entries: DataFrame, case_id=None, operation: str | None = None) -> DataFrame:
    """AUD-6: entries in order, optionally of one case or operation."""
    out = entries if case_id is None else entries.where(F.col("case_id") == case_id)
    out = out if operation is None else out.where(F.col("operation") == operation)
    return out.orderBy("case_id", "seq")


def anchor_check(anchors: DataFrame, entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN-10: an exported head against the ledger now."""
    now = entries.select(*keys, "seq", F.col("entry_hash").alias("ledger_hash"))
    status = (F.when(F.col("ledger_hash").isNull(), "deleted").when(F.col("ledger_hash") != F.col("head_hash"), "rewritten")
              .otherwise("consistent"))
    return anchors.join(now, [*keys, "seq"], "left").withColumn("status", status)


# ---- custody -----------------------------------------------------------------------
OPENING, TERMINAL = ["Seized", "Received"], ["Returned", "Disposed"]


def custody_history(events: DataFrame, keys=("evidence_id",), hours: int = 24) -> DataFrame:
    """CUS-1: events of each item numbered by time, then event id."""
    return slices.row_numbers(events, list(keys), ["ts", "event_id"], slices.by_hours("ts", hours), "position")


def custody_violations(history: DataFrame, keys=("evidence_id",), order=("event_id",), cut: Column | None = None) -> DataFrame:
    """CUS-2: each recorded event against the one before it."""
    cut = slices.by_width("event_id", SEQ_SLICE) if cut is None else cut
    prev = slices.previous_row(history, list(keys), list(order), cut, {"_pt": "event_type", "_pts": "ts"})
    rule = (F.when(F.col("_pt").isNull(), F.when(~F.col("event_type").isin(OPENING), "invalid_initial"))
            .when(F.col("_pt").isin(TERMINAL), "after_terminal")
            .when((F.col("event_type") == "Transferred") & (F.col("from_party").isNull() | F.col("to_party").isNull()), "missing_parties")
            .when(F.col("ts") < F.col("_pts"), "time_backwards"))
    return prev.withColumn("violation", rule).drop("_pt", "_pts")


def judge(last: tuple[str, float | None] | None, kind: str, has_parties: bool, at: float | None) -> str | None:
    """Reason to refuse an attempt after the last accepted event, or None."""
    if last is None:
        return None if kind in OPENING else "invalid_initial"
    if last[0] in TERMINAL:
        return "after_terminal"
    if kind == "Transferred" and not has_parties:
        return "missing_parties"
    if at is not None and last[1] is not None and at < last[1]:
        return "time_backwards"
    return None


def fold_attempts(pdf: pd.DataFrame, last):
    """Walk attempts in ``event_id`` order; gives reasons and the new last accepted event."""
    reasons = []
    for kind, parties, at in zip(pdf["event_type"], pdf["has_parties"], pdf["micros"]):
        why = judge(last, kind, bool(parties), None if pd.isna(at) else int(at))
        reasons.append(why)
        if why is None:
            last = (kind, None if pd.isna(at) else int(at))
    return reasons, last


def attempts_of(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only what the rules need; an unparsable time (null) is not compared."""
    return events.select(*keys, "event_id", "event_type", (F.col("from_party").isNotNull() & F.col("to_party").isNotNull()).alias("has_parties"),
                         F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))


def custody_admit(events: DataFrame, keys=("evidence_id",), slice_width: int = SEQ_SLICE) -> DataFrame:
    """CUS-3: like CUS-2, but a refused attempt does not enter the history.

    The last accepted event need not be carried along: nothing is accepted before the first opening; from there an attempt with its parties is
    refused if it is earlier than some such attempt before it, because the accepted times only rise; a time that cannot be read is
    accepted and starts the comparison anew; nothing is accepted after the first accepted terminal event. Running maxima
    in slices of ``event_id`` decide it, in a fixed number of steps.
    """
    keys = list(keys)
    cut = slices.by_width("event_id", slice_width)
    kind = F.col("event_type")
    rows = attempts_of(events, keys)
    opened = rows.where(kind.isin(OPENING)).groupBy(*keys).agg(F.min("event_id").alias("_open"))
    rows = rows.join(opened, keys, "left").withColumn("_begun", F.coalesce(F.col("event_id") >= F.col("_open"), F.lit(False)))
    rows = rows.withColumn("_lacks", (kind == "Transferred") & ~F.col("has_parties")).withColumn("_counts", F.col("_begun") & ~F.col("_lacks"))
    rows = slices.running_total(rows, keys, ["event_id"], cut, (F.col("_counts") & F.col("micros").isNull()).cast("bigint"), "_part", inclusive=False)
    rows = slices.max_so_far(rows, [*keys, "_part"], ["event_id"], cut, F.when(F.col("_counts"), F.col("micros")), "_latest")
    rows = cut_lineage(rows.withColumn("_early", F.coalesce(F.col("micros") < F.col("_latest"), F.lit(False))))
    ended = rows.where(F.col("_counts") & ~F.col("_early") & kind.isin(TERMINAL)).groupBy(*keys).agg(F.min("event_id").alias("_end"))
    reason = (F.when(~F.col("_begun"), "invalid_initial").when(F.col("event_id") > F.col("_end"), "after_terminal")
              .when(F.col("_lacks"), "missing_parties").when(F.col("_early"), "time_backwards"))
    done = rows.join(ended, keys, "left").withColumn("reason", reason)
    return done.select(*keys, "event_id", "event_type", "reason", F.col("reason").isNull().alias("accepted"))


def custody_current(history: DataFrame, keys=("evidence_id",), order=("ts", "event_id")) -> DataFrame:
    """CUS-4: last known owner and last known place, each keeping its last non-null."""
    o = F.struct(*order)
    owner = F.coalesce("to_party", "from_party")
    return history.groupBy(*keys).agg(
        F.max_by(owner, F.when(owner.isNotNull(), o)).alias("current_owner"),
        F.max_by("location", F.when(F.col("location").isNotNull(), o)).alias("current_location"))


def custody_ledger_text(history: DataFrame) -> DataFrame:
    """CUS-5: one formatted line per event in column ``line``."""
    both = F.col("from_party").isNotNull() & F.col("to_party").isNotNull()
    who = F.when(both, F.concat(F.lit(" from "), "from_party", F.lit(" to "), "to_party")).when(
        F.coalesce("to_party", "from_party").isNotNull(), F.concat(F.lit(" by "), F.coalesce("to_party", "from_party"))).otherwise("")
    extra = F.lit("")
    for name, shape in (("location", " [Loc: %s]"), ("purpose", " (Purpose: %s)"), ("evidence_condition", " [Cond: %s]")):
        if name in history.columns:
            extra = F.concat(extra, F.when(F.col(name).isNotNull(), F.format_string(shape, F.col(name))).otherwise(""))
    when = F.rpad(F.date_format("ts", "HH:mm 'UTC' (yyyy-MM-dd)"), 25, " ")
    return history.withColumn("line", F.concat(F.lit("  "), when, F.lit(" "), F.col("event_type"), who, extra))


def case_transitions(changes: DataFrame, keys=("case_id",), order=("change_id",), cut: Column | None = None) -> DataFrame:
    """CUS-6: offending changes: a closed case reopened, or any deletion."""
    cut = slices.by_width(order[0], SEQ_SLICE) if cut is None else cut
    prev = slices.previous_row(changes, list(keys), list(order), cut, {"_was": "status"})
    offence = (F.when(F.col("action") == "delete", "deleted")
               .when((F.col("_was") == "Closed") & (F.col("status") != "Closed"), "reopened"))
    return prev.withColumn("offence", offence).drop("_was").where("offence IS NOT NULL")
