"""Signature carving and two-fragment reassembly (JN-1, JN-5, JN-6, JN-14, CRV-1..13, CNF wiring).

Images are tables of chunks ``(image_id, chunk_no, start_lba, n, payload)`` near 64 KiB.
Only small rows (positions, verdicts, claims) travel between steps; payload windows are
built for the candidates of one step and dropped with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from blocklens.functions import native_packs, packs, scoring
from blocklens.functions import payload as kern
from blocklens.operators import acquire, byte_stats, filters, longobjects, ranges, slices
from blocklens.session import cut_lineage

BLOCK = 512
CHUNK_BLOCKS = 128
FIRST_WINDOW, WIDE_WINDOW = 2048, 16384
# blocks of a span that moves once for all windows starting in it; the reach window of tier 3 is a little larger than NEAR
NEAR, NEAR_REACH, FAR = FIRST_WINDOW, CHUNK_BLOCKS, WIDE_WINDOW
# bytes of an object that fit a row; larger ones are judged from marks and described by their pieces
MAX_PAYLOAD = 256 << 20
FOLD_SLICE = 1 << 16

# fixed values: gaps tried first, fragment sizes tried, id bases of the three tiers
LIKELY_GAPS = [8, 16, 32, 4, 64, 24, 40, 128, 256, 512, 1024, 2048]
MAX_EXPECTED = 16
DEFAULT_RADIUS = 2048
TIER_BASE = {1: 1000, 2: 2000, 3: 3000}
# fixed values: formats whose error in a prefix is final
PREFIX_FINAL = ["png", "jpeg", "mp4"]


def match_headers(blocks: DataFrame, signatures: DataFrame, head: str = "head") -> DataFrame:
    """JN-1: blocks whose bytes at the signature's offset equal its header.

    Signatures of equal (offset, length) are looked up together: a compiled set test per such shape drops the blocks
    that match nothing, and the few survivors meet the table in an equi-join on the sliced bytes, one slice per shape. The
    signature table is configuration; any number of rows and shapes takes the same plan.
    """
    shapes: dict[tuple[int, int], list[bytes]] = {}
    for s in signatures.select("header_offset", "header").distinct().collect():
        shapes.setdefault((s["header_offset"], len(s["header"])), []).append(bytes(s["header"]))
    any_hit, kinds = F.lit(False), sorted(shapes)
    for o, n in kinds:
        any_hit = any_hit | F.substring(head, o + 1, n).isin(shapes[o, n])
    probe = F.explode(F.array(*[F.struct(F.lit(o).alias("_o"), F.lit(n).alias("_n"), F.substring(head, o + 1, n).alias("_k")) for o, n in kinds])
                      if kinds else F.array().cast("array<struct<_o:int,_n:int,_k:binary>>"))
    return (blocks.where(any_hit).withColumn("_probe", probe).select("*", "_probe.*").drop("_probe")
            .join(signatures, (F.col("_o") == F.col("header_offset")) & (F.col("_n") == F.octet_length("header"))
                  & (F.col("_k") == F.col("header"))).drop("_o", "_n", "_k"))


def head_reach(signatures: DataFrame, block_size: int = BLOCK) -> int:
    """Bytes of a block that some signature looks at; a header never reaches past its block."""
    reach = signatures.agg(F.max(F.col("header_offset") + F.octet_length("header"))).first()[0]
    return min(int(reach or 1), block_size)


def to_chunks(sectors: DataFrame, keys: Sequence[str], chunk_blocks: int = CHUNK_BLOCKS) -> DataFrame:
    """Group a sector table to chunks of at most ``chunk_blocks`` rows each; absent sectors end a chunk's row."""
    no = slices.idiv(F.col("lba"), chunk_blocks).alias("chunk_no")
    placed = sectors.select("*", no)
    run = F.col("lba") - F.row_number().over(Window.partitionBy(*keys, "chunk_no").orderBy("lba"))
    return (placed.withColumn("_run", run).groupBy(*keys, "chunk_no", "_run").agg(
        F.min("lba").alias("start_lba"), F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("lba", "payload"))).alias("_parts"))
        .withColumn("payload", _glue(F.transform("_parts", lambda x: x["payload"]))).drop("_parts", "_run"))


def by_place(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunk rows under the numbers ``lba div CHUNK_BLOCKS`` they cover, whatever size they were read in."""
    cover = F.sequence(slices.idiv(F.col("start_lba"), CHUNK_BLOCKS), slices.idiv(F.col("start_lba") + F.col("n") - 1, CHUNK_BLOCKS))
    return chunks.where("n > 0").select(*keys, F.explode(cover).alias("chunk_no"), "start_lba", "n", "payload")


def _glue(parts: Column) -> Column:
    """Concatenate an array of binaries in linear time (one character per byte)."""
    return F.encode(F.array_join(F.transform(parts, scoring.latin), ""), "ISO-8859-1")


def block_heads(chunks: DataFrame, keys: Sequence[str], head_bytes: int = BLOCK, block_size: int = BLOCK) -> DataFrame:
    """One narrow row per block: its first bytes."""
    at = F.posexplode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("_p", "_i")
    return (chunks.where("n > 0").select(*keys, "start_lba", "payload", at)
            .select(*keys, (F.col("start_lba") + F.col("_i")).alias("lba"),
                    F.substring(F.col("payload"), F.col("_i") * block_size + 1, F.lit(head_bytes)).alias("head")))


def total_blocks(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return chunks.groupBy(*keys).agg(F.max(F.col("start_lba") + F.col("n")).alias("total_blocks"))


def candidates(blocks: DataFrame, signatures: DataFrame, keys: Sequence[str], allocated: DataFrame | None = None,
               types: Sequence[str] | None = None) -> DataFrame:
    """CRV-1: header hits outside allocated extents, signature order kept as tie-break."""
    hits = match_headers(blocks, filters.filter_target_types(signatures, types)).drop("head")
    if allocated is not None:
        hits = ranges.points_in_ranges(hits, allocated, keys, "left_anti")
    return hits


def candidate_windows(cands: DataFrame, chunks: DataFrame, keys: Sequence[str], blocks: str = "window_blocks",
                      block_size: int = BLOCK, carry: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """JN-5: the bytes of ``[lba, lba + window_blocks)`` per candidate; none if a block of it is absent.

    Windows overlap, chunks do not: the medium moves in spans of ``NEAR`` or ``FAR`` blocks and the windows that start in one, twice its
    bytes however dense the candidates are; a window exists only inside the task that reads it. Windows above ``FAR``
    are put together from their own pieces. ``most`` says how many blocks a window has at most; without it the rows are asked.
    """
    ids = list(dict.fromkeys([*keys, "lba", "sig_order", blocks, *carry]))
    asked = cands.select(*ids).where(F.col(blocks) > 0)
    level = F.when(F.col(blocks) <= NEAR + NEAR_REACH, 0).when(F.col(blocks) <= FAR, 1).otherwise(2)
    levels = [0] if most is not None and most <= NEAR + NEAR_REACH else sorted(r[0] for r in asked.select(level.alias("_l")).distinct().collect())
    out = None
    for k in levels or [0]:
        rows = asked.where(level == k)
        got = _own_pieces(rows, chunks, keys, ids, blocks, block_size) if k == 2 else _from_spans(
            rows, chunks, keys, ids, blocks, block_size, *((NEAR, NEAR + NEAR_REACH), (FAR, FAR))[k])
        out = got if out is None else out.unionByName(got)
    return out


def _from_spans(cands: DataFrame, chunks: DataFrame, keys: Sequence[str], ids: Sequence[str], blocks: str, block_size: int, stride: int, reach: int) -> DataFrame:
    """Windows of at most ``reach`` blocks: span ``s`` holds the blocks ``[s * stride, (s + 1) * stride + reach)`` that are present."""
    place = [*keys, "_span"]
    rest = [c for c in ids if c not in keys]
    asked = cands.withColumn("_span", slices.idiv(F.col("lba"), stride)).groupBy(*place).agg(F.collect_list(F.struct(*rest)).alias("_asked"))
    end = F.col("start_lba") + F.col("n")
    first = F.greatest(slices.idiv(F.col("start_lba") - reach, stride), F.lit(0).cast("bigint"))
    held = chunks.where("n > 0").select(*keys, "start_lba", "n", "payload", F.explode(F.sequence(first, slices.idiv(end - 1, stride))).alias("_span"))
    lo, hi = F.greatest(F.col("start_lba"), F.col("_span") * stride), F.least(end, (F.col("_span") + 1) * stride + reach)
    cut = F.substring(F.col("payload"), ((lo - F.col("start_lba")) * block_size + 1).cast("int"), ((hi - lo) * block_size).cast("int"))
    held = held.where(hi > lo).select(*place, F.struct(lo.alias("at"), (hi - lo).alias("n"), cut.alias("part")).alias("_part"))
    # a span is small on the way and large in work: its partitions are not to be merged by their bytes
    held = held.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *place)
    parts = F.array_sort(F.collect_list("_part"))
    spans = held.join(asked, place).groupBy(*place).agg(
        F.first("_asked").alias("_asked"), F.transform(parts, lambda x: F.struct(x["at"], x["n"])).alias("_runs"),
        _glue(F.transform(parts, lambda x: x["part"])).alias("_bytes"))
    # present blocks of the span below a block number
    below = lambda at: F.aggregate("_runs", F.lit(0).cast("bigint"), lambda n, x: n + F.least(x["n"], F.greatest(at - x["at"], F.lit(0))))
    one = spans.select(*keys, "_runs", "_bytes", F.explode("_asked").alias("_c")).select(*keys, "_c.*", "_bytes", below(F.col("_c.lba")).alias("_skip"),
                                                                                         below(F.col("_c.lba") + F.col(f"_c.{blocks}")).alias("_to"))
    payload = F.substring(F.col("_bytes"), (F.col("_skip") * block_size + 1).cast("int"), (F.col(blocks) * block_size).cast("int"))
    return one.where(F.col("_to") - F.col("_skip") == F.col(blocks)).select(*ids, payload.alias("payload"))


def _own_pieces(cands: DataFrame, chunks: DataFrame, keys: Sequence[str], ids: Sequence[str], blocks: str, block_size: int) -> DataFrame:
    """Windows of any size, each from the pieces it touches: an equi-join on (keys, place)."""
    first = slices.idiv(F.col("lba"), CHUNK_BLOCKS)
    last = slices.idiv(F.col("lba") + F.col(blocks) - 1, CHUNK_BLOCKS)
    pieces = cands.withColumn("chunk_no", F.explode(F.sequence(first, last)))
    j = pieces.join(by_place(chunks, keys), [*keys, "chunk_no"])
    at = F.col("chunk_no") * CHUNK_BLOCKS
    lo = F.greatest(F.col("lba"), F.col("start_lba"), at)
    hi = F.least(F.col("lba") + F.col(blocks), F.col("start_lba") + F.col("n"), at + CHUNK_BLOCKS)
    part = F.substring(F.col("payload"), ((lo - F.col("start_lba")) * block_size + 1).cast("int"),
                       ((hi - lo) * block_size).cast("int"))
    return (j.where(hi > lo).groupBy(*ids)
            .agg(F.sum(hi - lo).alias("_read"), F.array_sort(F.collect_list(F.struct(lo.alias("at"), part.alias("part")))).alias("_parts"))
            .where(F.col("_read") == F.col(blocks))
            .withColumn("payload", _glue(F.transform("_parts", lambda x: x["part"]))).drop("_parts", "_read"))


def windowed(cands: DataFrame, totals: DataFrame, keys: Sequence[str], max_blocks: int, block_size: int = BLOCK) -> DataFrame:
    """Size of the read window: format limit, end of medium and ``max_blocks``."""
    want = F.ceil(F.col("max_size_bytes") / block_size)
    return (cands.join(totals, list(keys))
            .withColumn("limit_blocks", F.least(want, F.col("total_blocks") - F.col("lba")).cast("bigint"))
            .withColumn("window_blocks", F.least("limit_blocks", F.lit(max_blocks)).cast("bigint")))


def verdict_column(validator: Column, payload: Column, python_packs: Mapping[str, Callable] = packs.PACKS,
                   native: Mapping[str, Callable] = native_packs.NATIVE) -> Column:
    """Verdict struct of one window: native rule packs first, Arrow UDF for the byte walkers."""
    table = dict(python_packs)

    @F.pandas_udf(native_packs.VERDICT)
    def walk(kind: pd.Series, data: pd.Series) -> pd.DataFrame:
        rows = [table[k](d) if d is not None and k in table else (None, None, None) for k, d in zip(kind, data)]
        return pd.DataFrame({"verdict": [r[0] for r in rows], "length": pd.array([r[1] for r in rows], dtype="Int64"),
                             "reason": [r[2] for r in rows]})

    walked = walk(validator, F.when(validator.isin(list(table)), payload))
    out = None
    for name, check in native.items():
        out = F.when(validator == name, check(payload)) if out is None else out.when(validator == name, check(payload))
    return walked if out is None else out.otherwise(walked)


def validate_candidates(windows: DataFrame, validator: str = "validator_id", **registry) -> DataFrame:
    """CRV-2: verdict, length and reason per window; the payload stays in the JVM."""
    v = verdict_column(F.col(validator), F.col("payload"), **registry)
    return (windows.withColumn("_v", v).withColumn("window_bytes", F.octet_length("payload").cast("bigint"))
            .select(*windows.columns, "window_bytes", "_v.verdict", "_v.length", "_v.reason"))


def verdict_summary(validated: DataFrame, keys: Sequence[str]) -> DataFrame:
    return validated.groupBy(*keys, "file_type", "verdict").agg(F.count(F.lit(1)).alias("n"))


CARRY = ["file_type", "validator_id", "max_size_bytes", "limit_blocks"]


def judged(cands: DataFrame, chunks: DataFrame, totals: DataFrame, keys: Sequence[str], first_window: int = FIRST_WINDOW,
           wide_window: int = WIDE_WINDOW, **registry) -> DataFrame:
    """CRV-2 plus CRV-3: small rows ``(keys, lba, sig_order, file_type, verdict, length, ...)``.

    Candidates still at EOF in the first window run again in a wider one, when the format allows more, and then over all blocks the
    format allows: from the mark index where the format has one (``longobjects``), at any size; other formats in one window of at
    most ``MAX_PAYLOAD``. A wider verdict is adopted if OK or EOF.
    """
    sized = windowed(cands, totals, keys, first_window)
    now = cut_lineage(validate_candidates(candidate_windows(sized, chunks, keys, carry=CARRY, most=first_window), **registry).drop("payload"))
    now = cut_lineage(_adopted(now, expand_window(now, chunks, keys, wide_window, **registry), keys, wide_window))
    larger = now.where(f"verdict = 'EOF' AND limit_blocks > window_blocks AND window_blocks >= {wide_window}")
    if larger.isEmpty():
        return now.drop("window_blocks")
    python, native = registry.get("python_packs", packs.PACKS), registry.get("native", native_packs.NATIVE)
    indexed = [k for k in longobjects.KINDS if python.get(k) is packs.PACKS.get(k) and native.get(k) is native_packs.NATIVE.get(k)]
    by_mark = F.col("validator_id").isin(indexed)
    far = longobjects.verdicts(larger.where(by_mark), chunks, keys).join(larger.select(*keys, "lba", "sig_order", (F.col("limit_blocks") * BLOCK).alias("window_bytes")), [*keys, "lba", "sig_order"])
    far = far.select(*keys, "lba", "sig_order", F.col("verdict").alias("wide_verdict"), F.col("length").alias("wide_length"),
                     F.lit(None).cast("string").alias("wide_reason"), F.col("window_bytes").alias("wide_window_bytes"))
    rest = expand_window(larger.where(~by_mark), chunks, keys, MAX_PAYLOAD // BLOCK, **registry)
    return cut_lineage(_adopted(now, far.unionByName(rest), keys, MAX_PAYLOAD // BLOCK)).drop("window_blocks")


def _adopted(now: DataFrame, wider: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    on = [*keys, "lba", "sig_order"]
    use = F.col("wide_verdict").isin("OK", "EOF")
    picks = [F.when(use, F.col(f"wide_{c}")).otherwise(F.col(c)).alias(c) for c in ("verdict", "length", "reason", "window_bytes")]
    blocks = F.when(F.col("wide_verdict").isNotNull(), F.least("limit_blocks", F.lit(window)).cast("bigint")).otherwise(F.col("window_blocks"))
    return now.join(wider, on, "left").select(*on, *CARRY, blocks.alias("window_blocks"), *picks)


def expand_window(validated: DataFrame, chunks: DataFrame, keys: Sequence[str], wide_window: int = WIDE_WINDOW, **registry) -> DataFrame:
    """CRV-3: verdicts of the wider window for EOF candidates that may be larger."""
    more = (validated.where((F.col("verdict") == "EOF") & (F.col("limit_blocks") > F.col("window_blocks")))
            .withColumn("window_blocks", F.least("limit_blocks", F.lit(wide_window)).cast("bigint")))
    got = validate_candidates(candidate_windows(more, chunks, keys, carry=CARRY), **registry)
    return got.select(*keys, "lba", "sig_order", *[F.col(c).alias(f"wide_{c}") for c in ("verdict", "length", "reason", "window_bytes")])


def blocks_used(length: Column, block_size: int = BLOCK) -> Column:
    return F.greatest(F.ceil(length / block_size), F.lit(1)).cast("bigint")


def sized_results(validated: DataFrame) -> DataFrame:
    """CRV-4 and CRV-5: OK rows and useful partials with their payload length and block count."""
    is_ok = F.col("verdict") == "OK"
    keep = is_ok | ((F.col("verdict") == "EOF") & scoring.useful_partial(F.col("file_type"), F.col("length")))
    n = F.when(is_ok, F.col("length")).otherwise(F.least("length", "window_bytes"))
    return validated.where(keep).withColumn("is_ok", is_ok).withColumn("payload_length", n).withColumn("blocks", blocks_used(n))


def greedy_select(sized: DataFrame, keys: Sequence[str], cut_width: int = FOLD_SLICE) -> DataFrame:
    """CRV-6: left-to-right choice per image.

    One winner per block (first signature in list order). An accepted whole object claims its blocks, later starts inside them are dropped,
    partials claim nothing. Behind every whole object the next choice is the first whole one at or after its end, so the chosen ones are
    those on the way from an image's first (``slices.hops``).
    """
    rest = [c for c in sized.columns if c not in (*keys, "lba")]
    first = cut_lineage(sized.groupBy(*keys, "lba").agg(F.min_by(F.struct(*rest), "sig_order").alias("_w")).select(*keys, "lba", "_w.*"))
    whole = first.where("is_ok").select(*keys, "lba", (F.col("lba") + F.greatest(F.col("blocks"), F.lit(1))).alias("_end"))
    chosen = slices.hops(whole, keys, "lba", "_end", cut_width, cut_lineage)
    taken = first.where("is_ok").join(chosen, [*keys, "lba"], "left_semi")
    parts = ranges.points_in_ranges(first.where("NOT is_ok"), taken.select(*keys, F.col("lba").alias("start_lba"), F.col("blocks").alias("block_count")), keys, "left_anti")
    return taken.unionByName(parts)


def assign_ids(artifacts: DataFrame, keys: Sequence[str], tier: int, order: str = "start_lba") -> DataFrame:
    """CRV-7: tiers 1 and 2 count up from their base per image; tier 3 uses base + start."""
    if tier == 3:
        return artifacts.withColumn("artifact_id", F.lit(TIER_BASE[3]).cast("bigint") + F.col("start_lba"))
    numbered = slices.row_numbers(artifacts, keys, [order], slices.by_width(order, FOLD_SLICE), "_no")
    return numbered.withColumn("artifact_id", F.col("_no") + TIER_BASE[tier]).drop("_no")


@F.pandas_udf(DoubleType())
def payload_entropy(data: pd.Series) -> pd.Series:
    return pd.Series(kern.entropy_of_counts(kern.histograms([d or b"" for d in data])))


ARTIFACT_COLUMNS = ["artifact_id", "tier", "file_type", "start_lba", "extents", "gap", "recovered_bytes", "expected_bytes",
                    "content_hash", *scoring.SIGNALS, "confidence_score", "limitations", "filename", "original_path", "payload"]


def _extent(start: Column, count: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start_lba"), count.cast("bigint").alias("block_count"))


def _finish(rows: DataFrame, keys: Sequence[str], entropy_score: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Entropy signal (heuristic bands unless a scorer is given), composite and hash."""
    if entropy_score is None:
        out = rows.withColumn("_e", payload_entropy("payload")).withColumn("entropy", scoring.entropy_consistency(
            F.col("_e"), F.col("file_type"), F.octet_length("payload") == 0)).drop("_e")
    else:
        out = entropy_score(rows)
    return (out.withColumn("confidence_score", scoring.composite())
            .withColumn("content_hash", F.sha2("payload", 256))
            .withColumn("recovered_bytes", F.octet_length("payload").cast("bigint"))
            .select(*keys, *ARTIFACT_COLUMNS))


def tier2_artifacts(selected: DataFrame, chunks: DataFrame, signatures: DataFrame, keys: Sequence[str],
                    entropy_score=None, block_size: int = BLOCK, max_payload: int = MAX_PAYLOAD) -> DataFrame:
    """Rows for the chosen objects: payload re-read at its own length, trimmed and scored.

    Objects too large for a row keep a null payload: their ends are read for the header score, hash and entropy come from
    ``large_content``, their bytes from ``extent_pieces``.
    """
    numbered = cut_lineage(assign_ids(selected.withColumn("start_lba", F.col("lba")), keys, 2))
    fits = F.col("payload_length") <= max_payload
    carry = ["file_type", "verdict", "length", "is_ok", "payload_length", "blocks", "artifact_id"]
    w = candidate_windows(numbered.where(fits).withColumn("window_blocks", F.col("blocks")), chunks, keys, carry=carry, block_size=block_size)
    w = w.withColumn("payload", F.substring(F.col("payload"), F.lit(1), F.col("payload_length").cast("int")))
    done = _finish(_tier2_scores(w, signatures), keys, entropy_score)
    large = numbered.where(~fits)
    if large.isEmpty():
        return done
    place = large.select(*keys, "lba", "sig_order", *carry)
    head = longobjects.peek(place.withColumn("cur", F.col("lba") * block_size), chunks, keys, block_size).withColumnRenamed("bytes", "_head")
    ends = longobjects.peek(head.withColumn("cur", F.col("lba") * block_size + F.col("payload_length") - block_size), chunks, keys, block_size)
    scored = _tier2_scores(ends.withColumn("payload", F.concat("_head", "bytes")), signatures)
    where = F.struct(F.lit("Contiguous").alias("kind"), F.lit(None).cast("binary").alias("resident"), F.col("extents"))
    entries = scored.select(*keys, F.col("artifact_id").alias("entry_id"), F.col("payload_length").alias("size_bytes"), where.alias("location"))
    content = large_content(entries, chunks, keys, block_size, max_payload).withColumnRenamed("entry_id", "artifact_id")
    big = scored.withColumn("payload", F.lit(None).cast("binary")).join(content, [*keys, "artifact_id"])
    big = big.withColumn("entropy", scoring.entropy_consistency(F.col("byte_entropy"), F.col("file_type"), F.lit(False)))
    return done.unionByName(_with_content(big, keys))


def _with_content(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Result columns of rows whose content is known by ``large_hash`` and ``large_bytes``."""
    return (rows.withColumn("confidence_score", scoring.composite()).withColumn("content_hash", F.coalesce("large_hash", F.sha2("payload", 256)))
            .withColumn("recovered_bytes", F.coalesce("large_bytes", F.lit(0).cast("bigint"))).select(*keys, *ARTIFACT_COLUMNS))


def _tier2_scores(w: DataFrame, signatures: DataFrame) -> DataFrame:
    """All signals but the entropy; ``payload`` holds the object, or its two ends."""
    w = w.join(signatures.select("sig_order", "footer"), "sig_order")
    return (w.withColumn("header_footer", scoring.header_footer_score(F.col("payload"), F.col("file_type"), F.col("footer"), ~F.col("is_ok")))
         .withColumn("structural", scoring.structural_score(F.col("verdict"), F.col("file_type"), F.col("length"), F.col("payload_length")))
         .withColumn("metadata", F.lit(0.0))
         .withColumn("fragmentation", scoring.fragmentation_score(F.when(F.col("is_ok"), "contiguous").otherwise("partial"), F.lit(0), 1))
         .withColumn("overwrite", scoring.overwrite_score(F.lit(2), F.lit("none")))
         .withColumn("tier", F.lit(2)).withColumn("start_lba", F.col("lba")).withColumn("gap", F.lit(None).cast("bigint"))
         .withColumn("extents", F.array(_extent(F.col("lba"), F.col("blocks"))))
         .withColumn("expected_bytes", F.when(F.col("is_ok"), F.col("payload_length")).cast("bigint"))
         .withColumn("original_path", F.lit(None).cast("string"))
         .withColumn("limitations", F.when(~F.col("is_ok"), F.format_string(
             "Truncated candidate (EOF): %d bytes verified, footer or tail missing", F.col("length"))))
         .withColumn("filename", F.format_string("%s_%04d.%s", F.when(F.col("is_ok"), "carved_file").otherwise("carved_partial"),
                                                 F.col("artifact_id"), F.col("file_type"))))


# ---- tier 1 ------------------------------------------------------------------------
def _mapped_bytes(block_size: int) -> Column:
    """Bytes an entry can yield: its extents, cut to its size."""
    blocks = F.aggregate(F.coalesce("location.extents", F.array().cast(EXTENTS)), F.lit(0).cast("bigint"), lambda a, x: a + x["block_count"])
    return F.least(blocks * block_size, F.coalesce("size_bytes", blocks * block_size))


EXTENTS = "array<struct<start_lba:bigint,block_count:bigint>>"


def extent_pieces(entries: DataFrame, chunks: DataFrame, keys: Sequence[str], block_size: int = BLOCK) -> DataFrame:
    """JN-6 in pieces: ``(keys, entry_id, extent_no, chunk_no, blocks, part)``, any file size, not cut to size; ``chunk_no`` orders them."""
    ext = (entries.select(*keys, "entry_id", F.posexplode("location.extents").alias("extent_no", "_x"))
           .select(*keys, "entry_id", "extent_no", F.col("_x.start_lba").alias("_s"), F.col("_x.block_count").alias("_c"))
           .where("_c > 0")
           .withColumn("chunk_no", F.explode(F.sequence(slices.idiv(F.col("_s"), CHUNK_BLOCKS),
                                                        slices.idiv(F.col("_s") + F.col("_c") - 1, CHUNK_BLOCKS)))))
    j = ext.join(by_place(chunks, keys), [*keys, "chunk_no"])
    at = F.col("chunk_no") * CHUNK_BLOCKS
    lo = F.greatest(F.col("_s"), F.col("start_lba"), at)
    hi = F.least(F.col("_s") + F.col("_c"), F.col("start_lba") + F.col("n"), at + CHUNK_BLOCKS)
    part = F.substring(F.col("payload"), ((lo - F.col("start_lba")) * block_size + 1).cast("int"), ((hi - lo) * block_size).cast("int"))
    return j.where(hi > lo).select(*keys, "entry_id", "extent_no", lo.alias("chunk_no"), (hi - lo).alias("blocks"), part.alias("part"))


def _mapped_blocks() -> Column:
    """Blocks an entry's extents name."""
    return F.aggregate(F.coalesce("location.extents", F.array().cast(EXTENTS)), F.lit(0).cast("bigint"), lambda a, x: a + F.greatest(x["block_count"], F.lit(0)))


def extent_payload(entries: DataFrame, chunks: DataFrame, keys: Sequence[str], block_size: int = BLOCK,
                   max_payload: int = MAX_PAYLOAD) -> DataFrame:
    """JN-6: bytes of each entry: resident as is, else extents in order, cut to ``size_bytes``; empty if a block is absent.

    ``entries`` has ``entry_id``, ``size_bytes`` and ``location<kind, resident, extents>``.
    Entries above ``max_payload`` do not fit a row: their payload is null and
    ``large_content`` describes them from their pieces.
    """
    fits = _mapped_bytes(block_size) <= max_payload
    read = (extent_pieces(entries.where(fits), chunks, keys, block_size).groupBy(*keys, "entry_id")
            .agg(F.sum("blocks").alias("_blocks"), F.array_sort(F.collect_list(F.struct("extent_no", "chunk_no", "part"))).alias("_parts"))
            .select(*keys, "entry_id", "_blocks", _glue(F.transform("_parts", lambda x: x["part"])).alias("_read")))
    whole = F.when(F.col("_blocks") == _mapped_blocks(), F.col("_read")).otherwise(F.lit(b""))
    cut = F.when(F.col("size_bytes").isNull(), whole).otherwise(
        F.substring(whole, F.lit(1), F.least(F.col("size_bytes"), F.octet_length(whole)).cast("int")))
    resident = F.coalesce("location.resident", F.lit(b""))
    return (entries.join(read, [*keys, "entry_id"], "left")
            .withColumn("payload", F.when(F.col("location.kind") == "Resident", resident).when(fits, cut)).drop("_read", "_blocks"))


def large_content(entries: DataFrame, chunks: DataFrame, keys: Sequence[str], block_size: int = BLOCK,
                  max_payload: int = MAX_PAYLOAD) -> DataFrame:
    """Length, SHA-256 and entropy of entries above ``max_payload``, without holding any of them.

    Pieces are cut to size by their offset, then hashed in a sorted stream and counted by
    byte value; only 256 numbers per piece are shuffled for the entropy.
    """
    ids = [*keys, "entry_id"]
    large = entries.where((F.col("location.kind") != "Resident") & (_mapped_bytes(block_size) > max_payload))
    every = extent_pieces(large, chunks, keys, block_size)
    whole = (every.groupBy(*ids).agg(F.sum("blocks").alias("_blocks")).join(large.select(*ids, _mapped_blocks().alias("_mapped")), ids)
             .where("_blocks = _mapped").select(*ids))
    pieces = every.join(whole, ids, "left_semi").withColumn("_order", F.col("extent_no") * F.lit(1 << 40) + F.col("chunk_no"))
    lens = slices.running_total(pieces.select(*ids, "_order", F.octet_length("part").cast("bigint").alias("_len")), ids, ["_order"],
                                slices.by_width("_order", FOLD_SLICE), F.col("_len"), "_at", inclusive=False)
    cut = (pieces.join(lens, [*ids, "_order"]).join(large.select(*ids, "size_bytes"), ids)
           .withColumn("_keep", F.least("_len", F.greatest(F.coalesce("size_bytes", F.lit(1 << 62)) - F.col("_at"), F.lit(0))))
           .where("_keep > 0").select(*ids, F.col("_order").alias("chunk_no"), F.substring(F.col("part"), F.lit(1), F.col("_keep").cast("int")).alias("payload")))
    digest = acquire.image_digest(cut, ids)
    counts = (byte_stats.profile(cut, ids, ["histogram"]).select(*ids, F.posexplode("histogram").alias("_b", "_c")).where("_c > 0")
              .groupBy(*ids, "_b").agg(F.sum("_c").alias("_c")))
    n = F.sum("_c")
    ent = counts.groupBy(*ids).agg((F.log2(n) - F.sum(F.col("_c") * F.log2("_c")) / n).alias("byte_entropy"))
    return digest.join(ent, ids).select(*ids, F.col("bytes").alias("large_bytes"), F.col("image_hash").alias("large_hash"), "byte_entropy")


def tier1_artifacts(entries: DataFrame, chunks: DataFrame, keys: Sequence[str], entropy_score=None, max_payload: int = MAX_PAYLOAD) -> DataFrame:
    """CRV-13: metadata recovery of decoded directory entries.

    Entries too large for a row keep a null payload; their hash, length and entropy come
    from ``large_content``.
    """
    got = extent_payload(entries, chunks, keys, max_payload=max_payload)
    conf = F.col("confidence")
    empty_lost = (F.octet_length("payload") == 0) & (F.coalesce("size_bytes", F.lit(0)) > 0)
    none = F.array().cast(EXTENTS)
    w = (got.withColumn("file_type", filters.file_type_from_name("name"))
         .withColumn("header_footer", F.lit(1.0)).withColumn("structural", F.lit(1.0))
         .withColumn("metadata", scoring.metadata_score(conf)).withColumn("fragmentation", F.lit(1.0))
         .withColumn("overwrite", scoring.overwrite_score(F.lit(1), conf))
         .withColumn("tier", F.lit(1)).withColumn("gap", F.lit(None).cast("bigint"))
         .withColumn("extents", F.when(F.col("location.kind") == "Resident", none).otherwise(F.coalesce("location.extents", none)))
         .withColumn("start_lba", F.get("extents", F.lit(0))["start_lba"])
         .withColumn("expected_bytes", F.col("size_bytes")).withColumn("filename", F.col("name"))
         .withColumn("original_path", F.col("path"))
         .withColumn("limitations", F.when(empty_lost, "Payload unavailable or overwritten")))
    w = assign_ids(w, keys, 1, "entry_id")
    done = _finish(w.where("payload IS NOT NULL"), keys, entropy_score)
    big = w.where("payload IS NULL").drop("content_hash").join(
        large_content(entries, chunks, keys, max_payload=max_payload), [*keys, "entry_id"], "left")
    # an entry of which blocks are absent is kept, with empty content
    lost = F.col("large_hash").isNull()
    big = (big.withColumn("entropy", scoring.entropy_consistency(F.col("byte_entropy"), F.col("file_type"), lost))
           .withColumn("limitations", F.when(lost, "Payload unavailable or overwritten"))
           .withColumn("payload", F.when(lost, F.lit(b""))))
    return done.unionByName(_with_content(big, keys))


def blocking_extents(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Extents of Confirmed or Partial entries: carving must stay out of them."""
    sure = entries.where(F.col("confidence").isin("Confirmed", "Partial") & (F.col("location.kind") != "Resident"))
    return sure.select(*keys, F.explode("location.extents").alias("_x")).select(*keys, "_x.*").where("block_count > 0")


# ---- tier 3 ------------------------------------------------------------------------
def gap_plan(radius: int = DEFAULT_RADIUS) -> list[int]:
    """CRV-8: likely gaps within the radius first, then the rest ascending."""
    first = [g for g in LIKELY_GAPS if g <= radius]
    return first + [g for g in range(1, radius + 1) if g not in set(first)]


def fragment_candidates(headers: DataFrame, totals: DataFrame, allocated: DataFrame, keys: Sequence[str], radius: int,
                        max_expected: int = MAX_EXPECTED) -> DataFrame:
    """CRV-9: every (size, split, gap) of a header whose two fragments are free and on the medium.

    Positions only. Blocked first fragments go before the gaps are exploded.
    """
    base = (headers.select(*keys, "lba", "file_type", "sig_order").join(totals, list(keys))
            .withColumn("expected", F.explode(F.sequence(F.lit(2), F.lit(max_expected))))
            .where(F.col("lba") + F.col("expected") < F.col("total_blocks"))
            .withColumn("split", F.explode(F.sequence(F.lit(1), F.col("expected") - 1))))
    splits = base.select(*keys, "lba", F.col("split").cast("bigint").alias("split")).distinct()
    free1 = ranges.overlap_filter(splits, allocated, keys, ["lba", "split"], False, ("lba", "split"))
    gaps = F.array(*[F.struct(F.lit(i).alias("gap_rank"), F.lit(g).cast("bigint").alias("gap")) for i, g in enumerate(gap_plan(radius))])
    full = (base.withColumn("split", F.col("split").cast("bigint")).join(free1, [*keys, "lba", "split"], "left_semi")
            .withColumn("_g", F.explode(gaps)).select("*", "_g.*").drop("_g")
            .where(F.col("gap") + F.col("lba") + F.col("expected") < F.col("total_blocks"))
            .withColumn("frag2_lba", F.col("lba") + F.col("split") + F.col("gap"))
            .withColumn("frag2_blocks", (F.col("expected") - F.col("split")).cast("bigint")))
    taken = (full.select(*keys, "frag2_lba", "frag2_blocks").distinct())
    free2 = ranges.overlap_filter(taken, allocated, keys, ["frag2_lba", "frag2_blocks"], False, ("frag2_lba", "frag2_blocks"))
    return full.join(free2, [*keys, "frag2_lba", "frag2_blocks"], "left_semi").drop("total_blocks")


def prefix_reject(fragments: DataFrame, chunks: DataFrame, keys: Sequence[str], **registry) -> DataFrame:
    """CRV-10: for prefix-final formats drop splits whose first fragment alone is an error."""
    tested = (fragments.where(F.col("file_type").isin(PREFIX_FINAL)).select(*keys, "lba", "sig_order", "file_type", "split").distinct()
              .withColumn("window_blocks", F.col("split").cast("bigint")))
    w = candidate_windows(tested, chunks, keys, carry=["file_type", "split"], most=MAX_EXPECTED)
    bad = validate_candidates(w, "file_type", **registry).where("verdict = 'ERR'").select(*keys, "lba", "sig_order", "split")
    return fragments.join(bad, [*keys, "lba", "sig_order", "split"], "left_anti")


FOUND = "expected int, split bigint, gap bigint, length bigint"


def first_assembly(data: bytes, blocked: np.ndarray, check: Callable, prefix_final: bool, gaps: Sequence[int],
                   max_expected: int, block_size: int = BLOCK):
    """First whole object by (size, split, gap order) in one reach window, or None.

    ``blocked[i]`` marks block ``i`` of the window as claimed. The window ends one block
    before the end of the medium at the latest, as a candidate must stop short of it.
    """
    n = len(blocked)
    claims = np.concatenate(([0], np.cumsum(blocked)))
    prefix_bad: dict[int, bool] = {}
    for expected in range(2, max_expected + 1):
        if expected >= n:
            break
        for split in range(1, expected):
            if claims[split]:
                break
            if prefix_final:
                if split not in prefix_bad:
                    prefix_bad[split] = check(data[:split * block_size])[0] == "ERR"
                if prefix_bad[split]:
                    continue
            rest = expected - split
            for gap in gaps:
                at = split + gap
                if gap + expected >= n or claims[at + rest] != claims[at]:
                    continue
                verdict, length, _ = check(data[:split * block_size] + data[at * block_size:(at + rest) * block_size])
                if verdict == "OK":
                    return expected, split, gap, min(length, expected * block_size)
    return None


def _search(headers: DataFrame, chunks: DataFrame, totals: DataFrame, claims: DataFrame, keys: Sequence[str], radius: int,
            python_packs: Mapping[str, Callable], max_expected: int) -> DataFrame:
    """Best free assembly of every header under the given claims; headers without one vanish."""
    reach = max_expected + radius + 1
    gaps = gap_plan(radius)
    table = dict(python_packs)
    sized = (headers.join(totals, list(keys)).withColumn(
        "window_blocks", F.least(F.lit(reach), F.col("total_blocks") - F.col("lba")).cast("bigint")))
    w = candidate_windows(sized, chunks, keys, carry=["file_type"], most=reach)
    # claimed blocks inside each reach, at most one small row per overlapping extent
    near = ranges.overlap_pairs(
        sized.select(*keys, "lba", "sig_order", F.col("window_blocks").alias("_wb")),
        claims.select(*keys, F.col("start_lba").alias("_cs"), F.col("block_count").alias("_cc")), keys, ("lba", "_wb"), ("_cs", "_cc"))
    near = near.groupBy(*keys, "lba", "sig_order").agg(F.collect_set(F.struct("_cs", "_cc")).alias("_claims"))
    ids = [*keys, "lba", "sig_order", "file_type"]
    w = w.join(near, [*keys, "lba", "sig_order"], "left").select(*ids, "payload", "_claims")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in w.select(*ids).schema.fields)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            payloads = batch.column("payload")
            rows = zip(*[batch.column(c).to_pylist() for c in ("file_type", "lba", "_claims")])
            for i, (kind, start, claimed) in enumerate(rows):
                data = payloads[i].as_py()  # windows are taken one at a time, not as a second copy of the batch
                n = len(data) // BLOCK
                blocked = np.zeros(n, dtype=np.int64)
                for x in claimed or []:
                    blocked[max(x["_cs"] - start, 0):max(min(x["_cs"] + x["_cc"] - start, n), 0)] = 1
                got = first_assembly(data, blocked, table[kind], kind in PREFIX_FINAL, gaps, max_expected)
                if got is not None:
                    at.append(i)
                    found.append(got)
            small = [batch.column(c).take(pa.array(at, pa.int64())) for c in ids]
            more = [pa.array([f[i] for f in found], pa.int32() if i == 0 else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*small, *more], names=[*ids, "expected", "split", "gap", "length"])

    # an operator of its own: as a column, the search would run again for the filter on what it found
    return w.mapInArrow(assemble, f"{types}, {FOUND}").withColumns({
        "frag2_lba": F.col("lba") + F.col("split") + F.col("gap"), "frag2_blocks": F.col("expected") - F.col("split")})


def reassemble_first(headers: DataFrame, chunks: DataFrame, totals: DataFrame, allocated: DataFrame, keys: Sequence[str],
                     radius: int = DEFAULT_RADIUS, python_packs: Mapping[str, Callable] | None = None,
                     max_expected: int = MAX_EXPECTED, cut_width: int = FOLD_SLICE) -> DataFrame:
    """CRV-11: per start the best assembly that misses everything claimed before it.

    Rounds: search every open header under the final claims, then walk the found ones in
    block order. A header is settled when no earlier open header could still take its
    blocks; the others search again under more claims. The first open header of an image
    settles in each round, so the loop ends, and a header without any assembly is dropped
    for good because claims only grow. The walk streams per (image, slice of blocks); rows
    within reach of the next slice are shown to it as neighbours that may take blocks.
    """
    table = packs_for_tier3() if python_packs is None else python_packs
    keys = list(keys)
    span = max_expected + radius + 1
    cut_width = max(cut_width, span)
    open_ = headers.select(*keys, "lba", "sig_order", "file_type")
    claims, done = allocated.select(*keys, "start_lba", "block_count"), None
    cols = [*keys, "lba", "sig_order", "file_type", "expected", "split", "gap", "length", "frag2_lba", "frag2_blocks"]
    walk_cols = [*keys, "lba", "sig_order", "split", "frag2_lba", "frag2_blocks"]

    def walk(batches):
        current, near = None, []
        for pdf in batches:
            flags = []
            for row in pdf.itertuples(index=False, name=None):
                *group, ghost, lba, _order, split, frag2, n2 = row
                if group != current:
                    current, near = group, []
                near = [x for x in near if x[1] > lba]
                mine = ((lba, lba + split), (frag2, frag2 + n2))
                free = not ghost and not any(a < z2 and a2 < z for a, z in mine for a2, z2 in near)
                flags.append(free)
                near += mine if free else [(lba, lba + span)]
            yield pdf[free_cols][flags]

    free_cols = [*keys, "lba", "sig_order"]
    while True:
        found = cut_lineage(_search(open_, chunks, totals, claims, keys, radius, table, max_expected).select(*cols))
        own = slices.idiv(F.col("lba"), cut_width)
        spill = slices.idiv(F.col("lba") + span, cut_width)
        shown = found.select(*walk_cols, F.explode(F.sequence(own, spill)).alias("_slice")).withColumn("_ghost", F.col("_slice") != own)
        shown = shown.select(*keys, "_slice", "_ghost", *walk_cols[len(keys):])
        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shown.select(*free_cols).schema.fields)
        settled = shown.repartition(*keys, "_slice").sortWithinPartitions(*keys, "_slice", "lba", "sig_order").mapInPandas(walk, types)
        fixed = cut_lineage(found.join(settled, free_cols, "left_semi"))
        done = fixed if done is None else done.unionByName(fixed)
        open_ = cut_lineage(found.join(fixed, free_cols, "left_anti").select(*free_cols, "file_type"))
        if open_.isEmpty():
            return done
        claims = claims.unionByName(fixed.select(*keys, F.col("lba").alias("start_lba"), F.col("split").alias("block_count"))).unionByName(
            fixed.select(*keys, F.col("frag2_lba").alias("start_lba"), F.col("frag2_blocks").alias("block_count")))


def packs_for_tier3() -> dict[str, Callable]:
    """Walkers plus plain-Python twins of the last-marker formats, for use inside the search."""
    return {**packs.PACKS, **packs.LAST_MARKER}


def tier3_artifacts(found: DataFrame, chunks: DataFrame, keys: Sequence[str], radius: int, entropy_score=None,
                    block_size: int = BLOCK) -> DataFrame:
    """Rows for reassembled objects; both fragments are read again by position."""
    entries = found.select(*keys, "lba", "sig_order", "file_type", "gap", "length", "split", "frag2_lba", "frag2_blocks",
                           F.struct("lba", "sig_order").alias("entry_id"), F.col("length").alias("size_bytes"),
                           F.struct(F.lit("Fragmented").alias("kind"), F.lit(None).cast("binary").alias("resident"),
                                    F.array(_extent(F.col("lba"), F.col("split")), _extent(F.col("frag2_lba"), F.col("frag2_blocks")))
                                    .alias("extents")).alias("location"))
    w = extent_payload(entries, chunks, keys, block_size)
    w = (w.withColumn("header_footer", F.lit(1.0)).withColumn("structural", F.lit(1.0)).withColumn("metadata", F.lit(0.0))
         .withColumn("fragmentation", scoring.fragmentation_score(F.lit("reassembled"), F.col("gap"), radius))
         .withColumn("overwrite", F.lit(1.0)).withColumn("tier", F.lit(3)).withColumn("start_lba", F.col("lba"))
         .withColumn("extents", F.col("location.extents"))
         .withColumn("expected_bytes", F.octet_length("payload").cast("bigint")).withColumn("original_path", F.lit(None).cast("string"))
         .withColumn("filename", F.format_string("reconstructed_file_%d.%s", F.col("lba"), F.col("file_type")))
         .withColumn("limitations", F.format_string("Reconstructed from 2 fragments across a %d-block gap", F.col("gap"))))
    return _finish(assign_ids(w, keys, 3), keys, entropy_score)


def supersede_partials(earlier: DataFrame, tier3: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN-14: limited artifacts that start where an object was reassembled give way to it."""
    gone = tier3.select(*keys, "start_lba").distinct()
    limited = earlier.where("limitations IS NOT NULL").join(gone, [*keys, "start_lba"], "left_anti")
    return earlier.where("limitations IS NULL").unionByName(limited)


def recover_image(chunks: DataFrame, signatures: DataFrame, keys: Sequence[str] = ("image_id",), entries: DataFrame | None = None,
                  tiers: Sequence[int] = (1, 2, 3), types: Sequence[str] | None = None, radius: int = DEFAULT_RADIUS,
                  entropy_score=None, head_bytes: int | None = None, max_expected: int = MAX_EXPECTED,
                  max_payload: int = MAX_PAYLOAD) -> DataFrame:
    """CRV-12: tiers 1, 2, 3 in order; extents claimed by one tier are closed to the next.

    ``entries`` are the decoded directory entries of the wanted partition (offset applied
    upstream), with ``confidence``.
    """
    keys = list(keys)
    head_bytes = head_reach(signatures) if head_bytes is None else head_bytes
    totals = cut_lineage(total_blocks(chunks, keys))
    empty = totals.select(*keys, F.lit(0).cast("bigint").alias("start_lba"), F.lit(0).cast("bigint").alias("block_count")).limit(0)
    claims, out = empty, None
    if 1 in tiers and entries is not None:
        out = tier1_artifacts(entries, chunks, keys, entropy_score, max_payload)
        claims = blocking_extents(entries, keys)
    hits = None
    if 2 in tiers or 3 in tiers:
        hits = cut_lineage(candidates(block_heads(chunks, keys, head_bytes), signatures, keys, claims, types))
    if 2 in tiers:
        chosen = cut_lineage(greedy_select(sized_results(judged(hits, chunks, totals, keys)), keys))
        two = tier2_artifacts(chosen, chunks, signatures, keys, entropy_score, max_payload=max_payload)
        out = two if out is None else out.unionByName(two)
        claims = claims.unionByName(chosen.where("is_ok").select(*keys, F.col("lba").alias("start_lba"), F.col("blocks").alias("block_count")))
    if 3 in tiers:
        left = ranges.points_in_ranges(hits, claims, keys, "left_anti")
        found = reassemble_first(left, chunks, totals, claims, keys, radius, max_expected=max_expected)
        three = tier3_artifacts(found, chunks, keys, radius, entropy_score)
        out = three if out is None else supersede_partials(out, three, keys).unionByName(three)
    return out
