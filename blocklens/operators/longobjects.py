"""Verdicts over objects of any size without reading them as one row (CRV-3).

The chunk table is read where it lies, twice: once for marks, places where a structure may begin, and once for the few bytes at each chunk's
borders. Everything after that is narrow rows. Marks are linked to the next place they announce; reachable places are found by pointer
doubling, so an object of a million parts takes twenty joins. Checksums over many chunks come from sums of per-chunk values (``functions.marks``).
Places no mark covers are settled by reading their 24 bytes through a join whose small side is broadcast behind a count.

``png`` and ``mp4`` follow links, ``pdf`` and ``zip`` need the last end mark, ``sqlite`` its header alone. Results are those of the same check over
one window up to the format's limit, with these differences: a range with absent blocks ends before the first of them and then only a
whole object counts; a broken chain of checksummed chunks ends at the last chunk whose predecessors' checksums all hold.

Defined results: no open candidates give no rows; a candidate whose first block is absent gives none; repeated candidates give equal rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocklens.functions import marks, native_packs
from blocklens.operators import ranges, slices
from blocklens.session import cut_lineage

BLOCK = 512
KINDS = ("png", "mp4", "pdf", "zip", "sqlite")
#: bytes kept at each side of a chunk's border
SEAM = marks.LOOK + marks.BACK
_MARK = "kind string, pos long, nxt long, flag long, ref long, opens long, closes long"


def _marks_of(kinds: Sequence[str], n_keys: int):
    """Batches (keys, start, size of what precedes, its checksum, bytes, low, high) to mark rows."""
    def run(batches):
        for batch in batches:
            rows, out = [], []
            for i in range(batch.num_rows):
                start, before, crc, data, low, high = (batch.column(n_keys + k)[i].as_py() for k in range(6))
                for kind in kinds:
                    found = list(marks.find(kind, data, low, high))
                    at = sorted({p for a, _, _ in found for p in (a - marks.BACK, a + marks.BACK) if p >= 0}) if kind == "png" else []
                    crcs = dict(zip(at, marks.sums(data, at, crc)))
                    for a, nxt, flag in found:
                        base = start * BLOCK + before
                        rows.append(i)
                        out.append((kind, base + a, None if nxt is None else base + nxt, flag, start, crcs.get(a - marks.BACK), crcs.get(a + marks.BACK),
                                    int.from_bytes(data[a - marks.BACK:a], "big") if a >= marks.BACK else None))
            start, pos = np.array([r[4] for r in out], np.int64) * BLOCK, np.array([r[1] for r in out], np.int64)
            has = np.array([r[5] is not None and r[6] is not None for r in out], bool)
            value = lambda k: np.array([r[k] or 0 for r in out], np.int64).astype(np.uint32)
            opens, closes = np.zeros(len(out), np.int64), np.zeros(len(out), np.int64)
            if has.any():
                opens[has] = marks.opens(start[has], pos[has] + marks.BACK, value(6)[has])
                closes[has] = marks.closes(start[has], pos[has] - marks.BACK, value(5)[has], value(7)[has])
            columns = [pa.array([r[0] for r in out], pa.string()), pa.array(pos, pa.int64()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.int64()),
                       pa.array([r[4] for r in out], pa.int64()), pa.array(opens, mask=~has), pa.array(closes, mask=~has)]
            keys = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(n_keys)]
            yield pa.RecordBatch.from_arrays([*keys, *columns], names=[*batch.schema.names[:n_keys], *[c.split()[0] for c in _MARK.split(", ")]])
    return run


def _pieces(batches):
    """Chunk checksums (keys, start, size, crc) to their share of the running sum."""
    for batch in batches:
        start, size, crc = (np.asarray(batch.column(batch.num_columns - 3 + k)).astype(np.int64) for k in range(3))
        share = marks.piece(start * BLOCK, start * BLOCK + size, crc)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(share.astype(np.int64))], names=[*batch.schema.names[:-2], "share"])


def _types(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*columns).schema.fields)


def mark_index(chunks: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Marks of ``kinds``: keys, kind, pos and nxt in bytes, flag, and both checksum values against the whole medium; the payload is not moved."""
    keys, n = list(keys), len(keys)
    schema = f"{_types(chunks, keys)}, {_MARK}"
    size = F.octet_length("payload").cast("long")
    zero = F.lit(0).cast("long")
    inner = chunks.where("n > 0").select(*keys, "start_lba", zero.alias("before"), zero.alias("crc"), "payload", F.lit(marks.BACK).cast("long").alias("low"), (size - marks.LOOK + 1).alias("high"))
    found = inner.mapInArrow(_marks_of(kinds, n), schema)
    # marks near a border are looked for in the bytes on both sides of it
    tail = F.least(size, F.lit(SEAM))
    edge = chunks.where("n > 0").select(*keys, "start_lba", "n", size.alias("size"), F.crc32("payload").alias("crc"), F.crc32(F.substring(F.col("payload"), F.lit(1), (size - tail).cast("int"))).alias("crc_tail"),
                                        F.substring(F.col("payload"), (size - tail + 1).cast("int"), tail.cast("int")).alias("tail"), F.substring("payload", 1, SEAM).alias("head"))
    edge = cut_lineage(edge)
    after = edge.select(*keys, F.col("start_lba").alias("_at"), F.col("head").alias("_head")).dropDuplicates([*keys, "_at"])
    both = edge.withColumn("_at", F.col("start_lba") + F.col("n")).join(after, [*keys, "_at"], "left")
    kept = F.octet_length("tail").cast("long")
    seam = both.select(*keys, "start_lba", (F.col("size") - kept).alias("before"), F.col("crc_tail"), F.concat("tail", F.coalesce("_head", F.lit(b""))).alias("bytes"),
                       F.greatest(kept - marks.LOOK + 1, F.when(kept == F.col("size"), F.lit(marks.BACK)).otherwise(0)).cast("long").alias("low"), (kept + F.when(F.col("_head").isNull(), 0).otherwise(marks.BACK)).alias("high"))
    found = found.unionByName(seam.mapInArrow(_marks_of(kinds, n), schema))
    if "png" not in kinds:
        return cut_lineage(found)
    shares = edge.select(*keys, "start_lba", "size", "crc").dropDuplicates([*keys, "start_lba"]).mapInArrow(_pieces, f"{_types(edge, [*keys, 'start_lba'])}, share long")
    total = cut_lineage(_running_xor(shares, keys))
    done = found.join(total.withColumnRenamed("start_lba", "ref"), [*keys, "ref"])
    return cut_lineage(done.withColumn("opens", F.col("opens").bitwiseXOR(F.col("before"))).withColumn("closes", F.col("closes").bitwiseXOR(F.col("before"))).drop("before"))


def _running_xor(shares: DataFrame, keys: Sequence[str], width: int = 1 << 20) -> DataFrame:
    """keys, start_lba, before: the sum of the shares of all chunks before, slice by slice."""
    cut = shares.withColumn("_slice", slices.by_width("start_lba", width))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.withColumn("_in", F.bit_xor("share").over(before(Window.partitionBy(*keys, "_slice").orderBy("start_lba"))))
    heads = cut.groupBy(*keys, "_slice").agg(F.bit_xor("share").alias("_all")).withColumn("_carry", F.bit_xor("_all").over(before(Window.partitionBy(*keys).orderBy("_slice"))))
    zero = F.lit(0).cast("long")
    return inner.join(heads, [*keys, "_slice"]).select(*keys, "start_lba", F.coalesce("_in", zero).bitwiseXOR(F.coalesce("_carry", zero)).alias("before"))


def links(index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, kind, pos, nxt, flag: what a walk may follow; a checksummed link needs a mark at its end that confirms it."""
    box = index.where("kind = 'mp4'").select(*keys, "kind", "pos", "nxt", "flag")
    a, b = index.where("kind = 'png' AND flag = 0").alias("a"), index.where("kind = 'png'").alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    chunk = a.join(b, same & (F.col("a.nxt") == F.col("b.pos")) & (F.col("a.opens") == F.col("b.closes"))).select(*[f"a.{k}" for k in keys], "a.kind", "a.pos", "a.nxt", "a.flag")
    return cut_lineage(box.unionByName(chunk).distinct())


def jumps(edges: DataFrame, keys: Sequence[str]) -> list[DataFrame]:
    """Tables of 1, 2, 4, ... steps along ``edges``; the flag of a jump is that of any of its steps. Links only lead ahead, so this ends."""
    levels = [edges]
    while True:
        now = levels[-1]
        ahead = now.select(*keys, "kind", F.col("pos").alias("nxt"), F.col("nxt").alias("_n"), F.col("flag").alias("_f"))
        more = cut_lineage(now.join(ahead, [*keys, "kind", "nxt"]).select(*keys, "kind", "pos", F.col("_n").alias("nxt"), F.greatest("flag", "_f").alias("flag")))
        if more.isEmpty():
            return levels
        levels.append(more)


def advance(points: DataFrame, levels: list[DataFrame], keys: Sequence[str]) -> DataFrame:
    """``points`` (keys, kind, cur, until, flag, ...) as far along the jumps as they stay up to ``until``."""
    for level in reversed(levels):
        step = level.select(*keys, "kind", F.col("pos").alias("cur"), F.col("nxt").alias("_n"), F.col("flag").alias("_f"))
        met = points.join(step, [*keys, "kind", "cur"], "left")
        ok = F.col("_n").isNotNull() & (F.col("_n") <= F.col("until"))
        points = cut_lineage(met.withColumn("flag", F.when(ok, F.greatest("flag", "_f")).otherwise(F.col("flag"))).withColumn("cur", F.when(ok, F.col("_n")).otherwise(F.col("cur"))).select(*points.columns))
    return points


def peek(points: DataFrame, chunks: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """``points`` with ``bytes``: up to ``width`` bytes from byte ``cur`` on; null where the medium has none."""
    keys = list(keys)
    where = slices.few(cut_lineage(points.select(*keys, "cur").distinct()))
    lo, hi = F.greatest(F.col("cur"), F.col("start_lba") * BLOCK), F.least(F.col("cur") + width, (F.col("start_lba") + F.col("n")) * BLOCK)
    # a chunk row lies in one or more slices of blocks, a point in one or two
    width_blocks = ranges.WIDTH
    spread = lambda first, last: F.explode(F.sequence(slices.idiv(first, width_blocks), slices.idiv(last, width_blocks)))
    near = where.withColumn("_b", spread(slices.idiv(F.col("cur"), BLOCK), slices.idiv(F.col("cur") + (width - 1), BLOCK)))
    held = chunks.where("n > 0").select(*keys, "start_lba", "n", "payload", spread(F.col("start_lba"), F.col("start_lba") + F.col("n") - 1).alias("_b"))
    part = F.substring(F.col("payload"), (lo - F.col("start_lba") * BLOCK + 1).cast("int"), (hi - lo).cast("int"))
    got = held.join(near, [*keys, "_b"]).where(hi > lo).groupBy(*keys, "cur").agg(F.array_sort(F.collect_set(F.struct(lo.alias("at"), part.alias("part")))).alias("_p"))
    text = F.array_join(F.transform("_p", lambda x: F.hex(x["part"])), "")
    return points.join(got.select(*keys, "cur", F.unhex(text).alias("bytes")), [*keys, "cur"], "left")


def _number(at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring("bytes", at + 1, size)), 16, 10).cast("decimal(20,0)")


def _box_step(points: DataFrame) -> DataFrame:
    """One box read at ``cur``: either ``cur`` behind it, or the verdict."""
    left = F.col("until") - F.col("cur")
    size4 = _number(0, 4)
    wide = size4 == 1
    size, head = F.when(wide, _number(8, 8)).otherwise(size4), F.when(wide, 16).otherwise(8)
    printable = F.hex(F.substring("bytes", 5, 4)).rlike("^([2-6][0-9A-F]|7[0-9A-E]|A9){4}$")
    whole = (F.col("cur") > F.col("start")) & (F.col("flag") == 1)
    first = F.col("cur") == F.col("start")
    brands = size - head - 8
    brand = F.hex(F.when(wide, F.substring("bytes", 17, 4)).otherwise(F.substring("bytes", 9, 4))).rlike("^([2-6][0-9A-F]|7[0-9A-E]){4}$")
    ok_first = (F.substring("bytes", 5, 4) == F.lit(b"ftyp")) & (brands >= 0) & (brands % 4 == 0) & brand
    verdict = (F.when((left < 8) | F.col("bytes").isNull(), F.when(whole, "OK").otherwise("EOF"))
               .when(~printable, F.when(whole, "OK").otherwise("ERR"))
               .when((size4 == 0) | (wide & (left < 16)), "EOF")
               .when(size < head, F.when(whole, "OK").otherwise("ERR"))
               .when(size > left, "EOF")
               .when(first & ~ok_first, "ERR"))
    media = F.substring("bytes", 5, 4).isin(*[F.lit(b) for b in marks.MEDIA_BOXES])
    moved = verdict.isNull()
    return points.select(*[c for c in points.columns if c not in ("bytes", "cur", "flag", "verdict")], verdict.alias("verdict"),
                         F.when(moved, F.col("cur") + size.cast("long")).otherwise(F.col("cur")).alias("cur"),
                         F.when(moved & media, 1).otherwise(F.col("flag")).cast("long").alias("flag"))


def _boxes(open_: DataFrame, chunks: DataFrame, levels: list[DataFrame], keys: Sequence[str]) -> DataFrame:
    """mp4: read one box, follow the jumps, until every walk has its verdict."""
    points = open_.where("kind = 'mp4'").withColumn("cur", F.col("start")).withColumn("flag", F.lit(0).cast("long")).withColumn("verdict", F.lit(None).cast("string"))
    done, points = None, cut_lineage(points)
    while not points.isEmpty():
        stepped = cut_lineage(_box_step(peek(points, chunks, keys, marks.LOOK)))
        over = stepped.where("verdict IS NOT NULL")
        done = over if done is None else done.unionByName(over)
        points = advance(stepped.where("verdict IS NULL"), levels, keys)
    return done


def verdicts(cands: DataFrame, chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, lba, sig_order, verdict, length of open candidates (``validator_id`` in ``KINDS``, ``limit_blocks``) over all their blocks."""
    keys, on = list(keys), [*keys, "lba", "sig_order"]
    asked = cands.where(F.col("validator_id").isin(*KINDS)).select(*on, F.col("validator_id").alias("kind"), "limit_blocks")
    runs = ranges.islands(chunks.where("n > 0").select(*keys, "start_lba", F.col("n").cast("long").alias("n")), keys, "start_lba", F.col("n"))
    open_ = ranges.points_in_ranges(asked, runs, keys, "inner")
    end = F.least(F.col("lba") + F.col("limit_blocks"), F.col("hit_start_lba") + F.col("hit_block_count"))
    open_ = cut_lineage(open_.select(*on, "kind", "limit_blocks", (F.col("lba") * BLOCK).alias("start"), (end * BLOCK).alias("until")))
    kinds = sorted(r["kind"] for r in open_.select("kind").distinct().collect())  # at most the number of kinds
    found = []
    walked = [k for k in kinds if k != "sqlite"]
    index = levels = None
    if walked:
        bounds = slices.few(cut_lineage(open_.where("kind <> 'sqlite'").groupBy(*keys).agg(F.min("lba").alias("_lo"), F.max(F.col("until") / BLOCK).cast("long").alias("_hi"))))
        near = chunks.join(bounds, keys).where("start_lba + n > _lo AND start_lba < _hi").drop("_lo", "_hi")
        index = mark_index(near, keys, walked)
    if {"png", "mp4"} & set(kinds):
        levels = jumps(links(index, keys), keys)
    if "mp4" in kinds:
        found.append(_boxes(open_, chunks, levels, keys).select(*on, "verdict", (F.col("cur") - F.col("start")).alias("length")))
    if "png" in kinds:
        points = open_.where("kind = 'png'").withColumn("cur", F.col("start") + 8).withColumn("flag", F.lit(0).cast("long"))
        last = advance(points, levels, keys)
        ends = index.where("kind = 'png' AND flag = 1").select(*keys, F.col("pos").alias("cur"), F.col("nxt").alias("_end")).distinct()
        last = last.join(ends, [*keys, "cur"], "left")
        ok = F.col("_end").isNotNull() & (F.col("_end") <= F.col("until"))
        found.append(last.select(*on, F.when(ok, "OK").otherwise("EOF").alias("verdict"), (F.when(ok, F.col("_end")).otherwise(F.col("cur")) - F.col("start")).alias("length")))
    if {"pdf", "zip"} & set(kinds):
        found.append(_last_marks(open_, index, keys))
    if "sqlite" in kinds:
        heads = peek(open_.where("kind = 'sqlite'").withColumn("cur", F.col("start")), chunks, keys, 32)
        raw = _number(16, 2)
        want = (F.when(raw == 1, 65536).otherwise(raw) * F.greatest(_number(28, 4), F.lit(1))).cast("long")
        fits = F.col("until") - F.col("start")
        found.append(heads.select(*on, F.when(want <= fits, "OK").otherwise("EOF").alias("verdict"), F.when(want <= fits, want).otherwise(fits).alias("length")))
    none = open_.select(*on, F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("long").alias("length")).limit(0)
    every = reduce(DataFrame.unionByName, found, none).distinct()
    # a range cut short by absent blocks can show that an object is whole, not that it ends early
    cut = open_.where(F.col("until") < (F.col("lba") + F.col("limit_blocks")) * BLOCK).select(*on).distinct()
    return every.where("verdict = 'OK'").unionByName(every.where("verdict = 'EOF'").join(cut, on, "left_anti"))


def _last_marks(open_: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pdf and zip: the last end mark inside the range, and what it needs besides."""
    on = [*keys, "lba", "sig_order"]
    places = index.where("kind IN ('pdf', 'zip')").select(*keys, F.col("kind").alias("_kind"), "pos", "nxt", "flag", slices.idiv(F.col("pos"), BLOCK).alias("_lba"))
    spans = open_.where("kind IN ('pdf', 'zip')").select(*on, "kind", "start", "until", F.col("lba").alias("_s"), (slices.idiv(F.col("until"), BLOCK) - F.col("lba")).alias("_c"))
    met = ranges.points_in_ranges(places, spans, keys, "inner", lba="_lba", start="_s", count="_c").where("kind = _kind AND pos >= start")
    is_ = lambda kind, k: (F.col("kind") == kind) & (F.col("flag") == k)
    inside = lambda n: F.col("pos") + n <= F.col("until")
    sums = met.groupBy(*on, "kind", "start", "until").agg(
        F.max(F.when(is_("pdf", 0) & inside(5), F.col("pos"))).alias("eof"), F.min(F.when(is_("pdf", 1), F.col("pos"))).alias("xref"), F.max(F.when(is_("pdf", 2) & inside(6), 1)).alias("obj"),
        F.max(F.when((F.col("kind") == "zip") & inside(22), F.struct("pos", "nxt", "flag"))).alias("rec"))
    n = F.col("until") - F.col("start")
    every = open_.where("kind IN ('pdf', 'zip')").select(*on, "kind", "start", "until").join(sums, [*on, "kind", "start", "until"], "left")
    pdf = F.when(F.col("eof").isNull(), "EOF").when((F.col("xref") + 9 <= F.col("eof")) | F.col("obj").isNotNull(), "OK").otherwise("ERR")
    archive = F.when(F.col("rec").isNull(), "EOF").when(F.col("rec.flag") > F.col("rec.pos") - F.col("start"), "ERR").otherwise("OK")
    verdict = F.when(F.col("kind") == "pdf", pdf).otherwise(archive)
    whole = F.when(F.col("kind") == "pdf", F.col("eof") + 5).otherwise(F.col("rec.nxt")) - F.col("start")
    return every.select(*on, verdict.alias("verdict"), F.when(verdict == "OK", whole).otherwise(n).alias("length"))
