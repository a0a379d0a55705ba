"""Ordered per-key work that stays balanced when one key holds most of the rows.

A plain window over ``key`` puts a whole key in one task. Here the ordered axis is cut in
slices, the window runs inside ``(key, slice)``, and only one summary row per slice takes
part in the window over the key. The summaries are joined back on ``(key, slice)``.
The caller picks a slice width that bounds the rows of a slice (for block numbers the
width itself is the bound).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
#: rows of a narrow table that may be broadcast
SMALL = 50_000


def few(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df``, a written table of narrow rows, broadcast if a count finds it small; otherwise the join is left to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def by_width(order: str | Column, width: int) -> Column:
    """Slice number of an integer axis."""
    axis = F.col(order) if isinstance(order, str) else order
    return idiv(axis, width)


def idiv(a: Column, b: int) -> Column:
    """Exact integer division of a non-negative bigint column."""
    return F.call_function("div", a.cast("bigint"), F.lit(b).cast("bigint"))


def by_hours(ts: str | Column, hours: int = 24) -> Column:
    """Slice number of an event-time axis."""
    axis = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_timestamp(axis.cast("timestamp")) / F.lit(hours * 3600)).cast("bigint")


def _inside(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def _over_slices(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(SLICE)


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], cut: Column,
                 fields: dict[str, str]) -> DataFrame:
    """``lag(1)`` of the given source columns; ``fields`` maps new name -> source column."""
    src = list(dict.fromkeys(fields.values()))
    cut_df = df.withColumn(SLICE, cut)
    inner = cut_df.withColumn("_prev", F.lag(F.struct(*src)).over(_inside(keys, order)))
    tails = (cut_df.groupBy(*keys, SLICE)
             .agg(F.max_by(F.struct(*src), F.struct(*order)).alias("_tail"))
             .withColumn("_carry", F.lag("_tail").over(_over_slices(keys)))
             .drop("_tail"))
    joined = inner.join(tails, [*keys, SLICE], "left")
    picked = joined.withColumn("_prev", F.coalesce("_prev", "_carry"))
    for name, source in fields.items():
        picked = picked.withColumn(name, F.col("_prev").getField(source))
    return picked.drop("_prev", "_carry", SLICE)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], cut: Column,
                  value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Running sum along ``order``; exclusive gives the sum of the rows before."""
    cut_df = df.withColumn(SLICE, cut).withColumn("_v", value)
    inner = cut_df.withColumn("_in", F.sum("_v").over(
        _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    heads = (cut_df.groupBy(*keys, SLICE).agg(F.sum("_v").alias("_total"))
             .withColumn("_before", F.sum("_total").over(
                 _over_slices(keys).rowsBetween(Window.unboundedPreceding, -1)))
             .drop("_total"))
    total = F.col("_in") + F.coalesce("_before", F.lit(0))
    if not inclusive:
        total = total - F.col("_v")
    return (inner.join(heads, [*keys, SLICE], "left").withColumn(name, total)
            .drop("_v", "_in", "_before", SLICE))


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], cut: Column,
                name: str) -> DataFrame:
    """1-based position along ``order``."""
    return running_total(df, keys, order, cut, F.lit(1).cast("bigint"), name)


def max_so_far(df: DataFrame, keys: Sequence[str], order: Sequence[str], cut: Column,
               value: Column, name: str) -> DataFrame:
    """Largest value among the rows strictly before, null on the first row."""
    cut_df = df.withColumn(SLICE, cut).withColumn("_v", value)
    inner = cut_df.withColumn("_in", F.max("_v").over(
        _inside(keys, order).rowsBetween(Window.unboundedPreceding, -1)))
    heads = (cut_df.groupBy(*keys, SLICE).agg(F.max("_v").alias("_m"))
             .withColumn("_before", F.max("_m").over(
                 _over_slices(keys).rowsBetween(Window.unboundedPreceding, -1)))
             .drop("_m"))
    return (inner.join(heads, [*keys, SLICE], "left")
            .withColumn(name, F.greatest("_in", "_before"))
            .drop("_v", "_in", "_before", SLICE))


def next_at_or_after(points: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, width: int, name: str) -> DataFrame:
    """Per row of ``points`` the smallest ``at`` of ``marks`` that is not below its own; null if there is none. One shuffle, no range join.

    Windows run from the far end back: a frame that grows is read once, one that shrinks is read again for every row.
    """
    both = points.withColumn("_tag", F.lit(0)).unionByName(marks.select(*keys, at).withColumn("_tag", F.lit(1)), allowMissingColumns=True)
    cut = both.withColumn(SLICE, by_width(at, width)).withColumn("_v", F.when(F.col("_tag") == 1, F.col(at)))
    back = Window.partitionBy(*keys, SLICE).orderBy(F.desc(at), F.desc("_tag")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(*keys).orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.withColumn("_in", F.min("_v").over(back))
    heads = cut.groupBy(*keys, SLICE).agg(F.min("_v").alias("_m")).withColumn("_later", F.min("_m").over(later)).drop("_m")
    return inner.where("_tag = 0").join(heads, [*keys, SLICE], "left").withColumn(name, F.coalesce("_in", "_later")).drop("_tag", "_v", "_in", "_later", SLICE)


def reachable(starts: DataFrame, links: DataFrame, keys: Sequence[str], at: str, to: str, cut_lineage) -> DataFrame:
    """Every (keys, at) on the way from ``starts`` along ``links`` (keys, at, to), each place having one way on and ways leading ahead only.

    Ways are doubled, then taken from the longest to the shortest: about twice log2(longest way) joins, however many rows or slices there are.
    """
    levels = [cut_lineage(links.select(*keys, at, to))]
    while True:
        ahead = levels[-1].select(*keys, F.col(at).alias(to), F.col(to).alias("_far"))
        more = cut_lineage(levels[-1].join(ahead, [*keys, to]).select(*keys, at, F.col("_far").alias(to)))
        if more.isEmpty():
            break
        levels.append(more)
    met = cut_lineage(starts.select(*keys, at))
    for level in reversed(levels):
        met = cut_lineage(met.unionByName(met.join(level, [*keys, at]).select(*keys, F.col(to).alias(at))))
    return met


def hops(spans: DataFrame, keys: Sequence[str], at: str, to: str, width: int, cut_lineage) -> DataFrame:
    """The ``(keys, at)`` met on the way that begins at each key's first row and goes on with the first ``at`` not below the last ``to``.

    ``at`` is unique per key and ``to`` lies behind it. A slice, of at most ``width`` rows, is followed to its end inside a task, from all of its rows at
    once; what leaves it is the place where each way goes on, and most ways have met by then. Only those places are linked and doubled, so
    the rounds work on a few rows per slice; with its entry known, each slice is walked once more. Slices stream through sorted partitions and
    all that lie in a batch are followed together, so many keys of a few rows cost no more than one key of many.
    """
    import numpy as np
    import pandas as pd

    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema.fields}
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    cut = spans.select(*keys, F.col(at).cast("bigint").alias("_at"), F.col(to).cast("bigint").alias("_to")).withColumn(SLICE, by_width("_at", width))

    def starts_of(pdf: pd.DataFrame) -> np.ndarray:
        """Which rows are the first of their slice."""
        first = np.arange(len(pdf)) == 0
        for v in (pdf[c].to_numpy() for c in (*keys, SLICE)):
            first[1:] |= v[1:] != v[:-1]
        return first

    def whole_slices(batches):
        """The rows in pieces that end where a slice ends; at most a batch and a slice are held."""
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            first = np.flatnonzero(starts_of(pdf))
            if len(first):
                held = pdf.iloc[first[-1]:].reset_index(drop=True)
                if first[-1]:
                    yield pdf.iloc[:first[-1]].reset_index(drop=True)
        if held is not None:
            yield held

    def nexts(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Per row the first one of its slice at or after its end, itself if there is none; and whether there is one."""
        group, low = np.cumsum(starts_of(pdf)), pdf[SLICE].to_numpy() * width
        on = np.searchsorted(group * (width + 1) + pdf["_at"].to_numpy() - low, group * (width + 1) + np.minimum(pdf["_to"].to_numpy() - low, width))
        own = np.arange(len(pdf))
        inside = np.append(group, 0)[on] == group
        return np.where(inside, on, own), inside

    def ends(batches):
        for pdf in whole_slices(batches):
            last, _ = nexts(pdf)
            while (last[last] != last).any():
                last = last[last]
            yield pdf[[*keys, "_at"]].assign(_z=pdf["_to"].to_numpy()[last])

    def walk(batches):
        for pdf in whole_slices(batches):
            (on, inside), met = nexts(pdf), pdf["_at"].to_numpy() == pdf["_entry"].to_numpy()
            now = np.flatnonzero(met)
            while len(now):
                now = on[now[inside[now]]]
                met[now] = True
            yield pdf.loc[met, [*keys, "_at"]]

    def sliced(rows: DataFrame) -> DataFrame:
        return rows.repartition(*keys, SLICE).sortWithinPartitions(*keys, SLICE, "_at")

    left = cut_lineage(sliced(cut).mapInPandas(ends, f"{head}, _at bigint, _z bigint"))
    places = left.select(*keys, F.col("_z").alias("_at")).distinct().withColumn("_z", F.col("_at"))
    entries = cut_lineage(next_at_or_after(places, left.select(*keys, "_at"), keys, "_at", width, "_s").where("_s IS NOT NULL").select(*keys, "_z", "_s"))
    heads = left.groupBy(*keys).agg(F.min("_at").alias("_at"))
    starts = cut_lineage(entries.select(*keys, F.col("_s").alias("_at")).unionByName(heads).distinct())
    links = left.join(few(starts), [*keys, "_at"]).join(entries, [*keys, "_z"]).select(*keys, "_at", "_s")
    met = reachable(heads, links, keys, "_at", "_s", cut_lineage)
    known = cut_lineage(met.select(*keys, by_width("_at", width).alias(SLICE), F.col("_at").alias("_entry")))
    return (sliced(cut.join(few(known), [*keys, SLICE])).mapInPandas(walk, f"{head}, _at bigint")
            .withColumnRenamed("_at", at))


def fold_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], cut: Column, step, values: Sequence[str],
                result: str, state_fields: Sequence[str], cut_lineage, settle=None) -> DataFrame:
    """Exact ordered fold per key over slices; gives keys, order, values and the ``result`` column.

    ``step(state, *values) -> (state, out)`` handles one row; a state is None or a tuple of
    strings. Rows stream through sorted partitions, so neither a key nor a slice is held in
    memory. All slices first run from None; then each slice whose true entry state (exit
    of the previous non-empty slice) differs runs again, until no entry state changes.
    After round ``r`` the first ``r`` slices of every key are final, so the result equals
    the sequential fold. ``settle(state, slice_no)`` maps states that no later row can
    tell apart to one form, which keeps the rounds few.
    """
    import pandas as pd

    keys, order, values = list(keys), list(order), list(values)
    ins = [f"_in_{s}" for s in state_fields]
    outs = [f"_out_{s}" for s in state_fields]
    lean = df.withColumn(SLICE, cut).select(*dict.fromkeys([*keys, SLICE, *order, *values]))
    kept = lean.columns
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in lean.schema.fields]
                       + [f"{n} string" for n in ins + outs] + [result])
    name = result.split()[0]
    final = settle or (lambda state, _slice: state)
    blank = (None,) * len(state_fields)

    def walk(batches):
        current, state = None, None
        for pdf in batches:
            groups = pdf[[*keys, SLICE]].itertuples(index=False, name=None)
            entries = pdf[ins].itertuples(index=False, name=None)
            rows = pdf[values].itertuples(index=False, name=None)
            got, states = [], []
            for group, entry, row in zip(groups, entries, rows):
                if group != current:
                    current = group
                    state = None if all(v is None or v != v for v in entry) else tuple(None if v != v else v for v in entry)
                state, out = step(state, *row)
                got.append(out)
                states.append(final(state, group[-1]) or blank)
            done = pdf[kept + ins].copy()
            for i, c in enumerate(outs):
                done[c] = pd.Series([s[i] for s in states], dtype=object, index=done.index)
            done[name] = pd.Series(got, dtype=object if "string" in result else None, index=done.index)
            yield done

    def apply(rows: DataFrame) -> DataFrame:
        return rows.repartition(*keys, SLICE).sortWithinPartitions(*keys, SLICE, *order).mapInPandas(walk, schema)

    nulls = [F.lit(None).cast("string").alias(c) for c in ins]
    lean = cut_lineage(lean)
    done = cut_lineage(apply(lean.select("*", *nulls)))
    while True:
        exits = (done.groupBy(*keys, SLICE)
                 .agg(F.first(F.struct(*ins)).alias("_had"), F.max_by(F.struct(*outs), F.struct(*order)).alias("_exit"))
                 .withColumn("_want", F.lag("_exit").over(_over_slices(keys))))
        differs = None
        for i, o in zip(ins, outs):
            d = ~F.col(f"_had.{i}").eqNullSafe(F.col(f"_want.{o}"))
            differs = d if differs is None else differs | d
        stale = cut_lineage(exits.where(differs).select(
            *keys, SLICE, *[F.col(f"_want.{o}").alias(i) for i, o in zip(ins, outs)]))
        if stale.isEmpty():
            return done.drop(SLICE, *ins, *outs)
        again = lean.join(stale, [*keys, SLICE]).select(*kept, *ins)
        rest = done.join(stale.select(*keys, SLICE), [*keys, SLICE], "left_anti")
        done = cut_lineage(rest.unionByName(apply(again)))
