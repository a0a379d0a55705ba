"""Mixing sources to target weights.

Words are summed per source, sources get target sizes by weight under a cap, and a source's repetition rate is its target over its
size. A document is emitted floor(rate) times, and once more when a number drawn from the hash of its id lies below the fraction.
Sixteen hash seeds are tried in one aggregation and each source takes the one whose total comes nearest its target, so reruns
and recomputed tasks agree.

Defined results: a null text has no words; sources sort by code point, null last, and null is a source; a source without words has
target and rate 0; a null doc_id draws as the empty string; repeated rows draw alike and are each emitted; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blocklens.llm.common import SPACE, query, small_side, table, text_of
from blocklens.session import cut_lineage

MOST = 3
SEEDS = 16
WEIGHTS = (1, 2, 3)


def size_of(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(f"[^{SPACE}]+")).cast("long")


def draw(doc_id: Column, seed: Column | int) -> Column:
    """A number of 32 bits from the hash of seed and id."""
    seed = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.conv(F.substring(F.md5(F.concat(seed, F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, rate: one row per source.

    Shares by weight, capped at ``most`` times a source's size, the excess shared again until none is above. The result of that
    repetition is min(cap, level * weight): with the sources in order of cap / weight, the level is the largest of the
    levels that follow from capping those before. Only the per-source table, one row per source, meets in one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    kinds = F.array(*[F.lit(w) for w in weights])
    s = (sized.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("weight", F.get(kinds, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
                     / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"))
    s = s.withColumn("level", F.max("level").over(every))
    target = F.least((most * F.col("source_size")).cast("double"), F.col("level") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"),
                    F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), target / F.col("source_size"))).otherwise(0.0).alias("rate"))


def _copies(doc_id: Column, seed: Column | int) -> Column:
    whole = F.floor("rate")
    return whole + F.when(draw(doc_id, seed) < (F.col("rate") - whole) * float(1 << 32), 1).otherwise(0)


def plan(sized: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """source, source_size, target, rate, seed: what every document needs to know; one row per source."""
    goal = cut_lineage(targets(sized)).select(F.col("source").alias("source_t"), "source_size", "target", "rate")
    met = sized.join(small_side(goal), F.col("source").eqNullSafe(F.col("source_t")))
    sums = met.groupBy("source_t", "source_size", "target", "rate").agg(*[F.sum(F.col("size") * _copies(F.col("doc_id"), s)).alias(f"s{s}") for s in range(seeds)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{s}") - F.col("target")).alias("off"), F.lit(s).alias("seed")) for s in range(seeds)]))["seed"]
    return cut_lineage(sums.select("source_t", "source_size", "target", "rate", best.alias("seed")))


def copies(sized: DataFrame) -> DataFrame:
    """``sized`` (doc_id, source, size, ...) with source_size, target, rate and the number of copies."""
    goal = small_side(plan(sized.select("doc_id", "source", "size")))
    return sized.join(goal, F.col("source").eqNullSafe(F.col("source_t"))).withColumn("copies", _copies(F.col("doc_id"), F.col("seed")).cast("long")).drop("source_t")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the input's columns."""
    narrow = cut_lineage(docs.select("doc_id", "source", size_of().alias("size")))
    goal = small_side(plan(narrow))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row_"), docs["doc_id"].alias("id_"), docs["source"].alias("source_"))
    met = rows.join(goal, F.col("source_").eqNullSafe(F.col("source_t")))
    taken = met.withColumn("copies", _copies(F.col("id_"), F.col("seed")).cast("int")).filter("copies > 0")
    return taken.select("row_", F.explode(F.sequence(F.lit(1), "copies"))).select(*[F.col(f"row_.`{c}`").alias(c) for c in docs.columns])


def _sql() -> str:
    seed_sums = ", ".join(f"sum(size * (floor(rate) + CASE WHEN {_draw_sql(str(s))} < (rate - floor(rate)) * 4294967296.0 THEN 1 ELSE 0 END)) AS s{s}" for s in range(SEEDS))
    off = ", ".join(f"abs(s{s} - target)" for s in range(SEEDS))
    return f"""WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
lev AS (SELECT *, (sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
    FROM per WINDOW o AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (SELECT source, source_size, least({MOST} * source_size::DOUBLE, max(level) OVER () * weight) AS target FROM lev),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN least({MOST}.0, target / source_size) ELSE 0.0 END AS rate FROM tgt),
met AS (SELECT doc_id, size, r.* FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source),
sums AS (SELECT source, target, {seed_sums} FROM met GROUP BY source, target),
best AS (SELECT source, list_position([{off}], list_min([{off}])) - 1 AS seed FROM sums)
SELECT doc_id, size, source_size, target, size * (floor(rate) + CASE WHEN {_draw_sql("seed::VARCHAR")} < (rate - floor(rate)) * 4294967296.0 THEN 1 ELSE 0 END)::BIGINT AS taken
FROM met JOIN best b ON met.source IS NOT DISTINCT FROM b.source"""


def _draw_sql(seed: str) -> str:
    seed = seed if "::" in seed else f"'{seed}'"
    return f"('0x' || substr(md5({seed} || ':' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT"


@query("op2_mixing", _sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut_lineage(table(spark, sf_dir, "documents").select("doc_id", "source", size_of().alias("size")))
    return copies(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
