"""Quality rules with thresholds that follow the data.

Per document five integer rates are measured with column expressions. Each (language, source) group summarises a rate in a
mergeable quantile sketch: counts in bins that keep three leading digits, so a quantile is known to one part in a hundred,
a sketch has under 1,000 bins for each power of ten, and sketches merge by adding counts. Every group has fences of its own: to
its counts those of its language are added, scaled to the weight of ``PRIOR`` documents, and to a language's those of everything, so a
group of five leans on its language and a group of thousands on itself, without a size at which the rule changes.
A document is rejected when a rate lies outside the fence of its group.

Defined results: a null text is empty; null language and source form groups of their own; documents without words are
measured as zero, fail the base rule and do not enter the sketches; repeated rows are measured one by one; an empty table gives
an empty result; input columns whose names the result uses are replaced by the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blocklens.llm.common import SPACE, packed, query, small_side, table, unpacked, words_of
from blocklens.session import cut_lineage

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATES = ["r_symbol", "r_dup", "r_repeat", "r_upper", "r_length"]
#: least distance of a fence from the group's median, so that a uniform group does not reject on a trifle; per ten thousand, r_length in hundredths
MARGINS = {"r_symbol": 800, "r_dup": 4000, "r_repeat": 3000, "r_upper": 2500, "r_length": 250}
#: rates that are also suspicious when low
TWO_SIDED = ("r_length",)
#: documents that the sketch of the level above counts for in a blend
PRIOR = 50
SPREADS = 4


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of ``COUNTS`` and the rates of ``RATES``; one narrow pass, no shuffle."""
    keep = [c for c in docs.columns if c not in {*COUNTS, *RATES}]
    t = F.coalesce(F.col(f"row_.`{text}`"), F.lit(""))
    a = packed(docs).select("row_", t.alias("t"), words_of(t).alias("w"), F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0).alias("lines"))
    b = a.select("row_", F.size("w").cast("long").alias("n_words"),
                 F.length(F.regexp_replace("t", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
                 F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                 F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
                 F.size("lines").cast("long").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.slice(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))), 1, F.greatest(F.size("w") - 2, F.lit(0))).alias("g"))
    # n_repeat_words: only texts that repeat a window pay for a sort, of one long per window: 40 bits of hash, 24 of position
    c = b.withColumn("twice", F.size("g") - F.size(F.array_distinct("g")))
    low = F.lit(1 << 24).cast("long")
    c = c.withColumn("keys", F.when((F.col("twice") > 0) & (F.size("g") < low), F.sort_array(F.transform("g", lambda h, i: h.bitwiseAND(-low).bitwiseOR(i.cast("long"))))))
    # if two different windows share the 40 bits, or positions need over 24, whole (hash, position) pairs are sorted instead
    c = c.withColumn("pairs", F.when((F.col("twice") > 0) & (F.col("keys").isNull() | (F.size(F.array_distinct(F.transform("g", lambda h: h.bitwiseAND(-low)))) < F.size(F.array_distinct("g")))),
                                     F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))))
    near = lambda x, y: F.coalesce(F.shiftrightunsigned(x.bitwiseXOR(y), 24) == 0, F.lit(False))
    at = (F.when(F.col("pairs").isNotNull(),
                 F.transform(F.filter("pairs", lambda k, i: F.coalesce(k["h"] == F.get("pairs", i - 1)["h"], F.lit(False)) | F.coalesce(k["h"] == F.get("pairs", i + 1)["h"], F.lit(False))), lambda k: k["i"]))
          .when(F.col("keys").isNotNull(),
                F.transform(F.filter("keys", lambda k, i: near(k, F.get("keys", i - 1)) | near(k, F.get("keys", i + 1))), lambda k: k.bitwiseAND(low - 1))))
    d = c.withColumn("at", at)
    covered = F.when(F.col("at").isNull(), 0).otherwise(F.size(F.array_distinct(F.concat("at", F.transform("at", lambda i: i + 1), F.transform("at", lambda i: i + 2)))))
    e = d.withColumn("n_repeat_words", covered.cast("long"))
    whole = lambda x, y: F.expr(f"({x}) div greatest({y}, 1)")
    return e.select(*unpacked(e, keep), *COUNTS,
                    whole("10000 * n_symbols", "word_chars").alias("r_symbol"), whole("10000 * n_dup_lines", "n_lines").alias("r_dup"),
                    whole("10000 * n_repeat_words", "n_words").alias("r_repeat"), whole("10000 * n_upper", "word_chars").alias("r_upper"),
                    whole("100 * word_chars", "n_words").alias("r_length"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _bin(x: Column) -> Column:
    """Three leading digits: the sketch's bins."""
    digits = F.length(x.cast("string"))
    return F.when(x < 1000, x).otherwise(x - x % F.pow(F.lit(10.0), digits - 3).cast("long"))


#: weights of a blend are exact whole numbers: a group's counts times its language's total times the corpus's
_EXACT = "decimal(38,0)"


def _blend(own: DataFrame, above: DataFrame, by: list[str], above_by: list[str]) -> DataFrame:
    """Sketch ``own`` (``by``, rate, bin, w) plus the one above it, scaled to ``PRIOR`` documents; all weights times the total above."""
    keys = [*above_by, "rate"]
    up = above.select(*[F.col(c).alias(f"{c}_up") for c in keys], F.col("bin").alias("bin_up"), F.col("w").alias("w_up"))

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        same = F.lit(True)
        for c in keys:
            same = same & left[c].eqNullSafe(right[f"{c}_up"])
        return left.join(right, same)
    totals = up.groupBy(*[f"{c}_up" for c in keys]).agg(F.sum("w_up").alias("total"))
    mine = meet(own, totals).select(*by, "rate", "bin", (F.col("w") * F.col("total")).cast(_EXACT).alias("w"))
    theirs = meet(own.select(*by, "rate").distinct(), up).select(*by, "rate", F.col("bin_up").alias("bin"), (F.lit(PRIOR) * F.col("w_up")).cast(_EXACT).alias("w"))
    return mine.unionByName(theirs).groupBy(*by, "rate", "bin").agg(F.sum("w").cast(_EXACT).alias("w"))


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Quartiles of sketches: one row per group and rate."""
    each = Window.partitionBy(*by, "rate").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    running = sketch.withColumn("below", F.sum("w").over(each)).withColumn("all", F.sum("w").over(Window.partitionBy(*by, "rate")))
    quarter = lambda k: F.min(F.when(4 * F.col("below") >= k * F.col("all"), F.col("bin"))).alias(f"q{k}")
    return running.groupBy(*by, "rate").agg(quarter(1), quarter(2), quarter(3))


def thresholds(measured: DataFrame, margins: dict[str, int] | None = None, spreads: int = SPREADS) -> DataFrame:
    """Fences per (lang, source): columns ``lang``, ``source`` and ``low_<rate>``, ``high_<rate>``; one row per group.

    Rows are counted into sketch bins before anything is shuffled, so a source with a third of all rows costs what any other does.
    """
    margins = margins or MARGINS
    long = (measured.filter(~base_failed())
            .select("lang", "source", F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), _bin(F.col(r)).alias("bin")) for r in RATES])).alias("x"))
            .select("lang", "source", "x.rate", "x.bin").groupBy("lang", "source", "rate", "bin").agg(F.count("*").cast(_EXACT).alias("w")))
    own = cut_lineage(long)
    merged = lambda *by: own.groupBy(*by, "rate", "bin").agg(F.sum("w").cast(_EXACT).alias("w"))
    lang = cut_lineage(_blend(merged("lang"), merged(), ["lang"], []))
    fence = _quartiles(_blend(own, lang, ["lang", "source"], ["lang"]), ["lang", "source"])
    margin = F.create_map(*[F.lit(x) for kv in margins.items() for x in kv])[F.col("rate")]
    fence = fence.select("lang", "source", "rate",
                         F.greatest(F.col("q2") + margin, F.col("q3") + spreads * (F.col("q3") - F.col("q1"))).alias("high"),
                         F.when(F.col("rate").isin(*TWO_SIDED), F.least(F.col("q2") - margin, F.col("q1") - spreads * (F.col("q3") - F.col("q1")))).otherwise(-1).alias("low"))
    wide = fence.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == r, F.col(c))).alias(f"{c}_{r}") for r in RATES for c in ("low", "high")])
    return cut_lineage(wide)


def judge(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``: the joined filter. A group without a fence (all its rows failed) keeps nothing."""
    keep = [c for c in measured.columns if c not in ("base_failed", "kept")]
    bounds = [c for c in fences.columns if c.startswith(("low_", "high_"))]
    f = small_side(fences).select(F.col("lang").alias("lang_f"), F.col("source").alias("source_f"), F.struct(*bounds).alias("fence_"))
    joined = measured.join(f, F.col("lang").eqNullSafe(F.col("lang_f")) & F.col("source").eqNullSafe(F.col("source_f")), "left")
    inside = F.lit(True)
    for r in RATES:
        inside = inside & F.col(r).between(F.col(f"fence_.low_{r}"), F.col(f"fence_.high_{r}"))
    return joined.select(*[measured[c] for c in keep], base_failed().alias("base_failed"), (~base_failed() & F.coalesce(inside, F.lit(False))).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents that pass, with their own columns: the pipeline's stage. Rows are measured once and written with their rates; the fences filter those."""
    sized = cut_lineage(measure(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("kept_row"), docs["text"], docs["lang"], docs["source"])).drop("text"))
    return judge(sized, thresholds(sized)).filter("kept").select(*[F.col(f"kept_row.`{c}`").alias(c) for c in docs.columns])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = measure(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")
    measured = cut_lineage(narrow)
    return judge(measured, thresholds(measured)).select("doc_id", *COUNTS, "base_failed", "kept")


RATE_SQL = """
words AS (SELECT doc_id, lang, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM docs),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
hits AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cover AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + d AS p FROM hits, (VALUES (0), (1), (2)) AS v(d)) GROUP BY doc_id),
counts AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^\\p{Lu}]+', '', 'g'))::BIGINT AS n_upper,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
    FROM words LEFT JOIN cover USING (doc_id)),
measured AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    10000 * n_symbols // greatest(word_chars, 1) AS r_symbol, 10000 * n_dup_lines // greatest(n_lines, 1) AS r_dup,
    10000 * n_repeat_words // greatest(n_words, 1) AS r_repeat, 10000 * n_upper // greatest(word_chars, 1) AS r_upper,
    100 * word_chars // greatest(n_words, 1) AS r_length FROM counts)"""


def _judge_sql() -> str:
    """The fences with exact quartiles over the sketch's bins, and the verdict."""
    binned = lambda r: f"CASE WHEN {r} < 1000 THEN {r} ELSE {r} - {r} % (10 ** (length({r}::VARCHAR) - 3))::BIGINT END"
    long = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {binned(r)} AS bin FROM measured WHERE NOT base_failed" for r in RATES)
    merged = lambda by: f"SELECT {by}rate, bin, count(*)::HUGEINT AS w FROM long GROUP BY ALL"

    def blend(own: str, above: str, by: str, same: str) -> str:
        return (f"SELECT {by}rate, bin, sum(w)::HUGEINT AS w FROM (SELECT o.* REPLACE (o.w * t.total AS w) FROM {own} o JOIN (SELECT * EXCLUDE (bin, w), sum(w)::HUGEINT AS total FROM {above} "
                f"GROUP BY ALL) t ON o.rate = t.rate{same.format('t')} UNION ALL SELECT {by.replace('lang', 'g.lang')}g.rate, a.bin, {PRIOR} * a.w FROM (SELECT DISTINCT {by}rate FROM {own}) g "
                f"JOIN {above} a ON g.rate = a.rate{same.format('a').replace('o.', 'g.')}) GROUP BY ALL")
    keys = "lang, source, rate"
    quarters = ", ".join(f"min(CASE WHEN 4 * below >= {k} * total THEN bin END) AS q{k}" for k in (1, 2, 3))
    margin = "CASE rate " + " ".join(f"WHEN '{r}' THEN {m}" for r, m in MARGINS.items()) + " END"
    inside = " AND ".join(f"{r} BETWEEN low_{r} AND high_{r}" for r in RATES)
    wide = ", ".join(f"max(CASE WHEN rate = '{r}' THEN {c} END) AS {c}_{r}" for r in RATES for c in ("low", "high"))
    return f"""long AS ({long}), own AS ({merged("lang, source, ")}), lang_own AS ({merged("lang, ")}), everything AS ({merged("")}),
lang_blend AS ({blend("lang_own", "everything", "lang, ", "")}),
blended AS ({blend("own", "lang_blend", "lang, source, ", " AND o.lang IS NOT DISTINCT FROM {}.lang")}),
picked AS (SELECT {keys}, {quarters} FROM (SELECT {keys}, bin, sum(w) OVER (PARTITION BY {keys} ORDER BY bin) AS below, sum(w) OVER (PARTITION BY {keys}) AS total FROM blended) GROUP BY {keys}),
fence AS (SELECT lang, source, rate, greatest(q2 + {margin}, q3 + {SPREADS} * (q3 - q1)) AS high,
    CASE WHEN rate IN ('r_length') THEN least(q2 - {margin}, q1 - {SPREADS} * (q3 - q1)) ELSE -1 END AS low FROM picked),
wide AS (SELECT lang, source, {wide} FROM fence GROUP BY lang, source),
judged AS (SELECT m.*, NOT base_failed AND coalesce({inside}, false) AS kept
    FROM measured m LEFT JOIN wide f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source)"""


SQL = f"""WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),{RATE_SQL},
{_judge_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""

query("op9_quality_rules", SQL)(op9)
