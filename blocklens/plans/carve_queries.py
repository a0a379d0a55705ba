"""Carving over virtual media laid out from pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blocklens.functions import native_packs, scoring
from blocklens.operators import carve, ranges, slices, wipe
from blocklens.plans import containers as ct
from blocklens.plans import domain as d
from blocklens.plans.catalog import query, r6, table
from blocklens.session import cut_lineage
from blocklens.sources import signatures

IMG = ["image_id"]
PER_IMAGE = 64
HTML_SIG = [("html", "<!DOCTYPE html>".encode().hex(), "</html>".encode().hex(), 1 << 20, 0)]


def sig_table(spark: SparkSession) -> DataFrame:
    """Default signatures plus the page signature registered after them."""
    return signatures.append_signatures(signatures.signature_rows(spark), signatures.signature_rows(spark, HTML_SIG))


def layout(spark: SparkSession, sf: str) -> DataFrame:
    """64 consecutive pages per medium, each from a block border on: a running sum over at most 64 rows."""
    p = table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("payload"))
    p = (p.withColumn("image_id", F.floor(F.col("page_id") / PER_IMAGE).cast("bigint"))
         .withColumn("blocks", F.ceil(F.octet_length("payload") / 512)))
    w = Window.partitionBy("image_id").orderBy("page_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return p.withColumn("lba", (F.sum("blocks").over(w) - F.col("blocks")))


LAYOUT = f"""lay AS (SELECT page_id, page_id // {PER_IMAGE} AS image_id, html, strlen(html) AS n, (strlen(html)+511)//512 AS blocks,
  CAST(sum((strlen(html)+511)//512) OVER (PARTITION BY page_id // {PER_IMAGE} ORDER BY page_id) AS BIGINT) - (strlen(html)+511)//512 AS lba FROM pages),
 tot AS (SELECT image_id, CAST(sum(blocks) AS BIGINT) AS total FROM lay GROUP BY 1),
 v AS (SELECT *, contains(html, '</html>') AS is_ok, CASE WHEN contains(html, '</html>') THEN strlen(split_part(html, '</html>', 1)) + 7 ELSE n END AS len FROM lay)"""


def sectors(spark: SparkSession, sf: str) -> DataFrame:
    pad = F.concat("payload", ct.zeros(F.col("blocks") * 512 - F.octet_length("payload")))
    return (layout(spark, sf).withColumn("_p", pad)
            .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
            .select("image_id", (F.col("lba") + F.col("_i")).alias("lba"), F.substring(F.col("_p"), (F.col("_i") * 512 + 1).cast("int"), F.lit(512)).alias("payload")))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(carve.to_chunks(sectors(spark, sf), IMG))


def page_candidates(spark: SparkSession, sf: str, media: DataFrame) -> DataFrame:
    return carve.candidates(carve.block_heads(media, IMG), sig_table(spark), IMG)


@query("jn01_match_headers", f"WITH {LAYOUT} SELECT image_id, lba, 'html' AS file_type FROM lay WHERE starts_with(html, '<!DOCTYPE html>')")
def match_headers(spark, sf):
    heads = sectors(spark, sf).select("image_id", "lba", F.col("payload").alias("head"))
    return carve.match_headers(heads, sig_table(spark)).select("image_id", "lba", "file_type")


@query("crv01_candidates", f"""WITH {LAYOUT} SELECT image_id, lba, 'html' AS file_type FROM lay l WHERE NOT EXISTS (SELECT 1 FROM lay a WHERE a.page_id % 5 = 2
 AND a.image_id = l.image_id AND l.lba >= a.lba AND l.lba < a.lba + a.blocks)""")
def candidates(spark, sf):
    lay = layout(spark, sf)
    taken = lay.where("page_id % 5 = 2").select("image_id", F.col("lba").alias("start_lba"), F.col("blocks").alias("block_count"))
    heads = sectors(spark, sf).select("image_id", "lba", F.col("payload").alias("head"))
    return carve.candidates(heads, sig_table(spark), IMG, taken, ["HTML", "png"]).select("image_id", "lba", "file_type")


@query("jn05_candidate_window", f"""WITH {LAYOUT} SELECT l.image_id, l.lba, least(2048, total - lba) AS window_blocks, least(2048, total - lba) * 512 AS window_bytes,
 sha256(unhex(substr(hex(encode(html)), 1, 1024))) AS first_block FROM lay l JOIN tot USING (image_id)""")
def candidate_window(spark, sf):
    m = chunks(spark, sf)
    sized = carve.windowed(page_candidates(spark, sf, m), carve.total_blocks(m, IMG), IMG, carve.FIRST_WINDOW)
    w = carve.candidate_windows(sized, m, IMG, most=carve.FIRST_WINDOW)
    return w.select("image_id", "lba", "window_blocks", F.octet_length("payload").cast("bigint").alias("window_bytes"),
                    F.sha2(F.substring("payload", 1, 512), 256).alias("first_block"))


@query("crv02_validate_candidates", f"WITH {LAYOUT} SELECT image_id, 'html' AS file_type, CASE WHEN is_ok THEN 'OK' ELSE 'EOF' END AS verdict, count(*) AS n FROM v GROUP BY ALL")
def validate(spark, sf):
    m = chunks(spark, sf)
    sized = carve.windowed(page_candidates(spark, sf, m), carve.total_blocks(m, IMG), IMG, carve.FIRST_WINDOW)
    w = carve.candidate_windows(sized, m, IMG, carry=carve.CARRY, most=carve.FIRST_WINDOW)
    return carve.verdict_summary(carve.validate_candidates(w), IMG)


@query("crv03_expand_window", f"WITH {LAYOUT} SELECT image_id, lba, CASE WHEN is_ok THEN 'OK' ELSE 'EOF' END AS verdict, len AS length FROM v")
def expand(spark, sf):
    m = chunks(spark, sf)
    got = carve.judged(page_candidates(spark, sf, m), m, carve.total_blocks(m, IMG), IMG, first_window=2)
    return got.select("image_id", "lba", "verdict", "length")


@query("crv04_trim_payload", f"""WITH {LAYOUT} SELECT image_id, lba, len AS payload_length, (len+511)//512 AS blocks,
 sha256(unhex(substr(hex(encode(html)), 1, len*2))) AS content_hash FROM v WHERE is_ok""")
def trim(spark, sf):
    m = chunks(spark, sf)
    got = carve.judged(page_candidates(spark, sf, m), m, carve.total_blocks(m, IMG), IMG)
    sized = carve.sized_results(got).where("is_ok").withColumn("window_blocks", F.col("blocks"))
    w = carve.candidate_windows(sized, m, IMG, carry=["payload_length"])
    return w.select("image_id", "lba", "payload_length", F.col("window_blocks").alias("blocks"),
                    F.sha2(F.substring(F.col("payload"), F.lit(1), F.col("payload_length").cast("int")), 256).alias("content_hash"))


@query("crv05_useful_partial", f"WITH {LAYOUT} SELECT image_id, lba, len AS length FROM v WHERE NOT is_ok AND len >= 16")
def partials(spark, sf):
    m = chunks(spark, sf)
    got = carve.judged(page_candidates(spark, sf, m), m, carve.total_blocks(m, IMG), IMG)
    return carve.sized_results(got).where("NOT is_ok").select("image_id", "lba", F.col("payload_length").alias("length"))


def overlapping(spark, sf):
    """Validated objects with many overlaps: position, first signature, block count."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 16).alias("image_id"), F.col("l_partkey").alias("lba"), F.col("l_linenumber").alias("sig_order"),
        (F.col("l_returnflag") != "R").alias("is_ok"), F.col("l_quantity").cast("bigint").alias("blocks"))


@query("crv06_greedy_select", """WITH RECURSIVE s AS (SELECT l_suppkey % 16 AS image_id, l_partkey AS lba, l_linenumber AS sig_order, l_returnflag <> 'R' AS is_ok,
  CAST(l_quantity AS BIGINT) AS blocks FROM lineitem),
 u AS (SELECT image_id, lba, sig_order, bool_and(is_ok) AS is_ok, max(blocks) AS blocks FROM s GROUP BY ALL),
 w AS (SELECT image_id, lba, arg_min(is_ok, sig_order) AS is_ok, arg_min(blocks, sig_order) AS blocks FROM u GROUP BY ALL),
 walk(image_id, lba, z) AS (
  SELECT image_id, min(lba), arg_min(lba + blocks, lba) FROM w WHERE is_ok GROUP BY image_id
  UNION ALL
  SELECT k.image_id, min(w.lba), arg_min(w.lba + w.blocks, w.lba) FROM walk k JOIN w ON w.image_id = k.image_id AND w.is_ok AND w.lba >= k.z GROUP BY k.image_id)
SELECT w.image_id, w.lba, w.is_ok, w.blocks FROM w JOIN walk k ON k.image_id = w.image_id AND k.lba = w.lba WHERE w.is_ok
UNION ALL SELECT image_id, lba, is_ok, blocks FROM w WHERE NOT is_ok AND NOT EXISTS (SELECT 1 FROM walk k WHERE k.image_id = w.image_id AND w.lba > k.lba AND w.lba < k.z)""")
def greedy(spark, sf):
    one = overlapping(spark, sf).groupBy("image_id", "lba", "sig_order").agg(F.bool_and("is_ok").alias("is_ok"), F.max("blocks").alias("blocks"))
    return carve.greedy_select(one, IMG, cut_width=4096).select("image_id", "lba", "is_ok", "blocks")


@query("crv07_assign_ids", """SELECT image_id, lba AS start_lba, 2000 + row_number() OVER (PARTITION BY image_id ORDER BY lba) AS artifact_id
FROM (SELECT DISTINCT l_suppkey % 16 AS image_id, l_partkey AS lba FROM lineitem)""")
def assign_ids(spark, sf):
    one = overlapping(spark, sf).select("image_id", F.col("lba").alias("start_lba")).distinct()
    return carve.assign_ids(one, IMG, 2)


@query("crv08_gap_plan", f"""WITH {LAYOUT}, e(i, g) AS (VALUES (0,8),(1,16),(2,32),(3,4),(4,64),(5,24),(6,40),(7,128),(8,256),(9,512),(10,1024),(11,2048)),
 p AS (SELECT i AS gap_rank, g AS gap FROM e UNION ALL SELECT 11 + row_number() OVER (ORDER BY r), r FROM range(1, 2049) t(r) WHERE r NOT IN (SELECT g FROM e))
SELECT image_id, CAST(gap_rank AS INT) AS gap_rank, CAST(gap AS BIGINT) AS gap FROM tot JOIN p ON gap < total""")
def gap_plan(spark, sf):
    lay = layout(spark, sf).groupBy("image_id").agg(F.sum("blocks").alias("total_blocks"))
    plan = F.array(*[F.struct(F.lit(i).alias("gap_rank"), F.lit(g).cast("bigint").alias("gap")) for i, g in enumerate(carve.gap_plan())])
    return lay.select("image_id", "total_blocks", F.explode(plan).alias("_g")).select("image_id", "_g.*", "total_blocks").where("gap < total_blocks").drop("total_blocks")


@query("crv09_fragment_candidates", f"""WITH {LAYOUT}, h AS (SELECT l.image_id, lba, total FROM lay l JOIN tot USING (image_id)),
 a AS (SELECT image_id, lba AS s, lba + blocks AS z FROM lay WHERE page_id % 5 = 2),
 f1 AS (SELECT h.*, s.split FROM h, range(1, 6) s(split) WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.image_id = h.image_id AND a.s < h.lba + s.split AND a.z > h.lba)),
 f AS (SELECT f1.*, e.expected, g.gap, lba + split + gap AS f2, expected - split AS c2 FROM f1, range(2, 7) e(expected), range(1, 9) g(gap)
  WHERE split < expected AND lba + expected < total AND gap + lba + expected < total)
SELECT image_id, lba, count(*) AS n, CAST(sum(f2) AS BIGINT) AS checksum FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.image_id = f.image_id AND a.s < f2 + c2 AND a.z > f2) GROUP BY ALL""")
def fragment_candidates(spark, sf):
    lay = layout(spark, sf).select("page_id", "image_id", "lba", "blocks", F.lit("html").alias("file_type"), F.lit(7).alias("sig_order"))
    tot = lay.groupBy("image_id").agg(F.sum("blocks").alias("total_blocks"))
    taken = lay.where("page_id % 5 = 2").select("image_id", F.col("lba").alias("start_lba"), F.col("blocks").alias("block_count"))
    f = carve.fragment_candidates(lay, tot, taken, IMG, 8, max_expected=6)
    return f.groupBy("image_id", "lba").agg(F.count(F.lit(1)).alias("n"), F.sum("frag2_lba").alias("checksum"))


SPLIT_SQL = "page_id % 2 + 1"
GAPS = [8, 16, 32, 4]
GAP_SQL = "CASE page_id % 4 " + " ".join(f"WHEN {i} THEN {g}" for i, g in enumerate(GAPS)) + " END"


def two_part(spark, sf):
    """One medium per page: a picture of one or two blocks, foreign blocks, then its end chunk."""
    p = table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("body"))
    split = F.col("page_id") % 2 + 1
    gap = F.element_at(F.array(*[F.lit(g) for g in GAPS]), (F.col("page_id") % 4 + 1).cast("int"))
    text = F.substring(F.col("body"), F.lit(1), (split * 512 - 45).cast("int"))
    typed = F.concat(F.lit(b"tEXt"), text, ct.zeros(split * 512 - 45 - F.octet_length(text)))
    part1 = F.concat(ct.png_head(), ct.be(split * 512 - 45, 4), typed, ct.be(F.crc32(typed), 4))
    noise = F.encode(F.repeat(F.lit("foreign block bytes and more... "), (gap * 16).cast("int")), "UTF-8")
    return p.select(F.col("page_id").alias("image_id"), F.concat(part1, noise, ct.hx(ct.PNG_END)).alias("payload"))


@query("crv10_prefix_reject", f"""SELECT page_id AS image_id, count(*) AS n FROM pages, range(2, 5) e(x), range(1, 4) s(y), range(1, 5) g(z)
WHERE y < x AND x + z < {SPLIT_SQL} + {GAP_SQL} + 1 + 2 AND (page_id % 3 <> 0 OR y < {SPLIT_SQL}) GROUP BY ALL""")
def prefix_reject(spark, sf):
    """Pictures with a wrong checksum in every third medium: splits that hold the whole chunk go."""
    t = two_part(spark, sf)
    at = (F.col("image_id") % 2 + 1) * 512
    wrong = F.concat(F.substring(F.col("payload"), F.lit(1), (at - 4).cast("int")), ct.hx("00000000"), F.substring(F.col("payload"), (at + 1).cast("int"), F.lit(1 << 30)))
    t = t.withColumn("payload", F.when(F.col("image_id") % 3 == 0, wrong).otherwise(F.col("payload")))
    m = cut_lineage(ct.media_of(t, lead=0, tail=2))
    sig = signatures.signature_rows(spark)
    hits = carve.candidates(carve.block_heads(m, IMG), sig, IMG, types=["png"])
    none = hits.select("image_id", F.lit(0).cast("bigint").alias("start_lba"), F.lit(0).cast("bigint").alias("block_count"))
    f = carve.fragment_candidates(hits, carve.total_blocks(m, IMG), none, IMG, 4, max_expected=4)
    return carve.prefix_reject(f, m, IMG).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


@query("crv11_reassemble_first", f"""SELECT page_id AS image_id, 3 AS lba, CAST({SPLIT_SQL} + 1 AS INT) AS expected, {SPLIT_SQL} AS split, CAST({GAP_SQL} AS BIGINT) AS gap,
 ({SPLIT_SQL}) * 512 + 12 AS length FROM pages""")
def reassemble(spark, sf):
    m = cut_lineage(ct.media_of(two_part(spark, sf)))
    hits = carve.candidates(carve.block_heads(m, IMG), signatures.signature_rows(spark), IMG)
    tot = carve.total_blocks(m, IMG)
    none = tot.select("image_id", F.lit(0).cast("bigint").alias("start_lba"), F.lit(0).cast("bigint").alias("block_count"))
    return carve.reassemble_first(hits, m, tot, none, IMG).select("image_id", F.col("lba").cast("int").alias("lba"), "expected", "split", "gap", "length")


def _outcome(column: int) -> str:
    return "CASE page_id % 7 " + " ".join(f"WHEN {i} THEN {ct.OUTCOME[f][column]}" for i, f in enumerate(ct.FORMATS)) + " END"


_FMT = "CASE page_id % 7 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(ct.FORMATS)) + " END"
# cut short, the last-marker formats verify to the end of the medium; the compound file is completed by its zero tail
_LONG = f"CASE WHEN page_id % 7 IN (2, 3, 4) THEN (((({_outcome(1)}) + 511) // 512) + 2) * 512 WHEN page_id % 7 = 6 THEN {ct.OLE_SQL} ELSE {_outcome(1)} END"
_LONG = _LONG.replace(ct.PAGES_SQL, "page_bytes")
RECOVERED = f"""rec AS (SELECT page_id AS image_id, {_FMT} AS file_type, page_id // 7 % 3 AS variant, CASE WHEN page_id // 7 % 3 = 0 THEN {_outcome(0)} ELSE {_LONG} END AS bytes
 FROM (SELECT page_id, strlen(html) AS n, {ct.PAGES_SQL.replace("n+108","strlen(html)+108")} AS page_bytes FROM pages))"""


@query("crv12_recover_image", f"""WITH {RECOVERED} SELECT image_id, CAST(2 AS INT) AS tier, 3 AS start_lba, file_type, bytes AS recovered_bytes, variant = 1 AND file_type <> 'ole2' AS partial
FROM rec WHERE variant < 2""")
def recover(spark, sf):
    m = cut_lineage(ct.media_of(ct.mixed(spark, sf)))
    got = carve.recover_image(m, signatures.signature_rows(spark), IMG)
    return got.select("image_id", "tier", F.col("start_lba").cast("int").alias("start_lba"), "file_type", "recovered_bytes",
                      F.col("limitations").isNotNull().alias("partial"))


@query("san4_recovery_check", f"WITH {RECOVERED} SELECT image_id, CASE WHEN image_id % 2 = 0 THEN 0 WHEN variant < 2 THEN 1 ELSE 0 END AS recovered, image_id % 2 = 0 OR variant = 2 AS passed FROM rec")
def recovery_check(spark, sf):
    wiped = F.when(F.col("image_id") % 2 == 0, ct.zeros(F.octet_length("payload"))).otherwise(F.col("payload"))
    m = cut_lineage(ct.media_of(ct.mixed(spark, sf)).withColumn("payload", wiped))
    got = carve.recover_image(m, signatures.signature_rows(spark), IMG, tiers=(2, 3))
    return wipe.recovery_check(got, carve.total_blocks(m, IMG), IMG)


def page_entries(spark, sf):
    """Directory entries of the laid-out pages: resident, contiguous, two extents, or unresolved."""
    lay = layout(spark, sf)
    ext = lambda s, c: F.struct(s.cast("bigint").alias("start_lba"), c.cast("bigint").alias("block_count"))
    one, two = F.array(ext(F.col("lba"), F.col("blocks"))), F.array(ext(F.col("lba"), F.lit(1)), ext(F.col("lba") + 1, F.col("blocks") - 1))
    kind = F.when(F.col("page_id") % 5 == 0, "Resident").when(F.col("page_id") % 5 == 1, "Fragmented").when(F.col("page_id") % 5 == 2, "Unresolved").otherwise("Contiguous")
    loc = F.struct(kind.alias("kind"), F.when(kind == "Resident", F.col("payload")).alias("resident"),
                   F.when(kind == "Contiguous", one).when(kind == "Fragmented", two).alias("extents"))
    conf = F.when(F.col("page_id") % 2 == 0, "Confirmed").otherwise("Partial")
    return lay.select("image_id", F.col("page_id").alias("entry_id"), F.concat(F.lit("Page"), F.col("page_id"), F.lit(".HTML")).alias("name"),
                      F.concat(F.lit("/web/Page"), F.col("page_id"), F.lit(".HTML")).alias("path"), (F.octet_length("payload") - F.col("page_id") % 3).cast("bigint").alias("size_bytes"),
                      conf.alias("confidence"), loc.alias("location"))


BODY_SQL = """CASE WHEN page_id % 5 = 2 THEN '' WHEN page_id % 5 = 0 THEN hex(encode(html)) ELSE substr(hex(encode(html)), 1, (strlen(html) - page_id % 3) * 2) END"""


@query("jn06_extent_payload", f"SELECT page_id AS entry_id, strlen({BODY_SQL}) // 2 AS bytes, sha256(unhex({BODY_SQL})) AS content_hash FROM pages")
def extent_payload(spark, sf):
    got = carve.extent_payload(page_entries(spark, sf), chunks(spark, sf), IMG)
    return got.select("entry_id", F.octet_length("payload").cast("bigint").alias("bytes"), F.sha2("payload", 256).alias("content_hash"))


@query("crv13_tier1_artifacts", f"""SELECT page_id // {PER_IMAGE} AS image_id, 1000 + row_number() OVER (PARTITION BY page_id // {PER_IMAGE} ORDER BY page_id) AS artifact_id,
 'Page' || page_id || '.HTML' AS filename, 'html' AS file_type, sha256(unhex({BODY_SQL})) AS content_hash, CASE WHEN page_id % 2 = 0 THEN 1.0 ELSE 0.6 END::DOUBLE AS metadata,
 CASE WHEN page_id % 2 = 0 THEN 1.0 ELSE 0.6 END::DOUBLE AS overwrite, page_id % 5 = 2 AS lost FROM pages""")
def tier1(spark, sf):
    got = carve.tier1_artifacts(page_entries(spark, sf), chunks(spark, sf), IMG)
    return got.select("image_id", "artifact_id", "filename", "file_type", "content_hash", "metadata", "overwrite", F.col("limitations").isNotNull().alias("lost"))


@query("jn14_supersede_partials", f"""WITH {d.ARTIFACTS} SELECT image_id, artifact_id, start_lba, limitations FROM artifacts a WHERE tier = 2 AND NOT (limitations IS NOT NULL
 AND EXISTS (SELECT 1 FROM artifacts t WHERE t.tier = 3 AND t.image_id = a.image_id AND t.start_lba = a.start_lba))""")
def supersede(spark, sf):
    a = d.artifacts(spark, sf)
    return carve.supersede_partials(a.where("tier = 2"), a.where("tier = 3"), IMG).select("image_id", "artifact_id", "start_lba", "limitations")


CNF1 = """x AS (SELECT page_id, html || repeat(' ', page_id % 700) AS p, contains(html, '</html>') AS has, page_id % 9 = 0 AS is_eof FROM pages),
 y AS (SELECT *, strlen(string_split(p, '</html>')[-1]) AS slack FROM x)"""


@query("cnf1_header_footer_score", f"""WITH {CNF1} SELECT page_id, round(CASE WHEN is_eof THEN 0.5::DOUBLE WHEN NOT has THEN 0.6::DOUBLE WHEN slack = 0 THEN 1.0::DOUBLE
 ELSE greatest(least(1 - slack/512.0::DOUBLE*0.15::DOUBLE, 0.99::DOUBLE), 0.8::DOUBLE) END, 6) AS score FROM y""")
def header_footer(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.encode(F.concat("html", F.repeat(F.lit(" "), (F.col("page_id") % 700).cast("int"))), "UTF-8").alias("payload"))
    return p.select("page_id", r6(scoring.header_footer_score(F.col("payload"), F.lit("html"), F.lit(b"</html>"), F.col("page_id") % 9 == 0)).alias("score"))


@query("cnf1_footerless_score", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 ELSE 1.0 END::DOUBLE AS score FROM pages")
def footerless(spark, sf):
    b = ct.bodies(spark, sf)
    kinds = F.element_at(F.array(F.lit("sqlite"), F.lit("mp4"), F.lit("ole2")), (F.col("page_id") % 3 + 1).cast("int"))
    zero = F.lit(0)
    p = F.when(F.col("page_id") % 3 == 0, ct.sqlite(F.col("body"), zero)).when(F.col("page_id") % 3 == 1, ct.mp4(F.col("body"), zero)).otherwise(ct.ole2(F.col("body"), zero))
    return b.select("page_id", scoring.header_footer_score(p, kinds, F.lit(None).cast("binary"), F.lit(False)).alias("score"))


@query("cnf2_structural_score", """SELECT l_orderkey, l_linenumber, l_quantity, round(CASE l_linenumber % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE CASE l_partkey % 8
 WHEN 0 THEN 0.6::DOUBLE WHEN 1 THEN 0.65::DOUBLE WHEN 2 THEN 0.6::DOUBLE WHEN 3 THEN 0.55::DOUBLE WHEN 4 THEN 0.7::DOUBLE WHEN 6 THEN 0.55::DOUBLE
 ELSE least(greatest(0.5::DOUBLE + 0.2::DOUBLE * least(l_quantity / 40, 1), 0.5), 0.7) END END, 6) AS score, l_partkey FROM lineitem""")
def structural(spark, sf):
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("jpeg", "png", "pdf", "zip", "sqlite", "ole2", "mp4", "other")]), (F.col("l_partkey") % 8 + 1).cast("int"))
    verdict = F.element_at(F.array(F.lit("OK"), F.lit("ERR"), F.lit("EOF")), F.col("l_linenumber") % 3 + 1)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", r6(
        scoring.structural_score(verdict, kinds, F.col("l_quantity"), F.lit(40))).alias("score"), "l_partkey")


def _register_packs() -> None:
    for fmt in ct.FORMATS:
        whole, short = ct.OUTCOME[fmt]
        sql = f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'EOF' ELSE 'ERR' END AS verdict,
 CAST(CASE page_id % 3 WHEN 0 THEN {whole} WHEN 1 THEN {short} END AS BIGINT) AS length FROM (SELECT page_id, strlen(html) AS n FROM pages)"""

        def run(spark, sf, fmt=fmt):
            return carve.validate_candidates(ct.wrapped(spark, sf, fmt)).select("page_id", "verdict", "length")

        query(f"val_{fmt}", sql)(run)


_register_packs()
