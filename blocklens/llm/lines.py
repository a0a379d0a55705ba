"""Line deduplication in content-defined chunks.

A chunk ends after a line where a rolling hash over the last two lines' hashes is divisible by ``DIVISOR``, so an inserted or lost line only moves
the boundaries next to it. Chunks of at least two lines with words are looked up globally by digest; where a digest repeats, the chunk's
text is compared byte by byte with its first occurrence (smallest doc_id, then place), and equal ones are removed.

Digests, places and minima are narrow rows; only the text of repeated chunks is brought together, and a chunk that stands in a
third of all documents meets its first occurrence in a join whose large side Spark splits.

Defined results: a null text is one empty line; null ids come last; rows that repeat doc_id and text are one document and lose the same
chunks; a text that loses all its lines becomes empty; an empty table gives an empty result; a column ``n_chars`` is brought up to date, all
others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.llm.common import SPACE_CHARS, query, table, text_of
from blocklens.session import cut_lineage

DIVISOR = 3
LEAST_LINES = 2


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _chunked(texts: DataFrame, divisor: int, least: int) -> DataFrame:
    """(id_, hash_, start, size, digest): the multi-line chunks of every text."""
    a = texts.select("id_", "hash_", F.split("text_", "\n").alias("lines")).withColumn("h", F.transform("lines", _line_hash))
    last = F.size("h") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | ((i >= 1) & ((F.get("h", i - 1) * 31 + F.get("h", i)) % divisor == 0)))
    b = a.select("id_", "hash_", "lines", ends.alias("ends"))
    spans = F.transform("ends", lambda e, k: F.struct(F.when(k == 0, F.lit(0)).otherwise(F.get("ends", k - 1) + 1).alias("start"), e.alias("last")))
    c = b.select("id_", "hash_", "lines", F.explode(spans).alias("s")).select(
        "id_", "hash_", F.col("s.start").alias("start"), (F.col("s.last") - F.col("s.start") + 1).alias("size"), F.slice("lines", F.col("s.start") + 1, F.col("s.last") - F.col("s.start") + 1).alias("part"))
    worded = F.size(F.filter("part", lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0))
    return c.filter(worded >= least).select("id_", "hash_", "start", "size", F.unhex(F.md5(F.array_join("part", "\n"))).alias("digest"))


def remove_chunks(docs: DataFrame, divisor: int = DIVISOR, least: int = LEAST_LINES, counts: bool = False) -> DataFrame:
    """``docs`` with the later occurrences of repeated chunks cut out of ``text``; with ``counts`` also n_lines and n_removed."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    base = docs.select(docs["doc_id"].alias("id_"), F.xxhash64(docs["text"]).alias("hash_"), text_of("text").alias("text_"),
                       *([F.struct(*[docs[c] for c in others]).alias("others_")] if others else []))
    texts = base.select("id_", "hash_", "text_")
    chunks = cut_lineage(_chunked(texts, divisor, least))
    order = F.struct(F.col("id_").isNull().alias("none"), "id_", "hash_", "start")
    repeated = cut_lineage(chunks.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    places = chunks.join(repeated, "digest").select("id_", "hash_", F.struct("start", "size", "digest", (order == F.col("first")).alias("is_first")).alias("place"))
    per_text = cut_lineage(places.groupBy("id_", "hash_").agg(F.collect_set("place").alias("places"))).select(F.col("id_").alias("id_p"), F.col("hash_").alias("hash_p"), "places")
    same = lambda l, r, s: l["id_"].eqNullSafe(r[f"id_{s}"]) & l["hash_"].eqNullSafe(r[f"hash_{s}"])
    pieces = (texts.join(per_text, same(texts, per_text, "p")).select("id_", "hash_", F.split("text_", "\n").alias("lines"), F.explode("places").alias("p"))
              .select("id_", "hash_", F.col("p.start").alias("start"), F.col("p.size").alias("size"), F.col("p.digest").alias("digest"), F.col("p.is_first").alias("is_first"),
                      F.array_join(F.slice("lines", F.col("p.start") + 1, F.col("p.size")), "\n").alias("piece")))
    first = pieces.filter("is_first").select(F.col("digest").alias("digest_f"), F.col("piece").alias("kept")).dropDuplicates(["digest_f"])
    # the byte comparison
    equal = pieces.filter("not is_first").join(first, (F.col("digest") == F.col("digest_f")) & (F.col("piece") == F.col("kept")))
    gone = equal.groupBy("id_", "hash_").agg(F.collect_set(F.struct("start", "size")).alias("gone")).select(F.col("id_").alias("id_g"), F.col("hash_").alias("hash_g"), "gone")
    met = base.join(gone, same(base, gone, "g"), "left").withColumn("lines", F.split("text_", "\n"))
    stays = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x, i: ~F.exists("gone", lambda g: (i >= g["start"]) & (i < g["start"] + g["size"]))))
    done = met.withColumn("stays", stays).withColumn("new_text", F.array_join("stays", "\n"))
    value = {"doc_id": F.col("id_"), "text": F.col("new_text"), **{c: F.col(f"others_.`{c}`") for c in others}}
    if "n_chars" in value:
        value["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    extra = {"n_lines": F.size("lines").cast("long"), "n_removed": (F.size("lines") - F.size("stays")).cast("long")} if counts else {}
    return done.select(*[value[c].alias(c) for c in docs.columns if c not in extra], *[v.alias(k) for k, v in extra.items()])


def chunk_sql(source: str) -> str:
    """Common table expressions from ``source`` (doc_id, text) to ``kept_lines`` (doc_id, n_lines, n_removed, new_text)."""
    return f"""
ln AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM {source}),
lh AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM ln),
lb AS (SELECT *, CASE WHEN i >= 1 AND (lag(h) OVER w * 31 + h) % {DIVISOR} = 0 THEN 1 ELSE 0 END AS cut FROM lh WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
lc AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM lb),
ch AS (SELECT doc_id, chunk, min(i) AS start, string_agg(line, chr(10) ORDER BY i) AS piece, sum(CASE WHEN regexp_matches(line, '[^\\x20\\x09-\\x0D]') THEN 1 ELSE 0 END) AS worded FROM lc GROUP BY doc_id, chunk),
rp AS (SELECT doc_id, chunk, row_number() OVER (PARTITION BY piece ORDER BY doc_id, start) AS rn FROM ch WHERE worded >= {LEAST_LINES}),
kept_lines AS (SELECT doc_id, count(*)::BIGINT AS n_lines, sum(CASE WHEN rn > 1 THEN 1 ELSE 0 END)::BIGINT AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE coalesce(rn, 1) = 1), '') AS new_text FROM lc LEFT JOIN rp USING (doc_id, chunk) GROUP BY doc_id)"""


@query("op10_line_dedup", f"WITH {chunk_sql('documents')}\nSELECT doc_id, n_lines, n_removed, sha256(new_text) AS kept_sha256 FROM kept_lines")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
