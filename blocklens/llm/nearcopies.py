"""Near copies by the exact Jaccard similarity of five-word shingles.

Candidates come from two sources. SimHash fingerprints of the shingle sets (``simhash``) that link at three or fewer differing bits bring the
nodes of a fingerprint component together; at similarity 0.8 they differ in about ten bits, so most near pairs need the second source:
MinHash bands, ``BANDS`` keys of ``ROWS`` minima each, so a pair at similarity 0.8 shares no key in one case of
twenty thousand, and rarer above. The members of a key go to the bucket of the key's smallest node, once however many of its keys they
share, as sorted shingle hashes; texts never meet. A bucket is compared inside tasks by exact overlaps; only links that join two
components leave a task, fewer than its members, so no pair of a group is ever a row.

Buckets above ``BLOCK`` shingles or ``BLOCK_ROWS`` members are cut into blocks by node. First every block is compared with itself and the
bucket's smallest node, which settles a group of near copies. Buckets that still hold several components are then compared block by
block, every member going to each of the bucket's blocks; that work, not its rows, is quadratic in the members of such a bucket.

Copies never meet: texts of equal words are one node. Defined results: null and wordless texts are one node without keys, near to
nothing else; texts of fewer words than a shingle are one shingle; null ids count last; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm import simhash
from blocklens.llm.common import partitions, small_side
from blocklens.llm.graphs import components
from blocklens.session import cut_lineage

SHINGLE = 5
#: least similarity, as a fraction: integers decide it without rounding
SIMILAR = (4, 5)
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
SEED = 42
#: shingles and members of a block: what one comparison holds in memory
BLOCK, BLOCK_ROWS = 1 << 20, 2048

_rng = np.random.default_rng(SEED)
_MULTIPLY = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def node_of(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED)


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The set of hashed shingles of a text, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    h, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((h(b" ".join(words[i:i + shingle]), SEED) for i in range(n)), np.uint64, n))


def minima(found: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(out, (found[at:at + 512, None] * _MULTIPLY + _ADD).min(axis=0), out=out)
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _words(text) -> list[bytes]:
    return (text.as_py() or b"").lower().split()


def _sign(batches):
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        nodes, sizes, prints, keys = [], [], [], []
        for i in range(batch.num_rows):
            words = _words(texts[i])
            found = shingles(words)
            nodes.append(_signed(node_of(words)))
            sizes.append(len(found))
            prints.append(_signed(simhash.majority(found)) if words else None)
            m = minima(found)
            keys.append([_signed(xxhash.xxh64_intdigest(m[k * ROWS:(k + 1) * ROWS].tobytes(), k)) for k in range(BANDS)] if words else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()),
                                          pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "hash", "node", "size", "print", "keys"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, node, number of shingles, SimHash fingerprint (null: no word) and band keys of every row; one pass over the whole texts."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("hash"), docs["text"]).mapInArrow(
        _sign, "doc_id long, hash long, node long, size long, print long, keys array<long>")


def _with_node(batches):
    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        nodes = [_signed(node_of(_words(texts[i]))) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), batch.column(0)], names=["node", "text"])


def _with_set(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(_words(t)).tobytes() for t in texts], pa.binary())], names=["node", "set"])


def sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its sorted shingle hashes, of the ``nodes`` only; texts move once, and not at all where these are few."""
    texts = docs.select("text").mapInArrow(_with_node, "node long, text string")
    return texts.join(small_side(nodes), "node", "left_semi").dropDuplicates(["node"]).mapInArrow(_with_set, "node long, set binary")


def spans(found: list[np.ndarray], label: np.ndarray, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join the rows as all similar pairs would, rows of equal ``label`` being joined already.

    Without ``left`` every row meets those after it; with it, the rows of that mask meet the others. A row is compared only with rows of
    other components whose size allows the similarity.
    """
    label, size = label.copy(), np.array([len(f) for f in found], np.int64)
    flat = np.unique(np.concatenate(found), return_inverse=True)[1].astype(np.int32)
    start = np.concatenate([[0], np.cumsum(size)])
    mark, rows, links = np.zeros(int(flat.max()) + 1, np.int32), np.arange(len(found)), []
    for i in rows if left is None else np.flatnonzero(left):
        meets = (rows > i if left is None else ~left) & (label != label[i]) & (size * SIMILAR[1] >= size[i] * SIMILAR[0]) & (size * SIMILAR[0] <= size[i] * SIMILAR[1])
        others = np.flatnonzero(meets)
        if not len(others):
            continue
        own = flat[start[i]:start[i + 1]]
        mark[own] = 1
        if 4 * len(others) > len(found):
            both = np.add.reduceat(mark[flat], start[:-1])[others]
        else:
            both = np.array([mark[flat[start[j]:start[j + 1]]].sum() for j in others])
        mark[own] = 0
        near = others[both * SIMILAR[1] >= (size[i] + size[others] - both) * SIMILAR[0]]
        joined, at = np.unique(label[near], return_index=True)
        links += [(int(i), int(j)) for j in near[at]]
        label[np.isin(label, joined)] = label[i]
    return links


def _groups(batches):
    """Columns of the rows of one (hub, x, y), which come sorted: lists of arrays node, root, set."""
    key, rows = None, []
    for batch in batches:
        hub, x, y = (np.asarray(batch.column(k)) for k in range(3))
        edges = np.flatnonzero((np.diff(hub) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            if a == b:
                continue
            if rows and key != (hub[a], x[a], y[a]):
                yield key, rows
                rows = []
            key = (hub[a], x[a], y[a])
            part = batch.slice(a, b - a)
            rows += zip(*(part.column(k).to_pylist() for k in (3, 4, 5, 6)))
    if rows:
        yield key, rows


def _compare(batches):
    for (_, x, y), rows in _groups(batches):
        node, root, block, found = zip(*rows)
        left = None if x == y else np.array(block) == x
        if len(rows) > 1 and (left is None or (left.any() and not left.all())):
            links = spans([np.frombuffer(f, np.uint64) for f in found], np.unique(np.array(root, np.int64), return_inverse=True)[1], left)
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in links], pa.int64()), pa.array([node[j] for _, j in links], pa.int64())], names=["a", "b"])


def _met(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b) inside each (hub, x, y) of ``rows`` (hub, x, y, node, root, block)."""
    # the rows come from an explode over blocks, which Spark's size estimates do not see: they must not be broadcast
    met = rows.join(known.hint("merge"), "node").select("hub", "x", "y", "node", "root", "block", "set")
    return met.repartition(partitions(rows.sparkSession), "hub", "x", "y").sortWithinPartitions("hub", "x", "y", "node").mapInArrow(_compare, "a long, b long")


def with_fingerprint_key(classes: DataFrame) -> DataFrame:
    """``classes`` (node, first, size, print, keys) with one more key per fingerprint: its SimHash component, whose members are compared like those of a band."""
    roots = components(simhash.links(classes.filter("print IS NOT NULL").select(F.col("print").alias("fingerprint")).distinct()))
    named = classes.join(roots.select(F.col("node").alias("print"), "root"), "print", "left")
    own = F.when(F.col("print").isNull(), F.col("keys")).otherwise(F.array_append("keys", F.xxhash64(F.lit("simhash"), F.coalesce("root", "print"))))
    return named.select("node", "first", "size", own.alias("keys"))


def links(docs: DataFrame, classes: DataFrame, block: int = BLOCK, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) that join the same nodes as all similar pairs of ``classes`` (node, size, keys) that share a key do."""
    every = classes.select("node", "size", F.explode("keys").alias("key"))
    shared = every.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("most")).filter("hub <> most").select("key", "hub")
    members = cut_lineage(every.join(shared, "key").select("hub", "node", "size").distinct())
    sized = members.groupBy("hub").agg(F.greatest(F.ceil(F.sum("size") / block), F.ceil(F.count("*") / block_rows)).alias("blocks"))
    members = cut_lineage(members.join(sized, "hub").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")))
    known = cut_lineage(sets(docs, members.select("node").distinct()))
    # the smallest node of a bucket meets all of its blocks
    everywhere = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    inside = members.select("hub", F.explode(everywhere).alias("x"), "node", F.col("node").alias("root"), "block").withColumn("y", F.col("x"))
    first = cut_lineage(_met(inside, known))
    cut = members.filter("blocks > 1").join(components(first), "node", "left").withColumn("root", F.coalesce("root", "node"))
    cut = cut_lineage(cut)
    mixed = cut.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("hub")
    other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda z: z != F.col("block"))).alias("other")
    across = cut.join(mixed, "hub", "left_semi").select("hub", "node", "root", "block", other)
    across = across.select("hub", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "node", "root", "block")
    return first.unionByName(_met(across, known))


def group(docs: DataFrame) -> DataFrame:
    """doc_id, hash, node, component_id: one row per document."""
    found = cut_lineage(signatures(docs))
    classes = cut_lineage(found.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("print").alias("print"), F.first("keys").alias("keys")))
    classes = cut_lineage(with_fingerprint_key(classes))
    roots = components(links(docs, classes))
    named = classes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = cut_lineage(named.join(least, "root").select("node", "component_id"))
    return found.select("doc_id", "hash", "node").join(label, "node").select("doc_id", "hash", "node", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with all its columns; rows repeating it (id and text) go too."""
    stays = group(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id_s"), F.col("hash").alias("hash_s")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row_"), docs["doc_id"].alias("id_"), F.xxhash64(docs["text"]).alias("hash_"))
    met = rows.join(stays, F.col("id_").eqNullSafe(F.col("id_s")) & (F.col("hash_") == F.col("hash_s")), "left_semi")
    return met.dropDuplicates(["id_", "hash_"]).select(*[F.col(f"row_.`{c}`").alias(c) for c in docs.columns])
