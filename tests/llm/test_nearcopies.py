"""Near copies of the pipeline against all pairs compared in plain Python."""

import random

import corpus_pipeline
import numpy as np
import plain
import pytest

from blocklens.llm import nearcopies, simhash
from blocklens.session import cut_lineage

SF = "/root/testdata/sf0.001"


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def survivors(texts: dict) -> set:
    """Smallest ids of the components over pairs at 0.8 or more; equal words are near."""
    found, root = {d: grams(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if 5 * len(found[a] & found[b]) >= 4 * len(found[a] | found[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d for d in ids if find(d) == d}


def test_near_dedup_links_every_pair_at_four_fifths(spark):
    texts = {}
    for k in range(60):  # similarities on both sides of 0.8
        base, rng = plain.prose(k, 200 + k), random.Random(k)
        texts[2 * k] = " ".join(base)
        for at in rng.sample(range(len(base)), 1 + k % 9):
            base[at] = f"changed{at}"
        texts[2 * k + 1] = " ".join(base)
    chain = plain.prose(999, 300)  # every link is near, the ends are not
    for k in range(8):
        texts[200 + k] = " ".join(chain[k * 15:k * 15 + 200])
    texts |= {300: "", 301: None, 302: "One two", 303: "one  TWO", 304: "one three"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, SF).collect()}
    want = survivors(texts)
    assert got == want
    assert 20 < sum(2 * k + 1 not in want for k in range(60)) < 60 and not want & set(range(201, 208)) and 301 not in want


def test_near_dedup_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == survivors(texts)


def changed(seed, base, words, at=None):
    rng = random.Random(seed)
    out = list(base)
    for k in at or rng.sample(range(len(out)), words):
        out[k] = f"w{seed}x{k}"
    return " ".join(out)


def links_of(spark, texts, **limits):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = cut_lineage(nearcopies.signatures(df))
    classes = cut_lineage(found.select("node", "size", "keys").dropDuplicates(["node"]))
    ids = {r["node"]: r["doc_id"] for r in found.collect()}
    return [(ids[r["a"]], ids[r["b"]]) for r in nearcopies.links(df, classes, **limits).collect()], classes


@pytest.mark.parametrize("limits", [{}, {"block_rows": 7}, {"block": 700}])
def test_links_do_not_depend_on_the_blocks(spark, limits):
    texts, base = {}, plain.prose(5, 120)
    for k in range(60):  # two changed words from the base, up to four between copies: links here and there
        texts[k] = changed(k, base, 2)
    texts |= {100 + k: changed(500 + k, plain.prose(6, 90), 1) for k in range(20)}
    found, _ = links_of(spark, texts, **limits)
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in found:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {d for d in texts if find(d) == d} == survivors(texts)
    assert all(5 * len(grams(texts[a]) & grams(texts[b])) >= 4 * len(grams(texts[a]) | grams(texts[b])) for a, b in found)


def test_two_thousand_members_below_the_threshold(spark):
    base = plain.prose(8, 150)
    texts = {k: changed(k, base, 2) for k in range(2000)}  # about 0.76 among each other
    found, classes = links_of(spark, texts)
    every = classes.selectExpr("node", "explode(keys) as key")
    hubs = every.groupBy("key").agg({"node": "min"}).withColumnRenamed("min(node)", "hub")
    met = every.join(hubs, "key").select("hub", "node").distinct().count()
    assert len(found) < met < nearcopies.BANDS * len(texts)  # links span components: what leaves a task is no more than what enters it
    few = dict(list(texts.items())[:300])
    got, _ = links_of(spark, few)
    touched = {x for pair in got for x in pair}
    sets = {d: grams(t) for d, t in few.items()}
    linked = {d for d in few for e in few if d != e and 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e])}
    assert touched == linked


def test_spans_equals_all_pairs():
    rng = np.random.default_rng(3)
    base = np.arange(100, dtype=np.uint64)
    found = [np.unique(np.where(rng.random(100) < 0.08, rng.integers(1000, 9999, 100).astype(np.uint64), base)) for _ in range(50)]
    label = np.arange(50)
    near = {(i, j) for i in range(50) for j in range(50) if i != j and 5 * len(np.intersect1d(found[i], found[j])) >= 4 * len(np.union1d(found[i], found[j]))}

    def parts(links):
        root = list(range(50))
        for a, b in links:
            root = [root[a] if r == root[b] else r for r in root]
        return {frozenset(i for i in range(50) if root[i] == r) for r in root}
    left = rng.random(50) < 0.4
    assert parts(nearcopies.spans(found, label)) == parts(near) and set(nearcopies.spans(found, label)) <= near
    assert parts(nearcopies.spans(found, label, left)) == parts({(i, j) for i, j in near if left[i] != left[j]})


def test_near_dedup_of_awkward_rows(spark):
    long = plain.prose(31, 30000)
    rows = [(None, "a null id is last", "x"), (5, "a null id is last", "x"), (7, " ".join(long), "y"), (9, changed(1, long, 40), "y"), (9, changed(1, long, 40), "y"),
            (11, None, None), (12, "", None), (None, "only here", "z"), (20, "one of a kind", "x"), (20, "one of a kind", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").selectExpr("*", "node as root", "1 as size", "'k' as keys", "2 as row_")
    got = nearcopies.drop_near_copies(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["node"]) for r in got.collect()) == [
        (False, 5, "x"), (False, 7, "y"), (False, 11, None), (False, 20, "x"), (True, 0, "z")]
    assert nearcopies.drop_near_copies(df.limit(0)).count() == 0


def test_fingerprints_bring_near_copies_together(spark):
    """Texts with one of 400 words changed: fingerprints within three bits share a key that no band gave them; wordless texts get none."""
    base = plain.prose(31, 400)
    texts = {0: " ".join(base), **{k: changed(k, base, 1) for k in range(1, 9)}, 20: "", 21: None, 22: " ".join(plain.prose(77, 300))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = cut_lineage(nearcopies.signatures(df).withColumnRenamed("doc_id", "first"))
    prints = {r["first"]: r["print"] for r in found.collect()}
    near = {k for k in range(1, 9) if bin((prints[0] ^ prints[k]) & (2**64 - 1)).count("1") <= 3}
    bands = {r["first"]: set(r["keys"]) for r in found.collect()}
    keys = {r["first"]: set(r["keys"]) - bands[r["first"]] for r in nearcopies.with_fingerprint_key(found.dropDuplicates(["node"])).collect()}
    assert near and all(keys[k] == keys[0] and len(keys[k]) == 1 for k in near) and keys[22] != keys[0]
    assert not keys.get(20) and not keys.get(21) and prints[20] is None and prints[21] is None
    assert nearcopies.drop_near_copies(df).count() == len(survivors(texts))


def test_rows_made_inside_tasks_are_not_broadcast(spark):
    """Keys of fingerprints and rows of blocks outnumber what Spark's size estimates see; the joins of small estimates must not broadcast them."""
    prints = spark.range(300).selectExpr("xxhash64(id) as fingerprint").unionByName(spark.range(30).selectExpr("xxhash64(id) ^ 5 as fingerprint")).distinct()
    pairs = simhash.links(prints)
    rows = spark.range(4).selectExpr("0L as hub", "id as node", "id as root", "0L as block", "explode(sequence(0L, 40L)) as x").selectExpr("hub", "x", "x as y", "node", "root", "block")
    met = nearcopies._met(rows, spark.range(4).selectExpr("id as node", "unhex(repeat('0100000000000000', 2)) as set"))
    assert len({tuple(sorted(r)) for r in pairs.collect()}) == 30 and {tuple(r) for r in met.collect()} == {(0, 1), (0, 2), (0, 3)}
    for got in (pairs, met):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
