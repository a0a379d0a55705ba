"""Merkle manifest, piecewise fingerprints and filter audit against plain Python."""

import hashlib
import string
import zlib
from collections import Counter
from itertools import permutations

import plain
import pytest
from pyspark.sql import functions as F

from blocklens.llm import interaction, merkle, piecewise


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- Merkle manifest

def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def walk(digests, at):
    """Levels of siblings of the node ``at``, as (place, run), and the root."""
    out = []
    while len(digests) > 1:
        run = digests[at - at % 16:at - at % 16 + 16]
        out.append((at % 16, run))
        digests, at = [sha("".join(digests[i:i + 16])) for i in range(0, len(digests), 16)], at // 16
    return out, digests[0]


def manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0] is None, r[0] or 0, leaf(r), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for v in by_source.values():
        v.sort(key=lambda x: x[:3])
    tops = [walk([x[2] for x in by_source[s]], 0)[1] for s in names]
    for k, s in enumerate(names):
        digests = [x[2] for x in by_source[s]]
        above, root = walk(tops, k)
        for i, (_, _, own, r) in enumerate(by_source[s]):
            path = walk(digests, i)[0] + above
            forged = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf((*r[:4], None if r[4] is None else lower(r[4]))) if forged else own
            for place, run in path:
                now = sha("".join([*run[:place], now, *run[place + 1:]]))
            proof = sha("".join("".join(run[:p] + run[p + 1:]) for p, run in path))
            yield r[0], own, tops[k], root, proof, now, now == root


def manifest_of(df):
    return Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect())


FIVE = "doc_id long, source string, lang string, n_chars long, text string"


def test_manifest_of_awkward_rows(docs, rows, nothing):
    got = merkle.manifest(docs)
    want = Counter(manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows]))
    assert manifest_of(got) == want
    assert {r[-1] for r in want} == {True, False}
    assert merkle.manifest(nothing).count() == 0


def test_manifest_with_superblocks_repeats_and_null_ids(spark):
    rows = [(i * 3 % 9001, "hot", None, i, f"Text {i}") for i in range(9000)] + [(None, "hot", "en", 1, None), (None, None, None, None, None), (5, "hot", "x", 1, "Again"), (5, "hot", "x", 1, "Again")]
    rows += [(i, f"s{i:03d}", "en", i, "A") for i in range(300)] + [(i, "é", None, None, "B") for i in range(17)] + [(1, "", None, None, "C")]
    df = spark.createDataFrame(rows, FIVE).repartition(7)
    # a lone superblock at the end of the hot source, 18 runs of subroots above
    assert manifest_of(merkle.manifest(df)) == Counter(manifest(rows))


def test_manifest_of_one_row(spark):
    rows = [(10, "s", "en", 4, "Text")]
    assert manifest_of(merkle.manifest(spark.createDataFrame(rows, FIVE))) == Counter(manifest(rows))


# --- fingerprints

def plain_fingerprint(text):
    data = text.encode()
    block = 3
    while len(data) > 64 * block:
        block *= 2
    letters = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"

    def rolled(i):
        h = 0
        for k in range(7):
            if i - k >= 0:
                h += (data[i - k] + 1) * pow(0x9E3779B1, k, 2**32)
        h %= 2**32
        h ^= h >> 15
        h = h * 0x85EBCA6B % 2**32
        h ^= h >> 13
        h = h * 0xC2B2AE35 % 2**32
        return h ^ h >> 16

    def sig(b):
        out, start = "", 0
        for i in range(len(data)):
            size = i + 1 - start
            if i + 1 == len(data) or size == 4 * b or size >= max(b // 4, 1) and rolled(i) < 2**32 // b:
                out, start = out + letters[zlib.crc32(data[start:i + 1]) >> 26], i + 1
        return out
    return f"{block}:{sig(block)}:{sig(2 * block)}"


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x):
        new = [i + 1]
        for j, b in enumerate(y):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (a != b)))
        row = new
    return row[-1]


def plain_likeness(f, g):
    if f == g:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = f.split(":"), g.split(":")

    def alike(x, y):
        if x == y:
            return 1.0
        few = min(len(x), len(y))
        if few == 0:
            return 0.0
        run = 3 if few < 16 else 4
        if few >= 3 and not {x[i:i + run] for i in range(len(x) - run + 1)} & {y[i:i + run] for i in range(len(y) - run + 1)}:
            return 0.0
        return 1 - distance(x, y) / max(len(x), len(y))
    if bx == by:
        return max(alike(x1, y1), alike(x2, y2))
    return alike(x1, y2) if int(bx) == 2 * int(by) else alike(x2, y1) if int(by) == 2 * int(bx) else 0.0


def prints(df):
    found = df.select("*", piecewise.likeness("fingerprint", "edited_fingerprint").alias("near_edited"), piecewise.likeness("fingerprint", "next_fingerprint").alias("near_next"))
    return Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found.collect())


def plain_prints(rows):
    """rows: (doc_id, text), ids different or null once."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    own = [plain_fingerprint(t) for _, t in rows]
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(t) // 3
        new = t[:len(t) - n] + after[:n]
        f = plain_fingerprint(new)
        yield d, len(t), sha(new), own[i], f, round(plain_likeness(own[i], f), 9), round(plain_likeness(own[i], own[(i + 1) % len(rows)]), 9)


@pytest.mark.parametrize("shuffles", ["4", "37", "211"])
def test_fingerprints_in_any_number_of_partitions(spark, docs, rows, shuffles):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        got = prints(piecewise.fingerprints(docs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == Counter(plain_prints([(r[0], r[1]) for r in rows]))


def test_fingerprints_of_few_and_repeated_rows(spark, nothing):
    df = spark.createDataFrame([(1, "é" * 9 + "abc")], "doc_id long, text string")
    assert prints(piecewise.fingerprints(df)) == Counter(plain_prints([(1, "é" * 9 + "abc")]))
    assert piecewise.fingerprints(nothing).count() == 0
    twice = " ".join(plain.prose(1, 200))
    df = spark.createDataFrame([(4, twice), (4, twice), (4, twice), (None, twice), (2, None), (3, "")], "doc_id long, text string")
    got = piecewise.fingerprints(df).collect()
    assert len(got) == 6 and len({r["fingerprint"] for r in got if r["n_chars"]}) == 1
    assert sorted(r["n_chars"] for r in got) == [0, 0, *[len(twice)] * 4]


def test_likeness_follows_the_edit(spark):
    docs = [(i, " ".join(plain.prose(i, 150 + 40 * i))) for i in range(60)] + [(100 + i, f"phrase {i} of a kind. " * 200) for i in range(10)]
    found = piecewise.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"))
    near, apart = found.select(F.min(F.when(F.col("doc_id") < 100, piecewise.likeness("fingerprint", "edited_fingerprint"))),
                               F.max(piecewise.likeness("fingerprint", "next_fingerprint"))).first()
    assert near > 0.4 and apart < 0.2


# --- filter audit

def audit(rows, labels):
    """rows: (doc_id, source, text); labels: (doc_id, quality, toxic)."""
    ids = {}
    for d, _, t in rows:
        ids.setdefault(t or "", []).append(d)
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    docs = []
    for d, s, t in rows:
        t = t or ""
        w = plain.words(t)
        failed = set()
        if len(w) < 50:
            failed.add("A")
        if 100 * len(set(w)) < 65 * len(w):
            failed.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            failed.add("C")
        if set(t) & set("#$%&*|"):
            failed.add("D")
        if any(x is not None and (d is None or x < d) for x in ids[t]):
            failed.add("E")
        docs.append((s or "", failed, d in good, d in toxic))
    out, shapley = [], Counter()
    for order in permutations("ABCDE"):
        left, gone = docs, []
        for step, f in enumerate(order, 1):
            removed = [x for x in left if f in x[1]]
            for part in {x[0] for x in docs}:
                mine = [x for x in removed if x[0] == part]
                shapley[part, f] += len(mine)
                out.append([part, "".join(order), step, sum(x[0] == part for x in left) - len(mine), len(mine), sum(x[0] == part and f in x[1] for x in gone),
                            sum(x[0] == part and x[1] == {f} for x in docs), sum(x[2] for x in mine), sum(x[3] for x in mine)])
            gone, left = gone + removed, [x for x in left if f not in x[1]]
    return Counter((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def audit_of(df):
    return Counter(tuple(r[c] for c in ("part", "filter_order", "step", *interaction.COUNTS)) for r in df.collect())


def test_filter_audit(spark, docs, rows, nothing):
    labels = [(r[0], r[0] % 2, int(r[0] % 3 == 0)) for r in rows if r[0] % 5] + [(5, 0, 1), (5, None, 0), (None, 1, 1), (9999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    assert audit_of(interaction.interactions(docs, marks)) == audit([(r[0], r[3], r[1]) for r in rows], labels)
    assert interaction.interactions(nothing, marks).count() == 0
    none = audit_of(interaction.interactions(docs, marks.limit(0)))
    assert sum(n * (r[7] + r[8]) for r, n in none.items()) == 0


def test_filter_audit_of_repeats_and_nulls(spark):
    text = " ".join(plain.prose(3, 60))
    rows = [(7, "a", text), (7, "b", text), (7, "a", text), (3, None, text), (None, "", text), (None, "a", "x"), (None, "a", "x"), (8, "a", None), (9, "b", ""), (10, "b", "X#")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    labels = [(7, 1, 0), (3, 0, 1), (7, 0, 0)]
    got = audit_of(interaction.interactions(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == audit(rows, labels)
    assert len(got) == 3 * 600
