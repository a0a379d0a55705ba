"""Verdicts from the mark index against the same checks over one window, and objects larger than any window."""

import hashlib
import random
import struct
import zlib

import golden
import pytest
from pyspark.sql import functions as F

from blocklens.functions import marks, packs
from blocklens.operators import carve, longobjects
from blocklens.sources import signatures

KEYS = ["image_id"]


def noise(seed, n):
    return random.Random(seed).randbytes(n)


def png(seed, parts, size=700):
    return golden.PNG_MAGIC + golden.IHDR + b"".join(golden.chunk(b"IDAT", noise(seed + k, size + k)) for k in range(parts)) + golden.chunk(b"IEND", b"")


def mp4(seed, parts, odd=b"qqqq"):
    body = b"".join(golden.box(b"moof", noise(seed + k, 40)) + golden.box(odd if k % 5 == 0 else b"mdat", noise(seed - k, 900 + k)) for k in range(parts))
    wide = struct.pack(">I4sQ", 1, b"mdat", 16 + 300) + noise(seed, 300)
    return golden.ftyp(b"isom", b"isom") + body + wide + golden.box(b"moov", b"x" * 50)


def sqlite(pages):
    head = bytearray(golden.sqlite())
    struct.pack_into(">I", head, 28, pages)
    return bytes(head) + noise(3, (pages - 1) * 1024)


def pdf(n):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, noise(k, 900).replace(b"%", b"x")) for k in range(n)) + b"startxref\n9\n%%EOF"


def objects():
    """Block-aligned objects: whole, cut short, damaged; marks fall on every kind of chunk border."""
    good = {"png": png(1, 60), "mp4": mp4(5, 40), "pdf": pdf(40), "zip": golden.archive(body=noise(9, 30000)), "sqlite": sqlite(40)}
    out = []
    for kind, data in good.items():
        out += [(kind, data), (kind, data[:len(data) * 2 // 3])]
    broken = bytearray(good["png"])
    broken[len(broken) // 2] ^= 1
    out.append(("png", bytes(broken)))
    out.append(("zip", good["zip"][:-10] + struct.pack("<I", 1 << 30) + good["zip"][-6:]))
    out.append(("mp4", golden.ftyp(b"isom") + golden.box(b"free", noise(1, 30000))))
    out += [("png", png(50 + k, 20, 480 + k)) for k in range(12)]
    return out


def medium(chunk_blocks):
    at, parts, places = 1, {}, []
    for kind, data in objects():
        parts[at] = data
        places.append((at, kind))
        at += -(-len(data) // 512) + 1
    return golden.place(at + 2, parts), places


@pytest.mark.parametrize("chunk_blocks", [3, 128])
def test_index_agrees_with_one_window(spark, chunk_blocks):
    image, places = medium(chunk_blocks)
    chunks = carve.to_chunks(golden.sectors(spark, image), KEYS, chunk_blocks)
    total = len(image) // 512
    limits = {lba: min(400, total - lba) for lba, _ in places}
    rows = [("img", lba, i, kind, limits[lba]) for i, (lba, kind) in enumerate(places)]
    cands = spark.createDataFrame(rows, "image_id string, lba bigint, sig_order int, validator_id string, limit_blocks bigint")
    got = {r["lba"]: (r["verdict"], r["length"]) for r in longobjects.verdicts(cands, chunks, KEYS).collect()}
    checks = {**packs.PACKS, **packs.LAST_MARKER}
    for lba, kind in places:
        want = checks[kind](image[lba * 512:(lba + limits[lba]) * 512])[:2]
        if want[0] == "ERR" and kind == "png":  # ends at the last confirmed chunk; an error is not adopted by the caller either
            assert got[lba][0] == "EOF", (lba, kind)
        elif want[0] == "ERR":
            assert lba not in got, (lba, kind, got.get(lba))
        elif want[0] == "EOF" and kind == "png":
            assert got[lba][0] == "EOF" and want[1] - 2000 < got[lba][1] <= want[1], (lba, want, got[lba])
        else:
            assert got[lba] == want, (lba, kind)
    assert sum(v[0] == "OK" for v in got.values()) >= 17


def test_holes_end_the_range(spark):
    data = mp4(3, 30)
    sectors = golden.sectors(spark, golden.place(200, {2: data, 120: data}))
    holed = carve.to_chunks(sectors.where("lba NOT BETWEEN 100 AND 101 AND lba <> 130"), KEYS)
    rows = [("img", 2, 0, "mp4", 198), ("img", 120, 1, "mp4", 80), ("img", 100, 2, "mp4", 50), ("img", 2, 3, "pdf", 198)]
    cands = spark.createDataFrame(rows, "image_id string, lba bigint, sig_order int, validator_id string, limit_blocks bigint")
    got = {(r["lba"], r["sig_order"]): (r["verdict"], r["length"]) for r in longobjects.verdicts(cands, holed, KEYS).collect()}
    assert got == {(2, 0): ("OK", len(data))}
    assert longobjects.verdicts(cands.limit(0), holed, KEYS).count() == 0


def test_judged_beyond_the_wide_window(spark):
    image = golden.place(900, {3: png(1, 90), 150: mp4(7, 60), 300: sqlite(90), 520: pdf(60), 700: golden.JPEG[:-2] + noise(4, 40000).replace(b"\xff", b"\x00") + b"\xff\xd9"})
    chunks = carve.to_chunks(golden.sectors(spark, image), KEYS)
    hits = carve.candidates(carve.block_heads(chunks, KEYS), signatures.signature_rows(spark), KEYS).where("lba IN (3, 150, 300, 520, 700)")
    got = {r["lba"]: (r["verdict"], r["length"]) for r in carve.judged(hits, chunks, carve.total_blocks(chunks, KEYS), KEYS, first_window=3, wide_window=8).collect()}
    want = {3: len(png(1, 90)), 150: len(mp4(7, 60)), 300: 90 * 1024, 520: len(pdf(60)), 700: len(golden.JPEG[:-2]) + 40002}
    assert got == {k: ("OK", v) for k, v in want.items()}


OFF, CHUNK = 4096, 65536


def large_medium(spark, mib):
    """A media file of ``mib`` MiB, a part per chunk, built where it is stored, and a page of a database behind it; no part ends where a window does."""
    parts = mib * 16
    first = FIRST[:CHUNK]
    end = bytes(OFF) + golden.box(b"moov", bytes(100))
    rows = spark.range(parts + 1).select(
        F.lit("img").alias("image_id"), F.col("id").alias("chunk_no"), (F.col("id") * 128).alias("start_lba"), F.lit(128).cast("bigint").alias("n"),
        F.when(F.col("id") == 0, F.lit(first)).when(F.col("id") == parts, F.lit(end.ljust(OFF + 512, b"\0") + golden.sqlite().ljust(CHUNK - OFF - 512, b"\0")))
        .otherwise(F.lit(MIDDLE)).alias("payload"))
    return rows, parts * CHUNK + len(end)


_HEAD = golden.ftyp(b"isom")
FIRST = _HEAD + struct.pack(">I4s", CHUNK + OFF - len(_HEAD), b"mdat") + bytes(CHUNK)
MIDDLE = bytes(OFF) + struct.pack(">I4s", CHUNK, b"mdat") + bytes(CHUNK - OFF - 8)


def test_object_of_200_mib_claims_its_blocks(spark):
    chunks, size = large_medium(spark, 200)
    got = {r["start_lba"]: r for r in carve.recover_image(chunks, signatures.signature_rows(spark), KEYS, tiers=(2,), types=["mp4", "sqlite"], max_payload=1 << 20)
           .select("start_lba", "file_type", "recovered_bytes", "limitations", "content_hash", F.octet_length("payload").alias("n"), "extents").collect()}
    assert set(got) == {0, 200 * 16 * 128 + 9}
    row = got[0]
    assert (row["file_type"], row["recovered_bytes"], row["limitations"], row["n"]) == ("mp4", size, None, None)
    assert row["extents"][0]["block_count"] == -(-size // 512)
    h = hashlib.sha256(FIRST[:CHUNK])
    for _ in range(200 * 16 - 1):
        h.update(MIDDLE)
    h.update(bytes(OFF) + golden.box(b"moov", bytes(100)))
    assert row["content_hash"] == h.hexdigest()


def test_checksums_of_ranges_from_pieces():
    import numpy as np
    data, cuts = noise(1, 5000), [0, 512, 1024, 2048, 4096, 5000]
    before = [0]
    for a, b in zip(cuts, cuts[1:]):
        before.append(before[-1] ^ int(marks.piece(np.array([a]), np.array([b]), np.array([zlib.crc32(data[a:b])]))[0]))

    def at(t):
        k = max(i for i in range(len(cuts) - 1) if cuts[i] <= t)
        return np.array([cuts[k]]), np.array([t]), np.array([zlib.crc32(data[cuts[k]:t])]), before[k]
    rng = random.Random(2)
    for _ in range(40):
        s = rng.randrange(4990)
        e = rng.randrange(s, 5000)
        o, t, c, b = at(s)
        left = int(marks.opens(o, t, c)[0]) ^ b
        o, t, c, b = at(e)
        right = [int(marks.closes(o, t, c, np.array([zlib.crc32(data[s:e]) ^ wrong]))[0]) ^ b for wrong in (0, 1)]
        assert left == right[0] != right[1]
