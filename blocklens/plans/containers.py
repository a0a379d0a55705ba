"""Page bodies wrapped in container formats by column expressions: input for the structural checks.

``variant`` 0 is intact, 1 is cut short, 2 is structurally wrong. The SQL twins know the
outcome of each variant from the body length alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.plans.catalog import table

FORMATS = ["png", "jpeg", "pdf", "zip", "sqlite", "mp4", "ole2"]


def hx(text: str) -> Column:
    return F.lit(bytes.fromhex(text))


def be(n: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), width * 2, "0"))


def le(n: Column, width: int) -> Column:
    h = F.lpad(F.hex(n.cast("bigint")), width * 2, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in range(width * 2 - 1, 0, -2)]))


def zeros(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n.cast("int")))


def pick(variant: Column, intact: Column, short: Column, wrong: Column) -> Column:
    return F.when(variant == 0, intact).when(variant == 1, short).otherwise(wrong)


PNG_END = "0000000049454E44AE426082"


def png_head() -> Column:
    ihdr = bytes.fromhex("49484452000000010000000108020000" + "00")
    return F.concat(hx("89504E470D0A1A0A0000000D"), F.lit(ihdr), be(F.crc32(F.lit(ihdr)), 4))


def png(body: Column, variant: Column) -> Column:
    n, typed = F.octet_length(body), F.concat(F.lit(b"tEXt"), body)
    start = F.concat(png_head(), be(n, 4), typed)
    whole = F.concat(start, be(F.crc32(typed), 4))
    return pick(variant, F.concat(whole, hx(PNG_END)), whole, F.concat(start, be(F.crc32(typed) + 1, 4).substr(-4, 4), hx(PNG_END)))


def jpeg(body: Column, variant: Column) -> Column:
    rest = F.concat(hx("FFC0000B080010001001011100FFDA000601010000"), body)
    return pick(variant, F.concat(hx("FFD8"), rest, hx("FFD9")), F.concat(hx("FFD8"), rest), F.concat(hx("FFD8AA"), rest, hx("FFD9")))


def pdf(body: Column, variant: Column) -> Column:
    mid = F.concat(F.lit(b"1.4\n1 0 obj\n"), body, F.lit(b"\nendobj\nstartxref\n9\n"))
    return pick(variant, F.concat(F.lit(b"%PDF-"), mid, F.lit(b"%%EOF")), F.concat(F.lit(b"%PDF-"), mid), F.concat(F.lit(b"%PDX-"), mid))


def archive(body: Column, variant: Column) -> Column:
    n = le(F.octet_length(body), 4)
    head = F.concat(hx("504B0304140000000000000000" + "00000000" + "00"), n, n, hx("08000000"), F.lit(b"page.htm"))
    local = F.concat(head, body)
    central = F.concat(hx("504B01021400140000000000000000" + "000000" + "0000"), n, n, hx("0800" + "00" * 16), F.lit(b"page.htm"))
    size, at = le(F.octet_length(central), 4), le(F.octet_length(local), 4)
    end = lambda where: F.concat(hx("504B05060000000001000100"), size, where, hx("0000"))
    both = F.concat(local, central)
    # the wrong one has its end record in the first block, pointing past itself
    return pick(variant, F.concat(both, end(at)), both, F.concat(head, end(hx("FFFFFF0F")), body))


def sqlite(body: Column, variant: Column) -> Column:
    pages = F.ceil((F.octet_length(body) + 108) / 4096)
    head = lambda count, kind: F.concat(
        F.lit(b"SQLite format 3\x00"), hx("1000" + "00" * 10), be(count, 4), hx("00" * 68 + kind + "00000000" + "1000" + "00"))
    whole = lambda count, kind: F.concat(
        head(count, kind), body, zeros(pages * 4096 - 108 - F.octet_length(body)))
    return pick(variant, whole(pages, "0D"), whole(pages + 16, "0D"), whole(pages, "FF"))


def mp4(body: Column, variant: Column) -> Column:
    head = F.concat(hx("00000018"), F.lit(b"ftypisom"), hx("00000200"), F.lit(b"isommp42"))
    n = F.octet_length(body)
    data = lambda extra: F.concat(be(n + 8 + extra, 4), F.lit(b"mdat"), body)
    moov = F.concat(hx("0000000C"), F.lit(b"moov"), hx("01020304"))
    return pick(variant, F.concat(head, data(0), moov), F.concat(head, data(1000000)),
                F.concat(hx("00000004"), F.lit(b"ftypisom"), data(0), moov))


def ole2(body: Column, variant: Column) -> Column:
    """Allocation sectors first, then one directory sector, then the stream."""
    n = F.octet_length(body)
    k = F.greatest(F.ceil(n / 512), F.lit(8))
    fats = F.ceil((k + 1) / 127)
    last = fats + k
    le_hex = lambda v: F.hex(le(v, 4))
    mark = lambda i: F.when(i < fats, "FDFFFFFF").when((i == fats) | (i == last), "FEFFFFFF").when(
        i < last, le_hex(i + 1)).otherwise("FFFFFFFF")
    fat = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), fats * 128 - 1), mark), ""))
    difat = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(108).cast("bigint")),
                                             lambda i: F.when(i < fats, le_hex(i)).otherwise("FFFFFFFF")), ""))
    head = lambda order: F.concat(
        hx("D0CF11E0A1B11AE1" + "00" * 16 + "3E000300" + order + "09000600" + "00" * 6 + "00000000"), le(fats, 4), le(fats, 4),
        hx("00000000" + "00100000" + "FEFFFFFF" + "00000000" + "FEFFFFFF" + "00000000"), difat)
    entry = lambda name, kind, child, start, size: F.concat(
        hx(name.encode("utf-16le").hex().ljust(128, "0") + (len(name) * 2 + 2).to_bytes(2, "little").hex() + kind + "01"
           + "FFFFFFFF" * 2 + child + "00" * 36), start, le(size, 8))
    stream = k * 512
    directory = F.concat(entry("Root Entry", "05", "01000000", hx("FEFFFFFF"), F.lit(0)),
                         entry("Body", "02", "FFFFFFFF", le(fats + 1, 4), stream), zeros(F.lit(256)))
    rest = F.concat(fat, directory, body, zeros(stream - n))
    whole = F.concat(head("FEFF"), rest)
    return pick(variant, whole, F.substring(whole, F.lit(1), (F.octet_length(whole) - 512)), F.concat(head("FFFE"), rest))


WRAP = {"png": png, "jpeg": jpeg, "pdf": pdf, "zip": archive, "sqlite": sqlite, "mp4": mp4, "ole2": ole2}


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("body"))


def wrapped(spark: SparkSession, sf: str, fmt: str) -> DataFrame:
    """Every page in one format, variants by page id."""
    return bodies(spark, sf).select("page_id", F.lit(fmt).alias("validator_id"), F.lit(fmt).alias("file_type"),
                                    WRAP[fmt](F.col("body"), F.col("page_id") % 3).alias("payload"))


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Every page in the format of its id, one medium per page."""
    b = bodies(spark, sf).withColumn("variant", F.floor(F.col("page_id") / 7) % 3)
    out = None
    for i, f in enumerate(FORMATS):
        part = WRAP[f](F.col("body"), F.col("variant"))
        out = F.when(F.col("page_id") % 7 == i, part) if out is None else out.when(F.col("page_id") % 7 == i, part)
    return b.select(F.col("page_id").alias("image_id"), "variant", out.alias("payload"))


def media_of(objects: DataFrame, lead: int = 3, tail: int = 2, chunk_blocks: int = 128) -> DataFrame:
    """Chunk table of one medium per object: zero blocks, the object, zero blocks."""
    used = F.ceil(F.octet_length("payload") / 512)
    whole = objects.withColumn("_n", used + lead + tail).withColumn("_img", F.concat(
        zeros(F.lit(lead * 512)), F.col("payload"), zeros((used + tail) * 512 - F.octet_length("payload"))))
    return (whole.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / chunk_blocks))))
            .withColumn("start_lba", F.col("chunk_no") * chunk_blocks)
            .withColumn("n", F.least(F.lit(chunk_blocks), F.col("_n") - F.col("start_lba")).cast("bigint"))
            .select("image_id", "chunk_no", "start_lba", "n", F.substring(
                F.col("_img"), (F.col("start_lba") * 512 + 1).cast("int"), (F.col("n") * 512).cast("int")).alias("payload")))


# outcome per format and variant as SQL over the body length n: verdict, length
K_SQL = "greatest(CAST(ceil(n/512.0) AS BIGINT), 8)"
OLE_SQL = f"(({K_SQL}) + CAST(ceil((({K_SQL})+1)/127.0) AS BIGINT) + 2) * 512"
PAGES_SQL = "CAST(ceil((n+108)/4096.0) AS BIGINT)*4096"
OUTCOME = {  # format: (length when intact, length when cut short)
    "png": ("n+57", "n+45"), "jpeg": ("n+25", "n+23"), "pdf": ("n+42", "n+37"), "zip": ("n+114", "n+92"),
    "sqlite": (PAGES_SQL, PAGES_SQL), "mp4": ("n+44", "24"), "ole2": (OLE_SQL, f"{OLE_SQL} - 512")}
