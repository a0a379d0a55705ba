"""Filters and projections over artifacts, entries, inventories and boot sectors (FLT-*, PRJ-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.operators import byte_stats

# fixed values: OS shadow-copy store GUID
SHADOW_STORE_GUID = "{3808876b-c176-4e48-b7ae-04046e6cc752}"

# fixed values: bridge hardware by USB vendor id, product id
WRITE_BLOCKERS = [
    (0x0ECF, 0x0001, "Tableau / OpenText", "T8 Forensic USB Bridge"),
    (0x0ECF, 0x0002, "Tableau / OpenText", "T35u USB 3.0 SATA/IDE Bridge"),
    (0x0ECF, 0x0003, "Tableau / OpenText", "T8u USB 3.0 Forensic Bridge"),
    (0x0ECF, 0x0004, "Tableau / OpenText", "T7u PCIe Forensic Bridge"),
    (0x0ECF, 0x0005, "Tableau / OpenText", "T9 FireWire/USB Bridge"),
    (0x0ECF, 0x0008, "Tableau / OpenText", "T6u SAS Forensic Bridge"),
    (0x0ECF, 0x0009, "Tableau / OpenText", "T35689iu Forensic Combo Bridge"),
    (0x04E6, 0x0001, "CRU / WiebeTech", "UltraDock Forensic Bridge"),
    (0x04E6, 0x0002, "CRU / WiebeTech", "DriveLock USB Write-Blocker"),
    (0x04E6, 0x0003, "CRU / WiebeTech", "DittoBeam Forensic Device"),
    (0x14BC, 0x0001, "CRU / WiebeTech", "ToughTech Forensic Bridge"),
    (0x05E3, 0x0735, "Coolgear", "USB 3.0 Forensic SATA Write Blocker"),
    (0x174C, 0x55AA, "ASMedia / Coolgear", "Hardware Write-Blocked Enclosure"),
]
# fixed values: words in the vendor or model text that mark a write blocker
BLOCKER_WORDS = ["TABLEAU", "WIEBETECH", "FASTBLOC", "WRITEBLOCK", "WRITE-BLOCK", "CRU DITTO"]

SOLID_STATE = ["SataSsd", "Nvme", "Sed", "Usb", "SdCard"]


def filter_target_types(df: DataFrame, types: Sequence[str] | None) -> DataFrame:
    """FLT-1: case-insensitive type list; None keeps everything."""
    return df if types is None else df.where(F.lower("file_type").isin([t.lower() for t in types]))


def filter_deleted(entries: DataFrame, only_deleted: bool = True) -> DataFrame:
    """FLT-2."""
    return entries.where(F.col("deleted")) if only_deleted else entries


def filter_tier(artifacts: DataFrame, tier: int | None = None) -> DataFrame:
    """FLT-3: None is all tiers."""
    return artifacts if tier is None else artifacts.where(F.col("tier") == tier)


def skip_system_records(entries: DataFrame) -> DataFrame:
    """FLT-4."""
    return entries.where(~((F.col("record_num") < 16) & F.col("name").startswith("$")))


CHECKPOINT_SCHEMA = ("op_id string, case_id string, evidence_id string, source_fingerprint string, "
                     "output_path string, start_lba bigint, current_lba bigint, end_lba bigint, "
                     "total_blocks bigint, bytes_written bigint, started_at string, last_updated_at string")


def with_checkpoint(operations: DataFrame, json_col: str = "parameters_json") -> DataFrame:
    """Decode the progress JSON; unparsable text or a missing position gives a null struct."""
    parsed = F.from_json(json_col, CHECKPOINT_SCHEMA)
    return operations.withColumn("checkpoint", F.when(
        parsed["current_lba"].isNotNull() & parsed["total_blocks"].isNotNull(), parsed))


def resumable_ops(operations: DataFrame) -> DataFrame:
    """FLT-5."""
    wanted = (F.col("op_type") == "Acquire") & F.col("status").isin("Paused", "Running", "Failed")
    return with_checkpoint(operations.where(wanted)).where("checkpoint IS NOT NULL")


def zero_block_filter(sectors: DataFrame, payload: str = "payload") -> DataFrame:
    """FLT-6."""
    return sectors.where(byte_stats.is_zero(payload))


def uniform_block_filter(sectors: DataFrame, payload: str = "payload") -> DataFrame:
    """FLT-7."""
    return sectors.where(byte_stats.is_uniform(payload))


def is_shadow_store(name: Column) -> Column:
    low = F.lower(name)
    return name.contains(SHADOW_STORE_GUID) | low.contains("vss_") | low.contains("syscache.hve")


def vss_summary(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FLT-8: distinct snapshot stores per volume.

    Distinct names first (a hot volume is spread over its names), then one count per key.
    """
    stores = entries.where(is_shadow_store(F.col("name"))).select(*keys, "name").distinct()
    return stores.groupBy(*keys).agg(F.count(F.lit(1)).alias("stores"), F.min("name").alias("first_store"))


def media_class(inventory: DataFrame) -> DataFrame:
    """FLT-9."""
    return (inventory.withColumn("is_solid_state", F.col("media_type").isin(SOLID_STATE))
            .withColumn("is_image", F.col("media_type") == "ForensicImage"))


def file_type_from_name(name: str | Column = "name") -> Column:
    """PRJ-1: extension in lower case; a name without a dot is its own type."""
    n = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.lower(F.element_at(F.split(n, r"\.", -1), -1)), F.lit("unknown"))


def _percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100.0)


def format_provenance(artifacts: DataFrame) -> DataFrame:
    """PRJ-2: readable multi-line record per artifact in column ``provenance``."""
    a = F.col
    where = F.array_join(F.transform("extents", lambda e: F.format_string(
        "LBA %d -> %d", e["start_lba"], e["start_lba"] + e["block_count"])), ", ")
    frag = F.when(F.size("extents") > 1, F.format_string(
        "Fragmentation: 2 fragments (gap size: %d sectors | LBA %d..%d + LBA %d..%d)", a("gap"),
        a("extents")[0]["start_lba"], a("extents")[0]["start_lba"] + a("extents")[0]["block_count"],
        a("extents")[1]["start_lba"], a("extents")[1]["start_lba"] + a("extents")[1]["block_count"]))
    method = (F.when(a("tier") == 1, "Tier 1 (metadata)").when(a("tier") == 2, "Tier 2 (signature)")
              .otherwise("Tier 3 (fragmented)"))
    lines = F.array_compact(F.array(
        F.format_string("Recovered File #R-%d", a("artifact_id")),
        F.concat(F.lit("Recovery method: "), method),
        F.concat(F.lit("Source: "), where),
        F.when(a("original_path").isNotNull(), F.concat(F.lit("Original path: "), a("original_path"))),
        F.concat(F.lit("Confidence: "), _percent(a("confidence_score")), F.lit(" (Structural: "),
                 _percent(a("structural")), F.lit(", Meta: "), _percent(a("metadata")), F.lit(", Entropy: "),
                 _percent(a("entropy")), F.lit(")")),
        frag,
        F.concat(F.lit("Recovered bytes: "), a("recovered_bytes").cast("string"), F.lit(" / "),
                 F.coalesce(a("expected_bytes").cast("string"), F.lit("Unknown"))),
        F.concat(F.lit("SHA-256: "), a("content_hash")),
        F.concat(F.lit("Recovery limitations: "),
                 F.coalesce("limitations", F.lit("None (Complete & verified payload)")))))
    return artifacts.withColumn("provenance", F.concat(F.array_join(lines, "\n"), F.lit("\n")))


def _le(value: Column, width: int) -> Column:
    """Little-endian bytes of a non-negative integer."""
    h = F.lpad(F.hex(value.cast("bigint")), width * 2, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in range(width * 2 - 1, 0, -2)]))


def _sized_text(value: Column) -> list[Column]:
    data = F.encode(F.upper(F.trim(value)), "UTF-8")
    return [_le(F.octet_length(data), 4), data]


def device_fingerprint(inventory: DataFrame) -> DataFrame:
    """PRJ-3: SHA-256 over sized serial, sized model, capacity and sized boundary sample."""
    sample = F.coalesce("boundary_sample", F.lit(b""))
    data = F.concat(*_sized_text(F.col("serial")), *_sized_text(F.col("model")),
                    _le(F.col("capacity_bytes"), 8), _le(F.octet_length(sample), 4), sample)
    return inventory.withColumn("fingerprint", F.sha2(data, 256))


def _byte(p: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(p, at + 1, 1)), 16, 10).cast("int")


def _le_int(p: Column, at: int, width: int) -> Column:
    total = None
    for i in range(width):
        term = _byte(p, at + i).cast("bigint") * F.lit(1 << (8 * i))
        total = term if total is None else total + term
    return total


def _boot_facts(sectors: DataFrame, keys: Sequence[str], facts: dict[str, tuple[int, Column]]) -> DataFrame:
    """One row per image: numbers and flags read from a few blocks where those lie, ``name -> (lba, fact)``.

    Facts have a fixed width, so images meet in a hash aggregation and no block is sorted or moved. Null where the block is absent;
    of several rows for one block the greatest fact counts.
    """
    few = sectors.where(F.col("lba").isin([lba for lba, _ in facts.values()]))
    read = few.select(*keys, *[F.when(F.col("lba") == lba, fact).alias(name) for name, (lba, fact) in facts.items()])
    return read.groupBy(*keys).agg(*[F.max(name).alias(name) for name in facts])


def _first_of(cases: Sequence[tuple[Column, int]], otherwise: int) -> Column:
    out = None
    for test, code in cases:
        out = F.when(test, code) if out is None else out.when(test, code)
    return out.otherwise(otherwise)


def _named(code: Column, names: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), code + 1)


TABLE_KINDS = ["Raw / Unknown", "Raw / Unpartitioned", "GPT (Protective MBR detected)", "MBR (Master Boot Record)"]


def partition_table_kind(sectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PRJ-4."""
    p = F.col("payload")
    protective = None
    for at in (446, 462, 478, 494):
        hit = _byte(p, at + 4) == 0xEE
        protective = hit if protective is None else protective | hit
    code = F.when(p.isNotNull(), _first_of([(F.octet_length(p) < 512, 0), (F.hex(F.substring(p, 511, 2)) != "55AA", 1), (protective, 2)], 3))
    b = _boot_facts(sectors, keys, {"_code": (0, code), "_efi": (1, F.substring(p, 1, 8) == F.lit(b"EFI PART"))}).where("_code IS NOT NULL")
    kind = F.when((F.col("_code") == 2) & F.col("_efi"), "GPT (GUID Partition Table)").otherwise(_named(F.col("_code"), TABLE_KINDS))
    return b.select(*keys, kind.alias("partition_table"))


FILESYSTEMS = ["NTFS", "exFAT", "APFS", "Unknown", "FAT32", "FAT16", "FAT12"]


def detect_filesystem(sectors: DataFrame, keys: Sequence[str], offset: int = 0) -> DataFrame:
    """PRJ-5: ordered byte tests on the boot block and the block two after it."""
    p = F.col("payload")
    oem = F.substring(p, 4, 8)
    bps, spc, reserved, fats = _le_int(p, 11, 2), _byte(p, 13), _le_int(p, 14, 2), _byte(p, 16)
    sane = (F.hex(F.substring(p, 511, 2)).eqNullSafe("55AA") & _byte(p, 0).isin(0xEB, 0xE9)
            & bps.isin(512, 1024, 2048, 4096) & spc.isin(1, 2, 4, 8, 16, 32, 64, 128)
            & (reserved > 0) & fats.isin(1, 2))
    small_total, small_fat = _le_int(p, 19, 2), _le_int(p, 22, 2)
    total = F.when(small_total != 0, small_total).otherwise(_le_int(p, 32, 4))
    fat = F.when(small_fat != 0, small_fat).otherwise(_le_int(p, 36, 4))
    root = F.floor((_le_int(p, 17, 2) * 32 + bps - 1) / bps)
    clusters = F.floor(F.greatest(total - (reserved + fats * fat + root), F.lit(0)) / spc)
    at = {name: i for i, name in enumerate(FILESYSTEMS)}
    code = F.when(p.isNotNull(), _first_of([
        (oem == F.lit(b"NTFS    "), at["NTFS"]), (oem == F.lit(b"EXFAT   "), at["exFAT"]), (F.substring(p, 33, 4) == F.lit(b"NXSB"), at["APFS"]),
        (~F.coalesce(sane, F.lit(False)), at["Unknown"]), (F.substring(p, 83, 8) == F.lit(b"FAT32   "), at["FAT32"]),
        (F.substring(p, 55, 8) == F.lit(b"FAT16   "), at["FAT16"]), (F.substring(p, 55, 8) == F.lit(b"FAT12   "), at["FAT12"]),
        ((small_fat == 0) | (clusters >= 65525), at["FAT32"]), (clusters >= 4085, at["FAT16"]), (clusters > 0, at["FAT12"])], at["Unknown"]))
    b = _boot_facts(sectors, keys, {"_code": (offset, code), "_ext": (offset + 2, F.hex(F.substring(p, 57, 2)) == "53EF")}).where("_code IS NOT NULL")
    # the superblock is asked after the first two names
    kind = F.when((F.col("_code") > at["exFAT"]) & F.col("_ext"), "ext4").otherwise(_named(F.col("_code"), FILESYSTEMS))
    return b.select(*keys, kind.alias("filesystem"))


def write_blocker_flag(inventory: DataFrame) -> DataFrame:
    """PRJ-6: known bridge id, else keyword in vendor or model, else OS read-only."""
    code = F.col("vid").cast("bigint") * 65536 + F.col("pid")
    by_id = None
    for vid, pid, vendor, model in WRITE_BLOCKERS:
        hit = code == vid * 65536 + pid
        named = F.lit(f"{vendor}: {model}")
        by_id = F.when(hit, named) if by_id is None else by_id.when(hit, named)
    text = F.upper(F.concat_ws(" ", F.coalesce("vendor", F.lit("")), F.coalesce("model", F.lit(""))))
    word = F.lit(False)
    for w in BLOCKER_WORDS:
        word = word | text.contains(w)
    method = (F.when(by_id.isNotNull(), "KnownVidPid").when(word, "KnownVidPid")
              .when(F.col("os_read_only"), "OsQuery"))
    return (inventory.withColumn("detection_method", method)
            .withColumn("blocker", F.when(by_id.isNotNull(), by_id).when(
                word, F.concat_ws(": ", F.trim("vendor"), F.trim("model"))))
            .withColumn("hardware_blocked", by_id.isNotNull() | word)
            .withColumn("write_blocked", F.col("detection_method").isNotNull()))
