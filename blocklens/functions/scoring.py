"""Confidence signals as column expressions (CNF-1..6, BYT-8, CRV-5)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: composite weights
WEIGHTS = {
    "header_footer": 0.20,
    "structural": 0.25,
    "metadata": 0.20,
    "entropy": 0.15,
    "fragmentation": 0.15,
    "overwrite": 0.05,
}
SIGNALS = list(WEIGHTS)

# fixed values: shortest useful partial, in bytes
MIN_PARTIAL = {"png": 33, "jpeg": 16, "pdf": 32, "sqlite": 100, "mp4": 24, "zip": 30, "ole2": 512}
MIN_PARTIAL_OTHER = 16

# fixed values: structural score of a truncated object
EOF_STRUCTURE = {"png": 0.65, "jpeg": 0.60, "pdf": 0.60, "sqlite": 0.70, "mp4": 0.55, "zip": 0.55}

# fixed values: entropy band families
COMPRESSED = ["jpeg", "jpg", "png", "zip", "docx", "xlsx", "pptx"]
DATABASE = ["sqlite", "db"]
OLE_FAMILY = ["ole2", "doc", "xls", "ppt", "msole"]


def lookup(values: Mapping[str, float], key: Column, default: Column) -> Column:
    """Small constant dimension as a CASE, so no join is planned."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def entropy_consistency(entropy: Column, file_type: Column, empty: Column) -> Column:
    """BYT-8 bands."""
    t = F.lower(file_type)
    return (F.when(empty, 0.0)
            .when(t.isin(COMPRESSED), F.when(entropy >= 7.2, 1.0).when(entropy >= 6.0, 0.7)
                  .when(entropy >= 4.5, 0.4).otherwise(0.1))
            .when(t == "pdf", F.when(entropy.between(4.5, 7.9), 1.0).when(entropy > 3.0, 0.7).otherwise(0.2))
            .when(t.isin(DATABASE), F.when(entropy.between(3.0, 6.8), 1.0).when(entropy > 2.0, 0.7).otherwise(0.3))
            .when(t.isin(OLE_FAMILY), F.when(entropy.between(1.0, 6.0), 1.0).when(entropy <= 7.0, 0.6).otherwise(0.2))
            .otherwise(F.when(entropy > 3.0, 0.8).otherwise(0.4)))


def _be16(payload: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(payload, at + 1, 2)), 16, 10).cast("bigint")


def latin(payload: Column) -> Column:
    """One character per byte, so string positions are byte positions."""
    return F.decode(payload, "ISO-8859-1")


def last_position(haystack: Column, needle: Column) -> Column:
    """0-based position of the last occurrence in a one-char-per-byte string, null if absent."""
    found = F.call_function("locate", F.reverse(needle), F.reverse(haystack))
    return F.when(found > 0, F.length(haystack) - found + 1 - F.length(needle))


def header_footer_score(payload: Column, file_type: Column, footer: Column, is_eof: Column) -> Column:
    """CNF-1: ``footer`` is the binary terminator, null for formats without one."""
    text, mark = latin(payload), latin(footer)
    slack = F.length(text) - last_position(text, mark) - F.length(mark)
    with_footer = (F.when(is_eof, 0.50)
                   .when(F.endswith(text, mark), 1.0)
                   .when(slack.isNotNull(), clamp(1.0 - slack / 512.0 * 0.15, 0.80, 0.99))
                   .otherwise(0.60))
    n = F.octet_length(payload)
    raw_page = _be16(payload, 16)
    page = F.when(raw_page == 1, 65536).otherwise(raw_page)
    good_page = page.between(512, 65536) & (page.bitwiseAND(page - 1) == 0)
    shift = F.hex(F.substring(payload, 31, 2))
    footerless = (F.when(file_type == "sqlite", F.when(n < 100, 0.50).when(good_page, 1.0).otherwise(0.70))
                  .when(file_type == "mp4", F.when((n >= 12) & (F.substring(payload, 5, 4) == F.lit(b"ftyp")), 1.0)
                        .otherwise(0.60))
                  .when(file_type == "ole2", F.when(n < 512, 0.50).when(shift.isin("0900", "0C00"), 1.0)
                        .otherwise(0.75))
                  .otherwise(1.0))
    return F.when(footer.isNotNull(), with_footer).otherwise(footerless)


def structural_score(verdict: Column, file_type: Column, partial_length: Column, payload_length: Column) -> Column:
    """CNF-2."""
    ratio = clamp(partial_length / F.greatest(payload_length, F.lit(1)), 0.0, 1.0)
    other = clamp(0.5 + 0.2 * ratio, 0.5, 0.7)
    return (F.when(verdict == "OK", 1.0).when(verdict == "ERR", 0.0)
            .otherwise(lookup(EOF_STRUCTURE, file_type, other)))


def metadata_score(confidence: Column) -> Column:
    """CNF-3."""
    return lookup({"Confirmed": 1.0, "Partial": 0.6, "Reconstructed": 0.4, "Low": 0.1}, confidence, F.lit(0.0))


def fragmentation_score(kind: Column, gap: Column, radius: Column | int) -> Column:
    """CNF-4: contiguous, partial or reassembled."""
    reach = F.least(gap / F.lit(radius) if isinstance(radius, int) else gap / radius, F.lit(1.0))
    return (F.when(kind == "partial", 0.80)
            .when(kind == "reassembled", clamp(1.0 - reach * 0.5, 0.1, 1.0)).otherwise(1.0))


def overwrite_score(tier: Column, confidence: Column) -> Column:
    """CNF-5."""
    return F.when((tier == 1) & ~confidence.eqNullSafe(F.lit("Confirmed")), 0.6).otherwise(1.0)


def composite(signals: Mapping[str, Column] | None = None, weights: Mapping[str, float] = WEIGHTS) -> Column:
    """CNF-6: weighted sum of the six signals, clamped; columns are named as the signals by default."""
    cols = signals or {s: F.col(s) for s in SIGNALS}
    total = None
    for s in SIGNALS:
        term = F.lit(weights[s]) * cols[s]
        total = term if total is None else total + term
    return clamp(total, 0.0, 1.0)


def useful_partial(file_type: Column, partial_length: Column) -> Column:
    """CRV-5 predicate."""
    return partial_length >= lookup(MIN_PARTIAL, file_type, F.lit(MIN_PARTIAL_OTHER))
