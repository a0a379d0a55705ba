"""Ordered classification rules as column expressions (SAN-2, SAN-5..7, HLT-1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEALTH_ORDER = ["Unknown", "Good", "Warning", "Critical"]


def health_status(prefix: str = "") -> Column:
    """HLT-1: reads ``kind`` (nvme / hdd / other) and the counters of that kind."""
    c = lambda n: F.col(prefix + n)
    nvme = (F.when((c("critical_warnings") != 0) | (c("spare_percent") < 10) | (c("media_errors") > 10), "Critical")
            .when((c("spare_percent") < 20) | (c("percentage_used") >= 95) | (c("media_errors") > 0)
                  | (c("temperature") >= 70), "Warning").otherwise("Good"))
    hdd = (F.when((c("uncorrectable") > 0) | (c("pending") > 5) | (c("reallocated") > 50), "Critical")
           .when((c("pending") > 0) | (c("reallocated") > 0) | (c("temperature") >= 55), "Warning").otherwise("Good"))
    return F.when(c("kind") == "nvme", nvme).when(c("kind") == "hdd", hdd).otherwise("Unknown")


def health_rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in HEALTH_ORDER]), status).cast("int") - 1


def health_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in HEALTH_ORDER]), rank + 1)


def health_advice(status: Column) -> Column:
    return (F.when(status == "Critical", "Image the device now behind a write blocker; stop other reads.")
            .when(status == "Warning", "Wear or errors present; image soon and keep reads low.")
            .when(status == "Good", "Indicators are nominal.").otherwise("No usable diagnostics for this interface."))


def required_sample_size(total: Column, confidence: float, defect_rate: float) -> Column:
    """SAN-2: ``ceil((1-(1-c)^(1/max(N p,1))) N)`` within 10..50000 and at most N."""
    n = total.cast("double")
    share = 1.0 - F.pow(F.lit(1.0 - confidence), 1.0 / F.greatest(n * defect_rate, F.lit(1.0)))
    raw = F.ceil(share * n)
    bounded = F.least(F.greatest(raw, F.lit(10)), total, F.lit(50_000))
    return F.when(total == 0, 0).otherwise(bounded).cast("bigint")


FLASH = ["Nvme", "SataSsd", "Usb", "SdCard"]
HOST_OVERWRITE = ["HostOverwriteSinglePass", "HostOverwriteMultiPass"]


def overall_assurance(l1: Column, l2: Column, l3: Column, l4: Column, l5: Column, media: Column,
                      method: Column) -> Column:
    """SAN-5."""
    capped = media.isin(FLASH) & F.coalesce(method.isin(HOST_OVERWRITE), F.lit(False))
    return (F.when(~l5 | ~l1, "FAILED").when(l2 & l3 & l4 & capped, "MEDIUM").when(l2 & l3 & l4, "HIGH")
            .when(l3 & l4, "MEDIUM").otherwise("LOW"))


def residual_state(data_done: Column, metadata_done: Column, journal_done: Column, traces: Column,
                   error: Column) -> Column:
    """SAN-6: ``traces`` is a count."""
    return (F.when(error.isNotNull(), "UnableToVerify").when(traces > 0, "ResidualTracesDetected")
            .when(data_done & metadata_done & journal_done, "Sanitized")
            .when(data_done, "PartiallySanitized").otherwise("ResidualTracesDetected"))


def recommend_method(media: Column, supported: Column) -> Column:
    """SAN-7: preferred erase method for a device; ``supported`` is an array of method names."""
    has = lambda m: F.array_contains(supported, m)
    return (F.when(has("CryptographicErase"), "CryptographicErase")
            .when((media == "Nvme") & has("NvmeSanitizeBlock"), "NvmeSanitizeBlock")
            .when((media == "Nvme") & has("NvmeFormat"), "NvmeFormat")
            .when((media == "SataSsd") & has("AtaEnhancedSecureErase"), "AtaEnhancedSecureErase")
            .when((media == "SataSsd") & has("AtaSecureErase"), "AtaSecureErase")
            .otherwise("HostOverwriteSinglePass"))


def alternative_method(chosen: Column, supported: Column) -> Column:
    has = lambda m: F.array_contains(supported, m)
    return (F.when((chosen == "CryptographicErase") & has("NvmeSanitizeBlock"), "NvmeSanitizeBlock")
            .when((chosen == "CryptographicErase") & has("AtaEnhancedSecureErase"), "AtaEnhancedSecureErase")
            .when((chosen == "NvmeSanitizeBlock") & has("NvmeFormat"), "NvmeFormat")
            .when((chosen == "AtaEnhancedSecureErase") & has("AtaSecureErase"), "AtaSecureErase")
            .when(chosen == "HostOverwriteSinglePass", "HostOverwriteMultiPass"))


def residual_risk(media: Column, chosen: Column) -> Column:
    """Text shown when only a host overwrite is left for non-magnetic media."""
    return F.when((chosen == "HostOverwriteSinglePass") & (media != "Hdd"),
                  "Host overwrite cannot reach spare or wear-levelled flash cells; residual data may survive.")
