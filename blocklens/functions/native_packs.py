"""Structural checks as column expressions over a candidate window: pdf, zip, sqlite.

Windows are decoded one character per byte, so string positions are byte positions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blocklens.functions.scoring import last_position, latin

VERDICT = "struct<verdict:string,length:bigint,reason:string>"


def _v(verdict: str, length: Column | None = None, reason: str | None = None) -> Column:
    return F.struct(F.lit(verdict).alias("verdict"),
                    (F.lit(None) if length is None else length).cast("bigint").alias("length"),
                    F.lit(reason).cast("string").alias("reason"))


def ok(length: Column) -> Column:
    return _v("OK", length)


def eof(length: Column) -> Column:
    return _v("EOF", length)


def err(reason: str) -> Column:
    return _v("ERR", None, reason)


def _num(payload: Column, at: Column | int, width: int, little: bool) -> Column:
    at1 = at + 1 if isinstance(at, int) else at + F.lit(1)
    h = F.hex(F.substring(payload, at1, F.lit(width)) if isinstance(at1, Column) else F.substring(payload, at1, width))
    if little:
        h = F.concat(*[F.substring(h, i, 2) for i in range(width * 2 - 1, 0, -2)])
    return F.conv(h, 16, 10).cast("bigint")


def check_pdf(payload: Column) -> Column:
    n, text = F.octet_length(payload), latin(payload)
    end = last_position(text, F.lit("%%EOF"))
    head = F.substring(text, F.lit(1), F.greatest(end, F.lit(0)))
    return (F.when(n < 10, eof(n))
            .when(~F.startswith(text, F.lit("%PDF-")), err("pdf header"))
            .when(end.isNull(), F.when(F.contains(text, F.lit("obj")), eof(n)).otherwise(err("pdf without end or objects")))
            .when(F.contains(head, F.lit("startxref")) | F.contains(text, F.lit("endobj")), ok(end + 5))
            .otherwise(err("pdf without objects")))


def check_zip(payload: Column) -> Column:
    n, text = F.octet_length(payload), latin(payload)
    # the end record needs 22 bytes, so its mark can start at n-22 at the latest
    at = last_position(F.substring(text, F.lit(1), F.greatest(n - 18, F.lit(0))), F.lit("PK\x05\x06"))
    cd_size, cd_at = _num(payload, at + 12, 4, True), _num(payload, at + 16, 4, True)
    return (F.when(n < 22, eof(n))
            .when(~F.startswith(text, F.lit("PK\x03\x04")), err("zip local header"))
            .when(at.isNull(), eof(n))
            .when(cd_at + cd_size > at, err("zip central directory bounds"))
            .otherwise(ok(at + 22 + _num(payload, at + 20, 2, True))))


def check_sqlite(payload: Column) -> Column:
    n = F.octet_length(payload)
    raw = _num(payload, 16, 2, False)
    page = F.when(raw == 1, F.lit(65536)).otherwise(raw)
    pages = _num(payload, 28, 4, False)
    cell = _num(payload, 105, 2, False)
    cell = F.when(cell == 0, F.lit(65536)).otherwise(cell)
    want = F.when(pages > 0, pages * page).otherwise(page)
    return (F.when(n < 100, eof(n))
            .when(F.substring(payload, 1, 16) != F.lit(b"SQLite format 3\x00"), err("sqlite magic"))
            .when(~page.between(512, 65536) | (page.bitwiseAND(page - 1) != 0), err("sqlite page size"))
            .when(n < 108, eof(n))
            .when(~F.hex(F.substring(payload, 101, 1)).isin("02", "05", "0A", "0D"), err("sqlite page type"))
            .when(cell > page, err("sqlite cell offset"))
            .when(n < want, eof(n)).otherwise(ok(want)))


def check_html(payload: Column) -> Column:
    """Markup page: ends at its closing tag; padding or the next page ends a cut-off one."""
    text = latin(payload)
    close = F.locate("</html>", text)
    stop = F.least(*[F.when(p > 0, p - 1).otherwise(F.length(text)) for p in (
        F.locate("\x00", text), F.locate("<!DOCTYPE html>", text, 2))])
    return (F.when(~F.startswith(text, F.lit("<!DOCTYPE html>")), err("html header"))
            .when((close > 0) & (close + 6 <= stop), ok(close + 6)).otherwise(eof(stop)))


NATIVE = {"pdf": check_pdf, "zip": check_zip, "sqlite": check_sqlite, "html": check_html}
