"""Cursors, versions, page tokens and the small scalar rules of the log, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BadToken

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Between the fields of a page token.
SEPARATOR = "\x1f"


def version(seq: Column) -> Column:
    return seq.cast("string")


def sequence_of(text: Column) -> Column:
    """The number in a version; null where it is none."""
    return text.try_cast("long")


def cursor(epoch: Column, seq: Column) -> Column:
    return F.concat_ws(".", epoch, seq.cast("string"))


def position_of(text: Column) -> Column:
    """epoch and seq of a cursor; null where the text is not a cursor."""
    parts = F.split(text, r"\.")
    seq = F.get(parts, F.lit(1)).try_cast("long")
    ok = (F.size(parts) == 2) & F.get(parts, F.lit(0)).rlike(UUID) & seq.isNotNull()
    return F.when(ok, F.struct(F.get(parts, F.lit(0)).alias("epoch"), seq.alias("seq")))


def page_token(*fields: Column) -> Column:
    """URL-safe Base64 without padding of the fields."""
    raw = F.base64(F.encode(F.concat_ws(SEPARATOR, *fields), "utf-8"))
    return F.regexp_replace(F.translate(F.regexp_replace(raw, r"[\r\n]", ""), "+/", "-_"), "=+$", "")


def page_fields(token: Column, count: int) -> Column:
    """The fields of a page token as an array; null where it is none of that many fields."""
    plain = F.translate(token, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    parts = F.split(F.decode(F.unbase64(padded), "utf-8"), SEPARATOR)
    ok = token.rlike(r"^[A-Za-z0-9_-]+$") & (F.length(token) % 4 != 1)
    return F.when(ok, F.when(F.size(parts) == count, parts))


def clamp(value: Column, most: int) -> Column:
    """Between 1 and most."""
    return F.greatest(F.lit(1), F.least(value, F.lit(most)))


def backoff_limit(attempt: Column, base_ms: int = 1000, cap_ms: int = 300_000) -> Column:
    """Longest wait before the attempt-th retry: doubling, capped; the wait is uniform below it."""
    doubled = F.lit(base_ms) * F.pow(F.lit(2.0), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(20)))
    return F.least(doubled, F.lit(float(cap_ms))).cast("long")


def backoff(attempt: Column, share: Column) -> Column:
    """Full jitter: share, in [0, 1), of the longest wait. Pass F.rand(seed) or a fixed number."""
    return F.floor(backoff_limit(attempt) * share).cast("long")


def next_after(highest: Column) -> Column:
    return F.coalesce(F.max(highest), F.lit(0)) + 1


def uuid_bytes(text: Column) -> Column:
    return F.unhex(F.translate(text, "-", ""))


def uuid_text(raw: Column) -> Column:
    h = F.lower(F.hex(raw))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


#: What a replica makes of the log's reject codes, fixed values; others stay unknown.
REJECTIONS = {"VALIDATION": "Validation", "UNKNOWN_ENTITY_TYPE": "UnknownEntityType", "TOO_LARGE": "TooLarge"}


def rejection_of(code: Column) -> Column:
    out = F.lit("Unknown")
    for name, kind in REJECTIONS.items():
        out = F.when(code == name, kind).otherwise(out)
    return out


def failure_of(status: Column) -> Column:
    """Kind of failure behind an HTTP status, fixed values."""
    out = F.lit("ServerError")
    for number, kind in ((401, "Unauthorized"), (403, "Forbidden"), (409, "CollectionReset"), (410, "CursorTooOld"), (429, "RateLimited")):
        out = F.when(status == number, kind).otherwise(out)
    return out


def parse_cursor(text: str) -> tuple[str, int]:
    """epoch and seq of one cursor."""
    import re

    head, dot, tail = text.partition(".")
    if not dot or "." in tail or not re.match(UUID, head) or not re.fullmatch(r"-?\d{1,19}", tail):
        raise BadToken(text)
    return head, int(tail)


def make_page_token(*fields: str) -> str:
    import base64

    return base64.urlsafe_b64encode(SEPARATOR.join(fields).encode()).decode().rstrip("=")


def parse_page_token(token: str, count: int) -> list[str]:
    import base64
    import binascii

    try:
        fields = base64.b64decode(token + "=" * (-len(token) % 4), b"-_", validate=True).decode().split(SEPARATOR)
    except (binascii.Error, UnicodeDecodeError) as bad:
        raise BadToken(token) from bad
    if len(fields) != count:
        raise BadToken(token)
    return fields
