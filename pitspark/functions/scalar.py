"""Scalar column expressions: ids, keys, clocks, payload fields, costs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_NS = 86_400 * 10**9
_BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
KINDS = ("cashtag", "ticker", "cik", "company_name", "search_term")


def ulid(timestamp_ms: int, key: str) -> str:
    """26 characters: 10 of the time, 16 of the first 80 bits of sha256 of the key."""
    if not 0 <= timestamp_ms < 1 << 48:
        raise ValueError("the time must fit 48 bits")
    value = timestamp_ms << 80 | int.from_bytes(hashlib.sha256(key.encode()).digest()[:10], "big")
    return "".join(_BASE32[value >> 5 * k & 31] for k in range(25, -1, -1))


def _base32(value: Column, digits: int) -> Column:
    """The last ``digits`` base-32 digits of a long."""
    return F.concat(*(F.substring(F.lit(_BASE32), F.shiftrightunsigned(value, 5 * k).bitwiseAND(31).cast("int") + 1, F.lit(1)) for k in range(digits - 1, -1, -1)))


def ulid_column(timestamp_ms: Column, key: Column) -> Column:
    """``ulid`` as an expression; a time out of range raises, null stays null."""
    checked = F.when(timestamp_ms.isNull() | timestamp_ms.between(0, (1 << 48) - 1), timestamp_ms).otherwise(F.raise_error(F.lit("the time must fit 48 bits")).cast("long"))
    digest = F.sha2(key, 256)
    chunks = [_base32(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 10).cast("long"), 4) for k in range(4)]
    return F.concat(_base32(checked, 10), *chunks)


def strip(value: Column) -> Column:
    """Without white space of any sort at both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def fold_kind(kind: Column) -> Column:
    """Kinds are compared without case and outer white space."""
    return F.lower(strip(kind))


def normalize(kind: Column, value: Column) -> Column:
    """An entity key in the form in which mappings are compared, by its kind."""
    v, kind = strip(value), fold_kind(kind)
    digits = F.regexp_replace(v, "^0+", "")
    cik = F.when(digits == "", v).when(F.length(digits) >= 10, digits).otherwise(F.lpad(digits, 10, "0"))
    return (
        F.when(kind == "cashtag", F.upper(F.regexp_replace(v, r"^\$+", "")))
        .when(kind == "ticker", F.upper(v))
        .when(kind == "cik", cik)
        .when(kind.isin("company_name", "search_term"), F.lower(F.regexp_replace(v, r"(?U)\s+", " ")))
        .otherwise(v)
    )


def filer_cik(value: Column) -> Column:
    """Ten digits of a filer number with or without the letters CIK before it; anything else raises."""
    v = F.regexp_replace(F.upper(F.trim(value)), "^CIK", "")
    return F.when(v.rlike("^[0-9]{1,10}$"), F.lpad(v, 10, "0")).otherwise(F.raise_error(F.concat(F.lit("not a filer number: "), F.coalesce(value, F.lit("null")))))


def entity_key(security: str = "security_id", native: str = "native_entity") -> Column:
    return F.coalesce(F.nullif(F.col(security), F.lit("")), F.col(native))


def ns_of_date(day: Column) -> Column:
    """Midnight UTC of a date."""
    return F.unix_date(day).cast("long") * DAY_NS


def ns_of_local(moment: Column) -> Column:
    """A zoneless time taken as UTC, whatever the session's zone."""
    return ns_of_date(F.to_date(moment)) + F.timestamp_diff("MICROSECOND", F.date_trunc("day", moment), moment) * 1000


def date_of_ns(ns: Column) -> Column:
    return F.date_from_unix_date(F.floor(ns / F.lit(DAY_NS)).cast("int"))


def session_close(day: Column, close: str = "21:00") -> Column:
    """Nanoseconds of a day's close, ``HH:MM`` or ``HH:MM:SS`` UTC."""
    parts = [int(x) for x in close.split(":")]
    if len(parts) not in (2, 3) or not (0 <= parts[0] < 24 and all(0 <= x < 60 for x in parts[1:])):
        raise ValueError(f"not a time of day: {close!r}")
    seconds = parts[0] * 3600 + parts[1] * 60 + (parts[2] if len(parts) == 3 else 0)
    return ns_of_date(day) + F.lit(seconds * 10**9)


def iso_moment_ns(text: Column) -> Column:
    """Nanoseconds of an ISO time with a zone, or of 14 digits taken as UTC; a time without zone raises."""
    t = F.trim(text)
    digits = t.rlike("^[0-9]{14}$")
    zoned = t.rlike(r"^\d{4}-\d{2}-\d{2}[T ].*(Z|[+-]\d{2}:?\d{2})$")
    compact = F.concat_ws("", F.substring(t, 1, 4), F.lit("-"), F.substring(t, 5, 2), F.lit("-"), F.substring(t, 7, 2), F.lit("T"), F.substring(t, 9, 2), F.lit(":"), F.substring(t, 11, 2), F.lit(":"), F.substring(t, 13, 2), F.lit("Z"))
    value = F.when(digits, compact).when(zoned, t)
    micros = F.unix_micros(F.try_to_timestamp(value))
    return F.coalesce(micros, F.raise_error(F.concat(F.lit("not a time with a zone: "), F.coalesce(text, F.lit("null")))).cast("long")) * 1000


def payload_number(field: str | Column, payload: str = "payload") -> Column:
    """A payload field as a double; null for texts, booleans and what is missing."""
    path = F.concat(F.lit("$."), field) if isinstance(field, Column) else F.lit(f"$.{field}")
    raw = F.expr(f"variant_get(try_parse_json({payload}), '$.{field}', 'variant')") if isinstance(field, str) else None
    if raw is None:
        return F.get_json_object(payload, path).try_cast("double")
    kind = F.schema_of_variant(raw)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(raw, "$", "double"))


def payload_text(field: str, payload: str = "payload") -> Column:
    """A payload field that is a JSON string; null otherwise."""
    raw = F.expr(f"variant_get(try_parse_json({payload}), '$.{field}', 'variant')")
    return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(raw, "$", "string"))


def slippage_bps(quantity: Column, adv: Column, volatility: Column, k: Column | float = 1.0) -> Column:
    """k * volatility * sqrt(quantity / adv) in basis points; no volume, no slippage."""
    k = k if isinstance(k, Column) else F.lit(k)
    return F.when(adv > 0, k * volatility * F.sqrt(F.greatest(quantity / F.nullif(adv, F.lit(0.0)), F.lit(0.0))) * 1e4).otherwise(F.lit(0.0))


def cost_bps(quantity: Column, adv: Column, volatility: Column, half_spread_bps: Column, commission_bps: float = 1.0, k: float = 1.0) -> Column:
    """The five parts of a fill's cost and their sum; impact and borrow are 0 in this model."""
    slip, half = slippage_bps(quantity, adv, volatility, k), half_spread_bps
    return F.struct(
        F.lit(commission_bps).alias("commission_bps"), half.alias("half_spread_bps"), slip.alias("slippage_bps"), F.lit(0.0).alias("impact_bps"), F.lit(0.0).alias("borrow_bps"), (F.lit(commission_bps) + half + slip).alias("total_bps"),
    )
