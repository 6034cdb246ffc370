"""Text Column helpers: safe cells, identifiers, public addresses, canonical numbers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: control, direction-mark and non-character code points refused in texts.
FORBIDDEN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\u061C\u200E\u200F\u202A-\u202E\u2066-\u2069\uFFFE\uFFFF]"


def spreadsheet_safe(value: Column) -> Column:
    """Quote cells that a spreadsheet would run as a formula, white space of any kind before the sign or not."""
    return F.when(value.rlike(r"(?U)^[\s\x1C-\x1F]*[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def has_forbidden_text(value: Column) -> Column:
    return F.coalesce(value.rlike(FORBIDDEN), F.lit(False))


def canonical_number(value: Column) -> Column:
    """Fixed-point text of a decimal without trailing zeros."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")).otherwise(text)


def provider_of(model_id: Column) -> Column:
    """The part before the first slash, or ``unknown``."""
    return F.when(model_id.contains("/"), F.split_part(model_id, F.lit("/"), F.lit(1))).otherwise(F.lit("unknown"))


def is_public_url(url: Column) -> Column:
    """HTTPS, with neither user, query nor fragment."""
    return F.coalesce(url.rlike(r"^https://[^/?#@\s]+(/[^?#\s]*)?$"), F.lit(False))


def is_safe_path(path: Column) -> Column:
    """A relative path without dot segments or backslashes."""
    return F.coalesce(path.rlike(r"^(?!\.{1,2}(/|$))[^/\\]+(/(?!\.{1,2}(/|$))[^/\\]+)*$"), F.lit(False))


def content_hash(columns: list[Column]) -> Column:
    """SHA-256 of the columns' texts, each with its length before it; nulls differ from empty texts."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("null")) for t in texts]
    return F.sha2(F.concat_ws(",", *parts), 256)


def domain_hash(domain: str, columns: list[Column]) -> Column:
    """A content hash that no equal content of another domain shares."""
    return content_hash([F.lit(domain), *columns])


def set_hash(columns: list[Column]) -> Column:
    """An aggregate: the same for the same rows in any order. One group's hashes meet in one list."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(content_hash(columns))), ","), 256)


def canonical_json(columns: dict[str, Column]) -> Column:
    """JSON text of one object: keys by code point, no spaces, null fields kept, numbers as given texts of decimals."""
    fields = [columns[k].alias(k) for k in sorted(columns)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


#: Digits, places and magnitude of a decimal at most.
MAX_DIGITS = 1024
_DECIMAL = r"([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,5})?$"


def _unfolded(number: Column) -> Column:
    """Fixed-point text of a decimal's text, digit by digit: no cast, so no digit is lost. Null beyond ``MAX_DIGITS``."""
    lower = F.lower(F.trim(number))
    sign = F.when(lower.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    mantissa = F.ltrim(F.substring_index(lower, "e", 1), F.lit("+-"))
    exponent = F.when(lower.contains("e"), F.substring_index(lower, "e", -1)).otherwise(F.lit("0")).try_cast("int")
    whole = F.substring_index(mantissa, ".", 1)
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    # Leading zeros move the point, trailing ones do not.
    plain = F.ltrim(digits, F.lit("0"))
    point = F.char_length(whole) + exponent - (F.char_length(digits) - F.char_length(plain))
    kept = F.rtrim(plain, F.lit("0"))
    n = F.char_length(kept)
    text = (
        F.when(n == 0, F.lit("0")).when(point <= 0, F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -point), kept))
        .when(point >= n, F.concat(sign, F.rpad(kept, F.greatest(n, point), F.lit("0"))))
        .otherwise(F.concat(sign, F.left(kept, point), F.lit("."), F.substr(kept, point + 1)))
    )
    return F.when((n == 0) | ((n <= MAX_DIGITS) & (n - point <= MAX_DIGITS) & (F.abs(point - 1) <= MAX_DIGITS)), text)


def decimal_text(value: Column) -> Column:
    """Fixed-point text of a text that is a finite decimal, not negative and at most 128 characters long; else null."""
    plain = F.trim(value).rlike(r"^(\+?" + _DECIMAL + r"|-[0.]+([eE]|$))")
    number = F.when(plain & F.trim(value).rlike(r"^[+-]?" + _DECIMAL) & (F.char_length(value) <= 128), value)
    return _unfolded(number)


def decimal_input(value: Column) -> Column:
    """Fixed-point text of a text of at most 1024 characters; null for booleans' texts, infinities and what is no number."""
    number = F.trim(value).rlike(r"^[+-]?" + _DECIMAL)
    return _unfolded(F.when(number & (F.char_length(value) <= 1024), value))


def is_rfc3339(value: Column) -> Column:
    """A timestamp text with a date, a time and a zone, that exists in the calendar."""
    shape = value.rlike(r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d{1,9})?([Zz]|[+-]\d{2}:\d{2})$")
    return F.coalesce(shape & F.upper(value).try_cast("timestamp").isNotNull(), F.lit(False))


def fixed_point(value: Column) -> Column:
    """How a decimal is shown: no exponent, no trailing zeros, ``0`` for any zero."""
    return F.when(value == 0, F.lit("0")).otherwise(canonical_number(value))


def shown(value: Column) -> Column:
    """A cell's text on one line; nothing for null."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    for sign, written in (("\r", r"\r"), ("\n", r"\n"), ("\t", r"\t")):
        text = F.replace(text, F.lit(sign), F.lit(written))
    return text


def escaped_markup(value: Column) -> Column:
    """A cell's text inside XML or HTML."""
    text = shown(value)
    for sign, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(written))
    return text


def opaque_id(value: Column, key: bytes, prefix: str, domain: str) -> Column:
    """Keyed HMAC-SHA-256 name of a value, separated by domain, from built-in functions."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in block) for p in (0x36, 0x5C))
    message = F.concat(F.lit(domain.encode() + b"\0"), value.cast("binary"))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))
    return F.concat(F.lit(prefix), F.sha2(F.concat(F.lit(outer), first), 256))


def local_offering_id(hardware: Column, model: Column, format_: Column, quantization: Column, runtime: Column, identity: list[Column]) -> Column:
    """Readable id of a model on own hardware; 16 digits of its identity's hash tell configurations apart."""
    short = F.substring(content_hash(identity), 1, 16)
    return F.concat(F.lit("local/"), hardware, F.lit("/"), model, F.lit("@"), F.concat_ws("-", format_, quantization, runtime, short))
