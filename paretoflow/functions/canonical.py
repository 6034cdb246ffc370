"""Canonical JSON (RFC 8785) of nested columns and of JSON texts, and the content hashes built on it.

:func:`canonical_json` turns a column of any nested type into its canonical text by an expression that
follows the type: keys stand in the order of their UTF-16 units, decimals and doubles are fixed-point
texts in quotes, timestamps are UTC texts, and whole numbers must be exact as doubles. What has no canonical
form makes the whole text null. ``drop`` names fields that are left out when they hold a given text, which
is how documents keep their identity when a format gains optional fields.

:func:`canonical_text` does the same to texts that are JSON already, whatever their schema: documents are
checked as they were written, unknown fields included.

Paths: ``members[].offering.billing_mode``; ``[]`` is any element of an array, ``{}`` any value of a map.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole numbers up to here are exact as doubles.
LARGEST = (1 << 53) - 1
# The format's bounds of decimals.
MAX_DIGITS, MAX_PLACES, MAX_MAGNITUDE = 1024, 1024, 1024
#: A field left out, by its path and the canonical text it then has; ``None`` leaves it out always.
Drop = Mapping[str, str | None]
_WRITTEN = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
#: How each control character is written, by its code.
_CONTROLS = ",".join(_WRITTEN.get(code, f"\\u{code:04x}") for code in range(32))


class CanonicalError(ValueError):
    """The value has no canonical JSON."""


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _quoted(text: Column) -> Column:
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    # Control characters are rare: only texts that hold one are gone through letter by letter.
    written = lambda c: F.when((F.ascii(c) < 32) & (c != ""), F.get(F.split(F.lit(_CONTROLS), ","), F.ascii(c))).otherwise(c)
    rare = lambda t: F.array_join(F.transform(F.split(t, ""), written), "")
    inner = _let(escaped, lambda t: F.when(t.rlike(r"[\x00-\x1f]"), rare(t)).otherwise(t))
    return F.concat(F.lit('"'), inner, F.lit('"'))


def fixed_text(value: Column, kind: T.DataType) -> Column:
    """Fixed-point text of a decimal or a finite double: no exponent, no zeros at the end, no negative zero."""
    if isinstance(kind, T.DecimalType):
        return _trimmed(F.when(value == 0, F.lit("0")).otherwise(value.cast("string")))
    x = value.cast("double")
    shortest = lambda n: F.format_string(f"%.{n - 1}e", x)
    text = F.coalesce(*[F.when(shortest(n).try_cast("double") == x, shortest(n)) for n in (15, 16)], shortest(17))
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.when(x == 0, F.lit("0")).otherwise(_let(text, _unfolded)))


def _trimmed(text: Column) -> Column:
    return _let(text, lambda t: F.when(t.contains("."), F.rtrim(F.rtrim(t, F.lit("0")), F.lit("."))).otherwise(t))


def _unfolded(text: Column) -> Column:
    """``-d.ddde±xx`` without its exponent."""
    exponent = F.substring_index(text, "e", -1).cast("int")
    digits = F.regexp_replace(F.substring_index(text, "e", 1), "[-.]", "")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    padded = F.rpad(digits, F.greatest(F.char_length(digits), exponent + 1), "0")
    large = F.concat(F.left(padded, exponent + 1), F.lit("."), F.substr(padded, exponent + 2))
    return F.concat(sign, _trimmed(F.when(exponent < 0, small).otherwise(large)))


def _moment(value: Column) -> Column:
    """A timestamp in UTC with seconds, or six further digits, whatever the session's zone."""
    seconds = (F.unix_micros(value).cast("decimal(24,0)") / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(18,6)")
    wall = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    text = F.replace(wall.cast("string"), F.lit(" "), F.lit("T"))
    return F.concat(_let(text, lambda t: F.when(t.contains("."), F.rpad(t, F.lit(26), F.lit("0"))).otherwise(t)), F.lit("Z"))


def _joined(parts: Column, begin: str, end: str) -> Column:
    """Parts with commas between; empty ones are left out, and a null one makes the whole null."""
    filled = lambda p: F.array_join(F.filter(p, lambda x: x != ""), ",")
    whole = _let(parts, lambda p: F.when(~F.exists(p, lambda x: x.isNull()), filled(p)))
    return F.concat(F.lit(begin), whole, F.lit(end))


def _member(key: Column, text: Column, drop: str | None) -> Column:
    pair = lambda t: F.concat(key, F.lit(":"), t)
    return pair(text) if drop is None else _let(text, lambda t: F.when(t == drop, F.lit("")).otherwise(pair(t)))


def canonical_json(value: Column, kind: T.DataType, drop: Drop | None = None, path: str = "") -> Column:
    """Canonical JSON text of a column; ``null`` for a null, and a null column where there is no canonical text."""
    drop = drop or {}
    inner = lambda v, k, p: canonical_json(v, k, drop, p)
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode("utf-16-be"))
        parts = []
        for f in fields:
            at = f"{path}.{f.name}" if path else f.name
            if at in drop and drop[at] is None:
                continue
            key = F.lit(json.dumps(f.name, ensure_ascii=False))
            parts.append(_member(key, inner(value[f.name], f.dataType, at), drop.get(at)))
        text = _joined(F.array(*parts), "{", "}") if parts else F.lit("{}")
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise CanonicalError("keys of objects are texts")
        order = lambda e: F.struct(F.encode(e["key"], "UTF-16BE").alias("order"), e["key"].alias("key"), e["value"].alias("value"))
        entries = F.transform(F.map_entries(value), order)
        ranked = F.array_sort(entries, lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0))
        text = _joined(F.transform(ranked, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), inner(e["value"], kind.valueType, path + "{}"))), "{", "}")
    elif isinstance(kind, T.ArrayType):
        text = _joined(F.transform(value, lambda v: inner(v, kind.elementType, path + "[]")), "[", "]")
    elif isinstance(kind, T.StringType):
        text = _quoted(value)
    elif isinstance(kind, T.BooleanType):
        text = value.cast("string")
    elif isinstance(kind, T.IntegralType):
        text = F.when(F.abs(value.cast("decimal(20,0)")) <= LARGEST, value.cast("string"))
    elif isinstance(kind, (T.DecimalType, T.FractionalType)):
        text = F.concat(F.lit('"'), fixed_text(value, kind), F.lit('"'))
    elif isinstance(kind, T.TimestampType):
        text = F.concat(F.lit('"'), _moment(value), F.lit('"'))
    elif isinstance(kind, T.DateType):
        text = F.concat(F.lit('"'), value.cast("string"), F.lit('"'))
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise CanonicalError(f"{kind.simpleString()} has no canonical JSON")
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def row_kind(columns: Mapping[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


def json_hash(text: Column) -> Column:
    """SHA-256 of a canonical text; null for none."""
    return F.sha2(text, 256)


# Texts that are JSON already


def _read(text: str) -> Any:
    def once(pairs: list[tuple[str, Any]]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise CanonicalError("a key stands twice")
        return out

    def refuse(name: str) -> Any:
        raise CanonicalError(f"{name} is no JSON number")

    try:
        return json.loads(text, object_pairs_hook=once, parse_constant=refuse, parse_float=Decimal)
    except (ValueError, RecursionError) as error:
        raise CanonicalError("text is no JSON") from error


def _decimal(value: Decimal) -> str:
    text = format(value, "f") if abs(value.adjusted()) <= MAX_MAGNITUDE else ""
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    digits = text.lstrip("-").replace(".", "").strip("0")
    if not text or len(digits) > MAX_DIGITS or len(text.partition(".")[2]) > MAX_PLACES:
        raise CanonicalError("decimal is out of bounds")
    return text if digits else "0"


def _dump(value: Any, drop: Drop, path: str) -> str:
    if isinstance(value, dict):
        parts = []
        for key in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass")):
            at, wild = f"{path}.{key}" if path else key, path + "{}"
            at = at if at in drop or wild not in _prefixes(drop) else wild
            if at in drop and drop[at] is None:
                continue
            text = _dump(value[key], drop, at)
            if at not in drop or text != drop[at]:
                parts.append(f"{_dump(key, {}, '')}:{text}")
        return "{" + ",".join(parts) + "}"
    if isinstance(value, list):
        return "[" + ",".join(_dump(v, drop, path + "[]") for v in value) + "]"
    if isinstance(value, str):
        try:
            value.encode()
        except UnicodeEncodeError as error:
            raise CanonicalError("text holds half a character") from error
        text = json.dumps(value, ensure_ascii=False)
        return text if "\x7f" not in text else text.replace("\\u007f", "\x7f")
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, int):
        if abs(value) > LARGEST:
            raise CanonicalError("whole number is not exact as a double")
        return str(value)
    return f'"{_decimal(value)}"'


def _prefixes(drop: Drop) -> set[str]:
    """Beginnings of the paths that end in ``{}``."""
    return {p[: k + 2] for p in drop for k in range(len(p)) if p.startswith("{}", k)}


def canonical_bytes(value: Any, drop: Drop | None = None) -> bytes:
    """Canonical JSON of a value of Python's: dictionaries, lists, texts, whole numbers, decimals, booleans and None."""
    return _dump(value, drop or {}, "").encode()


def value_hash(value: Any, drop: Drop | None = None) -> str:
    return hashlib.sha256(canonical_bytes(value, drop)).hexdigest()


def canonical_text(text: Column, drop: Drop | None = None) -> Column:
    """Canonical JSON of a column of JSON texts; null for what is no JSON or has no canonical form."""
    dropped = dict(drop or {})

    @F.pandas_udf(T.StringType())
    def canonical(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            try:
                return _dump(_read(t), dropped, "")
            except (CanonicalError, RecursionError):
                return None

        return texts.map(one)

    return canonical(text)


def text_hashes(text: Column, drops: Sequence[Drop]) -> Column:
    """The content hashes of a JSON text under several rules of what is left out; read once. Null where there is none."""
    rules = [dict(d) for d in drops]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def hashes(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str] | None:
            try:
                value = None if t is None else _read(t)
                return None if t is None else [value_hash(value, d) for d in rules]
            except (CanonicalError, RecursionError):
                return None

        return texts.map(one)

    return hashes(text)
