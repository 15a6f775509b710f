"""Schema-on-read lookups over a VARIANT payload: each function builds one Catalyst expression from a list of dotted paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _json_path(keys: list[str]) -> str:
    return "$" + "".join(f"['{k}']" for k in keys)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value bound once, however often ``use`` names it: the plan holds one copy of it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lookup(payload: Column, path: str) -> Column:
    """The variant at ``path``: the whole path as one flattened key if there is one, else the nested walk."""
    keys = path.split(".")
    tries = [F.try_variant_get(payload, _json_path([path]), "variant")]
    if len(keys) > 1:
        tries.append(F.try_variant_get(payload, _json_path(keys), "variant"))
    return F.coalesce(*tries)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def present(v: Column) -> Column:
    """Absent are only null and the empty string; an empty object, false and 0 are present."""
    return v.isNotNull() & ~F.is_variant_null(v) & (F.coalesce(_text(v), F.lit("-")) != "")


def first_present(payload: Column, paths: list[str]) -> Column:
    """The first value that is present among the paths, as a variant."""
    return F.get(F.filter(F.array(*(lookup(payload, p) for p in paths)), present), F.lit(0))


def _listed(v: Column) -> Column:
    return F.filter(F.try_variant_get(v, "$", "array<string>"), lambda x: x.isNotNull() & (F.trim(x) != ""))


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def first_string(payload: Column, paths: list[str]) -> Column:
    """The first present value as trimmed text; an object gives null, a list its non-blank items joined by commas, blank text null. Later paths are not tried."""
    text = lambda v: F.when(_is(v, "OBJECT"), None).when(_is(v, "ARRAY"), F.array_join(_listed(v), ",")).otherwise(_text(v))
    return F.nullif(F.trim(let(first_present(payload, paths), text)), F.lit(""))


def first_int(payload: Column, paths: list[str]) -> Column:
    """The first path that holds a whole non-negative number (or its text); booleans and others are passed over."""

    def one(v: Column) -> Column:
        return F.when(~_is(v, "BOOLEAN") & ~_is(v, "OBJECT") & ~_is(v, "ARRAY") & F.trim(_text(v)).rlike(r"^[+]?\d+$"), F.trim(_text(v)).try_cast("bigint"))

    found = F.transform(F.array(*(lookup(payload, p) for p in paths)), one)
    return F.get(F.array_compact(found), F.lit(0))


def first_list(payload: Column, paths: list[str]) -> Column:
    """The first present value as a list of trimmed non-blank texts; a scalar is a list of one, nothing an empty list."""

    def items(v: Column) -> Column:
        return F.when(_is(v, "ARRAY"), F.transform(_listed(v), lambda x: F.trim(x))).when(F.trim(_text(v)) != "", F.array(F.trim(_text(v))))

    return F.coalesce(let(first_present(payload, paths), items), F.array().cast("array<string>"))


def first_timestamp(payload: Column, paths: list[str], fallback: Column) -> Column:
    """ISO text or epoch seconds at the first present path, in UTC; ``fallback`` where it is missing or malformed."""

    def read(v: Column) -> Column:
        number = _is(v, "BIGINT") | _is(v, "DECIMAL") | _is(v, "DOUBLE")
        return F.when(number, F.timestamp_seconds(F.try_variant_get(v, "$", "double"))).otherwise(F.trim(_text(v)).try_cast("timestamp"))

    return F.coalesce(let(first_present(payload, paths), read), fallback)
