"""Scalar, aggregate and window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .aggregates import Agg, Window, average, collect, collect_unique, count, count_non_null, cume_dist, dens_rank, dense_rank, first, first_value, lag, last, last_value, lead, max_, min_, nth_value, ntile, percent_rank, rank, row_number, sum_, window
from .expr import Expr, all_, any_, as_expr, col, entry, lift, lit, not_, optional, ref, refs, when


def exists(e: Expr) -> Expr:
    return e.exists()


def between(e, low, high, boundary: str = "left_inclusive") -> Expr:
    return as_expr(e).between(low, high, boundary)


def concat(*parts) -> Expr:
    head, *rest = map(lift, parts)
    return head.concat(*rest)


def sprintf(pattern: str, *args) -> Expr:
    return lit(pattern).sprintf(*args)


def combine(keys, values) -> Expr:
    return as_expr(keys).combine(as_expr(values))


def now() -> Expr:
    return Expr(lambda ctx: F.current_timestamp())


def uuid_v4() -> Expr:
    return Expr(lambda ctx: F.expr("uuid()"))


def uuid_v7(moment=None) -> Expr:
    """Milliseconds of the moment (or now) and random bits; null for a null moment."""

    def build(ctx):
        at = F.current_timestamp() if moment is None else as_expr(moment).resolve(ctx).cast("timestamp")
        stamp = F.lower(F.lpad(F.hex(F.unix_millis(at)), 12, "0"))
        noise = F.expr("replace(uuid(), '-', '')")
        variant = F.expr("substr('89ab', 1 + cast(rand() * 4 as int), 1)")
        return F.concat(F.left(stamp, F.lit(8)), F.lit("-"), F.right(stamp, F.lit(4)), F.lit("-7"), F.substr(noise, F.lit(1), F.lit(3)), F.lit("-"), variant, F.substr(noise, F.lit(4), F.lit(3)), F.lit("-"), F.right(noise, F.lit(12)))

    return Expr(build)


#: Crockford's letters (fixed value).
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(value=None) -> Expr:
    """A new identifier, or ``value`` if it is one, else null."""

    def build(ctx):
        if value is not None:
            x = F.upper(as_expr(value).resolve(ctx))
            return F.when(F.regexp_like(x, F.lit(f"^[0-7][{BASE32}]{{25}}$")), x)
        millis = F.unix_millis(F.current_timestamp())
        letters = F.lit(BASE32)
        stamp = [F.substr(letters, (F.shiftright(millis, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in reversed(range(10))]
        noise = [F.substr(letters, (F.floor(F.rand() * 32) + 1).cast("int"), F.lit(1)) for _ in range(16)]
        return F.concat(*stamp, *noise)

    return Expr(build)


def random_string(length: int) -> Expr:
    return Expr(lambda ctx: F.randstr(F.lit(length)))


def random_int(low: int, high: int) -> Expr:
    """Both ends included."""
    return Expr(lambda ctx: (F.floor(F.rand() * (high - low + 1)) + low).cast("long"))


def _function(method: str):
    def call(e, *args, **kwargs) -> Expr:
        return getattr(as_expr(e), method)(*args, **kwargs)

    call.__name__ = method
    return call


array_get, array_get_collection, array_get_collection_first = map(_function, ("array_get", "array_get_collection", "array_get_collection_first"))
array_exists, array_merge, array_merge_collection = map(_function, ("array_path_exists", "array_merge", "array_merge_collection"))
array_key_rename, array_keys_style_convert = map(_function, ("array_key_rename", "array_keys_style_convert"))
array_sort, array_reverse, array_expand, array_unpack = map(_function, ("array_sort", "array_reverse", "expand", "unpack"))
to_date_time, to_date, date_time_format, to_timezone = map(_function, ("to_date_time", "to_date", "date_time_format", "to_timezone"))
split, hash_, cast, size, lower, upper, capitalize = map(_function, ("split", "hash", "cast", "size", "lower", "upper", "capitalize"))
regex, regex_all, regex_match, regex_match_all, regex_replace = map(_function, ("regex", "regex_all", "regex_match", "regex_match_all", "regex_replace"))
sanitize, round_, number_format, call_method = map(_function, ("sanitize", "round", "number_format", "method"))
list_ref = structure_ref = ref

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "F")]
