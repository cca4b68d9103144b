"""Scalar rules of the event tables, as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "__UNKNOWN__"
MAX_KEY_BYTES = 256
EVENT_TYPES = ("view", "cart", "remove_from_cart", "purchase")
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss 'UTC'"
#: Counts below which features are defined, in order.
FEATURES = ("log_views", "log_carts", "log_purchases", "cart_rate", "purchase_rate", "log_median_price", "log_distinct_users")


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_minor(text: Column | str) -> Column:
    """Cents of a money text; null for what isn't a number, is negative or has more than two significant decimals."""
    d = F.trim(as_column(text)).try_cast("decimal(38,18)")
    fits = (d >= 0) & (d == F.round(d, 2)) & (d < F.lit("90000000000000000").cast("decimal(38,18)"))
    return F.when(fits, (d * 100).cast("bigint"))


def money_text(minor: Column | str) -> Column:
    """Cents as text with two decimals."""
    return (as_column(minor).cast("decimal(36,0)") / 100).cast("decimal(38,2)").cast("string")


def average_minor(total: Column | str, count: Column | str) -> Column:
    """Average of non-negative integers, rounded half up; null without rows."""
    n = as_column(count).cast("decimal(20,0)")
    twice = (as_column(total).cast("decimal(20,0)") * 2 + n).cast("decimal(20,0)")
    return F.when(n > 0, F.floor((twice - twice % (n * 2)) / (n * 2)).cast("bigint"))


def event_time(text: Column | str) -> Column:
    return F.try_to_timestamp(as_column(text), F.lit(TIME_FORMAT))


def known_event(event_type: Column | str) -> Column:
    return F.trim(as_column(event_type)).isin(*EVENT_TYPES)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(as_column(c), F.lit(""))


def category_root(code: Column | str) -> Column:
    return F.substring_index(as_column(code), ".", 1)


def or_unknown(c: Column | str) -> Column:
    return F.coalesce(as_column(c), F.lit(UNKNOWN))


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole to six places; null where the whole is zero."""
    return F.when(as_column(whole) > 0, F.round(as_column(part) / as_column(whole), 6))


def _key_of_any_length(mode: str, category_id: Column | str, category_code: Column | str) -> Column:
    ident, code = F.trim(as_column(category_id)), F.trim(as_column(category_code))
    if mode == "category_id":
        return F.when(ident.rlike("^[0-9]+$"), ident)
    if mode in ("category_code", "category_root"):
        named = F.when(F.coalesce(code, F.lit("")) == "", F.lit(UNKNOWN)).when(~code.rlike("[\\t\\r\\n]"), code)
        return named if mode == "category_code" else category_root(named)
    raise ValueError(f"unknown mode {mode}")


def group_key(mode: str, category_id: Column | str, category_code: Column | str) -> Column:
    """Group key of an event by `mode`: category_id, category_code or category_root; null where it is invalid."""
    key = _key_of_any_length(mode, category_id, category_code)
    return F.when(F.octet_length(key) <= MAX_KEY_BYTES, key)


def overlong_key(mode: str, category_id: Column | str, category_code: Column | str) -> Column:
    """Whether a key is invalid for its length alone."""
    return F.coalesce(F.octet_length(_key_of_any_length(mode, category_id, category_code)) > MAX_KEY_BYTES, F.lit(False))


def standardized(x: Column | str, mean: float, std: float) -> Column:
    """(x - mean) * (1 / std), and 0 for a column that doesn't vary."""
    return (as_column(x) - mean) * (1.0 / std) if std else F.lit(0.0)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance of two arrays, summed in order."""
    return F.aggregate(F.zip_with(as_column(a), as_column(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)


def feature_columns(views: str = "views", carts: str = "carts", purchases: str = "purchases", price: str = "median_price", users: str = "distinct_users") -> dict[str, Column]:
    """The product features from raw counts; training and scoring share them."""
    return {
        "log_views": F.log1p(views),
        "log_carts": F.log1p(carts),
        "log_purchases": F.log1p(purchases),
        "cart_rate": F.col(carts) / F.col(views),
        "purchase_rate": F.col(purchases) / F.col(views),
        "log_median_price": F.log1p(price),
        "log_distinct_users": F.log1p(users),
    }


def domain_warnings(min_views: int) -> Column:
    """Names of the rules a row of raw counts breaks, outside of what the models have seen."""
    rules = {
        "views_below_minimum": F.col("views") < min_views,
        "carts_above_views": F.col("carts") > F.col("views"),
        "purchases_above_views": F.col("purchases") > F.col("views"),
        "recent_above_views": F.col("recent_views") > F.col("views"),
    }
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def hash_bucket(key: Column | str, seed: int, buckets: int = 100) -> Column:
    """A bucket of 0..buckets-1 by Spark's 64-bit hash; the seed is an INT."""
    return F.pmod(F.xxhash64(as_column(key), F.lit(seed)), F.lit(buckets))


def digest_bucket(parts: list[Column], buckets: int) -> Column:
    """A bucket by the first four bytes of SHA-256 over the parts joined by NUL, taken as a signed integer."""
    head = F.conv(F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 8), 16, 10).cast("bigint")
    signed = F.when(head >= 1 << 31, head - (1 << 32)).otherwise(head)
    return F.pmod(signed, F.lit(buckets).cast("bigint"))


def digest_uniform(*parts: Column | str) -> Column:
    """A number of [0, 1) by the first 48 bits of SHA-256 over the parts joined by colons."""
    text = F.concat_ws(":", *[as_column(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint") / float(1 << 48)


def _poisson_steps() -> list[float]:
    """The cumulative probabilities of a Poisson(1) number, the first twelve."""
    total, steps = 0.0, []
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        steps.append(total)
    return steps


#: The least first 48 bits of a digest that reach each cumulative probability.
POISSON_HEADS = tuple(math.ceil(t * (1 << 48)) for t in _poisson_steps())


def poisson_one(u: Column) -> Column:
    """A Poisson(1) number from a uniform one: how many of the cumulative probabilities it reaches."""
    return sum(((u >= t).cast("int") for t in _poisson_steps()), F.lit(0))


def poisson_digest(digest: Column) -> Column:
    """`poisson_one` of `digest_uniform` from the SHA-256 as hexadecimal text, whose order is that of its first 48 bits; 0 for null."""
    out = F.when(digest.isNull(), 0)
    for n, head in enumerate(POISSON_HEADS):
        out = out.when(digest < f"{head:012x}", n)
    return out.otherwise(len(POISSON_HEADS))
