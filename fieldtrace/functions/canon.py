"""Strict JSON, canonical text (RFC 8785) and digests."""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

MAX_DEPTH = 32
MAX_NODES = 100_000
_SAFE = 2**53 - 1


def number_text(x: int | float) -> str:
    """Shortest form of a number as ECMAScript writes it."""
    if isinstance(x, int):
        if abs(x) > _SAFE:
            raise ValueError("integer outside the safe range")
        return str(x)
    if not math.isfinite(x):
        raise ValueError("number isn't finite")
    if x == 0:
        return "0"
    sign = "-" if x < 0 else ""
    mantissa, _, exponent = f"{abs(x)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + part) - len((whole + part).lstrip("0")))
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    e = point - 1
    tail = f".{digits[1:]}" if n > 1 else ""
    return f"{sign}{digits[0]}{tail}e{'+' if e >= 0 else '-'}{abs(e)}"


def canonical(value) -> str:
    """Canonical JSON text: keys in UTF-16 order, no blanks, shortest numbers."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    raise TypeError(f"no JSON value: {type(value).__name__}")


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def object_hash(value) -> str:
    return digest(canonical(value).encode("utf-8", "surrogatepass"))


def tree_size(value) -> tuple[int, int]:
    """(depth, nodes) of a JSON value; a scalar has depth 0."""
    depth = nodes = 0
    open_ = [(value, 0)]
    while open_:
        v, d = open_.pop()
        nodes += 1
        depth = max(depth, d)
        if isinstance(v, dict):
            open_ += [(x, d + 1) for x in v.values()]
        elif isinstance(v, list):
            open_ += [(x, d + 1) for x in v]
    return depth, nodes


def _once(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key occurs twice")
    return out


def _refuse(text):
    raise ValueError(f"{text} isn't JSON")


def _finite(text):
    x = float(text)
    if not math.isfinite(x):
        raise ValueError("number overflows")
    return x


def loads_strict(text: str):
    """Parse JSON; repeated keys, NaN, Infinity, overflow and oversized trees are errors."""
    try:
        value = json.loads(text, object_pairs_hook=_once, parse_constant=_refuse, parse_float=_finite)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    depth, nodes = tree_size(value)
    if depth > MAX_DEPTH or nodes > MAX_NODES:
        raise ValueError("tree is too large")
    return value


def _canonical_or_none(text):
    try:
        return canonical(loads_strict(text))
    except (ValueError, TypeError):
        return None


@pandas_udf(StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    """Canonical form of JSON text; null for null and for what isn't strict JSON."""
    return texts.map(_canonical_or_none, na_action="ignore")


@pandas_udf(StructType([StructField("depth", IntegerType()), StructField("nodes", IntegerType())]))
def json_tree_size(texts: pd.Series) -> pd.DataFrame:
    """Depth and number of nodes; nulls for null and invalid text."""

    def one(t):
        try:
            return tree_size(json.loads(t))
        except (ValueError, TypeError, RecursionError):
            return (None, None)

    return pd.DataFrame([one(t) for t in texts], columns=["depth", "nodes"]).astype("Int32")


def text_digest(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(F.encode(text, "utf-8"), 256)
