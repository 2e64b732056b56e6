"""Field transforms as expressions over a list of variants.

A step maps ``struct<v: array<variant>, e: string>`` to the next state: the
values, and the code of the first value that failed. After an error the values
are kept and later steps do nothing.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import UTC, datetime
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from fieldtrace.errors import FieldtraceError
from fieldtrace.functions import canon, text

TYPE, PARSE = "TRANSFORM_TYPE", "TRANSFORM_PARSE"
#: strptime directives that a timestamp pattern expresses exactly.
_DIRECTIVES = {"Y": "yyyy", "m": "M", "d": "d", "H": "H", "M": "m", "S": "s"}


def start(values: Column) -> Column:
    return F.struct(values.alias("v"), F.lit(None).cast("string").alias("e"))


def is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def as_string(value: Column) -> Column:
    return F.when(is_string(value), F.try_variant_get(value, "$", "string"))


def _each(state: Column, one) -> Column:
    """Applies ``one``: variant -> (variant, error code or null) to every value."""
    told = F.transform(state["v"], lambda v: F.struct(*[c.alias(n) for c, n in zip(one(v), ("v", "e"))]))
    errors = F.filter(F.transform(told, lambda t: t["e"]), lambda e: e.isNotNull())
    first = F.get(errors, F.lit(0))
    done = F.struct(F.when(first.isNull(), F.transform(told, lambda t: t["v"])).otherwise(state["v"]).alias("v"), first.alias("e"))
    return F.when(state["e"].isNotNull(), state).otherwise(done)


def _text_step(state: Column, change, may_fail: bool = False) -> Column:
    """``change``: string column -> variant-able column; null then means PARSE."""

    def one(v):
        new = change(as_string(v))
        error = F.when(~is_string(v), TYPE)
        return new.cast("variant"), error.when(new.isNull(), PARSE) if may_fail else error

    return _each(state, one)


def _udf_step(state: Column, function, *extra: Column) -> Column:
    """As ``_text_step`` for list-at-once Python functions."""
    strings = F.when(state["e"].isNull(), F.transform(state["v"], as_string))
    given = F.transform(state["v"], is_string)
    new = function(strings, *extra)
    bad_type = F.array_position(given, False)
    bad_parse = F.coalesce(F.array_position(F.transform(new, lambda x: x.isNull()), True), F.lit(0))
    error = F.when((bad_type > 0) & ((bad_parse == 0) | (bad_type <= bad_parse)), TYPE).when(bad_parse > 0, PARSE)
    done = F.struct(F.when(error.isNull(), F.transform(new, lambda x: x.cast("variant"))).otherwise(state["v"]).alias("v"), error.alias("e"))
    return F.when(state["e"].isNotNull(), state).otherwise(done)


def _lists(function):
    """A pandas UDF over lists; null elements stay null, failures become null."""

    @pandas_udf(ArrayType(StringType()))
    def run(lists: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else function(x)
            except (ValueError, OverflowError):
                return None

        return lists.map(lambda xs: None if xs is None else [one(x) for x in xs])

    return run


nfc_list = _lists(lambda t: unicodedata.normalize("NFC", t))


@pandas_udf(ArrayType(StringType()))
def resolve_list(lists: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([None if xs is None else [None if x is None else urljoin(b or "", x) for x in xs] for xs, b in zip(lists, bases)], dtype=object)


def _canonical(text: str | None) -> str:
    """Canonical form of a JSON text; a null element is JSON's null."""
    return "null" if text is None else canon.canonical(canon.loads_strict(text))


@pandas_udf(ArrayType(StringType()))
def order_list(lists: pd.Series) -> pd.Series:
    """JSON texts in the order of their canonical texts."""
    return lists.map(lambda xs: None if xs is None else sorted((_canonical(x) for x in xs), key=lambda x: x.encode()))


@pandas_udf(ArrayType(StringType()))
def distinct_list(lists: pd.Series) -> pd.Series:
    return lists.map(lambda xs: None if xs is None else sorted({_canonical(x) for x in xs}, key=lambda x: x.encode()))


def parse_decimal(value: Column, decimal: str = ".", grouping: str | None = None) -> Column:
    """Finite double of a decimal text; null where it isn't one.

    Blanks around and single underscores between digits are allowed.
    """
    bare = text.strip(value)
    if grouping:
        bare = F.replace(bare, F.lit(grouping), F.lit(""))
    if decimal != ".":
        bare = F.replace(bare, F.lit(decimal), F.lit("."))
    shaped = bare.rlike(r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$")
    number = F.when(shaped, F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(F.abs(number) <= 1.7976931348623157e308, number)


def date_pattern(fmt: str) -> str | None:
    """The timestamp pattern equal to a strptime format, if there is one."""
    out, k, last = "", 0, False
    while k < len(fmt):
        if fmt[k] == "%":
            letter = _DIRECTIVES.get(fmt[k + 1 : k + 2])
            if letter is None or last:  # unknown, or digits that touch
                return None
            out, k, last = out + letter, k + 2, True
        else:
            if fmt[k].isalnum():
                out += f"'{fmt[k]}'"
            elif fmt[k] in "-/.: ,_":
                out += fmt[k]
            else:
                return None
            k, last = k + 1, False
    return out


def parse_date(value: Column, fmt: str) -> Column:
    """ISO-8601 text in UTC; null where the text doesn't have the format."""
    pattern = date_pattern(fmt)
    stamp = F.try_to_timestamp(value, F.lit(pattern)) if pattern else None
    if stamp is None:
        raise FieldtraceError("CAPABILITY_UNSUPPORTED", fmt)
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def _strptime(fmt: str):
    def one(t):
        d = datetime.strptime(t, fmt)
        return (d.replace(tzinfo=UTC) if d.tzinfo is None else d).isoformat()

    return _lists(one)


def may_be_absent(pattern: str, group: int) -> bool:
    """Whether a match can leave the group out: it lies in an option, a repetition or an alternative."""

    def absent(parsed, optional: bool) -> bool | None:
        for op, value in parsed:
            name = str(op)
            if name == "SUBPATTERN":
                if value[0] == group:
                    return optional
                inner = [(value[3], optional)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                inner = [(value[2], optional or value[0] == 0)]
            elif name == "BRANCH":
                inner = [(branch, True) for branch in value[1]]
            else:
                continue
            for part, o in inner:
                told = absent(part, o)
                if told is not None:
                    return told
        return None

    return group > 0 and bool(absent(re._parser.parse(pattern), False))


def _capture_optional(state: Column, pattern: str, group: int) -> Column:
    """Captures of a group that a match may leave out; such a value becomes JSON's null."""
    compiled = re.compile(pattern)

    @pandas_udf("array<struct<hit:boolean,text:string>>")
    def found(lists: pd.Series) -> pd.Series:
        def one(x):
            m = None if x is None else compiled.search(x)
            return {"hit": m is not None, "text": m[group] if m else None}

        return lists.map(lambda xs: None if xs is None else [one(x) for x in xs])

    told = found(F.when(state["e"].isNull(), F.transform(state["v"], as_string)))
    given = F.transform(state["v"], is_string)
    codes = F.zip_with(told, given, lambda t, g: F.when(~g, TYPE).when(~t["hit"], PARSE))
    first = F.get(F.filter(codes, lambda c: c.isNotNull()), F.lit(0))
    values = F.transform(told, lambda t: F.coalesce(t["text"].cast("variant"), F.parse_json(F.lit("null"))))
    done = F.struct(F.when(first.isNull(), values).otherwise(state["v"]).alias("v"), first.alias("e"))
    return F.when(state["e"].isNotNull(), state).otherwise(done)


def apply(state: Column, rule: dict, source_url: Column | None = None) -> Column:
    """One transform. ``rule``: {'op': ..., and the parameters of that op}."""
    op = rule["op"]
    if op == "strip":
        return _text_step(state, text.strip)
    if op == "collapse_whitespace":
        return _text_step(state, text.collapse)
    if op == "unicode_nfc":
        return _udf_step(state, nfc_list)
    if op == "resolve_url":
        return _udf_step(state, resolve_list, source_url if source_url is not None else F.lit(""))
    if op == "parse_decimal":
        return _text_step(state, lambda s: parse_decimal(s, rule["decimal_separator"], rule.get("grouping_separator")), True)
    if op == "parse_date":
        if date_pattern(rule["format"]):
            return _text_step(state, lambda s: parse_date(s, rule["format"]), True)
        return _udf_step(state, _strptime(rule["format"]))
    if op == "regex_capture":
        compiled = re.compile(rule["pattern"])
        group = rule.get("group", 1)
        index = group if isinstance(group, int) else compiled.groupindex[group]
        if may_be_absent(rule["pattern"], index):
            return _capture_optional(state, rule["pattern"], index)
        plain = re.sub(r"\(\?P<", "(?<", rule["pattern"])
        capture = F.regexp_extract
        return _each(state, lambda v: (
            F.when(F.regexp_like(as_string(v), F.lit(plain)), capture(as_string(v), plain, index)).cast("variant"),
            F.when(~is_string(v), TYPE).when(~F.regexp_like(as_string(v), F.lit(plain)), PARSE)))
    if op == "enum_map":
        table = F.create_map(*[F.lit(x) for kv in rule["mapping"].items() for x in kv])

        def key(v):
            kind = F.schema_of_variant(v)
            return F.when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string"))).when(F.is_variant_null(v), "None").otherwise(F.try_variant_get(v, "$", "string"))

        unknown = rule.get("unknown", "error")

        def one(v):
            hit = F.try_element_at(table, key(v))
            other = F.parse_json(F.lit("null")) if unknown == "null" else v
            return F.when(hit.isNotNull(), hit.cast("variant")).otherwise(other), F.when(hit.isNull() & F.lit(unknown == "error"), PARSE)

        return _each(state, one)
    if op == "join":
        strings = F.transform(state["v"], as_string)
        bad = F.exists(state["v"], lambda v: ~is_string(v))
        joined = F.array(F.array_join(strings, rule["separator"]).cast("variant"))
        done = F.struct(F.when(bad, state["v"]).otherwise(joined).alias("v"), F.when(bad, TYPE).alias("e"))
        return F.when(state["e"].isNotNull(), state).otherwise(done)
    if op in ("unique", "sort"):
        texts = F.when(state["e"].isNull(), F.transform(state["v"], lambda v: F.to_json(v)))
        new = (distinct_list if op == "unique" else order_list)(texts)
        done = F.struct(F.transform(new, lambda t: F.parse_json(t)).alias("v"), F.lit(None).cast("string").alias("e"))
        return F.when(state["e"].isNotNull(), state).otherwise(done)
    raise FieldtraceError("CAPABILITY_UNSUPPORTED", op)


def run(df: DataFrame, values: Column, rules: list[dict], name: str, source_url: Column | None = None) -> DataFrame:
    """``df`` with the state ``name`` after all rules.

    Each step is a column of its own, so no expression is evaluated or
    planned more than once.
    """
    df = df.withColumn(f"{name}__0", start(values))
    for k, rule in enumerate(rules):
        df = df.withColumn(f"{name}__{k + 1}", apply(F.col(f"`{name}__{k}`"), rule, source_url))
    last = f"{name}__{len(rules)}"
    return df.withColumn(name, F.col(f"`{last}`")).drop(*[f"{name}__{k}" for k in range(len(rules) + 1)])
