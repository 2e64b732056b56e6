"""A subset of JSON Schema (2020-12), failing closed on other keywords."""

from __future__ import annotations

from fieldtrace.errors import FieldtraceError
from fieldtrace.functions import canon

_KINDS = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "integer": lambda v: (isinstance(v, int) and not isinstance(v, bool)) or (isinstance(v, float) and v.is_integer()),
}
KEYWORDS = {
    "type", "properties", "required", "additionalProperties", "items", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength",
    "minItems", "maxItems", "uniqueItems", "minProperties", "maxProperties", "title", "description", "default", "examples", "format", "$schema", "$id", "$comment",
}

#: Keywords that hold lists of schemas, and single ones.
_LISTS, _SINGLE = ("allOf", "anyOf", "oneOf", "prefixItems"), ("not", "if", "then", "else", "contains", "propertyNames")
KEYWORDS |= {*_LISTS, *_SINGLE, "minContains", "maxContains", "dependentRequired"}


def check_schema(schema, depth: int = 0) -> None:
    """Refuses unknown keywords, deep nesting and a root that isn't an object."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict) or depth > 24 or (depth == 0 and schema.get("type") != "object"):
        raise FieldtraceError("VALIDATION_FAILED", "schema")
    if not schema.keys() <= KEYWORDS:
        raise FieldtraceError("CAPABILITY_UNSUPPORTED", str(sorted(schema.keys() - KEYWORDS)))
    for s in schema.get("properties", {}).values():
        check_schema(s, depth + 1)
    for k in ("items", "additionalProperties", *_SINGLE):
        if k in schema:
            check_schema(schema[k], depth + 1)
    for k in _LISTS:
        if k in schema:
            if not isinstance(schema[k], list) or not schema[k]:
                raise FieldtraceError("VALIDATION_FAILED", k)
            for s in schema[k]:
                check_schema(s, depth + 1)


def _same(a, b) -> bool:
    return type(a) is not bool and type(b) is not bool and isinstance(a, (int, float)) and isinstance(b, (int, float)) and a == b or canon.canonical(a) == canon.canonical(b)


def _fits(value, schema) -> bool:
    return next(failures(value, schema), None) is None


def _combined(value, schema, path: str):
    """Pointers from the keywords that combine schemas."""
    here = path or "/"
    for s in schema.get("allOf", []):
        yield from failures(value, s, path)
    if "anyOf" in schema and not any(_fits(value, s) for s in schema["anyOf"]):
        yield here
    if "oneOf" in schema and sum(_fits(value, s) for s in schema["oneOf"]) != 1:
        yield here
    if "not" in schema and _fits(value, schema["not"]):
        yield here
    if "if" in schema:
        yield from failures(value, schema.get("then" if _fits(value, schema["if"]) else "else", True), path)


def failures(value, schema, path: str = ""):
    """Pointers of the members that break the schema, one per broken keyword."""
    if schema is True or schema == {}:
        return
    if schema is False:
        yield path or "/"
        return
    here = path or "/"
    kinds = schema.get("type")
    if kinds is not None and not any(_KINDS[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        yield here
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        yield here
    if "const" in schema and not _same(value, schema["const"]):
        yield here
    yield from _combined(value, schema, path)
    if _KINDS["number"](value):
        for k, broken in (("minimum", lambda a, b: a < b), ("maximum", lambda a, b: a > b), ("exclusiveMinimum", lambda a, b: a <= b), ("exclusiveMaximum", lambda a, b: a >= b), ("multipleOf", lambda a, b: (a / b) % 1 != 0)):
            if k in schema and broken(value, schema[k]):
                yield here
    sized = {str: ("minLength", "maxLength"), list: ("minItems", "maxItems"), dict: ("minProperties", "maxProperties")}.get(type(value))
    if sized:
        least, most = sized
        if len(value) < schema.get(least, 0) or len(value) > schema.get(most, len(value)):
            yield here
    if isinstance(value, list):
        if schema.get("uniqueItems") and len({canon.canonical(x) for x in value}) != len(value):
            yield here
        first = schema.get("prefixItems", [])
        for k, (x, s) in enumerate(zip(value, first)):
            yield from failures(x, s, f"{path}/{k}")
        if "items" in schema:
            for k, x in enumerate(value[len(first):], len(first)):
                yield from failures(x, schema["items"], f"{path}/{k}")
        if "contains" in schema:
            n = sum(_fits(x, schema["contains"]) for x in value)
            if not schema.get("minContains", 1) <= n <= schema.get("maxContains", n):
                yield here
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                yield here
        if any(name in value and not set(needed) <= value.keys() for name, needed in schema.get("dependentRequired", {}).items()):
            yield here
        if "propertyNames" in schema and not all(_fits(k, schema["propertyNames"]) for k in value):
            yield here
        rest = [k for k in value if k not in known]
        extra = schema.get("additionalProperties", True)
        if extra is False and rest:
            yield here
        for k, v in value.items():
            if k in known:
                yield from failures(v, known[k], f"{path}/{k}")
            elif isinstance(extra, dict):
                yield from failures(v, extra, f"{path}/{k}")


_VARIANT_KINDS = {"string": ("STRING",), "boolean": ("BOOLEAN",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")}
_NATIVE = {"type", "properties", "required", "additionalProperties", "title", "description", "$schema", "$id", "$comment"}
_NATIVE_MEMBER = {"type", "minLength", "maxLength", "minimum", "maximum", "title", "description"}


def native_checks(schema: dict, ready: dict):
    """The schema as column expressions, or None if it needs the general check.

    ``ready``: top-level member -> variant column, null where missing. Covers
    flat schemas with scalar members, their types, lengths and bounds.
    """
    from pyspark.sql import functions as F

    members = schema.get("properties", {})
    if not schema.keys() <= _NATIVE or schema.get("additionalProperties", True) not in (True, False):
        return None
    if schema.get("additionalProperties", True) is False and not ready.keys() <= members.keys():
        return None
    if any(not isinstance(m, dict) or not m.keys() <= _NATIVE_MEMBER or m.get("type") not in (None, *_VARIANT_KINDS) for m in members.values()):
        return None
    checks = []
    for name in schema.get("required", []):
        checks.append(F.when(ready[name].isNull(), "/:VALIDATION_FAILED") if name in ready else F.lit("/:VALIDATION_FAILED"))
    for name, m in members.items():
        if name not in ready:
            continue
        value = ready[name]
        kind = F.schema_of_variant(value)
        text, number = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")), F.when(kind != "STRING", F.try_variant_get(value, "$", "double"))
        broken = F.lit(False)
        if "type" in m:
            fits = F.lit(False)
            for k in _VARIANT_KINDS[m["type"]]:
                fits = fits | kind.startswith(k)
            if m["type"] == "integer":
                fits = fits | F.coalesce((F.try_variant_get(value, "$", "double") % 1 == 0) & (kind != "STRING") & (kind != "BOOLEAN"), F.lit(False))
            broken = broken | ~fits
        for key, test in (("minLength", lambda x: F.length(text) < x), ("maxLength", lambda x: F.length(text) > x), ("minimum", lambda x: number < x), ("maximum", lambda x: number > x)):
            if key in m:
                broken = broken | F.coalesce(test(m[key]), F.lit(False))
        checks.append(F.when(value.isNotNull() & broken, f"/{name}:VALIDATION_FAILED"))
    return checks
