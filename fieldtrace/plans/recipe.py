"""Declarative extraction recipes and their checks (before any plan is made)."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, replace

from fieldtrace.errors import FieldtraceError
from fieldtrace.functions import canon
from fieldtrace.functions.dom import compile_selector
from fieldtrace.functions.paths import pointer_parts

# What each mode allows, and the parameters of each transform.
LOCATORS = {"json": {"json_pointer", "json_path"}, "html": {"css_text", "css_attr", "jsonld"}, "browser": {"css_text", "css_attr", "jsonld"}, "pdf": {"labeled_value"}}
SCOPES = {"json": {"one_per_resource", "items_path"}, "html": {"one_per_resource", "container_selector"}, "browser": {"one_per_resource", "container_selector"}, "pdf": {"one_per_document"}}
OPS = {
    "strip": set(), "collapse_whitespace": set(), "unicode_nfc": set(), "join": {"separator"}, "parse_decimal": {"decimal_separator", "grouping_separator"}, "parse_date": {"format"},
    "resolve_url": set(), "enum_map": {"mapping", "unknown"}, "unique": set(), "sort": set(), "regex_capture": {"pattern", "group"},
}
MAX_FIELDS, MAX_TRANSFORMS, MAX_POINTER_DEPTH, MAX_POINTER_CHARS = 256, 20, 24, 1024


@dataclass(frozen=True)
class Locator:
    type: str
    value: str
    attribute: str | None = None


@dataclass(frozen=True)
class Field:
    locator: Locator
    cardinality: str = "one"
    transforms: tuple[dict, ...] = ()
    required: bool = False


@dataclass(frozen=True)
class Scope:
    type: str
    value: str | None = None


@dataclass(frozen=True)
class Limits:
    max_records: int = 5_000
    max_bytes: int = 10_000_000
    max_pages: int = 100


@dataclass(frozen=True)
class Recipe:
    source_id: str
    mode: str
    scope: Scope
    fields: dict[str, Field]
    identity: tuple[str, ...]
    schema: dict = field(default_factory=lambda: {"type": "object"})
    limits: Limits = Limits()

    def __post_init__(self):
        check(self)

    def as_json(self) -> dict:
        return asdict(self)

    def hash(self) -> str:
        return canon.object_hash(self.as_json())

    def with_fields(self, **fields) -> Recipe:
        return replace(self, fields={**self.fields, **fields})


def _refuse(detail: str):
    raise FieldtraceError("VALIDATION_FAILED", detail)


def check_transform(rule: dict) -> None:
    op = rule.get("op")
    if op not in OPS:
        raise FieldtraceError("CAPABILITY_UNSUPPORTED", str(op))
    given = rule.keys() - {"op"}
    if not given <= OPS[op]:
        _refuse(f"{op} takes no {sorted(given - OPS[op])}")
    needed = {"join": {"separator"}, "parse_decimal": {"decimal_separator"}, "parse_date": {"format"}, "enum_map": {"mapping"}, "regex_capture": {"pattern"}}.get(op, set())
    if not needed <= given:
        _refuse(f"{op} needs {sorted(needed)}")
    if op == "parse_decimal" and rule.get("grouping_separator") == rule["decimal_separator"]:
        _refuse("separators must differ")
    if op == "regex_capture" and (re.search(r"\(\?(?!P<)", rule["pattern"]) or re.search(r"\\[1-9]", rule["pattern"])):
        _refuse("pattern uses lookaround, flags or back references")


def check(recipe: Recipe) -> None:
    """Mode, locators, pointers, transforms and identity must fit together."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", recipe.source_id):
        _refuse("source_id")
    if recipe.mode not in LOCATORS or recipe.scope.type not in SCOPES[recipe.mode]:
        _refuse("scope doesn't fit the mode")
    if (recipe.scope.value is None) != (recipe.scope.type in ("one_per_resource", "one_per_document")):
        _refuse("scope value")
    if recipe.scope.type == "container_selector":
        compile_selector(recipe.scope.value)
    if not 1 <= len(recipe.fields) <= MAX_FIELDS:
        _refuse("number of fields")
    parts = {}
    for pointer, rule in recipe.fields.items():
        parts[pointer] = pointer_parts(pointer)
        if len(pointer) > MAX_POINTER_CHARS or len(parts[pointer]) > MAX_POINTER_DEPTH:
            _refuse(pointer)
        if rule.locator.type not in LOCATORS[recipe.mode]:
            _refuse(f"{rule.locator.type} in mode {recipe.mode}")
        if (rule.locator.type == "css_attr") != (rule.locator.attribute is not None):
            _refuse("attribute")
        if rule.locator.type.startswith("css"):
            compile_selector(rule.locator.value)
        if rule.cardinality not in ("one", "many") or len(rule.transforms) > MAX_TRANSFORMS:
            _refuse(pointer)
        for t in rule.transforms:
            check_transform(t)
    paths = sorted(parts.values())
    if any(b[: len(a)] == a for a, b in zip(paths, paths[1:])):
        _refuse("field pointers overlap")
    if not recipe.identity or any(p not in recipe.fields or not recipe.fields[p].required for p in recipe.identity):
        _refuse("identity fields must be required fields")
