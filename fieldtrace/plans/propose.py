"""Recipe proposals: schema leaves matched to what a sample snapshot offers.

A proposal works on one snapshot of bounded size, so it runs on the driver; the
recipe that comes out is a DataFrame plan like any other.
"""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from fieldtrace.errors import FieldtraceError
from fieldtrace.functions import canon, dom
from fieldtrace.plans.recipe import Field, Locator, Recipe, Scope
from fieldtrace.plans.validate import check_schema

#: Least similarity of two names.
CLOSE = 0.6
_TEXT = ({"op": "strip"}, {"op": "collapse_whitespace"}, {"op": "unicode_nfc"})


@dataclass(frozen=True)
class Leaf:
    pointer: str
    name: str
    kind: str
    required: bool
    many: bool = False


@dataclass(frozen=True)
class Proposal:
    recipe: Recipe | None
    unmapped: tuple[str, ...]


def ratio(a: str, b: str) -> float:
    """Similarity of two names, 0 to 1."""
    return SequenceMatcher(None, a.casefold(), b.casefold()).ratio()


@pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` of two columns; null if either is null."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _escape(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def schema_leaves(schema: dict) -> list[Leaf]:
    """Scalar (or scalar array) members in sorted order; required if all above are."""
    check_schema(schema)
    out: list[Leaf] = []

    def walk(node: dict, pointer: str, needed: bool) -> None:
        for name in sorted(node.get("properties", {})):
            child = node["properties"][name]
            at, must = f"{pointer}/{_escape(name)}", needed and name in node.get("required", [])
            kind = child.get("type") if isinstance(child, dict) else None
            if kind == "object":
                walk(child, at, must)
            elif kind == "array" and isinstance(child.get("items"), dict) and child["items"].get("type") in ("string", "number", "integer", "boolean"):
                out.append(Leaf(at, name, child["items"]["type"], must, True))
            elif kind in ("string", "number", "integer", "boolean"):
                out.append(Leaf(at, name, kind, must))
            else:
                raise FieldtraceError("CAPABILITY_UNSUPPORTED", at)

    walk(schema, "", True)
    return out


def _closest(name: str, offers: list[str]) -> str | None:
    """The most similar offer if similar enough; ties go to the first in order."""
    ranked = sorted(((-ratio(name.replace("_", ""), o.replace("_", "")), o) for o in offers))
    best = ranked[0][1] if ranked else None
    return best if best is not None and ratio(name, best) >= CLOSE else None


def _json_roots(value) -> tuple[Scope, list[dict]]:
    if isinstance(value, list):
        return Scope("items_path", "$[*]"), [v for v in value if isinstance(v, dict)]
    if isinstance(value, dict):
        lists = [k for k, v in value.items() if isinstance(v, list) and v and all(isinstance(x, dict) for x in v)]
        if len(lists) == 1 and lists[0].replace("-", "_").isidentifier():
            return Scope("items_path", f"$.{lists[0]}[*]"), value[lists[0]]
        return Scope("one_per_resource"), [value]
    raise FieldtraceError("SNAPSHOT_INVALID", "no object to map")


def _html_locator(tree: dom.Node, leaf: Leaf) -> Locator | None:
    for selector in (f'[itemprop="{leaf.name}"]', "h1" if leaf.name in ("name", "title") else None, f'[data-field="{leaf.name}"]'):
        if selector and dom.select(tree, selector):
            return Locator("css_text", selector)
    return None


def propose(snapshot: str, mode: str, schema: dict, source_id: str, identity: tuple[str, ...]) -> Proposal:
    """A recipe for ``snapshot`` and the required members nothing was found for.

    Without a recipe a person has to help: a required member or an identity
    member stayed unmapped. A member is required if the schema or the identity
    says so.
    """
    leaves = [Leaf(x.pointer, x.name, x.kind, x.required or x.pointer in identity, x.many) for x in schema_leaves(schema)]
    fields: dict[str, Field] = {}
    if mode == "json":
        scope, rows = _json_roots(canon.loads_strict(snapshot))
        offers = sorted({k for row in rows for k in row})
        for x in leaves:
            key = _closest(x.name, offers)
            if key is None:
                continue
            if x.many:
                if key.replace("-", "_").isidentifier():
                    fields[x.pointer] = Field(Locator("json_path", f"$.{key}[*]"), "many", (), x.required)
            else:
                fields[x.pointer] = Field(Locator("json_pointer", f"/{_escape(key)}"), "one", (), x.required)
    elif mode in ("html", "browser"):
        scope, tree = Scope("one_per_resource"), dom.parse(snapshot)
        for x in leaves:
            locator = _html_locator(tree, x)
            if locator:
                number = ({"op": "parse_decimal", "decimal_separator": "."},) if x.kind in ("number", "integer") else ()
                fields[x.pointer] = Field(locator, "many" if x.many else "one", (*_TEXT, *number), x.required)
    elif mode == "pdf":
        scope, value = Scope("one_per_document"), canon.loads_strict(snapshot)
        labels = sorted({b["label"] for b in value.get("blocks", []) if isinstance(b.get("label"), str)})
        for x in leaves:
            label = _closest(x.name, labels)
            if label is not None:
                fields[x.pointer] = Field(Locator("labeled_value", label), "many" if x.many else "one", (), x.required)
    else:
        raise FieldtraceError("CAPABILITY_UNSUPPORTED", mode)
    missing = tuple(sorted({x.pointer for x in leaves if x.required and x.pointer not in fields} | {p for p in identity if p not in fields}))
    return Proposal(None if missing else Recipe(source_id, mode, scope, fields, identity, schema), missing)
