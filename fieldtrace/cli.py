"""Command line over files: validate, extract, replay, schema.

    python -m fieldtrace.cli extract RECIPE PAGE [--source-url URL] [--workspace NAME] [--output FILE]

Exit codes: 0 done, 1 something was quarantined, 2 refused or failed (the
problem as JSON on the error stream). Recipes are JSON, or YAML where a YAML
reader is installed.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict, fields as members
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtrace.errors import FieldtraceError
from fieldtrace.functions import canon
from fieldtrace.plans import extract as E
from fieldtrace.plans.recipe import Field, Limits, Locator, Recipe, Scope


def read_document(path: str) -> dict:
    """One JSON or YAML object of a file."""
    text = Path(path).read_text(encoding="utf-8-sig")
    if Path(path).suffix.lower() in (".yaml", ".yml"):
        try:
            import yaml
        except ModuleNotFoundError as e:
            raise FieldtraceError("CAPABILITY_UNSUPPORTED", "no YAML reader is installed") from e
        told = yaml.safe_load(text)
    else:
        told = canon.loads_strict(text)
    if not isinstance(told, dict):
        raise FieldtraceError("VALIDATION_FAILED", path)
    return told


def _made(kind, given: dict, **inner):
    """A dataclass of a mapping; unknown members are refused."""
    unknown = given.keys() - {m.name for m in members(kind)}
    if unknown:
        raise FieldtraceError("VALIDATION_FAILED", f"{kind.__name__} has no {sorted(unknown)}")
    try:
        return kind(**{**given, **inner})
    except TypeError as e:
        raise FieldtraceError("VALIDATION_FAILED", str(e)) from e


def recipe_of(document: dict) -> Recipe:
    """The checked recipe that a document tells, in the shape of ``Recipe.as_json``."""
    try:
        told = {p: _made(Field, f, locator=_made(Locator, f["locator"]), transforms=tuple(f.get("transforms", ()))) for p, f in document["fields"].items()}
        return _made(Recipe, document, scope=_made(Scope, document["scope"]), fields=told, identity=tuple(document["identity"]), limits=_made(Limits, document.get("limits", {})))
    except (KeyError, AttributeError) as e:
        raise FieldtraceError("VALIDATION_FAILED", str(e)) from e


def result_of(page: DataFrame, recipe: Recipe, workspace: str) -> dict:
    """One page's result as a document: merged records with all evidence, sorted by id, then what is quarantined.

    A page has at most ``max_records`` records, so it may be one document.
    """
    rows = [r.asDict(recursive=True) for r in E.extract(page, recipe, workspace).collect()]
    good, bad = [r for r in rows if not r["errors"]], [r for r in rows if r["errors"]]
    grouped: dict[str, list[dict]] = {}
    for r in sorted(good, key=lambda r: r["index"]):
        grouped.setdefault(r["record_id"], []).append(r)
    records = []
    for key in sorted(grouped):
        group = grouped[key]
        if len({r["data_hash"] for r in group}) > 1:
            bad += [{**r, "errors": ["IDENTITY_CONFLICT"]} for r in group]
        else:
            records.append({**group[0], "evidence": [e for r in group for e in r["evidence"]]})
    told = {"records": records, "quarantined": sorted(bad, key=lambda r: (-1 if r["index"] is None else r["index"])), "recipe_hash": recipe.hash(), "snapshot_hash": rows[0]["snapshot_hash"] if rows else None}
    return {**told, "result_hash": canon.object_hash(told)}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="fieldtrace")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("validate").add_argument("recipe")
    commands.add_parser("schema", help="the members of a recipe with their defaults")
    for name in ("extract", "replay"):
        one = commands.add_parser(name)
        one.add_argument("recipe")
        one.add_argument("page")
        if name == "replay":
            one.add_argument("expected")
        one.add_argument("--source-url", default="")
        one.add_argument("--workspace", default="default")
        one.add_argument("--output")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        if args.command == "schema":
            print(json.dumps({"Recipe": [m.name for m in members(Recipe)], "Field": [m.name for m in members(Field)], "Locator": [m.name for m in members(Locator)], "Scope": [m.name for m in members(Scope)], "Limits": asdict(Limits())}, indent=2))
            return 0
        recipe = recipe_of(read_document(args.recipe))
        if args.command == "validate":
            print("The recipe is valid.")
            return 0
        body = Path(args.page).read_bytes()
        spark = spark or SparkSession.builder.appName("fieldtrace").getOrCreate()
        page = spark.createDataFrame([(args.source_url, bytearray(body))], "url string, body binary")
        if args.command == "replay":
            expected = read_document(args.expected)
            if page.select(F.sha2("body", 256)).first()[0] != expected.get("snapshot_hash"):
                raise FieldtraceError("SNAPSHOT_CORRUPT", args.page)
        result = result_of(page, recipe, args.workspace)
        if args.command == "replay" and result["result_hash"] != expected.get("result_hash"):
            raise FieldtraceError("REPLAY_MISMATCH", result["result_hash"])
        text = json.dumps(result, ensure_ascii=False, indent=2)
        if args.output:
            Path(args.output).write_text(text + "\n", encoding="utf-8")
        else:
            print(text)
        return 1 if result["quarantined"] else 0
    except (ValueError, OSError) as e:
        print(json.dumps({"code": getattr(e, "code", "FAILED"), "error": str(e)}, ensure_ascii=False), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
