import json

from fieldtrace import cli

RECIPE = {"source_id": "tools", "mode": "json", "scope": {"type": "items_path", "value": "$.rows[*]"}, "identity": ["/code"], "schema": {"type": "object"},
          "fields": {"/code": {"locator": {"type": "json_pointer", "value": "/code"}, "required": True}, "/mass": {"locator": {"type": "json_pointer", "value": "/mass"}}}}


def files(tmp_path, rows, recipe=RECIPE):
    (tmp_path / "r.json").write_text(json.dumps(recipe))
    (tmp_path / "p.json").write_text(json.dumps({"rows": rows}))
    return str(tmp_path / "r.json"), str(tmp_path / "p.json"), str(tmp_path / "out.json")


def test_extract_and_replay(spark, tmp_path, capsys):
    r, p, out = files(tmp_path, [{"code": "Z", "mass": 2}, {"code": "B", "mass": 1}, {"code": "B", "mass": 1}])
    assert cli.main(["extract", r, p, "--output", out], spark) == 0
    told = json.loads((tmp_path / "out.json").read_text())
    assert len(told["records"]) == 2 and told["quarantined"] == []
    ids = [x["record_id"] for x in told["records"]]
    assert ids == sorted(ids)
    # both instances of one identity keep their evidence in the merged record
    assert sorted(len(x["evidence"]) for x in told["records"]) == [2, 4]
    assert cli.main(["replay", r, p, out], spark) == 0
    (tmp_path / "p.json").write_text(json.dumps({"rows": []}))
    assert cli.main(["replay", r, p, out], spark) == 2 and "SNAPSHOT_CORRUPT" in capsys.readouterr().err


def test_quarantine_and_refusals(spark, tmp_path, capsys):
    r, p, out = files(tmp_path, [{"code": "B", "mass": 1}, {"code": "B", "mass": 2}, {"mass": 3}])
    assert cli.main(["extract", r, p, "--output", out], spark) == 1
    told = json.loads((tmp_path / "out.json").read_text())
    assert told["records"] == [] and [x["errors"] for x in told["quarantined"]] == [["IDENTITY_CONFLICT"], ["IDENTITY_CONFLICT"], ["/code:LOCATOR_ZERO", "IDENTITY_MISSING"]]
    assert cli.main(["validate", r]) == 0 and cli.main(["schema"]) == 0
    bad = {**RECIPE, "mode": "pdf", "scope": {"type": "one_per_document"}}  # that mode takes labelled values only
    r, _, _ = files(tmp_path, [], bad)
    assert cli.main(["validate", r]) == 2
    r, _, _ = files(tmp_path, [], {**RECIPE, "colour": 1})
    assert cli.main(["validate", r]) == 2 and cli.main(["validate", str(tmp_path / "none.json")]) == 2
    assert "VALIDATION_FAILED" in capsys.readouterr().err
