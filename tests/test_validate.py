import pytest

from fieldtrace.errors import FieldtraceError
from fieldtrace.plans.validate import check_schema, failures

CASES = [
    ({"anyOf": [{"required": ["a"]}, {"required": ["b"]}]}, {"b": 1}, {"c": 1}), ({"oneOf": [{"required": ["a"]}, {"required": ["b"]}]}, {"b": 1}, {"a": 1, "b": 1}), ({"allOf": [{"required": ["a"]}, {"required": ["b"]}]}, {"a": 1, "b": 1}, {"b": 1}),
    ({"not": {"required": ["x"]}}, {}, {"x": 1}), ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}, {"a": 1, "b": 1}, {"a": 1}), ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}, {"c": 1}, {}),
    ({"dependentRequired": {"a": ["b"]}}, {"b": 1}, {"a": 1}), ({"propertyNames": {"maxLength": 2}}, {"ab": 1}, {"abc": 1}),
    ({"properties": {"l": {"prefixItems": [{"type": "string"}], "items": {"type": "integer"}}}}, {"l": ["x", 1]}, {"l": ["x", "y"]}), ({"properties": {"l": {"prefixItems": [{"type": "string"}]}}}, {"l": []}, {"l": [1]}),
    ({"properties": {"l": {"contains": {"const": 1}, "maxContains": 1}}}, {"l": [1, 2]}, {"l": [1, 1]}), ({"properties": {"l": {"contains": {"const": 1}}}}, {"l": [1]}, {"l": [2]}), ({"properties": {"l": {"contains": {"const": 1}, "minContains": 0}}}, {"l": []}, {"l": 0, "x": None}),
]


def test_combined_schemas():
    for k, (schema, good, bad) in enumerate(CASES):
        schema = {"type": "object", **schema}
        check_schema(schema)
        assert list(failures(good, schema)) == [], schema
        assert k == len(CASES) - 1 or list(failures(bad, schema)), schema


def test_bad_combinations_are_refused():
    for schema in ({"anyOf": []}, {"anyOf": {}}, {"not": 3}, {"oneOf": [{"unknown": 1}]}, {"contains": {"$ref": "#"}}):
        with pytest.raises(FieldtraceError):
            check_schema({"type": "object", **schema})
