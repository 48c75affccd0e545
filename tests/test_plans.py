"""Schema readers, units and quotas."""

import pytest

from siltstone.plans import schema as s
from siltstone.plans.quota import parse_quota
from siltstone.plans.units import code, decompose, name_list, stripped, yields

WORK = {
    "type": "object",
    "properties": {
        "basic": {"type": ["object", "null"], "description": "Basics\nmore", "properties": {"name": {"type": "string", "description": "姓名"}, "married": {"type": "boolean"}}, "required": ["name"]},
        "work": {"type": "array", "description": "Jobs", "items": {"type": "object", "required": ["company", "subs"], "properties": {"company": {"type": "string"}, "whole": {"type": "string", "x-override": "subs"}, "subs": {"type": "array", "items": {"type": "object", "properties": {"title": {"type": "string"}, "deep": {"type": "array"}}}}}}},
        "tags": {"type": "array", "items": {"type": "string"}},
        "when": {"type": "string", "format": "date", "description": "Day"},
    },
}


def test_units():
    units = {u.path: u for u in decompose(WORK)}
    assert list(units) == ["basic", "work", "work.subs", "tags", "$misc"]
    assert units["basic"].card == "[basic | object] Basics\n  more\n  name 姓名 · married (boolean)"
    assert units["basic"].header == "[basic | object] Basics"
    assert units["work"].contract["required"] == ["company"] and "subs" not in units["work"].contract["properties"]
    assert units["work.subs"].parent == "work" and units["work.subs"].field == "subs" and "deep" in units["work.subs"].contract["properties"]
    assert units["tags"].card == "[tags | array]" and units["$misc"].card == "[$misc | scalar] when Day(date)"
    assert yields(units["work"], {"subs"}) == {"subs": {"whole"}} and yields(units["work"], set()) == {}
    less = stripped(units["work"], {"whole"})
    assert less.card == "[work | array] Jobs\n  per item: company" and list(less.contract["properties"]) == ["company"]
    assert stripped(less, {"company"}).card == "[work | array] Jobs\n  per item:"
    assert decompose({}) == [] and not name_list(units["work"])


def test_codes():
    assert [code(n) for n in (0, 25, 26, 27, 701, 702)] == ["a", "z", "aa", "ab", "zz", "aaa"]


def test_readers():
    prop = {"anyOf": [{"type": "string", "format": "date", "enum": ["x", ""]}, {"enum": ["", "y", "x"]}], "enum": [1]}
    assert s.options(prop) == ["1", "x", "date", "y"] and len(s.branches(prop)) == 2 and s.branches({"type": "a"}) == [{"type": "a"}]
    nested = {"properties": {"a": {"properties": {"b": {}}, "items": {"properties": {"c": {}}}, "anyOf": [{"properties": {"b": {}}}]}}}
    assert [p for p, _ in s.fields(nested)] == ["a", "a.b", "a.c", "a.b"]
    assert s.label({"type": "string", "description": "Duty： do"}) == "Duty" and s.label({"type": ["string", "null"]}) is None
    assert [s.copy_ratio({"x-verbatim": v}) for v in (0.5, True, 0, 2, "0.8", "no")] == [0.5, 1.0, 0.9, 0.9, 0.8, 0.9] and s.copy_ratio({}) is None
    shown = s.shown({"description": "d", "x-verbatim": 1, "x-override": "o", "items": [{"x-verbatim": 1}]})
    assert shown == {"description": "d @verbatim", "items": [{"description": "@verbatim"}]}
    assert s.leaf_chars({"a": "xy", "b": [None, True, 12]}) == 2 + 4 + 4 + 2
    assert s.provenance(None) == "default" and len(s.provenance("t")) == 9
    with pytest.raises(ValueError):
        s.require_slots("no {x}", ["card"], "t")


def test_quota():
    assert parse_quota("8|rpm:30|tpm:600|burst:0").calls_per_second == 0.5 and parse_quota(8).concurrency == 8
    assert parse_quota("8|rps:4").share(4).calls_per_second == 1
    for wrong in ("rps:1", "0", "8|rpm:1|rps:1", "8|tpm:1|tps:1", "8|x:1", "a"):
        with pytest.raises(ValueError):
            parse_quota(wrong)
