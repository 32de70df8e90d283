import json

import pytest

from postlode.operators import nested as N

SCHEMA = "mail_id bigint, captured_at timestamp, record_json string, MAIL string"


def paths(record):
    return [(k, p, up) for k, p, up, *_ in N.objects_of(record)]


def test_children_positions_and_odd_containers():
    record = {
        "subject": "s", "recipients": [{"properties": {"a": 1}}, None, 5, {}], "properties": {"id": 1},
        "attachments": [{"embedded": json.dumps({"recipients": [{}], "attachments": [{"embedded": {"x": 1}}]})}, {"embedded": "no json"}, {"embedded": [1]}], "other": {"recipients": [{}]},
    }
    assert paths(json.dumps(record)) == [
        ("mail", "$", ""),
        ("recipient", "$.recipients[0]", "$"), ("recipient", "$.recipients[3]", "$"),
        ("attachment", "$.attachments[0]", "$"), ("attachment", "$.attachments[1]", "$"), ("attachment", "$.attachments[2]", "$"),
        ("property", "$.properties[0]", "$"), ("property", "$.recipients[0].properties[0]", "$.recipients[0]"),
        ("mail", "$.attachments[0].embedded", "$.attachments[0]"),
        ("recipient", "$.attachments[0].embedded.recipients[0]", "$.attachments[0].embedded"), ("attachment", "$.attachments[0].embedded.attachments[0]", "$.attachments[0].embedded"),
        ("mail", "$.attachments[0].embedded.attachments[0].embedded", "$.attachments[0].embedded.attachments[0]"),
    ]


@pytest.mark.parametrize("text", ["", "{", "[]", "null", "5", '"x"', '{"a":1,}', '{"a":NaN}', '{"a":1} x', "{'a':1}", '{"recipients":[{},]}', '{"a":"\t"}', '{"a" 1}', "{,}"])
def test_not_a_mail(text):
    assert paths(text) == []
    with pytest.raises(ValueError):
        if isinstance(N._parse_deep(text), (dict, list, str, int, type(None))) and text in ("[]", "null", "5", '"x"'):
            raise ValueError


@pytest.mark.parametrize("text", ['{"a":[1,-2.5e3,true,false,null,"\\u00e9\\n"],"b":{"c":[]},"d":{}}', " [ { } , [ ] , 0 ] ", '"x"', "12"])
def test_the_deep_parser_agrees(text):
    assert N._parse_deep(text) == json.loads(text)


def test_any_depth_and_long_numbers():
    deep = '{"attachments":{"embedded":' * 20_000 + "{}" + "}}" * 20_000
    assert len(paths(deep)) == 40_001
    assert len(paths('{"x":' + "9" * 6000 + ',"recipients":[{}]}')) == 2
    assert len(paths('{"x":' + "[" * 50_000 + "]" * 50_000 + "}")) == 1


def test_identities():
    a = N.objects_of('{"recipients":[{"b":1,"a":2},{"a":2,"b":1},{"a":2,"b":1,"properties":[{"p":1}]}],"properties":[{"a":2,"b":1}]}')
    ids = {p: i for _, p, _, _, _, i, _, _ in a}
    assert ids["$.recipients[0]"] == ids["$.recipients[1]"] != ids["$.recipients[2]"] and ids["$.properties[0]"] != ids["$.recipients[0]"]
    b = N.objects_of('{"recipients":[{"a":2,"b":1},{"a":2,"b":1},{"a":2,"b":1,"properties":[{"p":2}]}]}')
    assert a[0][5] != b[0][5]  # a difference below shows above


def test_latest_tables_and_objects(spark):
    import datetime as dt

    t = lambda n: dt.datetime(2025, 1, n)
    rows = [(1, t(1), '{"recipients":[{"a":1}]}', "x"), (1, t(2), '{"recipients":[{"display_name":"N","k":1},{"display_name":"N","k":1}]}', "x"), (1, t(2), '{"recipients":[{"display_name":"N","k":1},{"display_name":"N","k":1}]}', "x"),
            (2, t(1), "{}", None), (2, t(3), None, None), (3, None, "{}", None), (None, t(1), "{}", None), (4, t(1), "{bad", None)]
    latest = N.latest_records(spark.createDataFrame(rows, SCHEMA))
    o = N.occurrences(latest)
    assert sorted((r.mail_id, r.node_path) for r in o.collect()) == [(1, "$"), (1, "$.recipients[0]"), (1, "$.recipients[1]"), (3, "$")]
    stored = N.stored_objects(o).where("node_kind = 'recipient'").collect()
    assert len(stored) == 1 and stored[0].occurrences == 2
    assert [r.display_name for r in N.flat_table(o, "recipient", ("display_name",)).collect()] == ["N", "N"]
    back = N.bridge(o).where("node_kind = 'recipient'").join(N.stored_objects(o), "object_id").count()
    assert back == 2
    assert N.occurrences(N.latest_records(spark.createDataFrame([], SCHEMA))).count() == 0


ODD = [
    '{"recipients": [1, {"properties": {"a": 1}}, null, {}], "attachments": {"embedded": {"subject": "x", "attachments": []}}}',
    '{"recipients": [], "attachments": null, "properties": "none", "x": {"recipients": [{}]}}',
    '{"attachments": [{"embedded": {"attachments": [{"embedded": null, "properties": [[1], "t"]}]}}, {"embedded": 5}]}',
    '{}',
]


@pytest.mark.parametrize("text", ODD)
def test_a_record_is_put_together_again(text):
    rows = [(path, up, relation, ordinal, own) for _, path, up, relation, ordinal, _, _, own in N.objects_of(text)]
    assert N.rebuilt(rows) == N.parse(text)


def test_objects_that_differ_in_what_is_no_child_have_other_identities():
    ids = [N.objects_of(f'{{"recipients": {v}}}')[0][5] for v in ("null", "[]", '["a"]', '["b"]', '[{}]', "{}", '[{}, null]', '"a"')]
    assert len(set(ids)) == len(ids) and N.objects_of("{}")[0][5] not in ids


def test_unfolding_gives_every_place_back(spark):
    rows = [(k, None, t) for k, t in enumerate(ODD)] + [(9, None, ODD[0])]
    o = N.occurrences(N.latest_records(spark.createDataFrame(rows, "mail_id bigint, captured_at timestamp, record_json string")))
    back: dict = {}
    for r in N.unfolded(N.bridge(o), N.stored_objects(o)).collect():
        back.setdefault(r.mail_id, []).append((r.node_path, r.parent_path, r.relation, r.ordinal, r.content))
    assert {k: N.rebuilt(v) for k, v in back.items()} == {k: N.parse(t) for k, _, t in rows}
