import json

from pyspark.sql import functions as F

from conftest import DATA
from lamella.operators import shred
from lamella.plans import general
from lamella.plans.tables import table

SCHEMA = "record_id bigint, body string"


def entries(spark, *bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), SCHEMA)
    return sorted((r["record_id"], r["entry_path"], r["parent_path"], r["kind"], r["media_type"], r["architecture"], r["revision"]) for r in shred.manifest_entries(shred.manifest_nodes(df)).collect())


def test_nested_entries_and_shapes(spark):
    body = {
        "manifests": [None, {"mediaType": "m", "platform": {"architecture": "arm"}, "annotations": {shred.REVISION: "r", "revision": "no"}, "layers": {"mediaType": None, "config": {"mediaType": 5}}}],
        "config": [{"mediaType": "not an entry"}],
        "layers": [[{"mediaType": "nor this"}], "x", {"mediaType": {"a": 1}, "platform": "arm", "annotations": ["y"]}],
        "extra": {"config": {"mediaType": "nor that"}},
    }
    assert entries(spark, json.dumps(body)) == [
        (0, "layers/2", "", "layers", "", "", ""),
        (0, "manifests/1", "", "manifests", "m", "arm", "r"),
        (0, "manifests/1/layers/0", "manifests/1", "layers", "", "", ""),
        (0, "manifests/1/layers/0/config", "manifests/1/layers/0", "config", "5", "", ""),
    ]


def test_names_cannot_imitate_paths(spark):
    assert entries(spark, json.dumps({"manifests": {"0": {"mediaType": "a"}}, "manifests#1": {"mediaType": "b"}, "layers/0": {"mediaType": "c"}})) == [(0, "manifests/0", "", "manifests", "", "", "")]


def test_unusable_bodies(spark):
    bad = [None, "", "  ", "null", "[]", '"x"', '{"config":{}', '{"config":{}} x', "{'config':{}}", '{"config":{},}', '{"config":{"a":NaN}}', "﻿{}", '{"config":{"a":"\n"}}']
    assert entries(spark, *bad) == []
    assert entries(spark) == []
    assert entries(spark, ' \n{"config":{}}\t ') == [(0, "config", "", "config", "", "", "")]


def test_depth_beyond_recursion(spark):
    depth = 20_000
    text = '{"config":' * depth + "{}" + "}" * depth
    value = shred.parse_object(text)
    assert sum(1 for _ in shred.nodes_of({"manifests": json.loads("{}")})) == 2 and value is not None
    assert shred.parse_object(text[:-1]) is None and shred.parse_object(text + "}") is None
    nested = '{"manifests":[' * 1500 + "{}" + "]}" * 1500
    assert len(entries(spark, nested)) == 1500


def test_deep_parser_agrees_with_json():
    good = ['{"a":[1,2.5e3,-0,true,false,null,"x\\u00e9\\n",{}],"b":{"c":[]}}', "{}", '{ "a" : [ [ ] ] }', '{"a":1,"a":2}']
    bad = ['{"a":}', '{"a" 1}', '{"a":1 "b":2}', "{,}", '{"a":[1,]}', '{"a":01}', '{"a":1}}', '{"a":"\t"}', "{1:2}", '{"a":tru}', '{"a"}', "", '{"a":[}']
    for text in good:
        assert json.loads(json.dumps(shred._parse_deep(text))) == json.loads(text, parse_int=str, parse_float=str)
    for text in bad:
        try:
            shred._parse_deep(text)
        except ValueError:
            continue
        raise AssertionError(text)


def test_adjacency_links_surrogates_and_repeats(spark):
    df = spark.createDataFrame([(1, '{"a":{"b/c":["x",2]},"s":"\\ud800","d":1,"d":2}')] * 2 + [(None, '{"a":1}')], SCHEMA).withColumn("path", F.lit("clash"))
    rows = [r for r in shred.shred(df, "record_id", "body").collect() if r["record_id"] == 1]
    by_path = {r["path"]: r for r in rows}
    assert len(rows) == 2 * len(by_path)  # the adjacency table keeps one set a row
    assert by_path["a/b~1c#0"]["parent"] == by_path["a/b~1c"]["node"] and by_path["a/b~1c"]["parent"] == by_path["a"]["node"]
    assert by_path["a/b~1c#1"]["scalar"] == "2" and by_path["a/b~1c#1"]["kind"] == "number" and by_path["d"]["scalar"] == "2"
    assert "�" in by_path["s"]["scalar"]
    one = shred.manifest_entries(shred.manifest_nodes(spark.createDataFrame([(1, '{"config":{}}')] * 2, SCHEMA)))
    assert one.count() == 1


def test_whole_records_are_shredded(spark):
    def size(value):
        below = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
        return 1 + sum(size(x) for x in below)

    bodies = [shred.parse_object(r["body"]) for r in table(spark, DATA, "manifest_raw").collect()]
    nodes = general.QUERIES["p2_nodes"](spark, DATA)
    assert nodes.count() == sum(size(b) for b in bodies if b is not None)
    assert nodes.where("parent >= node").count() == 0 and nodes.where("parent = -1").count() == sum(b is not None for b in bodies)


def test_entities_are_joined_by_parent_numbers(spark):
    body = {"config": {"mediaType": "m", "annotations": {"k": "v", "n": 1, "o": {}, "z": None}, "platform": {"os": "linux", "variant": None}}, "annotations": {"k": "of no entry"}, "layers": {"platform": [{"os": "x"}]}}
    nodes = shred.manifest_nodes(spark.createDataFrame([(1, json.dumps(body)), (1, json.dumps(body)), (2, "{}")], SCHEMA))
    # without any path, the links alone lead from scalars to the object that owns them
    blind = nodes.withColumn("path", F.lit(""))
    found = shred.entities(blind, F.col("label").isin("config", "layers"), {"media": ["mediaType"], "os": ["platform", "os"], "k": ["annotations", "k"], "deep": ["config", "platform", "os"]})
    assert sorted((r["label"], r["media"], r["os"], r["k"], r["deep"]) for r in found.collect()) == [("config", "m", "linux", "v", None), ("layers", None, None, None, None)]
    root = shred.properties(blind, {"deep": ["config", "platform", "os"]}).collect()
    assert [(r["record_id"], r["node"], r["deep"]) for r in root] == [(1, 0, "linux")]
    assert sorted((r["entry_path"], r["name"], r["value"]) for r in shred.entry_annotations(nodes).collect()) == [("config", "k", "v"), ("config", "n", "1")]
    assert [(r["entry_path"], r["os"], r["architecture"], r["variant"]) for r in shred.entry_platforms(nodes).collect()] == [("config", "linux", None, None)]
