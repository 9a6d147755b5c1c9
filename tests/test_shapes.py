"""Documents, key-value entries and points."""

import json

from pyspark.sql import functions as F

from ledgerlift.operators import documents, keyvalue, points


def docs(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "doc string")


def test_document_types(spark):
    df = docs(
        spark, '{"_id":"a","n":1,"x":1,"m":1,"o":{"a":1},"l":[1],"b":true,"z":null}', '{"_id":"b","n":2,"x":1.5,"m":"t","z":null}'
    )
    assert {r["field"]: r["data_type"] for r in documents.infer_document_schema(df, "doc").collect()} == {
        "_id": "OBJECTID", "n": "BIGINT", "x": "DOUBLE", "m": "VARCHAR", "o": "JSON", "l": "TEXT", "b": "BOOLEAN", "z": "TEXT",
    }
    assert documents.infer_document_schema(df, "doc").first()["field"] == "_id"


def test_unusual_field_names(spark):
    df = docs(spark, '{"a b":{"x, y":[{"p":1.5}]},"c`d":"t","e<f":1,"plain":[1,"x"]}')
    assert documents.field_types(documents.infer_document_schema(df, "doc")) == {"a b": "JSON", "c`d": "VARCHAR", "e<f": "BIGINT", "plain": "TEXT"}
    assert documents.infer_document_schema(docs(spark, "[1]", "nonsense"), "doc").count() == 0
    mixed = docs(spark, '{"a":1}', "[1]", '"text"', "null", '{"a":2} junk', "{broken")
    assert documents.field_types(documents.infer_document_schema(mixed, "doc")) == {"a": "BIGINT"}
    assert [r["a"] for r in documents.read_documents(mixed, "doc", {"a": "BIGINT"}).collect()] == [1]
    assert sorted(r["reason"] for r in documents.document_rejects(mixed, "doc").collect()) == ["broken"] * 2 + ["not an object"] * 3


def test_documents_to_table_and_back(spark):
    df = docs(spark, '{"_id":"65a1b2c3d4e5f60718293a4b","n":1,"m":3,"o":{"a":{"b":[1,2]}},"s":"x\\"y"}', '{"_id":"k","n":null,"m":"t","s":"é"}')
    flat = documents.read_documents(df, "doc", documents.field_types(documents.infer_document_schema(df, "doc"))).orderBy("_id")
    rows = [r.asDict() for r in flat.collect()]
    assert rows[0] == {"_id": "65a1b2c3d4e5f60718293a4b", "m": "3", "n": 1, "o": '{"a":{"b":[1,2]}}', "s": 'x"y'}
    assert rows[1]["n"] is None and rows[1]["m"] == "t"
    built = [json.loads(r["doc"]) for r in documents.write_documents(flat, ["o"]).collect()]
    assert built[0]["_id"] == {"$oid": "65a1b2c3d4e5f60718293a4b"} and built[0]["o"] == {"a": {"b": [1, 2]}}
    assert built[1]["_id"] == "k"


def entries(spark, rows):
    return spark.createDataFrame(rows, "key string, type string, field string, member string, score double, seq long")


def test_large_keys_come_in_parts(spark):
    rows = [("big:1", t, f"f{i}", f"m{i}", float(i % 7), i) for t in ("hash", "list", "set", "zset") for i in range(1000)]
    rows = [(f"{k}{t}", t, *rest) for k, t, *rest in rows] + [("small", "set", None, m, None, 1) for m in "ba"]
    out = keyvalue.read_keyvalue(entries(spark, rows), part_rows=100).collect()
    assert [r["value"] for r in out if r["key"] == "small"] == ['["a","b"]']
    by_type = {t: [json.loads(r["value"]) for r in sorted(out, key=lambda r: r["part"]) if r["type"] == t and r["key"] != "small"] for t in ("hash", "list", "set", "zset")}
    assert all(len(p) > 1 for p in by_type.values())
    assert sum(by_type["list"], []) == [f"m{i}" for i in range(1000)]
    assert {k: v for p in by_type["hash"] for k, v in p.items()} == {f"f{i}": f"m{i}" for i in range(1000)}
    assert sum(by_type["set"], []) == sorted(f"m{i}" for i in range(1000))
    assert [(e["Score"], e["Member"]) for p in by_type["zset"] for e in p] == sorted((float(i % 7), f"m{i}") for i in range(1000))
    assert all(len(v) == 100 for parts in by_type.values() for v in parts)


def test_later_entries_replace_earlier_ones(spark):
    rows = [("k", "hash", "f", "old", None, 1), ("k", "hash", "f", "new", None, 2), ("z", "zset", None, "m", 1.0, 1), ("z", "zset", None, "m", 5.0, 2), ("s", "string", None, "a", None, 1)]
    out = {r["key"]: r["value"] for r in keyvalue.read_keyvalue(entries(spark, rows)).collect()}
    assert out == {"k": '{"f":"new"}', "z": '[{"Score":5.0,"Member":"m"}]', "s": "a"}


def test_values_that_are_not_of_their_type(spark):
    junk = spark.createDataFrame([("a:1", "hash", '{"a":"1"} junk')], "key string, type string, value string")
    assert [(r["field"], r["member"]) for r in keyvalue.explode_keyvalue(junk, "t").collect()] == [("value", '{"a":"1"} junk')]
    df = spark.createDataFrame([("a:1", "zset", "oops"), ("a:2", "hash", "{}"), ("a:3", "list", "x"), ("", "string", "v"), ("plain", "other", "v"), (None, "string", "v")], "key string, type string, value string")
    out = {r["key"]: (r["type"], r["field"], r["member"]) for r in keyvalue.explode_keyvalue(df, "t").collect()}
    assert out == {"t:1": ("string", None, "oops"), "t:2": ("hash", "value", "{}"), "t:3": ("list", None, "x"), "t:plain": ("string", None, "v")}


def test_key_tables(spark):
    df = spark.createDataFrame([("test:a:b",), ("bare",)], "key string")
    assert sorted(r[0] for r in keyvalue.list_keyvalue_tables(df).collect()) == ["_default", "test"]


def test_points_round_trip(spark):
    wide = spark.createDataFrame([("u1", 1, 2.5), ("u2", 2, None)], "tag_user string, t int, v double").select(
        "tag_user", (F.lit("2026-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs="t")).alias("time"), "v", (F.col("t") * 10.0).alias("w")
    )
    long = points.table_to_points(wide, "m", F.lit("2026-01-01").cast("timestamp_ntz"))
    assert long.count() == 3
    back = points.points_to_table(long.withColumn("field_value", F.col("value").cast("double")), ["tag_user"], ["v", "w"], "m")
    assert back.select(wide.columns).exceptAll(wide).count() == 0 and back.count() == 2


def test_tags_by_convention():
    assert points.is_tag("tag_x", []) and points.is_tag("host", []) and points.is_tag("kind", ["kind"]) and not points.is_tag("value", [])
