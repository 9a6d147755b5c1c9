"""Documents, key-value entries and time-series points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.operators import documents, keyvalue, points
from ledgerlift.plans import derived as d
from ledgerlift.plans.registry import query

_DOCS = d.sql_of("events", d.DOCS)
_KV = d.sql_of("events", d.KV_ENTRIES)
_KV_ROWS = d.sql_of("events", d.KV_ROWS)


@query(
    "doc_schema",
    f"""WITH f AS (SELECT unnest(json_keys(doc)) AS field, doc FROM ({_DOCS})),
    t AS (SELECT DISTINCT field, CASE json_type(doc, '$.' || field) WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'BIGINT' THEN 'BIGINT' WHEN 'DOUBLE' THEN 'DOUBLE' WHEN 'BOOLEAN' THEN 'BOOLEAN'
      WHEN 'VARCHAR' THEN 'VARCHAR' WHEN 'OBJECT' THEN 'JSON' WHEN 'ARRAY' THEN 'TEXT' END AS ty FROM f),
    g AS (SELECT field, string_agg(ty, ',' ORDER BY ty) AS ts FROM t GROUP BY field)
    SELECT field, CASE WHEN field = '_id' THEN 'OBJECTID' WHEN ts = 'BIGINT,DOUBLE' THEN 'DOUBLE' WHEN ts LIKE '%,%' THEN 'VARCHAR' ELSE coalesce(ts, 'TEXT') END AS data_type,
     field <> '_id' AS is_nullable, field = '_id' AS is_pk FROM g""",
)
def doc_schema(spark, sf):
    return documents.infer_document_schema(d.derive(spark, sf, "events", d.DOCS), "doc")


_NUMBER = "CASE WHEN json_type(doc, '$.score') = 'VARCHAR' THEN json_extract_string(doc, '$.score') ELSE CAST(CAST(json_extract_string(doc, '$.score') AS DOUBLE) AS VARCHAR) END"


@query(
    "doc_flatten",
    f"""SELECT event_id, json_extract_string(doc, '$._id') AS _id, CAST(json_extract_string(doc, '$.user') AS BIGINT) AS user, json_extract_string(doc, '$.event_type') AS event_type,
    json_extract_string(doc, '$.at') AS at, CAST(json_extract_string(doc, '$.flag') AS BOOLEAN) AS flag, CAST(json_extract_string(doc, '$.amount') AS DOUBLE) AS amount,
    {_NUMBER} AS score, CAST(json_extract(doc, '$.tags') AS VARCHAR) AS tags, replace(CAST(json_extract(doc, '$.props') AS VARCHAR), ' ', '') AS props FROM ({_DOCS})""",
)
def doc_flatten(spark, sf):
    docs = d.derive(spark, sf, "events", d.DOCS)
    fields = documents.field_types(documents.infer_document_schema(docs, "doc"))
    flat = documents.read_documents(docs, "doc", fields)
    # The mixed column is text; numbers in it are shown as both engines show a double.
    return flat.withColumn("score", F.coalesce(F.col("score").try_cast("double").cast("string"), F.col("score")))


_ODD = d.sql_of("events", d.ODD_DOCS)


@query(
    "doc_rejects",
    f"""SELECT event_id, doc, CASE WHEN doc IS NULL THEN 'missing' WHEN NOT json_valid(doc) THEN 'broken' ELSE 'not an object' END AS reason FROM ({_ODD})
    WHERE doc IS NULL OR NOT json_valid(doc) OR json_type(doc) <> 'OBJECT'""",
)
def doc_rejects(spark, sf):
    return documents.document_rejects(d.derive(spark, sf, "events", d.ODD_DOCS), "doc")


_DOC_ROWS = d.sql_of("events", d.DOC_ROWS)


@query(
    "doc_build",
    f"""SELECT '{{"_id":' || CASE WHEN length(_id) = 24 THEN '{{"$oid":"' || _id || '"}}' ELSE CAST(to_json(_id) AS VARCHAR) END || ',"user":' || coalesce(CAST(user AS VARCHAR), 'null')
    || ',"props":' || CASE WHEN props LIKE '{{%}}' THEN replace(props, ' ', '') ELSE coalesce(CAST(to_json(props) AS VARCHAR), 'null') END
    || ',"blob":' || CASE WHEN blob LIKE 'hex:%' AND blob <> 'hex:zz' THEN '"' || to_base64(unhex(substr(blob, 5))) || '"' ELSE coalesce(CAST(to_json(blob) AS VARCHAR), 'null') END || '}}' AS doc FROM ({_DOC_ROWS})""",
)
def doc_build(spark, sf):
    return documents.write_documents(d.derive(spark, sf, "events", d.DOC_ROWS), ["props"], ["blob"])


@query(
    "doc_roundtrip",
    f"""SELECT CASE WHEN length(_id) = 24 THEN '{{"$oid":"' || _id || '"}}' ELSE _id END AS _id, user, CASE WHEN props LIKE '{{%}}' THEN replace(props, ' ', '') ELSE props END AS props,
    CASE WHEN blob LIKE 'hex:%' AND blob <> 'hex:zz' THEN to_base64(unhex(substr(blob, 5))) ELSE blob END AS blob FROM ({_DOC_ROWS})""",
)
def doc_roundtrip(spark, sf):
    """Written and read back; the object id stays in its extended form, as it is one field of mixed kinds."""
    written = documents.write_documents(d.derive(spark, sf, "events", d.DOC_ROWS), ["props"], ["blob"])
    fields = documents.field_types(documents.infer_document_schema(written, "doc")) | {"_id": "VARCHAR"}
    return documents.read_documents(written, "doc", fields)


PART_ROWS = 3  # so that keys of every type come in several parts


@query(
    "kv_collect",
    f"""WITH e AS (SELECT *, CASE type WHEN 'hash' THEN field WHEN 'list' THEN CAST(seq AS VARCHAR) ELSE member END AS slot FROM ({_KV})),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, type, slot ORDER BY seq DESC) AS rn FROM e) WHERE rn = 1),
    p AS (SELECT *, (row_number() OVER (PARTITION BY key, type ORDER BY CASE type WHEN 'zset' THEN score END, CASE type WHEN 'list' THEN seq END, CASE type WHEN 'hash' THEN field ELSE member END) - 1) // {PART_ROWS} AS part FROM l)
    SELECT key, type, CAST(part AS BIGINT) AS part, CASE type
     WHEN 'hash' THEN '{{' || string_agg('"' || field || '":"' || member || '"', ',' ORDER BY field) || '}}'
     WHEN 'list' THEN '[' || string_agg('"' || member || '"', ',' ORDER BY seq) || ']'
     WHEN 'set' THEN '[' || string_agg('"' || member || '"', ',' ORDER BY member) || ']'
     ELSE '[' || string_agg('{{"Score":' || CAST(score AS VARCHAR) || ',"Member":"' || member || '"}}', ',' ORDER BY score, member) || ']' END AS value
    FROM p GROUP BY key, type, part""",
)
def kv_collect(spark, sf):
    return keyvalue.read_keyvalue(d.derive(spark, sf, "events", d.KV_ENTRIES), PART_ROWS)


@query("kv_tables", f"SELECT DISTINCT CASE WHEN strpos(key, ':') > 0 THEN split_part(key, ':', 1) ELSE '_default' END AS table_name FROM ({_KV_ROWS})")
def kv_tables(spark, sf):
    return keyvalue.list_keyvalue_tables(d.derive(spark, sf, "events", d.KV_ROWS))


@query(
    "kv_counts",
    f"SELECT CASE WHEN strpos(key, ':') > 0 THEN split_part(key, ':', 1) ELSE '_default' END AS table_name, count(DISTINCT key) AS n_rows FROM ({_KV_ROWS}) GROUP BY 1",
)
def kv_counts(spark, sf):
    return keyvalue.key_count(d.derive(spark, sf, "events", d.KV_ROWS))


@query(
    "kv_explode",
    f"""WITH r AS (SELECT 'tgt:' || CASE WHEN strpos(key, ':') > 0 THEN substr(key, strpos(key, ':') + 1) ELSE key END AS key, type, value FROM ({_KV_ROWS}) WHERE key <> ''),
    x AS (SELECT key, 'hash' AS type, unnest(json_keys(value)) AS field, value FROM r WHERE type = 'hash' AND starts_with(value, '{{'))
    SELECT key, type, CAST(0 AS INT) AS pos, CAST(NULL AS VARCHAR) AS field, value AS member, CAST(NULL AS DOUBLE) AS score FROM r WHERE type = 'string'
    UNION ALL SELECT key, type, 0, 'value', value, NULL FROM r WHERE type = 'hash' AND NOT starts_with(value, '{{')
    UNION ALL SELECT key, type, CASE field WHEN 'a' THEN 0 ELSE 1 END, field, json_extract_string(value, '$.' || field), NULL FROM x
    UNION ALL SELECT key, type, CAST(generate_subscripts(m, 1) - 1 AS INT), NULL, unnest(m), NULL FROM (SELECT key, type, CAST(value AS VARCHAR[]) AS m FROM (SELECT key, type, from_json(value, '["VARCHAR"]') AS value FROM r WHERE type IN ('list', 'set')))
    UNION ALL SELECT key, type, 0, NULL, json_extract_string(value, '$[0].Member'), CAST(json_extract_string(value, '$[0].Score') AS DOUBLE) FROM r WHERE type = 'zset'""",
)
def kv_explode(spark, sf):
    return keyvalue.explode_keyvalue(d.derive(spark, sf, "events", d.KV_ROWS), "tgt")


@query(
    "ts_pivot",
    f"SELECT measurement, tag_user, time, max(CASE WHEN field = 'value' THEN field_value END) AS value, max(CASE WHEN field = 'k' THEN field_value END) AS k FROM ({d.POINTS_SQL}) GROUP BY ALL",
)
def ts_pivot(spark, sf):
    return points.points_to_table(d.points(spark, sf), ["tag_user"], ["value", "k"])


@query(
    "ts_schema",
    f"""WITH p AS ({d.POINTS_SQL}) SELECT measurement, field AS column_name, upper(min(field_type)) AS data_type, false AS is_key FROM p GROUP BY measurement, field
    UNION ALL SELECT DISTINCT measurement, 'time', 'TIMESTAMP', true FROM p UNION ALL SELECT DISTINCT measurement, 'tag_user', 'TAG', true FROM p""",
)
def ts_schema(spark, sf):
    return points.measurement_schema(d.points(spark, sf), ["tag_user"])


@query("ts_counts", f"SELECT measurement, count(DISTINCT (tag_user, time)) AS n_rows FROM ({d.POINTS_SQL}) GROUP BY measurement")
def ts_counts(spark, sf):
    return points.point_rows(d.points(spark, sf), ["tag_user"])


@query(
    "ts_unpivot",
    f"""WITH w AS ({d.sql_of('events', d.WIDE_POINTS)}), t AS (SELECT 'm' AS measurement, tag_user, host, coalesce(time, TIMESTAMP '2024-02-01 00:00:00') AS time, kind, value, score FROM w)
    SELECT measurement, tag_user, host, time, 'kind' AS field, kind AS value FROM t UNION ALL SELECT measurement, tag_user, host, time, 'value', CAST(value AS VARCHAR) FROM t
    UNION ALL SELECT measurement, tag_user, host, time, 'score', CAST(score AS VARCHAR) FROM t WHERE score IS NOT NULL""",
)
def ts_unpivot(spark, sf):
    when = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return points.table_to_points(d.derive(spark, sf, "events", d.WIDE_POINTS), "m", when)
