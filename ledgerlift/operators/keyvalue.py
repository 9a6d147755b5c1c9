"""Key-value entries (strings, hashes, lists, sets, sorted sets) to (key, type, value) rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.functions.values import let, parse_whole
from ledgerlift.operators.paging import number_rows
from ledgerlift.session import spread

DEFAULT_TABLE = "_default"


def key_table(key: Column) -> Column:
    """Table of a key: the part before the first colon."""
    return F.when(key.contains(":"), F.substring_index(key, ":", 1)).otherwise(DEFAULT_TABLE)


def list_keyvalue_tables(df: DataFrame) -> DataFrame:
    return df.select(key_table(F.col("key")).alias("table_name")).distinct()


def key_count(df: DataFrame) -> DataFrame:
    """Distinct keys per table."""
    keys = df.select("key").distinct()
    return keys.groupBy(key_table(F.col("key")).alias("table_name")).agg(F.count("*").alias("n_rows"))


def read_keyvalue(entries: DataFrame, part_rows: int = 100_000) -> DataFrame:
    """(key, type, part, value) from entry rows (key, type, field, member, score, seq).

    A hash becomes an object, a list and a set arrays, a sorted set an array of
    {Score, Member}; a plain string keeps its member. Every key is cut by one rule:
    an entry's part is its place in the type's own order (field, list order,
    member, or score and member) divided by ``part_rows``. Each part is a complete
    JSON value, and the parts one after the other are the whole value in order, so
    no task and no text holds an unbounded key. Places come from row numbers over
    sorted ranges, which also split a single very large key.
    """
    kind = F.col("type")
    order = {
        "_score": F.when(kind == "zset", F.col("score")), "_seq": F.when(kind == "list", F.col("seq")),
        "_name": F.when(kind == "hash", F.col("field")).when(kind != "list", F.col("member")),
    }
    placed = number_rows(_last_entries(entries).withColumns(order), ["key", "type", *order], "_place")
    firsts = placed.groupBy(F.col("key").alias("_key"), F.col("type").alias("_type")).agg(F.min("_place").alias("_first"))
    dealt = placed.join(firsts, F.col("key").eqNullSafe(F.col("_key")) & F.col("type").eqNullSafe(F.col("_type")), "left_outer")
    part = F.floor((F.col("_place") - F.col("_first")) / part_rows)
    entry = F.struct("seq", "score", "member", "field")
    grouped = dealt.groupBy("key", "type", part.cast("long").alias("part")).agg(F.collect_list(entry).alias("e"))
    by_seq = F.transform(F.array_sort("e"), lambda x: x["member"])
    members = F.array_sort(F.transform("e", lambda x: x["member"]))
    pairs = F.array_sort(F.transform("e", lambda x: F.struct(x["field"].alias("k"), x["member"].alias("v"))))
    scored = F.array_sort(F.transform("e", lambda x: F.struct(x["score"].alias("Score"), x["member"].alias("Member"))))
    value = (
        F.when(kind == "hash", F.to_json(F.map_from_entries(pairs)))
        .when(kind == "list", F.to_json(by_seq))
        .when(kind == "set", F.to_json(members))
        .when(kind == "zset", F.to_json(scored))
        .when(kind == "string", F.element_at(members, 1))
        .otherwise(F.concat(F.lit("(type: "), kind, F.lit(")")))
    )
    return grouped.select("key", "type", "part", value.alias("value"))


def _last_entries(entries: DataFrame) -> DataFrame:
    """A later entry replaces an earlier one of the same hash field or member; list entries all stay."""
    kind = F.col("type")
    slot = (
        F.when(kind == "hash", F.col("field")).when(kind == "list", F.col("seq").cast("string"))
        .when(kind == "string", F.lit("")).otherwise(F.col("member"))
    )
    newest = F.max(F.struct("seq", "score", "member", "field")).alias("e")
    return entries.groupBy("key", "type", slot.alias("_slot")).agg(newest).select("key", "type", "e.*")


def explode_keyvalue(df: DataFrame, table: str) -> DataFrame:
    """Typed entries for a store: (key, type, pos, field, member, score).

    The key's prefix becomes the table name; rows without a key are skipped. A
    value that is not JSON of its type is stored whole, as the store's writer does.
    """
    key, kind, value = F.col("key"), F.col("type"), F.col("value")
    rest = F.when(key.contains(":"), F.substring(key, F.instr(key, ":") + 1, F.char_length(key))).otherwise(key)
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")

    def entry(field: Column, member: Column, score: Column) -> Column:
        return F.struct(field.alias("field"), member.alias("member"), score.alias("score"))

    def parsed(shape: str, entries, otherwise: Column) -> Column:
        """Entries of a value of that shape, from one parse; the other form if it has none."""
        return let(parse_whole(value, shape), lambda v: F.when(F.coalesce(F.size(v) > 0, F.lit(False)), entries(v)).otherwise(otherwise))

    whole = F.array(entry(none_s, value, none_d))
    entries = (
        F.when(kind == "hash", parsed("map<string,string>", lambda v: F.transform(F.map_entries(v), lambda x: entry(x["key"], x["value"], none_d)), F.array(entry(F.lit("value"), value, none_d))))
        .when(kind.isin("list", "set"), parsed("array<string>", lambda v: F.transform(v, lambda x: entry(none_s, x, none_d)), whole))
        .when(kind == "zset", let(
            parse_whole(value, "array<struct<Score:double,Member:string>>"),
            lambda v: F.when(F.coalesce((F.size(v) > 0) & F.get(v, F.lit(0))["Member"].isNotNull(), F.lit(False)), F.transform(v, lambda x: entry(none_s, x["Member"], x["Score"]))),
        ))
        .otherwise(whole)
    )
    # A sorted set without members in its value is stored whole, as a string.
    stored = F.when((kind == "zset") & F.col("_e").isNull(), "string").when(kind.isin("hash", "list", "set", "zset"), kind).otherwise("string")
    return (
        spread(df.filter(F.coalesce(key, F.lit("")) != ""))
        .select(F.concat(F.lit(f"{table}:"), rest).alias("key"), "type", "value", F.explode(F.array(entries)).alias("_e"))
        .select("key", stored.alias("type"), F.posexplode(F.coalesce("_e", whole)).alias("pos", "e"))
        .select("key", "type", "pos", "e.field", "e.member", "e.score")
    )
