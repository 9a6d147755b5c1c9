"""Catalogs as DataFrames: column, index and foreign-key facts, their differences and the reports on them.

Column rows: table_name, column_name, ordinal, base_type, data_type, char_len,
num_precision, num_scale, is_unsigned, is_nullable, is_auto, is_pk,
is_generated, default_value. Index and key rows carry ordered column arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlift.operators import fixed_types as fx
from ledgerlift.operators.typemap import UNKNOWN, neutral_kind, spark_kind, type_changes

SEVERITIES = ("ok", "info", "warning", "error")  # weakest first


@dataclass
class Catalog:
    """Facts of one database. ``tables`` has table_name, charset, check_count."""

    columns: DataFrame
    indexes: DataFrame | None = None
    fks: DataFrame | None = None
    tables: DataFrame | None = None

    def names(self) -> DataFrame:
        return (self.columns if self.tables is None else self.tables).select("table_name").distinct()


def build_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Column facts of files. Files declare every column nullable, so nullability is what the rows show."""
    parts: list[DataFrame] = []
    for name, df in tables.items():
        fields = df.schema.fields
        seen = df.agg(
            F.count("*").alias("n"), *[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"_z{i}") for i, f in enumerate(fields)]
        )
        facts = []
        for i, f in enumerate(fields):
            decimal = isinstance(f.dataType, T.DecimalType)
            facts.append(
                F.struct(
                    F.lit(name).alias("table_name"),
                    F.lit(f.name).alias("column_name"),
                    F.lit(i + 1).alias("ordinal"),
                    F.lit(spark_kind(f.dataType)).alias("base_type"),
                    F.lit(f.dataType.simpleString()).alias("data_type"),
                    F.lit(f.dataType.precision if decimal else None).cast("int").alias("num_precision"),
                    F.lit(f.dataType.scale if decimal else None).cast("int").alias("num_scale"),
                    (F.col(f"_z{i}") > 0).alias("is_nullable"),
                    F.col("n").alias("n_rows"),
                )
            )
        parts.append(seen.select(F.explode(F.array(*facts)).alias("f")).select("f.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def narrow_number(precision: Column, scale: Column) -> Column:
    """Kind of a decimal by its digits when it has no fraction."""
    return (
        F.when(precision.isNull() | scale.isNull() | (scale != 0), "DECIMAL")
        .when(precision <= 5, "SMALLINT")
        .when(precision <= 10, "INT")
        .otherwise("BIGINT")
    )


def _clean_default(c: Column) -> Column:
    bare = F.translate(F.lower(F.trim(c)), "()", "")
    return F.regexp_replace(bare, "^['\"]+|['\"]+\\z", "")


def _item(when: Column, category: str, severity: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    body = F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), text.alias("message"))
    return F.when(when, body)


def _in_both(a: DataFrame, names: DataFrame) -> DataFrame:
    return a.join(names, "table_name", "left_semi")


def column_diff(cat_a: DataFrame, cat_b: DataFrame, names_a: DataFrame | None = None, names_b: DataFrame | None = None) -> DataFrame:
    """Differences of columns of tables that exist on both sides, one row per finding.

    ``names_a`` and ``names_b`` give the table names where they are already known.
    """
    names_a = cat_a.select("table_name").distinct() if names_a is None else names_a
    names_b = cat_b.select("table_name").distinct() if names_b is None else names_b
    facts = ["column_name", "base_type", "data_type", "is_nullable", "is_auto", "default_value"]

    def side(cat: DataFrame, other: DataFrame, p: str) -> DataFrame:
        return _in_both(cat, other).select(
            "table_name", F.lower("column_name").alias("_name"), *[F.col(c).alias(f"{p}_{c}") for c in facts]
        )

    both = side(cat_a, names_b, "a").join(side(cat_b, names_a, "b"), ["table_name", "_name"], "full_outer")
    in_a, in_b = F.col("a_column_name").isNotNull(), F.col("b_column_name").isNotNull()
    paired = in_a & in_b
    ka, kb = neutral_kind(F.col("a_base_type")), neutral_kind(F.col("b_base_type"))
    da, db = F.col("a_default_value"), F.col("b_default_value")
    had_default = F.coalesce((F.trim(da) != "") & (F.upper(F.trim(da)) != "NULL"), F.lit(False))
    types = F.concat_ws(" -> ", "a_data_type", "b_data_type")
    items = [
        _item(~in_b, "column", "error", F.concat(F.lit("missing in target: "), F.col("a_data_type"))),
        _item(~in_a, "column", "info", F.concat(F.lit("only in target: "), F.col("b_data_type"))),
        _item(paired & (ka != UNKNOWN) & (kb != UNKNOWN) & (ka != kb), "type", "warning", types),
        _item(paired & (ka != UNKNOWN) & (kb == UNKNOWN), "type", "warning", F.concat(F.lit("unrecognised "), types)),
        _item(paired & F.col("a_is_nullable") & ~F.col("b_is_nullable"), "nullable", "warning", "target forbids NULL"),
        _item(paired & ~F.col("a_is_nullable") & F.col("b_is_nullable"), "nullable", "info", "target allows NULL"),
        _item(paired & F.col("a_is_auto") & ~F.col("b_is_auto"), "increment", "warning", "identity lost"),
        _item(
            paired & da.isNotNull() & db.isNotNull() & (_clean_default(da) != _clean_default(db)),
            "default", "info", F.concat_ws(" -> ", da, db),
        ),
        _item(paired & had_default & db.isNull(), "default", "warning", F.concat(F.lit("lost "), F.trim(da))),
    ]
    return both.select(
        "table_name",
        F.coalesce("a_column_name", "b_column_name").alias("column_name"),
        F.explode(F.array_compact(F.array(*items))).alias("i"),
    ).select("table_name", "column_name", "i.*")


def default_diff(cat_a: DataFrame, cat_b: DataFrame) -> DataFrame:
    return column_diff(cat_a, cat_b).filter(F.col("category") == "default")


def index_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Secondary indexes the target lacks; names and the order of columns do not matter."""

    def marked(df: DataFrame) -> DataFrame:
        key = F.concat_ws("|", F.col("is_unique").cast("string"), F.concat_ws(",", F.array_sort("columns")))
        return df.filter(~F.col("is_primary")).withColumn("_key", key)

    have = marked(b).select("table_name", "_key").distinct()
    return marked(a).join(have, ["table_name", "_key"], "left_anti").select("table_name", "index_name", "is_unique", "columns")


def fk_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Foreign keys the target lacks, compared by columns, referenced table and referenced columns."""

    def marked(df: DataFrame) -> DataFrame:
        parts = [F.concat_ws(",", F.array_sort("columns")), F.col("ref_table"), F.concat_ws(",", F.array_sort("ref_columns"))]
        return df.withColumn("_key", F.lower(F.concat_ws("|", *parts)))

    have = marked(b).select("table_name", "_key").distinct()
    return marked(a).join(have, ["table_name", "_key"], "left_anti").select("table_name", "fk_name", "columns", "ref_table", "ref_columns")


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Source tables without a target."""
    return a.select("table_name").distinct().join(b.select("table_name").distinct(), "table_name", "left_anti")


def column_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each column name (lower case) of either side: in both, only in the source or only in the target."""

    def side(df: DataFrame, left: int) -> DataFrame:
        return df.select("table_name", F.lower("column_name").alias("column_name"), F.lit(left).alias("_l"), F.lit(1 - left).alias("_r"))

    where = F.when(F.col("_l") + F.col("_r") == 2, "both").when(F.col("_l") == 1, "source").otherwise("target")
    stacked = side(a, 1).unionByName(side(b, 0)).groupBy("table_name", "column_name").agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return stacked.select("table_name", "column_name", where.alias("side"))


def constraint_columns(constraints: DataFrame, key_cols: DataFrame, ref_cols: DataFrame) -> DataFrame:
    """Ordered column lists per foreign key. Pairs are matched by position, so a composite key gives no cross pairs."""
    pairs = key_cols.join(ref_cols, ["table_name", "constraint_name", "position"]).join(
        constraints.select("table_name", "constraint_name").distinct(), ["table_name", "constraint_name"], "left_semi"
    )
    ordered = F.array_sort(F.collect_list(F.struct("position", "column_name", "ref_column")))
    return (
        pairs.groupBy("table_name", "constraint_name", "ref_table")
        .agg(ordered.alias("p"))
        .select("table_name", "constraint_name", "ref_table", F.col("p.column_name").alias("columns"), F.col("p.ref_column").alias("ref_columns"))
    )


def assemble_indexes(parts: DataFrame) -> DataFrame:
    """One row per index with its columns in order, from one row per index column.

    The lists stay short: databases allow an index a few dozen columns.
    """
    ordered = F.array_sort(F.collect_list(F.struct("position", "column_name")))
    return (
        parts.groupBy("table_name", "index_name")
        .agg(F.max("is_unique").alias("is_unique"), F.max("is_primary").alias("is_primary"), ordered.alias("p"))
        .select("table_name", "index_name", "is_unique", "is_primary", F.col("p.column_name").alias("columns"))
    )


def choose_key(columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """The key to align and page a table by: its primary key (whole), else a single unique NOT NULL column, else none."""
    single = F.size("columns") == 1
    nullable = columns.select("table_name", F.col("column_name").alias("_first"), "is_nullable").distinct()
    ranked = (
        indexes.withColumn("_first", F.try_element_at("columns", F.lit(1)))
        .join(nullable, ["table_name", "_first"], "left_outer")
        .select(
            "table_name",
            F.when(F.col("is_primary"), 1).when(F.col("is_unique") & single & ~F.col("is_nullable"), 2).alias("rank"),
            "index_name",
            "columns",
        )
    )
    best = ranked.groupBy("table_name").agg(F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "index_name", "columns"))).alias("k"))
    how = F.when(F.col("k.rank") == 1, "primary").when(F.col("k.rank") == 2, "unique").otherwise("none")
    return best.select("table_name", how.alias("key_source"), F.concat_ws(",", F.col("k.columns")).alias("key_columns"))


def severity_rank(c: Column) -> Column:
    return F.array_position(F.lit(list(SEVERITIES)), c).cast("int") - 1


def worst_severity(items: DataFrame, tables: DataFrame) -> DataFrame:
    """ok, warning or error per table; a table with nothing but notes is ok."""
    ranked = items.select("table_name", severity_rank(F.col("severity")).alias("r")).unionByName(
        tables.select("table_name", F.lit(0).alias("r"))
    )
    status = F.when(F.col("r") == 3, "error").when(F.col("r") == 2, "warning").otherwise("ok")
    return ranked.groupBy("table_name").agg(F.max("r").alias("r")).select("table_name", status.alias("status"))


ITEM = ("table_name", "object_name", "category", "severity", "message")


def structure_report(a: Catalog, b: Catalog) -> DataFrame:
    """Every structural difference, one row each. Lost tables are reported once, not column by column."""
    names, common = a.names(), b.names()
    items = table_diff(names, common).select(
        "table_name", F.lit("").alias("object_name"), F.lit("schema").alias("category"),
        F.lit("error").alias("severity"), F.lit("table missing in target").alias("message"),
    )
    columns = column_diff(a.columns, b.columns, names, common)
    items = items.unionByName(columns.withColumnRenamed("column_name", "object_name"))
    if a.indexes is not None and b.indexes is not None:
        lost = _in_both(index_diff(a.indexes, b.indexes), common)
        kind = F.when(F.col("is_unique"), "unique index ").otherwise("index ")
        items = items.unionByName(
            lost.select(
                "table_name", F.col("index_name").alias("object_name"), F.lit("index").alias("category"),
                F.lit("warning").alias("severity"),
                F.concat(F.lit("missing "), kind, F.lit("("), F.concat_ws(", ", "columns"), F.lit(")")).alias("message"),
            )
        )
    if a.fks is not None and b.fks is not None:
        lost = _in_both(fk_diff(a.fks, b.fks), common)
        target = F.concat(F.concat_ws(",", "columns"), F.lit(" -> "), F.col("ref_table"), F.lit("("), F.concat_ws(",", "ref_columns"), F.lit(")"))
        items = items.unionByName(
            lost.select(
                "table_name", F.col("fk_name").alias("object_name"), F.lit("fk").alias("category"),
                F.lit("warning").alias("severity"), F.concat(F.lit("missing "), target).alias("message"),
            )
        )
    if a.tables is not None and b.tables is not None:
        pairs = a.tables.select("table_name", F.col("charset").alias("ca")).join(
            b.tables.select("table_name", F.col("charset").alias("cb")), "table_name"
        )
        differ = (F.col("ca") != "") & (F.col("cb") != "") & (F.lower("ca") != F.lower("cb"))
        items = items.unionByName(
            pairs.filter(differ).select(
                "table_name", F.lit("").alias("object_name"), F.lit("charset").alias("category"),
                F.lit("info").alias("severity"), F.concat_ws(" -> ", "ca", "cb").alias("message"),
            )
        )
    return items.select(*ITEM)


def structure_summary(items: DataFrame, tables: DataFrame) -> DataFrame:
    """Table counts per verdict. ``success`` says the check ran; ``all_ok`` that nothing needs attention."""
    status = worst_severity(items, tables)
    return status.agg(
        F.count("*").alias("n_tables"),
        F.count_if(F.col("status") == "ok").alias("ok_count"),
        F.count_if(F.col("status") == "warning").alias("warning_count"),
        F.count_if(F.col("status") == "error").alias("error_count"),
        F.lit(True).alias("success"),
        F.coalesce(F.bool_and(F.col("status") == "ok"), F.lit(True)).alias("all_ok"),
    )


def _hint_family(dialect: str) -> str:
    if dialect in fx.POSTGRES_FAMILY and dialect != "timescaledb":
        return "postgres"
    return "mysql" if dialect in ("mysql", "mariadb", "tidb", "oceanbase") else dialect


def charset_advice(charset: Column) -> Column:
    cs = F.lower(charset)
    return (
        F.when(cs.contains("utf8") | cs.contains("unicode"), "unicode source; nothing to do per table")
        .when(cs.contains("gbk") | cs.contains("gb2312"), "check that the target database encodes rare characters and emoji")
        .when(cs.contains("latin"), "if the bytes are really UTF-8, convert before the copy")
        .otherwise("no charset per table in the target; check special characters afterwards")
    )


def migration_guide(cat: DataFrame, tables: DataFrame, dialect: str) -> DataFrame:
    """Things to look at before copying to ``dialect``: checks, charsets, identities and general advice."""
    family = _hint_family(dialect)
    checks = tables.filter("check_count > 0").select(
        F.lit("check").alias("category"), F.lit("info").alias("severity"), "table_name", F.lit("").alias("object_name"),
        F.concat(F.col("check_count").cast("string"), F.lit(" CHECK constraints to verify")).alias("message"),
    )
    items = checks
    if family != "mysql":
        items = items.unionByName(
            tables.filter("charset <> ''").select(
                F.lit("charset").alias("category"), F.lit("info").alias("severity"), "table_name",
                F.lit("").alias("object_name"),
                F.concat(F.col("charset"), F.lit(": "), charset_advice(F.col("charset"))).alias("message"),
            )
        )
    if family == "postgres":
        items = items.unionByName(
            cat.filter(F.col("is_auto") & F.col("is_pk")).select(
                F.lit("increment").alias("category"), F.lit("info").alias("severity"), "table_name",
                F.col("column_name").alias("object_name"),
                F.lit("explicit inserts do not move the sequence; reset it after the copy").alias("message"),
            )
        )
    hints = fx.DIALECT_HINTS.get(family, [])
    if hints:
        schema = "category string, severity string, table_name string, object_name string, message string"
        rows = [("dialect", "info", "", "", h) for h in hints]
        items = items.unionByName(cat.sparkSession.createDataFrame(rows, schema))
    return items


def sort_by_severity(items: DataFrame) -> DataFrame:
    """Errors first, then warnings, then the rest, with the rank shown."""
    rank = 3 - severity_rank(F.col("severity"))
    return items.withColumn("severity_rank", rank).orderBy("severity_rank", "category", "table_name", "object_name", "message")


def guide_summary(cat: DataFrame, tables: DataFrame, dialect: str) -> DataFrame:
    """How many tables, changed types and open points the guide holds, in one row."""
    facts = (
        cat.select("table_name").distinct().select(F.lit("t").alias("f"), F.lit("").alias("s"))
        .unionAll(type_changes(cat, dialect).select(F.lit("c"), F.lit("")))
        .unionAll(migration_guide(cat, tables, dialect).select(F.lit("i"), F.col("severity")))
    )
    f = F.col("f")
    return facts.agg(
        F.count_if(f == "t").alias("n_tables"),
        F.count_if(f == "c").alias("n_type_changes"),
        F.count_if(f == "i").alias("n_items"),
        F.count_if((f == "i") & (F.col("s") == "error")).alias("n_must_fix"),
    )

