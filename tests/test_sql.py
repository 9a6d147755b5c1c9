"""SQL scripts: masking, splitting, classes, audit and rewrite."""

import time

import pytest
from pyspark.sql import functions as F

from ledgerlift.functions import sqltokens as st
from ledgerlift.operators import sqlcorpus as sc
from ledgerlift.operators.fixed_rules import RULES


def scripts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "script_id int, sql string")


def audit(spark, sql, target):
    return [r.asDict() for r in sc.audit_sql(scripts(spark, sql), target).orderBy("line_no", "column_no").collect()]


def rewrite(spark, sql, source, target):
    return sc.rewrite_sql(scripts(spark, sql), source, target).first()["sql"]


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ("a 'b;''c' d", "a         d"),
        ("x -- y 'z\nw", "x        \nw"),
        ("x # y\nw", "x    \nw"),
        ('a "q -- r" b', "a          b"),
        ("a /* b\n' */ c", "a     \n     c"),
        ("a - b / c", "a - b / c"),
        ("open 'to the end", "open " + " " * 11),
        ("open /* to the end", "open " + " " * 13),
        ("a--", "a  "),
        ("/", "/"),
        ("", ""),
    ],
)
def test_mask(spark, text, masked):
    assert scripts(spark, text).select(st.mask_literals(F.col("sql"))).first()[0] == masked


def test_tokens_lose_nothing_on_long_texts(spark):
    body = "x - y / z 'lit''eral' " * 60_000
    row = scripts(spark, body).select(st.join(st.tokens(F.col("sql"))) == F.col("sql"), F.length(st.mask_literals(F.col("sql")))).first()
    assert row[0] and row[1] == len(body)


def test_statements(spark):
    sql = "SELECT 'a;b' FROM t; -- one; two\nSELECT 2;\u0001;\n"
    got = [r["statement"] for r in sc.explode_statements(scripts(spark, sql)).orderBy("statement_no").collect()]
    assert got == ["SELECT 'a;b' FROM t", "-- one; two\nSELECT 2", "\u0001"]


@pytest.mark.parametrize(
    ("source", "sql", "want"),
    [
        ("mysql", r"INSERT INTO buoy VALUES ('it\'s; lit'); DELETE FROM buoy", [r"INSERT INTO buoy VALUES ('it\'s; lit')", "DELETE FROM buoy"]),
        ("mysql", "SELECT `a;b` FROM t # one; two\n; SELECT 2", ["SELECT `a;b` FROM t # one; two", "SELECT 2"]),
        ("mssql", "SELECT * INTO #tmp FROM t; SELECT [x;y] FROM #tmp", ["SELECT * INTO #tmp FROM t", "SELECT [x;y] FROM #tmp"]),
        ("postgres", "DO $f$ a; b $f$; SELECT $1, $$ ; $$; SELECT a$b; SELECT c$b", ["DO $f$ a; b $f$", "SELECT $1, $$ ; $$", "SELECT a$b", "SELECT c$b"]),
        ("postgres", r"SELECT 'back\'; SELECT 2", [r"SELECT 'back\'", "SELECT 2"]),
    ],
)
def test_statements_by_source(spark, source, sql, want):
    assert [r["statement"] for r in sc.explode_statements(scripts(spark, sql), source=source).orderBy("statement_no").collect()] == want
    family = sc.family_of(source)
    row = scripts(spark, sql).select(st.join(st.tokens(F.col("sql"), family)), F.length(st.mask_literals(F.col("sql"), family))).first()
    assert tuple(row) == (sql, len(sql))


def test_open_scripts(spark):
    for source, opened, closed in [
        ("mysql", [r"a 'b\'", "x `y", '"q', "/* c", "a 'b\\"], [r"a 'b\\'", "x `y`", "a # it's", "1"]),
        ("postgres", ["$t$ a $$", "'x", "$$ y"], ["$t$ a $t$", r"'x\'", "$1"]),
        ("mssql", ["[a b", "a 'b"], ["[a b]", "#t"]),
        (None, ["'x", '"', "/*/"], ["'x'", "", "a -- 'b"]),
    ]:
        assert [r["sql"] for r in sc.open_scripts(scripts(spark, *opened, *closed), source=source).orderBy("script_id").collect()] == opened


def test_long_literals_and_names_need_no_recursion(spark):
    body = r"x \' y `` ]] " * 50_000
    for source, text in [("mysql", f"'{body}'"), ("mysql", f"`{body}`"), ("mssql", f"[{body}]"), ("postgres", f"$a$ {body} $a$")]:
        df = scripts(spark, text, text[:-1])
        assert [r["script_id"] for r in sc.open_scripts(df, source=source).collect()] == [1]
        assert sc.rewrite_sql(df, source, "sqlite").count() == 2


def test_audit_by_source(spark):
    found = sc.audit_sql(scripts(spark, "SELECT * INTO #tmp FROM t WHERE d < GETDATE()"), "postgres", source="mssql").collect()
    assert [f["rule_id"] for f in found] == ["getdate"]


def test_classes(spark):
    cases = {
        "create  table t (i int)": "create_table", "INSERT\tINTO t VALUES (1)": "insert", "CREATE UNIQUE INDEX i ON t (a)": "create_index",
        "drop table t": "drop_table", "ALTER TABLE t ADD c INT": "alter_table", "COMMENT ON TABLE t IS 'x'": "comment", "USE db": "use",
        "SET NAMES utf8": "set", "SELECT 1": "other", "-- note\n/* more */ INSERT INTO t VALUES (1)": "insert", "settle": "other",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, statement string")
    assert [r["class"] for r in sc.classify_statements(df).orderBy("i").collect()] == list(cases.values())


@pytest.mark.parametrize(
    ("sql", "target", "rule"),
    [
        ("UPDATE `berth` SET `tide` = 7", "postgres", "backtick_name"),
        ("SELECT depth FROM harbour LIMIT 4", "mssql", "limit_mssql"),
        ("SELECT depth FROM harbour LIMIT 9 , 3", "postgres", "limit_pair"),
        ("INSERT INTO buoy VALUES (3) ON  DUPLICATE KEY UPDATE lit = 0", "postgres", "on_duplicate_key"),
        ("INSERT INTO buoy VALUES (3) ON CONFLICT DO NOTHING", "mysql", "on_conflict_mysql"),
        ("SELECT LAST_INSERT_ID( ) + 1", "mssql", "last_insert_id"),
        ("values (GetDate( ))", "mysql", "getdate"),
        ("SELECT isnull(draught, 2.5) FROM ship", "postgres", "isnull"),
        ("EXECUTE [moor ship] 5", "mysql", "exec"),
        ("DELETE FROM ship WHERE imo = $3", "mysql", "dollar_parameter"),
        ("DELETE FROM ship RETURNING imo", "mysql", "returning"),
    ],
)
def test_audit_finds(spark, sql, target, rule):
    assert rule in [f["rule_id"] for f in audit(spark, sql, target)]


@pytest.mark.parametrize(
    ("sql", "target"),
    [
        ("SELECT tide FROM berth WHERE sign = 'no TOP 3, no NVL(a, b), no `knots`'", "postgres"),
        ("-- CHARINDEX(a\n/* REPLACE INTO x\n[y] */\nSELECT tide FROM berth", "postgres"),
        ("SELECT `a` FROM `b`", "mysql"),
        ("   \n  ", "postgres"),
        ("SELECT éTOP_5, STOP 5, nvl2(1)", "dameng"),
    ],
)
def test_audit_stays_quiet(spark, sql, target):
    assert [f for f in audit(spark, sql, target) if f["category"] in ("pagination", "function", "quote")] == []


def test_audit_places(spark):
    found = audit(spark, "SELECT 1\nSELECT `a`, 'x', `é` FROM `b`\nSELECT 3", "postgres")
    assert [(f["line_no"], f["column_no"], f["snippet"]) for f in found] == [(2, 8, "`a`"), (2, 18, "`é`"), (2, 27, "`b`")]
    long = audit(spark, "SELECT `" + "n" * 80 + "`", "postgres")[0]["snippet"]
    assert long == "`" + "n" * 56 + "..."


def test_audit_sees_constructs_broken_over_lines(spark):
    found = audit(spark, "INSERT INTO buoy VALUES (1)\n  ON DUPLICATE\n KEY\tUPDATE lit = 1", "postgres")
    assert [(f["rule_id"], f["line_no"], f["column_no"]) for f in found] == [("on_duplicate_key", 2, 3)]


def test_long_heads_are_classified(spark):
    df = spark.createDataFrame([("CREATE" + " " * 500 + "TABLE t (i INT)",)], "statement string")
    assert sc.classify_statements(df).first()["class"] == "create_table"


EXAMPLES = {
    "backtick_name": "`a`", "bracket_name": "[a b]", "limit_mssql": "limit 5", "limit_dameng": "LIMIT 5", "top": "select top 3 x",
    "limit_pair": "LIMIT 1 , 2", "getdate": "GetDate ( )", "last_identity": "@@rowcount", "datediff": "DATEDIFF(d, a, b)", "charindex": "CHARINDEX(a",
    "isnull": "ISNULL(a, b)", "last_insert_id": "LAST_INSERT_ID()", "on_duplicate_key": "on duplicate key update", "replace_into": "REPLACE INTO t",
    "group_concat": "GROUP_CONCAT(a)", "date_format": "DATE_FORMAT(a)", "if_call": "IF(a, b, c)", "ifnull": "x, IFNULL(a, b)", "returning": "RETURNING",
    "on_conflict_mssql": "ON CONFLICT", "nvl": "NVL(a, b)", "merge": "MERGE INTO t", "on_conflict_mysql": "on conflict (a)",
    "identity_query": "select @@identity", "call": "CALL p()", "exec": "execute dbo.p", "dollar_parameter": "a = $12", "at_parameter": "@p1",
}
TARGETS = ("mysql", "postgres", "mssql", "dameng")


def test_every_rule_fires(spark):
    assert {r[0] for r in RULES} == set(sc.ADVICE) == set(EXAMPLES) and len(RULES) == 28
    df = spark.createDataFrame(list(EXAMPLES.items()), "script_id string, sql string")
    fired = {(r["script_id"], r["rule_id"]) for t in TARGETS for r in sc.audit_sql(df, t).collect()}
    assert {(i, i) for i in EXAMPLES} <= fired
    matched = {(r["script_id"], r["rule_id"]) for t in TARGETS for r in sc.rule_match(df, t).collect()}
    assert matched == fired


def test_places_in_a_line_with_very_many_hits(spark):
    line = "".join(f"`n{i}`, 'lit' " for i in range(3000))
    found = audit(spark, line, "postgres")
    assert len(found) == 3000
    assert all(line[f["column_no"] - 1 :].startswith(f["snippet"]) for f in found)
    assert [f["snippet"] for f in found] == [f"`n{i}`" for i in range(3000)]


def test_audit_time_follows_the_hits(spark):
    """Ten times the matches in ten times the text, on one line and on many: about ten times the work, not a hundred times."""
    for sep in ("", "\n"):
        small, large = ("".join(f"`n{i}`, 'lit' {sep}" for i in range(n)) for n in (5_000, 50_000))
        audit(spark, small, "postgres")
        took = []
        for text in (small, large):
            start = time.perf_counter()
            found = sc.audit_sql(scripts(spark, text), "postgres").selectExpr("count(*)", "max(line_no)", "sum(length(snippet))").first()
            took.append(time.perf_counter() - start)
            n = text.count("`") // 2
            assert tuple(found) == (n, n if sep else 1, sum(len(f"`n{i}`") for i in range(n)))
        assert took[1] < 30 * max(took[0], 0.3)


def test_snippets_across_pages_and_wide_characters(spark):
    text = "é" * 250 + "😀 `nämé" + "x" * 40 + "`\n" + "ß" * 700 + " GETDATE ( )"
    found = audit(spark, text, "postgres")
    assert [(f["line_no"], f["column_no"], f["snippet"]) for f in found] == [(1, 253, "`nämé" + "x" * 40 + "`"), (2, 702, "GETDATE ( )")]


def test_summary_counts_clean_scripts(spark):
    out = sc.audit_summary(scripts(spark, "SELECT 1\n", "SELECT `a`, GETDATE() FROM t LIMIT 10"), "postgres").orderBy("script_id")
    assert [tuple(r) for r in out.collect()] == [(0, 0, 0, 0, 2), (1, 2, 0, 0, 1)]


@pytest.mark.parametrize(
    ("sql", "source", "target", "want"),
    [
        (
            "SELECT TOP 12 berth, tide FROM harbour WHERE seen < GETDATE() ORDER BY tide;", "mssql", "mysql",
            "SELECT berth, tide FROM harbour WHERE seen < NOW() ORDER BY tide LIMIT 12;",
        ),
        (
            "SELECT [berth].tide, ISNULL(flag, 'none') FROM [berth] WHERE moored = GETDATE();", "mssql", "postgres",
            "SELECT \"berth\".tide, COALESCE(flag, 'none') FROM \"berth\" WHERE moored = CURRENT_TIMESTAMP;",
        ),
        (
            "SELECT NVL(knots, 1), `berth`, IFNULL(flag, 'n') FROM `harbour`;", "mysql", "postgres",
            "SELECT COALESCE(knots, 1), \"berth\", COALESCE(flag, 'n') FROM \"harbour\";",
        ),
        ("SELECT TOP 30 PERCENT tide FROM berth;", "mssql", "mysql", "SELECT TOP 30 PERCENT tide FROM berth;"),
        (
            "SELECT TOP 2 s FROM (SELECT TOP 9 s FROM ship) q;", "mssql", "mysql",
            "SELECT TOP 2 s FROM (SELECT TOP 9 s FROM ship) q;",
        ),
        ("SELECT ISNULL(x, y) FROM [ship];", "mssql", "mssql", "SELECT ISNULL(x, y) FROM [ship];"),
        ("VALUES (GETDATE());", "mssql", "sqlite", "VALUES (CURRENT_TIMESTAMP);"),
        ("SELECT TOP 6 imo FROM [ship];", "mssql", "mysql", "SELECT imo FROM `ship` LIMIT 6;"),
        ("select top 5 'a  b' from t -- tail", "mssql", "mysql", "select 'a  b' from t -- tail\nLIMIT 5"),
        ("SELECT `a` FROM t", "mysql", "mssql", "SELECT [a] FROM t"),
        ("  ", "mssql", "mysql", "  "),
    ],
)
def test_rewrite(spark, sql, source, target, want):
    assert rewrite(spark, sql, source, target) == want


@pytest.mark.parametrize(
    ("sql", "source", "target", "want"),
    [
        (r"SELECT 'it\'s IFNULL(', IFNULL(a, 1) FROM `t`", "mysql", "postgres", r"""SELECT 'it\'s IFNULL(', COALESCE(a, 1) FROM "t" """[:-1]),
        (r"INSERT INTO t VALUES ('x\'; y'); SELECT NVL(a, b)", "mariadb", "postgres", "INSERT INTO t VALUES ('x\\'; y');\n SELECT COALESCE(a, b)"),
        ("SELECT * INTO #tmp FROM [a b] WHERE d < GETDATE(); SELECT TOP 3 x FROM #tmp", "mssql", "mysql", "SELECT * INTO #tmp FROM `a b` WHERE d < NOW();\n SELECT x FROM #tmp LIMIT 3"),
        ("SELECT [TOP 4], [GETDATE()], [a]]b] FROM [q`r]", "mssql", "mysql", "SELECT `TOP 4`, `GETDATE()`, `a]b` FROM `q``r`"),
        ("SELECT `NVL(`, `a``b`, `c\"d` FROM t", "mysql", "postgres", 'SELECT "NVL(", "a`b", "c""d" FROM t'),
        ("SELECT $q$ NVL(`a`) $q$, `b`", "postgres", "mssql", "SELECT $q$ NVL(`a`) $q$, [b]"),
        ("SELECT NVL(a, 'open", "mysql", "postgres", "SELECT NVL(a, 'open"),
    ],
)
def test_rewrite_by_source(spark, sql, source, target, want):
    assert rewrite(spark, sql, source, target) == want


def test_open_scripts_are_converted_apart(spark):
    done, rejected = sc.convert_scripts(scripts(spark, "SELECT NVL(a, b)", r"SELECT 'a\'", "/* x"), "mysql", "postgres")
    assert [r["sql"] for r in done.collect()] == ["SELECT COALESCE(a, b)"]
    assert [(r["script_id"], bool(r["reason"])) for r in rejected.orderBy("script_id").collect()] == [(1, True), (2, True)]
    counts = sc.rewrite_changes(scripts(spark, "SELECT `a`, NVL(`b`, 'NVL(')", "NVL( 'x"), "mysql", "postgres").orderBy("script_id").collect()
    assert [tuple(r) for r in counts] == [(0, 0, 0, 1, 2), (1, 0, 0, 0, 0)]


def test_classes_by_source(spark):
    df = spark.createDataFrame([("# note\nINSERT INTO t VALUES (1)",), ("#tmp",)], "statement string")
    assert [r["class"] for r in sc.classify_statements(df, source="mysql").collect()] == ["insert", "other"]
    df = spark.createDataFrame([("INSERT INTO #tmp VALUES (1)",)], "statement string")
    assert sc.classify_statements(df, source="mssql").first()["class"] == "insert"


def test_rewrite_leaves_literals_and_comments(spark):
    sql = "SELECT s FROM ship -- NVL(p, q)\nWHERE sign IN ('TOP 4', \"GETDATE()\");"
    assert rewrite(spark, sql, "mssql", "mysql") == sql
    assert sc.rewrite_changes(scripts(spark, sql), "mssql", "mysql").first()[1:] == (0, 0, 0, 0)


def test_short_inputs_are_spread_and_streams_left_alone(spark, sf, tmp_path):
    from ledgerlift.session import spread

    one = spark.read.parquet(f"{sf}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert spread(one).rdd.getNumPartitions() == cores and spread(spark.range(100, numPartitions=cores + 3)).rdd.getNumPartitions() == cores + 3
    grouped = one.groupBy("lang").count()
    assert spread(grouped) is grouped
    scripts(spark, "SELECT NVL(a, b)").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("script_id int, sql string").parquet(str(tmp_path / "s"))
    query = sc.audit_sql(stream, "postgres").writeStream.format("memory").queryName("audited").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert [r["rule_id"] for r in spark.table("audited").collect()] == ["nvl"]


def test_a_rewrite_finds_the_tokens_of_a_script_once(spark):
    from ledgerlift.functions.sqltokens import TOKENS

    rows = spark.range(0, 64, 1, 16).selectExpr("id AS script_id", "concat('SELECT IFNULL(a, ', id, ');') AS sql")
    for df in (sc.convert_scripts(rows, "mysql", "postgres")[0], sc.rewrite_sql(rows, "mysql", "postgres")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(TOKENS["mysql"][:30]) == 1
        assert sorted(r["sql"] for r in df.collect())[0] == "SELECT COALESCE(a, 0);"


def test_ends_of_scripts_are_kept_by_a_rewrite(spark):
    texts = {
        "": "", "  ": "  ", ";": ";", ";;": ";\n;", "select 1;;": "select 1;\n;", "select 1;\f": "select 1", "\u0001;\u0003": "\u0001;\n\u0003",
        "select top 3 a from t -- c;": "select a from t -- c;\nLIMIT 3;", "select [a;b] ; \n": "select `a;b] ; \n".replace("]", "`").replace(" ; \n", " ;"),
    }
    df = spark.createDataFrame(list(texts.items()) + [(None, None)], "sql string, want string")
    got = sc.convert_scripts(df, "mssql", "mysql")[0].collect()
    assert len(got) == len(texts) + 1
    assert [r["sql"] for r in got if r["sql"] != r["want"]] == []
