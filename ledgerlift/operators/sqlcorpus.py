"""Audit and rewrite large collections of SQL scripts: one row per script in, no Python per row.

Everything up to the per-script summaries is a map over rows; no script text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.functions.sqltokens import (
    WHITE, ascii_upper, ends_open, is_code, is_comment, is_name, join, let, map_code, mask_literals, needles, split_statements, sql_pattern,
    statement_tokens, stays_open, strip_white, tokens, upper_pattern,
)
from ledgerlift.functions.values import sql_text
from ledgerlift.operators import fixed_rules as fr
from ledgerlift.operators import fixed_types as fx
from ledgerlift.session import spread

ADVICE = fr.ADVICE
FAMILIES = {"mysql": fx.MYSQL_FAMILY, "postgres": fx.POSTGRES_FAMILY}
MOVE = "struct<chars:int,breaks:int,tail:int>"
HIT = f"struct<at:{MOVE},hit_len:int>"
CHUNK = 64  # matches laid out at a time
PAGE = 256  # characters of a page of the written text
FEW_HITS = 16  # up to so many snippets are cut from the text itself


def family_of(source: str | None) -> str | None:
    """Whose quoting rules a source dialect follows."""
    return next((f for f, members in FAMILIES.items() if source in members), "mssql" if source == "mssql" else None)


def open_scripts(df: DataFrame, text: str = "sql", source: str | None = None) -> DataFrame:
    """Scripts that end inside a string, a quoted name or a comment: they cannot be cut or audited with certainty."""
    return df.filter(ends_open(F.col(text), family_of(source)))


def rules_for(target: str) -> list[tuple[str, str, str, str]]:
    """Rules that apply to a target: id, category, severity, pattern."""

    def applies(scope: str) -> bool:
        words = scope.split()
        named = any(target == w or target in FAMILIES.get(w, ()) for w in words)
        return scope == "all" or (not named if words[0] == "not" else named)

    return [(i, c, s, p) for i, c, s, scope, p in fr.RULES if applies(scope)]


def _move(text: Column) -> Column:
    """What reading a text does to the place: characters passed, line breaks passed, characters since the last break."""
    n = F.char_length(text)
    return F.struct(n.alias("chars"), (n - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))).alias("breaks"), F.char_length(F.substring_index(text, "\n", -1)).alias("tail"))


def _then(a: Column, b: Column) -> Column:
    """One move after another."""
    tail = F.when(b["breaks"] > 0, b["tail"]).otherwise(a["tail"] + b["tail"])
    return F.struct((a["chars"] + b["chars"]).alias("chars"), (a["breaks"] + b["breaks"]).alias("breaks"), tail.alias("tail"))


def _running(steps: Column, start: Column) -> Column:
    """Place of each step (gap before it, match, both together) when laid end to end from ``start``."""

    def step(acc: Column, x: Column) -> Column:
        entry = F.struct(_then(acc["at"], x["gap"]).alias("at"), x["hit"]["chars"].alias("hit_len"))
        return F.struct(_then(acc["at"], x["both"]).alias("at"), F.concat(acc["out"], F.array(entry)).alias("out"))

    zero = F.struct(start.alias("at"), F.array().cast(f"array<{HIT}>").alias("out"))
    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


def _start() -> Column:
    return F.struct(*[F.lit(0).alias(n) for n in ("chars", "breaks", "tail")])


def _hits(code: Column, pattern: Column) -> Column:
    """Place (characters, line breaks, characters since the last break before it) and length of every match.

    Each piece between matches is measured once, and the measures are summed in
    chunks, so the work follows the text's length and the number of matches.
    """
    found = F.regexp_extract_all(code, pattern, F.lit(0))

    def steps(hits: Column) -> Column:
        moves = F.zip_with(
            F.slice(F.split(code, pattern), F.lit(1), F.size(hits)), hits,
            lambda before, hit: F.struct(_move(before).alias("gap"), _move(hit).alias("hit")),
        )
        return F.transform(moves, lambda m: F.struct(m["gap"].alias("gap"), m["hit"].alias("hit"), _then(m["gap"], m["hit"]).alias("both")))

    def place(all_steps: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(all_steps), F.lit(1)), F.lit(CHUNK))
        chunks = F.transform(firsts, lambda i: F.slice(all_steps, i, F.lit(CHUNK)))
        whole = F.transform(chunks, lambda c: F.aggregate(c, _start(), lambda at, x: _then(at, x["both"])))
        wide = F.transform(whole, lambda w: F.struct(_start().alias("gap"), w.alias("hit"), w.alias("both")))
        return F.flatten(F.zip_with(chunks, _running(wide, _start()), lambda c, w: _running(c, w["at"])))

    return let(let(found, steps), place)


def _snippets(written: Column, found: Column) -> Column:
    """Findings with the text they stand on, taken from pages of the written text, so that no prefix is read again."""
    kept = ("rule_id", "category", "severity", "suggestion")

    def cut(pages: Column, f: Column) -> Column:
        at, n = f["hit"]["at"]["chars"], f["hit"]["hit_len"]
        page = F.floor(at / PAGE).cast("int")
        near = F.concat(F.get(pages, page), F.coalesce(F.get(pages, page + 1), F.lit("")))
        shown_len = F.when(n > fr.SNIPPET_LIMIT, fr.SNIPPET_KEEP).otherwise(n)
        shown = F.when(pages.isNull(), F.substring(written, at + 1, shown_len)).otherwise(F.substring(near, at % PAGE + 1, shown_len))
        return F.struct(
            (f["hit"]["at"]["breaks"] + 1).alias("line_no"), (f["hit"]["at"]["tail"] + 1).alias("column_no"), *[f[k].alias(k) for k in kept],
            F.trim(F.when(n > fr.SNIPPET_LIMIT, F.concat(shown, F.lit("..."))).otherwise(shown)).alias("snippet"),
        )

    pages = F.regexp_extract_all(written, F.lit(rf"[\s\S]{{1,{PAGE}}}"), F.lit(0))
    return let(found, lambda hits: let(F.when(F.size(hits) > FEW_HITS, pages), lambda p: F.transform(hits, lambda f: cut(p, f))))


def _rules(target: str) -> Column:
    """The target's rules as one constant array, so that the plan does not grow with their number."""
    facts = [
        {"rule_id": i, "category": c, "severity": s, "suggestion": ADVICE[i], "pattern": upper_pattern(p), "words": needles(p)}
        for i, c, s, p in rules_for(target)
    ]
    return F.expr(sql_text(facts))


def _possible(rules: Column, code: Column) -> Column:
    """Rules whose keyword is in the code, a cheap look before a pattern is tried."""
    return F.filter(rules, lambda r: F.exists(r["words"], lambda w: F.contains(code, w)))


def audit_sql(df: DataFrame, target: str, text: str = "sql", keep_clean: bool = False, source: str | None = None) -> DataFrame:
    """Every construct the target does not take: where, which rule, how bad, and what to write instead.

    Rules see a script as a whole, so a construct broken over lines is found too.
    All hits of all rules are reported, with the 1-based line and column of their
    start. ``keep_clean`` keeps one empty row for each script without a hit. ``source``
    is the dialect the scripts are written in.
    """
    code = F.col("_code")

    def findings(r: Column) -> Column:
        facts = [r[n].alias(n) for n in ("rule_id", "category", "severity", "suggestion")]
        return F.transform(_hits(code, r["pattern"]), lambda h: F.struct(*facts, h.alias("hit")))

    keep = [c for c in df.columns if c != text]
    masked = spread(df).select(*keep, F.col(text).alias("_written"), _masked(text, source).alias("_code"))
    found = _snippets(F.col("_written"), F.flatten(F.transform(_possible(_rules(target), code), findings)))
    each = F.explode_outer(found) if keep_clean else F.explode(found)
    shown = ("line_no", "column_no", "rule_id", "category", "severity", "snippet", "suggestion")
    return masked.select(*keep, each.alias("_f")).select(*keep, *[F.col(f"_f.{n}").alias(n) for n in shown])


def _masked(text: str, source: str | None) -> Column:
    return ascii_upper(mask_literals(F.col(text), family_of(source)))


def _count_hits(pattern: str):
    return lambda total, s: total + F.regexp_count(s, F.lit(pattern))


def rule_match(df: DataFrame, target: str, text: str = "sql", source: str | None = None) -> DataFrame:
    """Scripts and the rules that hit their code at least once."""
    keep = [c for c in df.columns if c != text]
    rows = spread(df).select(*keep, _masked(text, source).alias("_code"))
    hit = F.transform(F.filter(_possible(_rules(target), F.col("_code")), lambda r: F.rlike("_code", r["pattern"])), lambda r: r["rule_id"])
    return rows.select(*keep, F.explode(F.array_distinct(hit)).alias("rule_id"))


def audit_summary(df: DataFrame, target: str, key: str = "script_id", text: str = "sql", source: str | None = None) -> DataFrame:
    """Findings per script by severity; a clean script shows zeros. Matches are counted, not placed."""
    levels = ("error", "warning", "info")
    zero = F.struct(*[F.lit(0).cast("bigint").alias(s) for s in levels])

    def add(total: Column, r: Column) -> Column:
        return let(F.regexp_count("_code", r["pattern"]), lambda n: F.struct(*[(total[s] + F.when(r["severity"] == s, n).otherwise(0)).alias(s) for s in levels]))

    lines = (F.char_length(text) - F.char_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).cast("long")
    rows = spread(df).select(key, lines.alias("_lines"), _masked(text, source).alias("_code"))
    counted = rows.select(key, "_lines", F.aggregate(_possible(_rules(target), F.col("_code")), zero, add).alias("_n"))
    return counted.groupBy(key).agg(*[F.coalesce(F.sum(f"_n.{s}"), F.lit(0)).alias(f"{s}s") for s in levels], F.max("_lines").alias("total_lines"))


def explode_statements(df: DataFrame, text: str = "sql", source: str | None = None) -> DataFrame:
    """One row per statement, numbered in script order; blank pieces are left out."""
    keep = [c for c in df.columns if c != text]
    cut = spread(df).select(*keep, F.posexplode(split_statements(F.col(text), family_of(source))).alias("_i", "_s"))
    return cut.select(*keep, (F.col("_i") + 1).alias("statement_no"), strip_white(F.col("_s")).alias("statement")).filter(F.col("statement") != "")


def statement_class(statement: Column, source: str | None = None) -> Column:
    """Class by the first words of code; comments in front do not count."""
    family = family_of(source)
    bare = join(F.filter(tokens(statement, family), lambda t: ~is_comment(t, family)))
    head = F.concat(F.upper(F.ltrim(bare, F.lit(WHITE))), F.lit(" "))

    def first(h: Column) -> Column:
        chain: Column | None = None
        for name, pattern in fr.STATEMENT_CLASSES:
            chain = F.when(h.rlike(pattern), name) if chain is None else chain.when(h.rlike(pattern), name)
        return chain.otherwise("other")

    return let(head, first)


def classify_statements(statements: DataFrame, column: str = "statement", source: str | None = None) -> DataFrame:
    return statements.withColumn("class", statement_class(F.col(column), source))


def conversion_summary(statements: DataFrame, key: str = "script_id", source: str | None = None) -> DataFrame:
    """Per script: statements converted by structure, passed with a rewrite, and skipped."""
    kind = F.col("class")
    return (
        classify_statements(statements, source=source)
        .groupBy(key)
        .agg(
            F.count("*").alias("total_statements"),
            F.count_if(kind.isin(*fr.CONVERTED)).alias("converted"),
            F.count_if(~kind.isin(*fr.CONVERTED, *fr.SKIPPED)).alias("passed"),
            F.count_if(kind.isin(*fr.SKIPPED)).alias("skipped"),
        )
    )


def _now(target: str) -> str:
    if target in fx.MYSQL_FAMILY:
        return "NOW()"
    return "SYSDATE" if target == "dameng" else "CURRENT_TIMESTAMP"


def _name_quotes(target: str) -> tuple[str, str]:
    return ("`", "`") if target in fx.MYSQL_FAMILY else ("[", "]") if target == "mssql" else ('"', '"')


def _replacements(source: str, target: str) -> list[tuple[str, str, str]]:
    """Change name, pattern and replacement of the rewrites of code that keep the meaning."""
    out = []
    from_mssql, from_mysql = source == "mssql", source in fx.MYSQL_FAMILY
    if from_mssql and target != "mssql":
        out.append(("now_calls", fr.GETDATE, _now(target)))
    if (from_mssql or source == "dameng") and target != "mssql":
        out.append(("coalesce_calls", fr.ISNULL, "COALESCE("))
    if from_mysql and target not in fx.MYSQL_FAMILY:
        out.append(("coalesce_calls", fr.IFNULL, "COALESCE("))
    if from_mysql or from_mssql or source == "dameng":
        out.append(("coalesce_calls", fr.NVL, "COALESCE("))
    if target not in fx.MYSQL_FAMILY and not from_mysql:
        opening, closing = _name_quotes(target)
        out.append(("quoted_names", fr.BACKTICK, f"{opening}$1{closing}"))
    return out


def _is_renamed(token: Column, source: str, target: str) -> Column:
    """A quoted name of the source whose quotes the target does not know."""
    if source in fx.MYSQL_FAMILY and target not in fx.MYSQL_FAMILY:
        return token.rlike(fr.BACKTICK_NAME)
    return token.rlike(fr.BRACKET_NAME) if source == "mssql" and target != "mssql" else F.lit(False)


def _renamed(token: Column, source: str, target: str) -> Column:
    """A quoted name in the target's quotes; doubled closing quotes inside are undone and done anew."""
    old, (opening, closing) = "`" if source in fx.MYSQL_FAMILY else "]", _name_quotes(target)
    name = F.replace(F.substring(token, F.lit(2), F.char_length(token) - 2), F.lit(old * 2), F.lit(old))
    return F.concat(F.lit(opening), F.replace(name, F.lit(closing), F.lit(closing * 2)), F.lit(closing))


def rewrite_statement(statement: Column, source: str, target: str) -> Column:
    """One statement in the target's dialect where that is safe; literals, comments and other names stay as written.

    What is a literal, a comment or a name follows the source's own quoting.
    """
    if source == target:
        return statement
    return let(tokens(statement, family_of(source)), lambda parts: _rewrite_tokens(parts, source, target))


def _plain_code(parts: Column, family: str | None) -> Column:
    """Code without literals, comments and quoted names, a blank for each."""
    return join(F.transform(parts, lambda t: F.when(is_code(t, family) & ~is_name(t, family), t).otherwise(" ")))


def _rewrite_tokens(parts: Column, source: str, target: str) -> Column:
    swaps, family = [(sql_pattern(p), to) for _, p, to in _replacements(source, target)], family_of(source)

    def changed(before) -> Column:
        def change(t: Column) -> Column:
            code = before(t)
            for pattern, to in swaps:
                code = F.regexp_replace(code, pattern, to)
            return F.when(_is_renamed(t, source, target), _renamed(t, source, target)).when(is_name(t, family), t).otherwise(code)

        return join(map_code(parts, change, family))

    if source != "mssql" or target == "mssql":
        return changed(lambda t: t)
    top = sql_pattern(fr.TOP_NUMBER)
    # TOP moves only when the statement has exactly one and the limit is a plain number of rows.
    limits = let(
        _plain_code(parts, family),
        lambda code: F.when(~code.rlike(sql_pattern(fr.TOP_UNSAFE)), F.regexp_extract_all(code, F.lit(top), F.lit(1))).otherwise(F.array().cast("array<string>")),
    )

    def with_limits(found: Column) -> Column:
        # After a trailing line comment the limit needs a line of its own.
        gap = F.when(is_comment(F.element_at(parts, -1), family) & ~F.element_at(parts, -1).startswith("/*"), "\n").otherwise(" ")
        without = changed(lambda t: F.regexp_replace(F.regexp_replace(t, top, ""), fr.BLANKS, " "))
        limited = F.concat(F.rtrim(without, F.lit(" \t\r\n")), gap, F.lit("LIMIT "), found[0])
        return F.when(F.size(found) == 1, limited).otherwise(changed(lambda t: t))

    return let(limits, with_limits)


def _rewritten_script(sql: Column, source: str, target: str, if_open) -> Column:
    """A script with every statement rewritten, its tokens found once; ``if_open`` says what becomes of one that stays open."""
    family = family_of(source)

    def statements(text: Column, found: Column) -> Column:
        blank_end = F.forall(F.element_at(found, -1), lambda t: strip_white(t) == "")
        kept = F.when(blank_end, F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found)
        out = F.array_join(F.transform(kept, lambda p: _rewrite_tokens(p, source, target)), ";\n")
        return F.when(F.rtrim(text, F.lit(" \t\r\n")).endswith(";"), F.concat(out, F.lit(";"))).otherwise(out)

    def script(text: Column, parts: Column) -> Column:
        written = F.exists(parts, lambda t: strip_white(t) != "")
        whole = F.when(written, let(statement_tokens(parts, family), lambda found: statements(text, found))).otherwise(text)
        return if_open(stays_open(F.try_element_at(parts, F.lit(-1)), family), whole, text)

    return let(sql, lambda text: let(tokens(text, family), lambda parts: script(text, parts)))


def rewrite_sql(df: DataFrame, source: str, target: str, text: str = "sql") -> DataFrame:
    """Scripts with every statement rewritten, joined by ``;`` and a line break as the converter prints them.

    A script that ends inside a literal, a name or a comment is returned as written;
    ``convert_scripts`` returns such scripts apart.
    """
    if source == target:
        return df
    out = _rewritten_script(F.col(text), source, target, lambda is_open, whole, written: F.when(is_open, written).otherwise(whole))
    return spread(df).select(*[out.alias(c) if c == text else F.col(c) for c in df.columns])


def convert_scripts(df: DataFrame, source: str, target: str, text: str = "sql") -> tuple[DataFrame, DataFrame]:
    """(scripts rewritten, scripts that cannot be cut with certainty, with a reason)."""
    rows = spread(df)
    is_open = ends_open(F.col(text), family_of(source))
    rejected = rows.filter(is_open).withColumn("reason", F.lit("a quote, a quoted name or a comment never closes"))
    if source == target:
        return rows.filter(~is_open), rejected
    # None or one result a script: a filter would have the tokens found a second time.
    out = _rewritten_script(F.col(text), source, target, lambda opened, whole, _: F.when(opened, F.array().cast("array<string>")).otherwise(F.array(whole)))
    return rows.select(*[F.explode(out).alias(c) if c == text else F.col(c) for c in df.columns]), rejected


def rewrite_changes(df: DataFrame, source: str, target: str, text: str = "sql") -> DataFrame:
    """How often each kind of rewrite applies, per script. Scripts that stay as written, being open, show zeros."""
    keep = [c for c in df.columns if c != text]
    names = ["top_to_limit", "now_calls", "coalesce_calls", "quoted_names"]
    zero, family = F.lit(0), family_of(source)
    totals = {n: zero for n in names}
    none = F.array().cast("array<array<string>>")
    parts = let(tokens(F.col(text), family), lambda t: F.when(stays_open(F.try_element_at(t, F.lit(-1)), family), none).otherwise(statement_tokens(t, family)))
    closed = spread(df).select(*keep, parts.alias("_parts"))
    rows = closed.select(*keep, "_parts", F.transform("_parts", lambda p: _plain_code(p, family)).alias("_code"))
    if source == "mssql" and target != "mssql":
        single = F.filter(
            "_code",
            lambda s: (F.regexp_count(s, F.lit(sql_pattern(fr.TOP_NUMBER))) == 1) & ~s.rlike(sql_pattern(fr.TOP_UNSAFE)),
        )
        totals["top_to_limit"] = F.size(single)
    for name, pattern, _ in _replacements(source, target):
        totals[name] = totals[name] + F.aggregate("_code", zero, _count_hits(sql_pattern(pattern)))
    renamed = F.size(F.filter(F.flatten("_parts"), lambda t: _is_renamed(t, source, target)))
    totals["quoted_names"] = totals["quoted_names"] + renamed
    return rows.select(*keep, *[totals[n].cast("int").alias(n) for n in names])


def requote_inserts(statement: Column, source: str | None = None) -> Column:
    """Backtick names of an INSERT as double-quoted names, outside literals."""
    family = family_of(source)
    return join(map_code(tokens(statement, family), lambda t: F.regexp_replace(t, fr.BACKTICK, '"$1"'), family))
