"""URL filters: a trie over reversed host labels and then path segments; the longest fitting rule decides."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlift.llm.texts import pick, settle

TRIE_BYTES = 8 << 20  # rule text that one trie may hold
DEFAULT = "allow"  # verdict where no rule fits
# The rules of the query, as (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): both empty without ``://``."""
    if not url:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return lower(host), slash + path


def lower(host: str) -> str:
    """A-Z only; other letters have no host rule to fold them."""
    return host.lower() if host.isascii() else host.encode().lower().decode()


class UrlTrie:
    """Host labels from the last to the first, then whole path segments, then the rest of a rule's path as a prefix."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(lower(host).split(".")):
                node = node.setdefault("." + label, {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault("/" + segment, {})
            ends = node.setdefault("", {})  # prefixes of the text that follows here
            # longest rule wins; of two equal ones, the block
            ends[rest] = max(ends.get(rest, (0, "", "")), (len(host) + len(path), verdict, host + path))

    def find(self, host: str, path: str) -> tuple[int, str, str] | None:
        """(length, verdict, rule) of the longest rule that fits."""
        best = None
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("." + label)
            if node is None:
                break
            at = node
            for segment in segments:  # at each depth the rest of the path begins with this segment
                for rest, entry in at.get("", {}).items():
                    if segment.startswith(rest) and (best is None or entry > best):
                        best = entry
                at = at.get("/" + segment)
                if at is None:
                    break
        return best


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per page row: host, path, rule (NULL where none fits) and verdict.

    ``rules`` has verdict, host and path. A rule fits its host and all hosts below,
    if the path begins with the rule's; an empty rule path fits every path. Rules
    with a NULL part are no rules; repeated ones count once; without rules every
    page gets ``default``. A NULL url, or one without ``://``, has an empty host and
    path. Of two rules of one length the block wins.

    The rules are measured first; a table above ``trie_bytes`` is cut by hash into
    tries of that size which the pages pass one after the other, the longest fit so
    far going along, so that what is sent to the executors stays bounded.
    """
    known = pick(rules, verdict="verdict", host="host", path="path").where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL")
    total = known.agg(F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // trie_bytes))
    rows = pick(pages, page_id=page_id, url=url)
    for part in range(parts):
        mine = known if parts == 1 else known.where(F.pmod(F.xxhash64("host", "path"), F.lit(parts)) == part)
        rows = rows.withColumn(f"__fit_{part}", _fit(UrlTrie([tuple(r) for r in mine.collect()]))(F.col("url")))
        if parts > 1:
            rows = settle(rows)
    fits = [F.col(f"__fit_{p}") for p in range(parts)]
    best = F.array_max(F.array(*[F.struct(f["size"], f["verdict"], f["rule"]) for f in fits]))
    return rows.select(
        "page_id", fits[0]["host"].alias("host"), fits[0]["path"].alias("path"), best["rule"].alias("rule"),
        F.coalesce(best["verdict"], F.lit(default)).alias("verdict"),
    )


def _fit(trie: UrlTrie):
    def fit(urls: pa.Array) -> pa.Array:
        cut = [split_url(u) for u in urls.to_pylist()]
        found = [trie.find(*c) or (None, None, None) for c in cut]
        columns = [[c[0] for c in cut], [c[1] for c in cut], [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "path", "size", "verdict", "rule"])

    fit.__annotations__ = {"urls": pa.Array, "return": pa.Array}
    return F.arrow_udf(fit, "struct<host:string,path:string,size:bigint,verdict:string,rule:string>").asNondeterministic()
