"""URL filter: a sort-merge range join of URLs against nested host rules, all in native expressions.

Each rule's host becomes an interval of reversed-host keys (``example.com`` -> ``com.example.``), and
because subdomains extend the key, the intervals of all rules are nested or apart. Sorting the
rules' end points once gives, between two neighbouring points, a fixed stack of active rules.
The URLs, keyed the same way, are merged with these points in key order, and each takes the
last point before it: a sweep with a stack. Of the stack's rules whose path fits, the longest wins.

The sweep runs in key ranges cut at sampled keys. The key ends in a hash of the row, so one host
or one URL that has a third of all rows is cut as well. A range starts with the stack that is
active there. The cut points only balance the work; they never change a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Above every byte that UTF-8 text has.
_TOP = "\U0010ffff"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    """``www.example.com`` -> ``com.example.www.``; an empty host gives an empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def sweep_points(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, list[tuple[str, str, str]]]]:
    """The stack of active rules from each end point on, by a sweep over the sorted rule intervals."""
    starts: dict[str, list] = {}
    for verdict, host, path in rules:
        starts.setdefault(_key(host.lower()), []).append((verdict, host.lower(), path))
    events = sorted([(k, 1, k) for k in starts] + [(k + _TOP, 0, k) for k in starts])
    stack: list[str] = []
    points: dict[str, list] = {"": []}
    for at, opens, key in events:
        if opens:
            stack.append(key)
        else:
            stack.remove(key)
        points[at] = [rule for k in stack for rule in starts[k]]
    return sorted(points.items())


def _bucket(key: Column, cuts: list[str]) -> Column:
    """Number of cuts at or below the key, by binary search."""
    if not cuts:
        return F.lit(0)
    steps = 1 << (len(cuts)).bit_length()
    sorted_cuts = F.array([F.lit(c) for c in cuts])
    halves = []
    while steps:
        halves.append(F.lit(steps))
        steps //= 2
    n = F.lit(len(cuts))
    return F.aggregate(F.array(halves), F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(sorted_cuts, at + step - 1) <= key), at + step).otherwise(at))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    url_col: str = "url",
    id_col: str = "page_id",
    default: str = "allow",
    rows_per_range: int = 100_000,
    least_ranges: int = 48,
    most_ranges: int = 8192,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the URL's path starts with the rule's path. The longest rule
    (host and path) wins; of equally long ones the one with the longer host, then ``block``. Without a fitting rule: null
    and ``default``. Null URLs and those without ``://`` have an empty host and path. Repeated rows each
    give a row; null ids are kept; other columns are left out, so no names clash. ``rules``
    is a list in the driver's hands, bounded by what a plan can hold (some ten thousand).
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("key", F.concat(reversed_key(F.col("host")), F.lit("\x01"), F.hex(F.xxhash64("page_id", "host", "path"))))
    count = rows.count()
    ranges = max(least_ranges, min(most_ranges, count // rows_per_range))
    share = min(1.0, 40.0 * ranges / max(count, 1))
    sample = sorted(r[0] for r in rows.select("key").sample(fraction=share, seed=7).collect()) if count else []
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    # The rules' points, and at the start of each range the stack that is active there.
    points = sweep_points(rules)
    stacked: dict[str, list] = dict(points)
    keys = [k for k, _ in points]
    for cut in cuts:
        import bisect

        stacked.setdefault(cut, points[bisect.bisect_right(keys, cut) - 1][1])
    schema = "key string, stack array<struct<verdict:string,host:string,path:string>>"
    marks = pages.sparkSession.createDataFrame(sorted(stacked.items()), schema)
    marks = marks.select(F.lit(None).cast(rows.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "key", "stack", F.lit(0).alias("kind"))
    merged = rows.select("page_id", "host", "path", "key", F.lit(None).cast(marks.schema["stack"].dataType).alias("stack"), F.lit(1).alias("kind")).unionByName(marks)
    merged = merged.withColumn("range", _bucket(F.col("key"), cuts))
    order = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = merged.withColumn("active", F.last("stack", ignorenulls=True).over(order)).filter("kind = 1")
    fitting = F.filter("active", lambda r: F.col("path").startswith(r["path"]))
    ranked = F.transform(
        fitting,
        lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("n"), F.length(r["host"]).alias("h"), r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule")),
    )
    best = F.array_max(ranked)
    swept = swept.select("page_id", "host", "path", best.alias("best"))
    return swept.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
