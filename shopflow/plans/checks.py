"""Plan checks: read the physical plan Spark chose for an analysis.

Used by the tests to keep the plans in the shape the library promises: no
Cartesian products or nested-loop joins, no ``Expand`` that copies every
row per distinct aggregate, filters pushed into the Parquet scans.
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def problems(df: DataFrame) -> list[str]:
    """Plan shapes that do not scale, as readable messages (empty when fine)."""
    text = plan_text(df, "extended")
    out = []
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if bad in text:
            out.append(f"plan has {bad}")
    for m in re.finditer(r"Expand \[\[(.*?)\]\]", text, flags=re.S):
        out.append(f"Expand with {m.group(1).count('], [') + 1} projections")
    return out


def pushed_filters(df: DataFrame) -> list[str]:
    """``PushedFilters`` lists of the plan's file scans."""
    return re.findall(r"PushedFilters: \[(.*?)\]", plan_text(df, "formatted"))


def read_schemas(df: DataFrame) -> list[str]:
    """``ReadSchema`` of the plan's file scans (the columns actually read)."""
    return re.findall(r"ReadSchema: (struct<.*?>)", plan_text(df, "formatted"))


def shuffle_keys(df: DataFrame) -> list[str]:
    """What each shuffle of the plan deals its rows by, without column numbers."""
    return [re.sub(r"#\d+L?", "", m) for m in re.findall(r"Arguments: (?:hash|range)partitioning\((.*?), \d+\)", plan_text(df, "formatted"))]


def partition_filters(df: DataFrame) -> list[str]:
    """``PartitionFilters`` lists of the plan's file scans."""
    return re.findall(r"PartitionFilters: \[(.*?)\]", plan_text(df, "formatted"))


def digest(df: DataFrame) -> dict:
    """Counts of the operators that cost at scale in the physical plan:
    shuffles, scans, joins by strategy, aggregates by kind, windows,
    sorts and subqueries."""
    text = plan_text(df, "formatted")
    nodes = re.findall(r"^\(\d+\) ([A-Za-z]+(?: [A-Za-z]+)*)", text, flags=re.M)
    count = lambda *names: sum(1 for n in nodes if any(n.startswith(x) for x in names))
    joins = [n for n in nodes if "Join" in n]
    return {
        "shuffles": count("Exchange"),
        "broadcasts": count("BroadcastExchange"),
        "scans": count("Scan parquet"),
        "joins": ", ".join(sorted(joins)) or "-",
        "hash_aggregates": count("HashAggregate"),
        "sort_aggregates": count("SortAggregate", "ObjectHashAggregate"),
        "windows": count("Window"),
        "subqueries": len(re.findall(r"^Subquery:\d+", text, flags=re.M)),
    }


def digest_table(spark, folder: str, names=None) -> str:
    """Markdown table of :func:`digest` for registered queries."""
    from shopflow.plans.registry import QUERIES
    rows = ["| query | shuffles | scans | joins | hash agg | sort agg | windows | subqueries |",
            "| --- | --- | --- | --- | --- | --- | --- | --- |"]
    for name in sorted(names or QUERIES):
        d = digest(QUERIES[name](spark, folder))
        rows.append(f"| `{name}` | {d['shuffles'] - d['broadcasts']} | {d['scans']} | {d['joins']} | "
                    f"{d['hash_aggregates']} | {d['sort_aggregates']} | {d['windows']} | {d['subqueries']} |")
    return "\n".join(rows)


if __name__ == "__main__":      # python -m shopflow.plans.checks [folder]
    import sys
    import tempfile

    from shopflow.session import build_session
    spark = build_session("local[4]", shuffle_partitions=8, extra={
        "spark.sql.autoBroadcastJoinThreshold": "-1",        # the plan shape when no side is small
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="shopflow-digest-")})
    print(digest_table(spark, sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"))
