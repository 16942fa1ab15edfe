"""Change history, reference graph, file manifest, signals and outcomes as views of the driver's tables.

Each view is one SQL text that Spark and DuckDB read alike; its braces name tables or other views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from rippleframe.sources.scratch import discard, written

_PARTS = "{lineitem} JOIN {part} ON l_partkey = p_partkey"
_OWNED = _PARTS + " JOIN {orders} ON l_orderkey = o_orderkey"
_PATH = "p_type || '/' || p_brand || '/' || replace(p_name, ' ', '_') || '.go'"

VIEWS = {
    # Each order is a commit, each brand in it a file.
    "commits": f"SELECT DISTINCT l_orderkey AS commit_id, p_brand AS file FROM {_PARTS}",
    # The same with files in directories.
    "commit_paths": f"SELECT DISTINCT l_orderkey AS commit_id, {_PATH} AS file FROM {_PARTS}",
    # Its rows before they are made distinct.
    "commit_lines": f"SELECT l_orderkey AS commit_id, {_PATH} AS file FROM {_PARTS}",
    "defs": "SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name, p_type AS receiver, p_brand AS source_file, p_size AS module_id, p_size % 5 = 0 AS is_test, p_size % 2 = 0 AS exported FROM {part}",
    # Parts on consecutive lines of an order.
    "refs": "SELECT DISTINCT a.l_partkey AS from_def, b.l_partkey AS to_def FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey",
    # A graph whose closures do not reach everything.
    "sparse_refs": "SELECT DISTINCT a.l_partkey AS from_def, b.l_partkey AS to_def FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey AND a.l_orderkey % 20 = 0",
    # What the body of a caller says about the definition it refers to.
    "bodies": "SELECT from_def, to_def, CASE from_def % 6 WHEN 0 THEN 'x := a.' || name || '(y)' WHEN 1 THEN 'return ' || name || ' (y)' WHEN 2 THEN 'v := z.(*' || name || ')' WHEN 3 THEN 'a.' || name || ' = 1' WHEN 4 THEN 'var x ' || name ELSE 'return nil' END AS body FROM {refs} JOIN {defs} ON id = to_def",
    "manifest": f"SELECT DISTINCT {_PATH} AS path, p_type || '/' || p_brand AS dir, p_type AS parent, replace(p_name, ' ', '_') || '.go' AS base FROM {{part}}",
    # A plan, and a task, is a customer; its files are the brands on its orders' lines.
    "signals": f"SELECT o_custkey AS plan_id, p_brand AS file, CASE l_linenumber % 5 WHEN 0 THEN 'structural' WHEN 1 THEN 'comod' WHEN 2 THEN 'semantic' WHEN 3 THEN 'keyword-dir' ELSE 'verified-spike' END AS source, max(l_discount) * 10 AS score FROM {_OWNED} GROUP BY 1, 2, 3",
    "planned": f"SELECT DISTINCT o_custkey AS plan_id, p_brand AS file FROM {_OWNED} WHERE l_returnflag = 'R'",
    "predicted": f"SELECT DISTINCT o_custkey AS task_id, p_brand AS file FROM {_OWNED} WHERE l_returnflag = 'A'",
    "actual": f"SELECT DISTINCT o_custkey AS task_id, p_brand AS file FROM {_OWNED} WHERE l_linestatus = 'O'",
    "log": "SELECT event_id, ts, user_id % 20 AS project, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}",
    "outcomes": "SELECT o_orderkey AS id, o_custkey % 40 AS project, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS recall, CAST(o_orderkey % 9 AS DOUBLE) / 8 AS precision_, CAST(o_custkey % 7 AS DOUBLE) / 10 AS density, o_custkey % 30 AS complexity, o_custkey % 25 AS blast, o_orderkey % 4 AS depth, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'rework' ELSE 'clean' END AS outcome, CASE WHEN o_orderkey % 3 = 0 THEN 'high' WHEN o_orderkey % 3 = 1 THEN 'moderate' ELSE 'low' END AS confidence FROM {orders}",
    # Every customer's plan.
    "customer_plans": "SELECT c_custkey AS plan_id, c_custkey % 30 AS complexity, CAST(c_custkey % 7 AS DOUBLE) / 10 AS density, c_custkey % 25 AS blast, c_custkey % 4 AS depth FROM {customer}",
    # What the customers of a nation and segment plan together.
    "plans": "SELECT concat_ws('-', c_nationkey, c_mktsegment) AS plan_id, CAST(sum(c_custkey) % 30 AS BIGINT) AS complexity, CAST(sum(c_custkey) % 7 AS DOUBLE) / 10 AS density, CAST(sum(c_custkey) % 25 AS BIGINT) AS blast, CAST(sum(c_custkey) % 4 AS BIGINT) AS depth, CAST(sum(c_custkey) % 29 AS BIGINT) AS cascade_files FROM {customer} GROUP BY 1",
}

_kept: dict[tuple, DataFrame] = {}
#: Views that many queries read and that take a join to build: written once for a state of the input.
_WRITTEN = ("refs", "sparse_refs")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_tasks(spark: SparkSession, sf_dir: str, lines: int) -> int:
    """Tasks among which rows go where each is to hold those of about ``lines`` lines of orders."""
    return table(spark, sf_dir, "lineitem").count() // lines + 1


def _state(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """The time and size of the file or folder of each table behind a view."""
    if name in VIEWS:
        return tuple(_state(spark, sf_dir, x) for x in _names(VIEWS[name]))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    return name, status.getModificationTime(), status.getLen()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    make = lambda: spark.sql(VIEWS[name], **{x: view(spark, sf_dir, x) for x in _names(VIEWS[name])})
    if name not in _WRITTEN:
        return make()
    key = (spark.sparkContext.applicationId, sf_dir, name, _state(spark, sf_dir, name))
    if key not in _kept:
        for old in [k for k in _kept if k[:3] == key[:3]]:
            discard(_kept.pop(old))
        _kept[key] = written(make(), name)
    return _kept[key]


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"{(\w+)}", text)))


def with_views(body: str, recursive: bool = False) -> str:
    """``body`` with the views it names in braces, in DuckDB's dialect; further clauses may follow "AND_VIEWS"."""
    done: dict[str, str] = {}

    def need(text: str) -> str:
        for x in _names(text):
            if x in VIEWS and x not in done:
                done[x] = need(VIEWS[x])
        return re.sub(r"{(\w+)}", r"\1", text)

    text = need(body)
    views = ", ".join(f"{k} AS ({v})" for k, v in done.items())
    head = f"WITH {'RECURSIVE ' * recursive}{views}" if views else ""
    return head + (", " if head else "WITH ") + text[len("AND_VIEWS "):] if text.startswith("AND_VIEWS ") else f"{head} {text}"
