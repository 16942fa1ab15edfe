"""Queries of scalar functions over the driver's texts and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.functions import text as T
from rippleframe.operators import history
from rippleframe.plans.base import query
from rippleframe.sources.views import table, view

_SING = "CASE WHEN ends_with(w, 'ies') AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN ends_with(w, 'es') AND length(w) > 3 THEN CASE WHEN regexp_matches(left(w, length(w) - 2), '(ch|sh|x|z)$') THEN left(w, length(w) - 2) ELSE left(w, length(w) - 1) END WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND length(w) > 2 THEN left(w, length(w) - 1) ELSE w END"
_PATH = "p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM {pages}) "


def _paths(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return table(spark, sf, "pages").select("page_id", path.alias("path"))


@query("AND_VIEWS t AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS w FROM {benchmark}), u AS (SELECT item_id, w FROM t WHERE length(w) >= 2 UNION SELECT item_id, " + _SING + " FROM t WHERE length(w) >= 2) SELECT item_id, count(*) AS n, string_agg(w, ' ' ORDER BY encode(w)) AS tokens FROM u GROUP BY 1")
def tokenize(spark, sf):
    t = table(spark, sf, "benchmark").select("item_id", T.tokenize(F.col("text")).alias("t"))
    return t.select("item_id", F.size("t").cast("long").alias("n"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


@query("AND_VIEWS t AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS w FROM {benchmark}) SELECT w, " + _SING + " AS singular FROM t WHERE length(w) >= 2")
def singularize(spark, sf):
    w = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).filter("length(w) >= 2").distinct()
    return w.select("w", T.singularize(F.col("w")).alias("singular"))


@query("AND_VIEWS " + _PATH + "SELECT page_id, regexp_replace(path, '^.*/', '') AS base, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir, regexp_extract(regexp_replace(path, '^.*/', ''), '(\\.[^.]*)$', 1) AS ext FROM p")
def path_parts(spark, sf):
    p = F.col("path")
    return _paths(spark, sf).select("page_id", T.basename(p).alias("base"), T.dirname(p).alias("dir"), T.extension(p).alias("ext"))


@query("SELECT plan_id, left(sha256('plan ' || plan_id || chr(0) || string_agg(file, chr(0) ORDER BY file)), 16) AS hash FROM {planned} GROUP BY 1")
def plan_hash(spark, sf):
    plans = view(spark, sf, "planned").groupBy("plan_id").agg(F.collect_list("file").alias("f"))
    return plans.select("plan_id", T.plan_hash(F.concat(F.lit("plan "), F.col("plan_id")), F.col("f")).alias("hash"))


_POLY = "CAST(list_reduce(list_transform(range(1, strlen(url) + 1), lambda i: CAST(ascii(url[i]) AS HUGEINT)), lambda h, c: (h * 31 + c) % 18446744073709551616, 0::HUGEINT) AS UBIGINT)"


@query("SELECT page_id, lpad(lower(to_hex(" + _POLY + ")), 16, '0') AS hash FROM {pages}")
def project_hash(spark, sf):
    return view(spark, sf, "pages").select("page_id", T.poly31(F.col("url")).alias("hash"))


@query("AND_VIEWS h AS (SELECT split_part(url, '/', 3) AS root, left(sha256(url), 2) AS hash FROM {pages}) SELECT hash, count(DISTINCT root) AS roots FROM h GROUP BY 1 HAVING count(DISTINCT root) > 1")
def hash_collisions(spark, sf):
    """Short hashes that several roots share."""
    roots = view(spark, sf, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("root"), F.substring(F.sha2("url", 256), 1, 2).alias("hash"))
    return roots.groupBy("hash").agg(F.countDistinct("root").alias("roots")).filter("roots > 1")


@query("AND_VIEWS w AS (SELECT item_id, unnest(regexp_split_to_array(text, '[^a-z0-9]+')) AS w FROM {benchmark}) SELECT item_id, string_agg(DISTINCT w, ' ' ORDER BY w) AS tokens FROM w WHERE length(w) >= 3 GROUP BY 1")
def task_tokens(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.task_tokens(F.col("text")), " ").alias("tokens")).filter("tokens <> ''")


@query("SELECT id, CASE WHEN receiver = '' THEN name ELSE '(' || receiver || ').' || name END AS display FROM {defs}")
def display_names(spark, sf):
    return view(spark, sf, "defs").select("id", T.display_name(F.col("name"), F.col("receiver")).alias("display"))


@query("SELECT event_id, ts >= (SELECT max(ts) FROM {events}) - INTERVAL 24 HOUR AS within_day, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS days FROM {events} WHERE event_type = 'error'")
def error_window(spark, sf):
    e = table(spark, sf, "events")
    newest = F.broadcast(e.agg(F.max("ts").alias("newest")))
    found = e.filter("event_type = 'error'").join(newest)
    return found.select("event_id", (F.col("ts") >= F.col("newest") - F.expr("INTERVAL 24 HOURS")).alias("within_day"), F.datediff(F.lit("2024-01-31").cast("date"), "ts").cast("long").alias("days"))


@query("SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, count(*) AS n FROM {events} GROUP BY 1")
def json_field(spark, sf):
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("AND_VIEWS n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM {events} WHERE value IS NOT NULL) SELECT event_type, event_id, CAST(r AS INTEGER) AS r FROM n WHERE r <= 3")
def top_k_per_group(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, sf, "events").filter("value IS NOT NULL").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 3).select("event_type", "event_id", "r")


@query("SELECT user_id, min(event_id) AS event_id FROM {events} WHERE event_type = 'error' GROUP BY 1")
def first_wins(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'error'")
    return history.first_of(e, ["user_id"], F.asc("event_id")).select("user_id", "event_id")
