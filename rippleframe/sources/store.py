"""Logs and results as JSON tables under a project folder: appended, never rewritten in place; readers trim to the newest rows.

Each record has a type (check, outcome, reflection), a project, an id and a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HISTORY = (
    "type string, project string, id string, timestamp string, objective string, comodMisses array<string>, suggestedModify array<string>, outcome string, "
    "passes int, probe_findings int, persona_findings int, missed string, blast_radius int, test_coverage int, brier_score double, estimated_cost double, cwd string"
)
CALIBRATION = "checkId string, project string, timestamp string, predictedFiles array<string>, actualFiles array<string>, recall double, precision double, brierScore double, blastRadius int, confidence string, outcome string"
STEP = "array<struct<id:string,description:string>>"
KEEP_HISTORY, KEEP_CALIBRATION, MOST_ENTRIES = 50, 100, 10_000


class Store:
    """The tables of a root folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _exists(self, name: str) -> bool:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)

    def _read(self, name: str, schema: str) -> DataFrame:
        """Lines that are no JSON, or whose fields do not fit, are left out; no table is an empty one."""
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        said = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j")
        return self.spark.read.text(self._path(name)).select(said).filter("j IS NOT NULL AND j._bad IS NULL").select("j.*").drop("_bad")

    def history(self) -> DataFrame:
        """The newest ``KEEP_HISTORY`` records of each project; records without a type are checks."""
        rows = self._read("history", HISTORY).withColumn("type", F.coalesce("type", F.lit("check")))
        w = Window.partitionBy("project").orderBy(F.desc("timestamp"), F.desc("id"))
        return rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= KEEP_HISTORY).drop("r")

    def everything(self) -> DataFrame:
        return self._read("history", HISTORY)

    def append_checks(self, checks: DataFrame) -> None:
        checks.withColumn("type", F.lit("check")).write.mode("append").json(self._path("history"))

    def append_global(self, checks: DataFrame, cwd: str) -> None:
        checks.withColumn("cwd", F.lit(cwd)).write.mode("append").json(self._path("global"))

    def record_outcomes(self, outcomes: DataFrame) -> int:
        """Append outcomes (project, id, timestamp, outcome) whose check exists; the number of the others."""
        known = self._read("history", HISTORY).filter("coalesce(type, 'check') = 'check'").select("project", "id").distinct()
        outcomes.join(known, ["project", "id"], "left_semi").withColumn("type", F.lit("outcome")).write.mode("append").json(self._path("history"))
        return outcomes.join(known, ["project", "id"], "left_anti").count()

    def record_reflections(self, reflections: DataFrame) -> int:
        """Append reflections of two passes or more; the number of the others."""
        reflections.filter("passes >= 2").withColumn("type", F.lit("reflection")).write.mode("append").json(self._path("history"))
        return reflections.filter("passes < 2 OR passes IS NULL").count()

    def append_calibration(self, entries: DataFrame) -> None:
        entries.write.mode("append").json(self._path("calibration"))

    def calibration(self) -> DataFrame:
        w = Window.partitionBy("project").orderBy(F.desc("timestamp"), F.desc("checkId"))
        return self._read("calibration", CALIBRATION).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= KEEP_CALIBRATION).drop("r")

    def save(self, df: DataFrame, name: str) -> None:
        """A result, weights, rates or a simulation, in place of what was there."""
        df.write.mode("overwrite").json(self._path(name))

    def load(self, name: str, schema: str) -> DataFrame:
        return self._read(name, schema)

    def clear_history(self) -> None:
        """Checks, outcomes and reflections go; whatever else is stored stays."""
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(self._path("history"))
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def weights(self, project: str, defaults: dict[str, float]) -> DataFrame:
        """One row of weights: the project's, else the global ones, else the defaults."""
        schema = "project string, " + ", ".join(f"{k} double" for k in defaults)
        stored = self._read("weights", schema)
        rank = F.when(F.col("project") == project, 0).when(F.col("project") == "*", 1)
        base = self.spark.createDataFrame([("", *defaults.values())], schema)
        every = stored.withColumn("p", rank).filter("p IS NOT NULL").unionByName(base.withColumn("p", F.lit(2)))
        return every.orderBy("p").limit(1).drop("p", "project")


def overlaid(defaults: dict[str, float], override: DataFrame) -> DataFrame:
    """Thresholds with what the override row sets to anything but zero."""
    return override.select(*[F.coalesce(F.nullif(F.col(k), F.lit(0.0)), F.lit(float(v))).alias(k) for k, v in defaults.items()])


def parse_plans(texts: DataFrame) -> DataFrame:
    """id, plan columns and ``problem`` of plan JSON texts (id, text).

    Steps are strings or {id, description}; unknown fields are ignored, absent lists are empty.
    ``problem`` says what is missing or too long, null where the plan is fine.
    """
    lists = ("filesToRead", "filesToModify", "filesToCreate")
    base = F.from_json("text", "objective string, steps array<string>, acknowledgedComod map<string,string>, testPatch string, " + ", ".join(f"{c} array<string>" for c in lists))
    said = F.from_json("text", f"steps {STEP}")
    empty = F.array().cast("array<string>")
    rows = texts.select("id", base.alias("p"), said.alias("s"))
    steps = F.when(F.exists(F.coalesce("s.steps", F.array().cast(STEP)), lambda x: x["description"].isNotNull()), F.transform("s.steps", lambda x: x["description"])).otherwise(F.coalesce("p.steps", empty))
    out = rows.select("id", "p.objective", steps.alias("steps"), "p.acknowledgedComod", "p.testPatch", *[F.coalesce(F.col(f"p.{c}"), empty).alias(c) for c in lists])
    long = F.greatest(*[F.size(c) for c in (*lists, "steps")]) > MOST_ENTRIES
    problem = F.when(F.coalesce("objective", F.lit("")) == "", "no objective").when(F.size("steps") == 0, "no steps").when(long, "too many entries")
    return out.withColumn("problem", problem)


def tool_calls(texts: DataFrame) -> DataFrame:
    """session, tool, file, ts of session traces, one JSON message a line (id, text); lines over 1 MB or no JSON are left out."""
    schema = "timestamp string, message struct<content:array<struct<type:string,name:string,input:string>>>"
    each = texts.select(F.col("id").alias("session"), F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") < (1 << 20))
    calls = each.select("session", F.from_json("line", schema).alias("m")).select("session", "m.timestamp", F.explode("m.message.content").alias("c")).filter("c.type = 'tool_use'")
    file = F.coalesce(F.get_json_object("c.input", "$.file_path"), F.get_json_object("c.input", "$.path"))
    return calls.select("session", F.col("c.name").alias("tool"), file.alias("file"), F.try_to_timestamp("timestamp").alias("ts"))


def price(tokens: DataFrame, prices: dict[str, tuple[float, float]], default: tuple[float, float]) -> DataFrame:
    """tokens(model, input, output) with their cost at prices a million tokens; models without a price take the default."""
    rows = tokens.sparkSession.createDataFrame([(m, *p) for m, p in prices.items()] or [("", *default)], "model string, p_in double, p_out double")
    joined = tokens.join(F.broadcast(rows), "model", "left")
    cost = (F.col("input") * F.coalesce("p_in", F.lit(default[0])) + F.col("output") * F.coalesce("p_out", F.lit(default[1]))) / 1_000_000
    return joined.withColumn("cost", cost).drop("p_in", "p_out")


def content_key(*parts: Column) -> Column:
    """16 hex digits of the parts, for caches by content."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)
