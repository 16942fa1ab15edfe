"""What a task's words say about the code: concepts, patterns of bodies, and functions that it is likely to change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.functions.text import camel_tokens, task_tokens
from rippleframe.sources.scratch import written

# Words of common concepts in code.
CONCEPTS = (
    "middleware", "handler", "router", "server", "client",
    "auth", "cache", "queue", "worker", "scheduler",
    "config", "logger", "validator", "serializ", "parser",
    "metric", "monitor", "rate", "limit", "circuit",
    "migrat", "command", "plugin", "hook", "event",
)
#: Functions of a file that a plan is taken to change at most.
PER_FILE = 3


def concepts(text: Column) -> Column:
    """Concepts that a text names, as parts of words too."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, CONCEPTS)), lambda c: F.contains(low, c))


def body_patterns(objective: Column, steps: Column) -> Column:
    """LIKE patterns for bodies that a task speaks of, in order; of patterns that differ in case alone the first."""
    text = F.lower(F.concat(objective, F.lit(" "), F.array_join(steps, " ")))
    says = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    words = F.filter(F.split(objective, r"\s+"), lambda w: w != "")
    none = F.array().cast("array<string>")
    pick = lambda told, some: F.when(told, some).otherwise(none)
    every = F.concat(
        pick(says("for loop", "range over"), F.array(F.lit("for %:= 0%<%++"), F.lit("for %:= 0%<%+="))),
        pick(says("error handling", "error wrap"), F.array(F.lit("if err != nil"))),
        pick(says("rename"), F.filter(words, lambda w: (F.octet_length(w) > 8) & w.rlike("^[A-Z]"))),
        pick(says("import", "migrate"), F.filter(words, lambda w: F.contains(w, F.lit("/")) & F.contains(w, F.lit(".")))),
        pick(says("deprecat"), F.array(F.lit("Deprecated"))),
        F.filter(words, lambda w: (F.octet_length(w) > 6) & w.rlike("^[A-Z].*[A-Z]") & ~w.rlike(r"[ .,;:!?()\[\]{}]")),
    )
    return F.filter(every, lambda w, i: ~F.exists(F.slice(every, F.lit(1), i), lambda v: F.lower(v) == F.lower(w)))


def mutation_score(name: Column, low: Column, parts: Column, text: Column, task: Column, flags: Column) -> Column:
    """struct<score, order, reason>: how likely a task with a lower-case ``text`` changes a function; score 0 if nothing says so.

    ``low`` and ``parts`` are the name in lower case and its camel tokens, ``task`` and ``flags``
    the words of the text and whether it speaks of flags: read once a name and once a text.
    """
    constructor = F.startswith(name, F.lit("NewCmd")) | (F.startswith(name, F.lit("New")) & F.endswith(name, F.lit("Cmd")))
    # A name that repeats a part counts it as often as it stands there.
    once = F.size(F.array_distinct(parts)) == F.size(parts)
    shared = F.when(once, F.size(F.array_intersect(parts, task))).otherwise(F.size(F.filter(parts, lambda t: F.array_contains(task, t))))
    by = {
        "mentioned": F.when(F.contains(text, low), 0.9),
        "run": F.when(F.endswith(low, F.lit("run")), 0.7),
        "constructor": F.when(constructor, F.when(flags, 0.8).otherwise(0.5)),
        "tokens": F.when(shared > 0, F.round((0.3 + 0.15 * shared) * 100) / 100),
    }
    # The first of the highest counts, as later rules have to exceed earlier ones.
    rules = [F.struct(F.coalesce(score, F.lit(0.0)).alias("score"), F.lit(-k).alias("order"), F.lit(reason).alias("reason")) for k, (reason, score) in enumerate(by.items())]
    return F.array_max(F.array(*rules))


def infer_mutations(plans: DataFrame, functions: DataFrame, k: int = PER_FILE, ahead: int = 8) -> DataFrame:
    """plans(plan_id, text, file), one text a plan, functions(file, name), exported ones -> plan_id, file, name, score, reason: of each planned file the ``k`` functions the task is likeliest to change.

    A name is scored once a plan, in however many of its files it stands. The ``ahead`` best names
    of a plan answer for the files that hold ``k`` of them; the other files meet all names.
    """
    own = written(plans.select("plan_id", "file").distinct().repartition("plan_id"), "planned")
    low = F.lower("text")
    flags = F.contains(low, F.lit("flag")) | F.contains(low, F.lit("option")) | F.contains(low, F.lit("--"))
    told = plans.select("plan_id", "text").distinct().select("plan_id", low.alias("text"), task_tokens(low).alias("task"), flags.alias("flags"))
    held = written(functions.select("file", "name").distinct(), "functions")
    names = held.select("name").distinct().select("name", F.lower("name").alias("low"), camel_tokens(F.col("name")).alias("parts"))
    # Put together by plan before names are rows, so that a plan's names are told apart where they are made.
    asked = own.repartition("plan_id").join(held, "file").select("plan_id", "name").distinct()
    m = mutation_score(*map(F.col, ("name", "low", "parts", "text", "task", "flags")))
    # As a row of its own the score is worked out once, not for each of its fields.
    scored = asked.join(told.hint("merge"), "plan_id").join(names, "name").select("plan_id", "name", F.inline_outer(F.array(m)))
    scored = written(scored.filter("score > 0").select("plan_id", "name", "score", "reason"), "scored")
    of_plan = Window.partitionBy("plan_id").orderBy(F.desc("score"), "name")
    best = scored.withColumn("r", F.row_number().over(of_plan)).filter(F.col("r") <= ahead).drop("r")
    of_file = Window.partitionBy("plan_id", "file").orderBy(F.desc("score"), "name")
    first = lambda df: df.withColumn("r", F.row_number().over(of_file)).filter(F.col("r") <= k)
    early = written(first(own.hint("merge").join(best.hint("merge"), "plan_id").join(held, ["file", "name"], "left_semi")), "early")
    # A file with fewer than k may hold names that come after the best of its plan.
    full = early.filter(F.col("r") == k).select("plan_id", "file")
    rest = own.join(full.hint("merge"), ["plan_id", "file"], "left_anti").join(held, "file").join(scored.hint("merge"), ["plan_id", "name"])
    done = early.join(full.hint("merge"), ["plan_id", "file"], "left_semi")
    columns = ["plan_id", "file", "name", "score", "reason"]
    return done.select(*columns).unionByName(first(rest).select(*columns))
