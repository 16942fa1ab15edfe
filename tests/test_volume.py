"""Rows that queries shuffle: how they grow, with results checked in Python."""

import hashlib
import math
from collections import Counter, defaultdict

from rippleframe.operators import comod, compound, evaluate, forecast, gaps
from rippleframe.sources.scratch import written


def shuffled(spark, run):
    """What ``run`` returns, and the rows that were shuffled for it."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = stages()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(n for k, n in stages().items() if k not in before)


def test_draws_find_outcomes_without_moving_them_for_each_plan(spark, monkeypatch):
    monkeypatch.setattr(forecast, "RUN", 50)
    n, plans, draws = 4000, 40, 60
    # Ids out of order; every third outcome is like none of the plans.
    data = [(k * 7919 % 10_007, (k * 31 % 101) / 100, "", 5 if k % 3 else 500, 0.5, 3, 0) for k in range(n)]
    outcomes = spark.createDataFrame(data, "id long, recall double, outcome string, complexity int, density double, blast int, depth int").repartition(6)
    asked = spark.createDataFrame([(k, 5, 0.5, 3, 0, 0) for k in range(plans)], "plan_id long, complexity int, density double, blast int, depth int, cascade_files int")
    got, rows = shuffled(spark, lambda: {r["plan_id"]: r for r in forecast.forecast_draws(asked, outcomes, draws).collect()})
    alike = [x[1] for x in sorted(data) if x[3] == 5]
    for plan in range(plans):
        digest = lambda d: int(hashlib.md5(f"recall:{plan}:{d}:42".encode()).hexdigest()[:15], 16)
        drawn = sorted(alike[digest(d) % len(alike)] for d in range(1, draws + 1))
        assert got[plan]["n"] == len(alike) and got[plan]["mean"] == math.floor(sum(drawn) / draws * 100 + 0.5) / 100
        assert [got[plan][c] for c in ("p50", "p85", "p95")] == [drawn[math.floor(p * (draws - 1))] for p in (0.5, 0.85, 0.95)]
    # Numbered plan by plan, the similar outcomes alone were ``plans`` times 2,666 rows.
    assert rows < 85_000


def _project(spark, n_plans, n_files=20, each=6):
    """plans, refs, defs and commits; every file is tied to every other."""
    files = [f"f{k:02}.go" for k in range(n_files)]
    plans = spark.createDataFrame([(p, files[(p + 3 * k) % n_files]) for p in range(n_plans) for k in range(each)], "plan_id long, file string")
    defs = spark.createDataFrame([(k, files[k], k % 5 == 0, k % 2 == 0) for k in range(n_files)], "id long, source_file string, is_test boolean, exported boolean")
    refs = spark.createDataFrame([(a, b) for a in range(n_files) for b in range(n_files) if (a * b + a) % 3], "from_def long, to_def long")
    commits = spark.createDataFrame([(c, files[k]) for c in range(12) for k in range(n_files) if (c + k) % 3], "commit_id long, file string")
    return plans, refs, defs, commits


def test_suggestions_are_counted_where_plans_lie(spark):
    plans, refs, defs, commits = _project(spark, 300)

    def run():
        links = compound.file_links(refs, defs, comod.confidence(commits), 0.4)
        return compound.suggest_linked(plans, written(links, "file-links")).collect()

    got, rows = shuffled(spark, run)
    names = {d["id"]: (d["source_file"], d["is_test"]) for d in defs.collect()}
    ties = [(names[r["from_def"]], names[r["to_def"]][0]) for r in refs.collect()]
    calls = Counter((a, b) for (a, test), b in ties if not test and a != b)
    sets = defaultdict(set)
    for r in commits.collect():
        sets[r["file"]].add(r["commit_id"])
    own = defaultdict(set)
    for r in plans.collect():
        own[r["plan_id"]].add(r["file"])
    for plan, mine in own.items():
        want = []
        for file in set(sets) - mine:
            callers, callees = sum(calls[file, m] for m in mine), sum(calls[m, file] for m in mine)
            near = max(len(sets[m] & sets[file]) / len(sets[m]) for m in mine)
            told = [(min((4 + callers) / 10, 0.8), "graph-caller")] * (callers > 0) + [(0.3, "graph-callee")] * (callees >= 3) + [(min(near, 0.8), "comod")] * (near >= 0.4)
            if len(told) >= 2:
                want.append((-max(told)[0], file, max(told)[1], len(told)))
        assert [(-r["best"], r["file"], r["reason"], r["n_sources"]) for r in sorted((r for r in got if r["plan_id"] == plan), key=lambda r: (-r["best"], r["file"]))] == sorted(want)[:10]
    # Signals of each source were shuffled plan by plan, over 300 * 14 rows each.
    assert rows < 6000


def test_directories_meet_commits_where_these_are_gathered(spark):
    paths = [f"d{k % 4}/e{k % 3}/f{k}.go" for k in range(24)]
    data = [(c, paths[(c * 5 + 7 * k * k) % 24]) for c in range(300) for k in range(6)]
    planned = ["d1/e0/f9.go", "d2/e2/f2.go"]
    commits, plan = spark.createDataFrame(data, "commit_id long, file string"), spark.createDataFrame([(p,) for p in planned], "file string")
    got, rows = shuffled(spark, lambda: sorted(tuple(r) for r in comod.dir_comod(commits, plan, 0.1, tasks=9).select("plan_dir", "file", "together", "touching").collect()))
    files = defaultdict(set)
    for c, f in data:
        files[c].add(f)
    want = []
    for d in ("d1/e0", "d1", "d2/e2", "d2"):
        touching = [fs for fs in files.values() if any(f.startswith(d + "/") for f in fs)]
        together = Counter(f for fs in touching for f in fs if not f.startswith(d + "/") and f not in planned)
        want += [(d, f, n, len(touching)) for f, n in together.items() if n / len(touching) >= 0.1]
    assert got == sorted(want) and got
    # Each line is dealt once; what is counted then is a row a directory, file and task.
    assert rows < len(data) + 9 * 4 * 25 + 200


def test_gaps_are_merged_where_plans_lie(spark):
    plans, refs, defs, commits = _project(spark, 300)
    acks = spark.createDataFrame([(p, "f07.go", "known") for p in range(0, 300, 2)], "plan_id long, file string, reason string")
    conf = written(comod.confidence(commits), "confidences")
    columns = ("plan_id", "place", "plan_file", "file", "frequency", "confidence", "cross_stack", "hub", "reason", "source")
    apart = gaps.merged_gaps(conf, gaps.blast_gaps(refs, defs, plans, 0.01), plans, acks, 0.6)
    want = sorted(map(str, apart.select(*columns).collect()))
    got, rows = shuffled(spark, lambda: gaps.plan_gaps(conf, gaps.blast_links(refs, defs, 0.01), plans, acks, 0.6, tasks=3).select(*columns).collect())
    assert sorted(map(str, got)) == want and {r["source"] for r in got} == {"comod", "refgraph"} and "known" in {r["reason"] for r in got}
    # Pairs of a plan's file with a gap are more; they were shuffled to be filtered, to find hubs and to be placed.
    assert len(got) > 3000 and rows < 6000


def test_gold_and_planned_files_are_dealt_once(spark):
    schema = "task_id long, path string"
    plans = spark.createDataFrame([(t, f"a/b{k}/c/x{k}.go") for t in range(50) for k in range(10)] + [(None, "q.go"), (1, None)], schema)
    gold = spark.createDataFrame([(t, f"b{k}/c/x{k}.go") for t in range(50) for k in range(10)] + [(None, "q.go"), (1, None)], schema)
    got, rows = shuffled(spark, lambda: evaluate.gold_matches(gold, plans).collect())
    assert sum(r["how"] == "suffix" and r["matched"] == f"a/{r['path']}" for r in got) == 500
    assert sorted((r["task_id"] or 0, r["path"] or "", r["matched"]) for r in got if r["how"] is None) == [(0, "q.go", None), (1, "", None)]
    # Joined end by end, each file was shuffled several times.
    assert rows == 1004
