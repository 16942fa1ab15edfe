"""Best positions, grouped prefix join and conversation trie against plain Python and SQL, with nulls, ties, repeats, long and empty texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from rippleframe.llm import lexical, ngram_join, trie
from rippleframe.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
CLASHES = ("t", "th", "n", "term", "score", "rank", "class", "gid", "path", "sizes", "turns", "dealt", "key", "head", "first")


def texts():
    r = random.Random(11)
    words = ["Alpha", "beta", "gamma", "délta", "echo", "x9", "it's", "end.", "Zulu", "ñandú", "one", "two", "three"]
    base = [" ".join(r.choices(words, k=r.randint(40, 160))) for _ in range(10)]
    near = []
    for b in base[:5]:
        w = b.split()
        for _ in range(9):
            v = list(w)
            v[r.randrange(len(v))] = f"new{r.randrange(50)}"
            near.append(" ".join(v))
    odd = [None, "", " \n\t ", "one", "One", "one two three", "one  two\x0bthree", "a b c d", "a b c d e", "long " * 20_000, "\x00   naïve　x", "..."]
    return base + near + odd + base[:3] + [base[0].upper(), None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("new"))
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts())]
    rows += [(None, texts()[1] + " tail", "en", "s0", 13), (None, "without an id", "en", "s0", 13), (7, rows[7][1], "en", "s1", 5), (8, "another text of id 8 with beta", "de", "s2", 5)]
    items = [(0, texts()[0]), (1, "beta BETA gamma"), (2, None), (3, ""), (4, "nowhere-found"), (1, "echo"), (None, "alpha"), (5, " ".join(t or "" for t in texts()[10:40]))]
    r = random.Random(4)
    turns = [(c, t, r.choice(["user", "assistant", None]), r.choice(["hi", "hello", "", None, "ü", "a" * 2000])) for c in range(60) for t in range(r.randint(0, 12)) if c not in (20, 25)]
    turns += [(100 + c, t, "user", f"turn {t}") for c in range(40) for t in range(30)] + [(7, None, "user", "null turn"), (7, 0, "user", "hi"), (7, 0, "user", "hi"), (None, 1, "user", "x"), (-7, 0, "user", "hi")]
    tables = {
        "documents": (rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": (items, "item_id long, text string"),
        "conversations": (turns, "conv_id long, turn long, role string, text string"),
    }
    for name, (data, schema) in tables.items():
        df = spark.createDataFrame(data, schema)
        for c in CLASHES:
            df = df.selectExpr("*", f"'{c}' AS `{c}`")
        df.repartition(3).write.parquet(f"{path}/{name}.parquet")
        df.limit(0).write.parquet(f"{path}/empty/{name}.parquet")
    return path


def table(spark, folder, name):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


def plain(frame):
    return sorted(tuple((pd.isna(v), 0 if pd.isna(v) else v) for v in row) for row in frame.values.tolist())


def collected(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["op11_bpa", "op12_ngram_join", "op13_trie"])
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == columns
    assert plain(got[columns]) == plain(want[columns])


@pytest.mark.parametrize("name", ["op11_bpa", "op12_ngram_join", "op13_trie"])
def test_empty_tables_give_no_rows(spark, folder, name):
    assert QUERIES[name](spark, f"{folder}/empty").count() == 0


def best_lists(documents, items, k=50):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    docs = [(d["doc_id"], Counter(cut(d["text"]))) for d in documents]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    total, n_docs = sum(n for _, _, n in docs), len(docs)
    df = Counter(t for _, c, _ in docs for t in c)
    terms = defaultdict(set)
    for item in items:
        terms[item["item_id"]] |= set(cut(item["text"]))
    out = []
    for item, own in terms.items():
        scored = []
        for i, c, n in docs:
            m = 50 + 50 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("slab", [1 << 20, 40])
def test_op11_is_exhaustive_search(spark, folder, monkeypatch, slab):
    want = best_lists(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    documents, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    monkeypatch.setattr(lexical, "SLAB", slab)
    assert collected(lexical.search(documents, items)) == want
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 6000)
    assert collected(lexical.search(documents, items, 5)) == best_lists(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 5)


def test_best_positions_stop_early_and_lose_nothing():
    r = np.random.default_rng(2)
    n_docs, width, k = 3000, 6, 10
    per = r.integers(0, width + 1, n_docs)
    term = np.concatenate([np.sort(r.permutation(width)[:n]) for n in per]).astype(np.int64)
    count = r.geometric(0.4, len(term)).astype(np.int64)
    slab = lexical.Slab(r.integers(60, 90, n_docs), np.concatenate([[0], np.cumsum(per)]), term, count, r.integers(1, 9000, width))
    whole = np.zeros(n_docs, dtype=np.int64)
    np.add.at(whole, slab.doc, slab.impact)
    met = []
    direct = slab.direct
    slab.direct = lambda docs, lists: (met.append(len(docs)), direct(docs, lists))[1]
    docs, scores = lexical.best_positions(slab, np.arange(width), k, np.zeros(0, np.int64))
    assert (whole[docs] == scores).all() and sorted(scores)[-k:] == sorted(whole)[-k:]
    assert set(np.flatnonzero(whole >= np.sort(whole)[-k])) <= set(docs.tolist()) and sum(met) < 0.7 * n_docs
    none, _ = lexical.best_positions(slab, np.arange(width), k, np.full(k, whole.max() + 1))
    assert not len(none)


def joined(links, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def shingle_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


@pytest.mark.parametrize("salt", [2000, 2])
def test_op12_is_all_pairs(spark, folder, monkeypatch, salt):
    monkeypatch.setattr(ngram_join, "SALT", salt)
    rows = [(d["doc_id"], shingle_set(d["text"])) for d in table(spark, folder, "documents")]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][1] and rows[b][1] and 100 * len(rows[a][1] & rows[b][1]) >= 85 * len(rows[a][1] | rows[b][1])]
    root = joined(links, range(len(rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(least.get(root[k], (True, 0)), (i is None, i or 0))
    want = Counter((i, len(s), None if least[root[k]][0] else least[root[k]][1]) for k, (i, s) in enumerate(rows))
    assert len({root[k] for k in root}) < len(rows) - 20
    assert collected(QUERIES["op12_ngram_join"](spark, folder)) == want


def test_op12_filters_lose_no_link(spark):
    """Texts of a small vocabulary, so that sets overlap in every degree."""
    r = random.Random(9)
    rows = []
    for i in range(160):
        seed = random.Random(i // 8)
        w = [str(seed.randrange(40)) for _ in range(seed.randint(5, 60))]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = str(r.randrange(40))
        rows.append((i, " ".join(w)))
    sets = [shingle_set(t) for _, t in rows]
    links = [(a, b) for a in range(160) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = joined(links, range(160))
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == root


def test_op12_other_words_and_threshold(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g x"), (3, "q r s")]
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), words=2, percent=70).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def nodes_of(rows):
    own = defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            role, text = r["role"] or "", r["text"] or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[r["conv_id"]].append(((r["turn"] is not None, r["turn"] or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        own_saved = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += own_saved
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(made[c]) == len(p))))
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items())


@pytest.mark.parametrize("size", [1 << 16, 3])
def test_op13_is_the_trie(spark, folder, size):
    own = trie.paths(spark.read.parquet(f"{folder}/conversations.parquet"))
    want = nodes_of(table(spark, folder, "conversations"))
    assert collected(trie.trie(trie.rebuilt(own), size)) == want


def test_shards_share_spines():
    """Shards of any size add up to the same trie."""
    import pyarrow as pa

    r = random.Random(1)
    turn = lambda x: hashlib.md5(str(x).encode()).digest()
    convs = sorted((b"".join(turn(r.randrange(3)) for _ in range(r.randint(0, 9))), c) for c in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array([c for _, c in convs]), pa.array([p for p, _ in convs]), pa.array([[1] * (len(p) // 16) for p, _ in convs], pa.list_(pa.int64()))], names=["conv_id", "path", "sizes"])

    def built(size, monkey):
        monkey.setattr(trie.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
        return pa.Table.from_batches(list(trie._shards(size)([batch]))).to_pandas()

    with pytest.MonkeyPatch.context() as monkey:
        one, many = built(1 << 16, monkey), built(5, monkey)
    assert many["shard"].nunique() > 20 and one["shard"].nunique() == 1
    # Nodes that are no spine anywhere agree; all members of the root are there.
    inner = lambda f: Counter(map(tuple, f[~f["spine"]][["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved"]].values.tolist()))
    assert not inner(many) - (inner(one) + Counter(map(tuple, one[one["spine"]][["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved"]].values.tolist())))
    assert many[many["depth"] == 0]["n_convs"].sum() == 400


@pytest.mark.parametrize("shape", ["random", "deep", "flat"])
def test_find_close_is_matching_parentheses(shape):
    r = random.Random(8)
    if shape == "deep":
        opens = [True] * 5000 + [False] * 5000
    elif shape == "flat":
        opens = [True] + [True, False] * 4000 + [False]
    else:
        opens, depth = [True], 1
        while len(opens) < 9000:
            up = depth == 1 or r.random() < 0.5
            opens.append(up)
            depth += 1 if up else -1
        opens += [False] * depth
    stack, close = [], {}
    for k, o in enumerate(opens):
        if o:
            stack.append(k)
        else:
            close[stack.pop()] = k
    at = np.array(sorted(close))
    assert trie.RangeMinMax(np.array(opens)).find_close(at).tolist() == [close[k] for k in at.tolist()]
