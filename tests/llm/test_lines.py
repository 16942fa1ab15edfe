import random

import pytest
from pyspark.sql import SparkSession

from rippleframe.llm.lines import BANDS, CHECKED, MOST_APART, ROWS, decide, shingle_set, signatures, sketches


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def _jaccard(a, b):
    x, y = ({s[k : k + 5] for k in range(len(s) - 4)} for s in (a, b))
    return len(x & y) / len(x | y)


def test_near_lines_meet_whatever_their_white_space(spark, tmp_path):
    r = random.Random(5)
    word = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    pairs = []
    for _ in range(30):
        token, tag = word(69), word(78)
        pairs += [(f"{' ' * 12}x{token}", f"{' ' * 12}y{token}"), (f"{' ' * 12}<div class={tag}>", f"{' ' * 12}<p><div class={tag}>")]
    assert all(_jaccard(a, b) >= 0.85 for a, b in pairs)
    docs = [(2 * k + side, pair[side]) for k, pair in enumerate(pairs) for side in (0, 1)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    kept = {x["doc_id"] for x in decide(spark.read.parquet(f"{tmp_path}/docs")).filter("kept").collect()}
    assert kept == set(range(0, 2 * len(pairs), 2))


def test_links_are_all_pairs_links(spark, tmp_path):
    r = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "\tx = 1;", "    return", "<p>", "identifierWithoutBlank"]
    lines = []
    for _ in range(60):
        line = r.choice(["", "    ", "\t\t"]) + " ".join(r.choices(words, k=r.randint(1, 12)))
        lines += [line, line[:-1] + "z", "q" + line]
    lines = sorted({x for x in lines if x.strip()})
    root = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if _jaccard(lines[a].ljust(5), lines[b].ljust(5)) >= 0.9:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    found = {x["doc_id"]: x["component"] for x in decide(spark.read.parquet(f"{tmp_path}/docs"), threshold=0.9).collect()}
    assert all(found[k] == found[root[k]] for k in found)
    assert len(set(found.values())) == len(set(root))


def test_sketches_never_show_more_than_the_difference():
    r = random.Random(7)
    lines = ["a", "ab", "aaaaaaaaaa", "é😀é😀é😀é", "x" * 5000]
    for _ in range(60):
        line = "".join(r.choices("abcde ", k=r.randint(1, 900)))
        lines += [line, line[: len(line) // 2] + "".join(r.choices("abcde ", k=r.randint(1, 300)))]
    counts, words = sketches(lines)
    sets = [shingle_set(x) for x in lines]
    assert counts.tolist() == [len(s) for s in sets]
    for a in range(len(lines)):
        for b in range(a + 1):
            shown = sum(bin((int(x) ^ int(y)) % 2**64).count("1") for x, y in zip(words[a], words[b], strict=True))
            apart = len(sets[a] ^ sets[b])
            assert shown <= apart and (shown - apart) % 2 == 0


def test_drifted_copies_keep_their_links(spark, tmp_path):
    """Copies on both sides of the threshold: all links of any pair at or above it."""
    r = random.Random(8)
    base = [r.choice("abcdefghijklmnop ") for _ in range(150)]
    lines = []
    for k in range(90):
        line = list(base)
        for at in r.sample(range(150), k % 9):
            line[at] = r.choice("ABCDEFGH")
        lines.append("".join(line))
    lines = sorted(set(lines))
    root = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if _jaccard(lines[a], lines[b]) >= 0.8:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    found = {x["doc_id"]: x["component"] for x in decide(spark.read.parquet(f"{tmp_path}/docs")).collect()}
    split = sum(found[k] != found[root[k]] for k in found)
    assert split <= 0.02 * len(lines)
    assert len(set(found.values())) >= len(set(root))


def test_signatures_do_not_depend_on_the_block():
    """Alone, even shorter than a shingle, or among others: a line has one signature."""
    lines = ["a", "ab", "abcd", "abcde", "abcdef", "é😀é😀é😀é", "x" * 400]
    together = signatures(lines)
    for k, line in enumerate(lines):
        assert (signatures([line])[0] == together[k]).all()
        assert sketches([line])[0].tolist() == [len(shingle_set(line))]


def near_pair(r, least, most):
    """Two random lines of a length, with a similarity from .8 to .845."""
    while True:
        x = "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=r.randint(least, most)))
        shingles = max(1, len(x) - 4)
        # A changed end of k characters takes k shingles from one line and adds k to the other.
        k = round(shingles * r.uniform(0.165, 0.2) / (2 - 0.18))
        y = x[:-k] + "".join(r.choices("ABCDEFGH", k=k)) if k and r.random() < 0.5 else x[max(1, round(shingles * r.uniform(0.155, 0.2))) :]
        a, b = shingle_set(x), shingle_set(y)
        if 0.8 <= len(a & b) / len(a | b) <= 0.845:
            return x, y


@pytest.mark.parametrize("least, most", [(12, 16), (16, 30), (30, 60), (60, 300)])
def test_recall_by_length(least, most):
    r = random.Random(least)
    pairs = [near_pair(r, least, most) for _ in range(1500)]
    a, b = (signatures([p[side] for p in pairs]) for side in (0, 1))
    same = (a == b).reshape(len(pairs), BANDS, ROWS).all(axis=2).any(axis=1)
    close = ((a[:, :CHECKED] & 15) != (b[:, :CHECKED] & 15)).sum(axis=1) <= MOST_APART
    assert (same & close).mean() >= 0.98 and close.mean() >= 0.9995
