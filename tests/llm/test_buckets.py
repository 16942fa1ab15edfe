"""Rows of the buckets in which op12 compares."""

import random

from rippleframe.llm import ngram_join


def test_shingles_of_the_same_groups_are_one_bucket(spark, monkeypatch):
    r = random.Random(3)
    texts, pairs = [], 30
    for _ in range(pairs):
        words = ["".join(r.choices("abcdefgh", k=7)) for _ in range(300)]
        texts += [" ".join(words), " ".join(words[:150] + ["other"] + words[151:])]
    # Three that differ from one another in other places: shingles of any two of them.
    words = ["".join(r.choices("abcdefgh", k=7)) for _ in range(300)]
    texts += [" ".join(words[:at] + ["other"] + words[at + 1 :]) for at in (50, 150, 250)]
    seen, buckets = [], ngram_join._buckets

    def counted(shared, *rest):
        seen.append(shared.count())
        return buckets(shared, *rest)

    monkeypatch.setattr(ngram_join, "_buckets", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.similar(docs).collect()}
    assert got == {k: k - k % 2 if k < 2 * pairs else 2 * pairs for k in range(len(texts))}
    # With a bucket for each shingle a pair alone has more than 50 rows.
    assert max(seen) <= 2 * pairs + 3 * 4
