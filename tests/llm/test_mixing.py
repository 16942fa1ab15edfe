import warnings

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

from rippleframe.llm.mixing import fit_rates, rates_of, shares_of, way_of


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


@pytest.fixture(scope="module", params=[0.285, 0.6, 0.05])
def post(request, spark, tmp_path_factory):
    """Skewed lengths, soft posteriors with the mean share of the parameter."""
    r = np.random.default_rng(7)
    n = np.exp(r.normal(4, 1.5, 4000)).astype(int) + 1
    p = r.beta(request.param * 2, (1 - request.param) * 2, 4000)
    path = str(tmp_path_factory.mktemp("mix") / "post")
    spark.createDataFrame([(int(a), [float(b), float(1 - b)]) for a, b in zip(n, p)], "n_tokens long, p array<double>").write.parquet(path)
    return spark.read.parquet(path), n, np.stack([p, 1 - p], axis=1)


@pytest.mark.parametrize("cover", [False, True])
@pytest.mark.parametrize("target", [0.15, 0.6])
def test_fit_reaches_the_shares(post, target, cover):
    frame, n, p = post
    targets = {"0": target, "1": 1 - target}
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        gaps = fit_rates(frame, ["0", "1"], targets, cover=cover)
    way = way_of(pa.array(n), pa.array(list(p)), shares_of(["0", "1"], targets), cover)
    rates = rates_of(way, gaps, float(cover))
    tokens = rates @ (p * n[:, None])
    assert rates.min() >= float(cover)
    assert tokens / tokens.sum() == pytest.approx([target, 1 - target], abs=1e-5)
    assert cover or tokens.sum() == pytest.approx(n.sum(), rel=1e-5)


def test_shares_out_of_reach_are_reported(spark, tmp_path):
    spark.createDataFrame([(10, [0.5, 0.5]), (20, [0.6, 0.4])], "n_tokens long, p array<double>").write.parquet(f"{tmp_path}/post")
    with pytest.warns(UserWarning, match="short of its targets"):
        fit_rates(spark.read.parquet(f"{tmp_path}/post"), ["0", "1"], {"0": 0.15, "1": 0.85})


def test_texts_without_spaces_weigh_their_tokens(spark):
    from rippleframe.llm.bpe import Encoder, Vocabulary
    from rippleframe.llm.mixing import Classifier, posteriors

    texts = ["これは空白のない長い文章です。" * 50, "a few plain words", "x" * 2000, " \n ", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["n_tokens"] for x in posteriors(docs, Classifier(["0", "1"])).collect()}
    want = Encoder(Vocabulary.load()).counts([t or "" for t in texts])
    assert [got[k] for k in range(3)] == want[:3] and got[0] > 100
    assert [got[k] for k in range(3, 6)] == [0, 0, 0]
