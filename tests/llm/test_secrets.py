import pytest
from pyspark.sql import SparkSession

from rippleframe.llm.secrets import op9_secrets, scan, verdicts


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def test_ownership_reaches_the_result(spark, tmp_path):
    own, copied, token, example = "a1b2c3d4" * 4, "0f" * 16, "Zk3" * 8, "Qx7" * 8
    rows = [
        (1, f"{own} {copied}", "s1", "en"), (2, f"{own}", "s1", "de"), (3, copied, "s2", "en"), (4, copied, "s3", "en"),
        (5, f"see {token} and {example}", "s1", "en"), (6, example, "s2", "en"), (7, "nothing", "s1", "en"), (8, None, "s1", "en"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in op9_secrets(spark, str(tmp_path)).collect()}
    assert got[1]["ownership"] == "hex:0:32:1:2:live,hex:33:65:3:3:copied" and got[1]["spans"] == "hex:0:32,hex:33:65" and got[1]["n_hex"] == 2
    assert got[2]["ownership"] == "hex:0:32:1:2:live" and got[3]["ownership"] == "hex:0:32:3:3:copied"
    assert got[5]["ownership"] == "token:4:28:1:1:live,token:33:57:2:2:copied" and got[5]["spans"] == "token:4:28"
    assert got[6]["ownership"] == "token:0:24:2:2:copied" and got[6]["spans"] == ""
    assert got[7]["ownership"] == got[8]["ownership"] == ""


SCHEMA = "doc_id long, text string, source string, lang string, digest string, kind string, start string"


def test_very_many_matches_in_one_text(spark):
    """Positions of 60,000 spans in one text, in time that grows with their number."""
    import time

    one = " ".join(f"{k:024x}" for k in range(60_000)) + " Zk3" + "Zk3" * 8
    began = time.time()
    rows, spans = scan(spark.createDataFrame([(1, one, "s", "en", "x", "y", "z")], SCHEMA))
    got = [(r["start"], r["end"]) for r in spans.orderBy("start").collect()]
    assert got[:60_000] == [(25 * k, 25 * k + 24) for k in range(60_000)] and len(got) == 60_001
    assert verdicts(rows, spans).first()["n_hex"] == 60_000 and time.time() - began < 60


def test_nulls_repeats_and_empty_tables(spark):
    token = "Zk3" * 8
    rows = [(1, f"{token}", None, "en"), (1, f"{token}", None, "en"), (None, f"{token} x", None, None), (2, None, "s", "en")]
    docs = spark.createDataFrame([(*r, "d", "k", "s") for r in rows], SCHEMA)
    got = sorted((x["doc_id"] or 0, x["spans"], x["ownership"]) for x in verdicts(*scan(docs)).collect())
    # A null owner is one owner; repeated rows are each returned.
    assert got == [(0, "token:0:24", "token:0:24:1:2:live"), (1, "token:0:24", "token:0:24:1:2:live"), (1, "token:0:24", "token:0:24:1:2:live"), (2, "", "")]
    assert verdicts(*scan(docs.limit(0))).count() == 0


def test_tokens_that_touch_base_spans_are_left_out(spark):
    text = "key: token=Ab1" + "c" * 30 + " AKIA" + "B2" * 10 + "a Cd2" + "e" * 20 + "/" + "0f" * 14
    (row,) = verdicts(*scan(spark.createDataFrame([(1, text, "s", "en", "d", "k", "s")], SCHEMA))).collect()
    # The assigned value holds a run of hexadecimal digits too; tokens that touch either are none of their own.
    assert [s.split(":")[0] for s in row["spans"].split(",")] == ["assign", "hex", "access", "hex"]
