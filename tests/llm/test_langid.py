import numpy as np
import pytest
from pageloom.llm.langid import cut, filter_language, fit_language_id, identify, softmax
from pageloom.llm.queries import op2_language_id
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return fit_language_id(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 5 <> 0"), docs_per_lang=150)


def test_held_out_accuracy(spark):
    got = op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.count() > 150 and got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_tables_equal_convolution(model):
    w = np.frombuffer(cut("The théatre and the cat".encode() * 40, model.width), np.uint8).reshape(-1, model.width)
    e = model.embed[w]
    patches = np.lib.stride_tricks.sliding_window_view(e, 4, axis=1).transpose(0, 1, 3, 2).reshape(len(w), model.width - 3, -1)
    want = softmax(np.maximum((patches @ model.filters).max(axis=1) + model.bias, 0) @ model.out + model.out_bias)
    assert np.allclose(model.predictor(rows=2)(w), want, atol=1e-4)


def test_edges(spark, model):
    english = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").orderBy("doc_id").first().text
    texts = [None, "", " 12 !", "x", english * 200, english, english, "中"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in identify(df, model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and got[3].lang_pred != "und"
    assert got[4].lang_pred == got[5].lang_pred == got[6].lang_pred == "en" and got[5].score == got[6].score
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = filter_language(df, model)
    assert kept.columns == df.columns and {4, 5, 6} <= {r.doc_id for r in kept.collect()} and kept.where("doc_id < 3").count() == 0
    assert fit_language_id(df.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in identify(df, None).collect()} == {"und"} and identify(df.limit(0), model).count() == 0
