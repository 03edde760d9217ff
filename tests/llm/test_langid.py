from cases import docs

from plumbline.llm.langid import LENGTHS, Model, fit, held_out, identify, keep_identified, predict
from pyspark.sql import functions as F

EN, DE = "the house and the river under a bridge", "das haus und der fluss unter einer brücke"


def train(spark):
    return docs(spark, [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(20)] + [(None, EN, "en"), (50, None, "en"), (51, EN, None)])


def test_predictions_and_defined_results(spark):
    model = fit(train(spark))
    assert model.langs == ["de", "en"]
    texts = ["the BRIDGE", "unterhaus", "", None, "12 %%", "flussbrücken", "x " * 100_000 + "the", "²½"]
    got = predict(docs(spark, list(enumerate(texts))).select("doc_id", "text"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:6]] == ["en", "de", "und", "und", "und", "de"] and got[7].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got) and got[2].score == 0


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(40)]
    fold = {r[0]: r[1] for r in docs(spark, rows).select("doc_id", held_out(F.col("doc_id"))).collect()}
    assert 0 < sum(fold.values()) < 40
    rows = [(i, "zzz qqq" if fold[i] else t, "xx" if fold[i] else lang) for i, t, lang in rows]
    got = identify(docs(spark, rows)).collect()
    assert len(got) == 40 and {r.lang_pred for r in got} <= {"en", "de"} and all(r.held_out == fold[r.id] for r in got)


def test_nothing_to_learn_and_empty(spark):
    assert identify(docs(spark, [])).collect() == []
    got = identify(docs(spark, [(1, EN), (2, None)])).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_filter_keeps_columns_and_clean_rows(spark):
    data = docs(spark, [(1, EN), (2, "123"), (3, DE), (1, EN)])
    kept = keep_identified(data, fit(train(spark)), 0.5)
    assert kept.columns == data.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 3]


def test_backoff_uses_the_longest_known_grams():
    model = Model(["a", "b"], {"w": [(0, 1.0)]}, {5: {}, 4: {}, 3: {"^ca": [(1, 2.0)]}, 2: {"^c": [(0, 1.0)]}, 1: {}})
    assert model.piece("W") == [-15.0, 0.0, 1] and model.piece("cat") == [0.0, -14.0, 1] and model.piece("co") == [-15.0, 0.0, 1]


def test_held_out_accuracy_on_the_given_documents(spark):
    data = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = identify(data).withColumnRenamed("id", "doc_id").join(data.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count() > 0


def test_predictions_replace_columns_of_their_names(spark):
    model = Model(["aa"], {"ja": [(0, 1.0)]}, {n: {} for n in LENGTHS})
    rows = spark.createDataFrame([("ja ja", "x", "y")], "text string, score string, lang_pred string")
    assert predict(rows, model).first().asDict() == {"text": "ja ja", "lang_pred": "aa", "score": 1.0}
