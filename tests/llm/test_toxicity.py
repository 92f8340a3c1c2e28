import math
import zlib

from cohortry.llm import toxicity as X


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = X.toxicity_report(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    test = got.merge(labels.where("toxic is not null").toPandas(), on="doc_id")
    test = test[test.held_out]
    hit = ((test.predicted == 1) & (test.toxic == 1)).sum()
    assert hit / (test.predicted == 1).sum() > 0.9 and hit / (test.toxic == 1).sum() > 0.7


def test_score_is_a_noisy_or_and_finds_the_sentences():
    model = X.ToxicityModel({"bad": 6.0, "worse": 9.0}, -4.0)
    text = "Fine words here. Some BAD one! And worse?\nAll good"
    score, spans = model.score(text)
    p = [X._sigmoid(z) for z in (-4, 2, 5, -4)]
    assert math.isclose(score, 1 - math.prod(1 - x for x in p))
    assert [text.encode()[i:j].decode() for i, j, _ in spans] == [" Some BAD one", " And worse"]
    assert math.isclose(model.score(None)[0], X._sigmoid(-4)) and model.score("...")[1] == []
    assert 0 <= model.score("worse. " * 50_000)[0] <= 1


def test_nulls_ties_empty_tables_and_clashing_columns(spark):
    rows = [(i, "you are bad people. yes" if i % 3 == 0 else "all is well. yes", 0.5) for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, None, None), (7, "all is well. yes", None), (61, "", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in X.toxicity_report(docs, labels).collect()}
    assert len(got) == 62 and all(got[i]["predicted"] == (i % 3 == 0) for i in range(60))
    assert X.toxicity_report(docs.limit(0), labels).count() == 0
    assert X.toxicity_report(docs, labels.limit(0)).count() == docs.count()
    assert X.toxicity_report(docs, labels.where("toxic = 0")).where("predicted = 1").count() == 0
    kept = X.toxicity(docs, X.train(docs, labels))
    assert kept.columns == ["doc_id", "text", "score", "toxic_sentences"] and kept.count() == docs.count()


def test_sentences_end_at_full_width_marks_too():
    text = "你 好。坏 人！x? y\nz. 。。w"
    assert [text.encode()[i:j].decode().strip() for i, j, _ in X.sentences(text)] == ["你 好", "坏 人", "x", "y", "z", "w"]
