import pytest

from cohortry.llm import exact_dedup, near_copies, simhash

ROWS = [(None, "a b c d"), (7, "a b c d"), (None, "q r s t"), (None, "u v w x"), (3, "k l m n"), (5, "k l m n"), (5, "e f g h")]
WANT = [("7", "a b c d"), ("None", "q r s t"), ("None", "u v w x"), ("3", "k l m n"), ("5", "e f g h")]


@pytest.mark.parametrize("dedup", [exact_dedup.exact_dedup, simhash.near_dedup, near_copies.near_copies])
def test_rows_that_share_an_id_are_judged_by_their_own_texts(spark, dedup):
    clash = ["_gone_id", "_gone_key", "_gone_sha", "_text_key", "_id", "_key"]
    docs = spark.createDataFrame([(*r, *range(len(clash))) for r in ROWS], "doc_id long, text string, " + ", ".join(f"{c} int" for c in clash))
    assert sorted((str(r["doc_id"]), r["text"]) for r in dedup(docs).collect()) == sorted(WANT)
