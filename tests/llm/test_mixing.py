import duckdb
import pytest

from cohortry.llm import mixing as M


@pytest.mark.parametrize("rows", [20_000, 40])
def test_mix_equals_sql(spark, monkeypatch, rows):
    monkeypatch.setattr(M, "BUCKET_ROWS", rows)
    path = "/root/testdata/sf0.01/documents.parquet"
    want = duckdb.connect().execute(M.MIX_SQL.format(docs=f"'{path}'")).fetchall()
    got = sorted(map(tuple, M.mix(spark.read.parquet(path)).collect()))
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in sorted(want)]
    assert all(a[3] == pytest.approx(b[3]) for a, b in zip(got, sorted(want)))


def test_taken_words_come_near_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = M.mix(docs).toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    by = got.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert ((by.taken - by.target).abs() < 0.02 * by.target).all()
    assert (got.taken <= 2 * got["size"]).all() and (by.target <= 2 * by["size"]).all()
    assert by.target.sum() == pytest.approx(1.5 * by["size"].sum())


def test_longer_documents_are_likelier_as_their_probabilities_tell(spark):
    sizes = [1 + i % 40 for i in range(400)] + [900, 700]
    docs = spark.createDataFrame([(i, "w " * n, "s") for i, n in enumerate(sizes)], "doc_id long, text string, source string").cache()
    due, runs = 0.4, 12
    wanted, certain = due * sum(sizes), 0
    rest = sorted(sizes, reverse=True)
    while rest and (wanted - certain) / sum(x * x for x in rest) * rest[0] >= 1:
        certain += rest.pop(0)
    scale = (wanted - certain) / sum(x * x for x in rest)
    got = [0.0] * len(sizes)
    for k in range(runs):
        out = M.mix(docs, weights=[1.0], share=due, seed=f"run {k}").collect()
        assert abs(sum(r["taken"] for r in out) - wanted) <= 40
        for r in out:
            got[r["doc_id"]] += (r["taken"] > 0) / runs
    assert got[400] == got[401] == 1
    for low, high in ((1, 10), (11, 20), (21, 30), (31, 40)):
        own = [i for i, n in enumerate(sizes) if low <= n <= high]
        assert sum(got[i] for i in own) / len(own) == pytest.approx(sum(min(1, scale * sizes[i]) for i in own) / len(own), abs=0.06)


def reshare(sizes, weights, share=1.5):
    """Targets by sharing out the excess again and again."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > 2 * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = 2 * sizes[i]
            left -= target[i]
            free.discard(i)
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10, 10], [1000, 1, 1, 0], [0, 0, 5, 7], [3, 500, 20, 90]])
def test_targets_are_the_fixed_point(spark, sizes):
    frame = spark.createDataFrame([(k if k < 3 else None, n) for k, n in enumerate(sizes)], "source int, source_size long").selectExpr("cast(source as string) source", "source_size")
    got = {r["source"]: r["target"] for r in M.source_targets(frame, [3, 1, 2]).collect()}
    want = reshare(sizes, [3, 1, 2, 3])
    assert [got[k] for k in ("0", "1", "2", None)] == pytest.approx(want)


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(1, "a b c", "s", 1), (1, "a b c", "s", 1), (2, None, None, 2), (None, "x y", None, 3), (4, "", "t", None)], "doc_id long, text string, source string, rank int"
    )
    got = M.mix(docs).collect()
    assert len(got) == 5 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, M.mix(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert M.mix(docs.limit(0)).count() == 0
    kept = M.mix_documents(docs.withColumnRenamed("rank", "_taken")).collect()
    assert all(r["copies"] in (1, 2) and r["text"] for r in kept)
