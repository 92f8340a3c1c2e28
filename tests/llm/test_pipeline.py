import sys

import corpus_pipeline as P
from test_decontaminate import brute as benchmark_hits
from test_line_dedup import brute as line_report
from test_mixing import reshare
from test_near_copies import brute as near_heads

from cohortry.llm import toxicity


def test_stages_equal_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    kept = []
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, folder)
        after = {r["doc_id"]: r for r in out.collect()}
        if k < 4:
            assert out.columns == docs.columns
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            assert set(after) == {i for i, r in before.items() if model.score(r["text"])[0] < 0.5}
        elif name == "line_dedup":
            import hashlib

            want = line_report([(i, r["text"]) for i, r in before.items()])
            assert {i: hashlib.sha256((r["text"] or "").encode()).hexdigest() for i, r in after.items()} == {i: w[2] for i, w in want.items()}
        elif name == "near_dedup":
            assert set(after) == set(near_heads({i: r["text"] for i, r in before.items()})[0])
        elif name == "decontamination":
            hits = dict(zip(before, benchmark_hits([r["text"] for r in before.values()], bench, 10)))
            assert set(after) == set(before)
            for i, r in after.items():
                assert (r["text"] == before[i]["text"]) == (hits[i][1] == 0) and r["n_chars"] == len(r["text"])
                assert len(P.decontaminate.words(r["text"])) == hits[i][0] - hits[i][1]
        else:
            sizes = {i: len((r["text"] or "").encode().split()) for i, r in before.items()}
            sources = sorted({r["source"] for r in before.values()})
            by = [sum(n for i, n in sizes.items() if before[i]["source"] == s) for s in sources]
            targets = reshare(by, [(3, 1, 2)[j % 3] for j in range(len(sources))])
            for s, target in zip(sources, targets):
                own = [i for i in after if after[i]["source"] == s]
                largest = max(sizes[i] for i in before if before[i]["source"] == s)
                assert abs(sum(sizes[i] * after[i]["copies"] for i in own) - target) <= largest
            assert all(r["copies"] in (1, 2) for r in after.values())
        kept.append(set(after))
        docs = spark.createDataFrame([tuple(r[c] for c in P.DOCUMENTS) for r in after.values()], docs.schema) if k < 4 else docs
    assert {r["doc_id"] for r in P.run(spark, folder).collect()} == kept[-1]
    assert "corpus_pipeline" in sys.modules
