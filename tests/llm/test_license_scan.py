import random

from cohortry.llm import license_scan as L

S = L.Scanner()
VOCABULARY = sorted({w for t in S.templates for w in t}) + [b"other"]


def test_phrases_and_matching_statistics_equal_brute_force():
    rng = random.Random(4)
    common = [b"gnu", b"general", b"public", b"license", b"apache", b"cc", b"by", b"mit", b"x"]
    for k in range(1500):
        w = [rng.choice(common if k % 2 else VOCABULARY) for _ in range(rng.randint(0, 30))]
        base, long = S.matches(w)
        phrases = S.templates[: len(L.PHRASES)]
        assert sorted(base) == sorted((i, p) for p, t in enumerate(phrases) for i in range(len(w) - len(t) + 1) if w[i : i + len(t)] == t)

        def held(x):
            return any(x == t[a : a + len(x)] for t in S.templates for a in range(len(t)))

        # The longest match ending at each word, by definition; long matches are those that go no farther.
        stat = [next((n for n in range(j, 0, -1) if held(w[j - n : j])), 0) for j in range(len(w) + 1)]
        ends = {j: stat[j] for j in range(1, len(w) + 1) if stat[j] >= L.LONG and (j == len(w) or stat[j + 1] != stat[j] + 1)}
        assert {j: j - i for i, j, _ in long if j - i >= L.LONG} == ends


def test_templates_are_covered_whole_and_in_parts():
    for t, label in zip(S.templates, S.labels):
        got = S.scan("foo " + b" ".join(t).decode() + " bar")
        assert got[4] == 1.0 and label in got[3]
    broken = "Permission is hereby granted, FREE of charge, to a person obtaining a copy of this software and its documentation files to deal in the Software without restriction"
    got = S.scan(broken)
    assert got[3] == {"mit"} and L.COVERED <= got[4] < 1 and got[2] == set()
    assert S.scan("public license of a general kind")[3] == set()


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(1, "MIT License and mit license.", "q"), (1, "MIT License and mit license.", "q"), (None, None, None), (2, "", "r"), (3, "x " * 100_000 + "CC-BY", "s")],
        "doc_id long, text string, labels string",
    )
    got = sorted((tuple(r)[:8] for r in L.license_scan(docs).collect()), key=str)
    one = (1, 5, 2, 0, 3, "mit", "mit", 1.0)
    assert got == [one, one, (2, 0, 0, None, None, "", "", 0.0), (3, 100_002, 1, 100_000, 100_000, "cc-by", "cc-by", 1.0), (None, 0, 0, None, None, "", "", 0.0)]
    assert L.license_scan(docs.limit(0)).count() == 0


def test_base_columns_equal_sql(spark, sf):
    import duckdb

    sql = f"""
    WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(COALESCE(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), ' ') || ' ' AS t FROM '{sf}/documents.parquet')
    SELECT doc_id, {" + ".join(f"(length(replace(t, ' ', '  ')) - length(replace(replace(t, ' ', '  '), ' {p.replace(' ', '  ')} ', ''))) // {len(p.replace(' ', '  ')) + 2}" for p in L.PHRASES)} AS n FROM d
    """
    want = dict(duckdb.sql(sql).fetchall())
    got = {r["doc_id"]: r["n_base"] for r in L.license_scan(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == want and sum(want.values()) > 0
