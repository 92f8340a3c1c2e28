from cohortry.llm import license_scan as L

S = L.Scanner()


def test_every_repeat_of_a_notice_is_a_span():
    for t, label in zip(S.templates, S.labels):
        for filler in (0, 3, 40):
            w = []
            want = []
            for _ in range(5):
                want.append((len(w), len(w) + len(t), label))
                w += t + [b"other"] * filler
            spans = S.scan(b" ".join(w).decode())[5]
            places = [(i, i + len(t), label) for i in range(len(w)) if w[i : i + len(t)] == t]
            assert places == want and set(want) <= set(spans)
