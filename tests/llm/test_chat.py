import hashlib
import random

import pytest

from cohortry.llm import chat as C
from cohortry.llm.queries import op9_chat_format, tokenizer_path

UNITS = ["\\", "#", "###", "### ", "</turn>", "<", "\n", ":", "n", "c", "word ", "é"]


def test_escapes_are_reversible():
    rng = random.Random(6)
    for _ in range(3000):
        said = "".join(rng.choice(UNITS) for _ in range(rng.randint(0, 12)))
        role = "".join(rng.choice(UNITS) for _ in range(rng.randint(0, 4)))
        assert C.parse(C.render(role, said)[0] + C.render("u", said)[0]) == [(role, said), ("u", said)]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(x for role, x in said if role == "assistant")
        out[conv] = (len(said), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    want = brute([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert {r[0]: tuple(r)[1:5] for r in op9_chat_format(spark, sf).collect()} == want


def plan(tokens, budget, history, fixed):
    """(first repeated, first new, stop) of the windows over the turns after the system turn, from sums over the whole list."""
    room = max(2, budget - fixed)
    back = min(history, room // 2)
    starts = [sum(tokens[:i]) for i in range(len(tokens))]
    half = room // 2
    width = room - max([back, *(n for n in tokens if n <= half)])
    names = [(sum(n > half for n in tokens[:i]), n > half, 0 if n > half else starts[i] // width) for i, n in enumerate(tokens)]
    spans, at = [], 0
    while at < len(tokens):
        stop = at + 1
        while stop < len(tokens) and names[stop] == names[at]:
            stop += 1
        limit, first = min(back, budget - fixed - sum(tokens[at:stop])), at
        while first and sum(tokens[first - 1 : at]) <= limit:
            first -= 1
        spans.append((first, at, stop))
        at = stop
    return spans


def test_long_conversations_are_planned_as_one(spark):
    rng = random.Random(11)
    count = C.counter(tokenizer_path()).count
    said = [(t, rng.choice(["user", "assistant"]), " ".join(["word"] * rng.choice([0, 1, 5, 20, 90]))) for t in range(1500)]
    said[0] = (0, "system", "be kind")
    tokens = count([C.render(r, x)[0] for _, r, x in said])
    want = [(i - a, j - i) for a, i, j in plan(tokens[1:], 120, 40, tokens[0])]
    assert max(n for _, n in want) > 3 and any(c > 1 for c, _ in want)
    for shift, block in ((0, 512), (300, 512), (7, 4)):
        turns = spark.createDataFrame([("x", t + shift, r, x) for t, r, x in said], "conv_id string, turn long, role string, text string")
        got = C.format_chat(turns, tokenizer_path(), budget=120, history=40, block_turns=block).orderBy("window").collect()
        plain = [(w["n_context"] - 1, w["n_new"]) for w in got]
        if tokens[1] <= 40:  # the system turn is new in the first window
            plain[0] = (plain[0][0] + 1, plain[0][1] - 1)
        assert plain == want and {w["conv_id"] for w in got} == {"x"}
        assert all(w["n_tokens"] <= 120 or w["n_new"] == 1 for w in got)
        assert [x for w in got for x in C.parse(w["formatted"])[-w["n_new"] :]] == [(r, x) for _, r, x in said]


@pytest.mark.parametrize("block_turns", [4, 512])
def test_windows_repeat_history_and_mask_it(spark, block_turns):
    rng = random.Random(8)
    rows = [(1, 0, "system", "be kind")]
    rows += [(1, t, "assistant" if t % 2 == 0 else "user", " ".join(rng.choice(["one", "two"]) for _ in range(rng.randint(1, 30)))) for t in range(1, 40)]
    rows += [(2, 5, "assistant", None), (2, None, "user", "first"), (2, 5, "assistant", None), (None, 1, None, "no id"), (3, 0, "user", "long " * 5000), (3, 1, "assistant", "ok")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, block string")
    windows = C.format_chat(turns, tokenizer_path(), budget=120, history=40, block_turns=block_turns)
    shown = windows.where("conv_id = 1").orderBy("window").collect()
    assert len(shown) > 3 and all(C.parse(w["formatted"])[0] == ("system", "be kind") for w in shown)
    assert sum(w["n_new"] for w in shown) == 40 and any(w["n_context"] > 1 for w in shown)
    assert all(w["n_tokens"] <= 120 for w in shown)
    for w in shown:
        new = C.parse(w["formatted"])[-w["n_new"] :]
        assert [C.unescape(w["formatted"][s["start"] : s["stop"]]) for s in w["loss"]] == [x for role, x in new if role == "assistant"]
    assert {r[0]: tuple(r)[1:5] for r in C.read_back(windows).collect()} == brute(rows)
    assert C.read_back(C.format_chat(turns.limit(0), tokenizer_path())).count() == 0


def test_windows_are_filled(spark):
    count = C.counter(tokenizer_path()).count
    path = tokenizer_path()
    for words, most in ((515, 7), (700, 11), (990, 20), (20, 2)):
        said = " ".join(["word"] * words)
        n = count([C.render("user", said)[0]])[0]
        turns = spark.createDataFrame([(1, t, "user", said) for t in range(20)], "conv_id long, turn long, role string, text string")
        windows = C.format_chat(turns, path).collect()
        assert len(windows) <= most and all(w["n_tokens"] <= C.BUDGET for w in windows), (n, len(windows))
        assert sum(w["n_new"] for w in windows) == 20 and all(w["n_context"] * n <= C.HISTORY for w in windows)
