import itertools
import random
from collections import defaultdict

import pytest

from souq.llm import chat_repair as C


def cheapest(roles):
    """Over all relabellings, the cheapest merges and insertions."""
    best = 10 ** 9
    for states in itertools.product(range(1, 5), repeat=len(roles)):
        cost, before = 0, 0
        for r, t in zip(roles, states):
            ways = [C.INSERT * len(C.INSERTIONS[before, t])] if (before, t) in C.INSERTIONS else []
            ways += [C.MERGE] * (before == t)
            if not ways:
                break
            cost, before = cost + min(ways) + (0 if r == t else C.RELABEL), t
        else:
            best = min(best, cost + C.END[before][0])
    return best


def known(role):
    role = (role or "").strip().lower()
    return C.ROLES.index(role) + 1 if role in C.ROLES else 0


@pytest.fixture(scope="module")
def conversations():
    g = random.Random(0)
    return {i: [g.choice(["user", "assistant", "system", "tool", "USER ", None, "bot"]) for _ in range(g.randint(1, 6))]
            for i in range(40)}


@pytest.mark.parametrize("block_turns", [2048, 2])
def test_cheapest_and_legal(spark, conversations, block_turns):
    """Whole and cut into blocks, against all possible repairs."""
    rows = [(i, t, r, f"m{t}", "x") for i, rs in conversations.items() for t, r in enumerate(rs)]
    got = C.repair(spark.createDataFrame(rows + rows[:4], "conv_id long, turn long, role string, text string, new_role string"),
                   block_turns).collect()
    cost, pieces = defaultdict(int), defaultdict(list)
    for r in got:
        cost[r.conv_id] += r.cost
        pieces[r.conv_id].append((r.position, r.rendered))
    for i, roles in conversations.items():
        assert cost[i] == cheapest([known(r) for r in roles])
        assert sorted(p for p, _ in pieces[i]) == list(range(1, len(roles) + 1))
        text = "".join(x for _, x in sorted(pieces[i]))
        messages = text.split(C.OPEN)[1:]
        seq = [m.split("\n")[0] for m in messages]
        assert all(m.endswith(f"{C.CLOSE}\n") and m.count(C.CLOSE) == 1 for m in messages)
        assert all(b in C.NEXT[a] for a, b in zip(["", *seq], seq)) and seq[-1] in C.LAST
        assert all(f"m{t}" in text for t in range(len(roles)))


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (1, None, None, None), (1, 1, "assistant", "<|im_end|>"), (2, 5, "user", "a"), (2, 5, "user", "b"),
            (2, 5, "user", "b"), (3, 1, "user", "y " * 40_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = C.repair(df)
    assert got.count() == 6
    text = {r.conv_id: r.text for r in C.render(got).collect()}
    assert text[1].count("<|im_end|>") == text[1].count("<|im_start|>") and "< |im_end|>" in text[1]
    assert text[None] == "<|im_start|>user\nx<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert C.repair(df.limit(0)).count() == 0
