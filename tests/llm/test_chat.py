import itertools
import random

import numpy as np

from wavelens.llm import chat
from wavelens.llm.common import table


def brute_cost(roles):
    best = chat.INF
    for path in itertools.product((1, 2, 3), repeat=len(roles)):
        q, c = chat.START, 0.0
        for r, x in zip(roles, path):
            options = []
            if (q, x) in chat.LEGAL:
                options.append(0.0)
            if q == x:
                options.append(chat.MERGE)
            options += [chat.INSERT for y in (1, 2, 3) if (q, y) in chat.LEGAL and (y, x) in chat.LEGAL]
            c += min(options, default=chat.INF) + chat._relabel(r, x)
            q = x
        best = min(best, c + chat.FINAL[q])
    return best


def test_repair_is_cheapest_and_matrices_compose():
    rng = random.Random(2)
    for _ in range(150):
        roles = [rng.randint(0, 3) for _ in range(rng.randint(1, 6))]
        whole = chat.transfer(roles)[0] + chat.FINAL
        assert whole.min() == brute_cost(roles)
        k = rng.randint(0, len(roles))
        a, b = chat.transfer(roles[:k]), chat.transfer(roles[k:])
        assert np.array_equal((a[:, :, None] + b[None]).min(1), chat.transfer(roles))


def text_of(rows):
    return "".join(r.rendered for r in sorted(rows, key=lambda r: r.pos))


def test_rendering_and_edges(spark):
    rows = [
        (1, 0, "user", "hi", 9), (1, 1, "assistant", "yo", 9), (2, 0, "assistant", "a", 9), (2, 1, "user", "b", 9), (3, 0, "user", "x", 9), (3, 1, "USER ", "y", 9), (3, 2, "bot", None, 9),
        (4, 0, None, None, 9), (None, None, "user", "n", 9), (5, 1, "user", "same", 9), (5, 1, "user", "same", 9),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int")
    got = {}
    for r in chat.format_chats(df).collect():
        got.setdefault(r.conv_id, []).append(r)
    u, a, e = "<|im_start|>user\n", "<|im_start|>assistant\n", "<|im_end|>\n"
    assert text_of(got[1]) == u + "hi" + e + a + "yo" + e
    assert text_of(got[3]) == u + "x\ny" + e + a + e
    assert sum(map(len, got.values())) == len(rows)
    for v in got.values():
        t = text_of(v)
        assert t.count("<|im_start|>") == t.count("<|im_end|>") and t.rstrip().endswith("<|im_end|>")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_conversation_is_cut_without_effect(spark, sf_dir):
    rng = random.Random(4)
    turns = [(7, i, rng.choice(["user", "assistant", "system", "?"]), str(i)) for i in range(3000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = sorted(chat.format_chats(df).collect(), key=lambda r: r.pos)
    codes = [chat.ALIASES.get(t[2], 0) for t in turns]
    want = (chat.transfer(codes)[0] + chat.FINAL).min()
    cost = sum({"keep": 0, "merge": chat.MERGE, "relabel": 0}[r.action] + (len(r.inserted.split(",")) if r.inserted else 0) * chat.INSERT + chat._relabel(c, chat.ROLES.index(r.role)) for r, c in zip(out, codes))
    assert [r.turn for r in out] == list(range(3000)) and cost == want
    convs = table(spark, sf_dir, "conversations")
    assert chat.format_chats(convs).count() == convs.count()
