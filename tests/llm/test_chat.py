import random

import pytest

from tickloom.llm import chat


def plain(rows):
    convs = {}
    low = lambda v: (v is not None, v)
    for conv, turn, role, text in sorted(rows, key=lambda r: (low(r[0]), low(r[1]), low(r[2]), low(r[3]))):
        convs.setdefault(conv, []).append((role, text))
    out = []
    for conv, turns in convs.items():
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in convs.values())
        equal = [c for c, o in convs.items() if o == turns]
        first = min((c for c in equal if c is not None), default=None)
        if not longer and conv == first:
            out.append((conv, len(turns), "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(4)
    rows = []
    for conv in range(80):
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, "", "hello é"])) for _ in range(rng.randint(1, 4))]
        for i, (r, t) in enumerate(turns):
            rows.append((conv, 2 * i, r, t))
    base = [("user", f"t{i}") for i in range(23)]
    for conv, n in ((100, 5), (101, 23), (102, 23), (99, 23), (103, 11), (None, 12)):
        rows += [(conv, i, *base[i]) for i in range(n)]
    rows += [(110, None, "user", "x"), (110, 1, "user", "y"), (110, 1, "user", "y"), (111, 0, "user", "x"), (111, 1, "user", "y"), (112, 0, "user", "long " * 50_000)]
    return rows


@pytest.mark.parametrize("part", [4_096, 4])
def test_against_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART_TURNS", part)
    rows = corpus()
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, place string, n int")
    whole = {}
    for r in sorted(chat.collapse(turns).collect(), key=lambda r: r.part):
        _, _, text = whole.get(r.conv_id, (0, 0, ""))
        whole[r.conv_id] = (r.conv_id, r.n_turns, text + r.text)
    assert sorted(whole.values(), key=repr) == plain(rows)


def test_empty_table(spark):
    assert chat.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
