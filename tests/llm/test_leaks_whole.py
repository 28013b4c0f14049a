"""Leaked passages: quotations with words put in, many passages, hot windows, and the join against brute force."""

import random

import numpy as np
import pytest

from ridgeline.llm import leaks

WORDS = [f"{a}{b}" for a in ("oak", "elm", "fir", "ash", "yew", "box", "bay", "fig") for b in ("land", "side", "gate", "ford", "mill", "wood", "stone", "field", "well", "moor")]


def _passage(rng, n=40):
    return [rng.choice(WORDS) for _ in range(n)]


def _frames(spark, texts, passages):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string")


def test_words_put_in_after_every_second_word(spark):
    words = _passage(random.Random(1), 60)
    dense = " ".join(w if i % 2 == 0 else f"{w} zzz" for i, w in enumerate(words))
    docs, items = _frames(spark, [dense, " ".join(words[:11])], [" ".join(words)])
    assert [(r["doc_id"], r["kind"]) for r in leaks.leaked_items(docs, items).collect()] == [(0, "quoted")]


def test_join_equals_brute_force_with_and_without_hot_windows(spark):
    rng = random.Random(7)
    passages = [_passage(rng, rng.choice((15, 30, 60))) for _ in range(40)]
    texts = []
    for _ in range(150):
        p = rng.choice(passages)
        a = rng.randrange(len(p))
        part = [w for w in p[a : a + rng.randrange(5, 60)] if rng.random() > 0.1]
        texts.append(" ".join(_passage(rng, 20) + part + _passage(rng, 20)))
    docs, items = _frames(spark, texts, [" ".join(p) for p in passages])

    def held(p, t):
        if any(p[i : i + 12] == t[j : j + 12] for i in range(len(p) - 11) for j in range(len(t) - 11)):
            return True
        masks, size = leaks.Side(np.array([WORDS.index(w) for w in p])).masks, int(np.ceil(leaks.PLACE * len(p)))
        t = np.array([WORDS.index(w) for w in t])
        return any(leaks.lcs_length(t[s : s + size], masks, len(p)) >= leaks.SHARE * len(p) for s in range(max(1, len(t) - size + 1)))

    want = {(i, j) for i, t in enumerate(texts) for j, p in enumerate(passages) if held(p, t.split())}
    for hot in (0, leaks.HOT):
        got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(docs, items, hot=hot).where("kind = 'quoted'").collect()}
        assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 30


@pytest.mark.parametrize("shipped", [leaks.SHIPPED, 0])
def test_more_passages_than_one_block_held_before(spark, monkeypatch, shipped):
    monkeypatch.setattr(leaks, "SHIPPED", shipped)
    rng = random.Random(3)
    passages = [" ".join(f"w{rng.randrange(10**6)}x" for _ in range(14)) for _ in range(5000)]
    docs, items = _frames(spark, [passages[4999], passages[17] + " and " + passages[4242], "nothing"], passages)
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(docs, items).collect()} == {(0, 4999), (1, 17), (1, 4242)}
