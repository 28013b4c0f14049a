"""Problems 4 to 9 against brute force, exact round trips and held-out accuracy, with nulls, repeats, ties and empty tables."""

import base64
import random

import numpy as np
import pandas as pd
import pytest

from ridgeline.llm import bpe, canonical, leaks, lookalike, neardup, subjects

NAMED = "tbl string, id long, text string, form string, salt int"


def test_look_alike_pairs(spark):
    same = ["Café Ijsje", "Café Ijsje", "Саfé Ijsje", "Café Ijsje", "Ｃafé Ijsje ", "Ca​fé Ijsje"]
    other = ["Cafe Ijsje", "café Ijsje", "Café Ijsje!", "Café Ijsje 1"]
    rows = [("poi", i, t) for i, t in enumerate(same + other)] + [("poi", 50, same[0]), ("poi", 50, same[0]), ("poi", 51, None), (None, 52, same[1]), ("library_routes", 1, same[1]), ("poi", None, same[1])]
    got = {tuple(r) for r in lookalike.confusable_pairs(spark.createDataFrame([(*r, "x", 1) for r in rows], NAMED)).collect()}
    ids = [*range(6)]
    want = {("poi", a, b) for a in ids for b in ids if a < b} | {("poi", a, 50) for a in ids if a}
    assert got == want
    assert lookalike.confusable_pairs(spark.createDataFrame([], NAMED)).count() == 0
    named = spark.createDataFrame([(*r, "x", 1) for r in rows], NAMED)
    assert {tuple(r) for r in lookalike.confusable_pairs(named, hot=1).collect()} == want  # every form in blocks, every text salted
    assert [(r["tbl"], r["texts"], r["records"]) for r in lookalike.confusable_classes(named).collect()] == [("poi", 6, 7)]


def test_ligatures_and_marks_on_look_alikes():
    table = lookalike.rewrites(lookalike.look_alike_classes("\u200bĳﬁÅÅА̊…"), {"i": 5})
    form = lookalike.Rewriter(table)
    assert form("dĳk ﬁets…") == form("dijk fiets...") and form("Åse") == form("А̊se") == form("Åse")
    assert form("​") == "" and form("x" * 50_000 + "​") == "x" * 50_000


LINE = "id long, track_hash string, updated_at timestamp, geometry array<struct<lat double, lon double>>, cls long, h long"


def _ride(rng, n=20, noise=0.0, base=None):
    if base is None:
        la, lo = 51 + rng.uniform(-0.2, 0.2), 4 + rng.uniform(-0.2, 0.2)
        base = []
        for _ in range(n):
            la, lo = la + rng.uniform(-0.01, 0.01), lo + rng.uniform(-0.015, 0.015)
            base.append((la, lo))
    return [(a + rng.uniform(-noise, noise), o + rng.uniform(-noise, noise)) for a, o in base]


def test_same_rides_against_all_pairs(spark):
    rng = random.Random(4)
    bases = [_ride(rng) for _ in range(25)]
    rides = [_ride(rng, noise=1e-4, base=b if k % 2 else b[::-1]) for b in bases for k in range(3)] + [b[: len(b) // 2] for b in bases[:8]] + [bases[0]] * 3
    rows = [(i, f"h{i}", None, [{"lat": a, "lon": o} for a, o in r], 1, 1) for i, r in enumerate(rides)]
    odd = [(900, "x", None, None, 1, 1), (901, "x", None, [], 1, 1), (902, "", None, [{"lat": 51.0, "lon": 4.0}], 1, 1), (903, "", None, [{"lat": 51.0, "lon": 4.0}] * 3, 1, 1), (904, neardup.EMPTY_HASH, None, [{"lat": float("nan"), "lon": 4.0}] * 2, 1, 1), (905, neardup.EMPTY_HASH, None, [None, {"lat": 51.0, "lon": None}], 1, 1), rows[3]]
    got = {tuple(r) for r in neardup.same_rides(spark.createDataFrame(rows + odd, LINE)).collect()}
    lines = [neardup.clean_line(*zip(*r, strict=True)) for r in rides]
    want = {(i, j) for i in range(len(rides)) for j in range(i + 1, len(rides)) if neardup.same_ride(lines[i], lines[j])} | {(900, 901)}
    assert got == want and len(want) > 70
    assert neardup.same_rides(spark.createDataFrame([], LINE)).count() == 0


@pytest.mark.parametrize("short,middle", [(64, 4096), (2, 8), (1, 1)])
def test_join_kernels_find_all_similar_sets(monkeypatch, short, middle):
    monkeypatch.setattr(neardup, "SHORT_LIST", short)
    monkeypatch.setattr(neardup, "MIDDLE_LIST", middle)
    rng = np.random.default_rng(1)
    centres = [rng.choice(400, 30, replace=False) for _ in range(6)]
    sets = [np.unique(np.r_[rng.choice(c, 26, replace=False), rng.choice(400, 4)]) for c in centres for _ in range(12)]
    rows = []
    for i, s in enumerate(sets):
        bits = np.zeros(256, dtype=np.uint8)
        bits[(neardup._mix(s) % np.uint64(256)).astype(int)] = 1
        words = np.packbits(bits, bitorder="little").view(np.int64)
        rows += [(int(t), 0, 0, i, len(s), p, *words) for p, t in enumerate(s[: int(neardup.prefix_length(np.array(len(s)), 0.6))])]
    found = {tuple(x) for x in neardup._candidates(0.6, pd.DataFrame(rows, columns=neardup.POSTING)).to_numpy().tolist()}
    similar = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(np.intersect1d(sets[i], sets[j])) >= 0.6 * len(np.union1d(sets[i], sets[j]))}
    assert similar and similar <= found


def test_hot_blocks_meet_pairwise(monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 3)

    class Counts:
        value = np.full(neardup.SKETCH, 10)

    rng = random.Random(3)
    base = _ride(rng)
    rides = [_ride(rng, noise=1e-4, base=base) for _ in range(9)]
    pdf = pd.DataFrame({"id": range(9), "lat": [[p[0] for p in r] for r in rides], "lon": [[p[1] for p in r] for r in rides]})
    postings = pd.concat(neardup._postings(Counts, 0.6, iter([pdf])))
    assert postings["other"].max() > 0
    assert len(neardup._candidates(0.6, postings)) == 36


def test_categories(spark):
    entries = [("tap", "Water tap", ["water tap", "robinet", None]), ("workshop", "Bicycle workshop", ["fietsenmaker"]), ("bell", "Bell tower", ["clocher"]), (None, "x", None), ("empty", None, None)]
    typed = {1: "wtaer tap", 2: "Robinet (Popkamp)", 3: "tower, Bell", 4: "bookshop", 5: "old fietsenmakr", 6: "tap dance", 7: "bell pepper", 8: "TAP", 9: "type: clocher.", 10: "???", 11: "x" * 20_000, 12: "BellTower"}
    rows = [*typed.items(), (1, "wtaer tap"), (20, None), (21, "  "), (22, "tap"), (None, "clocher")]
    poi = spark.createDataFrame([(i, c, "n", 1) for i, c in rows], "id long, category string, value string, salt int")
    cats = spark.createDataFrame(entries, "id string, label string, words array<string>")
    got = dict(map(tuple, canonical.place_categories(poi, cats).collect()))
    assert got == {1: "tap", 2: "tap", 3: "bell", 4: "unmatched", 5: "workshop", 6: "unmatched", 7: "unmatched", 8: "tap", 9: "bell", 10: "unmatched", 11: "unmatched", 12: "bell"}
    assert canonical.place_categories(poi.limit(0), cats).count() == 0
    assert {r[1] for r in canonical.place_categories(poi.where("id = 2"), cats.limit(0)).collect()} == {"unmatched"}


def test_prefix_join_is_exact(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(3, 8))) for _ in range(150)})
    rows = [(w, canonical.token_set(w)) for w in words]
    a, b = spark.createDataFrame(rows[:90], "reading string, tokens array<string>"), spark.createDataFrame(rows[60:], "name string, tokens array<string>")
    got = {(r["reading"], r["name"]) for r in canonical.similar_entries(a, b, 0.5).collect()}
    j = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    assert got == {(x, y) for x, s in rows[:90] for y, t in rows[60:] if j(s, t) >= 0.5}


RANKS = f"{bpe.TOKENIZER_DIR}/{bpe.VOCABULARY}"


def test_ids_equal_the_public_library_and_round_trip(spark):
    tiktoken = pytest.importorskip("tiktoken")
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    texts = ["", None, "<|endoftext|> hé", "  a \n\tb", "日本語🚴‍♀️", "a" * 30_000, "".join(rng.choice("abcdehlo") for _ in range(20_000)), "x'll don't 12 345"]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 1500), rng.randint(0x4E00, 0x4F00)])) for _ in range(rng.randint(1, 60))) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(map(tuple, bpe.encode_corpus(df).collect()))
    assert all(got[i] == public.encode_ordinary(t or "") for i, t in enumerate(texts))
    assert all(bpe.decode_ids(RANKS, got[i]) == (t or "") for i, t in enumerate(texts[:20]))
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_bitmap_queue_orders_ranks():
    queue, rng = bpe.BitmapQueue(50_256), random.Random(1)
    ranks = set(rng.sample(range(50_256), 500))
    for r in ranks:
        queue.add(r)
    out = []
    while (r := queue.first()) >= 0:
        queue.discard(r)
        out.append(r)
    assert out == sorted(ranks)


PASSAGE = (
    "Which of Auberoux, Belmont or Kortrath keeps the heron apart from the heather? By 1642 Montbos had lost the badger sett, though the wet meadow "
    "still nests above the moss near the quiet old mill of Tillevoorde until day 3908 of the long survey."
)


SLOTS = "then rider {} of {} met rider {} of {} and rider {} of {} on day {} at km {} of {}"


def test_leaks(spark):
    words = PASSAGE.split()
    fill = " filler text about nothing at all that matters here "
    thin = " ".join(w if i % 8 else "zzz" for i, w in enumerate(words))
    texts = {
        1: fill + PASSAGE.upper().replace(" ", "\n") + fill, 2: fill + "<b>" + " ".join(words[3:16]) + "</b>" + fill, 3: fill + " ".join(words[3:13]) + fill, 4: fill + thin + fill,
        5: (" ".join(words[:10]) + fill * 20 + " ".join(words[10:20]) + fill * 20 + " ".join(words[20:30])), 6: PASSAGE.replace("Auberoux", "Wolrath").replace("Montbos", "Everpop").replace("1642", "1777").replace("Tillevoorde", "Grimbeek").replace("3908", "12").replace("Belmont", "Faulare").replace("Kortrath", "Lintoux"),
        7: None, 8: "", 11: fill + SLOTS.format(11, "Wolrath", 22, "Everpop", 33, "Grimbeek", 4, 5, "Faulare") + fill, 12: fill + SLOTS.format(11, "Wolrath", 22, "Everpop", 33, "Grimbeek", 4, 5, "Faulare").replace("met", "saw") + fill, 9: PASSAGE.replace("e", "е").replace(" ", "  "), 10: "x " * 50_000 + PASSAGE,
    }
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(1, texts[1], 1)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(7, PASSAGE), (7, PASSAGE), (8, None), (9, ""), (10, "Too short"), (11, SLOTS.format(8911, "Lintoux", 6187, "Merwijk", 3984, "Oberoux", 12, 45, "Popdrecht"))], "item_id long, passage string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in leaks.leaked_items(docs, items).collect()}
    assert {k for k, v in got.items() if v == "quoted"} == {(1, 7), (2, 7), (4, 7), (6, 7), (9, 7), (10, 7)}  # 6 keeps more than three quarters
    assert got[11, 11] == got[12, 11] == "reparameterised"
    assert leaks.leaked_items(docs, items, hot=0).count() == len(got)
    assert leaks.leaked_items(docs.limit(0), items).count() == leaks.leaked_items(docs, items.limit(0)).count() == 0


def test_bit_vector_subsequence_length():
    rng = random.Random(9)
    for _ in range(50):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 40))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            prev = row[:]
            for j, y in enumerate(b, 1):
                row[j] = prev[j - 1] + 1 if x == y else max(prev[j], row[j - 1])
        assert leaks.lcs_length(np.array(a), leaks.Side(np.array(b)).masks, len(b)) == row[-1]


def _labelled(n, rng):
    nouns = {"rail": "train platform ticket conductor signal railcar".split(), "food": "cider waffle pancake loaf mustard stew".split()}
    frames = ["the {} stands beside the {}.", "near us the {} was like the {}.", "I saw that the {} comes after the {}."]
    filler = ["we rode far along the road.", "a chain of villages came first."]
    one = lambda s: rng.choice(frames).format(*rng.sample(nouns[s], 2))
    return [(s, " ".join([one(s) for _ in range(4)] + [rng.choice(filler) for _ in range(2)])) for s in nouns for _ in range(n)], one, filler


def test_subjects_on_held_out_texts(spark):
    rng = random.Random(5)
    train, one, filler = _labelled(40, rng)
    test, _, _ = _labelled(15, rng)
    examples = spark.createDataFrame([(i, t, s, "en") for i, (s, t) in enumerate(train)] + [(900, None, "rail", "en"), (901, "x y z", "unknown", None)], "example_id long, text string, subject string, lang string")
    areas = spark.createDataFrame([("rail", "r"), ("food", "f"), (None, "n")], "subject string, about string")
    passing = " ".join([one("food") for _ in range(9)] + [one("rail")])
    rows = [(i, t, s) for i, (s, t) in enumerate(test)] + [(800, passing, ""), (801, " ".join(filler), ""), (802, None, ""), (803, "", ""), (804, "?" * 10_000, ""), (805, " ".join([one("food")] * 3 + [one("rail")] * 3).upper(), "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, subject string")
    found = {}
    for r in subjects.subjects_of(docs, areas, examples).collect():
        found.setdefault(r["doc_id"], set()).add(r["subject"])
    assert sum(found.get(i) == {s} for i, _, s in rows[: len(test)]) >= 0.95 * len(test)
    assert found[800] == {"food"} and found[805] == {"food", "rail"} and not {801, 802, 803, 804} & set(found)
    assert subjects.subjects_of(docs.limit(0), areas, examples).count() == subjects.subjects_of(docs, areas.limit(0), examples).count() == 0
