"""Evaluation texts leaking into training text.

Passages and documents are cut to words without case, punctuation, markup and character forms, and turned into templates: numbers,
names and units become typed placeholders, their words are the slots. Windows of the passages' templates are hash-joined with those
of the documents, of which a Bloom filter of the passages' windows has left the ones that can join. Pairs with enough windows in
common are judged by template and slots: where the slots hold the passage's own words, in at least RUN consecutive words or in three
quarters of the passage in one place, the document holds it; where the template agrees and the slots are filled by a
consistent other assignment, the document holds a re-parameterised passage.

Windows that many documents hold are left out of the join, as many of each passage as its least number of windows allows (the rarest
stay), so that no key of half the corpus meets all passages with it.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.lookalike import SAME_SHAPE
from ridgeline.session import cut

WINDOW = 3
RUN = 12
SHARE = 0.75
#: A passage is in one place when its words lie within this many times its length.
PLACE = 1.5
#: Documents are cut with up to one word skipped between the words of a window, so that inserted words do not break it.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4))
#: Bits of a Bloom filter: so many times its keys, within these bounds.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 30
SEGMENT = 1 << 16
#: A window in more documents than this is hot.
HOT = 50_000
#: Documents go through the judge once for each so many passages there are.
TOGETHER = 256
#: Letters of passages that are shipped to the workers, and candidate pairs that are sent to the documents; beyond these both are shuffled.
SHIPPED, SENT = 32_000_000, 2_000_000
UNITS = frozenset("km m cm mm kmh h min s uur uhr std minuten heures kg g ton l ml euro eur volt watt kwh grad degrees hm".split())
NAME, NUMBER, UNIT, OTHER = 1, 2, 3, 4
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_LINK = re.compile(r"\]\([^()\s]*\)")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE_END = re.compile(r"[.!?:;\n]\s*[\"'«»„“”*#>_\s-]*$")
_SHAPES = {ord(o): first for first, *others in (line.split(" ") for line in SAME_SHAPE.strip().splitlines()) for o in others}


class _Shown(dict):
    """Code point to what it stands for: nothing for marks and invisible characters, one letter for look-alikes."""

    def __missing__(self, point: int) -> int | str | None:
        c = chr(point)
        self[point] = out = None if unicodedata.combining(c) or unicodedata.category(c) == "Cf" else _SHAPES.get(point, point)
        return out


_SHOWN = _Shown()


def plain_text(text: str) -> str:
    """Without markup, invisible characters, accents and look-alike letters; case is kept."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub("] ", text)
    return text if text.isascii() else unicodedata.normalize("NFKD", text).translate(_SHOWN)


def words_of(text: str) -> tuple[list[str], list[bool]]:
    """Words in lower case, and which are capitalised within a sentence."""
    plain = plain_text(text)
    words, named = [], []
    last = 0
    for m in _WORD.finditer(plain):
        word = m.group()
        upper = word[0].isupper() and not word.isupper()
        named.append(upper and last > 0 and not _SENTENCE_END.search(plain, max(0, last - 1), m.start()))
        words.append(word.casefold())
        last = m.end()
    return words, named


def lcs_length(a: np.ndarray, masks: dict[int, int], n: int) -> int:
    """Longest common subsequence by bit vectors: masks hold the positions of each word in the other text of n words."""
    full = (1 << n) - 1
    v = full
    for x in a.tolist():
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def word_key(word: str) -> int:
    """63 bits of a word in lower case, none of the placeholders' numbers."""
    return (xxhash.xxh64_intdigest(word) >> 1) | 8


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Bloom:
    """Bits of a set of keys; what is not in the set is mostly not found."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> np.ndarray:
        k = _mixed(keys)
        return np.concatenate([k & np.uint64(bits - 1), (k >> np.uint64(32)) & np.uint64(bits - 1)])

    def has(self, keys: np.ndarray) -> np.ndarray:
        k = _mixed(keys)
        out = np.ones(len(k), dtype=bool)
        for at in (k & self.mask, (k >> np.uint64(32)) & self.mask):
            out &= ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out

    @classmethod
    def of(cls, keys: np.ndarray, bits: int) -> Bloom:
        words = np.zeros(bits // 64, dtype=np.uint64)
        at = cls.places(np.asarray(keys, dtype=np.uint64), bits)
        np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        return cls(words)


def _segments(bits: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The segments of a partition's filter that hold any bit."""
    words = np.zeros(bits // 64, dtype=np.uint64)
    for pdf in batches:
        words |= Bloom.of(pdf["key"].to_numpy(dtype=np.int64).view(np.uint64), bits).words
    parts = words.reshape(-1, min(SEGMENT, len(words)))
    (some,) = np.nonzero(parts.any(axis=1))
    yield pd.DataFrame({"segment": some.astype(np.int32), "bits": [parts[k].tobytes() for k in some]})


def _either(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint64) for b in pdf["bits"]])
    return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "bits": [total.tobytes()]})


def bloom_of(keys: DataFrame) -> Bloom:
    """The filter of ``keys`` (key), of at most MOST_BITS whatever their number."""
    count = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(max(1, BITS_PER_KEY * count)))))
    words = np.zeros(bits // 64, dtype=np.uint64)
    width = min(SEGMENT, len(words))
    for r in keys.mapInPandas(lambda it: _segments(bits, it), "segment int, bits binary").groupBy("segment").applyInPandas(_either, "segment int, bits binary").collect():
        words[r["segment"] * width : (r["segment"] + 1) * width] = np.frombuffer(r["bits"], dtype=np.uint64)
    return Bloom(words)


_UNIT_KEYS = frozenset(map(word_key, UNITS))


class _Codes(dict):
    """Word, as written, to its number in ``code`` (its place in a template: a placeholder, or the key of a word of the passages) and ``key``."""

    def __init__(self, names: np.ndarray, vocabulary: np.ndarray):
        super().__init__()
        self.names, self.vocabulary = Bloom(names), Bloom(vocabulary)
        self.code, self.key = np.empty(1024, dtype=np.int64), np.empty(1024, dtype=np.int64)

    def __missing__(self, word: str) -> int:
        key = word_key(word.casefold())
        one = np.array([key])
        if word[0].isdigit():
            code = NUMBER
        elif self.names.has(one)[0]:
            code = NAME
        elif self.vocabulary.has(one)[0]:
            code = key
        else:
            code = NAME if word[0].isupper() and not word.isupper() else OTHER
        n = len(self)
        if n == len(self.code):
            self.code, self.key = np.resize(self.code, 2 * n), np.resize(self.key, 2 * n)
        self.code[n], self.key[n] = code, key
        self[word] = n
        return n


class Cutter:
    """Texts to templates (codes) and their words (keys)."""

    def __init__(self, filters: tuple):
        """``filters``: shipped bits of the passages' names and of all their words."""
        self.codes = _Codes(*(f.value for f in filters))

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        of = self.codes
        if len(of) > 500_000:
            of.clear()
        words = _WORD.findall(plain_text(text))
        at = np.fromiter(map(of.__getitem__, words), np.int64, len(words))
        code, key = of.code[at], of.key[at]
        after = np.flatnonzero(code[:-1] == NUMBER) + 1
        if len(after):
            code[[n for n, k in zip(after.tolist(), key[after].tolist(), strict=True) if k in _UNIT_KEYS]] = UNIT
        return code, key


def window_keys(code: np.ndarray, shape: tuple[int, ...] = SHAPES[0]) -> np.ndarray:
    """Hash of each window of a template; 0 for those that hold an unknown word or nothing but placeholders."""
    n = len(code) - shape[-1]
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    parts = [code[k : k + n].astype(np.uint64) for k in shape]
    out = np.zeros(n, dtype=np.uint64)
    for x in parts:
        out = _mixed(out + x) * np.uint64(0x100000001B3)
    usable = np.logical_and.reduce([x != OTHER for x in parts]) & np.logical_or.reduce([x > OTHER for x in parts])
    return np.where(usable, out | np.uint64(1), np.uint64(0))


def least_windows(n: np.ndarray | int) -> np.ndarray:
    """How many windows of a passage of n words a document must hold at least.

    A quarter of the words changed or dropped, evenly, leaves n / 4 - 2 windows whole, and RUN words in a row hold RUN - WINDOW + 1; this is
    a fifth, to allow for words put in beside.
    """
    return np.minimum(RUN - WINDOW + 1, np.maximum(2, np.ceil(np.asarray(n) / 5) - 2)).astype(np.int64)


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, named) of the passages' words."""
    for pdf in batches:
        cut_up = [words_of(p) for p in pdf["passage"]]
        rows = {(word_key(w), n) for words, named in cut_up for w, n in zip(words, named, strict=True)}
        yield pd.DataFrame(sorted(rows), columns=["key", "named"]).astype({"key": "int64", "named": "bool"})


def _passage_windows(filters: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cutter = Cutter(filters)
    for pdf in batches:
        out = []
        for item, passage in zip(pdf["item_id"], pdf["passage"], strict=True):
            code, _ = cutter(passage)
            keys, n = np.unique(window_keys(code), return_counts=True)
            keys, n = keys[keys > 0], n[keys > 0]
            need = min(int(least_windows(len(code))), int(n.sum()))
            # nine tenths of the template in order leave so many windows whole, with words put in beside
            same = max(need, int(n.sum()) - len(code) // 2)
            out.append(pd.DataFrame({"item_id": item, "key": keys.view(np.int64), "n": n.astype(np.int32), "need": np.int32(need), "same": np.int32(same)}))
        yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"item_id": [], "key": [], "n": [], "need": [], "same": []}).astype("int64")


def _document_windows(filters: tuple, known, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, key) of the windows, each once a document, that the filter of the passages' windows lets pass."""
    cutter, bloom = Cutter(filters), Bloom(known.value)
    for pdf in batches:
        for begin in range(0, len(pdf), 256):
            part = pdf.iloc[begin : begin + 256]
            cuts = [cutter(t)[0] for t in part["text"]]
            gap = np.full(SHAPES[-1][-1], OTHER)  # no window runs from one text into the next
            code = np.concatenate([x for c in cuts for x in (c, gap)])
            owner = np.repeat(np.arange(len(cuts)), [len(c) + len(gap) for c in cuts])
            found = []
            for shape in SHAPES:
                keys = window_keys(code, shape)
                (at,) = np.nonzero(keys)
                at = at[bloom.has(keys[at])]
                found.append(pd.DataFrame({"n": owner[at], "key": keys[at].view(np.int64)}))
            out = pd.concat(found, ignore_index=True).drop_duplicates()
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[out["n"].to_numpy()], "key": out["key"].to_numpy()})


class Numbers(dict):
    """Small numbers of the words and placeholders of the passages at hand; 0 is any other word."""

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.array([self.get(v, 0) for v in x.tolist()], dtype=np.int64)

    def added(self, x: np.ndarray) -> np.ndarray:
        return np.array([self.setdefault(v, len(self) + 1) for v in x.tolist()], dtype=np.int64)


class Side:
    """The words of a passage, or its template: their numbers, the places of each as bits, and which numbers are in it."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.masks: dict[int, int] = {}
        for at, w in enumerate(x.tolist()):
            self.masks[w] = self.masks.get(w, 0) | (1 << at)
        self.member = np.zeros(0, dtype=bool)
        self.count = np.zeros(0, dtype=np.int64)

    def most(self, document: np.ndarray, size: int) -> int:
        """Bound of the common subsequence: words in common, each as often as both have it."""
        if len(self.count) < size:
            self.count = np.bincount(self.x, minlength=size)
        return int(np.minimum(np.bincount(document, minlength=len(self.count)), self.count).sum())

    def holds(self, document: np.ndarray, size: int) -> np.ndarray:
        if len(self.member) < size:
            self.member = np.zeros(size, dtype=bool)
            self.member[self.x] = True
        return self.member[document]


class Passage:
    """A passage cut once for all documents it is compared with."""

    def __init__(self, code: np.ndarray, key: np.ndarray, numbers: Numbers):
        self.code, self.key, self.n = code, key, len(code)
        self.runs = set(run_keys(key).tolist())
        self.template, self.words = Side(numbers.added(code)), Side(numbers.added(key))


class Text:
    """A document cut once for all passages it is compared with; what few passages need is made when it is asked for."""

    def __init__(self, code: np.ndarray, key: np.ndarray, numbers: Numbers):
        self.code, self.key, self.numbers = code, key, numbers
        self.words = numbers.of(key)

    @cached_property
    def template(self) -> np.ndarray:
        return self.numbers.of(self.code)

    @cached_property
    def runs(self) -> set[int]:
        return set(run_keys(self.key).tolist())


def run_keys(x: np.ndarray, length: int = RUN) -> np.ndarray:
    n = len(x) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(length):
        out = _mixed(out + x[k : k + n].astype(np.uint64)) * np.uint64(0x100000001B3)
    return out


def most_in_one_place(document: np.ndarray, side: Side, size: int, least: float) -> tuple[int, int]:
    """(longest common subsequence, its place) over the places of PLACE times the passage, or zero where none reaches ``least``.

    A place holds no longer subsequence than it holds words of the passage, so that only places with enough of them are aligned.
    Places that begin at a word of the passage are enough, and of those that hold the same words one.
    """
    n = len(side.x)
    own = side.holds(document, size)
    if not len(own) or np.count_nonzero(own) < least:
        return 0, 0
    length = min(math.ceil(PLACE * n), len(document))
    held = np.r_[0, np.cumsum(own)]
    inside = held[length:] - held[:-length]
    starts = np.flatnonzero((inside >= least) & own[: len(inside)])
    if not len(starts) and len(inside) and inside.max() >= least:
        starts = np.array([int(inside.argmax())])
    best, after, half = (0, 0), -1, length // 2
    for s in starts.tolist():
        if s < after:
            continue
        if side.most(document[s : s + length + half], size) < least:
            after = s + half + 1  # all places inside it hold fewer
            continue
        part = document[s : s + length]
        same = side.most(part, size)
        if same >= least:
            same = lcs_length(part, side.masks, n)
            best = max(best, (same, -s))
        # a place begun k words later holds at most k words more
        after = s + math.ceil(least - same)
    return (best[0], -best[1]) if best[0] >= least else (0, 0)


def consistent(passage: Passage, code: np.ndarray, key: np.ndarray, place: int) -> bool:
    """Slots of the passage, aligned in order, take one value each and not all their own."""
    part, at = code[place : place + math.ceil(PLACE * passage.n)], 0
    value: dict[int, int] = {}
    changed = 0
    for p in range(passage.n):
        nxt = np.flatnonzero(part[at : at + 8] == passage.code[p])
        if not len(nxt):
            continue
        at += int(nxt[0])
        if passage.code[p] in (NAME, NUMBER):
            word, own = int(key[place + at]), int(passage.key[p])
            if value.setdefault(own, word) != word:
                return False
            changed += word != own
        at += 1
    return changed > 0


def judge(passage: Passage, text: Text, size: int, alike: bool = True) -> tuple[str, float] | None:
    """Whether a text holds the passage: template and slots alike (quoted), or the template (if it may be ``alike``) with other slots."""
    if not len(text.words):
        return None
    # a run of RUN words can only be where so many words in a row are the passage's
    held = np.cumsum(passage.words.holds(text.words, size))
    if len(held) >= RUN and (held[RUN:] - held[:-RUN] == RUN).any() | (held[RUN - 1] == RUN) and not passage.runs.isdisjoint(text.runs):
        return "quoted", 1.0
    n = passage.n
    same, _ = most_in_one_place(text.words, passage.words, size, SHARE * n)
    if same:
        return "quoted", same / n
    same, begin = most_in_one_place(text.template, passage.template, size, 0.9 * n) if alike else (0, 0)
    if same and consistent(passage, text.code, text.key, begin):
        return "reparameterised", same / n
    return None


def _judged(filters: tuple, shipped, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cutter = Cutter(filters)
    numbers = Numbers()
    passages: dict[int, Passage] = {}
    for pdf in batches:
        if len(passages) > 20_000:
            passages.clear()
            numbers.clear()
        rows = []
        for items, several in zip(pdf["item_id"], pdf["passage"], strict=True):
            for item, passage in zip(items, several, strict=True):
                if item not in passages:
                    passages[item] = Passage(*cutter(shipped.value[item] if shipped else passage), numbers)
        size = len(numbers) + 1
        for doc, text, items, alike in zip(pdf["doc_id"], pdf["text"], pdf["item_id"], pdf["alike"], strict=True):
            one = Text(*cutter(text), numbers)
            for item, other in zip(items, alike, strict=True):
                found = judge(passages[item], one, size, other)
                if found:
                    rows.append((doc, item, *found))
        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "kind", "share"]).astype({"doc_id": "int64", "item_id": "int64", "share": "float64"})


def candidate_pairs(texts: DataFrame, windows: DataFrame, filters: tuple, hot: int = HOT) -> DataFrame:
    """(doc_id, item_id, alike): pairs with at least the least number of windows in common, and whether the templates can be alike."""
    spark = texts.sparkSession
    known = spark.sparkContext.broadcast(bloom_of(windows.select("key").distinct()).words)
    hits = cut(texts.mapInPandas(lambda it: _document_windows(filters, known, it), "doc_id long, key long"))
    often = hits.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") > hot)
    # of the hottest windows of a passage as many are left out as leave one of its least number
    ranked = windows.join(often, "key", "left").withColumn(
        "so_far", F.sum("n").over(Window.partitionBy("item_id").orderBy(F.coalesce("often", F.lit(0)).desc(), "key").rowsBetween(Window.unboundedPreceding, 0))
    )
    spared = F.col("often").isNotNull() & (F.col("so_far") < F.col("need"))
    left_out = F.max(F.when(spared, F.col("so_far")).otherwise(0)).over(Window.partitionBy("item_id"))
    rest = ranked.withColumn("left_out", left_out).where(~spared).select("key", "item_id", "n", (F.col("need") - F.col("left_out")).alias("least"), (F.col("same") - F.col("left_out")).alias("same"))
    held = hits.join(rest, "key").groupBy("doc_id", "item_id").agg(F.sum("n").alias("n"), F.max("least").alias("least"), F.max("same").alias("same"))
    return held.where("n >= least").select("doc_id", "item_id", F.expr("n >= same").alias("alike"))


def leaked_items(documents: DataFrame, items: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, item_id, kind, share): documents that hold a passage, ``kind`` quoted or reparameterised.

    Null or empty texts and passages hold nothing; repeated rows give one case; empty tables give an empty result. Any number of
    passages is joined in one pass over the documents. Other columns are ignored.
    """
    spark = documents.sparkSession
    known = items.where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "passage").dropDuplicates(["item_id"])
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = known.select("passage").mapInPandas(_words, "key long, named boolean").groupBy("key").agg(F.max("named").alias("named"))
    words = cut(words)
    filters = tuple(spark.sparkContext.broadcast(bloom_of(w).words) for w in (words.where("named"), words))
    windows = cut(known.mapInPandas(lambda it: _passage_windows(filters, it), "item_id long, key long, n int, need int, same int"))
    pairs = candidate_pairs(texts, windows, filters, hot)
    # a text goes to the judge with the passages it may hold, in lists of bounded length; passages of bounded size are shipped, others joined
    size = known.agg(F.count(F.lit(1)).alias("passages"), F.sum(F.length("passage")).alias("letters")).first()
    lists = F.pmod(F.xxhash64("item_id"), F.lit(-(-size["passages"] // TOGETHER) or 1)).alias("list")
    if (size["letters"] or 0) <= SHIPPED:
        shipped = spark.sparkContext.broadcast({r["item_id"]: r["passage"] for r in known.collect()})
        held = F.struct("item_id", F.lit(None).cast("string").alias("passage"), "alike")
    else:
        shipped, pairs = None, pairs.join(known, "item_id")
        held = F.struct("item_id", "passage", "alike")
    asked = cut(pairs.groupBy("doc_id", lists).agg(F.collect_list(held).alias("of")).select("doc_id", "of.item_id", "of.passage", "of.alike"))
    if shipped is not None and (asked.agg(F.sum(F.size("item_id"))).first()[0] or 0) <= SENT:
        asked = F.broadcast(asked)
    judged = texts.join(asked, "doc_id").select("doc_id", "text", "item_id", "passage", "alike")
    out = judged.mapInPandas(lambda it: _judged(filters, shipped, it), "doc_id long, item_id long, kind string, share double")
    return out.groupBy("doc_id", "item_id", "kind").agg(F.max("share").alias("share"))
