"""Subject areas of each document by a seeded, anchored non-negative factorisation.

The rows factored are the sentences of the whole corpus, the columns hashed terms weighted by rarity. Each subject is one component,
seeded by the terms that labelled examples tie to it and anchored there: such a term is zero in every other component and stays so,
terms the examples show to be common to all subjects are left to a few background components, and terms the examples do not show are
free and are learnt. Updates alternate by least squares, cut off at zero: with the components fixed each worker solves the mixtures of
its sentences, and the sums that renew the components are added up over all partitions, until the components stay as they are.
The mixture of a sentence then gives its subject.

The texts are cut to terms once and kept, as binary rows, in the checkpoint folder; every pass reads only these.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.leaks import plain_text
from ridgeline.session import cut

TERMS = 1 << 17
BACKGROUND = 4
#: Rounds end when no component moves by more than this (all have length 1), and at the latest after so many.
MOVED, MOST_ROUNDS = 0.15, 8
#: A document is about a subject when this part of its sentences is.
PART = 1 / 6
#: A sentence is about the subject that is first in its mixture when it holds this many times what one term of the subject brings.
MIXTURE = 1.5
#: Bound on labelled examples used for the seeds; all are used up to it.
MOST_EXAMPLES = 200_000
SUPPORT, PURITY = 5, 0.7
#: Weight of the seeds in each renewed component, and of the diagonal in the least squares.
PRIOR, RIDGE = 0.7, 1e-3
_SPECIAL = re.compile(r"<\|[^|<>]*\|>")
_LINES = re.compile(r"[\r\n\x0b\x0c\x85  ]+")
_CASED_END = re.compile(r"(?<=[.!])\s+(?=\S)|(?<=\?)\s+(?=[A-ZÀ-ÞΑ-ЯЀ-Џ])")
_UPPER_END = re.compile(r"(?<=[.!])\s+(?=\S)")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str) -> list[list[str]]:
    """Words, in lower case, of each sentence; headings, table rows, data and fragments of fewer than three words are none."""
    plain = plain_text(_SPECIAL.sub(" ", text))
    end = _CASED_END if any(c.islower() for c in plain) else _UPPER_END
    out = []
    for line in _LINES.split(plain):
        line = line.strip()
        if line[:1] in ("#", "|", "{", "["):
            continue
        for part in end.split(line):
            words = _WORD.findall(part.casefold())
            if len(words) >= 3:
                out.append(words)
    return out


class _Terms(dict):
    """Word to hashed term, -1 for what is no word of language (single letters, numbers)."""

    def __init__(self, terms: int):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = ((zlib.crc32(word.encode()) * 0x9E3779B1) % 2**32 * self.terms) >> 32 if len(word) > 1 and not word[0].isdigit() else -1
        return out


def term_ids(words: list[str], of: _Terms | None = None) -> list[int]:
    """Hashed terms of a sentence: its words of two letters or more, without numbers."""
    of = _Terms(TERMS) if of is None else of
    ids = {of[w] for w in words}
    ids.discard(-1)
    return sorted(ids)


def _cut(terms: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The terms of each document's sentences: one count a sentence, and the terms one after the other."""
    of = _Terms(terms)
    for pdf in batches:
        counts, flat = [], []
        for text in pdf["text"]:
            rows = [term_ids(words, of) for words in sentences(text)]
            counts.append(np.array([len(r) for r in rows], dtype=np.int32).tobytes())
            flat.append(np.array([t for r in rows for t in r], dtype=np.int32).tobytes())
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "counts": counts, "terms": flat})


class Rows:
    """Sentences of a batch of documents as sparse rows of weighted terms."""

    def __init__(self, counts, terms, weight: np.ndarray):
        per_text = [np.frombuffer(c, dtype=np.int32) for c in counts]
        self.texts = len(per_text)
        self.owner = np.repeat(np.arange(self.texts), [len(c) for c in per_text])
        self.counts = np.concatenate([np.empty(0, np.int32), *per_text]).astype(np.int64)
        self.term = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(t, dtype=np.int32) for t in terms)])
        self.row = np.repeat(np.arange(len(self.owner)), self.counts)
        self.x = weight[self.term]

    def mixtures(self, components: np.ndarray) -> np.ndarray:
        """Least-squares mixture of each sentence, cut off at zero, with the components fixed."""
        k = len(components)
        w = np.zeros((len(self.owner), k))
        full = self.counts > 0
        if full.any():
            starts = (np.cumsum(self.counts) - self.counts)[full]
            w[full] = np.add.reduceat(np.take(components.T, self.term, axis=0) * self.x[:, None], starts, axis=0)
        h = components.astype(np.float64)
        return np.maximum(w @ np.linalg.inv(h @ h.T + RIDGE * np.eye(k)), 0)

    def sums(self, components: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the components are renewed from: mixtures x terms, and mixtures x mixtures."""
        w = self.mixtures(components)
        return np.stack([np.bincount(self.term, weights=w[self.row, k] * self.x, minlength=components.shape[1]) for k in range(len(components))]), w.T @ w


class Seeds:
    """What labelled examples say of the terms: those anchored in one subject (``anchor``, else -1), and those common to all."""

    def __init__(self, examples: pd.DataFrame, subjects: list[str], terms: int = TERMS, support: int = SUPPORT):
        seen = np.zeros((len(subjects), terms), dtype=np.float32)
        number = {s: k for k, s in enumerate(subjects)}
        of = _Terms(terms)
        for text, subject in zip(examples["text"], examples["subject"], strict=True):
            if isinstance(text, str) and subject in number:
                seen[number[subject], list({i for words in sentences(text) for i in term_ids(words, of)})] += 1
        # of equally frequent subjects, the share of a term is what counts
        size = np.maximum(seen.sum(axis=1, keepdims=True), 1)
        share = seen / size * size.mean()
        known = seen.sum(axis=0) >= support
        pure = share.max(axis=0) >= PURITY * share.sum(axis=0)
        self.subjects, self.terms = len(subjects), terms
        self.anchor = np.where(known & pure, share.argmax(axis=0), -1).astype(np.int32)
        self.common = known & ~pure

    def allowed(self) -> np.ndarray:
        """(components, terms): where a component may be other than zero."""
        out = np.ones((self.subjects + BACKGROUND, self.terms), dtype=bool)
        out[: self.subjects, self.common] = False
        out[:, self.anchor >= 0] = False
        (at,) = np.nonzero(self.anchor >= 0)
        out[self.anchor[at], at] = True
        return out

    def start(self, weight: np.ndarray) -> np.ndarray:
        h = np.zeros((self.subjects + BACKGROUND, self.terms), dtype=np.float32)
        (at,) = np.nonzero(self.anchor >= 0)
        h[self.anchor[at], at] = 1
        h[self.subjects :, self.common] = np.random.default_rng(7).uniform(0.5, 1.5, (BACKGROUND, int(self.common.sum())))
        return unit_rows(h * weight)

    def unit(self, h: np.ndarray, weight: np.ndarray, often: np.ndarray) -> np.ndarray:
        """What one anchored term, of those there are in the corpus, brings to the mixture of its subject."""
        out = np.ones(self.subjects)
        for k in range(self.subjects):
            (at,) = np.nonzero((self.anchor == k) & (often > 0))
            if len(at):
                out[k] = max(1e-9, float((h[k, at] * weight[at] * often[at]).sum() / often[at].sum()))
        return out


def unit_rows(h: np.ndarray) -> np.ndarray:
    return (h / np.maximum(np.sqrt((h.astype(np.float64) ** 2).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)


def _parts(vectors: np.ndarray, squares: list[np.ndarray]) -> pd.DataFrame:
    """Sums of a partition by component; a recomputed task sends them to the same keys."""
    part = np.int32(TaskContext.get().partitionId() % 16)
    return pd.DataFrame({
        "component": np.arange(len(vectors), dtype=np.int32), "part": np.full(len(vectors), part),
        "sums": [v.astype(np.float32).tobytes() for v in vectors], "squares": [q.tobytes() for q in squares],
    })


def _often(terms: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, rows = np.zeros(terms), 0
    for pdf in batches:
        for c, t in zip(pdf["counts"], pdf["terms"], strict=True):
            rows += len(c) // 4
            total += np.bincount(np.frombuffer(t, dtype=np.int32), minlength=terms) if len(t) > 4 * terms else 0
            if len(t) <= 4 * terms:
                np.add.at(total, np.frombuffer(t, dtype=np.int32), 1)
    yield _parts(total[None], [np.array([float(rows)])])


def _partial(components, weight, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    h = components.value
    total, squares = np.zeros(h.shape), np.zeros((len(h), len(h)))
    for pdf in batches:
        for begin in range(0, len(pdf), 2048):
            some = pdf.iloc[begin : begin + 2048]
            xw, ww = Rows(some["counts"], some["terms"], weight.value).sums(h)
            total += xw
            squares += ww
    yield _parts(total, list(squares))


_SUMS = "component int, part int, sums binary, squares binary"


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, dtype=np.float32).astype(np.float64) for x in pdf["sums"])
    squares = sum(np.frombuffer(x, dtype=np.float64) for x in pdf["squares"])
    return pd.DataFrame({"component": [pdf["component"].iloc[0]], "part": [np.int32(0)], "sums": [total.astype(np.float32).tobytes()], "squares": [squares.tobytes()]})


def _collected(sums: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """One vector a component comes to the driver; partitions are added up in two steps."""
    once = sums.groupBy("component", "part").applyInPandas(_added, _SUMS)
    rows = sorted(once.groupBy("component").applyInPandas(_added, _SUMS).collect(), key=lambda r: r["component"])
    if not rows:
        return np.zeros((1, TERMS), dtype=np.float32), np.zeros((1, 1))
    return np.stack([np.frombuffer(r["sums"], dtype=np.float32) for r in rows]), np.stack([np.frombuffer(r["squares"], dtype=np.float64) for r in rows])


def fit_components(rows: DataFrame, seeds: Seeds, weight: np.ndarray, most_rounds: int = MOST_ROUNDS) -> np.ndarray:
    """The components after alternating updates over all sentences of ``rows`` (counts, terms)."""
    context = rows.sparkSession.sparkContext
    start, allowed = seeds.start(weight), seeds.allowed()
    h, heavy = start, context.broadcast(weight)
    for _ in range(most_rounds):
        shipped = context.broadcast(h)
        xw, ww = _collected(rows.select("counts", "terms").mapInPandas(lambda it, shipped=shipped: _partial(shipped, heavy, it), _SUMS))
        renewed = np.linalg.inv(ww + RIDGE * max(np.trace(ww) / len(ww), 1e-12) * np.eye(len(ww))) @ xw
        renewed = unit_rows(PRIOR * start + (1 - PRIOR) * unit_rows(np.maximum(renewed, 0) * allowed))
        moved = float(np.sqrt(((renewed - h) ** 2).sum(axis=1)).max())
        h = renewed
        if moved <= MOVED:
            break
    return h


def document_subjects(rows: Rows, h: np.ndarray, unit: np.ndarray, mixture: float = MIXTURE) -> list[tuple[int, int, float]]:
    """(text number, subject number, part of its sentences) of a batch."""
    subjects = len(unit)
    if not len(rows.owner):
        return []
    w = rows.mixtures(h)[:, :subjects] / unit
    best = w.argmax(axis=1)
    about = w[np.arange(len(best)), best] >= mixture
    size = np.bincount(rows.owner, minlength=rows.texts)
    found = np.bincount(rows.owner[about] * subjects + best[about], minlength=rows.texts * subjects).reshape(rows.texts, subjects)
    n, k = np.nonzero((found >= PART * size[:, None] - 1e-9) & (found > 0))
    return [(int(a), int(b), float(found[a, b] / size[a])) for a, b in zip(n, k, strict=True)]


def _assign(components, weight, unit: np.ndarray, subjects: list[str], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for begin in range(0, len(pdf), 2048):
            part = pdf.iloc[begin : begin + 2048]
            found = document_subjects(Rows(part["counts"], part["terms"], weight.value), components.value, unit)
            ids = part["doc_id"].to_numpy()
            yield pd.DataFrame(
                {"doc_id": [int(ids[n]) for n, _, _ in found], "subject": [subjects[k] for _, k, _ in found], "part": [p for _, _, p in found]}
            ).astype({"doc_id": "int64", "part": "float64"})


def subjects_of(documents: DataFrame, areas: DataFrame, examples: DataFrame, terms: int = TERMS, most_rounds: int = MOST_ROUNDS, support: int = SUPPORT) -> DataFrame:
    """(doc_id, subject, part): the subjects that at least a sixth of a document's sentences are about, with that part.

    Null, empty and sentence-less texts have no subject; no areas or no examples give an empty result; examples of unknown subjects and
    null texts are left out. Any number of subjects; workers hold one vector of ``terms`` numbers for each. Other columns are ignored.
    """
    spark = documents.sparkSession
    schema = "doc_id long, subject string, part double"
    subjects = sorted(r["subject"] for r in areas.select("subject").where(F.col("subject").isNotNull()).distinct().collect())
    labelled = examples.where(F.col("text").isNotNull() & F.col("subject").isNotNull()).select("example_id", "text", "subject")
    known = labelled.orderBy(F.xxhash64("example_id"), "text").limit(MOST_EXAMPLES).toPandas()
    if not subjects or not len(known):
        return spark.createDataFrame([], schema)
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(texts.mapInPandas(lambda it: _cut(terms, it), "doc_id long, counts binary, terms binary"))
    often, count = _collected(rows.select("counts", "terms").mapInPandas(lambda it: _often(terms, it), _SUMS))
    if not often.any():
        return spark.createDataFrame([], schema)
    weight = np.log((count[0, 0] + 1) / (often[0] + 1)).clip(min=0)
    weight = (weight / max(weight.max(), 1e-9)).astype(np.float32)
    seeds = Seeds(known, subjects, terms, support)
    h = fit_components(rows, seeds, weight, most_rounds)
    unit = seeds.unit(h, weight, often[0])
    shipped, heavy = spark.sparkContext.broadcast(h), spark.sparkContext.broadcast(weight)
    return rows.mapInPandas(lambda it: _assign(shipped, heavy, unit, subjects, it), schema)


def composition(found: DataFrame) -> DataFrame:
    """(subject, documents, mean_part) of the corpus."""
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("part"), 6).alias("mean_part"))
