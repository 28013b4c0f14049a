"""The factorisation decides, all subjects count, and a recomputed task sends its partial sums to the keys it sent them to before."""

import random

import numpy as np
from pyspark.sql import functions as F

from ridgeline.llm import subjects


def test_shuffle_keys_of_partial_sums_are_the_same_in_every_run(spark):
    texts = spark.createDataFrame([(i, f"the train stands beside the platform {i}. a cider and a waffle.") for i in range(60)], "doc_id long, text string").repartition(6)
    rows = texts.mapInPandas(lambda it: subjects._cut(1024, it), "doc_id long, counts binary, terms binary")
    start, weight = (spark.sparkContext.broadcast(x) for x in (np.ones((3, 1024), dtype=np.float32), np.ones(1024, dtype=np.float32)))
    keys = rows.select("counts", "terms").mapInPandas(lambda it: subjects._partial(start, weight, it), subjects._SUMS).withColumn("task", F.spark_partition_id())
    one, two = (sorted(map(tuple, keys.select("task", "component", "part").collect())) for _ in range(2))
    assert one == two and all(part == task % 16 for task, _, part in one)


def _corpus():
    rng = random.Random(2)
    words = {s: [f"{s}{chr(97 + i % 26)}{chr(97 + i // 26)}word" for i in range(60)] for s in ("rail", "food", "law")}
    filler = [f"place{chr(97 + i)}" for i in range(20)]
    sentence = lambda s, known: " ".join(rng.sample(words[s][:known], 5) + rng.sample(filler, 2)).capitalize() + "."
    examples = [(i, " ".join(sentence(s, 8) for _ in range(3)), s) for i, s in enumerate(["rail", "food", "law"] * 12)]
    docs = [(i, " ".join(sentence(s, 60) for _ in range(6)), s) for i, s in enumerate(["rail", "food", "law"] * 60)]
    return examples, docs


def test_rounds_find_what_the_examples_do_not_show(spark):
    """The labelled texts show 8 of the 60 words of each subject; the rest is learnt from texts without labels."""
    examples, docs = _corpus()
    ex = spark.createDataFrame(examples, "example_id long, text string, subject string")
    areas = spark.createDataFrame([(s,) for s in ("rail", "food", "law")], "subject string")
    df = spark.createDataFrame(docs, "doc_id long, text string, truth string")
    truth = {(i, s) for i, _, s in docs}
    right = {}
    for rounds in (0, subjects.MOST_ROUNDS):
        got = {(r["doc_id"], r["subject"]) for r in subjects.subjects_of(df, areas, ex, terms=4096, most_rounds=rounds).collect()}
        assert not got - truth
        right[rounds] = len(got)
    assert right[subjects.MOST_ROUNDS] >= 1.2 * right[0] and right[subjects.MOST_ROUNDS] >= 0.75 * len(docs)


def test_more_than_a_thousand_subjects(spark):
    names = [f"s{i:04d}" for i in range(1001)]
    code = lambda i: "".join(chr(97 + int(d)) for d in f"{i:04d}")
    text = lambda i: f"Alpha{code(i)} beta{code(i)} gamma{code(i)}."
    ex = spark.createDataFrame([(i, text(i), s) for i, s in enumerate(names)], "example_id long, text string, subject string")
    docs = spark.createDataFrame([(i, text(i)) for i in range(1001)], "doc_id long, text string")
    got = subjects.subjects_of(docs, spark.createDataFrame([(s,) for s in names], "subject string"), ex, terms=1 << 16, most_rounds=0, support=1)
    found = {(r["doc_id"], r["subject"]) for r in got.collect()}
    assert len(found & {(i, s) for i, s in enumerate(names)}) >= 950 and (1000, "s1000") in found
