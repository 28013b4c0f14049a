"""Mapping free-entered values to a canonical list.

A prefix-filter join by Jaccard similarity between the distinct values typed and the names in the list, on their letters (numbered when
repeated) without blanks: tokens are ordered by global rarity, only rare prefixes are joined, length and positions filter, and the similarity
is verified exactly. Its threshold is the least that the typing errors allowed for the names in the list leave, so that none of these is
dropped. The most similar entry is kept among those a check of the errors lets pass; values without one are unmatched.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.session import cut

SIMILARITY = 0.5
UNMATCHED = "unmatched"
SALTS = 8


def letters(text: str) -> list[str]:
    """Words in lower case without accents, punctuation and symbols."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain)


def readings(text: str) -> list[str]:
    """What was possibly meant: the text, without a place added in brackets or after a dash, without a label or a word before it."""
    bare = re.sub(r"[\s.,;:!?]+$", "", text)
    bare = re.sub(r"\s*\([^()]*\)$|\s+[-–—]\s+\S.*$", "", bare)
    bare = re.sub(r"^\s*\w+\s*:\s*", "", bare)
    out = []
    for words in (letters(text), letters(bare), letters(bare)[1:], sorted(letters(bare)), sorted(letters(bare)[1:])):
        if words and " ".join(words) not in out:
            out.append(" ".join(words))
    return out


def token_set(words: str) -> list[str]:
    """Numbered letters of the text without blanks: one token a letter, so that the order of words does not matter."""
    seen: Counter[str] = Counter()
    out = []
    for c in words.replace(" ", ""):
        seen[c] += 1
        out.append(f"{c}{seen[c]}")
    return sorted(out)


def pairs_in_common(a: str, b: str) -> float:
    """Jaccard similarity of the letter pairs, to tell entries of one letter similarity apart."""
    one, two = ({x[i : i + 2] for x in t.split() for i in range(len(x) - 1)} for t in (a, b))
    return len(one & two) / max(1, len(one | two))


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours; more than ``most`` is most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], two[j - 2] + 1)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def allowed_edits(name: str, is_id: bool = False) -> int:
    """By length; an id that is no name of its entry is code, not language, and may be one edit away at most."""
    n = len(name.replace(" ", ""))
    return 0 if n < 4 else 1 if n < 6 or is_id else 2 if n < 11 else 3


def _with_tokens(batches: Iterator[pd.DataFrame], most: int | None = None) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(value, reading) for value in pdf["value"] for reading in readings(value)[:most]]
        out = pd.DataFrame(rows, columns=["value", "reading"])
        yield out.assign(tokens=[token_set(r) for r in out["reading"]])


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Similar pairs that few typing errors can lead to, with the letter pairs they share."""
    for pdf in batches:
        keep, pairs = [], []
        for reading, name, code in zip(pdf["reading"], pdf["name"], pdf["code"], strict=True):
            most = allowed_edits(name, code)
            ok = edits(reading.replace(" ", ""), name.replace(" ", ""), most) <= most or edits("".join(sorted(reading.split())), "".join(sorted(name.split())), most) <= most
            keep.append(ok)
            pairs.append(pairs_in_common(reading, name) if ok else 0.0)
        yield pdf.assign(pairs=pairs)[keep]


def least_similarity(name: str, is_id: bool = False) -> float:
    """Jaccard similarity of numbered letters that the allowed edits leave at least: k edits of n letters keep n - k in common, of n + k."""
    n, k = len(name.replace(" ", "")), allowed_edits(name, is_id)
    return (n - k) / (n + k) if n else 1.0


def _least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"least": [least_similarity(n, bool(c)) for n, c in zip(pdf["name"], pdf["code"], strict=True)]}).astype({"least": "float64"})


def _prefix(tokens: Column, similarity: float) -> Column:
    n = F.size(tokens)
    return F.slice(tokens, F.lit(1), n - F.ceil(F.lit(similarity) * n).cast("int") + 1)


def _ranked(rows: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """(key, tokens by rarity) of (key, tokens)."""
    return (
        rows.select(key, F.explode("tokens").alias("token")).join(counts, "token").groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("seen", "token"))).alias("ranked")).select(key, F.col("ranked.token").alias("tokens"))
    )


def similar_entries(values: DataFrame, names: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(reading, name, jaccard) of all readings and names at least so similar; both sides are (key, tokens) of distinct keys."""
    one = values.select(F.explode("tokens").alias("token")).unionByName(names.select(F.explode("tokens").alias("token")))
    counts = one.groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    left, right = _ranked(values, "reading", counts), _ranked(names, "name", counts)

    def postings(rows: DataFrame, side: str) -> DataFrame:
        return rows.select("*", F.size("tokens").alias(f"{side}_n"), F.posexplode(_prefix(F.col("tokens"), similarity)).alias(f"{side}_pos", "token")).withColumnRenamed(
            "tokens", f"{side}_tokens"
        )

    a, b = postings(left, "a"), postings(right, "b")
    t = F.lit(similarity)
    possible = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    filters = (F.col("a_n") >= t * F.col("b_n")) & (F.col("b_n") >= t * F.col("a_n")) & (possible >= F.ceil(t / (1 + t) * (F.col("a_n") + F.col("b_n")) - 1e-9))
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return (
        a.join(b, "token").where(filters).dropDuplicates(["reading", "name"])
        .withColumn("jaccard", shared / (F.col("a_n") + F.col("b_n") - shared)).where(F.col("jaccard") >= t).select("reading", "name", "jaccard")
    )


def canonical_values(values: DataFrame, entries: DataFrame) -> DataFrame:
    """(value, entry): for each distinct non-blank ``values.value`` the id of the entry meant, or ``unmatched``.

    ``entries`` is (entry, names): the id and its other names (null names are skipped). The highest similarity of letters wins, then of
    letter pairs, then the lesser id. Null and blank values are left out; empty tables give an empty result, an empty list leaves all unmatched.
    """
    distinct = values.where(F.length(F.regexp_replace("value", r"(?U)\s", "")) > 0).select("value").distinct()
    spoken = entries.select("entry", F.explode("names").alias("value"), F.lit(False).alias("code"))
    listed = spoken.unionByName(entries.select("entry", F.col("entry").alias("value"), F.lit(True).alias("code"))).where(F.col("value").isNotNull())
    wanted = cut(distinct.mapInPandas(lambda it: _with_tokens(it), "value string, reading string, tokens array<string>"))
    named = cut(
        listed.select("value").distinct().mapInPandas(lambda it: _with_tokens(it, 1), "value string, reading string, tokens array<string>")
        .join(listed, "value").groupBy("entry", F.col("reading").alias("name")).agg(F.min("tokens").alias("tokens"), F.min("code").alias("code"))
    )
    names = named.groupBy("name").agg(F.min("tokens").alias("tokens"))
    least = named.select("name", "code").distinct().mapInPandas(_least, "least double").agg(F.min("least")).first()[0]
    near = similar_entries(wanted.select("reading", "tokens").distinct(), names, least if least is not None else SIMILARITY)
    judged = near.join(named.select("name", "entry", "code"), "name").mapInPandas(_checked, "name string, reading string, jaccard double, entry string, code boolean, pairs double")
    best = (
        wanted.select("value", "reading").join(judged, "reading").groupBy("value")
        .agg(F.min(F.struct((-F.col("jaccard")).alias("j"), (-F.col("pairs")).alias("p"), "entry")).alias("best"))
    )
    return distinct.join(best, "value", "left").select("value", F.coalesce(F.col("best.entry"), F.lit(UNMATCHED)).alias("entry"))


def place_categories(poi: DataFrame, categories: DataFrame) -> DataFrame:
    """(poi_id, category_id) of every place whose category is not null, not blank and not literally an id of the list."""
    ids = categories.where(F.col("id").isNotNull()).select(F.col("id").alias("category")).distinct()
    typed = (
        poi.where(F.col("id").isNotNull() & (F.length(F.regexp_replace("category", r"(?U)\s", "")) > 0)).select("id", "category").distinct().join(ids, "category", "left_anti")
    )
    nothing = F.array().cast("array<string>")
    entries = categories.where(F.col("id").isNotNull()).select(F.col("id").alias("entry"), F.concat(F.array("label"), F.coalesce("words", nothing)).alias("names"))
    mapped = canonical_values(typed.select(F.col("category").alias("value")), entries).withColumnRenamed("value", "category")
    salted = mapped.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = typed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, ["category", "salt"]).select(F.col("id").cast("long").alias("poi_id"), F.col("entry").alias("category_id"))
