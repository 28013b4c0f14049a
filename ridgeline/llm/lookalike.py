"""Visually identical text with different characters.

Look-alike classes are the transitive closure, by union-find, of relations between strings and code points: width forms,
kinds of blank and hyphen, ligatures and the letters they show, letters of other scripts with the same shape, and
everything that does not show (a class with the empty string). Each class takes as representative its member that is most
frequent in the corpus; a greedy leftmost-longest multi-pattern automaton rewrites texts to representatives. Texts are decomposed
first and composed last, so that accents in either normal form meet and an accent on a look-alike letter is still that letter.

The universe of the union-find is Unicode, not the corpus: what reaches the driver is one count per code point and ligature string.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.session import cut

#: Texts of a form, or rows of a text, that one task may hold.
HOT = 10_000

# Letters of one shape, one class a line (Latin first, then Greek, Cyrillic, Armenian, Cherokee and others).
SAME_SHAPE = """
A Α А Ꭺ
B Β В Ᏼ
C С Ϲ Ꮯ
D Ꭰ
E Ε Е Ꭼ
G Ԍ Ꮐ
H Η Н Ꮋ
I Ι І Ӏ
J Ј Ꭻ Ϳ
K Κ К Ꮶ
L Ꮮ
M Μ М Ꮇ Ϻ
N Ν
O Ο О Օ
P Ρ Р Ꮲ
Q Ԛ
R Ꭱ
S Ѕ Ꮪ Տ
T Τ Т Ꭲ
U Ս
V Ѵ Ꮩ
W Ԝ Ꮃ
X Χ Х
Y Υ Ү
Z Ζ Ꮓ
a а ɑ
c с ϲ ᴄ
d ԁ
e е
g ɡ
h һ հ
i і
j ј ϳ
l ӏ
o о ο օ ᴏ
p р ρ
q ԛ
s ѕ ꜱ
u ս ᴜ
v ν ѵ ᴠ
w ԝ ᴡ
x х
y у ү
z ᴢ
Ә Ə
ә ə
Ɛ Ԑ
ɛ ԑ
Γ Г
Π П
Φ Ф
φ ф
"""
# Hyphens of one look, and strings shown by one character.
HYPHENS = "-‐‑﹣－"
SHOWN_AS = {"…": "..."}
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85  ⠀"
#: Format characters that do show (signs over or before numbers).
_VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x2065, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


class UnionFind:
    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while (up := self.parent[x]) != root:
            self.parent[x], x = root, up
        return root

    def union(self, a: str, b: str) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return [sorted(members) for members in out.values() if len(members) > 1]


def relations(code_points: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Look-alike pairs of strings that concern the given characters."""
    for line in SAME_SHAPE.strip().splitlines():
        first, *others = line.split(" ")
        for other in others:
            yield first, other
    for h in HYPHENS[1:]:
        yield HYPHENS[0], h
    for c in BLANKS:
        yield " ", c
    yield from SHOWN_AS.items()
    for c in code_points:
        point, kind = ord(c), unicodedata.category(c)
        if (kind == "Cf" and point not in _VISIBLE_FORMAT) or point in _INVISIBLE or (kind == "Cc" and c not in BLANKS):
            yield "", c
        elif kind == "Zs" and point != 0x1680:
            yield " ", c
        tag, _, rest = unicodedata.decomposition(c).partition("> ")
        if not rest:
            continue
        shown = unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in rest.split()))
        if tag in ("<wide", "<narrow"):
            yield shown, c
        elif tag == "<compat" and len(shown) > 1 and shown.isascii() and shown.isalpha() and kind[0] in "LN":
            yield shown, c


def look_alike_classes(code_points: Iterable[str]) -> list[list[str]]:
    found = UnionFind()
    for a, b in relations(code_points):
        found.union(a, b)
    return found.classes()


def rewrites(classes: list[list[str]], frequency: dict[str, int]) -> dict[str, str]:
    """Member -> representative. The most frequent member, among those not shown as several characters; nothing shows as the empty string."""
    out: dict[str, str] = {}
    for members in classes:
        if "" in members:
            best = ""
        else:
            longest = max(map(len, members))
            best = max((m for m in members if len(m) == longest), key=lambda m: (frequency.get(m, 0), [-ord(c) for c in m]))
        out |= {m: best for m in members if m != best}
    return out


class Rewriter:
    """Greedy leftmost-longest rewriting by an Aho-Corasick automaton."""

    def __init__(self, table: dict[str, str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for pattern, to in table.items():
            self.automaton.add_word(pattern, (len(pattern), to))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> str:
        """The one form of the text; blanks at its ends do not show."""
        text = unicodedata.normalize("NFD", text)
        out, at = [], 0
        for end, (length, to) in self.automaton.iter_long(text):
            out += (text[at : end + 1 - length], to)
            at = end + 1
        out.append(text[at:])
        return unicodedata.normalize("NFC", "".join(out)).strip(" ")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter[str] = Counter()
    for pdf in batches:
        for text, n in zip(pdf["text"], pdf["n"], strict=True):
            for c, k in Counter(unicodedata.normalize("NFD", text)).items():
                seen[c] += k * int(n)
    yield pd.DataFrame({"c": [ord(c) for c in seen], "n": list(seen.values())}).astype({"c": "int32", "n": "int64"})


def rewriting_table(texts: DataFrame) -> dict[str, str]:
    """The rewriting table of a corpus of (text, n): at most one count per Unicode code point comes to the driver."""
    rows = texts.mapInPandas(_count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    frequency = {chr(r["c"]): r["n"] for r in rows}
    return rewrites(look_alike_classes(sorted(frequency)), frequency)


def _rewrite(table: dict[str, str], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rewriter = Rewriter(table)
    for pdf in batches:
        yield pdf.assign(form=[rewriter(t) for t in pdf["text"]])


def one_form(texts: DataFrame) -> DataFrame:
    """(tbl, text, n, form): each distinct text of ``texts`` (tbl, text) with its count and the form all its look-alikes share.

    Null texts are left out; an empty text, or one in which nothing shows, has the empty form. An empty table gives an empty result.
    """
    distinct = texts.where(F.col("text").isNotNull()).groupBy("tbl", "text").agg(F.count(F.lit(1)).alias("n"))
    table = rewriting_table(distinct.select("text", "n"))
    return distinct.mapInPandas(lambda it: _rewrite(table, it), "tbl string, text string, n long, form string")


def look_alike_forms(known: DataFrame) -> DataFrame:
    """(tbl, form, text, n, texts): the texts of every form that several texts of a table share, with their number of rows and of texts."""
    forms = cut(one_form(known.select("tbl", "text")))
    several = forms.groupBy("tbl", "form").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    return forms.join(several, ["tbl", "form"]).select("tbl", "form", "text", "n", "texts")


def confusable_classes(records: DataFrame) -> DataFrame:
    """(tbl, form, texts, records): the classes of look-alike texts, one row each whatever their size."""
    known = records.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select("tbl", "id", "text").distinct()
    return look_alike_forms(known).groupBy("tbl", "form").agg(F.max("texts").alias("texts"), F.sum("n").alias("records"))


def confusable_pairs(records: DataFrame, hot: int = HOT) -> DataFrame:
    """(tbl, a_id, b_id), a_id < b_id: records (tbl, id, text) whose texts are different strings of one form.

    Equal strings are no case, repeated records give one. Pairs are made between the distinct texts of a form, those of a form with more than
    ``hot`` texts in blocks that meet once, and only then spread to the records; the records of a text that more than ``hot`` hold are salted.
    """
    known = records.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select("tbl", "id", "text").distinct()
    blocks = F.ceil(F.col("texts") / hot).cast("int")
    variants = cut(look_alike_forms(known)).withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("text"), blocks).cast("int")})
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = variants.select("tbl", "form", F.col("text").alias("a_text"), F.col("n").alias("a_n"), F.col("own").alias("one"), every.alias("other"))
    b = variants.select("tbl", "form", F.col("text").alias("b_text"), F.col("n").alias("b_n"), every.alias("one"), F.col("own").alias("other"))
    both = a.join(b, ["tbl", "form", "one", "other"]).where("a_text < b_text").select("tbl", "a_text", "a_n", "b_text", "b_n")
    # at most one text in ``hot`` rows is held by so many
    often = variants.where(F.col("n") > hot).select("tbl", "text", F.ceil(F.col("n") / hot).cast("int").alias("salts"))
    if often.head(1):
        holders = known.join(often, ["tbl", "text"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    else:
        holders = known.withColumn("salt", F.lit(0))
    for side in ("a", "b"):
        salts = F.explode(F.sequence(F.lit(0), F.ceil(F.col(f"{side}_n") / hot).cast("int") - 1))
        held = holders.select("tbl", F.col("text").alias(f"{side}_text"), F.col("id").alias(side), "salt")
        both = both.withColumn("salt", salts).join(held, ["tbl", f"{side}_text", "salt"]).drop("salt")
    return both.where("a <> b").select("tbl", F.least("a", "b").alias("a_id"), F.greatest("a", "b").alias("b_id")).distinct()


def named_records(routes: DataFrame, poi: DataFrame) -> DataFrame:
    """(tbl, id, text) of route names and place names."""
    return routes.select(F.lit("library_routes").alias("tbl"), F.col("id").cast("long").alias("id"), F.col("name").alias("text")).unionByName(
        poi.select(F.lit("poi").alias("tbl"), F.col("id").cast("long").alias("id"), F.col("name").alias("text"))
    )
