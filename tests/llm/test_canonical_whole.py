"""The join of typed values and names drops nothing that the allowed edits accept."""

import random

from ridgeline.llm import canonical


def test_allowed_edits_are_never_filtered_out(spark):
    rng = random.Random(12)
    names = ["museum", "bakery", "station", "shelter", "fountain", "picnic place", "tap", "kiosk", "viewpoint east", "bicycle workshop", "aaaaaa", "m1 m2 m3"]

    def typo(text):
        at = rng.randrange(len(text))
        kind = rng.randrange(4)
        letter = rng.choice("abemsu ")
        return (text[:at] + letter + text[at + 1 :], text[:at] + text[at + 1 :], text[:at] + letter + text[at:], text[:at] + text[at + 1 : at + 2] + text[at] + text[at + 2 :])[kind]

    typed = {"mxseim", "east viewpint", *names}
    for name in names:
        for _ in range(25):
            typed.add(typo(typo(name)))
            typed.add(typo(" ".join(reversed(name.split()))))
    typed = sorted(t for t in typed if canonical.letters(t))
    lists = {name: n for n, name in enumerate(names)}
    poi = spark.createDataFrame(list(enumerate(typed)), "id long, category string")
    cats = spark.createDataFrame([(f"c{n:02d}zzzzzzzzzzzzzzzz", name, None) for name, n in lists.items()], "id string, label string, words array<string>")
    got = dict(map(tuple, canonical.place_categories(poi, cats).collect()))

    def accepted(value, name):
        most = canonical.allowed_edits(name)
        plain = " ".join(canonical.letters(name))
        return any(
            min(canonical.edits(r.replace(" ", ""), plain.replace(" ", ""), most), canonical.edits("".join(sorted(r.split())), "".join(sorted(plain.split())), most)) <= most
            for r in canonical.readings(value)
        )

    for i, value in enumerate(typed):
        able = {f"c{n:02d}zzzzzzzzzzzzzzzz" for name, n in lists.items() if accepted(value, name)}
        assert got[i] in (able or {"unmatched"}), value
    assert got[typed.index("mxseim")].startswith("c00")
