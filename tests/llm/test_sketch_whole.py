"""The counts that order the cells of lines are of all lines."""

import sys
from pathlib import Path

import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from ridgeline.llm import neardup as N  # noqa: E402


def test_sketch_counts_every_line():
    rng = np.random.default_rng(4)
    lat, lon = (list(v0 + np.cumsum(rng.normal(0, 0.01, (50, 12)), axis=1)) for v0 in (51.0, 4.0))
    pdf = pd.DataFrame({"id": np.arange(1, 51), "lat": lat, "lon": lon})
    want = np.zeros(N.SKETCH, dtype=np.int64)
    for la, lo in zip(lat, lon, strict=True):
        _, token, _ = N._Lines([la], [lo]).samples()
        want += np.bincount((np.unique(token) % np.uint64(N.SKETCH)).astype(np.int64), minlength=N.SKETCH)
    (got,) = N._sketch(iter([pdf.iloc[:20], pdf.iloc[20:]]))
    assert dict(zip(got["bucket"], got["n"], strict=True)) == {b: n for b, n in enumerate(want.tolist()) if n}
