"""What Spark sizes too low, as after an explode, isn't broadcast, however small it looks."""

import re

import numpy as np
import pytest

from tarn.llm import shingles, simhash
from tarn.llm.shared import table


def exploded_broadcasts(df):
    """Exchanges of ``df``'s plan that broadcast what an explode made."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(re.match(r"[ :+\-]*", line)[0]) for line in lines]
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines))
            found += [line for below in lines[i:end] if "Generate" in below]
    return found


@pytest.mark.parametrize("crowded", [4096, 2])
def test_probes_of_fingerprints_are_not_broadcast(spark, monkeypatch, crowded):
    """68 probes a fingerprint were sized as one and broadcast, 17 million of them at 0.5 GB."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    prints = [int(x) for x in np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 50)]
    prints = sorted({p ^ (1 << k) ^ (1 << k // 2) for p in prints for k in range(0, 40, 5)})
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long").distinct(), 3)
    assert not exploded_broadcasts(found)
    mask = (1 << 64) - 1
    assert {tuple(r) for r in found.collect()} == {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & mask).bit_count() <= 3}
    assert not exploded_broadcasts(found)


def test_shingles_of_near_copies_are_not_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(12):
        base = list(rng.choice(words, 100))
        texts += [" ".join(base[:k] + [f"e{k}"] + base[k:]) for k in (3, 30, 50, 80)] + [" ".join(base[:70])]
    written = {}
    monkeypatch.setattr(shingles, "table", lambda df, name: written.setdefault(name, []).append(df) or table(df, name))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(docs).collect()}
    assert found == {i: i - i % 5 if i % 5 < 4 else i for i in range(len(texts))}
    assert len(written["pairs"]) == 2
    assert [n for n, dfs in written.items() for df in dfs if exploded_broadcasts(df)] == []
