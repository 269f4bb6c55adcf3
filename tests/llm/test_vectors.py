"""Whitening, periodic runs and packing against plain versions."""

import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarn.llm import packing, periods, whitening
from tarn.llm.queries import BYTES, ORACLES, op12_periods, op13_packing

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, id string, x int, component string, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0, "y", 1) for i, v in rows], VECTORS)


def plain_whitening(rows):
    """x in whole numbers, eigenvectors of the exact covariance, by vector."""
    kept = [(i, [math.floor(64 * float(c)) + 1000000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, dims = len(kept), len(kept[0][1])
    sums = [sum(x[k] for _, x in kept) for k in range(dims)]
    away = [[n * x[k] - sums[k] for k in range(dims)] for _, x in kept]
    cov = np.array([[sum(a[j] * a[k] for a in away) / n**3 for k in range(dims)] for j in range(dims)])
    values, axes = np.linalg.eigh(cov)
    return {i: (sum(e * e for e in a), np.array([e / n for e in a]) @ axes[:, ::-1] / np.sqrt(values[::-1])) for (i, _), a in zip(kept, away, strict=True)}, values[::-1] / values.sum(), n


def test_whitening(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(6, 6))
    rows = [(i, (rng.normal(size=6) @ mixed).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 360)]
    bad = [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 6), (403, [float("-inf")] * 6), (404, []), (405, [1.0, 2.0]), (None, rows[1][1])]
    expected, explained, n = plain_whitening([*rows, bad[-1]])
    found = whitening.whiten(vectors(spark, rows + bad).repartition(7), components=4).collect()
    assert len(found) == 4 * 361 and {r["n"] for r in found} == {n}
    signs = {}
    for r in found:
        deviation, whitened = expected[r["vec_id"]]
        k = r["component"] - 1
        assert r["deviation"] == deviation
        assert r["explained"] == pytest.approx(explained[k], rel=1e-9)
        sign = signs.setdefault(k, 1 if (whitened[k] > 0) == (r["whitened"] > 0) else -1)
        assert r["whitened"] == pytest.approx(sign * whitened[k], abs=1e-8)
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-10


def test_whitening_without_a_direction_or_rows(spark):
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)])).orderBy("vec_id", "component").collect()
    assert [r["component"] for r in flat[:3]] == [1, 2, 3]
    assert [r["whitened"] is None for r in flat[:3]] == [False, True, True] and flat[0]["identity_error"] < 1e-12
    one = whitening.whiten(vectors(spark, [(1, [3.0, 4.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0, 0.0)] * 2
    assert whitening.whiten(vectors(spark, [(1, None), (2, [None])])).collect() == []
    huge = whitening.whiten(vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])])).collect()
    assert all(r["deviation"] is None for r in huge if r["vec_id"] != 3) and len(huge) == 6


def test_moments_merge_to_those_of_all():
    rng = np.random.default_rng(1)
    x = rng.integers(10**6, 10**6 + 90, size=(1000, 5))
    held = whitening.whole_moments(x[:1])
    for lo, hi in ((1, 4), (4, 700), (700, 1000)):
        held = held.merge(whitening.whole_moments(x[lo:hi]))
    away = x - x.mean(axis=0)
    assert held.count == 1000 and held.sums.tolist() == x.sum(axis=0).tolist()
    assert np.allclose(held.scatter, away.T @ away, rtol=1e-12)


def plain_runs(w, least):
    found, n = {}, len(w)
    for q in range(1, n):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_all_periods():
    pick, total = random.Random(5), 0
    for _ in range(600):
        n, letters = pick.randint(0, 250), pick.choice([1, 2, 3, 5, 50])
        w = [pick.randrange(letters) for _ in range(n)]
        if n and pick.random() < 0.7:
            a = pick.randrange(n)
            p = pick.randint(1, max(1, (n - a) // 2))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            if pick.random() < 0.5:
                w[pick.randrange(n)] = pick.randrange(letters)
        for least in (12, 7, 20):
            expected = plain_runs(w, least)
            assert periods.runs(np.array(w, dtype=np.int64), least) == expected, (w, least)
            total += len(expected)
    assert total > 500


def test_runs_of_long_texts():
    n = 60_000
    base = np.random.default_rng(2).integers(0, 4000, n).tolist()
    for w, expected in (
        ([7] * n, [(0, n, 1)]),
        (base[:100] + [1, 2] * 20_000 + base[100:20_000], [(100, 40_000, 2)]),
        ((base[: n // 3] * 3)[: n - 5], [(0, n - 5, n // 3)]),
        (base, []),
    ):
        assert periods.runs(np.array(w, dtype=np.int64)) == expected


def test_find_runs_edges(spark):
    lines = "x y\tz\n" * 5
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a " * 12), (4, "a " * 11), (None, lines), (5, "é\x00 " * 30 + "end")]
    docs = spark.createDataFrame([(i, t, "id", 1) for i, t in rows], "doc_id long, text string, id string, runs int")
    found = {(r["doc_id"], r["n_words"]): ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periods.find_runs(docs).collect()}
    assert found == {(1, 0): ([], ""), (2, 0): ([], ""), (3, 0): ([], ""), (4, 12): ([(0, 12, 1)], "a"), (4, 11): ([], "a " * 10 + "a"), (None, 15): ([(0, 15, 3)], "x y z"), (5, 31): ([(0, 30, 1)], "é\x00 end")}
    assert periods.find_runs(docs.limit(0)).collect() == []


def test_op12_against_sql(spark):
    found = op12_periods(spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = sorted(found.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    assert rows == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES['op12_periods']})").fetchall(), key=repr)
    assert sum(r[columns.index("n_runs")] > 0 for r in rows) > 5


def check_pieces(pieces, documents, window=2048):
    """Every id in one piece, sequences gapless, full or a power of two; pieces as the query returns them."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert by_doc.keys() == documents.keys()
    for doc, own in by_doc.items():
        at, ids = 0, documents[doc]
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], dtype="<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        fill = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == fill
            fill += p["length"]
        assert fill == window or fill < window and fill & (fill - 1) == 0


def test_op13_on_the_whole_table(spark):
    model = Tokenizer.from_file(BYTES)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check_pieces(op13_packing(spark, SF).collect(), {r["doc_id"]: [*model.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in rows})


def test_pack_edges(spark):
    model = Tokenizer.from_file(BYTES)
    long = " ".join(f"word{i} été, 12's" for i in range(9000))
    texts = {1: None, 2: "", 3: long, 4: "x" * 5000, None: "null id"} | {i: "Same copy, twice." for i in range(5, 40)}
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in texts.items()], "doc_id long, text string, ids string, start int")
    documents = {i: [*model.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    for parts, most in ((1, 4096), (5, 2)):
        found = packing.pack(docs.repartition(parts), BYTES, most_open=most)
        check_pieces(found.withColumn("ids_crc32", F.crc32("ids")).collect(), documents)
    assert packing.pack(docs.limit(0), BYTES).collect() == []
    repeated = packing.pack(docs.filter("doc_id = 5").union(docs.filter("doc_id = 5")), BYTES)
    assert repeated.agg(F.sum("length")).head()[0] == 2 * len(documents[5])


def test_stretches_have_the_ids_of_the_whole(monkeypatch):
    model = Tokenizer.from_file(BYTES)
    with open(BYTES, encoding="utf-8") as f:
        tokens = packing.Tokens(f.read())
    rng = random.Random(4)
    letters = ["a", "b", "é", "The", " ", "  ", "\n", "\t", "\r\n", "1", "'s", "'", ".", "\x1c", "\xa0", "\u2003", "²", "漢", "😀", "\x00", "<|endoftext|>", "<|"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(2000)] + ["", " ", "\n\n", "x", " x", "x "]
    expected = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(packing, "AT_ONCE", 50)
    for at in (0, 0):
        for lo in range(at, len(texts), 100):
            assert [i.tolist() for i in tokens.encode(texts[lo : lo + 100])] == expected[lo : lo + 100]
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    assert [i.tolist() for i in tokens.encode(texts)] == expected and [i.tolist() for i in tokens.encode(texts[::-1])] == expected[::-1]


def test_placement_takes_the_least_sum_of_squares():
    packer, rng = packing.Packer(64, 10**6), random.Random(8)
    level = [0] * 65
    for _ in range(2000):
        s = rng.randint(1, 63)
        ways = [h for h in range(0, 65 - s) if h == 0 or level[h]]

        def after(h, s=s):
            new = level.copy()
            new[h] -= h > 0
            new[h + s] += h + s < 64
            return sum(x * x for x in new)

        h = min(ways, key=lambda h: (after(h), -h))
        level[h] -= h > 0
        level[h + s] += h + s < 64
        packer.add(0, np.zeros(s, dtype="<u4"))
        assert packer.level.tolist() == level
