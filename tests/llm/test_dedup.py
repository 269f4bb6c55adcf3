"""Suffix arrays, repeats, lines, exact and near duplicates against plain versions."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import exact_dedup, line_dedup, repeats, simhash, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, id string, part int, start int, spans int"


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, "x", 1, 2, 3) for i, t, s in rows], SCHEMA)


PASSAGE = "the quick brown fox jumps over the lazy dog and then it sleeps until noon "
TEXTS = [
    (5, "alpha " + PASSAGE + "omega", "a"),
    (2, PASSAGE * 3, "b"),
    (9, "x" * 400, "a"),
    (3, "y" + "x" * 100, "c"),
    (7, None, "a"),
    (8, "", None),
    (11, "alpha " + PASSAGE + "omega", "d"),
    (12, "ñandú " * 30, "d"),
    (13, "ñandú " * 11 + "fin", None),
    (None, "alpha " + PASSAGE + "omega", "d"),
]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.booleans())
def test_suffix_array(symbols, by_buckets):
    text = np.array([*symbols, 0], dtype=np.int32)
    expected = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    small, suffixes.SMALL = suffixes.SMALL, 512 if by_buckets else 0
    try:
        assert suffixes.suffix_array(text).tolist() == expected
    finally:
        suffixes.SMALL = small


def plain_repeats(rows, n=50):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - n + 1):
            if i is not None:
                first[raw[p : p + n]] = min(i, first.get(raw[p : p + n], i))
    out = {}
    for i, t in rows:
        raw, gone = (t or "").encode(), set()
        for p in range(len(raw) - n + 1):
            if i is not None and first[raw[p : p + n]] < i:
                gone |= set(range(p, p + n))
        out[i] = bytes(b for p, b in enumerate(raw) if p not in gone)
    return out


def test_repeats_match_a_plain_search(spark):
    rows = [(i, t) for i, t, _ in TEXTS]
    found = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(frame(spark, TEXTS)).collect()}
    assert found == plain_repeats(rows)


def test_repeats_where_a_phrase_is_twice_in_a_window(spark):
    """Pairs with a stretch of 50 to 54 bytes in common, which has a phrase of 20 to 24 bytes twice, among other text."""
    rng = np.random.default_rng(11)

    def other(n):
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))

    rows = []
    for i in range(400):
        phrase, gap = other(20 + i % 5), other(i % 3)
        twice = phrase + gap + phrase
        left = int(rng.integers(0, 51 - len(twice))) if len(twice) < 50 else 0
        shared = other(left) + twice + other(max(0, 50 + i % 5 - left - len(twice)))
        # phrases of the first and the second document's own before and after the stretch
        rows += [(2 * i, other(30) + phrase + shared + other(40)), (2 * i + 1, other(40) + shared + (phrase if i % 2 else "") + other(30))]
    found = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert found == plain_repeats(rows)


def test_repeats_over_many_random_documents(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("ab c"), 300)) for _ in range(8)]
    rows = []
    for i in range(120):
        t = base[i % 8]
        at = int(rng.integers(0, 250))
        rows.append((i, t[:at] + str(i) + t[at + 3 :] if i % 3 else t[at:] + base[(i + 1) % 8]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(docs).collect()}
    assert found == plain_repeats(rows)


def test_repeats_of_an_empty_table(spark):
    assert repeats.remove_repeats(frame(spark, [])).collect() == []


def test_lines_spread_over_sites(spark):
    rows = [(i, f"shared\nown {i}\nshared\n\n" + ("wide" if i % 2 else "narrow"), f"s{i % 12}") for i in range(40)]
    rows += [(100, None, "s1"), (101, "", None), (102, "shared\nonly", None), (102, "shared\nonly", None)]
    found = line_dedup.remove_spread_lines(frame(spark, rows), min_sites=7)
    sites = {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            sites.setdefault(x, set()).update({s} - {None})
    expected = sorted((i, "\n".join(x for x in (t or "").split("\n") if not x.strip(" ") or len(sites[x]) < 7)) for i, t, _ in rows)
    assert sorted((r["doc_id"], r["kept"]) for r in found.collect()) == expected
    assert line_dedup.remove_spread_lines(frame(spark, [])).collect() == []


def test_exact_groups(spark):
    rows = [(4, "a  b", "s"), (1, "a\tb", "s"), (3, "a b", "s"), (6, None, "s"), (5, "", "s"), (7, "ab", "s"), (None, "a b", "s"), (7, "ab", "s")]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    found = exact_dedup.report(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        alike = [(i, t) for i, t, _ in rows if hashlib.sha256(norm(t).encode()).hexdigest() == r["text_sha256"]]
        assert r["group_size"] == len(alike)
        keep = min(i for i, _ in alike if i is not None)
        assert r["keep_id"] == keep and r["kept"] == (r["doc_id"] == keep)
    kept = exact_dedup.deduplicate(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [1, 5, 7, 7]
    two = frame(spark, [(3, "same text", "s"), (5, "own text", "s"), (5, "same text", "s"), (None, "same  text", "s"), (None, "lone", "s"), (None, "lone", "s")])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in exact_dedup.deduplicate(two).collect()) == [(0, "lone"), (0, "lone"), (3, "same text"), (5, "own text")]
    long = "word " * 400_000
    assert exact_dedup.report(frame(spark, [(1, long, "s"), (2, long + " ", "s"), (3, long + "x", "s")])).filter("kept").count() == 2
    assert exact_dedup.report(frame(spark, [])).collect() == []


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def plain_components(prints):
    parent = {i: i for i in prints}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for x in ids:
        for y in ids:
            if x < y and (prints[x] ^ prints[y]).bit_count() <= 3:
                a, b = sorted((top(x), top(y)))
                parent[b] = a
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("crowded", [4096, 2])
def test_near_duplicates(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        base = list(rng.choice(words, 120))
        for k in range(3):
            text = list(base)
            text[int(rng.integers(0, 120))] = f"e{k}"
            rows.append((i * 3 + k, " ".join(text), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, "One", "s"), (503, "one", "s")]
    found = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    prints = {i: plain_simhash(t) for i, t, _ in rows}
    assert {i: f for i, (f, _) in found.items()} == prints
    assert {i: c for i, (_, c) in found.items()} == plain_components(prints)
    kept = {r["doc_id"] for r in simhash.deduplicate(frame(spark, rows)).collect()}
    assert kept == set(plain_components(prints).values())
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    own, same = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    two = frame(spark, [(3, same, "s"), (5, own, "s"), (5, same, "s"), (None, same, "s"), (None, "lone words here", "s"), (7, "long " * 300_000, "s")])
    assert sorted((r["doc_id"] or 0, r["text"][:4]) for r in simhash.deduplicate(two).collect()) == [(0, "lone"), (3, same[:4]), (5, own[:4]), (7, "long")]


def test_every_link_within_the_distance_is_found(spark):
    rng = np.random.default_rng(9)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 60, dtype=np.uint64)]
    for p in list(prints):
        for k in range(1, 5):
            for b in rng.choice(64, k, replace=False):
                p ^= 1 << int(b)
            prints.append(p)
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    found = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 3).collect()}
    mask = (1 << 64) - 1
    assert found == {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & mask).bit_count() <= 3}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=200), st.integers(1, 60), st.integers(1, 9))
def test_common_prefixes(symbols, cap, chain):
    text = np.array([*symbols, 0], dtype=np.int32)
    sa = suffixes.suffix_array(text)
    before, suffixes.CHAIN = suffixes.CHAIN, chain
    try:
        found = suffixes.common_prefixes(np.concatenate([text, np.zeros(cap, np.int32)]), sa, cap)
    finally:
        suffixes.CHAIN = before
    share = lambda a, b: next(k for k in range(cap + 1) if k == cap or text[a + k] != text[b + k])
    assert found.tolist() == [share(a, b) for a, b in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True)]


def test_repeats_with_frequent_keys(spark, monkeypatch):
    """One passage in a third of all documents and more, each time among other text, and parts so small that its keys overfill them."""
    monkeypatch.setattr(repeats, "PART_BYTES", 600)
    monkeypatch.setattr(repeats, "LEAST", 4)
    rng = np.random.default_rng(8)

    def other(n):
        return "".join(rng.choice(list("abcdefghijklmnop "), n))

    menu = "home | news | sport | weather | about us | contact | terms of use | imprint"
    rows = [(i, other(60) + (menu[i % 7 :] if i % 3 else menu[: 60 + i % 9] * 2) + other(40)) for i in range(150)]
    rows += [(None, menu), (3, menu), (3, menu), (200, None), (201, "")]
    held = spark.createDataFrame([r for r in rows if r[0] is not None and r[1]], "doc long, text string")
    volume = sum(len(t or "") for _, t in rows)
    assert len(repeats.frequent_keys(held, 50, volume // 600, volume, 1 << 20)) > 3
    found = {}
    for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        found.setdefault(r["doc_id"], []).append(bytes(r["kept"]))
    expected = plain_repeats(rows)
    assert {i: kept for i, kept in found.items() if i != 3} == {i: [kept] for i, kept in expected.items() if i != 3}
    assert len(found[3]) == 3
