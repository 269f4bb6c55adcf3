"""Periodic runs of words: aligned blocks searched by an Aho-Corasick automaton seed exact extensions.

A run is a stretch of words with smallest period q, at least ``least`` words and two periods long, that
no neighbouring word extends.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
#: Texts turned into rows at once, in bytes.
CHUNK = 4 << 20
#: Symbols of a key.  Longer blocks are spelled in names of stretches, so that an automaton stays shallow:
#: on repetitive text each step of a search may follow as many links as it is deep.
DEPTH = 16
#: Pairs of a block and a place that are held at once, about.
MOST_SEEDS = 1 << 20


def word_ids(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` and a number for each that equal words share."""
    words = text.split()
    numbers: dict[bytes, int] = {}
    return words, np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)


def repeats_words(ids: np.ndarray, k: int) -> bool:
    """False only if no k words stand twice in the text."""
    if len(ids) <= k:
        return False
    h = np.zeros(len(ids) - k + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - k + 1 + i].astype(np.uint64) + np.uint64(1)
    h.sort()
    return bool((h[1:] == h[:-1]).any())


class _Search:
    """Runs of one text.

    A run of period q repeats a stretch of at least max(least - q, q) words q further on.  Any stretch of
    2b - 1 words holds a whole block of b words that begins at a multiple of b.  So a scale b, a power of
    two, is for the periods whose shortest stretch has 2b - 1 to 4b - 2 words: such a run holds an aligned
    block that occurs again at the distance q, and reading on both ways from there finds all of it.
    """

    def __init__(self, ids: np.ndarray, least: int):
        self.ids, self.n, self.least = ids, len(ids), least
        self.found: dict[tuple[int, int], int] = {}
        #: for each place the furthest end of the runs that began there or before, and that run's period
        self.end = np.zeros(self.n, dtype=np.int64)
        self.period = np.ones(self.n, dtype=np.int64)

    def _agree(self, i: int, d: int, step: int) -> int:
        """How many places from i on, to the right (1) or left (-1), have the same word d further on."""
        ids, total, size = self.ids, 0, 16
        while True:
            room = min(size, self.n - d - i if step > 0 else i + 1)
            if room <= 0:
                return total
            lo = i if step > 0 else i - room + 1
            differs = ids[lo : lo + room] != ids[lo + d : lo + d + room]
            if differs.any():
                return total + int(np.argmax(differs if step > 0 else differs[::-1]))
            total, i, size = total + room, i + step * room, 2 * size

    def _extend(self, at: int, d: int) -> int:
        """Reads on from a place that recurs d further on; notes the run, if it is one.  Its stretch's end."""
        begin = at - self._agree(at - 1, d, -1)
        stop = at + self._agree(at, d, 1)
        end = stop + d
        if end - begin >= max(self.least, 2 * d):
            # a period that isn't the smallest spans the same words as the smallest does
            if d < self.found.get((begin, end), self.n):
                self.found[begin, end] = d
                ends, periods = self.end[begin:end], self.period[begin:end]
                better = (ends < end) | (ends == end) & (periods > d)
                ends[better], periods[better] = end, d
        return stop

    def _distances(self, b: int) -> list[tuple[int, int]]:
        """Ranges of the periods whose shortest stretch has 2b - 1 to 4b - 2 words."""
        short = [(q, q) for q in range(1, self.least) if 2 * b - 1 <= max(self.least - q, q) <= 4 * b - 2]
        lo, hi = max(self.least, 2 * b - 1), 4 * b - 2
        return short + [(lo, hi)] * (lo <= hi)

    def run(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run, by start, then period."""
        ids, n = self.ids, self.n
        last = np.zeros(int(ids.max(initial=-1)) + 1, dtype=np.int64)
        last[ids] = np.arange(n)
        again = last[ids] > np.arange(n)  # of blocks of one word: stands again further on
        b, unit, names = 1, 1, ids
        while 2 * b <= n and again.any():
            b *= 2
            m = n // b
            halves = again[: 2 * m].reshape(m, 2).all(axis=1)  # a block recurs only where both its halves do
            again = np.zeros(m, dtype=bool)
            blocks = np.flatnonzero(halves)
            if len(blocks):
                while DEPTH * unit < b:  # equal stretches of twice the length get equal names
                    names = np.unique(names[:-unit] * self.n + names[unit:], return_inverse=True)[1]
                    unit *= 2
                self._scale(b, unit, names, blocks, again)
        return sorted(((s, e - s, q) for (s, e), q in self.found.items()), key=lambda r: (r[0], r[2]))

    def _scale(self, b: int, unit: int, names: np.ndarray, blocks: np.ndarray, again: np.ndarray) -> None:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        at, kinds = blocks * b, np.zeros(len(blocks), dtype=np.int64)
        for i, key in enumerate(map(tuple, names[at[:, None] + np.arange(0, b, unit)].tolist())):
            kinds[i] = kind = automaton.get(key, i)
            if kind == i:
                automaton.add_word(key, i)
        automaton.make_automaton()
        wide, depth, found = self.n + 4 * b, b // unit, []
        for shift in range(unit):
            hits = np.array(list(automaton.iter(tuple(names[shift::unit].tolist()))), dtype=np.int64).reshape(-1, 2)
            found.append(hits[:, 1] * wide + (hits[:, 0] - depth + 1) * unit + shift)
        # occurrences by block, then place, as one sorted array
        places = np.sort(np.concatenate(found))
        own = kinds * wide + at
        follows = np.append(places, -1)[np.searchsorted(places, own) + 1]
        again[blocks] = follows // wide == kinds
        seeds = [np.zeros((0, 2), dtype=np.int64)]
        for lo, hi in self._distances(b):
            first, stop = np.searchsorted(places, own + lo), np.searchsorted(places, own + hi, side="right")
            for few in np.array_split(np.arange(len(own)), 1 + int((stop - first).sum()) // MOST_SEEDS):
                counts = stop[few] - first[few]
                begin = np.repeat(at[few], counts)
                met = places[np.arange(counts.sum()) + np.repeat(first[few] - np.cumsum(counts) + counts, counts)]
                seeds.append(self._new(begin, met - np.repeat(own[few], counts), b))
        pairs = np.concatenate(seeds)
        read: dict[int, int] = {}
        for begin, d in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist():
            if read.get(d, 0) <= begin and len(self._new(np.array([begin]), np.array([d]), b)):
                read[d] = self._extend(begin, d)

    def _new(self, at: np.ndarray, d: np.ndarray, b: int) -> np.ndarray:
        """(place, distance) of those that don't lie in a known run of whose period the distance is a multiple: they lead to that run again."""
        p = self.period[at]
        new = (self.end[at] < at + d + b) | (d <= p) | (d % p > 0)
        return np.stack([at[new], d[new]], axis=1)


def runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a sequence of numbers, by start, then period."""
    # the shortest stretch that any run repeats has least/2 words
    return _Search(ids, least).run() if repeats_words(ids, -(-least // 2)) else []


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """True for words that stay: all but those after the first period of a run that they are in."""
    cover = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in found:
        cover[start + period] += 1
        cover[start + length] -= 1
    return np.cumsum(cover[:-1]) == 0


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id_col, n_words, runs, collapsed): a row for each row.

    ``runs`` has (start, length, period) of every run of the whole text, by start, then period, counted in
    words; ``collapsed`` is the text without the repetitions, words joined by one space.  A null or empty
    text has no words, no runs and an empty collapsed text.  Null and repeated ids are rows like any other;
    other columns aren't read.  A text is searched by itself, in one task, with memory in proportion to it.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, size, out = 0, 0, ([], [], [])
            for i, text in enumerate(b.column(1)):
                words, ids = word_ids(text.as_py() or b"")
                found = runs(ids, least)
                stay = kept(len(ids), found).tolist() if found else None
                out[0].append(len(ids))
                out[1].append([{"start": s, "length": n, "period": q} for s, n, q in found])
                out[2].append(b" ".join([w for w, k in zip(words, stay, strict=True) if k] if stay else words).decode("utf-8", "replace"))
                size += len(out[2][-1])
                if size > CHUNK or i + 1 == b.num_rows:
                    yield pa.record_batch([b.column(0).slice(lo, i + 1 - lo), pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(span)), pa.array(out[2], pa.string())], names=["id", "n_words", "runs", "collapsed"])
                    lo, size, out = i + 1, 0, ([], [], [])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("id", id_col)
