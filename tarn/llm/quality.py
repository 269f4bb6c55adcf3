"""Quality classification from weak labels: heuristic labellers, their accuracies by
expectation-maximisation, and a hashed linear scorer trained on the posterior labels."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import blocks, string_buffer
from .shared import small_batches

#: Documents that the scorer is trained on, chosen by a hash of their text: the least hashes.
SAMPLE = 20_000
#: Weights of the scorer; words' outlines are hashed to them.
FEATURES = 1 << 12
#: Bytes of text looked at together.
STEP = 512 << 10
GOOD, NONE, BAD = 1, 0, -1
LABELLERS = ("symbols", "capitals", "odd_words", "word_length", "sentences", "repeats", "variety")
_SPACE, _SMALL, _CAPITAL, _DIGIT, _STOP, _OTHER = range(6)
_B = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _kinds() -> np.ndarray:
    """What each code point is: white space, small letter (or one without case), capital, digit, a sign that ends a sentence, or else."""

    def kind(c: str) -> int:
        if c in " \t\n\r\x0b\x0c":
            return _SPACE
        if c.isalpha():
            return _CAPITAL if c.isupper() else _SMALL
        return _DIGIT if c.isdigit() else _STOP if c in ".,;:?!" else _OTHER

    return np.fromiter((kind(chr(c)) for c in range(sys.maxunicode + 1)), dtype=np.int8, count=sys.maxunicode + 1)


@dataclass
class Looks:
    """Of each text: its votes, and (text, feature, count) of the outlines of its words."""

    votes: np.ndarray
    text: np.ndarray
    feature: np.ndarray
    count: np.ndarray


def _vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, NONE))


def _hashes(values: np.ndarray, first: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """A hash of each stretch of ``values`` that begins at ``first``; ``nth`` counts within stretches."""
    if not len(first):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(nth.max()), _B)]))
        out = np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * _B * powers[nth], first)
        return (out ^ (out >> np.uint64(31))) * _B >> np.uint64(8)


def look(raw: np.ndarray, offsets: np.ndarray, features: int = FEATURES) -> Looks:
    """Votes and outlines of the texts raw[offsets[i]:offsets[i+1]].

    An outline is a word with runs of small letters, of capitals and of digits made one sign each, and
    so are runs of one other sign; a word that is the same as the one before has an outline of its own.
    """
    n = len(offsets) - 1
    raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4").astype(np.int64)
    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    text = np.repeat(np.arange(n), np.diff(at))
    kinds = _kinds()[codes]
    inside = kinds != _SPACE
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (text[1:] != text[:-1])
    own = np.flatnonzero(inside)
    word = np.cumsum(begins)[own] - 1
    first = np.flatnonzero(begins[own])
    of = text[own[first]]
    words = np.bincount(of, minlength=n)
    # per text and kind of character
    by = np.bincount(text * 6 + kinds, minlength=n * 6).reshape(n, 6)
    letters, chars = by[:, _SMALL] + by[:, _CAPITAL], np.maximum(1, by[:, 1:].sum(1))
    nth = np.arange(len(own)) - first[word] if len(own) else own
    whole = _hashes(codes[own], first, nth)
    again = np.zeros(len(whole), dtype=bool)
    again[1:] = (whole[1:] == whole[:-1]) & (of[1:] == of[:-1])
    sign = np.where(kinds[own] >= _STOP, codes[own] + 8, kinds[own])
    run = np.ones(len(own), dtype=bool)
    run[1:] = (sign[1:] != sign[:-1]) | (word[1:] != word[:-1])
    runs, run_word = sign[run], word[run]
    run_first = np.flatnonzero(np.concatenate([[True], run_word[1:] != run_word[:-1]])) if len(runs) else np.zeros(0, np.int64)
    outline = _hashes(runs, run_first, np.arange(len(runs)) - run_first[run_word] if len(runs) else runs)
    bucket = np.where(again, 0, 1 + outline % np.uint64(features - 1)).astype(np.int64)
    ends_stop = np.zeros(len(first), dtype=bool)
    if len(first):
        last = np.append(first[1:], len(own)) - 1
        ends_stop = kinds[own][last] == _STOP
        known = np.add.reduceat(np.isin(kinds[own], (_SMALL, _CAPITAL, _DIGIT)).astype(np.int64), first)
        odd_word = (np.add.reduceat((kinds[own] == _OTHER).astype(np.int64), first) > 1) | (known == 0)
    else:
        odd_word = ends_stop
    per = np.maximum(words, 1)
    odd, stops, repeats = (np.bincount(of, weights=x, minlength=n) / per for x in (odd_word, ends_stop, again))
    pairs = np.sort((of.astype(np.uint64) << np.uint64(44)) ^ (whole >> np.uint64(12)))
    fresh = np.concatenate([[True], pairs[1:] != pairs[:-1]]) if len(pairs) else again
    variety = np.bincount((pairs[fresh] >> np.uint64(44)).astype(np.int64), minlength=n) / per
    symbols, capitals, length = by[:, _OTHER] / chars, by[:, _CAPITAL] / np.maximum(letters, 1), chars / per
    some = words > 0
    votes = np.stack(
        [
            _vote(symbols > 0.06, some & (symbols < 0.02)),
            _vote(capitals > 0.4, some & (letters > 0) & (capitals < 0.3)),
            _vote(odd > 0.2, some & (odd < 0.05)),
            _vote((words > 30) & (length > 14) | some & (length < 2), (length >= 2) & (length < 11)),
            _vote((words > 30) & (stops < 0.01), (stops > 0.03) & ((stops < 0.4) | (words < 12))),
            _vote((words > 5) & (repeats > 0.3), some & (repeats < 0.05)),
            _vote((words > 30) & (variety < 0.15), some & ((variety > 0.25) | (words < 30))),
        ],
        axis=1,
    )
    votes[~some] = BAD
    found, count = np.unique(of * features + bucket, return_counts=True)
    return Looks(votes, found // features, found % features, count)


def _each(raw: np.ndarray, offsets: np.ndarray, features: int) -> Iterator[tuple[int, int, Looks]]:
    for lo, hi in blocks(offsets, STEP):
        yield lo, hi, look(raw, offsets[lo : hi + 1], features)


def votes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(votes): one of GOOD, NONE and BAD from each of LABELLERS, for each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = string_buffer(b.column(0))
            for _, _, seen in _each(raw, offsets, FEATURES):
                yield pa.record_batch([pa.array(list(seen.votes.astype(np.int32)), pa.list_(pa.int32()))], names=["votes"])

    return docs.select(text_col).mapInArrow(run, "votes array<int>")


def posteriors(patterns: list[tuple[list[int], int]], rounds: int = 100) -> tuple[list[float], np.ndarray]:
    """(probability of GOOD for each vote pattern, accuracy of each labeller where it votes).

    Expectation-maximisation over how often each pattern occurs: labellers vote independently given
    the class, each with its own chances of the three votes in either class.  Begins from the share of
    good votes, so the classes keep their names; ends when no probability moves by 1e-9.
    """
    if not patterns:
        return [], np.zeros(0)
    seen = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    good = (1 + (seen == GOOD).sum(1)) / (2 + (seen != NONE).sum(1))
    for _ in range(rounds):
        weight = np.stack([n * (1 - good), n * good])
        prior = weight.sum(1) / n.sum()
        chance = np.stack([[(w[:, None] * (seen == v)).sum(0) + 0.5 for v in (BAD, NONE, GOOD)] for w in weight])
        chance /= chance.sum(1, keepdims=True)
        at = np.log(np.maximum(prior, 1e-12))[:, None] + np.stack([np.log(c[seen + 1, np.arange(seen.shape[1])]).sum(1) for c in chance])
        now = 1 / (1 + np.exp(np.clip(at[0] - at[1], -700, 700)))
        moved, good = np.abs(now - good).max(), now
        if moved < 1e-9:
            break
    right = prior[0] * chance[0][0] + prior[1] * chance[1][2]
    cast = right + prior[0] * chance[0][2] + prior[1] * chance[1][0]
    return good.tolist(), right / cast


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for lo, hi, seen in _each(raw, offsets, len(self.weights)):
            total = np.bincount(seen.text, weights=seen.count, minlength=hi - lo)
            margin = np.bincount(seen.text, weights=seen.count * self.weights[seen.feature], minlength=hi - lo)
            out[lo:hi] = np.where(total > 0, 1 / (1 + np.exp(-np.clip(self.bias + margin / np.maximum(total, 1), -700, 700))), 0.0)
        return out


def fit(rows: list[tuple[list[int], list[int], float]], features: int = FEATURES, *, rounds: int = 400, step: float = 1.0, decay: float = 1e-4) -> Scorer:
    """A logistic regression from (features, counts, probability of GOOD) of each training document.

    Adaptive gradient descent over all rows at once; a document's counts are shares of its words.
    """
    sizes = [len(f) for f, _, _ in rows]
    row = np.repeat(np.arange(len(rows)), sizes)
    at = np.concatenate([np.zeros(0, np.int64), *(np.asarray(f) for f, _, _ in rows)]).astype(np.int64)
    share = np.concatenate([np.zeros(0), *(np.asarray(c) / max(1, sum(c)) for _, c, _ in rows)])
    target = np.array([p for _, _, p in rows])
    weights, bias = np.zeros(features), 0.0
    seen, seen_bias = np.full(features, 1e-12), 1e-12
    for _ in range(rounds if rows else 0):
        guess = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weights=share * weights[at], minlength=len(rows)), -700, 700)))
        off = (guess - target) / len(rows)
        slope = np.bincount(at, weights=share * off[row], minlength=features) + decay * weights / max(1, len(rows))
        seen += slope**2
        seen_bias += off.sum() ** 2
        weights -= step * slope / np.sqrt(seen)
        bias -= step * off.sum() / np.sqrt(seen_bias)
    return Scorer(weights, bias)


def train(docs: DataFrame, *, text_col: str = "text", sample: int = SAMPLE, features: int = FEATURES) -> Scorer | None:
    """The scorer, trained on about ``sample`` documents chosen by a hash of their text, the same in every run.

    The labellers vote on all documents; the patterns of their votes are three to the number of
    labellers at most, and those are what is fitted and broadcast.  None if there are no documents.
    """
    patterns = votes(docs, text_col).groupBy("votes").count().collect()
    n = sum(r["count"] for r in patterns)
    if not n:
        return None
    good, _ = posteriors([(r["votes"], r["count"]) for r in patterns])
    p_good = {tuple(r["votes"]): p for r, p in zip(patterns, good, strict=True)}
    place = F.pmod(F.xxhash64(text_col), F.lit(1_000_003))
    chosen = docs.select(F.col(text_col), place.alias("place")).filter(F.col("place") < min(1.0, sample / n) * 1_000_003)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, seen in _each(*string_buffer(b.column(0)), features):
                cuts = pa.array(np.searchsorted(seen.text, np.arange(hi - lo + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (seen.feature, seen.count)]
                yield pa.record_batch([*lists, pa.array([p_good.get(tuple(v), 0.5) for v in seen.votes.tolist()], pa.float64()), b.column(1).slice(lo, hi - lo)], names=["feature", "count", "p_good", "place"])

    found = chosen.mapInArrow(run, "feature array<int>, count array<int>, p_good double, place long")
    rows = found.orderBy("place", "feature", "count").limit(2 * sample).collect()
    return fit([(r["feature"], r["count"], r["p_good"]) for r in rows if r["feature"]], features)


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """id_col, score (0 to 1) and kept (score of ``threshold`` or more) for each row of ``docs``.

    The scorer is trained on the same documents' weak labels; no given label is read.  A text without
    words, null among them, scores 0 and isn't kept.  Rows with equal texts score alike, whatever their
    ids; equal texts are in the training sample together or not at all, and it has twice ``sample`` rows
    at most.  Other columns aren't read.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    scorer = train(docs.select(F.col(text_col)), text_col=text_col, sample=sample)
    if scorer is None:
        return docs.select(F.col(id_col), F.lit(0.0).alias("score"), F.lit(False).alias("kept")).limit(0)
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(shipped.value.score(*string_buffer(b.column(1))))], names=["id", "score"])

    scored = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).alias("kept"))
