"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bytewords import ALNUM, Words, blocks, scan_words, string_buffer
from .shared import digest, small_batches, table

#: Words that a shift table looks at together.
BLOCK = 2
#: Documents are searched in stretches of so many words, all at once.
STRETCH = 512
#: Bytes of benchmark text whose tables are broadcast together; a larger benchmark is searched in parts.
PART_BYTES = 32 << 20
_R = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from eight bytes at a time."""
    out = np.zeros(len(w.start), dtype=np.uint64)
    if not len(out):
        return out
    padded = np.concatenate([w.norm, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    live, at = np.arange(len(out)), w.start.copy()
    with np.errstate(over="ignore"):
        while len(live):
            left = np.minimum(w.end[live] - at[live], 8)
            value = np.ascontiguousarray(eight[at[live]]).view("<u8").ravel()
            value &= np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left.astype(np.uint64) * np.uint64(8) & np.uint64(63))) - np.uint64(1))
            mixed = (out[live] ^ value ^ (left.astype(np.uint64) << np.uint64(56))) * _R
            out[live] = (mixed ^ (mixed >> np.uint64(29))) * _M
            at[live] += 8
            live = live[at[live] < w.end[live]]
    return out ^ (out >> np.uint64(32))


def _together(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each ``n`` consecutive words."""
    out = np.zeros(max(0, len(hashes) - n + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ hashes[i : i + len(out)]) * _R
            out ^= out >> np.uint64(31)
    return out


@dataclass
class Tables:
    """Wu-Manber tables for the test strings of one length in words.

    shift: by block hash, how far the search may go on when that block ends the window (0: a test
    string ends so); buckets: of each test string, sorted, the halves of two hashes, its suffix block's
    above and the whole string's below, so that a bucket of one frequent ending isn't gone through
    string by string; numbers: each one's string; strings: their bytes, words space-joined; items: the
    items each is from.
    """

    words: int
    block: int
    shift: np.ndarray
    buckets: np.ndarray
    numbers: np.ndarray
    strings: list[bytes]
    items: list[np.ndarray]

    @staticmethod
    def build(words: int, hashes: list[np.ndarray], strings: list[bytes], items: list[np.ndarray]) -> Tables:
        block = min(BLOCK, words)
        size = 1 << max(16, (len(strings) * words * 4).bit_length())
        shift = np.full(size, words - block + 1, dtype=np.int16)
        rows = np.array(hashes, dtype=np.uint64).reshape(len(strings), words)
        for end in range(block, words + 1):
            key = _rows_together(rows[:, end - block : end]) & np.uint64(size - 1)
            np.minimum.at(shift, key.astype(np.int64), words - end)
        found = _bucket(_rows_together(rows[:, words - block :]), _rows_together(rows))
        order = np.argsort(found, kind="stable")
        return Tables(words, block, shift, found[order], order, strings, items)


def _bucket(suffix: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return (suffix >> np.uint64(32) << np.uint64(32)) | whole >> np.uint64(32)


def _rows_together(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows.shape[1]):
            out = (out ^ rows[:, i]) * _R
            out ^= out >> np.uint64(31)
    return out


def build_tables(items: list[tuple[object, str]], window: int) -> list[Tables]:
    """Tables for every window of the items; an item shorter than a window is one string by itself."""
    texts = [str(t or "").encode() for _, t in items]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    w = scan_words(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets, ALNUM)
    hashes, norm = word_hashes(w), w.norm.tobytes()
    found: dict[int, dict[bytes, tuple[np.ndarray, set]]] = {}
    for i, n in enumerate(w.counts.tolist()):
        size, first = min(n, window), int(w.first[i])
        for at in range(first, first + n - size + 1 if n else first):
            string = norm[w.start[at] : w.end[at + size - 1]]
            found.setdefault(size, {}).setdefault(string, (hashes[at : at + size], set()))[1].add(i)
    ids = np.array([i for i, _ in items], dtype=object)
    return [Tables.build(size, [h for h, _ in of.values()], list(of), [ids[sorted(s)] for _, s in of.values()]) for size, of in sorted(found.items())]


def search(w: Words, tables: Tables, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first word, string's number) of each occurrence in the texts of ``w``, none across two texts.

    The texts' possible window ends are cut into stretches that are searched side by side, each going
    on by what the shift table allows.
    """
    n = tables.words
    counts = w.counts
    per = np.maximum(counts - n + 1, 0)
    stretches = -(-per // STRETCH)
    text = np.repeat(np.arange(len(counts)), stretches)
    if not len(text):
        return
    nth = np.arange(len(text)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    at = w.first[text] + n - 1 + nth * STRETCH
    stop = np.minimum(at + STRETCH, w.first[text + 1])
    key = _together(hashes, tables.block)
    back, mask = tables.block - 1, np.uint64(len(tables.shift) - 1)
    hits = []
    while len(at):
        ends = key[at - back]
        skip = tables.shift[(ends & mask).astype(np.int64)].astype(np.int64)
        zero = np.flatnonzero(skip == 0)
        if len(zero):
            here = _bucket(ends[zero], _rows_together(hashes[(at[zero] - n + 1)[:, None] + np.arange(n)]))
            low = np.searchsorted(tables.buckets, here, side="left")
            high = np.searchsorted(tables.buckets, here, side="right")
            some = low < high
            hits += zip((at[zero[some]] - n + 1).tolist(), low[some].tolist(), high[some].tolist(), strict=True)
        at = at + np.maximum(skip, 1)
        live = at < stop
        at, stop = at[live], stop[live]
    norm = w.norm.tobytes() if hits else b""
    for first, low, high in hits:
        here = norm[w.start[first] : w.end[first + n - 1]]
        for number in tables.numbers[low:high].tolist():
            if tables.strings[number] == here:
                yield first, number


def scan(raw: np.ndarray, offsets: np.ndarray, tables: list[Tables]) -> Iterator[tuple[int, list[tuple[int, int]], list]]:
    """For each text: number of words, hit stretches of words (begin, end; merged), items found."""
    for lo, hi in blocks(offsets):
        w = scan_words(raw, offsets[lo : hi + 1], ALNUM)
        hashes = word_hashes(w)
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set] = {}
        for t in tables:
            for first, number in search(w, t, hashes):
                text = int(w.text[first])
                at = first - int(w.first[text])
                spans.setdefault(text, []).append((at, at + t.words))
                items.setdefault(text, set()).update(t.items[number])
        for i, n in enumerate(w.counts.tolist()):
            yield n, merge(spans.get(i, [])), sorted(items.get(i, ()))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search_part(docs: DataFrame, item_kind: pa.DataType, item_type: str, tables: list[Tables]) -> tuple[DataFrame, Broadcast]:
    """What ``tables`` find in ``docs`` (id, text, mark); mark is handed on."""
    shipped = docs.sparkSession.sparkContext.broadcast(tables)
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(scan(*string_buffer(b.column(1)), shipped.value))
            n = pa.array([x[0] for x in found], pa.int64())
            spans = pa.array([[{"begin": s, "end": e} for s, e in x[1]] for x in found], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            items = pa.array([x[2] for x in found], pa.list_(item_kind))
            yield pa.record_batch([b.column(0), b.column(2), n, spans, items], names=["id", "mark", "n_words", "spans", "items"])

    schema = f"id {id_type}, mark string, n_words long, spans array<struct<begin: long, end: long>>, items array<{item_type}>"
    return docs.mapInArrow(run, schema), shipped


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Where windows of ``window`` consecutive benchmark words occur in each document.

    Returns id_col, n_words, spans (merged runs of hit words, from 0), items (found, sorted), a row for
    each row of ``docs``.  Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
    lower-cased.  An item with fewer words than a window is one string; one without words finds
    nothing, and neither does a null item_col.  A null text has no words.  Rows that repeat an id, null
    ids among them, are each searched by their own text; items that repeat an id are one item.  Other
    columns aren't read.  An empty ``docs`` gives no rows, an empty benchmark no spans.

    The benchmark's size is measured first: up to ``part_bytes`` its tables are broadcast and one scan
    of ``docs`` without a shuffle does it all.  A larger one is dealt by item into parts of about that
    size.  The driver holds one part's tables at a time, whose findings are written before the next
    part's are made; at the end rows of equal id and text, whose findings are equal, are put together.
    """
    found = _found(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, window, item_col, item_text_col, part_bytes)
    return found.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def clean(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs``, columns as they are, whose text has no window of the benchmark.

    Rows are judged by their own text, whatever their ids: of rows that repeat an id, null ids among
    them, those with a clean text stay.  A null or empty text is clean.  An empty table stays empty.
    Tasks hand on what they find clean, without a shuffle; of a benchmark in parts (as in
    ``contamination``) each searches what the one before left, which is written between them.
    """
    small_batches(docs.sparkSession)
    items, parts = _items(benchmark, item_col, item_text_col, part_bytes)
    at = docs.columns.index(text_col)
    for part in range(parts):
        shipped = docs.sparkSession.sparkContext.broadcast(_tables(items, part, parts, window))

        def run(batches: Iterator[pa.RecordBatch], shipped: Broadcast = shipped) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not spans for _, spans, _ in scan(*string_buffer(b.column(at)), shipped.value)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if parts > 1:
            docs = table(docs, "clean")
            shipped.destroy()
    return docs


def _items(benchmark: DataFrame, item_col: str, item_text_col: str, part_bytes: int) -> tuple[DataFrame, int]:
    """(item, words) of the items that can be found, and how many parts they are searched in."""
    items = benchmark.filter(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text_col).alias("words"))
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    return items, max(1, -(-size // part_bytes))


def _tables(items: DataFrame, part: int, parts: int, window: int) -> list[Tables]:
    of = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
    return build_tables([(r["item"], r["words"]) for r in of.toLocalIterator()], window)


def _found(rows: DataFrame, benchmark: DataFrame, window: int, item_col: str, item_text_col: str, part_bytes: int) -> DataFrame:
    """(id, n_words, spans, items) for each of ``rows`` (id, text)."""
    small_batches(rows.sparkSession)
    item_type = benchmark.schema[item_col].dataType
    items, parts = _items(benchmark, item_col, item_text_col, part_bytes)
    texts = rows.select("id", "text", (digest(F.col("text")) if parts > 1 else F.lit(None).cast("string")).alias("mark"))
    kind, name = to_arrow_type(item_type), item_type.simpleString()
    if parts == 1:
        return _search_part(texts, kind, name, _tables(items, 0, 1, window))[0]
    found = []
    for part in range(parts):
        hits, shipped = _search_part(texts, kind, name, _tables(items, part, parts, window))
        same = hits.groupBy("id", "mark").agg(F.count("*").alias("rows"), F.first("n_words").alias("n_words"), F.first("spans").alias("spans"), F.first("items").alias("items"))
        found.append(table(same if part == 0 else same.filter(F.size("spans") > 0), "found"))
        shipped.destroy()
    whole = reduce(DataFrame.union, found).groupBy("id", "mark").agg(
        F.max("rows").alias("rows"), F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("all"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    start = F.expr("cast(array() as array<struct<begin: bigint, end: bigint>>)")
    joined = F.aggregate("all", start, lambda got, x: F.when((F.size(got) > 0) & (x["begin"] <= F.element_at(got, -1)["end"]), F.concat(F.slice(got, 1, F.size(got) - 1), F.array(F.struct(F.element_at(got, -1)["begin"].alias("begin"), F.greatest(x["end"], F.element_at(got, -1)["end"]).alias("end"))))).otherwise(F.concat(got, F.array(x))))
    each = whole.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return each.select("id", "mark", "n_words", joined.alias("spans"), "items")
