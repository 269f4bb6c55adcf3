"""Removal of strings that repeat across documents, by sharded suffix arrays.

A string of ``length`` bytes starts at nearly every byte of the corpus, so the corpus is not sorted
whole.  Each start belongs to a segment, whose key is the smallest hash among the 16-byte strings in
the start's window: equal windows have equal keys, so all that can be equal meets in one shard.

1. ``frequent_keys``: keys with more segments than a part can hold are found in a bounded sample; their
   windows meet one by one by their bytes (``_frequent``), so that no task gets a whole such key.
2. ``_segments``: documents are cut into segments; one record (key, content hash, document, place)
   for each.  Where a batch has the same segment in several documents, the later ones are settled
   there and then, byte by byte, so that a passage in a third of all documents sends one record a batch.
3. ``_settle``: by key, segments whose content a smaller document has too are covered whole.  Only
   segments that share a key with a different segment of another document are left (contested).
4. ``_cut`` and ``_sort``: the contested segments' bytes meet by key; those that share no more than the
   gram with another are put aside (``_met``), and the others make shards of SHARD bytes, whose suffix
   arrays and permuted common prefixes tell which windows are equal and who had them first.
5. Covered stretches are gathered by document and cut out of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import blocks, string_buffer
from .shared import small_batches, table
from .suffixes import common_prefixes, suffix_array

#: Bytes of the strings whose smallest hash is a window's key.
GRAM = 16
#: Starts in one segment at most.
RUN = 64
#: Bytes of text whose segments go to one partition, about.
PART_BYTES = 16 << 20
#: Bytes of text hashed at once.
STEP = 192 << 10
#: Bytes in one suffix array, about; a key whose segments have more is a shard by itself.
SHARD = 512 << 10
#: Bytes of documents in which keys are looked for that would overfill a part, and how often a key is there at least.
SAMPLE, LEAST = 32 << 20, 16
_B = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]), out=out)
    return out


def _grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 8 bytes (the last ones run into zeros) and of the GRAM bytes at each place."""
    n = len(raw)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = raw
    g = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1))).view("<u8").ravel()
    with np.errstate(over="ignore"):
        g = (g ^ (g >> np.uint64(32))) * _C
        g = (g ^ (g >> np.uint64(32))) * _C
        g ^= g >> np.uint64(32)
        h = (g[: n - GRAM + 1] * _B + g[8 : n - GRAM + 9]) * _C
    return g, h ^ (h >> np.uint64(32))


def segments(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, start, size, key, content): the segments of the texts raw[offsets[i]:offsets[i+1]].

    A segment holds whole windows of ``length`` bytes; each window starts in one segment.  key and
    content are 64-bit hashes of the smallest gram and of the segment's bytes.
    """
    window = length - GRAM + 1
    found = []
    for lo, hi in blocks(offsets, STEP):
        base, top = int(offsets[lo]), int(offsets[hi])
        n = top - base
        if n < length:
            continue
        with np.errstate(over="ignore"):
            g, h = _grams(raw[base:top])
            least, span = h, 1
            while span < window:
                by = min(span, window - span)
                least = np.minimum(least[: len(least) - by], least[by:])
                span += by
            at = offsets[lo : hi + 1] - base
            starts = len(least)
            new = np.ones(starts, dtype=bool)
            new[1:] = least[1:] != least[:-1]
            new[at[:-1][at[:-1] < starts]] = True
            inside = np.zeros(starts + 1, dtype=np.int8)
            full = np.diff(at) >= length
            inside[at[:-1][full]] = 1
            # a text's windows end length - 1 bytes before it does
            inside[at[1:][full] - length + 1] -= 1
            inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
            edge = np.flatnonzero(new)
            run = np.arange(starts) - np.repeat(edge, np.diff(np.append(edge, starts)))
            first = np.flatnonzero((run % RUN == 0) & inside)
            stop = np.flatnonzero(inside & np.concatenate([(run[1:] % RUN == 0) | ~inside[1:], [True]])) + 1
            size = stop - first + length - 1
            sums = np.concatenate([[np.uint64(0)], np.cumsum(g * _powers(int(_B), n), dtype=np.uint64)])
            content = (sums[first + size - 7] - sums[first]) * _powers(pow(int(_B), -1, 1 << 64), n)[first]
            content = (content ^ (content >> np.uint64(29))) * _C + size.astype(np.uint64)
        text = np.searchsorted(at, first, side="right") - 1
        found.append((text + lo, first - at[text], size, least[first], content))
    if not found:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _by(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, distinct groups, cuts) to list rows by group."""
    order = np.argsort(groups, kind="stable")
    ranked = groups[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    return order, ranked[first], np.append(first, len(ranked))


RECORDS = "part int, settled boolean, doc array<long>, start array<int>, size array<int>, key array<int>, content array<long>"
PLACES = "part int, doc long, start int, size int, key int"
COVERED = "doc long, start int, size int"
WINDOWS = "window binary, doc long, start int, size int"


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes of ``raw`` at each place of ``a`` are those at ``b``; sizes are 8 or more."""
    same = np.ones(len(a), dtype=bool)
    if not len(a):
        return same
    eight = np.lib.stride_tricks.as_strided(raw, (max(0, len(raw) - 7), 8), (1, 1))
    live, k = np.arange(len(a)), 0
    while len(live):
        at = np.minimum(k, size[live] - 8)
        x = np.ascontiguousarray(eight[a[live] + at]).view("<u8").ravel()
        y = np.ascontiguousarray(eight[b[live] + at]).view("<u8").ravel()
        same[live[x != y]] = False
        k += 8
        live = live[(x == y) & (k < size[live])]
    return same


def _known(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    """True for strings that a smaller document of the same batch has too: found by hash, confirmed byte by byte."""
    known = np.zeros(len(doc), dtype=bool)
    if not len(doc):
        return known
    order = np.lexsort((doc, *hashes))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = np.any([h[order][1:] != h[order][:-1] for h in (*hashes, size)], axis=0)
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.flatnonzero(doc[order] > doc[first])
    known[order[later]] = _equal(raw, begin[order[later]], begin[first[later]], size[order[later]])
    return known


def frequent_keys(held: DataFrame, length: int, parts: int, volume: int, sample: int) -> np.ndarray:
    """Keys that would have more segments than a part's share of all, judged from about ``sample`` bytes of whole documents.

    The documents are chosen by a hash of their ids.  At most one key in LEAST of the sample's segments
    is found; whether a key is found changes how its segments meet, and not what is covered.
    """
    chosen = held.filter(F.pmod(F.xxhash64("doc"), F.lit(1_000_003)) < min(1.0, sample / max(1, volume)) * 1_000_003)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n = np.unique(segments(*string_buffer(b.column(1)), length)[3], return_counts=True)
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    counts = table(chosen.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") >= max(LEAST, total / parts)).select("key").collect()
    return np.sort(np.array([r["key"] for r in found], dtype=np.int64).view(np.uint64))


def _has(keys: np.ndarray, these: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are among the sorted ``these``."""
    if not len(these):
        return np.zeros(len(keys), dtype=bool)
    return these[np.minimum(np.searchsorted(these, keys), len(these) - 1)] == keys


def _windows(length: int, frequent: np.ndarray):
    """Each window of the segments with a frequent key, by its bytes; without bytes where a smaller document of the batch has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = string_buffer(b.column(1))
            text, start, size, key, _ = segments(raw, offsets, length)
            hot = _has(key, frequent)
            text, start, per = text[hot], start[hot], size[hot] - length + 1
            if not len(text):
                continue
            nth = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
            text, start = np.repeat(text, per), np.repeat(start, per) + nth
            doc, begin = _ids(b)[text], offsets[text] + start
            whole, sizes = raw.tobytes(), np.full(len(doc), length)
            strings = [whole[x : x + length] for x in begin.tolist()]
            hashes = np.fromiter((hash(s) for s in strings), dtype=np.int64, count=len(strings))
            known = _known(raw, begin, sizes, doc, hashes)
            yield pa.record_batch(
                [pa.array(strings, pa.binary(), mask=known), pa.array(doc), pa.array(start, pa.int32()), pa.array(sizes, pa.int32())],
                names=["window", "doc", "start", "size"],
            )

    return run


def _segments(length: int, parts: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = string_buffer(b.column(1))
            text, start, size, key, content = segments(raw, offsets, length)
            if len(frequent):
                rest = ~_has(key, frequent)
                text, start, size, key, content = text[rest], start[rest], size[rest], key[rest], content[rest]
            if not len(text):
                continue
            doc = _ids(b)[text]
            known = _known(raw, offsets[text] + start, size, doc, content, key)
            # records stay in the documents' order, in which ids and places compress well
            part = (key % np.uint64(parts)).astype(np.int32)
            # what is settled only passes through: its document's hash deals it out
            part[known] = (doc[known] * 0x9E3779B1 >> 7) % parts
            at, groups, cuts = _by(part.astype(np.int64) * 2 + known)
            short = (key >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.record_batch(
                [
                    pa.array(groups >> 1, pa.int32()),
                    pa.array((groups & 1) == 1),
                    _lists(doc[at], cuts, pa.int64()),
                    _lists(start[at], cuts, pa.int32()),
                    _lists(size[at], cuts, pa.int32()),
                    _lists(short[at], cuts, pa.int32()),
                    _lists(content.view(np.int64)[at], cuts, pa.int64()),
                ],
                names=["part", "settled", "doc", "start", "size", "key", "content"],
            )

    return run


def _flat(t: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy(zero_copy_only=False) for c in t.column(name).chunks)])


def _place_rows(part: int, doc: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> pa.Table:
    """A row for each place, in the order of documents."""
    order = np.argsort(doc, kind="stable")
    columns = [pa.array(np.full(len(doc), part), pa.int32()), pa.array(doc[order], pa.int64()), *(pa.array(x[order], pa.int32()) for x in (start, size, key))]
    return pa.table(columns, names=["part", "doc", "start", "size", "key"])


def _settle(t: pa.Table) -> pa.Table:
    """Places that are covered (part -1) and contested ones."""
    part = t.column("part")[0].as_py()
    here = t.filter(t.column("settled"))
    known = [_flat(here, x).astype(np.int64) for x in ("doc", "start", "size", "key")]
    here = t.filter(pa.compute.invert(t.column("settled")))
    doc, start, size, key, content = (_flat(here, x).astype(np.int64) for x in ("doc", "start", "size", "key", "content"))
    order = np.lexsort((doc, size, content, key))
    doc, start, size, key, content = doc[order], start[order], size[order], key[order], content[order]
    covered, contested = np.zeros(len(doc), dtype=bool), np.zeros(len(doc), dtype=bool)
    if len(doc):
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new = new_key | np.concatenate([[True], (content[1:] != content[:-1]) | (size[1:] != size[:-1])])
        first = np.flatnonzero(new)
        covered = doc > doc[first][np.cumsum(new) - 1]
        # of each content the documents that have it first; more than one document within a key is a contest
        keys = np.flatnonzero(new_key[first])
        low, high = np.minimum.reduceat(doc[first], keys), np.maximum.reduceat(doc[first], keys)
        contested = ~covered & (low != high)[np.cumsum(new_key) - 1]
    settled = _place_rows(-1, *(np.concatenate([a, b[covered]]) for a, b in zip(known, (doc, start, size, key), strict=True)))
    return pa.concat_tables([settled, _place_rows(part, doc[contested], start[contested], size[contested], key[contested])])


CUT = "part int, doc array<long>, start array<int>, size array<int>, key array<int>, bytes binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of contested segments, listed by part."""
    for b in batches:
        raw, offsets = string_buffer(b.column(1))
        lists = [b.column(i) for i in range(2, 6)]
        part, start, size, key = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
        of = np.repeat(np.arange(b.num_rows), lists[0].value_lengths().to_numpy(zero_copy_only=False))
        fits = start + size <= np.diff(offsets)[of]
        part, start, size, key, of = part[fits], start[fits], size[fits], key[fits], of[fits]
        doc = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[of]
        order, parts, cuts = _by(part)
        begin = (offsets[of] + start)[order]
        whole = raw.tobytes()
        pieces = [whole[s:e] for s, e in zip(begin.tolist(), (begin + size[order]).tolist(), strict=True)]
        joined = [b"".join(pieces[s:e]) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        yield pa.record_batch(
            [pa.array(parts, pa.int32()), _lists(doc[order], cuts, pa.int64()), *(_lists(x[order], cuts, pa.int32()) for x in (start, size, key)), pa.array(joined, pa.binary())],
            names=["part", "doc", "start", "size", "key", "bytes"],
        )


def had_before(raw: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, begin, end): maximal stretches of starts whose windows a smaller document has as well.

    ``raw`` holds the segments one after another, of ``size`` bytes and from document ``doc`` each.
    """
    at = np.cumsum(size + 1) - size - 1
    of = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(raw)) + of
    text = np.ones(len(raw) + len(size) + 1 + length, dtype=np.int32)
    text[place] = raw.astype(np.int32) + 2
    end = len(text) - length
    text[end - 1 :] = 0
    whole = np.zeros(end, dtype=bool)
    whole[place] = place - at[of] <= size[of] - length
    owner = np.zeros(end, dtype=np.int64)
    owner[place] = of
    sa = suffix_array(text[:end], 258)
    # windows are equal as long as no entry between them in the array shares less than their length
    run = np.concatenate([[0], np.cumsum(common_prefixes(text, sa, length) < length)])
    held = whole[sa]
    sa, run = sa[held], run[held]
    if not len(sa):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    docs = doc[owner[sa]]
    least = np.repeat(np.minimum.reduceat(docs, first), np.diff(np.append(first, len(sa))))
    late = np.sort(sa[least < docs])
    if not len(late):
        return (np.zeros(0, np.int64),) * 3
    new = np.concatenate([[True], (late[1:] != late[:-1] + 1) | (owner[late[1:]] != owner[late[:-1]])])
    begin = late[new]
    end = late[np.concatenate([new[1:], [True]])] + 1
    return owner[begin], begin - at[owner[begin]], end - at[owner[begin]]


def _met(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """False for segments that can have no window in common with another document's of their key.

    A window holds the key's gram and ``side`` bytes on its left or on its right, if not both, so equal
    windows have one of the two in common, whichever place of the gram they hold.  That is why both
    sides of every place where a segment has the gram are compared.
    """
    side = (length - GRAM) // 2
    if side < 8:
        return np.ones(len(size), dtype=bool)
    hold = np.zeros(len(size), dtype=bool)
    if not len(size):
        return hold
    with np.errstate(over="ignore"):
        g, h = _grams(raw)
        place = np.flatnonzero((h >> np.uint64(32)).astype(np.uint32).view(np.int32) == np.repeat(key.astype(np.int32), size)[: len(h)])
        of = np.searchsorted(begin, place, side="right") - 1
        inside = place + GRAM <= begin[of] + size[of]
        place, of = place[inside], of[inside]
        for left in (True, False):
            i = np.flatnonzero(place - begin[of] >= side if left else begin[of] + size[of] - place - GRAM >= side)
            if not len(i):
                continue
            edge = place[i] - side if left else place[i] + GRAM
            i = of[i]
            seen = key[i].astype(np.uint64)
            for k in [*range(0, side - 7, 8), side - 8]:
                seen = (seen ^ g[edge + k]) * _B
                seen ^= seen >> np.uint64(29)
            order = np.lexsort((doc[i], seen))
            new = np.flatnonzero(np.concatenate([[True], seen[order][1:] != seen[order][:-1]]))
            counts = np.diff(np.append(new, len(i)))
            own = doc[i][order]
            hold[i[order][np.repeat(own[new] != own[new + counts - 1], counts)]] = True
    return hold


def _sort(length: int):
    def run(t: pa.Table) -> pa.Table:
        doc, start, size, key = (_flat(t, x).astype(np.int64) for x in ("doc", "start", "size", "key"))
        raw = np.frombuffer(b"".join(t.column("bytes").to_pylist()), dtype=np.uint8)
        begin = np.cumsum(size) - size
        hold = _met(raw, begin, size, key, doc, length)
        doc, start, size, key, begin = doc[hold], start[hold], size[hold], key[hold], begin[hold]
        order = np.argsort(key, kind="stable")
        ends = np.cumsum(size[order])
        last_of_key = np.flatnonzero(np.concatenate([key[order][1:] != key[order][:-1], [True]]))
        out, lo = [], 0
        while lo < len(order):
            target = (ends[lo - 1] if lo else 0) + SHARD
            nth = np.searchsorted(ends[last_of_key], target, side="right") - 1
            hi = int(last_of_key[max(nth, np.searchsorted(last_of_key, lo))]) + 1
            own = order[lo:hi]
            pick = np.repeat(begin[own] - (np.cumsum(size[own]) - size[own]), size[own]) + np.arange(int(size[own].sum()))
            segment, low, high = had_before(raw[pick], size[own], doc[own], length)
            out.append((doc[own][segment], start[own][segment] + low, high - low + length - 1))
            lo = hi
        doc, start, size = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(size, pa.int32())], names=["doc", "start", "size"])

    return run


def _union(starts: np.ndarray, sizes: np.ndarray, top: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for i in np.argsort(starts, kind="stable").tolist():
        a, b = int(starts[i]), min(int(starts[i] + sizes[i]), top)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _frequent(held: DataFrame, length: int, frequent: np.ndarray) -> DataFrame:
    """(doc, start, size): covered windows of the segments with a frequent key.

    Such a key's windows meet one by one by their bytes, each batch having sent only the first document
    of its own; a window that very many batches have is a hot key of a plain aggregation with partial
    minima, and of a join that Spark splits.
    """
    windows = table(held.mapInArrow(_windows(length, frequent), WINDOWS), "windows")
    open_ = windows.filter("window is not null")
    least = open_.groupBy("window").agg(F.min("doc").alias("least"))
    late = open_.join(least, "window").filter("doc > least")
    return windows.filter("window is null").select("doc", "start", "size").union(late.select("doc", "start", "size"))


def repeated_spans(docs: DataFrame, *, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, start array, size array), one row for each document with bytes to remove; stretches may overlap."""
    if length < GRAM + 8:
        raise ValueError(f"length is at least {GRAM + 8}")
    spark = docs.sparkSession
    small_batches(spark)
    held = docs.filter(F.col(id_col).isNotNull() & (F.octet_length(text_col) >= length)).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    volume = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // PART_BYTES))
    frequent = frequent_keys(held, length, parts, volume, SAMPLE)
    places = table(held.mapInArrow(_segments(length, parts, frequent), RECORDS).groupBy("part").applyInArrow(_settle, PLACES), "places")
    lists = places.filter("part >= 0").groupBy("doc").agg(F.collect_list(F.struct("part", "start", "size", "key")).alias("l"))
    contested = lists.select("doc", *(F.col(f"l.{x}").alias(x) for x in ("part", "start", "size", "key")))
    cut = held.join(contested.hint("shuffle_hash"), "doc").select("doc", "text", "part", "start", "size", "key").mapInArrow(_cut, CUT)
    late = cut.groupBy("part").applyInArrow(_sort(length), COVERED)
    settled = places.filter("part < 0").select("doc", "start", "size")
    covered = table(settled.union(late).union(_frequent(held, length, frequent)) if len(frequent) else settled.union(late), "covered")
    gathered = covered.groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("l"))
    return gathered.select("doc", F.col("l.start").alias("start"), F.col("l.size").alias("size"))


def remove_repeats(docs: DataFrame, *, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts from each text all bytes of ``length``-byte strings that also start in a smaller document.

    Returns a row for each row of ``docs``: id_col, n_bytes, spans (array of begin and end in bytes,
    merged, from 0) and kept (binary, the bytes that stay).  Texts are UTF-8 bytes, a null one is
    empty; a cut may fall inside a character, which is why ``kept`` is binary.  Strings are judged on
    the texts as they come.  id_col is an integer key; a null id is never smaller than another, and
    nothing is cut from it.  Rows that repeat an id are one document if their texts are equal; if not,
    places found in any are cut from each as far as it reaches.  Other columns aren't read, whatever
    their names.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    spans = repeated_spans(docs, length=length, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = rows.join(spans.hint("shuffle_hash"), rows["id"] == spans["doc"], "left").select("id", "text", "start", "size")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = string_buffer(b.column(1))
            whole = raw.tobytes()
            spans, kept = [], []
            for i, (start, size) in enumerate(zip(*(b.column(k).to_pandas() for k in (2, 3)), strict=True)):
                lo, hi = int(offsets[i]), int(offsets[i + 1])
                found = [] if start is None else _union(np.asarray(start), np.asarray(size), hi - lo)
                spans.append([{"begin": x, "end": y} for x, y in found])
                edges = [0, *(z for span in found for z in span), hi - lo]
                kept.append(b"".join(whole[lo + x : lo + y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.record_batch(
                [b.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "spans", "kept"],
            )

    return joined.mapInArrow(run, f"id {kind}, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary").withColumnRenamed("id", id_col)
