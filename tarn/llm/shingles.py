"""Near-duplicate documents by the exact Jaccard similarity of their word shingles.

Candidates come from two sides: SimHash fingerprints of the shingles, linked by ``simhash.links``, and,
because a similarity of 0.8 leaves some ten of 64 bits different, min-wise keys.  Both only propose; a
pair is linked by its whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import NOT_SPACE, blocks, scan_words, string_buffer
from .components import components
from .shared import digest, small_batches, table, without_rows
from .simhash import links, majority

#: Keys of a document, each made of ROWS minima: a pair of similarity 0.8 has no key in common in 3 of a million cases.
BANDS, ROWS = 24, 4
#: A pair is linked from OVER / UNDER on.
OVER, UNDER = 4, 5
#: Of the 96 minima's two last bits so many agree in a pair that is compared.  At a similarity of 0.8 each
#: agrees with a chance of 0.85: 65 is 4.7 standard deviations below what is expected, which one pair in 400,000 is.
AGREE = 65
#: Bits in which fingerprints of candidates differ at most.
DISTANCE = 3
#: Longs of parity bits of a set.
PARITY = 8
_MIX = np.random.default_rng(42).integers(0, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, cuts) for each block of texts: the distinct shingles' 64-bit hashes, sorted in each text.

    Words are those of ``simhash.fingerprints``; a text of fewer than ``words`` is one shingle.
    """
    digest = xxhash.xxh64_intdigest
    for lo, hi in blocks(offsets):
        w = scan_words(raw, offsets[lo : hi + 1], NOT_SPACE)
        n = w.counts
        shingles = np.maximum(n - words + 1, np.minimum(n, 1))
        text = np.repeat(np.arange(hi - lo), shingles)
        begin = np.arange(len(text)) - (np.cumsum(shingles) - shingles)[text] + w.first[text]
        last = np.minimum(begin + words - 1, w.first[text + 1] - 1)
        norm = w.norm.tobytes()
        hashes = np.fromiter((digest(norm[s:e]) for s, e in zip(w.start[begin].tolist(), w.end[last].tolist(), strict=True)), dtype=np.uint64, count=len(begin))
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        yield hashes[new], np.searchsorted(text[new], np.arange(hi - lo + 1))


def marks(hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sketches): BANDS hashes of ROWS minima each, and three longs of all minima's two last bits; zero for an empty set."""
    out = np.zeros((len(cuts) - 1, BANDS), dtype=np.uint64)
    sketch = np.zeros((len(cuts) - 1, 3), dtype=np.uint64)
    full = np.flatnonzero(np.diff(cuts))
    if not len(full):
        return out, sketch
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(full), band + 1, dtype=np.uint64)
            for row in range(ROWS):
                nth = band * ROWS + row
                a, b = _MIX[nth]
                least = np.minimum.reduceat((hashes ^ a) * b, cuts[full])
                key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
                sketch[full, nth // 32] |= ((least >> np.uint64(20)) & np.uint64(3)) << np.uint64(2 * (nth % 32))
            out[full, band] = key
    return out, sketch


def parities(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """PARITY longs for each set: of each of 64 * PARITY buckets of hashes, whether it holds an odd number.

    A bucket whose parity differs between two sets holds a hash that one of them lacks, so they differ
    in no fewer hashes than their parities do in bits.
    """
    bits = 64 * PARITY
    text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    odd = np.bincount(text * bits + (hashes >> np.uint64(32)).astype(np.int64) % bits, minlength=(len(cuts) - 1) * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, PARITY)


_SKETCH = [f"s{k}" for k in range(3)]
_PARITY = [f"p{k}" for k in range(PARITY)]


def _marked(docs: DataFrame, words: int) -> DataFrame:
    """(id, mark, n, whole, fp, keys, sketch, parities) of ``docs`` (id, text, mark): size and hash of the set of shingles, its fingerprint, keys, and longs s0.. and p0.. ."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            for hashes, cuts in shingle_sets(*string_buffer(b.column(1)), words):
                whole = [xxhash.xxh128_hexdigest(hashes[s:e].tobytes()) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                keys, sketch = marks(hashes, cuts)
                flat = pa.array(keys.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1) * BANDS, pa.int32()), flat)
                own = [b.column(k).slice(lo, len(whole)) for k in (0, 2)]
                columns = [*own, pa.array(np.diff(cuts), pa.int64()), pa.array(whole, pa.string()), pa.array(majority(hashes, cuts).view(np.int64)), lists, *(pa.array(sketch[:, k].view(np.int64)) for k in range(3)), *(pa.array(x) for x in parities(hashes, cuts).T)]
                yield pa.record_batch(columns, names=["id", "mark", "n", "whole", "fp", "keys", *_SKETCH, *_PARITY])
                lo += len(whole)

    longs = ", ".join(f"{x} long" for x in [*_SKETCH, *_PARITY])
    return docs.mapInArrow(run, f"id {kind}, mark string, n long, whole string, fp long, keys array<long>, {longs}")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(cid, shingles) of ``docs`` (cid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            for hashes, cuts in shingle_sets(*string_buffer(b.column(1)), words):
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.record_batch([b.column(0).slice(lo, len(lists)), lists], names=["cid", "shingles"])
                lo += len(lists)

    return docs.mapInArrow(run, "cid long, shingles array<long>")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ``sets``' (cid, shingles) Jaccard similarity is OVER / UNDER or more."""
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")
    return both.filter((OVER + UNDER) * F.size(F.array_intersect("x", "y")) >= OVER * (F.size("x") + F.size("y"))).select("a", "b")


def _rare_in_common(sets: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``known`` (cid, component, c) in different components that can be alike, all of them.

    Prefix filtering: with the shingles of each set ordered by how many of the sets have them, rarest
    first, two sets that are 0.8 alike have one in common among the first 2/10 of the larger and the
    first 1/9 of the smaller.  Copies that each changed more than that have only shingles of their own
    there and don't meet, so a large group of them makes no pairs.
    """
    each = sets.join(known.select("cid"), "cid", "left_semi").select("cid", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("cid").orderBy("df", "shingle"))
    # a row a shingle is sized as a row a set, so neither side may be broadcast
    ranked = each.hint("merge").join(often, "shingle").withColumn("place", place).filter(F.col("df") > 1)
    # sets of n and m <= n shingles have at least 4 / 9 * (n + m) in common, which is 8 / 9 * m or more and 4 / 5 * n
    larger = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * OVER / UNDER) + 1)
    smaller = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * (2 * OVER) / (OVER + UNDER)) + 1)
    left, right = (rows.select("shingle", "cid", "place").join(known, "cid").select("shingle", "place", F.col("c").alias(x), F.col("component").alias(f"c_{x}")) for rows, x in ((larger, "x"), (smaller, "y")))
    left, right = left.withColumnRenamed("place", "px"), right.withColumnRenamed("place", "py").withColumnRenamed("shingle", "same")
    # the first shingle in common and what follows it in both have to be enough
    enough = (F.least(F.col("x.n") - F.col("px"), F.col("y.n") - F.col("py")) + 1) * (OVER + UNDER) >= (F.col("x.n") + F.col("y.n")) * OVER
    met = left.join(right, (F.col("shingle") == F.col("same")) & (F.col("x.n") >= F.col("y.n")) & (F.col("c_x") != F.col("c_y")) & enough & _could("x", "y"))
    return met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


def _could(x: str, y: str) -> Column:
    """Whether the sizes, parities and sketches of the classes in columns ``x`` and ``y`` allow the similarity.

    Sets are 0.8 alike exactly if they differ in a ninth of both sizes' sum or fewer, so parities lose no link.
    """
    fits = (F.col(f"{x}.n") * UNDER >= F.col(f"{y}.n") * OVER) & (F.col(f"{y}.n") * UNDER >= F.col(f"{x}.n") * OVER)
    odds = sum(F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in _PARITY)
    fits &= odds * (OVER + UNDER) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (UNDER - OVER)
    odd = F.lit(0x5555555555555555)
    differ = [F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}")) for k in range(3)]
    apart = sum(F.bit_count((d.bitwiseOR(F.shiftrightunsigned(d, 1))).bitwiseAND(odd)) for d in differ)
    return fits & (apart <= BANDS * ROWS - AGREE)


def _named(links: DataFrame, like: DataFrame) -> DataFrame:
    """(cid, component) of the classes that ``links`` (a, b) join."""
    return like.select("cid", F.col("cid").alias("component")).limit(0) if links.isEmpty() else components(links).select(F.col("node").alias("cid"), "component")


def _joined(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, mark, component_id) for each row of ``docs``."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), digest(F.col(text_col)).alias("mark"))
    marked = table(_marked(texts, words), "marked")
    grouped = marked.groupBy("whole", "n").agg(F.min("id").alias("least"), *(F.first(x).alias(x) for x in ("mark", "fp", "keys", *_SKETCH, *_PARITY)))
    classes = table(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    full = classes.filter("n > 0")
    known = full.select("cid", F.struct("cid", "n", *_SKETCH, *_PARITY).alias("c"))
    def with_classes(pairs: DataFrame) -> DataFrame:
        return pairs.join(known.withColumnRenamed("c", "x").withColumnRenamed("cid", "a"), "a").join(known.withColumnRenamed("c", "y").withColumnRenamed("cid", "b"), "b")

    def pair(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    # equal fingerprints are one more key; fingerprints a few bits apart link their keys' chosen classes
    keys = F.explode(F.concat("keys", F.array("fp"))).alias("key")
    index = table(full.select("cid", keys), "index")
    chosen = table(index.groupBy("key").agg(F.count("*").alias("members"), F.min_by("cid", F.xxhash64("cid", "key")).alias("other")), "chosen")
    shared = chosen.filter("members > 1").select("key", "other")
    near = links(full.select("fp").distinct(), DISTANCE)
    head = lambda x: chosen.select(F.col("key").alias(x), F.col("other").alias(f"{x}_head"))
    met = index.join(shared, "key").filter("cid <> other").select(*pair("cid", "other"))
    pairs = met.union(near.join(head("a"), "a").join(head("b"), "b").select(*pair("a_head", "b_head"))).distinct()
    first = table(with_classes(pairs).filter(_could("x", "y")).select("a", "b"), "pairs")
    # sets of the classes that share a key, from one text of each by its digest
    keyed = table(index.join(shared.select("key"), "key", "left_semi"), "keyed")
    needed = keyed.select("cid").union(first.select("a")).union(first.select("b")).distinct()
    wanted = full.join(needed, "cid", "left_semi").select("cid", "mark")
    chosen_texts = texts.select("mark", "text").join(wanted.hint("shuffle_hash"), "mark").select("cid", "text")
    sets = table(_sets(chosen_texts, words).dropDuplicates(["cid"]), "sets")
    found = table(_alike(first, sets), "alike")
    named = table(_named(found, classes), "named")
    # of the keys whose classes aren't in one component by now, those in different ones meet
    held = table(keyed.join(named, "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("component")), "held")
    mixed = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    apart = table(held.join(mixed, "key", "left_semi").select("cid", "component").distinct().join(known, "cid"), "apart")
    second = table(_rare_in_common(sets, apart).join(first, ["a", "b"], "left_anti"), "pairs")
    if not second.isEmpty():
        named = _named(table(found.union(_alike(second, sets)), "alike"), classes)
    told = classes.join(named, "cid", "left").select("whole", "n", "least", F.coalesce("component", "cid").alias("component"))
    told = table(told, "told")
    smallest = told.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.select("id", "mark", "n", "whole").join(told.join(smallest, "component").select("whole", "n", "component_id"), ["whole", "n"], "left").select("id", "mark", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """id_col and component_id, the smallest id reachable over links of a similarity of 0.8 or more.

    Equal sets are one class from the start.  Classes meet that have a min-wise key or a fingerprint in
    common, or fingerprints DISTANCE bits apart, and whose sizes, parities and sketches allow the similarity.
    First each meets one class chosen for the key, so that a large group of near copies makes as many
    pairs as it has members; then, of the keys whose classes aren't in one component by then, those
    in different ones meet by their rarest shingles.  Every link is decided on the whole sets.  Texts without words, null
    included, are one class.  A null id is passed over when a smallest id is taken; a component of null
    ids only has none.  Rows that repeat an id are each linked by their own text.  Other columns aren't
    read.  An empty table gives no rows.
    """
    return _joined(docs, id_col, text_col, words).select(F.col("id").alias(id_col), "component_id")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """The rows of ``docs``, columns as they are, but for all of a component other than its smallest id's.

    Rows are dropped by id and text together.  Rows with null ids go if their component has an id, else
    they all stay; so do rows that repeat the smallest id within its component.
    """
    found = _joined(docs, id_col, text_col, words)
    gone = found.filter(F.col("component_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("component_id")))
    return without_rows(docs, table(gone.select("id", "mark").distinct(), "dropped"), id_col, text_col)
