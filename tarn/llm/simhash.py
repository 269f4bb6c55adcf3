"""Near-duplicate documents by SimHash, linked through pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import NOT_SPACE, blocks, scan_words, string_buffer
from .components import components
from .shared import digest, small_batches, table, without_rows

BITS, SEGMENTS, WIDTH = 64, 4, 16
#: Fingerprints that share a 32-bit chain key beyond this many are told apart by 48 bits.
CROWDED = 4096
_BIT_OF_VALUE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def fingerprints(raw: np.ndarray, offsets: np.ndarray, words: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text: A-Z lower-cased, shingles of ``words`` words with repeats."""
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for lo, hi in blocks(offsets):
        w = scan_words(raw, offsets[lo : hi + 1], NOT_SPACE)
        n = w.counts
        shingles = np.maximum(n - words + 1, np.minimum(n, 1))
        at = np.concatenate([[0], np.cumsum(shingles)])
        text = np.repeat(np.arange(hi - lo), shingles)
        begin = np.arange(at[-1]) - at[text] + w.first[text]
        last = np.minimum(begin + words - 1, w.first[text + 1] - 1)
        norm = w.norm.tobytes()
        hashes = np.fromiter((digest(norm[s:e], seed) for s, e in zip(w.start[begin].tolist(), w.end[last].tolist(), strict=True)), dtype=np.uint64, count=len(begin))
        out[lo:hi] = majority(hashes, at)
    return out


def majority(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The bits that more than half of hashes[cuts[i]:cuts[i+1]] have, for each i; none of no hashes."""
    out = np.zeros(len(cuts) - 1, dtype=np.uint64)
    # how often each of a hash's eight bytes takes each value tells how often each bit is set
    values = hashes.astype(">u8").view(np.uint8).reshape(-1, 8) + (np.arange(8) * 256)[None, :]
    for i in np.flatnonzero(np.diff(cuts)):
        seen = np.bincount(values[cuts[i] : cuts[i + 1]].ravel(), minlength=2048).reshape(8, 256)
        out[i] = np.packbits((seen @ _BIT_OF_VALUE).ravel() * 2 > cuts[i + 1] - cuts[i]).view(">u8")[0]
    return out


def with_fingerprint(docs: DataFrame, *, id_col: str, text_col: str, words: int = 3, seed: int = 42) -> DataFrame:
    """(id, mark, fp): of each row its text's digest, and the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(*string_buffer(b.column(1)), words, seed).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(fp)], names=["id", "mark", "fp"])

    return docs.select(F.col(id_col), F.col(text_col), digest(F.col(text_col)).alias("mark")).mapInArrow(run, f"id {kind.simpleString()}, mark string, fp long")


def _turned(fp: Column, by: int) -> Column:
    """``fp`` rotated left by ``by`` bits."""
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def _budget(segments: int, distance: int) -> int:
    return segments * distance // SEGMENTS


def _flips(width: int, most: int) -> list[int]:
    """All masks of ``width`` bits with ``most`` bits set or fewer."""
    out = [0]
    for _ in range(most):
        out = sorted({m | 1 << i for m in out for i in range(width)} | set(out))
    return out


def links(fps: DataFrame, distance: int) -> DataFrame:
    """Pairs a < b of the distinct fingerprints ``fps`` (fp) at ``distance`` bits or fewer.

    Pigeonring: cut into four segments in a ring, two fingerprints within the distance have a segment
    from which every chain of 1..4 consecutive segments differs in no more than its proportional share
    of the distance (0, 1, 2 and 3 of 3).  The shares of the first two segments make a join key: one
    side has its own two segments, the other all it could meet there.  The third share and the whole
    distance are conditions of the join.  Spark takes the exploded probes for as few bytes as the
    fingerprints they come from, so the join is told not to broadcast them.  A key that more than CROWDED fingerprints share is replaced
    by one of three segments, which no more than 65,536 distinct ones can share; only fingerprints that
    reach such a key are probed for it.
    """
    if _budget(2, distance) > 2:
        raise ValueError("distance is at most 5")
    turns = F.explode(F.array(*[F.struct(F.lit(i).alias("ring"), _turned(F.col("fp"), WIDTH * i).alias("turned")) for i in range(SEGMENTS)]))
    turned = fps.select("fp", turns.alias("t")).select("fp", "t.ring", "t.turned")

    def key(segments: int) -> Column:
        return F.shiftrightunsigned("turned", BITS - WIDTH * segments)

    def masks(segments: int) -> Column:
        first = [m << WIDTH for m in _flips(WIDTH, _budget(1, distance))]
        out = [a | b for a in first for b in _flips(WIDTH, _budget(2, distance)) if (a | b).bit_count() <= _budget(2, distance)]
        if segments == 3:
            out = [a << WIDTH | b for a in out for b in _flips(WIDTH, _budget(3, distance) - a.bit_count())]
        return F.array(*[F.lit(m).cast("long") for m in out])

    def probes(of: DataFrame, segments: int) -> DataFrame:
        return of.select("ring", F.explode(F.transform(masks(segments), lambda m: key(segments).bitwiseXOR(m))).alias("key"), F.col("turned").alias("y"), F.col("fp").alias("a"))

    def meet(index: DataFrame, probe: DataFrame, segments: int) -> DataFrame:
        left = index.select("ring", key(segments).alias("key"), F.col("turned").alias("x"), F.col("fp").alias("b"))
        right = probes(probe, segments).hint("merge")
        differ = F.col("x").bitwiseXOR(F.col("y"))
        near = (F.bit_count(F.shiftrightunsigned(differ, WIDTH)) <= _budget(3, distance)) & (F.bit_count(differ) <= distance)
        return left.join(right, ["ring", "key"]).filter((F.col("a") < F.col("b")) & near).select("a", "b")

    crowded = table(turned.groupBy("ring", key(2).alias("key")).agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).select("ring", "key"), "crowded")
    if crowded.isEmpty():
        return meet(turned, turned, 2).distinct()
    tagged = turned.withColumn("key", key(2))
    thin, thick = tagged.join(crowded, ["ring", "key"], "left_anti"), tagged.join(crowded, ["ring", "key"], "left_semi")
    reaching = probes(turned, 2).join(crowded, ["ring", "key"], "left_semi").select("ring", F.col("y").alias("turned"), F.col("a").alias("fp")).distinct()
    return meet(thin, turned, 2).union(meet(thick, reaching, 3)).distinct()


def _joined(docs: DataFrame, id_col: str, text_col: str, words: int, distance: int) -> DataFrame:
    """(id, mark, fp, component_id) for each row of ``docs``."""
    prints = table(with_fingerprint(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    classes = table(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    joined = components(table(links(classes.select("fp"), distance), "pairs"))
    grouped = classes.join(joined, classes.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = table(grouped, "grouped")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = table(named.join(smallest, "component").select("fp", "component_id"), "components")
    return prints.join(of_class, "fp", "left").select("id", "mark", "fp", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """id_col, fp (long) and component_id, the smallest id reachable over links of ``distance`` bits or fewer.

    Documents of one fingerprint are one class from the start, so a group of copies makes no pairs;
    classes are linked by ``links`` and joined into components.  A text without words, null included,
    has fingerprint zero and is linked like any other.  A null id is passed over when a smallest id is
    taken; a component of null ids only has none.  Rows that repeat an id are each linked by their own
    text.  Other columns aren't read.  An empty table gives no rows.
    """
    return _joined(docs, id_col, text_col, words, distance).select(F.col("id").alias(id_col), "fp", "component_id")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs``, columns as they are, but for all of a component other than its smallest id's.

    Rows are dropped by id and text together.  Rows with null ids go if their component has an id, else
    they all stay; so do rows that repeat the smallest id within its component.
    """
    found = _joined(docs, id_col, text_col, words, distance)
    gone = found.filter(F.col("component_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("component_id")))
    return without_rows(docs, table(gone.select("id", "mark").distinct(), "dropped"), id_col, text_col)
