"""Language identification by rank-order n-gram profiles and the out-of-place distance."""

from __future__ import annotations

import functools
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, table

#: Most frequent n-grams that a profile holds; also the distance of a gram that a profile lacks.
RANKS = 300
#: Labelled documents a language is learned from, chosen by a hash of their ids.
SAMPLE = 3000
#: Languages whose profiles are broadcast at once, some 4 MB; and those whose shares are.
AT_ONCE, SHARES = 2000, 500_000
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """The code point of each letter, 0 for all other characters."""
    return np.fromiter((c if chr(c).isalpha() else 0 for c in range(sys.maxunicode + 1)), dtype=np.int64, count=sys.maxunicode + 1)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The 1- to 3-grams of a text's lower-cased words and their counts, most frequent first, ties by
    gram.  A gram is a number of three code points; the ends of words count as a character, 1."""
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    inside = codes != 0
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([[0], codes, [0]])
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
    c = padded[keep]
    # 1, as a gram that begins with 0 would be the number of the shorter one
    c = np.where(c == 0, 1, c)
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[c[1:-1] != 1]
    found, counts = np.unique(np.concatenate([c[c != 1], two, three]), return_counts=True)
    order = np.argsort(-counts, kind="stable")
    return found[order], counts[order]


@dataclass
class Profiles:
    """names: languages in order; known: all profiles' grams, sorted; start: where each gram's entries begin in langs (by
    number) and ranks, and their end.  ``rest`` are the profiles of further languages, in parts of AT_ONCE."""

    names: list[str]
    known: np.ndarray
    start: np.ndarray
    langs: np.ndarray
    ranks: np.ndarray
    rest: tuple[Profiles, ...] = ()

    @staticmethod
    def of(rows: list[tuple[str, int, int]], rest: tuple[Profiles, ...] = ()) -> Profiles:
        names = sorted({r[0] for r in rows})
        at = {n: i for i, n in enumerate(names)}
        grams_ = np.array([r[1] for r in rows], dtype=np.int64)
        order = np.argsort(grams_, kind="stable")
        known, first = np.unique(grams_[order], return_index=True)
        langs = np.array([at[r[0]] for r in rows], dtype=np.int32)[order]
        return Profiles(names, known, np.append(first, len(rows)), langs, np.array([r[2] for r in rows], dtype=np.int32)[order], rest)

    @property
    def parts(self) -> tuple[Profiles, ...]:
        return (self, *self.rest)

    def nearest(self, found: np.ndarray) -> tuple[int, str] | None:
        """The least distance from a text's grams, most frequent first, and its language, by name among equals; of this part alone."""
        if not len(found) or not self.names:
            return None
        at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        own = np.flatnonzero(self.known[at] == found)
        begin = self.start[at[own]]
        counts = self.start[at[own] + 1] - begin
        rows = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        # a gram that a profile lacks is RANKS away: what each has takes off that
        less = np.bincount(self.langs[rows], RANKS - np.abs(self.ranks[rows] - np.repeat(own, counts)), len(self.names))
        best = int(np.argmax(less))
        return RANKS * len(found) - int(less[best]), self.names[best]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language of all parts and 1 less the share of the largest distance."""
        found = grams(text or "")[0][:RANKS]
        best = min((x for p in self.parts if (x := p.nearest(found)) is not None), default=None)
        return (UNKNOWN, 0.0) if best is None else (best[1], float(1 - best[0] / (RANKS * len(found))))


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Profiles:
    """Profiles of the languages in ``labelled``, each from about ``sample`` documents (their whole
    texts), chosen by a hash of the id; rows without a language or a text aren't used.

    Any number of languages is learned.  Beyond AT_ONCE their profiles are gathered and used a part after the
    other, so that no broadcast grows with them; the driver holds them all, 300 entries a language.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))
    share = sorted((r["lang"], r["share"]) for r in rows.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share")).collect())
    if not share:
        return Profiles.of([])
    shares = spark.createDataFrame(share, "lang string, share double")
    of = F.broadcast(shares) if len(share) <= SHARES else shares
    chosen = rows.join(of, "lang").filter(F.pmod("h", F.lit(1_000_003)) < F.col("share") * 1_000_003).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, counts = grams(text)
                seen.setdefault(lang, Counter()).update(dict(zip(found.tolist(), counts.tolist(), strict=True)))
            flat = [(lang, g, n) for lang, of in seen.items() for g, n in of.items()]
            yield pa.record_batch([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.int64())], names=["lang", "gram", "n"])

    counted = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counted.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < RANKS)
    found = top.select("lang", "gram", "rank")
    gathered = lambda df: [(r["lang"], r["gram"], r["rank"]) for r in df.collect()]
    if len(share) <= AT_ONCE:
        return Profiles.of(gathered(found))
    held = table(found, "profiles")
    ends = [(share[lo][0], share[min(lo + AT_ONCE, len(share)) - 1][0]) for lo in range(0, len(share), AT_ONCE)]
    first, *rest = [Profiles.of(gathered(held.filter(F.col("lang").between(a, b)))) for a, b in ends]
    return replace(first, rest=tuple(rest))


def identify(docs: DataFrame, profiles: Profiles, *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with pred_col and score_col (0 to 1) added, from the whole text alone.

    A null text, one without letters, or no learned language gives ``und`` and 0.  One pass without a
    shuffle; rows that repeat are judged alike, and an empty table gives no rows.  Columns of ``docs``
    stay as they are; one that has the name of a column to add is an error, so that none is lost.
    """
    if taken := {pred_col, score_col} & set(docs.columns):
        raise ValueError(f"columns {sorted(taken)} are there already: name others")
    small_batches(docs.sparkSession)
    out = docs.withColumn("__found", F.lit(None).cast(NEAREST))
    for part in profiles.parts:
        out = _nearer(out, replace(part, rest=()), text_col)
    found = F.col("__found")
    return out.select("*", F.coalesce(found["lang"], F.lit(UNKNOWN)).alias(pred_col), F.coalesce(1 - found["away"] / (RANKS * found["grams"]), F.lit(0.0)).alias(score_col)).drop("__found")


NEAREST = "struct<away:long,lang:string,grams:long>"


def _nearer(docs: DataFrame, part: Profiles, text_col: str) -> DataFrame:
    """``docs`` with __found: the nearest language of this part or what stood there, if that is nearer."""
    shipped = docs.sparkSession.sparkContext.broadcast(part)

    @F.pandas_udf("away long, lang string, grams long")
    def nearest(texts):
        import pandas as pd

        rows = []
        for t in texts:
            found = grams(t or "")[0][:RANKS]
            best = shipped.value.nearest(found)
            rows.append((None, None, len(found)) if best is None else (*best, len(found)))
        return pd.DataFrame(rows, columns=["away", "lang", "grams"]).astype({"away": "Int64", "lang": object})

    with_new = docs.withColumn("__new", nearest(text_col))
    new, old = F.col("__new"), F.col("__found")
    better = new["lang"].isNotNull() & (old.isNull() | (new["away"] < old["away"]) | ((new["away"] == old["away"]) & (new["lang"] < old["lang"])))
    return with_new.withColumn("__found", F.when(better, new).otherwise(old)).drop("__new")


def held_out(id_col: str = "doc_id"):
    """True for the documents that nothing is learned from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))
