"""Encoding to pieces by a streaming Viterbi search, and decoding."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

SPACE = "▁"
#: Of log-probabilities.
UNITS = 1_000_000
#: Stands for a literal U+2581 of the text while spaces take its place; no valid text holds it.
_LITERAL = "\udc81"
#: Words whose ids a task remembers, and the longest of them.
REMEMBERED, LONGEST = 300_000, 48


class Pieces:
    """A vocabulary: pieces, log-probabilities and ids of single bytes.

    A model with log-probabilities (unigram) is taken as it is.  In a model of merges a score is only
    a rank; a piece's probability is then Zipf's, in proportion to one over its rank and 2.  Log-probabilities are
    whole numbers of millionths, so that sums are exact and equal paths are equal.
    """

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int], unknown: int):
        self.byte_ids, self.unknown = byte_ids, unknown
        ranks = all(float(s).is_integer() for _, _, s in pieces)
        order = sorted(pieces, key=lambda x: (-x[2], x[0]))
        whole = math.log(sum(1 / (r + 2) for r in range(len(order))) or 1)
        score = {i: -math.log(r + 2) - whole if ranks else s for r, (i, _, s) in enumerate(order)}
        self.longest = max((len(p) for _, p, _ in pieces), default=1)
        #: of each piece its length, id and score
        self.pieces = {p: (len(p), i, round(score[i] * UNITS)) for i, p, _ in pieces if p}
        #: characters that are pieces
        self.single = frozenset(p for p in self.pieces if len(p) == 1)
        #: of a character that no piece covers
        self.fallback = round((min(score.values(), default=0.0) - 10) * UNITS)
        #: no piece goes on to another word, or across a line's end: all paths meet there
        self.words = not any(SPACE in p.lstrip(SPACE) for _, p, _ in pieces)
        lines = not any("\n" in p for _, p, _ in pieces)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.bytes_of = {i: p.replace(SPACE, " ").encode() for i, p, _ in pieces} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.known: dict[str, list[int]] = {}
        self._found = None

    @staticmethod
    def load(path: str) -> Pieces:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        by = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return Pieces([(i, p.id_to_piece(i), p.get_score(i)) for i in kept], by if all(p.is_byte(i) for i in by) else [], p.unk_id())

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_found": None, "known": {}}

    def _matches(self, text: str) -> Iterator[tuple[int, tuple[int, int, int]]]:
        """(last character, (length, id, score)) of every piece in a text, by where it ends, the longest first."""
        if self._found is None:
            self._found = ahocorasick.Automaton()
            for piece, value in self.pieces.items():
                self._found.add_word(piece, value)
            self._found.make_automaton()
        return self._found.iter(text) if self.pieces else iter(())

    def _spell(self, char: str) -> list[int]:
        raw = (SPACE if char == _LITERAL else char).encode("utf-8", "surrogatepass")
        return [self.byte_ids[b] for b in raw] if self.byte_ids else [self.unknown]

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of the best path, a stretch at a time.

        A boundary's score needs those of the boundaries no further back than the longest piece, the window.  Each
        boundary also knows through which boundary of an earlier moment its path goes.  When as much as
        the longest piece has been read since the last look and all boundaries of the window go through the
        same one, every path that can survive does: ids up to there are final and leave, and
        the moment is taken anew.  Of equal scores the path whose last piece is shortest is kept: what doesn't fit
        an even division then stands last on every path, so that paths through repetitive text meet too.
        """
        longest, fallback, none = self.longest, self.fallback, (-1, (0, 0, 0))
        matches = self._matches(text)
        end, (length, number, score) = next(matches, none)
        # best and through are of boundaries from ``first`` on, piece and size of those behind ``base``
        first = base = looked = 0
        best, through = [0], [0]
        piece, size = [-1], [0]
        for i in range(len(text)):
            top, what, long, single = None, -1, 1, False
            while end == i:
                if i + 1 - length >= first:
                    s = best[i + 1 - length - first] + score
                    if top is None or s >= top:
                        top, what, long = s, number, length
                single = single or length == 1
                end, (length, number, score) = next(matches, none)
            if not single:
                s = best[i - first] + fallback
                if top is None or s >= top:
                    top, what, long = s, -1, 1
            best.append(top)
            through.append(through[i + 1 - long - first])
            piece.append(what)
            size.append(long)
            if i - looked >= longest:
                looked = i
                live = max(first, i + 2 - longest)
                best, through, first = best[live - first :], through[live - first :], live
                met = through[0]
                if through.count(met) == len(through):
                    if met > base:
                        yield self._path(text, base, met, size, piece)
                        piece, size, base = piece[met - base :], size[met - base :], met
                    through = list(range(first, first + len(through)))
        if len(text) > base:
            yield self._path(text, base, len(text), size, piece)

    def _word(self, text: str) -> list[int]:
        """The same of a word whose characters all are pieces and which ends before it could be cut."""
        best: list = [0] + [None] * len(text)
        last = best.copy()
        for end, value in self._matches(text):
            s = best[end + 1 - value[0]] + value[2]
            if best[end + 1] is None or s >= best[end + 1]:
                best[end + 1], last[end + 1] = s, value
        out, at = [], len(text)
        while at:
            out.append(last[at][1])
            at -= last[at][0]
        out.reverse()
        return out

    def _path(self, text: str, base: int, end: int, size: list[int], piece: list[int]) -> list[int]:
        out: list[list[int]] = []
        while end > base:
            number = piece[end - base]
            out.append([number] if number >= 0 else self._spell(text[end - 1]))
            end -= size[end - base]
        return [i for part in reversed(out) for i in part]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        marked = SPACE + text.replace(SPACE, _LITERAL).replace(" ", SPACE)
        if not self.words:
            return [i for part in self.stream(marked) for i in part]
        out: list[int] = []
        known = self.known
        for word in self.cut.findall(marked):
            ids = known.get(word)
            if ids is None:
                ids = self._word(word) if len(word) <= LONGEST and self.single.issuperset(word) else [i for part in self.stream(word) for i in part]
                if len(word) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text again; its first space, put there by encode, goes."""
        of = self.bytes_of
        return b"".join([of.get(i, b"") for i in ids]).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, pieces: Pieces, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): ids of every whole text; none for a null or an empty one.

    Null and repeated ids are rows like any other, and equal texts have equal ids; an empty table has no rows.  Other columns
    aren't read.
    """
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(pieces)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = shipped.value
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([use.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["id", "ids"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, pieces: Pieces, *, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """``encoded`` with the text of each row's ids as column ``to``, which takes the place of one of that name; null ids give an empty text."""
    small_batches(encoded.sparkSession)
    shipped = encoded.sparkSession.sparkContext.broadcast(pieces)

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd

        return pd.Series([shipped.value.decode([] if x is None else x.tolist()) for x in ids], dtype=object)

    return encoded.withColumn(to, text(ids_col))
