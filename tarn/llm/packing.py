"""Packing of tokenised documents into windows by sum-of-squares online placement."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
#: Id after each document.
END = 1
#: Windows that a task holds open at most; with the window they bound its memory.
OPEN = 4096
#: Bytes of texts taken at once, stretches given to the tokenizer at once, and stretches whose ids a task remembers.
CHUNK, AT_ONCE, REMEMBERED = 1 << 20, 20_000, 600_000

Piece = tuple[int, int, np.ndarray]
#: White space and the word after it.  No token of a byte-level vocabulary reaches from a word to white space after it.
_STRETCH = re.compile(r"\s*\S+|\s+")
#: White space to Python and not to the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")


class Tokens:
    """Ids by a byte-level tokenizer, which sees each stretch of white space and a word once.

    Stretches that aren't known yet are encoded together: one that begins with white space and ends with a word can
    follow another, as the ids between two such ends are its own, and those ends are found by the bytes
    that ids stand for.  A text's first word gets a line's end before it, whose id is dropped.
    """

    def __init__(self, description: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(description)
        vocabulary = self.model.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)  # a character of a token stands for a byte
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.start, self.count = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Adds the ids of stretches, numbered as they come."""
        for lo in range(0, len(new), AT_ONCE):
            some = new[lo : lo + AT_ONCE]
            first = np.array([not w[0].isspace() for w in some])
            blank = [i for i, w in enumerate(some) if w.isspace()]
            joined = [w for w in some if not w.isspace()]
            ids = self._plain(["".join(["\n" + w if not w[0].isspace() else w for w in joined])])[0]
            ends = np.cumsum([len(w.encode()) + (not w[0].isspace()) for w in joined], dtype=np.int64)
            stop = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
            begin = np.concatenate([[0], stop[:-1]]).astype(np.int64)
            start, count = np.zeros(len(some), dtype=np.int64), np.zeros(len(some), dtype=np.int64)
            word = np.ones(len(some), dtype=bool)
            word[blank] = False
            start[word], count[word] = begin + first[word], stop - begin - first[word]
            own = self._plain([some[i] for i in blank])
            count[blank] = [len(x) for x in own]
            start[blank] = len(ids) + np.cumsum([0, *(len(x) for x in own)], dtype=np.int64)[:-1]
            self.start = np.concatenate([self.start, start + len(self.ids)])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, ids, *own])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self._forget()
        known, new, rows, odd = self.known, [], [], {}
        for n, text in enumerate(texts):
            if _ODD.search(text):
                odd[n] = self._plain([text])[0]
                text = ""
            words = _STRETCH.findall(text)
            row = list(map(known.get, words))
            if None in row:
                for i, w in enumerate(words):
                    if row[i] is None:
                        row[i] = known.setdefault(w, len(known))
                        if row[i] == len(self.start) + len(new):
                            new.append(w)
            rows.append(np.array(row, dtype=np.int64))
        self._learn(new)
        out = []
        for n, row in enumerate(rows):
            counts = self.count[row]
            at = np.repeat(self.start[row] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            out.append(odd[n] if n in odd else self.ids[at])
        return out


#: A worker's tokens, by the tokenizer's description: tasks that follow each other in it share what is known.
_TOKENS: dict[str, Tokens] = {}


def tokens_of(description: str) -> Tokens:
    if description not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[description] = Tokens(description)
    return _TOKENS[description]


class Packer:
    """Windows of one task.  ``level`` counts the open windows by their fill.

    A piece goes to the fill level where the sum of the squared counts is least afterwards, a new window
    being one of the choices; ties go to the fullest.  A full window leaves.  What is open at the end, or
    when there are ``most`` open windows, is poured: windows that are filled to a power of two leave as
    they are, as those aren't padded; the pieces of the others are strung together and cut into full
    windows, and what is left of them into powers of two.  So nothing is padded, and a window
    costs one cut at most.
    """

    def __init__(self, window: int = WINDOW, most: int = OPEN):
        self.window, self.most, self.n_open = window, most, 0
        self.level = np.zeros(window + 1, dtype=np.int64)
        self.held: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.full: list[list[Piece]] = []

    def add(self, doc: int, ids: np.ndarray) -> None:
        w, whole = self.window, len(ids) - len(ids) % self.window
        self.full += [[(doc, at, ids[at : at + w])] for at in range(0, whole, w)]
        if whole < len(ids):
            self._place((doc, whole, ids[whole:]))

    def _place(self, piece: Piece) -> None:
        s, w, level = len(piece[2]), self.window, self.level
        # of moving one window from h to h + s: (n[h] - 1)^2 - n[h]^2 + (n[h + s] + 1)^2 - n[h + s]^2
        cost = 2 * (level[s:] - level[: w + 1 - s]) + 2
        cost[w - s] -= 1  # full windows aren't counted
        cost[level[: w + 1 - s] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * level[s] + 1  # a new one
        h = w - s - int(np.argmin(cost[::-1]))
        if h:
            level[h] -= 1
            self.n_open -= 1
            into = self.held[h].pop()
        else:
            into = []
        into.append(piece)
        if h + s == w:
            self.full.append(into)
            return
        level[h + s] += 1
        self.n_open += 1
        self.held[h + s].append(into)
        if self.n_open > self.most:
            self.pour()

    def pour(self) -> None:
        rest: list[Piece] = []
        for h in range(self.window - 1, 0, -1):
            for pieces in self.held[h]:
                if h & (h - 1):
                    rest += pieces
                else:
                    self.full.append(pieces)
            self.held[h] = []
        self.level[:], self.n_open = 0, 0
        left, own = sum(len(ids) for _, _, ids in rest), []
        room = self._room(left)
        for doc, start, ids in rest:
            at = 0
            while at < len(ids):
                part = ids[at : at + room]
                own.append((doc, start + at, part))
                at, room, left = at + len(part), room - len(part), left - len(part)
                if not room:
                    self.full.append(own)
                    own, room = [], self._room(left)

    def _room(self, left: int) -> int:
        return self.window if left >= self.window else 1 << max(left.bit_length() - 1, 0)

    def leave(self) -> list[list[Piece]]:
        out, self.full = self.full, []
        return out


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, most_open: int = OPEN) -> DataFrame:
    """(id_col, start, length, ids, doc_tokens, sequence_id, offset): a row for each piece.

    ``tokenizer`` is the file of a byte-level vocabulary, read on the driver and sent to the tasks (2 MB
    whatever the documents).  A document is the ids of its whole text and ``end``.  ``ids`` are a
    piece's ids as little-endian 32-bit numbers, ``start`` says how many of the document stand before it,
    ``offset`` how many of the sequence.  Each id is in exactly one piece, and each sequence is
    either full or filled to a power of two, so none is padded.

    Each task packs the rows of its own partition in their order, holding ``most_open`` windows at most;
    nothing is shuffled and no sequence is shared by two tasks, so one that runs again, after an executor
    is lost, replaces its sequences whole.  sequence_id is the partition's number times 2**33 and a count.
    A null text counts as empty: its ``end`` is its only id.  Null and repeated ids are documents like any
    other; other columns aren't read; an empty table has no pieces.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokens_of(shipped.value)
        packer, tail = Packer(window, most_open), np.array([end], dtype="<u4")
        #: of documents whose pieces haven't all left: id, tokens, tokens left
        held: dict[int, list] = {}
        n_docs, n_sequences = 0, TaskContext.get().partitionId() << 33

        def left() -> pa.RecordBatch:
            nonlocal n_sequences
            columns: list[list] = [[] for _ in names]
            for pieces in packer.leave():
                offset = 0
                for doc, start, ids in pieces:
                    own = held[doc]
                    for column, value in zip(columns, (own[0], start, len(ids), ids.tobytes(), own[1], n_sequences, offset), strict=True):
                        column.append(value)
                    offset += len(ids)
                    own[2] -= len(ids)
                    if not own[2]:
                        del held[doc]
                n_sequences += 1
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        types = None
        for b in batches:
            types = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CHUNK, side="right")))
                texts = [(x or b"").decode("utf-8", "replace") for x in b.column(1).slice(lo, hi - lo).to_pylist()]
                once = list(dict.fromkeys(texts))
                found = {t: np.concatenate([ids, tail]) for t, ids in zip(once, model.encode(once), strict=True)}
                for name, text in zip(b.column(0).slice(lo, hi - lo).to_pylist(), texts, strict=True):
                    ids = found[text]
                    held[n_docs] = [name, len(ids), len(ids)]
                    packer.add(n_docs, ids)
                    n_docs += 1
                lo = hi
                yield left()
        if types:
            packer.pour()
            yield left()

    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
