"""Packing into training sequences by vector bin packing.

A document's token ids (with the end id) are cut into full sequences and a
rest. Rests are packed under simultaneous limits on tokens, segments and
loss-bearing tokens by the dot-product heuristic: the open sequence takes, of
all rests that fit, the one whose demand vector has the largest dot product
with the room that is left; when none fits it is closed. Sequences that would
be closed with much padding wait for the next rests of the task. What is left
at the end of a task is cut into sequences whose lengths are powers of two,
which need no padding.

Each task packs its own stream of documents with a bounded buffer: no shuffle,
and nothing that grows with the input. Sequence ids start with the number of
the partition, so a task that runs again after a lost executor gives the same
ids, provided its input partition has the same rows in the same order (read
the documents from files, not from a shuffle).
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, text_slices, utf8
from .hashing import BYTE, CASED, SPACE, WORDS, Slots, word_spans

TOKENS = 2048
SEGMENTS = 64
LOSS_TOKENS = 2048
END_ID = 1
#: Rests a task holds at a time, and the share of tokens from which a
#: sequence may be closed while more rests are to come.
BUFFER, FILLED = 1024, 0.985


#: Pre-tokenizer patterns that part runs of letters, digits and other
#: characters and know contractions (fixed value, as tokenizer files state it).
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ascii = np.arange(256)
_LETTER = ((_ascii >= 65) & (_ascii <= 90)) | ((_ascii >= 97) & (_ascii <= 122))
_DIGIT = (_ascii >= 48) & (_ascii <= 57)
#: White space, letters, digits, other ASCII characters, and those that may go
#: with either neighbour: the apostrophe and everything beyond ASCII.
PARTS = np.where(SPACE, 0, np.where(_LETTER, 1, np.where(_DIGIT, 2, np.where((_ascii < 128) & (_ascii != 39), 3, 4)))).astype(np.uint8)


def parts(raw: np.ndarray) -> np.ndarray:
    """A class per byte such that words, being runs of one class, can be
    tokenized one by one under ``RUNS``: a run of letters, digits or other
    ASCII characters is one, but what touches an apostrophe or a character
    beyond ASCII stays whole with its neighbours up to the next white space."""
    kind = PARTS[raw]
    if not (kind == 4).any():
        return kind
    edge = np.flatnonzero(np.diff((kind > 0).astype(np.int8), prepend=0, append=0))
    lo, hi = edge[::2], edge[1::2]
    loose = np.concatenate([[0], np.cumsum(kind == 4)])
    whole = loose[hi] > loose[lo]
    mark = np.zeros(len(raw) + 1, np.int32)
    mark[lo[whole]] += 1
    mark[hi[whole]] -= 1
    kind[np.cumsum(mark[:-1]) > 0] = 4
    return kind


class Tokens:
    """Ids of words, computed once per distinct word of a worker (bounded:
    beyond ``limit`` words it starts anew)."""

    def __init__(self, path: str, limit: int = 1_000_000):
        # one thread: tasks are the parallelism, and each thread would hold
        # memory of its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        # a special token parts the words of one call; words that hold such a
        # string themselves are read one by one
        special = [t for t in self.tokenizer.get_added_tokens_decoder().items() if t[1].special]
        self.mark_id, self.mark = (special[0][0], special[0][1].content) if special else (None, None)
        self.hints = [t[1].content[:2].encode() for t in special]
        first = json.loads(self.tokenizer.to_str()).get("pre_tokenizer") or {}
        first = first["pretokenizers"][0] if first.get("type") == "Sequence" else first
        self.runs = first.get("type") == "Split" and first["pattern"].get("Regex") == RUNS and first["invert"]
        self.clear()

    def clear(self) -> None:
        self.slots = Slots()
        self.start = np.zeros(4096, np.int64)
        self.size = np.zeros(4096, np.int32)
        self.ids = np.zeros(65536, np.uint32)
        self.used = 0

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids per word)."""
        if self.mark is None or any(h in b" ".join(words) for h in self.hints):
            made = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
            return np.array([i for ids in made for i in ids], np.uint32), np.array([len(ids) for ids in made], np.int64)
        # a few thousand words a call, each followed by the mark
        mark = self.mark.encode()
        texts = [(mark.join(words[i:i + 4000]) + mark).decode() for i in range(0, len(words), 4000)]
        flat = np.concatenate([np.array(e.ids, np.uint32)
                               for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(flat == self.mark_id)
        return flat[flat != self.mark_id], np.diff(np.concatenate([[-1], ends])) - 1

    def learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        flat, size = self._encode(words)
        at = self.slots.add(keys)
        while len(self.slots) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + len(flat)] = flat
        self.start[at] = self.used + np.cumsum(size) - size
        self.size[at] = size
        self.used += len(flat)

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds). White space parts the tokenizer's own
        words, so a text's ids are those of its runs between white space, or of
        shorter ``parts`` where the tokenizer's pattern is known."""
        raw, offsets = utf8(column)
        data = raw.tobytes()
        # letters' case changes no id, unless it makes a special token
        plain = self.lowers and not any(h in data for h in self.hints)
        kinds = parts(raw) if plain and self.runs else WORDS[raw]
        hashes, starts, size, bounds = word_spans(raw, offsets, table=BYTE if plain else CASED, kinds=kinds)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.slots) + len(distinct) > self.limit:
            self.clear()
        at = self.slots.find(distinct)
        new = np.flatnonzero(at < 0)
        if len(new):
            where = first[new]
            self.learn(distinct[new], [data[s:s + n] for s, n in zip(starts[where].tolist(), size[where].tolist())])
            at = self.slots.find(distinct)
        at = at[inverse]
        count = self.size[at]
        total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        pick = np.repeat(self.start[at] - total[:-1], count) + np.arange(total[-1])
        return self.ids[pick], total[bounds]

    @property
    def lowers(self) -> bool:
        """Whether the tokenizer reads upper-case letters as lower-case."""
        return self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("Aé") == "aé"


def worker_tokens(path: str) -> Tokens:
    """The worker process's own ``Tokens``: words that an earlier task of the
    worker has read need not be read again. This module's code travels to
    workers by value and has no module there, so a named place among the
    interpreter's modules holds the object. A new worker starts anew."""
    place = sys.modules.setdefault("_packing_tokens", ModuleType("_packing_tokens"))
    held = place.__dict__.get("held")
    if held is None or held[0] != path:
        place.held = held = (path, Tokens(path))
    return held[1]


def fill(demand: np.ndarray, room: np.ndarray) -> list[list[int]]:
    """Vector bin packing by dot product: item numbers of each bin.

    ``demand``: items x resources, ``room``: capacity of a bin; every item
    fits an empty bin."""
    share = demand / room
    # longest first, so that ties fall to the longer and then the earlier item
    order = np.lexsort((np.arange(len(demand)), -demand[:, 0]))
    share, left = share[order], np.ones(len(demand), bool)
    bins = []
    waiting = len(demand)
    while waiting:
        free = np.ones(share.shape[1])
        one: list[int] = []
        while True:
            fits = left & (share <= free + 1e-12).all(axis=1)
            if not fits.any():
                break
            i = int(np.argmax(np.where(fits, share @ free, -1.0)))
            left[i] = False
            one.append(int(order[i]))
            free -= share[i]
        bins.append(one)
        waiting -= len(one)
    return bins


class Packer:
    """Takes documents' ids and gives finished pieces, sequence by sequence."""

    def __init__(self, first_sequence: int, tokens: int = TOKENS, segments: int = SEGMENTS,
                 loss_tokens: int = LOSS_TOKENS, with_ids: bool = False):
        self.tokens, self.with_ids = tokens, with_ids
        self.room = np.array([tokens, segments, loss_tokens], float)
        self.next = first_sequence
        self.rests: list[tuple[object, int, np.ndarray, int]] = []
        self.rows: list[tuple] = []

    def _put(self, doc, start: int, ids: np.ndarray, total: int, offset: int) -> None:
        self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset,
                          *([ids] if self.with_ids else [])))

    def add(self, doc, ids: np.ndarray) -> None:
        # a full sequence needs all loss-bearing tokens but its first
        step = int(min(self.tokens, self.room[2] + 1))
        whole = len(ids) // step
        for i in range(whole):
            self._put(doc, i * step, ids[i * step:(i + 1) * step], len(ids), 0)
            self.next += 1
        if len(ids) > whole * step:
            self.rests.append((doc, whole * step, ids[whole * step:], len(ids)))
        if len(self.rests) >= BUFFER:
            self.pack(last=False)

    def pack(self, last: bool) -> None:
        if not self.rests:
            return
        size = np.array([len(r[2]) for r in self.rests], float)
        demand = np.column_stack([size, np.ones(len(size)), size - 1])
        kept = []
        for one in fill(demand, self.room):
            used = int(size[one].sum())
            full = used >= FILLED * self.tokens
            if not full and len(one) >= self.room[1]:
                # full by segments: short rests, which need no padding if cut
                self._exact([self.rests[i] for i in one], used)
            elif full or (not last and len(kept) >= BUFFER // 2):
                offset = 0
                for i in one:
                    doc, start, ids, total = self.rests[i]
                    self._put(doc, start, ids, total, offset)
                    offset += len(ids)
                self.next += 1
            elif last:
                self._exact([self.rests[i] for i in one], used)
            else:
                kept += one
        self.rests = [self.rests[i] for i in kept]

    def _exact(self, rests: list, used: int) -> None:
        """Sequences of powers of two, largest first, cutting rests freely."""
        lengths = [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]
        offset, room = 0, lengths.pop(0)
        for doc, start, ids, total in rests:
            at = 0
            while at < len(ids):
                if room == 0:
                    self.next += 1
                    offset, room = 0, lengths.pop(0)
                n = min(room, len(ids) - at)
                self._put(doc, start + at, ids[at:at + n], total, offset)
                at, offset, room = at + n, offset + n, room - n
        self.next += 1

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


_COLUMNS = [("doc_id", None), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
            ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]


def pack(docs: DataFrame, tokenizer: str, tokens: int = TOKENS, segments: int = SEGMENTS,
         loss_tokens: int = LOSS_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of all ``docs(doc_id, text)``: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, and ``ids`` if ``with_ids``.

    With the default limits the one on loss-bearing tokens can not bind (a
    full sequence has fewer of them than tokens); a smaller one does.

    ``tokenizer``: path of a tokenizer file that every executor can read. A
    NULL or empty text is its end id alone. Each token but a piece's first is
    loss-bearing. Sequences are padded to ``tokens`` unless their length is a
    power of two. Every row is packed, repeated ids and rows included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_tokens(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 36, tokens, segments, loss_tokens, with_ids)
        end = np.array([END_ID], np.uint32)

        def made():
            rows = packer.take()
            if not rows:
                return
            columns = list(zip(*rows))
            kinds = [(n, k or doc_type) for n, k in _COLUMNS[:len(columns)]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, kinds)],
                                             [n for n, _ in kinds])

        doc_type = pa.int64()
        for b in text_slices(batches, "text"):
            doc_type = b.schema.field("doc_id").type
            ids, bounds = words.of(b.column(b.schema.get_field_index("text")))
            for i, doc in enumerate(b.column(b.schema.get_field_index("doc_id")).to_pylist()):
                packer.add(doc, np.concatenate([ids[bounds[i]:bounds[i + 1]], end]))
            yield from made()
        packer.pack(last=True)
        yield from made()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
              "offset bigint" + (", ids array<int>" if with_ids else ""))
    return docs.select("doc_id", F.col("text")).mapInArrow(released(run), schema)
