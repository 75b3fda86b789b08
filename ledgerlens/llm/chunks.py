"""Substring deduplication by content-defined chunking.

A gear rolling hash runs over a text's bytes; a chunk ends where the top bits
of the hash of the last ``WINDOW`` bytes are zero, so an insertion moves only
the chunks around it. Chunks are short (at least ``LEAST`` and at most ``MOST``
bytes, 36 on average), since up to the first common cut of a repeated passage,
and after the last, nothing of it is found. Chunks with equal digests are
copies; the copy in the document with the smallest id (there the first)
stays. Copies are removed where a run of neighbouring repeated chunks has at
least ``RUN`` bytes, ``SAME`` of them first seen in one document, so that short
phrases that texts share by chance stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_slices, utf8

#: A chunk ends at one position in 2 ** CUT_BITS.
CUT_BITS, LEAST, MOST = 4, 20, 256
WINDOW = 16
RUN, SAME = 160, 96
GEAR = np.random.default_rng(31337).integers(0, 2 ** WINDOW, 256, dtype=np.uint16)


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte, of the ``WINDOW`` bytes that end there."""
    h = GEAR[raw]
    for s in (1, 2, 4, 8):
        h[s:] = h[s:] + (h[:-s] << np.uint16(s))
    return h


def cuts(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Per text, the ends of its chunks (relative to the text)."""
    after = np.zeros(len(raw), bool)
    if len(raw):
        after = (gear_hashes(raw) >> np.uint16(WINDOW - CUT_BITS)) == 0
        # a chunk does not end inside a character
        after[:-1] &= (raw[1:] & 0xC0) != 0x80
    spots = np.flatnonzero(after) + 1
    lo, hi = np.searchsorted(spots, offsets[:-1], "right"), np.searchsorted(spots, offsets[1:], "left")
    out = []
    for a, b, x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lo.tolist(), hi.tolist()):
        if a == b:
            out.append(np.zeros(0, np.int64))
            continue
        ends, last = [], a
        for e in spots[x:y].tolist() + [b]:
            # the hash of the first bytes would hold bytes before the text
            if e != b and (e - last < LEAST or e - a < WINDOW):
                continue
            while e - last > MOST:
                last += MOST
                while (raw[last] & 0xC0) == 0x80:
                    last -= 1
                ends.append(last)
            ends.append(e)
            last = e
        out.append(np.array(ends, np.int64) - a)
    return out


#: 64-bit digests: a chance equality is one chunk, never a run.
CHUNKS = "doc_id bigint, start int, size int, digest bigint, again boolean"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches, "text"):
        ids = b.column(b.schema.get_field_index("doc_id")).cast(pa.int64())
        raw, offsets = utf8(b.column(b.schema.get_field_index("text")))
        data = raw.tobytes()
        owner, start, size, digests, again = [], [], [], [], []
        for i, ends in enumerate(cuts(raw, offsets)):
            base, last, seen = int(offsets[i]), 0, set()
            for e in ends.tolist():
                d = blake2b(data[base + last:base + e], digest_size=8).digest()
                again.append(d in seen)
                seen.add(d)
                digests.append(d)
                start.append(last)
                size.append(e - last)
                last = e
            owner.append(np.full(len(ends), i))
        if digests:
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.concatenate(owner))), pa.array(start, pa.int32()), pa.array(size, pa.int32()),
                 pa.array(np.frombuffer(b"".join(digests), np.int64)), pa.array(again)], [c.split()[0] for c in CHUNKS.split(", ")])


def chunk_table(docs: DataFrame) -> DataFrame:
    """The chunks of all ``docs(doc_id, text)``: place, size, digest, and
    whether the same text has the chunk before."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_chunks, CHUNKS)


def repeated(chunks: DataFrame) -> DataFrame:
    """The chunks that are copies of an earlier one (all but the first of the
    document with the smallest id, ``source``). ``chunks`` must be staged."""
    known = chunks.where(F.col("doc_id").isNotNull())
    first = (known.groupBy("digest").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.max("again").alias("twice"))
             .where(F.col("twice") | (F.col("source") < F.col("last"))).select("digest", "source"))
    return (known.join(first, "digest").where(F.col("again") | (F.col("doc_id") != F.col("source")))
            .select("doc_id", "start", "size", "source"))


def _cut(schema_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            marks = b.column(b.schema.get_field_index("_copies")).to_pylist()
            out, spans, gone = [], [], []
            for text, copies in zip(texts, marks):
                raw = text.encode() if text and copies else b""
                kept, told, last, n = [], [], 0, 0
                for a, e in _runs(copies or []) if raw else ():
                    kept.append(raw[last:a].decode())
                    begin = (told[-1][1] if told else 0) + len(kept[-1])
                    told.append((begin, begin + len(raw[a:e].decode())))
                    last, n = e, n + e - a
                out.append("".join(kept) + raw[last:].decode() if told else text)
                spans.append(",".join(f"{x}:{y}" for x, y in told))
                gone.append(n)
            made = {"text": pa.array(out, pa.string()), "removed": pa.array(spans, pa.string()),
                    "removed_bytes": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else b.column(b.schema.get_field_index(n))
                                              for n in schema_names], schema_names)
    return run


def _runs(copies: list[dict]) -> list[tuple[int, int]]:
    """Bytes of the runs of neighbouring copies that are long enough."""
    out: list[tuple[list[int], Counter]] = []
    for start, size, source in sorted({(c["start"], c["size"], c["source"]) for c in copies}):
        if not out or out[-1][0][1] != start:
            out.append(([start, start], Counter()))
        out[-1][0][1] = start + size
        out[-1][1][source] += size
    return [(a, e) for (a, e), of in out if e - a >= RUN and max(of.values()) >= SAME]


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, plus ``removed`` (spans
    ``start:end`` of the old text in code points, comma-joined) and
    ``removed_bytes``.

    Every row stays; NULL and empty texts stay as they are. Rows with a NULL
    doc_id are neither cut nor a reason to cut others. Rows that share a
    doc_id count as one document. Columns named ``removed`` or ``removed_bytes``
    give way to the result's."""
    docs = docs.drop("removed", "removed_bytes")
    chunks = stage(chunk_table(docs), "chunks")
    copies = repeated(chunks).groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.struct("start", "size", "source"))).alias("_copies"))
    joined = docs.join(copies.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    names = [*docs.columns, "removed", "removed_bytes"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(_cut(names), f"{schema}, removed string, removed_bytes bigint")
