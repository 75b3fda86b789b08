"""Benchmark decontamination by greedy string tiling.

Texts are read as lower-cased words without punctuation. Documents and test
items meet on shared seeds (runs of ``MIN_MATCH`` words). For each document
and item that share one, running Karp-Rabin matching tiles the item: windows
of the present search length that start at seeds are looked up by rolling
hash, matches are extended to their full length over unmarked words, the
longest non-overlapping ones are marked, and the search length is halved until
it reaches ``MIN_MATCH``. An item is found in a document when the tiles cover
at least ``COVERAGE`` of its words, in whatever order they stand.

The items travel to the tasks in blocks whose size is checked
(``BLOCK_BYTES``); a larger benchmark takes more passes over the same stream
of documents, with no shuffle of the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, text_slices, utf8
from .hashing import ALNUM, TERM, mix, word_hashes

MIN_MATCH = 5
COVERAGE = 0.6
BLOCK_BYTES = 32 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(*utf8(pc.utf8_lower(column.fill_null(""))), ALNUM)


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the run of ``k`` words at each start (none if too few)."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j:j + n] * TERM[j]
    return mix(out)


class Rolling:
    """Karp-Rabin hashes of any window of a word sequence."""

    def __init__(self, words: np.ndarray):
        power = np.ones(len(words) + 1, np.uint64)
        power[1:] = _BASE
        self.power = np.cumprod(power)
        self.back = np.cumprod(np.where(np.arange(len(words) + 1) > 0, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64(1)))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * self.power[:-1])])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[starts + length] - self.sums[starts]) * self.back[starts]


def tile(item: np.ndarray, text: np.ndarray, starts: np.ndarray, least: int,
         rolling: Rolling | None = None) -> list[tuple[int, int, int]]:
    """Tiles (text start, item start, length) of greedy string tiling.

    ``starts``: positions of ``text`` where a run of ``least`` words of the
    item begins; every tile begins and stays on such positions' matches."""
    n, m = len(item), len(text)
    free_item, free_text = np.ones(n, bool), np.ones(m, bool)
    own, other = Rolling(item), rolling or Rolling(text)
    tiles = []
    length = max(least, min(n, 2 * least))
    while True:
        longest = length
        found: list[tuple[int, int, int]] = []
        windows: dict[int, list[int]] = {}
        for j, h in enumerate(own.at(np.arange(max(0, n - length + 1)), length).tolist()):
            windows.setdefault(h, []).append(j)
        here = starts[starts + length <= m]
        here = here[free_text[here]]
        for i, h in zip(here.tolist(), other.at(here, length).tolist()):
            for j in windows.get(h, ()):
                if i and j and text[i - 1] == item[j - 1] and free_text[i - 1] and free_item[j - 1]:
                    continue  # part of the match that starts one word before
                size = 0
                while (i + size < m and j + size < n and text[i + size] == item[j + size]
                       and free_text[i + size] and free_item[j + size]):
                    size += 1
                if size >= length:
                    found.append((size, i, j))
                    longest = max(longest, size)
        again = False
        for size, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if free_text[i:i + size].all() and free_item[j:j + size].all():
                tiles.append((i, j, size))
                free_text[i:i + size] = False
                free_item[j:j + size] = False
            else:
                again = True  # what is left of it may still hold a match
        if not again:
            if length == least:
                return sorted(tiles)
            length = max(least, length // 2)


class Items:
    """The items of one block: words, seeds by run length, and a bit table
    over seed hashes that passes by most of a text quickly."""

    def __init__(self, ids: list[int], words: list[np.ndarray]):
        self.ids, self.words = ids, words
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, w in enumerate(words):
            if len(w):
                k = min(MIN_MATCH, len(w))
                by_length.setdefault(k, []).append((np.unique(_runs(w, k)), i))
        for k, parts in by_length.items():
            hashes = np.concatenate([p for p, _ in parts])
            owner = np.concatenate([np.full(len(p), i) for p, i in parts])
            order = np.argsort(hashes, kind="stable")
            table = np.zeros(1 << 20, bool)
            table[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.seeds[k] = (hashes[order], owner[order], table)

    def matches(self, words: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, float, list]]]:
        """By text number: (item, coverage, tiles) of the items found."""
        out: dict[int, list] = {}
        for k, (hashes, owner, table) in self.seeds.items():
            runs = _runs(words, k)
            at = np.flatnonzero(table[(runs >> np.uint64(44)).astype(np.int64)])
            doc = np.searchsorted(bounds, at, side="right") - 1
            inside = at + k <= bounds[doc + 1]
            at, doc = at[inside], doc[inside]
            lo, hi = np.searchsorted(hashes, runs[at], "left"), np.searchsorted(hashes, runs[at], "right")
            hit = hi > lo
            groups: dict[tuple[int, int], list[int]] = {}
            for a, d, x, y in zip(at[hit].tolist(), doc[hit].tolist(), lo[hit].tolist(), hi[hit].tolist()):
                for z in range(x, y):
                    groups.setdefault((d, int(owner[z])), []).append(a - int(bounds[d]))
            rolling: tuple[int, Rolling] | None = None
            for (d, i), starts in sorted(groups.items()):
                # tiles can not cover more than the seeds' runs do
                if (len(set(starts)) + k - 1) * k < COVERAGE * len(self.words[i]):
                    continue
                text = words[bounds[d]:bounds[d + 1]]
                if rolling is None or rolling[0] != d:
                    rolling = (d, Rolling(text))
                tiles = tile(self.words[i], text, np.array(starts), k, rolling[1])
                covered = sum(t[2] for t in tiles) / len(self.words[i])
                if covered >= COVERAGE:
                    out.setdefault(d, []).append((self.ids[i], covered, tiles))
        return out


FOUND = "array<struct<item_id:bigint,coverage:double,tiles:array<struct<start:int,item_start:int,words:int>>>>"
_FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()),
                             ("tiles", pa.list_(pa.struct([("start", pa.int32()), ("item_start", pa.int32()),
                                                           ("words", pa.int32())])))]))


def _find(shared, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value)
        for b in text_slices(batches, "text"):
            words, bounds = _words(b.column(b.schema.get_field_index("text")))
            found = items.matches(words, bounds)
            before = b.column(b.schema.get_field_index(column))
            if found:
                rows = before.to_pylist()
                for d, hits in found.items():
                    rows[d] = rows[d] + [{"item_id": i, "coverage": c, "tiles": [
                        {"start": t[0], "item_start": t[1], "words": t[2]} for t in ts]} for i, c, ts in hits]
                before = pa.array(rows, _FOUND)
            yield pa.RecordBatch.from_arrays(
                [before if f.name == column else b.column(i) for i, f in enumerate(b.schema)], b.schema.names)
    return run


def find_items(docs: DataFrame, benchmark: DataFrame, column: str = "_found_items") -> DataFrame:
    """``docs`` with a column of the items found in each text: item_id,
    coverage and tiles (word positions). Every row is kept, in place; NULL and
    empty texts and items without words hold or match nothing. ``column`` must
    be a new name."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"),
                             F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    size = bench.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    out = docs.withColumn(column, F.array().cast(FOUND))
    for i in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        rows = sorted((r.item_id, r.text) for r in part.collect())
        words, bounds = _words(pa.array([r[1] for r in rows], pa.string()))
        shared = spark.sparkContext.broadcast(
            ([r[0] for r in rows], [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])]))
        out = out.mapInArrow(released(_find(shared, column)), out.schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: contaminated, number of items found, largest coverage,
    their ids and their tiles as ``item:start:words`` (comma-joined)."""
    found = find_items(docs.select("doc_id", "text"), benchmark)
    items = F.array_sort(F.transform("_found_items", lambda x: x["item_id"]))
    tiles = F.flatten(F.transform("_found_items", lambda x: F.transform(
        x["tiles"], lambda t: F.concat_ws(":", x["item_id"], t["start"], t["words"]))))
    return found.select(
        "doc_id", (F.size("_found_items") > 0).alias("contaminated"),
        F.size("_found_items").cast("bigint").alias("n_items"),
        F.coalesce(F.array_max(F.transform("_found_items", lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"),
        F.concat_ws(",", items).alias("item_ids"), F.concat_ws(",", tiles).alias("tiles"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their columns."""
    return find_items(docs, benchmark).where(F.size("_found_items") == 0).drop("_found_items")
