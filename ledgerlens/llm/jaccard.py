"""Near-duplicate join on word n-grams by rare-first prefix filtering.

Two documents link when the Jaccard similarity of their shingle sets is at
least ``NUMERATOR / DENOMINATOR``. All shingles have one global order, by
their count in the corpus (kept in hashed counters, so of a fixed size) and
then by hash; every order gives the same links, a rare-first one few
candidates. Documents with equal sets are one class and take part once. A
pair of classes can only link if it shares one of the first n - ceil(t n) + 1
shingles, so these are joined; the length, positional (rest of both sets after
the shared shingle) and suffix filter (shared counts in the parts of a hash
partition of both sets) drop pairs that cannot reach the overlap, and what is
left is verified once per pair on the whole sets.

To give components without all pairs of a large group, the first round
verifies each class against one leader per shared shingle (the class whose
rarest shingle is most frequent: the text others were copied from). The
second round joins all pairs whose classes are still in different components,
so no link between different texts that could change a component is left out;
a pair is made at its first common shingle, not again at every later one.
The number of links needs all of them: ``link_counts`` joins and verifies every
pair of classes that share a shingle, also inside a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import released, stage, text_slices, utf8
from .components import components
from .hashing import mix, shingles, word_hashes

WORDS = 5
NUMERATOR, DENOMINATOR = 4, 5
#: Hashed counters behind the global order, and rows they travel in.
COUNTERS, BLOCK = 1 << 21, 1 << 14
#: Parts of the hash partition behind the suffix filter.
PARTS = 64
#: Bits of the filter that picks the documents whose sets are needed.
PICK_BITS = 1 << 23
#: Classes with one shingle that a task pairs with another's.
HOT = 256
#: Shingles of a class, rarest first, that the second round knows it by.
EARLY = 8


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    raw, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
    hashes, bounds = shingles(*word_hashes(raw, offsets), WORDS)
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield np.unique(hashes[a:b])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for b in text_slices(batches, "text"):
        raw, offsets = utf8(b.column(0))
        hashes, _ = shingles(*word_hashes(raw, offsets), WORDS)
        total += np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (COUNTERS - 1), minlength=COUNTERS)
    for i in range(0, COUNTERS, BLOCK):
        part = total[i:i + BLOCK]
        if part.any():
            kind = np.int32 if part.max() < 2 ** 31 else np.int64
            yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.array([part.astype(kind).tobytes()])],
                                             ["block", "counts"])


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK, np.int64)
    for raw in pdf["counts"]:
        total += np.frombuffer(raw, np.int32 if len(raw) == 4 * BLOCK else np.int64)
    level = np.minimum(255, np.ceil(10 * np.log2(1 + total))).astype(np.uint8)
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "levels": [level.tobytes()]})


def frequency_levels(docs: DataFrame) -> np.ndarray:
    """Logarithmic count of each hashed counter over the whole corpus
    (``COUNTERS`` bytes, whatever the corpus)."""
    rows = (docs.select("text").mapInArrow(released(_count), "block int, counts binary")
            .groupBy("block").applyInPandas(_add, "block int, levels binary").collect())
    levels = np.zeros(COUNTERS, np.uint8)
    for r in rows:
        levels[r.block * BLOCK:(r.block + 1) * BLOCK] = np.frombuffer(r.levels, np.uint8)
    return levels


def _signatures(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for b in text_slices(batches, "text"):
            out = {k: [] for k in ("n", "d1", "d2", "level", "prefix", "parts")}
            for s in _sets(b):
                n = len(s)
                level = levels[(s >> np.uint64(20)).astype(np.int64) & (COUNTERS - 1)]
                order = np.argsort(level, kind="stable")
                keep = order[:n - -(-NUMERATOR * n // DENOMINATOR) + 1] if n else order
                digest = np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                out["n"].append(n)
                out["d1"].append(digest[0])
                out["d2"].append(digest[1])
                out["level"].append(int(level[keep[0]]) if n else 0)
                out["prefix"].append(s[keep].view(np.int64))
                out["parts"].append(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=PARTS).astype(np.int32)
                                    if n else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(out["n"], pa.int32()),
                 pa.array(out["d1"], pa.int64()), pa.array(out["d2"], pa.int64()), pa.array(out["level"], pa.int32()),
                 pa.array(out["prefix"], pa.list_(pa.int64())), pa.array(out["parts"], pa.list_(pa.int32()))],
                ["doc_id", *out])
    return run


SIGNATURE = "doc_id bigint, n int, d1 bigint, d2 bigint, level int, prefix array<bigint>, parts array<int>"


def signatures(docs: DataFrame) -> DataFrame:
    """Per document: set size, digest of the set, level of its rarest
    shingle, the rare-first prefix and the sizes of the set's parts."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs))
    return stage(docs.mapInArrow(released(_signatures(shared)), SIGNATURE), "signatures")


def _needed(n_a, n_b):
    """Least overlap of two sets that link."""
    return F.ceil((n_a + n_b) * NUMERATOR / (NUMERATOR + DENOMINATOR) - 1e-9)


def _possible(a: str, b: str):
    """Length and positional filter of two rows that share a shingle: what
    both can share is at most the shingles before it that any other class has
    in its prefix (``before``), itself, and the rest after it."""
    n_a, n_b, i, j, x, y = (F.col(f"{side}.{c}") for c in ("n", "pos", "before") for side in (a, b))
    return ((F.greatest(n_a, n_b) * NUMERATOR <= F.least(n_a, n_b) * DENOMINATOR)
            & (F.least(x, y) + 1 + F.least(n_a - i, n_b - j) - 1 >= _needed(n_a, n_b)))


def _pick(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        ids = whole.column(0).to_numpy(zero_copy_only=False)
        at = mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(PICK_BITS - 1)
        hit = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        for b in text_slices(iter([whole.filter(pa.array(hit.astype(bool)))]), "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in _sets(b)], pa.binary())],
                                             ["id", "items"])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = np.unique(mix(b.column(0).to_numpy().view(np.uint64)) & np.uint64(PICK_BITS - 1))
        byte, first = np.unique((at >> np.uint64(3)).astype(np.int32), return_index=True)
        if len(byte):
            mask = np.bitwise_or.reduceat((1 << (at & np.uint64(7)).astype(np.int32)).astype(np.int32), first)
            yield pa.RecordBatch.from_arrays([pa.array(byte), pa.array(mask)], ["byte", "mask"])


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, items): whole sets of at least the documents in ``ids``. The ids
    travel as a bit filter of a fixed size; a document that it lets through
    by chance only costs time."""
    rows = (ids.mapInArrow(_bits, "byte int, mask int").groupBy("byte").agg(F.bit_or("mask").alias("mask"))).collect()
    bits = np.zeros(PICK_BITS // 8, np.uint8)
    for r in rows:
        bits[r.byte] = r.mask
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def pick(batches):
        return _pick(batches, shared.value)

    return stage(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
                 .mapInArrow(released(pick), "id bigint, items binary"), "sets")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        left, right = batch.column(2), batch.column(3)
        for i in range(batch.num_rows):
            x = np.frombuffer(left[i].as_buffer(), np.uint64)
            y = np.frombuffer(right[i].as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum()) if len(y) else 0
            keep[i] = both * DENOMINATOR >= NUMERATOR * (len(x) + len(y) - both) and both > 0
        yield batch.select([0, 1]).filter(pa.array(keep))


def verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that link: suffix filter, then one exact
    comparison of the whole sets."""
    part = classes.select("id", "n", "parts")
    rows = (pairs.join(part.toDF("a", "n_a", "p_a"), "a").join(part.toDF("b", "n_b", "p_b"), "b")
            .where(F.aggregate(F.zip_with("p_a", "p_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
                   >= _needed(F.col("n_a"), F.col("n_b"))))
    rows = stage(rows.select("a", "b"), "pairs")
    items = _sets_of(docs, rows.select("a").union(rows.select("b")).distinct())
    full = (rows.join(items.toDF("a", "x"), "a").join(items.toDF("b", "y"), "b").select("a", "b", "x", "y"))
    return full.mapInArrow(released(_verify), "a bigint, b bigint").distinct()


def prefixes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures, classes, shared). ``classes``: id (smallest doc_id), set
    size, digest; ``shared``: their prefix shingles that another class has in
    its prefix."""
    sig = signatures(docs)
    classes = stage(sig.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n", "level", "prefix", "parts"))), "classes")
    grams = classes.select("id", "n", "level", F.posexplode("prefix").alias("pos", "g"))
    common = grams.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g")
    earlier = Window.partitionBy("id").orderBy("pos")  # a class's prefix: no more than its shingles
    shared = stage(grams.join(common, "g").withColumn("before", F.row_number().over(earlier) - 1), "shared")
    return sig, classes, shared


def link_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures, classes, edges): ``edges(a, b)`` are verified links between
    classes, enough to connect every component."""
    sig, classes, shared = prefixes(docs)
    rank = F.col("level").cast("bigint") * (1 << 52) + F.pmod(F.xxhash64("id"), F.lit(1 << 52))
    leaders = shared.groupBy("g").agg(*(F.max_by(c, rank).alias(c) for c in ("id", "n", "pos", "before")))
    star = (shared.alias("m").join(leaders.alias("l"), "g")
            .where((F.col("m.id") != F.col("l.id")) & _possible("m", "l"))
            .select(F.least("m.id", "l.id").alias("a"), F.greatest("m.id", "l.id").alias("b")).distinct())
    first = stage(verify(docs, star, classes), "links")
    known = components(first)
    rows = stage(shared.join(known, "id", "left")
                 .select("g", "id", "n", "pos", "before", F.coalesce("component", "id").alias("component"),
                         F.col("level")), "rows")
    head = rows.groupBy("g").agg(F.max_by("component", rank).alias("main"), F.min("component").alias("lo"),
                                 F.max("component").alias("hi")).where("lo <> hi").select("g", "main")
    # one shuffle by class: its rows in order, each with the few before it
    mixed = rows.join(head, "g").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "g", "n", "before", "component", "main"))).alias("own"))
    mixed = mixed.select("id", F.transform(F.slice("own", 1, EARLY), lambda x: x["g"]).alias("early"), F.posexplode("own").alias("k", "x"))
    mixed = stage(mixed.select("id", "x.*", F.slice("early", F.lit(1), F.least("k", F.lit(EARLY))).alias("early")), "mixed")
    others = mixed.where(F.col("component") != F.col("main"))
    # a pair meets at its first common shingle; later ones that both know to
    # have a common one before them do not make it again
    rest = (others.alias("m").join(mixed.alias("l"), "g")
            .where((F.col("m.component") != F.col("l.component"))
                   & ((F.col("l.component") == F.col("l.main")) | (F.col("m.id") < F.col("l.id")))
                   & _possible("m", "l") & ~F.arrays_overlap("m.early", "l.early"))
            .select(F.least("m.id", "l.id").alias("a"), F.greatest("m.id", "l.id").alias("b")).distinct())
    second = verify(docs, rest, classes)
    return sig, classes, stage(first.union(second), "links")


def all_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures, classes, edges): ``edges(a, b)`` are all links between
    classes. The rows of a shingle that many classes share are dealt out, so
    that no task pairs more than ``HOT`` of them with the others."""
    sig, classes, shared = prefixes(docs)
    many = shared.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("many"))
    rows = stage(shared.join(many, "g").drop("level"), "rows")
    left = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    right = rows.withColumn("part", F.pmod(F.hash("id"), F.col("many")))
    pairs = (left.alias("m").join(right.alias("l"), ["g", "part"])
             .where((F.col("m.id") < F.col("l.id")) & _possible("m", "l"))
             .select(F.col("m.id").alias("a"), F.col("l.id").alias("b")).distinct())
    return sig, classes, stage(verify(docs, pairs, classes), "links")


def link_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_links for every row of ``docs``: how many other documents link
    with it, copies of its own text included. Documents without words and rows
    with a NULL doc_id link with nothing; rows that share a doc_id and a text
    are one document."""
    sig, classes, edges = all_links(docs)
    sizes = (sig.where("n > 0 and doc_id is not null").groupBy("d1", "d2")
             .agg(F.countDistinct("doc_id").alias("size")))
    sized = stage(classes.select("d1", "d2", "id").join(sizes, ["d1", "d2"]), "sizes")
    others = (edges.select("a", "b").union(edges.select("b", "a")).toDF("id", "other")
              .join(sized.select(F.col("id").alias("other"), "size"), "other")
              .groupBy("id").agg(F.sum("size").alias("others")))
    counted = sized.join(others, "id", "left").select(
        "d1", "d2", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    joined = sig.select("doc_id", "d1", "d2").join(counted, ["d1", "d2"], "left")
    return joined.select("doc_id", F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0)))
                         .cast("bigint").alias("n_links"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    component_id is the smallest doc_id reachable by links, the document's
    own included; a document without words has no shingles and links with
    nothing. Rows with a NULL doc_id link with nothing and have a NULL
    component; rows that share a doc_id are one document."""
    sig, classes, edges = link_classes(docs)
    named = (classes.select("d1", "d2", "id").join(components(edges), "id", "left")
             .select("d1", "d2", F.coalesce("component", "id").alias("component")))
    joined = sig.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    return joined.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"),
                         F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, with
    their columns. Of rows that share a doc_id one stays; rows with a NULL
    doc_id all stay."""
    groups = stage(near_duplicates(docs), "groups")
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    again = stage(groups.where("doc_id is not null").groupBy(F.col("doc_id").alias("_again"))
                  .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_again"), "repeated")
    if again.isEmpty():
        return kept
    single = kept.join(again, F.col("doc_id") == F.col("_again"), "left_anti")
    return single.unionByName(kept.join(again, F.col("doc_id") == F.col("_again"), "left_semi").dropDuplicates(["doc_id"]))


ORACLE_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * c >= 80 * (s.n + t.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN comp c ON c.a = d.doc_id
"""

#: The links themselves, by the same SQL.
LINKS_SQL = ORACLE_SQL[:ORACLE_SQL.index("SELECT d.doc_id, coalesce(s.n")] + """\
SELECT d.doc_id, coalesce(g.n, 0) AS n_links FROM documents d LEFT JOIN degree g ON g.a = d.doc_id
"""
