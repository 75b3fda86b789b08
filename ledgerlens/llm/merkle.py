"""Merkle manifest of a dataset by nested-struct rollup.

Leaves are ranked inside their tree (a tree per value of ``lang``) by one range
shuffle and the counts of its partitions, so a tree that holds most rows is
spread like any other. A rank's octal digits become columns. Inside bounded
blocks of ``FANOUT ** DIGITS`` consecutive nodes the digit columns are grouped
away one after another, lowest first, each time nesting the children's structs
in their parent's and hashing their digests; one shuffle by block serves all of
a block's groupings. The blocks' own digests are the nodes of the next tier,
until a tree is one block; the trees' digests are rolled up likewise.

Proofs come from the nested structs alone: a tier's blocks are transformed and
exploded digit by digit, highest first, each child taking its siblings left and
right of it in front of the path it was given. What a block inherits from the
tier above is grouped into it with a union; no rows are joined for proofs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

FANOUT_BITS, DIGITS = 3, 4
FANOUT, BLOCK_BITS = 1 << FANOUT_BITS, FANOUT_BITS * DIGITS
PATH = "array<struct<left:string,right:string>>"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for NULL, else the value's length in UTF-8 bytes, ``:``, value."""
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s), F.lit(":"), s))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def ranked(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes(tree, ...)`` staged, with ``rank`` (from 0) inside their tree by
    ``order`` (NULLs first) and ``n``, their tree's size. Rows equal in all of
    ``order`` are ranked in some order."""
    keys = ["tree", *order]
    # equal rows may lie in any order, so a number splits groups of them
    spread = nodes.withColumn("_split", F.monotonically_increasing_id())
    lined = spread.repartitionByRange(*keys, "_split").sortWithinPartitions(*keys, "_split").drop("_split")
    # partition number and place inside it, in one long
    lined = stage(lined.withColumn("_at", F.monotonically_increasing_id()), name)
    lined = lined.select("*", F.shiftright("_at", 33).alias("_part"),
                         F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")).drop("_at")
    runs = lined.groupBy("tree", "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("tree")
    runs = runs.select(F.col("tree").alias("_tree"), F.col("_part").alias("_run"), "_first",
                       (F.sum("_rows").over(whole.orderBy("_part")) - F.col("_rows")).alias("_before"),
                       F.sum("_rows").over(whole).alias("n"))
    placed = lined.join(runs, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_run")))
    return (placed.withColumn("rank", F.col("_before") + F.col("_place") - F.col("_first"))
            .drop("_tree", "_part", "_run", "_first", "_before", "_place"))


def _above(n: Column, levels: int) -> Column:
    """Nodes ``levels`` levels above ``n`` nodes."""
    return F.shiftright(n + F.lit((1 << FANOUT_BITS * levels) - 1), FANOUT_BITS * levels)


def roll_up(nodes: DataFrame) -> DataFrame:
    """One row per block of ``nodes(tree, rank, n, hash, payload)``: tree, rank
    among the tree's blocks, n of the tier below, hash, and ``kids``, the
    nested structs of its nodes."""
    digits = [f"d{i}" for i in range(DIGITS)]
    rows = nodes.select(
        "tree", "n", F.shiftright("rank", BLOCK_BITS).alias("block"), "hash", F.col("payload").alias("kids"),
        *[F.shiftright("rank", FANOUT_BITS * i).bitwiseAND(F.lit(FANOUT - 1)).cast("int").alias(d) for i, d in enumerate(digits)])
    rows = rows.repartition("tree", "block")
    for level in range(DIGITS):
        kids = F.array_sort(F.collect_list(F.struct(F.col(digits[level]).alias("digit"), "hash", "kids")))
        rows = rows.groupBy("tree", "n", "block", *digits[level + 1:]).agg(kids.alias("kids"))
        # a tree that is down to one node has its digest already
        rows = rows.withColumn("hash", F.when(
            _above(F.col("n"), level) > 1, F.sha2(F.array_join(F.transform("kids", lambda k: k["hash"]), ""), 256))
            .otherwise(F.get("kids", F.lit(0))["hash"]))
    return rows.select("tree", F.col("block").alias("rank"), "n", "hash", "kids")


def unfold(blocks: DataFrame) -> DataFrame:
    """The nodes of ``blocks(tree, rank, n, kids, path, top)``: tree, rank,
    hash, payload, path from the node to the root, top."""
    rows = blocks.select("tree", "rank", "n", "kids", "path", "top")
    for level in reversed(range(DIGITS)):
        hashes = F.transform("kids", lambda k: k["hash"])
        step = F.explode(F.transform(F.col("kids"), lambda k, i: F.struct(
            k["digit"].alias("digit"), k["hash"].alias("hash"), k["kids"].alias("kids"),
            F.struct(F.array_join(F.slice(F.col("hashes"), F.lit(1), i), "").alias("left"),
                     F.array_join(F.slice(F.col("hashes"), i + 2, F.lit(FANOUT)), "").alias("right")).alias("beside"))))
        rows = rows.withColumn("hashes", hashes).select("tree", "rank", "n", "path", "top", step.alias("kid"))
        rows = rows.select(
            "tree", (F.shiftleft("rank", FANOUT_BITS) + F.col("kid.digit")).alias("rank"), "n", F.col("kid.kids").alias("kids"),
            F.when(_above(F.col("n"), level) > 1, F.concat(F.array("kid.beside"), F.col("path"))).otherwise(F.col("path")).alias("path"),
            "top", F.col("kid.hash").alias("hash"))
    return rows.select("tree", "rank", "hash", F.col("kids").alias("payload"), "path", "top")


def _tiers(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Staged blocks, tier by tier, until each tree is one block."""
    size = nodes.agg(F.max("n")).first()[0] or 0
    tiers = [stage(roll_up(nodes), f"{name}-0")]
    while size > 1 << BLOCK_BITS:
        size = (size + (1 << BLOCK_BITS) - 1) >> BLOCK_BITS
        below = tiers[-1]
        up = below.select("tree", "rank", _above(F.col("n"), DIGITS).alias("n"), "hash", F.lit(None).cast("int").alias("payload"))
        tiers.append(stage(roll_up(up), f"{name}-{len(tiers)}"))
    return tiers


def _given(blocks: DataFrame, inherited: DataFrame) -> DataFrame:
    """``blocks`` with the path and top of ``inherited(tree, rank, path,
    top)``, by a union that is grouped."""
    kids, top = blocks.schema["kids"].dataType, inherited.schema["top"].dataType
    both = blocks.select("tree", "rank", "n", "kids", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast(top).alias("top")).union(
        inherited.select("tree", "rank", F.lit(None).cast("bigint"), F.lit(None).cast(kids), "path", "top"))
    return both.groupBy("tree", "rank").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", "top")])


def proofs(leaves: DataFrame) -> DataFrame:
    """Per row of ``leaves(tree, key, leaf, payload)``: tree, leaf, payload,
    subroot, root and ``path``, the siblings left and right at each level from
    the leaf up through its tree's subroot to the root.

    Leaves ascend by key, then leaf, inside their tree (NULL keys first; equal
    rows are as many leaves); trees ascend by name, NULL (a tree of its own)
    first. A tree of one leaf has that leaf as subroot, a lone tree's subroot
    is the root, and a table without rows gives no rows."""
    nodes = ranked(leaves.select("tree", "key", F.col("leaf").alias("hash"), "payload"), ["key", "hash"], "merkle-leaves")
    tiers = _tiers(nodes, "merkle-tier")
    trees = tiers[-1].select(F.lit(0).alias("tree"), F.struct(F.col("tree").alias("name")).alias("payload"), "hash")
    trees = trees.withColumn("name", F.col("payload.name"))
    forest = _tiers(ranked(trees, ["name"], "merkle-trees"), "merkle-root")
    at = forest[-1].select("tree", "rank", "n", "kids", F.array().cast(PATH).alias("path"), F.col("hash").alias("top"))
    for below in reversed(forest[:-1]):
        at = _given(below, unfold(at).select("tree", "rank", "path", "top"))
    at = unfold(at).select(F.col("payload.name").alias("tree"), F.lit(0).cast("bigint").alias("rank"), "path",
                           F.struct(F.col("hash").alias("subroot"), F.col("top").alias("root")).alias("top"))
    for blocks in reversed(tiers):
        at = unfold(_given(blocks, at.select("tree", "rank", "path", "top")))
    return at.select("tree", F.col("hash").alias("leaf"), "payload", F.col("top.subroot").alias("subroot"),
                     F.col("top.root").alias("root"), "path")


def fold(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def siblings_hash(path: str = "path") -> Column:
    """Digest of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root, proof digest and verification of each row of
    documents, as it stands or tampered with: where 3 divides crc32 of the
    decimal id, the text's A-Z are lower-cased before the leaf is computed
    again. NULL values have a code of their own, so a NULL and an empty text
    differ; a NULL id is never tampered with; other columns are ignored."""
    values = [F.col(c) for c in COLUMNS]
    plain = leaf_hash(values)
    changed = leaf_hash([F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in COLUMNS])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("key"), plain.alias("leaf"),
                         F.struct(F.col("doc_id"), F.when(hit, changed).alias("claim")).alias("payload"))
    checked = proofs(leaves).select(
        F.col("payload.doc_id").alias("doc_id"), "leaf", "subroot", "root", siblings_hash().alias("proof_sha256"),
        fold(F.coalesce("payload.claim", "leaf")).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT row_number() OVER () AS r, doc_id, lang,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    text, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
      lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)) AS bytes FROM documents),
checks AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b:
      list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) for i in range(8)]), lambda x, z:
        xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS crc FROM rows_),
leaves AS (
  SELECT r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' ||
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS claim FROM checks),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS rank,
    count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree AS (
  SELECT lang, 0 AS level, rank, n, leaf AS hash FROM placed
  UNION ALL
  SELECT lang, level + 1, rank // 8, (n + 7) // 8, sha256(string_agg(hash, '' ORDER BY rank))
  FROM tree WHERE n > 1 GROUP BY lang, level, rank // 8, n),
subroots AS (
  SELECT lang, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n
  FROM tree WHERE n = 1),
forest AS (
  SELECT 0 AS level, rank, n, subroot AS hash FROM subroots
  UNION ALL
  SELECT level + 1, rank // 8, (n + 7) // 8, sha256(string_agg(hash, '' ORDER BY rank))
  FROM forest WHERE n > 1 GROUP BY level, rank // 8, n),
climb AS (
  SELECT p.r, 0 AS part, t.level, string_agg(t.hash, '' ORDER BY t.rank) FILTER (t.rank < p.rank // CAST(8 ** t.level AS BIGINT)) AS l,
    string_agg(t.hash, '' ORDER BY t.rank) FILTER (t.rank > p.rank // CAST(8 ** t.level AS BIGINT)) AS g
  FROM placed p JOIN tree t ON t.lang IS NOT DISTINCT FROM p.lang AND t.n > 1
    AND t.rank // 8 = p.rank // CAST(8 ** (t.level + 1) AS BIGINT) GROUP BY p.r, t.level
  UNION ALL
  SELECT p.r, 1, t.level, string_agg(t.hash, '' ORDER BY t.rank) FILTER (t.rank < s.rank // CAST(8 ** t.level AS BIGINT)),
    string_agg(t.hash, '' ORDER BY t.rank) FILTER (t.rank > s.rank // CAST(8 ** t.level AS BIGINT))
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN forest t ON t.n > 1
    AND t.rank // 8 = s.rank // CAST(8 ** (t.level + 1) AS BIGINT) GROUP BY p.r, t.level),
steps AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY part, level) AS step, coalesce(l, '') AS l, coalesce(g, '') AS g FROM climb),
folded AS (
  SELECT r, 0 AS step, coalesce(claim, leaf) AS hash FROM placed
  UNION ALL
  SELECT f.r, f.step + 1, sha256(s.l || f.hash || s.g) FROM folded f JOIN steps s ON s.r = f.r AND s.step = f.step + 1),
proof AS (SELECT r, sha256(string_agg(l || g, '' ORDER BY step)) AS proof FROM steps GROUP BY r)
SELECT p.doc_id, p.leaf, s.subroot, root.hash AS root, coalesce(pr.proof, sha256('')) AS proof_sha256,
  f.hash AS folded_root, f.hash = root.hash AS verified
FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
JOIN (SELECT hash FROM forest WHERE n = 1) root ON true
LEFT JOIN proof pr ON pr.r = p.r
JOIN (SELECT r, arg_max(hash, step) AS hash FROM folded GROUP BY r) f ON f.r = p.r
"""
