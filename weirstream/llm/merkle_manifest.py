"""Merkle manifest of a dataset: leaves of rows, a tree for each group, one tree over the groups' roots.

A parent is stored with its preimage, the concatenated hashes of its children. So a leaf needs one row for each
level above it: the siblings are the preimage without the leaf's own 64 characters, and a changed leaf is checked
by splicing its hash into that place and hashing again, level by level.

Texts are hashed where they are read; only hashes and ids are shuffled. Places in a group come from one range
partitioning of all leaves (a row's place in its partition, and the counts of the group's earlier partitions), so a
group of a third of all rows is many tasks' work. A parent gathers 16 children at most, and the paths from the root
are handed down one level at a time, to one row for each 16 leaves before leaves join them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstream.llm.common import persisted, shared_folder

#: Children of a parent, and hexadecimal characters of a hash.
SPAN, DIGITS = 16, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of the fields, each as byte count, colon and value, or a dash for null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _first(names: list[str]) -> list[Column]:
    return [F.col(n).asc_nulls_first() for n in names]


def in_order(rows: DataFrame, group: str, order: list[str], folder: str) -> DataFrame:
    """Adds tree (a number for each group, rising with it), pos (gapless from 0 in a group) and size (rows of the group).

    Nulls come first, in groups and in ``order``. Rows that are equal there are put in the order of reading.
    """
    keys = _first([group, *order])
    rows = rows.withColumn("__read", F.monotonically_increasing_id())  # equal rows need not meet in one partition
    keys.append(F.col("__read"))
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__read")
    # the number's upper bits are the partition, the lower 33 the row in it; written, so both are fixed
    placed = persisted(spread.withColumn("__at", F.monotonically_increasing_id()), "order", folder)
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part"), F.col(group).alias("__group")).agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    whole = Window.partitionBy("__group")
    before = F.sum("n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    # at most a row for each partition and each group; written, so its size decides whether it is broadcast
    starts = persisted(counts.select("__part", "__group", "__first", F.coalesce(before, F.lit(0)).alias("__before"), F.min("__first").over(whole).alias("tree"), F.sum("n").over(whole).alias("size")), "starts", folder)
    found = placed.join(starts, (part == F.col("__part")) & F.col(group).eqNullSafe(F.col("__group")))
    return found.withColumn("pos", F.col("__before") + F.col("__at") - F.col("__first")).drop("__at", "__part", "__group", "__first", "__before")


def grow(nodes: DataFrame, folder: str) -> list[DataFrame]:
    """The levels above nodes (tree, pos, size, hash): tree, pos, size (of the tree on this level), preimage, hash."""
    levels, most = [], nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        run = nodes.where("size > 1").groupBy("tree", F.expr(f"pos div {SPAN}").alias("pos"))
        # a run has 16 children at most
        run = run.agg(F.array_join(F.sort_array(F.collect_list(F.struct(F.col("pos").alias("child"), "hash")))["hash"], "").alias("preimage"), F.ceil(F.first("size") / SPAN).alias("size"))
        nodes = persisted(run.select("tree", "pos", "size", "preimage", F.sha2("preimage", 256).alias("hash")), "level", folder)
        levels.append(nodes)
        most = -(-most // SPAN)
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """What remains of each tree: (tree, hash); of a single node that node itself."""
    found = nodes.where("size = 1").select("tree", "hash")
    for level in levels:
        found = found.unionByName(level.where("size = 1").select("tree", "hash"))
    return found


def _under(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes with the steps from their parent to the root, and what else the parents' rows carry."""
    parent = above.withColumnsRenamed({"tree": "__tree", "pos": "__pos", "preimage": "__preimage"})
    found = nodes.join(parent, (F.col("tree") == F.col("__tree")) & (F.expr(f"pos div {SPAN}") == F.col("__pos")))
    step = F.array(F.struct(F.col("__preimage").alias("preimage"), (F.col("pos") % SPAN).cast("int").alias("slot")))
    return found.withColumn("steps", F.when(F.col("__preimage").isNull(), F.col("steps")).otherwise(F.concat(step, "steps"))).drop("__tree", "__pos", "__preimage")


def paths(nodes: DataFrame, levels: list[DataFrame], crown: DataFrame) -> DataFrame:
    """Nodes (tree, pos, ...) with steps: (preimage, slot) of each ancestor, the nearest first.

    ``crown`` has a row for each tree: the steps above its top, and columns that its nodes get.
    """
    above = None
    for level in reversed(levels):
        level = level.select("tree", "pos", "size", "preimage")
        here = level.where("size = 1").drop("size").join(crown, "tree")
        if above is not None:
            here = here.unionByName(_under(level.where("size > 1").drop("size"), above))
        above = here
    lone = crown.where("lone").select("tree", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("preimage"), *[c for c in crown.columns if c != "tree"])
    above = lone if above is None else above.unionByName(lone)
    return _under(nodes, above.drop("lone"))


@dataclass
class Manifest:
    """leaves: id, tree, pos, size, hash and other given columns; levels: their groups' parents; subroots: of the
    groups, with places in the tree over them; upper: that tree's parents; root: one row (null of no rows)."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    upper: list[DataFrame]
    folder: str

    def root(self) -> DataFrame:
        return tops(self.subroots, self.upper).agg(F.first("hash").alias("root"))


def build(leaves: DataFrame, group: str, order: list[str], folder: str | None = None) -> Manifest:
    """The trees of leaves (a column ``hash``, a group, columns that order the leaves of a group).

    Equal leaves of a group may change places without a change of any hash. Tables are written to ``folder``, the
    manifest; a null group is a group like any other and comes first.
    """
    folder = folder or shared_folder(leaves.sparkSession, "manifest")
    slim = persisted(leaves, "leaves", folder)  # the range partitioning reads it twice, texts once
    placed = in_order(slim, group, [*order, "hash"], folder)
    levels = grow(placed, folder)
    top = tops(placed, levels).withColumnRenamed("tree", "member").withColumn("forest", F.lit(0))
    subroots = in_order(top, "forest", ["member"], folder).drop("forest")
    return Manifest(placed, levels, subroots, grow(subroots, folder), folder)


def prove(manifest: Manifest, changed: Column) -> DataFrame:
    """Leaves with subroot, root, proof_sha256 (of the siblings from left to right, level by level), folded_root
    (of ``changed``, or where that is null the leaf, put in the leaf's place) and verified."""
    nothing = F.array().cast("array<struct<preimage:string,slot:int>>")
    # one row: the tree over the groups
    forest = tops(manifest.subroots, manifest.upper).select("tree", F.col("hash").alias("root"), F.lit(not manifest.upper).alias("lone"), nothing.alias("steps"))
    groups = paths(manifest.subroots, manifest.upper, forest)
    crown = groups.select(F.col("member").alias("tree"), F.col("hash").alias("subroot"), "root", "steps")
    lone = manifest.leaves.where("size = 1").select("tree", F.lit(True).alias("lone"))
    # a row for each group, read by every level
    crown = persisted(crown.join(lone, "tree", "left").withColumn("lone", F.coalesce("lone", F.lit(False))), "crown", manifest.folder)
    found = paths(manifest.leaves, manifest.levels, crown)

    def left(step: Column) -> Column:
        return step["preimage"].substr(F.lit(1), step["slot"] * DIGITS)

    def right(step: Column) -> Column:
        return step["preimage"].substr(step["slot"] * DIGITS + DIGITS + 1, F.lit(SPAN * DIGITS))

    proof = F.array_join(F.transform("steps", lambda s: F.concat(left(s), right(s))), "")
    folded = F.aggregate("steps", F.coalesce(changed, F.col("hash")), lambda h, s: F.sha2(F.concat(left(s), h, right(s)), 256))
    found = found.withColumns({"proof_sha256": F.sha2(proof, 256), "folded_root": folded})
    return found.withColumn("verified", F.col("folded_root") == F.col("root")).drop("steps")


def document_manifest(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Leaves of doc_id, source, lang, n_chars and text, in trees by source; a fifth of the rows is tampered with.

    Tampering (where 5 divides the checksum of the id) lower-cases A-Z of the text; a row whose text has none, a null
    text, a null id stay as they are. Null ids come first in their source; of equal ids the smaller leaf; equal rows
    have equal leaves. An empty table gives no rows. Other columns are not read. Returns doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified, source.
    """
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf_hash(*rest, F.translate("text", UPPER, LOWER)))
    leaves = docs.select("doc_id", "source", leaf_hash(*rest, F.col("text")).alias("hash"), tampered.alias("tampered"))
    found = prove(build(leaves, "source", ["doc_id"], folder), F.col("tampered"))
    return found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", "verified", "source")


def manifest_sql() -> str:
    """DuckDB: trees by recursion over levels, steps of a leaf by division of its place, folds by reduction."""
    field = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')".format
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    return f"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS __crc FROM bits WHERE k = 8
), docs AS (
  SELECT documents.*, row_number() OVER () AS rn, coalesce(
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: xor(c >> 8, __crc[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0, false) AS hit
  FROM documents, crc
), hashed AS (
  SELECT rn, doc_id, source, {leaf('text')} AS leaf, CASE WHEN hit THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf('text')} END AS tampered FROM docs
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM hashed
), nodes AS (
  SELECT source, 0 AS lvl, pos, size, leaf AS hash, NULL::VARCHAR AS pre FROM leaves
  UNION ALL
  SELECT source, lvl + 1, pos // {SPAN}, (max(size) + {SPAN - 1}) // {SPAN}, sha256(string_agg(hash, '' ORDER BY pos)), string_agg(hash, '' ORDER BY pos)
  FROM nodes WHERE size > 1 GROUP BY source, lvl, pos // {SPAN}
), subroots AS (
  SELECT source, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1
), upper AS (
  SELECT 0 AS lvl, pos, size, hash, NULL::VARCHAR AS pre FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // {SPAN}, (max(size) + {SPAN - 1}) // {SPAN}, sha256(string_agg(hash, '' ORDER BY pos)), string_agg(hash, '' ORDER BY pos)
  FROM upper WHERE size > 1 GROUP BY lvl, pos // {SPAN}
), steps AS (
  SELECT l.rn, 0 AS tier, n.lvl, n.pre, (l.pos // (16 ** (n.lvl - 1))::BIGINT) % {SPAN} AS slot
  FROM leaves l JOIN nodes n ON l.source IS NOT DISTINCT FROM n.source AND n.lvl > 0 AND n.pos = l.pos // (16 ** n.lvl)::BIGINT
  UNION ALL
  SELECT l.rn, 1, u.lvl, u.pre, (s.pos // (16 ** (u.lvl - 1))::BIGINT) % {SPAN}
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN upper u ON u.lvl > 0 AND u.pos = s.pos // (16 ** u.lvl)::BIGINT
), sides AS (
  SELECT rn, list(left(pre, slot * {DIGITS}) || '|' || substr(pre, slot * {DIGITS} + {DIGITS + 1}) ORDER BY tier, lvl) AS s FROM steps GROUP BY rn
), done AS (
  SELECT l.doc_id, l.source, l.leaf, r.hash AS subroot, (SELECT hash FROM upper WHERE size = 1) AS root,
    sha256(replace(array_to_string(coalesce(s, []), ''), '|', '')) AS proof_sha256,
    list_reduce(list_prepend(l.tampered, coalesce(s, [])), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
  FROM leaves l LEFT JOIN sides USING (rn) JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified, source FROM done"""
