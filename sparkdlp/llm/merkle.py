"""A Merkle manifest of a table: one digest a row, trees of fan-out eight by language, and a root over all of them.

Only every third level of a tree is stored. The nodes between are those of aligned subtrees of 512 stored nodes at
most; building a stored level computes them in the row of their subtree and keeps the top alone. Proofs go from the
top down: a subtree's missing nodes are computed again from its stored descendants, every descendant gets its
siblings on the way up, followed by those of the subtree's top, and the nodes are dropped. Proofs are never
shuffled: they are joined to subtrees, and each leaf's is used in the row that makes it.

Places of leaves come from a range partitioning by language and id, whose partitions are counted; a language that
holds most rows, or one id that does, is spread like the others.

Defined cases: a null in any hashed column is the text ``-``. A null language is a group of its own, first in order.
Leaves ascend by id (null first), rows of one id by leaf; repeated rows have equal leaves in neighbouring places and
a proof each. A group of one row has its leaf as subroot; the only group's subroot is the root. A null id is never
drawn for tampering. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdlp.functions.text import settle
from sparkdlp.llm.common import fresh, saved, small

FAN = 8
#: Levels from one stored level to the next.
LEVELS = 3
SPAN = FAN**LEVELS
HASHED = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "struct<left:string,right:string>"


def digest(*inputs: Column) -> Column:
    """Lower-case hex SHA-256 of all inputs, one after the other."""
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest of a row of documents, with some columns changed."""
    return digest(*(field(changed.get(name, F.col(name))) for name in HASHED))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with two more columns: n, the rows of their group, and pos, their place in it from 0."""
    salt, mark = fresh("salt", rows.columns), fresh("mark", rows.columns)
    keys = [F.asc_nulls_first(c) for c in (group, *order, salt)]
    # The salt lets range borders fall between rows that are equal in all else.
    sorted_ = rows.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(salt)
    placed = saved(sorted_.withColumn(mark, F.monotonically_increasing_id()))
    part = F.shiftright(mark, 33)
    # One row for each partition and group in it: as many as there are partitions and groups, not rows.
    runs = placed.groupBy(part.alias("run_part"), F.col(group).alias("run_group")).agg(F.min(mark).alias("run_first"), F.count("*").alias("size"))
    whole = Window.partitionBy("run_group")
    earlier = whole.orderBy("run_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "run_part", "run_group", "run_first", F.sum("size").over(whole).alias("n"),
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("run_before"),
    )
    joined = placed.join(small(saved(starts), 128), F.col(group).eqNullSafe(F.col("run_group")) & (part == F.col("run_part")))
    return joined.select(*rows.columns, "n", (F.col(mark) - F.col("run_first") + F.col("run_before")).alias("pos"))


def runs_of(nodes: Column) -> Column:
    """The level above: the digest of every eight nodes."""
    last = F.floor((F.size(nodes) - 1) / FAN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: digest(F.array_join(F.slice(nodes, i * FAN + 1, F.lit(FAN)), "")))


def subtrees(nodes: DataFrame, *payload: str) -> DataFrame:
    """One row per aligned subtree of 512 nodes: tree, n, chunk, items (pos, digest, payload), and levels l0 to l3.

    A level that the tree does not have any more repeats the one below it.
    """
    item = F.struct("pos", "digest", *payload)
    # Places differ, so that nothing behind them is compared.
    chunks = nodes.groupBy("tree", "n", F.floor(F.col("pos") / SPAN).alias("chunk")).agg(F.array_sort(F.collect_list(item), _by_place).alias("items"))
    out = settle(chunks.withColumn("l0", F.col("items")["digest"]), "items", "l0")
    for level in range(LEVELS):
        nodes_, above = f"l{level}", f"l{level + 1}"
        # Each level is fixed before the next reads it, once per run.
        out = settle(out.withColumn(above, F.when(F.col("n") > FAN**level, runs_of(F.col(nodes_))).otherwise(F.col(nodes_))), above)
    return out


def _by_place(a: Column, b: Column) -> Column:
    return (a["pos"] - b["pos"]).cast("int")


def stored_levels(leaves: DataFrame) -> list[DataFrame]:
    """The stored levels above numbered leaves (tree, n, pos, digest), up to the one that has only tops of trees."""
    out, level = [], leaves
    while (level.agg(F.max("n")).first()[0] or 1) > 1:
        tops = subtrees(level.select("tree", "n", "pos", "digest"))
        level = saved(tops.select("tree", F.ceil(F.col("n") / SPAN).cast("bigint").alias("n"), F.col("chunk").alias("pos"), F.get("l3", F.lit(0)).alias("digest")))
        out.append(level)
    return out


def _split(nodes: Column, at: Column) -> Column:
    """The siblings of the node at a place, left and right of it in its run."""
    here = at % FAN
    left = F.slice(nodes, at - here + 1, here)
    right = F.slice(nodes, at + 2, F.lit(FAN - 1) - here)
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def _if_level(level: int, step: Column) -> Column:
    return F.when(F.col("n") > FAN**level, F.array(step)).otherwise(F.array().cast(f"array<{STEP}>"))


def proofs(nodes: DataFrame, above: DataFrame, *payload: str) -> DataFrame:
    """tree, pos, digest, payload, and for each node its path (siblings from its level to the root), subroot and root.

    ``above`` has path, subroot and root of every node of the stored level above (tree, pos), whose nodes are the
    tops of the subtrees of ``nodes``.
    """
    chunks = subtrees(nodes, *payload)
    up = above.select(F.col("tree").alias("up_tree"), F.col("pos").alias("up_pos"), F.col("path").alias("up"), "subroot", "root")
    chunks = chunks.join(up, F.col("tree").eqNullSafe(F.col("up_tree")) & (F.col("chunk") == F.col("up_pos")))
    # First the runs with what lies above them, then the nodes of a run with their siblings in it.
    higher = lambda i: F.concat(
        _if_level(1, _split(F.col("l1"), i)), _if_level(2, _split(F.col("l2"), F.floor(i / FAN).cast("int"))), "up"
    )
    last = F.floor((F.size("items") - 1) / FAN).cast("int")
    run = lambda i: F.struct(F.slice("items", i * FAN + 1, F.lit(FAN)).alias("members"), higher(i).alias("path"))
    out = chunks.select("tree", "n", "subroot", "root", F.inline(F.transform(F.sequence(F.lit(0), last), run)))
    out = out.select("tree", "n", "subroot", "root", "path", F.col("members")["digest"].alias("siblings"), F.posexplode("members").alias("at", "m"))
    own = _if_level(0, _split(F.col("siblings"), F.col("at")))
    return out.select("tree", "m.*", F.concat(own, "path").alias("path"), "subroot", "root")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, start, lambda so_far, step: digest(step["left"], so_far, step["right"]))


def drawn(doc_id: Column) -> Column:
    """A third of the rows, by the checksum of the id in decimal."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _tops(level: DataFrame) -> DataFrame:
    """The tree over all subroots, ordered by group: path, subroot and root for each group's top (tree, pos)."""
    subroots = level.select(F.lit(0).alias("all"), F.col("tree").alias("of"), "digest")
    leaves = saved(numbered(subroots, "all", ["of"]).select(F.col("all").alias("tree"), "n", "pos", "digest", "of"))
    levels = [leaves, *stored_levels(leaves)]
    none = F.array().cast(f"array<{STEP}>")
    # Without any level above its only node, a tree's root is that node.
    out = levels[-1].select("tree", "pos", none.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for below in reversed(levels[:-1]):
        out = proofs(below, out, *[c for c in below.columns if c == "of"])
    if "of" not in out.columns:
        out = leaves.select("of", "digest", none.alias("path"), F.col("digest").alias("root"))
    return out.select(F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "path", F.col("digest").alias("subroot"), "root")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row.

    A drawn third of the rows is folded from the leaf of a text whose letters A to Z were made small.
    """
    tampered = F.when(drawn(F.col("doc_id")), leaf(text=F.translate("text", UPPER, LOWER)))
    rows = docs.select("doc_id", F.col("lang").alias("tree"), leaf().alias("digest"), tampered.alias("tampered"))
    # Saved first: a range partitioning reads its rows twice, and the texts are to be hashed once.
    leaves = saved(numbered(saved(rows), "tree", ["doc_id", "digest"]))
    levels = [leaves, *stored_levels(leaves)]
    above = saved(_tops(levels[-1]))
    for below in reversed(levels[1:-1]):
        above = saved(proofs(below, above))
    if len(levels) > 1:
        out = proofs(leaves, above, "doc_id", "tampered")
    else:  # every group has one row, its own subroot
        out = leaves.join(above.drop("pos"), leaves["tree"].eqNullSafe(above["tree"])).drop(above["tree"])
    out = out.withColumn("folded_root", folded(F.coalesce("tampered", "digest"), F.col("path")))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return settle(
        out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root"),
        "folded_root",
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: The checksum that draws rows, bit by bit over the id's digits.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, i: xor(d >> 1, (d & 1) * 3988292384))), 4294967295::BIGINT)"""
_FIELDS = "\n  || ".join(
    f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars")
)
_TEXT = "coalesce(octet_length(encode({0})) || ':' || {0}, '-')"

SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang AS tree, sha256({_FIELDS} || {_TEXT.format("text")}) AS leaf,
         CASE WHEN {_CRC} % 3 = 0
              THEN sha256({_FIELDS} || {_TEXT.format(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS tampered
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY tree) AS n
  FROM hashed
), nodes AS (
  SELECT 0 AS level, tree, n, pos, leaf AS digest FROM leaves
  UNION ALL
  SELECT level + 1, tree, (n + 7) // 8, pos // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY level, tree, n, pos // 8
), subroots AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, n, pos, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, (n + 7) // 8, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, n, pos // 8
), steps AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.tree IS NOT DISTINCT FROM b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8
  WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos
), top_steps AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM tops a JOIN tops b ON a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.level, a.pos
), climbed AS (
  SELECT 0 AS level, tree, pos AS own, pos, coalesce(tampered, leaf) AS digest, '' AS seen FROM leaves
  UNION ALL
  SELECT c.level + 1, c.tree, c.own, c.pos // 8, sha256(s.l || c.digest || s.r), c.seen || s.l || s.r
  FROM climbed c JOIN steps s ON c.tree IS NOT DISTINCT FROM s.tree AND c.level = s.level AND c.pos = s.pos
), at_top AS (
  SELECT 0 AS level, c.tree, c.own, s.pos, c.digest, c.seen
  FROM (SELECT tree, own, arg_max(digest, level) AS digest, arg_max(seen, level) AS seen FROM climbed GROUP BY tree, own) c
  JOIN subroots s ON c.tree IS NOT DISTINCT FROM s.tree
  UNION ALL
  SELECT c.level + 1, c.tree, c.own, c.pos // 8, sha256(s.l || c.digest || s.r), c.seen || s.l || s.r
  FROM at_top c JOIN top_steps s ON c.level = s.level AND c.pos = s.pos
)
SELECT l.doc_id, l.leaf, s.subroot, t.digest AS root, sha256(f.seen) AS proof_sha256, f.digest AS folded_root,
       f.digest = t.digest AS verified
FROM leaves l
JOIN subroots s ON l.tree IS NOT DISTINCT FROM s.tree
JOIN (SELECT tree, own, arg_max(digest, level) AS digest, arg_max(seen, level) AS seen FROM at_top GROUP BY tree, own) f
  ON l.tree IS NOT DISTINCT FROM f.tree AND l.pos = f.own
CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t
"""
