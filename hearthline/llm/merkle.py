"""A manifest of a dataset: a hash tree per language, one root over all, and a proof per row.

Rows become leaves, each the SHA-256 of its values as ``byte count:value`` (``-`` if null).
Per language the leaves ascend by id; every two consecutive nodes become their hash until one
remains, the subroot. A last node without a partner is hashed alone. Subroots by language (null
first) give the root in the same way.

A parent keeps copies of its hash state before each child slot. Folding a leaf that may
have changed resumes the state of the slot it stands in, adds the replacement and the siblings to
the right only, and goes on with the digest in the parent above; nothing to the left is hashed again.

Ranks come from a range partitioning by language and id with offsets per partition. Nodes are
worked on in blocks of ``BLOCK`` consecutive ones, which are whole subtrees: going up, a block gives
its root, and block roots are nodes of the next round; going down, a block gets the steps from its
root to the top and gives each of its nodes the steps from there. No task holds more than a block,
whatever share of the rows a language has, and rounds grow with the logarithm of the rows.

Repeated rows and rows with the same id are leaves of their own, ordered by leaf digest; rows
without an id come first and are not tampered with. Further columns are ignored, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from hearthline.llm.common import column_set
from hearthline.session import staged

FANOUT = 2
BLOCK = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# A step on the way up: the place of the node in its run, and the digests of the others, in order.
Step = tuple[int, tuple[str, ...]]


class Parent:
    """A node over a run of children, with its hash states before each child slot."""

    __slots__ = ("states", "run", "digest")

    def __init__(self, run: Sequence[str]) -> None:
        state = hashlib.sha256()
        self.states = []
        self.run = run
        for child in run:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def replaced(self, slot: int, child: str) -> str:
        """Digest with another child in one slot: the state before it, and what is right of it."""
        state = self.states[slot].copy()
        state.update(child.encode())
        for sibling in self.run[slot + 1 :]:
            state.update(sibling.encode())
        return state.hexdigest()


def levels_of(nodes: Sequence[str], height: int | None, fanout: int = FANOUT) -> list[list[Parent]]:
    """Parents level by level, ``height`` levels of them or until one node remains."""
    levels: list[list[Parent]] = []
    while len(levels) < height if height is not None else len(nodes) > 1:
        parents = [Parent(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        levels.append(parents)
        nodes = [p.digest for p in parents]
    return levels


def packed_steps(steps: Sequence[Step], rest: str = "") -> str:
    own = " ".join(",".join((str(slot), *others)) for slot, others in steps)
    return f"{own} {rest}".strip()


def unpacked_steps(text: str) -> list[Step]:
    steps = [part.split(",") for part in text.split(" ")] if text else []
    return [(int(slot), tuple(others)) for slot, *others in steps]


def ancestors(steps: Sequence[Step], node: str) -> list[tuple[Parent, int]]:
    """Parents above a node with the slot it comes from, up to the root."""
    found = []
    for slot, others in steps:
        parent = Parent((*others[:slot], node, *others[slot:]))
        found.append((parent, slot))
        node = parent.digest
    return found


def folded(path: Sequence[tuple[Parent, int]], node: str) -> str:
    for parent, slot in path:
        node = parent.replaced(slot, node)
    return node


def _in_block(levels: list[list[Parent]], place: int, fanout: int = FANOUT) -> list[tuple[Parent, int]]:
    """Parents of one node of a block, with its slot in each."""
    found = []
    for parents in levels:
        found.append((parents[place // fanout], place % fanout))
        place //= fanout
    return found


def _steps_of(path: Sequence[tuple[Parent, int]]) -> list[Step]:
    return [(slot, (*parent.run[:slot], *parent.run[slot + 1 :])) for parent, slot in path]


def _height_of_block(block: int, fanout: int = FANOUT) -> int:
    height = 0
    while fanout**height < block:
        height += 1
    return height


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def ranked(rows: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """Add ``place``, from 0 in each group, and the group's ``size``, without a group in one task.

    Equal rows may come in any order; the table is staged before, so that places are given once.
    """
    apart = rows.withColumn("tie", F.monotonically_increasing_id())
    placed = apart.repartitionByRange(F.col(group), *order, F.col("tie")).withColumn("part", F.spark_partition_id())
    placed = staged(placed, "placed")
    counts = placed.groupBy(group, "part").agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        group, "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(whole).alias("size")
    )
    within = Window.partitionBy(group, "part").orderBy(*order, F.col("tie"))
    numbered = placed.withColumn("row", F.row_number().over(within) - 1)
    place = (F.col("offset") + F.col("row")).alias("place")
    return numbered.join(offsets, [group, "part"]).select(*rows.columns, place, "size")


def _levels(rows: pa.Table, block: int) -> list[list[Parent]]:
    """Parents within a block, in order of place.

    The block of a tree that has no other ends with one node; in larger trees all blocks are equally high.
    """
    size = rows["size"][0].as_py()
    return levels_of(rows["node"].to_pylist(), _height_of_block(block) if size > block else None)


def _blocks(nodes: DataFrame, block: int) -> GroupedData:
    return nodes.withColumn("block", F.floor(F.col("place") / F.lit(block))).groupBy("tree", "block")


def _roots(nodes: DataFrame, block: int) -> DataFrame:
    """The nodes one round up: (tree, place, node, size), one for each block."""

    def root(key: tuple[Any, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        levels = _levels(rows, block)
        top = levels[-1][0].digest if levels else rows["node"][0].as_py()
        size = -(-rows["size"][0].as_py() // block)
        return pa.table({"tree": [key[0].as_py()], "place": [key[1].as_py()], "node": [top], "size": [size]})

    return _blocks(nodes.select("tree", "place", "node", "size"), block).applyInArrow(
        root, "tree string, place long, node string, size long"
    )


def _rounds(nodes: DataFrame, block: int) -> list[DataFrame]:
    """Nodes round by round, until every tree has one."""
    rounds = [nodes]
    most = nodes.agg(F.max("size").alias("size")).first()["size"] or 0
    while most > 1:
        rounds.append(staged(_roots(rounds[-1], block), "nodes"))
        most = -(-most // block)
    return rounds


def _down(nodes: DataFrame, above: DataFrame, block: int) -> DataFrame:
    """(tree, place, steps, subroot) of every node, from those of the blocks' roots."""

    def steps(key: tuple[Any, ...], rows: pa.Table, top: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        levels = _levels(rows, block)
        rest = top["steps"][0].as_py()
        own = [packed_steps(_steps_of(_in_block(levels, i)), rest) for i in range(rows.num_rows)]
        many = rows.num_rows
        return pa.table(
            {"tree": [key[0].as_py()] * many, "place": rows["place"], "steps": own, "subroot": [top["subroot"][0].as_py()] * many}
        )

    tops = above.withColumnRenamed("place", "block").groupBy("tree", "block")
    grouped = _blocks(nodes.select("tree", "place", "node", "size"), block).cogroup(tops)
    return grouped.applyInArrow(steps, "tree string, place long, steps string, subroot string")


def _folds(leaves: DataFrame, above: DataFrame, block: int) -> DataFrame:
    """Leaves with subroot, root, proof and folded root; the steps above a block are hashed once."""
    kind = leaves.schema["id"].dataType.simpleString()

    def fold(key: tuple[Any, ...], rows: pa.Table, top: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        leaf_of = rows["node"].to_pylist()
        levels = _levels(rows, block)
        block_root = levels[-1][0].digest if levels else leaf_of[0]
        rest = ancestors(unpacked_steps(top["steps"][0].as_py()), block_root)
        root = rest[-1][0].digest if rest else block_root
        tail = "".join(d for _, others in _steps_of(rest) for d in others)
        proofs, roots = [], []
        for i, changed in enumerate(rows["changed"].to_pylist()):
            path = _in_block(levels, i)
            siblings = "".join(d for _, others in _steps_of(path) for d in others) + tail
            proofs.append(hashlib.sha256(siblings.encode()).hexdigest())
            roots.append(folded(path + rest, leaf_of[i] if changed is None else changed))
        many = rows.num_rows
        return pa.table(
            {
                "id": rows["id"],
                "leaf": rows["node"],
                "subroot": [top["subroot"][0].as_py()] * many,
                "root": [root] * many,
                "proof": proofs,
                "folded_root": roots,
            }
        )

    tops = above.withColumnRenamed("place", "block").groupBy("tree", "block")
    grouped = _blocks(leaves, block).cogroup(tops)
    return grouped.applyInArrow(
        fold, f"id {kind}, leaf string, subroot string, root string, proof string, folded_root string"
    )


def manifest(leaves: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root) of every leaf.

    Takes (id, lang, leaf, changed): the digest of a row as it was written down, and the one
    found now if that differs. ``proof`` is the digest of all siblings on the way to the root, and
    ``folded_root`` the root that the changed leaf leads to. ``block`` is a power of ``FANOUT``.
    """
    # '' sorts before every name, so null comes first.
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang")))
    rows = staged(leaves.select("id", tree.alias("tree"), F.col("leaf").alias("node"), "changed"), "leaves")
    rows = staged(ranked(rows, "tree", [F.col("id").asc_nulls_first(), F.col("node")]), "ranked")
    rounds = _rounds(rows, block)

    subroots = rounds[-1].select(F.lit("all").alias("tree"), F.col("tree").alias("name"), "node")
    subroots = staged(ranked(subroots, "tree", [F.col("name")]), "subroots")
    above = _rounds(subroots, block)

    steps = above[-1].select("tree", "place", F.lit("").alias("steps"), F.lit("").alias("subroot"))
    for nodes in reversed(above[:-1]):
        steps = staged(_down(nodes, steps, block), "steps")
    steps = subroots.join(steps, ["tree", "place"]).select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "steps", F.col("node").alias("subroot")
    )
    for nodes in reversed(rounds[1:-1]):
        steps = staged(_down(nodes, steps, block), "steps")
    return _folds(rows, steps, block)


def tampered(identity: Column) -> Column:
    """Whether the contract's tampering meets a row: 7 divides the CRC-32 of its id."""
    return F.coalesce(F.crc32(identity.cast("string")) % 7 == 0, F.lit(False))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents as they are, and after tampering adds 1 to some ``n_chars``."""
    docs = column_set(docs, *FIELDS)
    values = {name: F.col(name) for name in FIELDS}
    one_more = values | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    changed = F.when(tampered(F.col("doc_id")), leaf([one_more[n] for n in FIELDS]))
    own = leaf([values[n] for n in FIELDS])
    return docs.select(F.col("doc_id").alias("id"), "lang", own.alias("leaf"), changed.alias("changed"))


ORACLE = r"""
WITH RECURSIVE crc_bytes AS (
  SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) r(b)
), crc AS (
  SELECT list(v ORDER BY b) AS t FROM crc_bytes
), docs AS (
  SELECT row_number() OVER () AS id, doc_id, lang,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                         lambda c, k: xor(c >> 8, t[(xor(c, k) & 255) + 1])), 4294967295) % 7 = 0 AS tampered
  FROM documents, crc
), leaves AS (
  SELECT id, doc_id, lang,
         sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(CAST(n_chars + tampered::INT AS VARCHAR)) || ':' || (n_chars + tampered::INT), '-') || tail) AS changed
  FROM docs
), placed AS (
  SELECT *, coalesce('=' || lang, '') AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size
  FROM leaves
), nodes AS (
  SELECT 0 AS level, tree, place, leaf AS node, size FROM placed
  UNION ALL
  SELECT level + 1, tree, place // 2, sha256(string_agg(node, '' ORDER BY place)), (any_value(size) + 1) // 2
  FROM nodes WHERE size > 1 GROUP BY level, tree, place // 2
), subroots AS (
  SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM nodes WHERE size = 1
), tops AS (
  SELECT 0 AS level, place, node, size FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (any_value(size) + 1) // 2
  FROM tops WHERE size > 1 GROUP BY level, place // 2
), walk AS (
  SELECT id, tree, 0 AS level, place, size, changed AS node, '' AS proof FROM placed
  UNION ALL
  SELECT w.id, w.tree, w.level + 1, w.place // 2, (w.size + 1) // 2,
         sha256(CASE WHEN w.place % 2 = 0 THEN w.node || coalesce(n.node, '') ELSE n.node || w.node END), w.proof || coalesce(n.node, '')
  FROM walk w LEFT JOIN nodes n ON n.tree = w.tree AND n.level = w.level AND n.place = xor(w.place, 1)
  WHERE w.size > 1
), climb AS (
  SELECT w.id, s.node AS subroot, 0 AS level, s.place, s.size, w.node, w.proof
  FROM walk w JOIN subroots s ON s.tree = w.tree WHERE w.size = 1
  UNION ALL
  SELECT c.id, c.subroot, c.level + 1, c.place // 2, (c.size + 1) // 2,
         sha256(CASE WHEN c.place % 2 = 0 THEN c.node || coalesce(n.node, '') ELSE n.node || c.node END), c.proof || coalesce(n.node, '')
  FROM climb c LEFT JOIN tops n ON n.level = c.level AND n.place = xor(c.place, 1)
  WHERE c.size > 1
)
SELECT p.doc_id, p.leaf, c.subroot, t.node AS root, sha256(c.proof) AS proof_sha256, c.node AS folded_root, c.node = t.node AS verified
FROM placed p JOIN climb c ON c.id = p.id AND c.size = 1 JOIN tops t ON t.size = 1
"""
