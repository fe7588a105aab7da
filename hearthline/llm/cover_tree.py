"""Exact top-k inner products by dual-tree search over cover trees.

Both a shard of the data and a block of queries are indexed by a cover tree: a node
has a centre and a radius that covers all below it, and children whose centres are taken
farthest-first until they cover it at half the radius. The two trees are searched together.
For centres q, p with radii r, s no query and vector below two nodes have a product above

    q.p + r |p| + s |q| + r s,

so a pair of nodes is dropped when that is below the worst kth score of the query group.
The kth scores of one shard hold for the next. Pairs of leaves are compared by one matrix
product, and so are larger nodes where the bounds of the leaves below them would drop little.
Nothing is approximate: bounds carry a margin above the rounding of doubles, ties at the
kth score are never pruned, and products in single precision only tell, with a margin above
their rounding, which queries have nothing to gain; scores are exact integers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame

from hearthline.llm.vectors import Best, query_blocks, search

LEAF = 64
# Queries of one matrix product, and the share that bounds of leaves must drop to be worth following.
# Up to so many candidates a query are multiplied one by one.
ROWS = 512
FEW = 16
DROPPED = 0.25
SCALE = 1024
NONE = np.iinfo(np.int64).min + 1


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    items: np.ndarray
    children: list[Node] = field(default_factory=list)
    norm: float = 0.0
    below: Leaves | None = None


class Leaves:
    """What the bounds of all leaves below a node need, as arrays."""

    def __init__(self, node: Node) -> None:
        found, waiting = [], [node]
        while waiting:
            at = waiting.pop()
            waiting += at.children
            found += [] if at.children else [at]
        self.centres = np.array([x.centre for x in found])
        self.radii = np.array([x.radius for x in found])
        self.norms = np.array([x.norm for x in found])
        self.counts = np.array([len(x.items) for x in found])
        self.starts = np.cumsum(self.counts) - self.counts
        self.items = np.concatenate([x.items for x in found])


def leaves(node: Node) -> Leaves:
    if node.below is None:
        node.below = Leaves(node)
    return node.below


def build(points: np.ndarray, items: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Cover tree over the rows of points; equal points end in one leaf of any size."""
    items = np.arange(len(points)) if items is None else items
    own = points[items]
    centre = own.mean(axis=0)
    apart = np.sqrt(((own - centre) ** 2).sum(axis=1))
    node = Node(centre, float(apart.max()), items, norm=float(np.sqrt(centre @ centre)))
    if len(items) <= leaf or node.radius == 0:
        return node
    owner = np.zeros(len(items), np.int64)
    chosen = int(apart.argmax())
    nearest = np.sqrt(((own - own[chosen]) ** 2).sum(axis=1))
    number = 0
    # Far-apart points in many dimensions all become centres at half the radius, so the
    # number of children is bounded by what keeps leaves filled; radii stay exact.
    most = max(2, min(16, len(items) // leaf))
    while nearest.max() > node.radius / 2 and number + 1 < most:
        number += 1
        chosen = int(nearest.argmax())
        away = np.sqrt(((own - own[chosen]) ** 2).sum(axis=1))
        closer = away < nearest
        owner[closer], nearest[closer] = number, away[closer]
    groups = [items[owner == i] for i in range(number + 1)]
    if len(groups) < 2 or max(map(len, groups)) == len(items):
        return node
    node.children = [build(points, g, leaf) for g in groups if len(g)]
    return node


def _largest(vectors: np.ndarray) -> float:
    return float(np.abs(vectors).max()) if vectors.size else 0.0


class Search:
    """Best k of the data for each query; data may come shard by shard."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.best = Best(len(queries), k, NONE)
        self.margin = 1e-9
        self.largest = _largest(queries)
        self.turn_to(ids, data)

    def turn_to(self, ids: np.ndarray, data: np.ndarray) -> None:
        """Go on with other data; what was found stays."""
        self.ids, self.data = ids, data
        self.most = _largest(data) * self.largest * data.shape[1]
        self.ordered = bool((ids[1:] > ids[:-1]).all())
        # Twice what single precision may be off, for a query and a vector of length one.
        self.slack = 2 * (data.shape[1] + 4) * 2.0**-24 * float(np.sqrt((data * data).sum(axis=1).max(initial=0)))

    def products(self, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Exact integer products: in doubles where none can round, else in integers.

        A score beyond a long has no place in the result and is an error.
        """
        asked, data = self.queries[rows], self.data[own]
        if self.most < 2.0**53:
            return (asked @ data.T).astype(np.int64)
        if self.most < 2.0**63:
            return asked.astype(np.int64) @ data.astype(np.int64).T
        whole = np.frompyfunc(int, 1, 1)
        exact = whole(asked) @ whole(data).T
        if (np.abs(exact) >= (1 << 63) - 1).any():
            raise OverflowError("a score is beyond the range of a long")
        return exact.astype(np.int64)

    def worst(self, node: Node) -> int:
        return self.best.scores[node.items, -1].min()

    def bound(self, asked: Node, node: Node) -> float:
        middle = float(asked.centre @ node.centre)
        around = asked.radius * node.norm + node.radius * asked.norm + asked.radius * node.radius
        return middle + around + self.margin * (asked.norm * node.norm + around + 1)

    def dropped(self, asked: Node, node: Node) -> float:
        """Share of the products below two nodes that the bounds of their leaves would drop now."""
        q, p = leaves(asked), leaves(node)
        around = np.outer(q.radii, p.norms) + np.outer(q.norms, p.radii) + np.outer(q.radii, p.radii)
        bounds = q.centres @ p.centres.T + around + self.margin * (np.outer(q.norms, p.norms) + around + 1)
        worst = np.minimum.reduceat(self.best.scores[q.items, -1], q.starts)
        return float(q.counts @ (bounds < worst[:, None]) @ p.counts) / (len(q.items) * len(p.items))

    def compare(self, asked: Node, node: Node) -> None:
        own = node.items
        single = self.data[own].astype(np.float32).T if self.most < 2.0**53 else None
        for at in range(0, len(asked.items), ROWS):
            rows = asked.items[at : at + ROWS]
            if single is None:
                self.take(rows, own)
                continue
            queries = self.queries[rows]
            near = queries.astype(np.float32) @ single
            need = (self.best.scores[rows, -1] - self.slack * np.sqrt((queries * queries).sum(axis=1))).astype(np.float32)
            gain = np.flatnonzero(near.max(axis=1) >= need)
            row, place = np.divmod(np.flatnonzero(near[gain] >= need[gain][:, None]), len(own))
            if len(row) > FEW * len(gain):
                self.take(rows[gain], own)
            elif len(row):
                row, place = gain[row], own[place]
                scores = np.einsum("ij,ij->i", queries[row], self.data[place]).astype(np.int64)
                row, ids = rows[row], self.ids[place]
                last, name = self.best.scores[row, -1], self.best.found[row, -1]
                better = ((scores > last) | ((scores == last) & (ids < name))) & (self.query_ids[row] != ids)
                if better.any():
                    self.best.add(row[better], ids[better], scores[better])

    def take(self, rows: np.ndarray, own: np.ndarray) -> None:
        """Add what is better than the kth found, or as good with a smaller id."""
        scores = self.products(rows, own)
        scores[self.query_ids[rows][:, None] == self.ids[own][None, :]] = NONE
        last, name = self.best.scores[rows, -1][:, None], self.best.found[rows, -1][:, None]
        better = (scores > last) | ((scores == last) & (scores > NONE) & (self.ids[own][None, :] < name))
        many = np.flatnonzero(better.sum(axis=1) > self.k) if self.ordered else []
        if len(many):
            some = np.where(better[many], scores[many], NONE)
            least = np.partition(some, -self.k, axis=1)[:, -self.k][:, None]
            above, level = some > least, some == least
            room = self.k - above.sum(axis=1)[:, None]
            better[many] = above | (level & (np.cumsum(level, axis=1) <= room))
        row, place = np.nonzero(better)
        if len(row):
            self.best.add(rows[row], self.ids[own][place], scores[row, place])

    def visit(self, asked: Node, node: Node) -> None:
        worst = self.worst(asked)
        if self.bound(asked, node) < worst:
            return
        if not asked.children and not node.children or worst > NONE and self.dropped(asked, node) < DROPPED:
            self.compare(asked, node)
        elif asked.children and (not node.children or asked.radius > node.radius):
            for child in asked.children:
                self.visit(child, node)
        else:
            for child in sorted(node.children, key=lambda c: -self.bound(asked, c)):
                self.visit(asked, child)


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer products for each query, exactly.

    Components are floor(scale * x). Ties go to the smaller id; a query is never its own
    result. Vectors that are null or hold null or non-finite components take no part, nor do
    rows without an id. Repeated rows count once; an id with several
    vectors stands for several candidates.
    """

    def begin(query_ids: np.ndarray, asked: np.ndarray) -> tuple:
        asked *= scale
        np.floor(asked, out=asked)
        blocks = [build(asked, rows) for rows in query_blocks(len(asked))]
        job = Search(query_ids[:0], asked[:0], query_ids, asked, k)

        def meet(ids: np.ndarray, data: np.ndarray) -> None:
            data = np.floor(scale * data)
            job.turn_to(ids, data)
            tree = build(data)
            for block in blocks:
                job.visit(block, tree)

        return meet, job.best.results

    return search(vectors, queries, k, begin, "long", id_col, vector_col)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, v.e) DESC, v.vec_id) AS rank
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
) WHERE rank <= 10
"""
