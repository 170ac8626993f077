"""Exact top-k by inner product with dual-tree search over cover trees.

Queries and candidates are both indexed by a cover tree: a node's points lie within its radius of its
centre, and its children's centres, themselves points, are more than half that radius apart. A pair of
nodes is pruned when no inner product between their points can reach the worst kth score so far of the
queries in the query node. Equal scores go to the smaller id, so only strictly lower bounds prune.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

LEAF = 16
#: Rows of one candidate tree, and bytes of the vectors of one block of queries or candidates.
TREE, BLOCK_BYTES = 4096, 32 << 20
EXACT = 2**53


class Node:
    """A ball of points. Leaves hold their rows; inner nodes their children and the children's centres."""

    __slots__ = ("rows", "kids", "centre", "norm", "radius", "centres", "norms", "radii")

    def __init__(self, x: np.ndarray, squares: np.ndarray, rows: np.ndarray, centre: int, radius: float):
        self.rows, self.centre, self.norm, self.radius = rows, x[centre], float(np.sqrt(squares[centre])), radius
        self.kids: list[Node] = []
        if len(rows) <= LEAF or radius < 0.5:
            return
        # the next centre is the first point that no child covers yet; distances come 64 centres at a time
        rest = np.r_[centre, rows[rows != centre]]
        while len(rest):
            head = rest[:64]
            gap = np.sqrt(np.maximum(squares[head][:, None] + squares[rest] - 2 * (x[head] @ x[rest].T), 0))
            free = np.ones(len(rest), bool)
            for k, at in enumerate(head):
                if not free[k]:
                    continue
                own = free & (gap[k] <= radius / 2)
                own[k] = True
                free &= ~own
                near = np.flatnonzero(own)
                self.kids.append(Node(x, squares, rest[near], at, float(gap[k][near].max()) * (1 + 1e-9)))
            rest = rest[free]
        self.centres = np.array([k.centre for k in self.kids])
        self.norms = np.array([k.norm for k in self.kids])
        self.radii = np.array([k.radius for k in self.kids])


def tree(x: np.ndarray) -> Node:
    squares = np.einsum("ij,ij->i", x, x)
    gap = np.sqrt(np.maximum(squares + squares[0] - 2 * (x @ x[0]), 0))
    return Node(x, squares, np.arange(len(x)), 0, float(gap.max()) * (1 + 1e-9))


class Search:
    """Best k candidates of each query so far, kept while candidate trees come in.

    Rows are told apart by a number, candidates of equal score ordered by id, then by number.
    """

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, k: int):
        self.rows, self.vectors, self.k = rows, vectors, k
        self.x = vectors.astype(np.float64)
        self.root = tree(self.x)
        self.kth = np.full(len(rows), -np.inf)
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in rows]  # (-score, id, row), sorted
        self.work = 0  # inner products: of points, and of centres for bounds

    def add(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(ids):
            return
        width = max(vectors.shape[1], self.vectors.shape[1])
        wide = lambda v: np.pad(v, ((0, 0), (0, width - v.shape[1])))  # noqa: E731  a shorter vector ends in zeros
        if width > self.vectors.shape[1]:
            self.vectors = wide(self.vectors)
            self.x = self.vectors.astype(np.float64)
            self.root = tree(self.x)
        self.c_rows, self.c_ids, self.c = rows, ids, wide(vectors)
        self.y = self.c.astype(np.float64)
        reach = np.abs(self.x).max(initial=0) * np.abs(self.y).max(initial=0) * max(width, 1)
        self.small = reach < EXACT
        self.slack = 0.5 + 1e-9 * reach
        self.visit(self.root, tree(self.y))

    def worst(self, q: Node) -> float:
        return self.kth[q.rows].min()

    def visit(self, q: Node, r: Node) -> None:
        """All pairs of q's and r's children at once, or of the one that has children with the other."""
        if not r.kids and not q.kids:
            self.compare(q.rows, r.rows)
        elif not r.kids:
            self.work += len(q.kids)
            bound = q.centres @ r.centre + r.radius * q.norms + q.radii * (r.norm + r.radius) + self.slack
            for kid, b in zip(q.kids, bound):
                if b >= self.worst(kid):
                    self.visit(kid, r)
        elif not q.kids:
            self.work += len(r.kids)
            self.descend(q, r, r.centres @ q.centre + q.radius * r.norms + r.radii * (q.norm + q.radius) + self.slack)
        else:
            for at in range(0, len(q.kids), 512):
                some = slice(at, at + 512)
                self.work += len(q.kids[some]) * len(r.kids)
                bound = q.centres[some] @ r.centres.T + q.radii[some, None] * r.norms + (q.norms + q.radii)[some, None] * r.radii + self.slack
                for kid, row in zip(q.kids[some], bound):
                    self.descend(kid, r, row)

    def descend(self, q: Node, r: Node, bound: np.ndarray) -> None:
        """q against r's children, the most promising first, until no bound reaches the worst kth score."""
        order = np.flatnonzero(bound >= self.worst(q))
        order = order[np.argsort(-bound[order], kind="stable")]
        for at in range(0, len(order), 128):
            some = order[at : at + 128]
            some = some[bound[some] >= self.worst(q)]
            if not len(some):
                return  # the rest have lower bounds
            if not q.kids and (leaves := [r.kids[j].rows for j in some if not r.kids[j].kids]):
                self.compare(q.rows, np.concatenate(leaves))
            for j in some:
                kid = r.kids[j]
                if (kid.kids or q.kids) and bound[j] >= self.worst(q):
                    self.visit(q, kid)

    def compare(self, qs: np.ndarray, cs: np.ndarray) -> None:
        self.work += len(qs) * len(cs)
        if self.small:
            scores = self.x[qs] @ self.y[cs].T
        else:
            scores = self.vectors[qs].astype(object) @ self.c[cs].T.astype(object)
        ids, rows = self.c_ids[cs], self.c_rows[cs]
        for q, row in zip(qs, scores):
            hit = np.flatnonzero((row >= self.kth[q]) & (rows != self.rows[q]))
            if self.small and len(hit) > 4 * self.k:
                least = np.partition(row[hit], len(hit) - self.k)[len(hit) - self.k]
                hit = hit[row[hit] >= least]
            if len(hit):
                self.best[q] = sorted([*self.best[q], *((-int(row[i]), int(ids[i]), int(rows[i])) for i in hit)])[: self.k]
                if len(self.best[q]) == self.k:
                    self.kth[q] = -self.best[q][-1][0]


def whole_numbers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as long; null if the vector or a component is null or not finite."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def flat(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, longest) integers of a list column; shorter lists end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0))
    if len(flat) == width * len(lengths):
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def dealt(rows: DataFrame, name: str, blocks: int) -> DataFrame:
    """rows with the number of a block, by a hash of their row number."""
    return rows.withColumn(name, F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int"))


def top_k(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """vectors (vec_id long, v array<long>) -> query_id, rank (from 1), vec_id, score.

    Each query row against every other row; ties go to the smaller vec_id; fewer rows give fewer
    results. Null ids and vectors take no part. Rows that repeat a vec_id are queries and candidates of
    their own, also for each other, so a repeated query's ranks repeat. A shorter vector counts as ending
    in zeros. Scores beyond a long are cut to its ends. An empty table or query set gives no rows.

    Queries are a stated set. They and the candidates are dealt into blocks of bounded bytes, each pair
    of blocks is one task, in which a tree of the queries meets trees of candidates, and gives k rows a
    query. Vectors move once for each block of the other side; none of them reaches the driver.
    """
    spark = vectors.sparkSession
    own, _ = cut(vectors.filter("vec_id IS NOT NULL AND v IS NOT NULL").select("vec_id", "v", F.monotonically_increasing_id().alias("_row")))
    size = F.sum(8 * F.size("v") + 32)
    asked = own.filter(queries)
    bytes_asked, bytes_own = (df.agg(size).first()[0] or 0 for df in (asked, own))
    in_queries = max(1, -(-bytes_asked // BLOCK_BYTES))
    in_own = max(3 * spark.sparkContext.defaultParallelism, -(-bytes_own // BLOCK_BYTES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = dealt(asked, "q", in_queries).withColumn("c", every(in_own))
    right = dealt(own, "c", in_own).withColumn("q", every(in_queries))
    end = np.iinfo(np.int64)
    names = ["query_row", "query_id", "_row", "vec_id", "score"]

    def search(some: pa.Table, others: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if some.num_rows and others.num_rows:
            some, others = some.combine_chunks(), others.combine_chunks()
            ids = dict(zip(some["_row"].to_pylist(), some["vec_id"].to_pylist()))
            found = Search(some["_row"].to_numpy(), matrix(flat(some["v"])), k)
            for at in range(0, others.num_rows, TREE):
                part = others.slice(at, TREE)
                found.add(part["_row"].to_numpy(), part["vec_id"].to_numpy(), matrix(flat(part["v"])))
            out = [(int(q), ids[int(q)], row, i, min(max(-s, end.min), end.max)) for q, best in zip(found.rows, found.best) for s, i, row in best]
        columns = zip(*out) if out else ((),) * len(names)
        return pa.table([pa.array(x, pa.int64()) for x in columns], names)

    pairs = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(search, ", ".join(f"{x} long" for x in names))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "_row")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", whole_numbers(F.col("embedding")).alias("v"))
    return top_k(rows, F.col("vec_id") % 100 == 0, 10)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
