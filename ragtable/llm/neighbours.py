"""Approximate nearest neighbours by cosine: NN-descent and greedy graph search (operator 13).

Index. Rows with equal vectors are one node (its smallest vec_id), so a vector
in a third of all rows is one. Every node keeps ``NEIGHBOURS`` neighbours:

1. Start: nodes are sorted ``TABLES`` times by the signs of random projections;
   each block of ``BLOCK`` nodes in that order is compared within itself.
2. NN-descent: a neighbour's neighbour is likely a neighbour. A round joins each
   node's neighbours, and a hashed choice of ``REVERSE`` nodes that have it as
   theirs, among each other: pairs with a new edge, nearer than the farthest
   neighbour of one of them, are its candidates. Rounds are Spark joins on node
   ids; they end when under ``DELTA`` of the edges are new.

Search. A query starts at its own node, if its vector is in the index, and at
``PIVOTS`` nodes of least hash. A hop expands the ``EXPAND`` nearest unexpanded
nodes among its ``BEAM`` nearest, along edges and some back edges, for all
queries in one join, until no query has one left. The ``RERANK`` nearest are
ranked by exact cosine of the original vectors.

Compared are unit vectors of 16-bit floats. Nodes are dealt to parts of about
``PART`` (queries: ``QUERY_PART``) by hash, and a vector goes to a part once,
however many edges there ask for it; a task holds the vectors of one part at a
time, at most (``NEIGHBOURS`` + ``REVERSE``) * ``PART``. A pair of query and node
is scored once. The driver sees counts and the ids of the pivots only.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do null vec_ids, nor vectors of another length than
most rows have (ties: the greater length); of several vectors of one vec_id
the least (by array order) counts; rows that repeat count once; a query's own
vec_id is never its result; with fewer candidates than k all are returned; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import let
from ..session import cut_lineage
from .shared_tables import SharedTable

NEIGHBOURS = 24
REVERSE = 16
TABLES = 4
BLOCK = 256
ROUNDS = 12
DELTA = 0.1
#: nodes and queries whose vectors a task holds at a time, with those that their edges name
PART = 256
QUERY_PART = 4
PIVOTS = 64
BEAM = 256
EXPAND = 128
HOPS = 40
RERANK = 64
SEED = 42
_EDGE = "u long, v long, s float, new boolean"


def usable_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, embedding array<double>), one row for each vec_id that takes part."""
    e = rows[vector].cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    found = rows.select(rows[id_column].cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & fine)
    sizes = found.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found.where(F.size("embedding") == (sizes["d"] if sizes else 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _units(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column, as float16."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float16)


def _binary(units: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in units], pa.binary())


def _matrix(codes: list[pa.Array]) -> np.ndarray:
    raw = b"".join(b"".join(c.to_pylist()) for c in codes)
    return np.frombuffer(raw, np.float16).reshape(sum(len(c) for c in codes), -1).astype(np.float32)


def _encoded(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _binary(_units(batch.column(1)))], names=["node", "code"])


def _sketches(batches):
    """Each node once for every table: the signs of 62 random projections as a number, and one more projection to break ties."""
    for batch in batches:
        x = _matrix([batch.column(1)])
        planes = np.random.default_rng(SEED).standard_normal((x.shape[1], TABLES, 63)).astype(np.float32)
        seen = np.einsum("nd,dtb->ntb", x, planes, optimize=True)
        signs = ((seen[:, :, :62] > 0) @ (np.int64(1) << np.arange(61, -1, -1, dtype=np.int64)))
        for t in range(TABLES):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(signs[:, t]), pa.array(seen[:, t, 62]), batch.column(0), batch.column(1)],
                                             names=["t", "sketch", "along", "node", "code"])


def _edges(u, v, s, new) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float32()), pa.array(new, pa.bool_())], names=["u", "v", "s", "new"])


def _blocks(batches):
    """Nearest nodes within each block of sorted rows."""
    for batch in batches:
        t, node = batch.column(0).to_numpy(), batch.column(3).to_numpy()
        x = _matrix([batch.column(4)])
        cuts = np.flatnonzero(np.diff(t)) + 1
        for rows in np.split(np.arange(len(t)), cuts):
            for at in np.array_split(rows, max(1, len(rows) // BLOCK)):
                s = x[at] @ x[at].T
                np.fill_diagonal(s, -9)
                k = min(NEIGHBOURS, len(at) - 1)
                if k > 0:
                    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    yield _edges(np.repeat(node[at], k), node[at][best].ravel(), np.take_along_axis(s, best, 1).ravel(), np.ones(k * len(at), bool))


def _part(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


class _Loaded:
    """The vectors of one part, looked up by id."""

    def __init__(self, ids: list, codes: list, limits: list):
        ids = np.concatenate(ids)
        order = np.argsort(ids)
        self.ids, self.x, self.limit = ids[order], _matrix(codes)[order], np.concatenate(limits)[order]

    def at(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)


def _by_part(kernel):
    """Rows sorted by (part, kind, u): kind 0 vectors of others, 1 vectors of u, 2 edges. kernel(own, others, u, v, new) gets whole groups of u."""

    def run(batches):
        part, held, own, others, rest = None, {0: ([], [], []), 1: ([], [], [])}, None, None, None
        for batch in batches:
            p = batch.column(0).to_numpy()
            for rows in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p)) + 1):
                piece = batch.slice(int(rows[0]), len(rows)) if len(rows) else batch
                if not len(rows):
                    continue
                if p[rows[0]] != part:
                    if rest is not None:
                        yield from kernel(own, others, *rest)
                    part, held, own, others, rest = p[rows[0]], {0: ([], [], []), 1: ([], [], [])}, None, None, None
                kind = piece.column(1).to_numpy()
                for k in (0, 1):
                    some = np.flatnonzero(kind == k)
                    if len(some):
                        mine = piece.slice(int(some[0]), len(some))
                        for to, column in zip(held[k], (mine.column(2).to_numpy(), mine.column(6), mine.column(5).to_numpy()), strict=True):
                            to.append(column)
                some = np.flatnonzero(kind == 2)
                if not len(some):
                    continue
                if others is None:
                    others = _Loaded(*held[0])
                    own = _Loaded(*held[1]) if held[1][0] else None
                mine = piece.slice(int(some[0]), len(some))
                u, v, new = mine.column(2).to_numpy(), mine.column(3).to_numpy(), mine.column(4).to_numpy(zero_copy_only=False)
                if rest is not None:
                    u, v, new = (np.concatenate(x) for x in zip(rest, (u, v, new), strict=True))
                tail = int(np.searchsorted(u, u[-1]))  # the last u may go on in the next batch
                if tail:
                    yield from kernel(own, others, u[:tail], v[:tail], new[:tail])
                rest = (u[tail:], v[tail:], new[tail:])
        if rest is not None:
            yield from kernel(own, others, *rest)

    return run


def _join_local(own, others, u, v, new):
    """Members v of each u among each other: pairs with a new one, nearer than the first's farthest neighbour."""
    heads = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    size = np.diff(np.append(heads, len(u)))
    at = others.at(v)
    for some in np.array_split(np.arange(len(heads)), -(-len(heads) // 128)):
        width = int(size[some].max())
        pad = np.arange(width)[None, :] < size[some][:, None]
        index = np.where(pad, heads[some][:, None] + np.arange(width)[None, :], 0)
        member, fresh = at[index], new[index] & pad
        x = others.x[member]
        s = x @ x.transpose(0, 2, 1)
        good = (fresh[:, :, None] | fresh[:, None, :]) & pad[:, :, None] & pad[:, None, :] & (s > others.limit[member][:, :, None]) & (member[:, :, None] != member[:, None, :])
        g, a, b = np.nonzero(good)
        pair = member[g, a].astype(np.int64) * len(others.ids) + member[g, b]
        _, first = np.unique(pair, return_index=True)
        g, a, b = g[first], a[first], b[first]
        yield _edges(others.ids[member[g, a]], others.ids[member[g, b]], s[g, a, b], np.ones(len(g), bool))


def _score_pairs(own, others, u, v, new):
    """Distinct pairs of u and v with their cosine."""
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    keep = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
    u, v = u[keep], v[keep]
    for i in range(0, len(u), 8192):
        a, b = u[i: i + 8192], v[i: i + 8192]
        yield _edges(a, b, np.einsum("nd,nd->n", own.x[own.at(a)], others.x[others.at(b)]), np.ones(len(a), bool))


def _dealt(edges: DataFrame, others: DataFrame, own: DataFrame | None, parts: int, kernel) -> DataFrame:
    """kernel over edges (u, v, new): u's part gets each vector of ``others`` (node, code, low) that its edges name, once."""
    edges = edges.select(_part("u", parts).alias("p"), "u", "v", "new")
    asked = edges.select("p", F.col("v").alias("node")).distinct()
    none = F.lit(None)
    vectors = asked.join(others, "node").select("p", F.lit(0).alias("kind"), F.col("node").alias("u"), none.cast("long").alias("v"), none.cast("boolean").alias("new"), "low", "code")
    rows = vectors.unionByName(edges.select("p", F.lit(2).alias("kind"), "u", "v", "new", none.cast("float").alias("low"), none.cast("binary").alias("code")))
    if own is not None:
        rows = rows.unionByName(own.select(_part("node", parts).alias("p"), F.lit(1).alias("kind"), F.col("node").alias("u"), none.cast("long").alias("v"),
                                           none.cast("boolean").alias("new"), F.lit(0).cast("float").alias("low"), "code"))
    return rows.repartition("p").sortWithinPartitions("p", "kind", "u").mapInArrow(_by_part(kernel), _EDGE)


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k best distinct v of each u; an edge is new if no old one is the same."""
    once = edges.repartition("u").groupBy("u", "v").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    best = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    return once.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def _back_edges(graph: DataFrame, seed: int) -> DataFrame:
    """At most REVERSE edges into each node, new ones first, chosen by hash."""
    some = Window.partitionBy("v").orderBy(F.desc("new"), F.xxhash64("u", "v", F.lit(seed)), "u")
    return graph.withColumn("r", F.row_number().over(some)).where(F.col("r") <= REVERSE).select(F.col("v").alias("u"), F.col("u").alias("v"), "new")


class Index:
    """nodes (node, embedding, code), members (node, vec_id), edges (u, v, s) of a table of vectors."""

    def __init__(self, vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", keep: int = 6):
        """keep: smallest vec_ids remembered of each group of equal vectors; a search for k needs k + 1."""
        self.spark, self.keep = vectors.sparkSession, keep
        same = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = (usable_vectors(vectors, id_column, vector).withColumn("r", F.row_number().over(same)).withColumn("node", F.min("vec_id").over(same))
                .where(F.col("r") <= keep))
        self._rows = SharedTable(rows.select("node", "vec_id", "embedding"), "vectors")
        self.members = self._rows.read().select("node", "vec_id")
        self.nodes = self._rows.read().where("node = vec_id").select("node", "embedding")
        self._codes = SharedTable(self.nodes.mapInArrow(_encoded, "node long, code binary"), "codes")
        self.codes = self._codes.read()
        self.size = self.codes.count()
        self.parts = -(-self.size // PART) or 1
        self.rounds = 0
        self.edges = self._descend()

    def _descend(self) -> DataFrame:
        order = ("t", "sketch", "along", "node")
        tables = self.codes.mapInArrow(_sketches, "t int, sketch long, along float, node long, code binary")
        start = tables.repartitionByRange(-(-TABLES * self.size // (16 * BLOCK)) or 1, *order).sortWithinPartitions(*order).mapInArrow(_blocks, _EDGE)
        table = SharedTable(_nearest(start, NEIGHBOURS), "graph")
        for self.rounds in range(1, ROUNDS + 1):
            graph = table.read()
            limits = graph.groupBy("u").agg(F.when(F.count("*") >= NEIGHBOURS, F.min("s")).otherwise(-2.0).cast("float").alias("low"))
            others = self.codes.join(limits, F.col("node") == F.col("u"), "left").select("node", "code", F.coalesce("low", F.lit(-2.0).cast("float")).alias("low"))
            members = graph.select("u", "v", "new").union(_back_edges(graph, self.rounds)).groupBy("u", "v").agg(F.max("new").alias("new"))
            found = _dealt(members, others, None, self.parts, _join_local)
            grown = SharedTable(_nearest(graph.withColumn("new", F.lit(False)).union(found), NEIGHBOURS), "graph")
            table.drop()
            table = grown
            fresh = table.read().where("new").count()
            if fresh <= DELTA * NEIGHBOURS * self.size:
                break
        return table.read().drop("new")

    def _hop_list(self) -> DataFrame:
        """(node, next): where a search goes from a node, along its edges and some back edges."""
        graph = self.edges.withColumn("new", F.lit(False))
        both = graph.select("u", "v").union(_back_edges(graph, 0).select("u", "v"))
        return cut_lineage(both.groupBy(F.col("u").alias("node")).agg(F.collect_set("v").alias("next")))

    def search(self, queries: DataFrame, k: int = 5, id_column: str = "query_id", vector: str = "embedding") -> DataFrame:
        """query_id, rank, vec_id, score: the k nearest found for every usable query, exact cosine, ties to the smaller vec_id."""
        if k >= self.keep:
            raise ValueError("build the index with keep > k")
        asked = cut_lineage(usable_vectors(queries, id_column, vector).withColumnRenamed("vec_id", "query_id"))
        own = SharedTable(asked.select(F.col("query_id").alias("node"), "embedding").mapInArrow(_encoded, "node long, code binary"), "queries")
        codes = self.codes.withColumn("low", F.lit(0).cast("float"))
        parts = -(-asked.count() // QUERY_PART) or 1
        hop_list = self._hop_list()
        pivots = [r["node"] for r in self.codes.select("node").orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(PIVOTS).collect()]
        at_home = asked.join(self.nodes.withColumnRenamed("embedding", "same"), (F.xxhash64("embedding") == F.xxhash64("same")) & (F.col("embedding") == F.col("same")))
        pairs = asked.select(F.col("query_id").alias("u"), F.explode(F.lit(pivots or None).cast("array<long>")).alias("v")).union(at_home.select("query_id", "node")).distinct()
        seen = [SharedTable(pairs, "seen")]
        best = None
        for _ in range(HOPS):
            scored = _dealt(seen[-1].read().withColumn("new", F.lit(True)), codes, own.read(), parts, _score_pairs)
            best = _nearest(scored if best is None else best.union(scored), BEAM)  # new: not expanded yet
            step = Window.partitionBy("u").orderBy(F.desc("new"), F.desc("s"), "v")
            best = cut_lineage(best.withColumn("front", F.col("new") & (F.row_number().over(step) <= EXPAND)))
            front = best.where("front").select("u", "v")
            best = best.select("u", "v", "s", (F.col("new") & ~F.col("front")).alias("new"))
            known = seen[0].read()
            for more in seen[1:]:
                known = known.union(more.read())
            ahead = front.join(hop_list, F.col("v") == F.col("node")).select("u", F.explode("next").alias("v")).distinct().join(known, ["u", "v"], "left_anti")
            seen.append(SharedTable(ahead, "seen"))
            if front.isEmpty():
                break
        for table in seen:
            table.drop()
        own.drop()
        top = Window.partitionBy("u").orderBy(F.desc("s"), "v")
        some = best.withColumn("r", F.row_number().over(top)).where(F.col("r") <= max(RERANK, 8 * k)).select(F.col("u").alias("query_id"), F.col("v").alias("node"))
        pair = some.join(self.nodes.withColumnRenamed("embedding", "b"), "node").join(asked.withColumnRenamed("embedding", "a"), "query_id")
        scored = pair.select("query_id", "node", cosine(F.col("a"), F.col("b")).alias("score")).join(self.members, "node").where(F.col("vec_id") != F.col("query_id"))
        last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return scored.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; vectors are first divided by a power of two, which changes no digit but keeps squares in range."""

    def scaled(x):
        largest = F.array_max(F.transform(x, lambda y: F.abs(y)))
        return let(F.pow(F.lit(2.0), F.floor(F.log2(largest))), lambda by: F.transform(x, lambda y: y / by))

    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda t, y: t + y)

    def norm(x):
        return F.sqrt(total(F.transform(x, lambda y: y * y)))

    return let(F.struct(scaled(a).alias("a"), scaled(b).alias("b")), lambda p: total(F.zip_with(p["a"], p["b"], lambda x, y: x * y)) / (norm(p["a"]) * norm(p["b"])))
