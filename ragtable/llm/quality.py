"""Quality classifier by Bradley-Terry pairwise ranking (operator 4).

A text's features are shares of kinds of characters, words and repeats. All
labelled rows are learned from: they are dealt by hash to groups of about
``PER_GROUP`` rows of the rarer class, in each of which every preferred text
meets every rejected one, and the weights w minimise the logistic loss of
w . (features preferred - features rejected) over these pairs (all pairs there
are, if one group holds the rarer class). A Newton step is one Spark job whose
tasks hand on the sums of their groups. The threshold is the score quantile, over
all labelled rows, at the share of rejected rows among them; scores are moved so
that it comes out at ``CUT``.

Defined results: null and empty texts have features of nothing and are scored;
without labelled rows of both kinds every score is 0.5; an empty table gives no
rows; label rows without a document are ignored, and so are ids labelled both ways;
of several documents with one id one is learned from, and all are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import join_small_side
from ..session import cut_lineage
from .features import ratios, repeated_windows
from .kernels import PrefixHash, Words, blocks

#: rows of each class in the samples of operators 8 and 9 (``labelled_sample``)
SAMPLE = 2000
CUT = 0.3
#: rows of the rarer class in a group (on average, at least) and of the other one (about, at most)
PER_GROUP, GROUP_ROWS = 64, 4096
TASK_ROWS = 20000
#: scores that the driver reads to place the threshold, and cells by which it comes that near
NEAR, CELLS = 10000, 1024


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    words = Words(data, off)
    hashes = PrefixHash(data).span(words.start, words.end)
    base = ratios(data, off, words, hashes)
    again = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.cumsum(repeated_windows(hashes, words, 5), out=again[1:])
    share = (again[words.bounds[1:]] - again[words.bounds[:-1]]) / np.maximum(np.diff(words.bounds), 1)
    return np.column_stack([base, share, share > 0.2])


def with_features(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but text, and ``x`` array<double>."""

    def run(batches):
        for rows, data, off in blocks(batches, "text"):
            x = features(data, off)
            keep = [i for i, f in enumerate(rows.schema) if f.name != "text"]
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in keep), flat], names=[*(rows.schema.names[i] for i in keep), "x"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{fields}, x array<double>")


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def _known(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of ids labelled one way."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    return given.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("doc_id", "y")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, y, text): at most ``per_class`` labelled documents of each class, by hash of doc_id.

    One row for each doc_id: of several texts the one of the least hash. An id that is labelled both ways is not learned from.
    """
    known = _known(labels, label)
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(parts[0].union(parts[1])), "doc_id")
    one = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("row"))
    return one.select("doc_id", "y", F.col("row.text").alias("text"))


def labelled_features(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y, x) of every labelled document, kept; of several texts of an id the one of the least hash."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    met = join_small_side(texts, _known(labels, label), ["doc_id"], salt_source=F.xxhash64("text"))
    x = with_features(met.select("doc_id", "y", F.xxhash64("text").alias("h"), "text"))
    one = x.groupBy("doc_id", "y").agg(F.min(F.struct("h", "x")).alias("row")).select("doc_id", "y", "row.x")
    return cut_lineage(one.sortWithinPartitions("doc_id"))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    y = batch.column(batch.schema.get_field_index("y")).to_numpy()
    return y, batch.column(batch.schema.get_field_index("x")).flatten().to_numpy().reshape(len(y), -1)


def _summed(rows: DataFrame, part) -> np.ndarray | None:
    """The sum, in order of tasks, of the arrays that ``part`` makes of a task's batches; the driver reads one short row for each task."""

    def run(batches):
        total = None
        for v in part(batches):
            total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["task", "v"])

    sums = sorted(rows.mapInArrow(run, "task long, v array<double>").collect())
    return np.sum([r["v"] for r in sums], axis=0) if sums else None


def _moments(batches):
    """Rows of class 0, rows of class 1, sums and sums of squares."""
    for batch in batches:
        y, x = _matrix(batch)
        if len(y):
            yield np.concatenate([[(y == 0).sum(), (y == 1).sum()], x.sum(axis=0), (x * x).sum(axis=0)])


def _groups(batches):
    """(good, bad) of each group; its rows stand together in a task."""
    held = []

    def both():
        y, x = (np.concatenate(c) for c in zip(*held, strict=True))
        return x[y == 1], x[y == 0]

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        y, x = _matrix(batch)
        key = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("b", "s")])
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if held and tuple(key[i]) != last:
                yield both()
                held = []
            held.append((y[i:j], x[i:j]))
            last = tuple(key[i])
    if held:
        yield both()


def _loss_sums(w: np.ndarray, mean: np.ndarray, scale: np.ndarray):
    """Pairs, gradient and Hessian of the logistic loss over the pairs of each group, from sums over rows."""

    def part(batches):
        for good, bad in _groups(batches):
            if not len(good) or not len(bad):
                continue
            good, bad = (good - mean) / scale, (bad - mean) / scale
            p = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - (bad @ w)[None, :], -40, 40)))
            h = p * (1 - p)
            cross = good.T @ h @ bad
            hess = (good * h.sum(axis=1)[:, None]).T @ good + (bad * h.sum(axis=0)[:, None]).T @ bad - cross - cross.T
            yield np.concatenate([[p.size], p.sum(axis=1) @ good - p.sum(axis=0) @ bad, hess.ravel()])

    return part


def _dealt(rows: DataFrame, n: dict[int, int]) -> DataFrame:
    """(doc_id, y, x, b, s): each row of the rarer class in all slices s of its group b, each of the other in one."""
    rare = 0 if n[0] <= n[1] else 1
    groups = max(1, n[rare] // PER_GROUP)
    slices = -(-n[1 - rare] // (groups * GROUP_ROWS))
    one = F.array(F.pmod(F.xxhash64("doc_id", F.lit("slice")), F.lit(slices)))
    every = F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))
    dealt = rows.select("doc_id", "y", "x", F.pmod(F.xxhash64("doc_id", F.lit("group")), F.lit(groups)).alias("b"), F.explode(F.when(F.col("y") == rare, every).otherwise(one)).alias("s"))
    tasks = -(-(n[1 - rare] + n[rare] * slices) // TASK_ROWS)
    return cut_lineage(dealt.repartition(tasks, "b", "s").sortWithinPartitions("b", "s", "y", "doc_id"))


def _threshold(scored: DataFrame, weight: dict[int, float], share: float) -> float:
    """The score (mean of it and its neighbours) up to which rows weigh ``share``; cells around it are cut smaller until few scores are left."""
    low, high = scored.agg(F.min("s"), F.max("s")).first()
    below = 0.0
    while True:
        inside = scored.where(F.col("s").between(low, high))
        if low == high:
            return low
        if not inside.offset(NEAR).take(1):
            break
        cell = F.least(F.floor((F.col("s") - low) / (high - low) * CELLS), F.lit(CELLS - 1))
        cells = inside.groupBy(cell.alias("c")).agg(*[F.count(F.when(F.col("y") == y, 1)).alias(f"n{y}") for y in (0, 1)], F.min("s").alias("low"), F.max("s").alias("high")).orderBy("c").collect()
        for r in cells:
            low, high, heavy = r["low"], r["high"], r["n0"] * weight[0] + r["n1"] * weight[1]
            if below + heavy >= share or r is cells[-1]:
                break
            below += heavy
    near = inside.orderBy("s", "y").collect()
    upto = below + np.cumsum([weight[r["y"]] for r in near])
    at = int(np.searchsorted(upto, share))
    return float(np.mean([r["s"] for r in near][max(0, at - 1): at + 2]))


def fit(rows: DataFrame, bad_share: float, cut: float = CUT) -> dict | None:
    """Weights and threshold of the Bradley-Terry model over all of ``rows`` (doc_id, y, x), or None without both classes."""
    sums = _summed(rows, _moments)
    if sums is None or not sums[0] or not sums[1]:
        return None
    n, dim = {0: int(sums[0]), 1: int(sums[1])}, (len(sums) - 2) // 2
    mean = sums[2: 2 + dim] / (n[0] + n[1])
    scale = np.sqrt(np.maximum(sums[2 + dim:] / (n[0] + n[1]) - mean * mean, 0)) + 1e-3
    dealt = _dealt(rows, n)
    w = np.zeros(dim)
    for _ in range(25):  # Newton steps of the logistic loss with a small ridge
        got = _summed(dealt, _loss_sums(w, mean, scale))
        grad = got[1: 1 + dim] / got[0] - 1e-2 * w
        step = np.linalg.solve(got[1 + dim:].reshape(dim, dim) / got[0] + 1e-2 * np.eye(dim), grad)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break

    def scores(batches):
        for batch in batches:
            y, x = _matrix(batch)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array((x - mean) / scale @ w)], names=["y", "s"])

    scored = cut_lineage(rows.mapInArrow(scores, "y int, s double"))
    threshold = _threshold(scored, {0: bad_share / n[0], 1: (1 - bad_share) / n[1]}, bad_share)
    return {"mean": mean, "scale": scale, "w": w, "shift": float(np.log(cut / (1 - cut)) - threshold)}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict | None:
    """The model, or None without rows of both classes. All labelled rows are learned from; the driver reads sums and the scores next to the threshold."""
    totals = {r["y"]: r["n"] for r in labels.groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect() if r["y"] in (0, 1)}
    if len(totals) < 2:
        return None
    return fit(labelled_features(docs, labels, label), totals[0] / (totals[0] + totals[1]))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """The columns of ``docs`` but text, and ``score``."""
    if model is None:
        return docs.drop("text").withColumn("score", F.lit(0.5))
    w = model["w"] / model["scale"]
    bias = model["shift"] - float(model["mean"] @ w)
    x = with_features(docs)
    dot = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(float(bias)), lambda s, v: s + v)
    return x.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), dot))))).drop("x")
