"""MinHash near-duplicate components with sequential Bayesian verification (operator 1).

1. One scan makes each text's set of word shingles, its MinHash signature and a
   128-bit set key. Equal sets collapse to one node by a map-side combined
   minimum, so thousands of copies cost one row. Keys that share a half get
   names of their own.
2. Signatures are cut in bands; nodes sharing a band key are candidates. A
   bucket does not emit its pairs: each member is tried against the bucket's
   smallest node, which joins most of a group of near copies at once.
3. Buckets that still hold several components are tried exhaustively, in blocks:
   members go to blocks of about ``BLOCK_BYTES``, and only blocks that share a
   bucket and know two of its components meet, in one row per pair of blocks, which
   returns the links that join components; the lighter block is sent to the heavier. So there is no cap, and no pair of texts
   becomes a row.
4. A candidate pair's signatures are compared batch by batch. With a uniform
   prior, the posterior after m matches in n is Beta(m+1, n-m+1); a pair goes
   once P(J >= threshold) is under ``miss``. Survivors are verified on the full
   sets: 100 * |A & B| >= percent * |A | B|.
5. Verified links make components.

Defined results: null, empty or wordless text is linked with nothing; texts
with fewer than ``k`` words have one shingle, the whole sequence; rows with
equal sets are always linked. component_id is the smallest non-null doc_id of
the component (a text without words: its own); rows without doc_id are kept
only where their whole component has none. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graph import connected_components
from .kernels import blocks, list_column, mix64, shingle_sets
from .slots import may_contain, slot_filter
from .spread import ROWS_PER_TASK, hot_keys, spread_join

N_HASHES = 128
BAND_ROWS = 4
BATCH = 16
MISS = 1e-6
SEED = 7919
BLOCK_BYTES = 2 << 20
_HALVES = (np.uint64(0), np.uint64(0xA5A5A5A5))  # what a set's shingles are xored with for each half of its key


def min_matches(threshold: float, n_hashes: int = N_HASHES, batch: int = BATCH, miss: float = MISS) -> list[int]:
    """Least matches after each signature batch at which P(J >= threshold | matches) is still >= ``miss``.

    For the uniform prior, P(J >= t | m of n) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, n_hashes + 1, batch):
        below, m = 0.0, -1
        while m < n and below < miss:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(docs: DataFrame, k: int, n_hashes: int = N_HASHES) -> DataFrame:
    """(doc_id, n_shingles, half1, half2, sig): the halves of the set's key are null for texts without words."""

    def scan(batches):
        xor, mul = _permutations(n_hashes)
        for rows, data, off in blocks(batches, "text"):
            sets = shingle_sets(data, off, k)
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            sig = np.zeros((len(sets), n_hashes), dtype=np.uint32)
            one = np.zeros(len(sets), dtype=np.uint64)
            two = one.copy()
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                at = np.zeros(len(full), dtype=np.int64)
                np.cumsum(sizes[full][:-1], out=at[1:])
                for j in range(n_hashes):
                    sig[full, j] = (np.minimum.reduceat((flat ^ xor[j]) * mul[j], at) >> np.uint64(32)).astype(np.uint32)
                one[full], two[full] = (mix64(np.add.reduceat(mix64(flat ^ x), at)) for x in _HALVES)
            none = sizes == 0
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(sizes, pa.int64()), pa.array(one.view(np.int64), mask=none), pa.array(two.view(np.int64), mask=none),
                 list_column([sig[i].view(np.int32) if sizes[i] else np.zeros(0, np.int32) for i in range(len(sets))], pa.int32())],
                names=["doc_id", "n_shingles", "half1", "half2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        scan, "doc_id long, n_shingles long, half1 long, half2 long, sig array<int>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def sequential_filter(pairs: DataFrame, threshold: float, n_hashes: int = N_HASHES, batch: int = BATCH, miss: float = MISS) -> DataFrame:
    """Pairs (u, v, sig_u, sig_v) whose posterior survives every signature batch -> (u, v)."""
    least = min_matches(threshold, n_hashes, batch, miss)

    def judge(batches):
        for rows in batches:
            a, b = _matrix(rows.column(2), n_hashes), _matrix(rows.column(3), n_hashes)
            alive, matched = np.arange(rows.num_rows), np.zeros(rows.num_rows, dtype=np.int64)
            for i, need in enumerate(least):
                part = slice(i * batch, (i + 1) * batch)
                matched[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
                alive = alive[matched[alive] >= need]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(alive)), rows.column(1).take(pa.array(alive))], names=["u", "v"])

    return pairs.select("u", "v", "sig_u", "sig_v").mapInArrow(judge, "u long, v long")


def own_names(nodes: DataFrame) -> DataFrame:
    """``nodes`` (half1, half2: a 128-bit key, no two rows alike) with ``node``, one 64-bit name for each row.

    The name is the first half; where rows share it, a hash of both halves, until all names differ.
    """
    named = nodes.withColumn("node", F.col("half1"))
    salt = 0
    while True:
        twice = cut_lineage(named.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select("node", F.lit(True).alias("again")))
        if twice.isEmpty():
            return named
        named = cut_lineage(named.join(twice, "node", "left").withColumn(
            "node", F.when(F.col("again"), F.xxhash64("half1", "half2", F.lit(salt))).otherwise(F.col("node"))).drop("again"))
        salt += 1


def _sets(docs: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """(half1, half2, items): the full shingle sets, one per key, cut anew by a scan that skips most other texts.

    Copies leave a block once and are combined before the shuffle, so a task of it sends one set however many copies it has read.
    """
    wanted = slot_filter(keys, "half1")

    def scan(batches):
        for _, data, off in blocks(batches, "text"):
            sets = [s for s in shingle_sets(data, off, k) if len(s)]
            if not sets:
                continue
            one, two = (np.array([mix64(mix64(s ^ x).sum(dtype=np.uint64, keepdims=True))[0] for s in sets], dtype=np.uint64) for x in _HALVES)
            _, first = np.unique(np.column_stack([one, two]), axis=0, return_index=True)
            pick = np.sort(first[may_contain(wanted.value, one[first])])
            yield pa.RecordBatch.from_arrays([pa.array(one[pick].view(np.int64)), pa.array(two[pick].view(np.int64)), list_column([sets[i].view(np.int64) for i in pick], pa.int64())],
                                             names=["half1", "half2", "items"])

    return docs.select("text").mapInArrow(scan, "half1 long, half2 long, items array<long>").dropDuplicates(["half1", "half2"])


def _exact(first: list[np.ndarray], second: list[np.ndarray], ask: np.ndarray, percent: int, columns: int = 4096) -> np.ndarray:
    """Of the pairs ``ask`` (n x 2 places in first, second), which meet the threshold on full sets.

    Intersection sizes are products of incidence matrices over the shingles that both sides know, a slice of columns at a time.
    """
    a, b = np.unique(ask[:, 0]), np.unique(ask[:, 1])
    sizes = [np.array([len(s[i]) for i in p]) for s, p in ((first, a), (second, b))]
    flat = [np.concatenate([s[i] for i in p]) for s, p in ((first, a), (second, b))]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    common = np.zeros((len(a), len(b)), dtype=np.float64)
    if len(shared):
        place = []
        for n, x in zip(sizes, flat, strict=True):
            at = np.minimum(np.searchsorted(shared, x), len(shared) - 1)
            hit = shared[at] == x
            order = np.argsort(at[hit], kind="stable")
            place.append((np.repeat(np.arange(len(n)), n)[hit][order], at[hit][order]))
        for lo in range(0, len(shared), columns):
            wide = min(columns, len(shared) - lo)
            side = []
            for n, (row, at) in zip(sizes, place, strict=True):
                x, y = np.searchsorted(at, [lo, lo + wide])
                m = np.zeros((len(n), wide), dtype=np.float32)
                m[row[x:y], at[x:y] - lo] = 1
                side.append(m)
            common += side[0] @ side[1].T
    i, j = np.searchsorted(a, ask[:, 0]), np.searchsorted(b, ask[:, 1])
    both = np.rint(common[i, j]).astype(np.int64)
    return 100 * both >= percent * (sizes[0][i] + sizes[1][j] - both)


def _block_links(pairs: DataFrame, least: list[int], n_hashes: int, batch: int, percent: int) -> DataFrame:
    """Rows (a, b: arrays of nodes with comp, sig, items) -> links (u, v) that join two components of the block pair."""

    def side(column):
        flat = column.flatten()
        items = flat.field("items")
        off, values = items.offsets.to_numpy(), items.values.to_numpy()
        return (flat.field("node").to_numpy(), flat.field("comp").to_numpy(), flat.field("sig").flatten().to_numpy().reshape(-1, n_hashes),
                [values[x:y] for x, y in zip(off[:-1], off[1:], strict=True)])

    def run(batches):
        for rows in batches:
            for r in range(rows.num_rows):
                (u, cu, su, xu), (v, cv, sv, xv) = side(rows.column(0).slice(r, 1)), side(rows.column(1).slice(r, 1))
                size_u, size_v = np.array([len(x) for x in xu]), np.array([len(x) for x in xv])
                root = {c: c for c in (*cu.tolist(), *cv.tolist())}

                def find(c):
                    while root[c] != c:
                        c = root[c]
                    return c

                out = []
                for lo in range(0, len(u), 64):  # a strip of u against all of v
                    part = slice(lo, lo + 64)
                    cur = (np.array([find(c) for c in cu[part].tolist()])[:, None] != np.array([find(c) for c in cv.tolist()])[None, :]) & (u[part, None] != v[None, :])
                    cur &= (100 * np.minimum(size_u[part, None], size_v[None, :]) >= percent * np.maximum(size_u[part, None], size_v[None, :]))
                    i, j = np.nonzero(cur)
                    matched = np.zeros(len(i), dtype=np.int64)
                    for step, need in enumerate(least):
                        if not len(i):
                            break
                        cols = slice(step * batch, (step + 1) * batch)
                        matched += (su[part][i, cols] == sv[j, cols]).sum(axis=1)
                        go = matched >= need
                        i, j, matched = i[go], j[go], matched[go]
                    if not len(i):
                        continue
                    ok = _exact(xu[part], xv, np.column_stack([i, j]), percent)
                    for p, q in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                        c, d = find(int(cu[lo + p])), find(int(cv[q]))
                        if c != d:
                            root[max(c, d)] = min(c, d)
                            out.append((int(u[lo + p]), int(v[q])))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["u", "v"])

    return pairs.select("a", "b").mapInArrow(run, "u long, v long")


def lighter_first(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Pairs (x, y) of blocks with the lighter one as x, by ``weights`` (block, bytes): x is sent to y once for each pair, y is not."""
    w = [weights.select(F.col("block").alias(c), F.col("bytes").alias(f"bytes_{c}")) for c in ("x", "y")]
    swap = F.col("bytes_x") > F.col("bytes_y")
    return pairs.join(w[0], "x").join(w[1], "y").select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"))


def near_duplicate_components(docs: DataFrame, k: int = 5, percent: int = 80, n_hashes: int = N_HASHES, band_rows: int = BAND_ROWS,
                              batch: int = BATCH, miss: float = MISS, block_bytes: int = BLOCK_BYTES, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row. Keys of over ``per_task`` rows are dealt over tasks."""
    scanned = cut_lineage(signatures(docs, k, n_hashes))
    nodes = own_names(cut_lineage(scanned.where(F.col("half1").isNotNull()).groupBy("half1", "half2")
                        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("sig").alias("sig"), F.any_value("n_shingles").alias("n"))))
    bands = F.transform(F.sequence(F.lit(0), F.lit(n_hashes // band_rows - 1)),
                        lambda b: F.xxhash64(b, F.slice("sig", b * band_rows + 1, band_rows)))
    items = nodes.select(F.explode(bands).alias("bk"), "node")
    shared = cut_lineage(items.groupBy("bk").agg(F.count("*").alias("c"), F.min("node").alias("hub")).where("c > 1"))
    hot_buckets = hot_keys(shared, ["bk"], "c", per_task)
    members = cut_lineage(spread_join(items, shared.select("bk", "hub"), ["bk"], hot_buckets, F.col("node")))
    used = cut_lineage(nodes.select("half1", "half2", "node").join(members.select("node").distinct(), "node", "left_semi"))
    least = min_matches(percent / 100, n_hashes, batch, miss)
    info = cut_lineage(nodes.join(used.select("half1", "half2"), ["half1", "half2"]).join(_sets(docs, used, k), ["half1", "half2"]).select("node", "sig", "items", "n"))
    hot_hubs = hot_keys(shared.groupBy(F.col("hub").alias("u")).agg(F.sum("c").alias("c")), ["u"], "c", per_task)

    # every member against its buckets' hubs
    stars = members.where(F.col("node") != F.col("hub")).select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    sized = info.select("node", "sig", "n")
    both = (spread_join(stars, sized.select(F.col("node").alias("u"), F.col("sig").alias("sig_u"), F.col("n").alias("n_u")), ["u"], hot_hubs, F.col("v"))
            .join(sized.select(F.col("node").alias("v"), F.col("sig").alias("sig_v"), F.col("n").alias("n_v")), "v")
            .where(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent))
    alive = sequential_filter(both, percent / 100, n_hashes, batch, miss)
    sets = info.select("node", "items")
    common = F.size(F.array_intersect("a", "b"))
    links = cut_lineage(spread_join(alive, sets.select(F.col("node").alias("u"), F.col("items").alias("a")), ["u"], hot_hubs, F.col("v"))
                        .join(sets.select(F.col("node").alias("v"), F.col("items").alias("b")), "v")
                        .where(common * 100 >= (F.size("a") + F.size("b") - common) * percent).select("u", "v"))
    comps = connected_components(links)

    # buckets that still hold several components: their members in blocks, block against block
    member = members.join(comps, "node", "left").select("bk", "node", "hub", F.coalesce("component", "node").alias("comp"))
    open_ = member.groupBy("bk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo <> hi AND c > 2").select("bk")
    member = cut_lineage(spread_join(member, open_, ["bk"], hot_buckets, F.col("node")))
    # a group's blocks hold its hub's component or the rest, so most pairs of blocks know one component only and can't join any
    home = (member.groupBy("node", "comp").agg(F.min("hub").alias("g"))
            .join(comps.select(F.col("node").alias("g"), F.col("component").alias("hub_comp")), "g", "left")
            .select("node", "comp", "g", (F.col("comp") == F.coalesce("hub_comp", "g")).alias("main")))
    placed = home.join(info, "node")
    weight = placed.groupBy("g", "main").agg(F.ceil(F.sum(F.col("n") * 8 + 4 * n_hashes) / block_bytes).alias("parts"))
    placed = cut_lineage(placed.join(weight, ["g", "main"]).select(
        "node", "comp", "sig", "items", F.xxhash64("g", "main", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block")))
    in_block = (member.select("bk", "node", "comp").join(placed.select("node", "block"), "node")
                .groupBy("bk", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")))
    sides = [in_block.select("bk", F.col("block").alias(x), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}")) for x in ("x", "y")]
    block_pairs = (sides[0].join(sides[1], "bk").where("x <= y AND least(lo_x, lo_y) < greatest(hi_x, hi_y)")
                   .select("x", "y").distinct())
    content = cut_lineage(placed.groupBy("block").agg(F.collect_list(F.struct("node", "comp", "sig", "items")).alias("rows"), F.sum(F.size("items") * 8 + 4 * n_hashes).alias("bytes")))
    against = (lighter_first(block_pairs, content.select("block", "bytes")).join(content.select(F.col("block").alias("x"), F.col("rows").alias("a")), "x")
               .join(content.select(F.col("block").alias("y"), F.col("rows").alias("b")), "y"))
    more = cut_lineage(_block_links(against, least, n_hashes, batch, percent))
    if not more.isEmpty():
        comps = connected_components(comps.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))

    of = nodes.select("half1", "half2", "node", "rep", "copies").join(comps, "node", "left").where("copies > 1 OR component IS NOT NULL")
    low = of.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("rep").alias("low"))
    of = of.join(low, "component", "left").select(
        "half1", "half2", F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("low")).alias("component_id"), F.lit(True).alias("linked"))
    worded = F.col("half1").isNotNull()
    many = hot_keys(nodes, ["half1", "half2"], "copies", per_task)
    rows = scanned.drop("sig")
    got = (spread_join(rows.where(worded), of, ["half1", "half2"], many, F.struct("doc_id", F.spark_partition_id()), "left")
           .unionByName(rows.where(~worded), allowMissingColumns=True))
    return (got.select("doc_id", "n_shingles", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each component; rows that repeat doc_id and text stay once.

    doc_id identifies a document: where several rows carry one id, they stay or go together.
    """
    rows = near_duplicate_components(docs, k, percent).groupBy(F.col("doc_id").alias("_near_id")).agg(F.count("*").alias("_near_rows"), F.max("kept").alias("_near_kept"))
    kept = cut_lineage(rows.where("_near_kept"))
    one_id = docs["doc_id"].cast("long").eqNullSafe(F.col("_near_id"))
    once, again = (docs.join(kept.where(w).select("_near_id"), one_id, "left_semi") for w in ("_near_rows = 1", "_near_rows > 1"))
    return once.unionByName(again.dropDuplicates(["doc_id", "text"]))  # only rows of a repeated id are compared by their texts
