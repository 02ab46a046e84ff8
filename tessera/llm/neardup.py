"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are normalised and turned into the principal axes of all of them, largest variance first. Blocks of rows are compared tile by
tile: products accumulate over the leading axes, and after each step what is left is bounded by the product of the suffix norms; pairs
that cannot reach the threshold are dropped, and a tile stops when none is left. What survives is decided in double precision on the
vectors as they came. A tile pair returns each vector's number of links and the root of its piece, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .jaccard import grouped

THRESHOLD = 0.95
#: Vectors of a block at most, and about as many at least where there are too few blocks for the cluster; a task compares two blocks.
BLOCK_ROWS, LEAST_ROWS = 8192, 1024
#: Tasks of the comparison at most; beyond, a task compares several pairs of blocks, one after the other.
MOST_TASKS = 100_000
TILE = 1024
STEPS = (8, 24, 64, 256, 1024, 4096)
#: Room for rounding in the single-precision screen; the decision itself is made in double precision.
SLACK = 1e-4


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", able: bool = True) -> DataFrame:
    """(id, dim, vec binary of doubles) of the rows that can link: an id, and a vector not null, without null or non-finite components, not zero. Or (id) of the others."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            n = len(column)
            lengths = np.asarray(column.value_lengths().fill_null(0))
            flat = column.flatten()
            values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            finite = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            keep = (lengths > 0) & (finite[ends] == finite[ends - lengths])
            rows = []
            for k in np.flatnonzero(keep):
                v = values[ends[k] - lengths[k] : ends[k]]
                if v.any() and batch.column(0)[int(k)].is_valid:
                    rows.append((k, v))
            if not able:
                others = np.setdiff1d(np.arange(n), [k for k, _ in rows])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(others))], ["id"])
            elif rows:
                ids = batch.column(0).take(pa.array([k for k, _ in rows]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(v) for _, v in rows], pa.int32()), pa.array([np.ascontiguousarray(v).tobytes() for _, v in rows], pa.binary())], ["id", "dim", "vec"])

    one = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    return one.mapInArrow(run, "id long, dim int, vec binary" if able else "id long")


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest component first, so that squares neither overflow nor vanish."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def axes(ready: DataFrame, dim: int) -> np.ndarray:
    """The principal axes of the normalised vectors of one dimension, from their second moments summed over all rows (dim x dim numbers)."""

    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                m = unit(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(-1, dim))
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([common.task_number()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "vec"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(dim * dim)
        for x in table.column("vec"):
            total += np.frombuffer(x.as_buffer(), np.float64)
        return pa.table({"part": table.column("part").slice(0, 1), "vec": pa.array([total.tobytes()], pa.binary())})

    sums = ready.where(F.col("dim") == dim).select("vec").mapInArrow(run, "part int, vec binary")
    for fan in (4096, 256, 16, 1):  # a tree, so that no task holds more than a few of the matrices
        sums = sums.select((F.col("part") % fan).alias("part"), "vec").groupBy("part").applyInArrow(add, "part int, vec binary")
    total = sum((np.frombuffer(r.vec, np.float64) for r in sums.collect()), np.zeros(dim * dim)).reshape(dim, dim)  # one row
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def reach(threshold: float) -> float:
    """How far apart unit vectors that link can be, on any axis."""
    return float(np.sqrt(2 - 2 * threshold)) + SLACK


def compare(a_ids, a, a_n, b_ids, b, b_n, same: bool, threshold: float, basis: np.ndarray):
    """(id, root id, links) of the vectors of two blocks that link across them (or within one, if same). A vector stands for n rows."""
    ua, ub = unit(a), unit(b)
    pa_, pb = (ua @ basis), (ub @ basis)
    order_a, order_b = np.argsort(pa_[:, 0], kind="stable"), np.argsort(pb[:, 0], kind="stable")
    pa_, pb, ua, ub, a_ids, b_ids, a_n, b_n = pa_[order_a], pb[order_b], ua[order_a], ub[order_b], a_ids[order_a], b_ids[order_b], a_n[order_a], b_n[order_b]
    dim = a.shape[1]
    steps = [s for s in STEPS if s < dim] + [dim]
    tails = lambda p: {s: np.sqrt(np.maximum(0.0, 1.0 - np.cumsum(p * p, axis=1)[:, s - 1])).astype(np.float32) for s in steps}
    ta, tb = tails(pa_), tails(pb)
    fa, fb = pa_.astype(np.float32), pb.astype(np.float32)
    gap = reach(threshold)
    low = np.float32(threshold - SLACK)
    na = len(a_ids)
    shift = 0 if same else na
    label = np.arange(na + (0 if same else len(b_ids)))
    links = np.zeros(len(label), np.int64)
    for i in range(0, na, TILE):
        i2 = min(i + TILE, na)
        for j in range(i if same else 0, len(b_ids), TILE):
            j2 = min(j + TILE, len(b_ids))
            if pb[j, 0] - pa_[i2 - 1, 0] > gap or pa_[i, 0] - pb[j2 - 1, 0] > gap:
                continue  # too far apart on the first axis alone
            s = steps[0]
            acc = fa[i:i2, :s] @ fb[j:j2, :s].T
            mask = acc + np.outer(ta[s][i:i2], tb[s][j:j2]) >= low
            if same and i == j:
                mask &= np.triu(np.ones(mask.shape, bool), 1)
            for p, s in zip(steps[:-1], steps[1:], strict=True):
                live = int(mask.sum())
                if not live:
                    break
                if live > mask.size // 16:
                    acc = acc + fa[i:i2, p:s] @ fb[j:j2, p:s].T
                    mask &= acc + np.outer(ta[s][i:i2], tb[s][j:j2]) >= low
                else:
                    r, c = np.nonzero(mask)
                    got = acc[r, c] + np.einsum("ij,ij->i", fa[i + r, p:s], fb[j + c, p:s])
                    acc[r, c] = got
                    mask[r, c] = got + ta[s][i + r] * tb[s][j + c] >= low
            r, c = np.nonzero(mask)
            for k in range(0, len(r), 1 << 16):
                x, y = i + r[k : k + (1 << 16)], j + c[k : k + (1 << 16)]
                linked = np.einsum("ij,ij->i", ua[x], ub[y]) >= threshold
                x, y = x[linked], y[linked] + shift
                if len(x):
                    links += np.bincount(x, weights=b_n[y - shift], minlength=len(label)).astype(np.int64) + np.bincount(y, weights=a_n[x], minlength=len(label)).astype(np.int64)
                    while True:
                        least = np.minimum(label[x], label[y])
                        if (least == label[x]).all() and (least == label[y]).all():
                            break
                        np.minimum.at(label, label[x], least)
                        np.minimum.at(label, label[y], least)
                        label = label[label]
    while not (label[label] == label).all():
        label = label[label]
    ids = a_ids if same else np.concatenate((a_ids, b_ids))
    hit = np.flatnonzero(links)
    return ids[hit], ids[label[hit]], links[hit]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Vectors link if their cosine in double precision is at least the threshold; those of different dimensions do not. Null, empty and
    zero vectors, and those with null or non-finite components, link with nothing: their own component, kept. A row with a null id
    links with nothing and has a null component. Equal vectors are compared once, with the number of their rows, so a repeated row is a
    vector like any other; rows that share an id have each the links of its own vector. An empty table gives an empty result; other
    columns are not read.

    Blocks are ranges of the first axis, by quantiles; two blocks are compared only if vectors on the ranges' near ends could link.
    """
    spark = df.sparkSession
    ready = common.written(vectors(df, id_col, vec_col).withColumn("key", F.xxhash64("dim", "vec")))
    classes = common.written(ready.groupBy("dim", "key", "vec").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    counts = {r.dim: r["count"] for r in classes.groupBy("dim").count().collect()}  # a row for each dimension in use
    found = None
    for dim, count in sorted(counts.items()):
        basis = spark.sparkContext.broadcast(axes(classes, dim))

        def place(batches, dim=dim, basis=basis):
            for batch in batches:
                if batch.num_rows:
                    m = unit(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(-1, dim))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m @ basis.value[:, 0])], ["id", "n", "vec", "first"])

        rows = common.written(classes.where(F.col("dim") == dim).select("id", "n", "vec").mapInArrow(place, "id long, n long, vec binary, first double"))
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        blocks = max(-(-count // block_rows), min(int(np.ceil(np.sqrt(2 * partitions))), count // LEAST_ROWS), 1)
        cuts = sorted(rows.agg(F.approx_percentile("first", [k / blocks for k in range(1, blocks)], 10_000)).first()[0]) if blocks > 1 else []
        # what lies on a cut goes to any block that it bounds, by hash
        edges = F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>")
        low, high = F.size(F.filter(edges, lambda c: c < F.col("first"))), F.size(F.filter(edges, lambda c: c <= F.col("first")))
        dealt = rows.withColumn("block", (low + F.pmod(F.xxhash64("id", "vec"), high - low + 1)).cast("int"))
        # each block goes to the tasks of all pairs of blocks that it is in; what they compare never leaves them
        last = [max(j for j in range(i, blocks) if j == i or cuts[j - 1] - cuts[i] <= reach(threshold)) for i in range(blocks)]
        first = [min(i for i in range(j + 1) if last[i] >= j) for j in range(blocks)]
        start = np.concatenate(([0], np.cumsum([last[i] - i + 1 for i in range(blocks)])))
        at = lambda values, k: F.element_at(F.array(*[F.lit(int(x)) for x in values]), k + 1)
        other = F.explode(F.sequence(at(first, F.col("block")), at(last, F.col("block"))))
        dealt = dealt.withColumn("other", other).select(F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), (F.col("block") > F.col("other")).alias("second"), "id", "n", "vec")
        tasks = int(min(start[-1], MOST_TASKS))
        dealt = dealt.withColumn("task", ((at(start, F.col("one")) + F.col("two") - F.col("one")) % tasks).cast("int"))

        def run(batches, dim=dim, basis=basis):
            for table in grouped(batches, 2):
                ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
                m = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float64).reshape(-1, dim)
                if table.column("one")[0].as_py() == table.column("two")[0].as_py():
                    out = compare(ids, m, n, ids, m, n, True, threshold, basis.value)
                else:
                    second = table.column("second").to_numpy(zero_copy_only=False)
                    if second.all() or not second.any():
                        continue
                    out = compare(ids[~second], m[~second], n[~second], ids[second], m[second], n[second], False, threshold, basis.value)
                for k in range(0, len(out[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in out], ["id", "root", "links"])

        piece = dealt.repartitionById(tasks, F.col("task")).sortWithinPartitions("one", "two").drop("task").mapInArrow(run, "id long, root long, links long")
        found = piece if found is None else found.unionByName(piece)
    ids = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"))
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = common.written(found)
    groups = common.components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    # classes of equal bytes may share their smallest id, where an id has several vectors
    known = classes.join(links, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    known = common.written(known.groupBy("key").agg(F.max(F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.min(F.coalesce("component", "id")).alias("component_id")))
    linked = ready.select(F.col("id").alias("vec_id"), "key").join(known, "key").select("vec_id", "n_links", "component_id", (F.col("component_id") == F.col("vec_id")).alias("kept"))
    alone = vectors(df, id_col, vec_col, able=False).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
