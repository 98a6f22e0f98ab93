"""Imputers of long matrices behind one contract. Observed cells are never changed; each imputer returns the whole grid."""

from __future__ import annotations

import functools
import math
import pickle
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.operators.holdout import holdout, moments, score
from gridloom.runtime import checked_broadcast, cut

#: Items of a matrix that algebra on the driver takes: p x p doubles are 200 MB there.
MAX_ITEMS = 5_000
#: Tasks whose sums the driver adds; those of more are added on the cluster first. Cells of a block of rows, which a task holds at once.
SLOTS, BLOCK_CELLS = 16, 100_000
#: Blocks of rows of at most this size (24 bytes a cell) are passed over on the driver, where a pass takes less than a job's start.
DRIVER_BYTES = 32_000_000
#: Squared change of a completion, by its square, at which passes end: the reference's library's default.
THRESH = 1e-5


@dataclass
class Imputation:
    """What an imputer gives: the completed cells, the chosen parameter, and the held-out curve over all parameters."""

    cells: DataFrame
    best: float
    param_name: str
    curve: list[tuple[float, float, float]] = field(default_factory=list)  # (param, rmse, r2)
    complete_at: Callable[[float], DataFrame] | None = None


def grid(cells: DataFrame) -> DataFrame:
    """Every (row_key, col_key) with its value or null. Built per row from the item list, which is broadcast after a size check."""
    items = [r[0] for r in cells.select("col_key").distinct().limit(MAX_ITEMS + 1).collect()]
    if len(items) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items")
    kind = dict(cells.dtypes)["col_key"]
    listed = F.array(*[F.lit(i).cast(kind) for i in sorted(items)]) if items else F.array().cast(f"array<{kind}>")
    full = cells.select("row_key").distinct().select("row_key", F.explode(listed).alias("col_key"))
    return full.join(cells.select("row_key", "col_key", "value"), ["row_key", "col_key"], "left")


#: Cells that a task emits at once, and rows whose cells it completes together at least.
EMIT_CELLS, EMIT_ROWS = 500_000, 64


def _emit(packed: DataFrame, kinds: dict, items: list, rows_of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The whole grid as (row_key, col_key, value): ``packed`` has a row per entity with its observed items (their positions ``idx`` or keys
    ``key``) and their values ``raw``, which are put over what ``rows_of`` gives for a block of its rows from their ``idx``, ``val`` and numbers
    of cells. Nothing is shuffled or joined by cell, and no number of items is too large: the list of items, once per task, is all that
    grows with it. A block goes out item by item, so that equal values follow each other and take little room in a file of columns."""
    fields = packed.select("row_key").schema.fields
    typed = T.StructType([*fields, T.StructField("col_key", T._parse_datatype_string(kinds["col_key"])), T.StructField("value", T.DoubleType())])
    names = packed.sparkSession.sparkContext.broadcast(items)
    given = [c for c in ("idx", "key", "val", "raw") if c in packed.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = None
        for batch in batches:
            if listed is None:
                listed = pa.array(names.value, to_arrow_type(typed["col_key"].dataType))
            step = max(EMIT_ROWS, EMIT_CELLS // max(1, len(listed)))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                flat = {c: part.column(c).flatten() for c in given}
                idx, val, raw = (flat[c].to_numpy(zero_copy_only=False) if c in flat else None for c in ("idx", "val", "raw"))
                if "key" in flat:
                    idx = pc.index_in(flat["key"], listed).to_numpy(zero_copy_only=False)
                counts = _lengths(part.column("raw"))
                out = rows_of(idx, val, counts)
                out[np.repeat(np.arange(len(counts)), counts), idx] = raw
                n, p = out.shape
                wide = max(1, EMIT_CELLS // n)
                for c in range(0, p, wide):
                    some = out[:, c : c + wide].T
                    rows = part.column("row_key").take(pa.array(np.tile(np.arange(n), len(some))))
                    cols = listed.take(pa.array(np.repeat(np.arange(c, c + len(some)), n)))
                    yield pa.RecordBatch.from_arrays([rows, cols, pa.array(np.ascontiguousarray(some).ravel())], names=["row_key", "col_key", "value"])

    return packed.select("row_key", *given).mapInArrow(run, typed)


def mean_impute(cells: DataFrame) -> DataFrame:
    """Empty cells take their column's mean."""
    seen = F.when(F.col("value").isNotNull() & F.col("col_key").isNotNull(), F.struct("col_key", F.col("value").cast("double").alias("value")))
    packed = cut(cells.groupBy("row_key").agg(F.collect_list(seen).alias("_c")).select("row_key", F.col("_c.col_key").alias("key"), F.col("_c.value").alias("raw")), "mean-rows")
    each = packed.select(F.explode(F.arrays_zip("key", "raw")).alias("_c")).select(F.col("_c.key").alias("col_key"), F.col("_c.raw").alias("value"))
    items = each.groupBy("col_key").agg(F.avg("value").alias("mu")).orderBy("col_key").toPandas()
    mu = cells.sparkSession.sparkContext.broadcast(items["mu"].to_numpy(float))
    return _emit(packed, dict(cells.dtypes), items["col_key"].tolist(), lambda idx, val, counts: np.tile(mu.value, (len(counts), 1)))


#: Rows whose distances to all rows a task holds at once, rows a task takes, and columns seen by fewer of the rows than this share are added by place.
KNN_ROWS, KNN_TASK_ROWS, DENSE_SHARE = 8, 4_000, 0.2


def knn_impute(cells: DataFrame, k: int = 5) -> DataFrame:
    """Empty cells take the mean of the k nearest rows that observe the column; the column's mean where no row has a distance.

    Distance of two rows: mean over the columns both observe of the difference by the column's range; ties by row key. Every pair of
    rows is compared, none is sampled: the work is rows squared times columns, but no pair leaves its task. Each task gets all cells and
    completes its share of the rows, so tasks grow with the rows and a task's memory is that of the cells.
    """
    seen = cells.filter("value is not null").select("row_key", "col_key", "value")
    kinds = dict(cells.dtypes)
    all_cells = cut(cells.select("row_key", "col_key", F.col("value").cast("double").alias("value")).filter("row_key is not null and col_key is not null"), "knn")
    parts = max(12, -(-all_cells.select("row_key").distinct().count() // KNN_TASK_ROWS))
    sent = all_cells.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row, rows = pd.factorize(pdf["row_key"], sort=True)
        col, cols = pd.factorize(pdf["col_key"], sort=True)
        value = pdf["value"].to_numpy(float)
        i, j, filled = _knn_share(row, col, value, len(rows), len(cols), int(key[0]), parts, k)
        return pd.DataFrame({"row_key": np.asarray(rows)[i], "col_key": np.asarray(cols)[j], "value": filled})

    filled = sent.groupBy("_p").applyInPandas(run, f"row_key {kinds['row_key']}, col_key {kinds['col_key']}, value double")
    return seen.unionByName(filled)


def _knn_share(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, p: int, part: int, parts: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fills (row, column, value) of the rows part, part + parts, ... from the cells of all n rows (nan: none)."""
    x = np.full((p, n), np.nan)
    x[col, row] = value
    mask = ~np.isnan(x)
    means = np.array([v[m].mean() if m.any() else np.nan for v, m in zip(x, mask)])
    spread = np.array([v[m].max() - v[m].min() if m.any() else 0.0 for v, m in zip(x, mask)])
    scaled = np.zeros((p, n))
    np.divide(x, spread[:, None], out=scaled, where=mask & (spread > 0)[:, None])
    at = [np.flatnonzero(m) if m.mean() < DENSE_SHARE else None for m in mask]
    weight = mask.astype(np.float32)
    usable = ~np.isnan(means)
    out_i, out_j, out_v = [], [], []
    mine = np.arange(part, n, parts)
    work = np.empty(n)
    for start in range(0, len(mine), KNN_ROWS):
        own = mine[start : start + KNN_ROWS]
        shared = weight[:, own].T @ weight  # columns that both observe
        for a, common in zip(own, shared):
            empty = np.flatnonzero(~mask[:, a] & usable)
            if not len(empty):
                continue
            total = np.zeros(n)
            for j in np.flatnonzero(mask[:, a]):
                if at[j] is not None:
                    total[at[j]] += np.abs(scaled[j, at[j]] - scaled[j, a])
                else:
                    np.subtract(scaled[j], scaled[j, a], out=work)
                    np.abs(work, out=work)
                    work *= weight[j]
                    total += work
            near = np.flatnonzero(common > 0)
            near = near[near != a]
            near = near[np.argsort(np.round(total[near] / common[near].astype(float), 9), kind="stable")]
            take, open_ = 64, empty
            while len(open_):
                first = near[:take]
                has = mask[np.ix_(open_, first)]
                nth = has.cumsum(1)
                done = (nth[:, -1] >= k) if len(first) else np.zeros(len(open_), bool)
                done |= take >= len(near)
                for j, h, c in zip(open_[done], has[done], nth[done]):
                    donors = first[h & (c <= k)]
                    out_i.append(a), out_j.append(j), out_v.append(x[j, donors].mean() if len(donors) else means[j])
                open_, take = open_[~done], take * 4
    return np.array(out_i, int), np.array(out_j, int), np.array(out_v, float)


def _rows_of(cells: DataFrame) -> tuple[DataFrame, dict, dict, list]:
    """Standardised cells as one row per entity: arrays of item positions, z-values and values; and the items' moments, of the cells
    that are not ``held`` where that column is given. Held-out cells are put aside as ``hidx`` and ``hval``, so a row may have these only."""
    marked = cells.filter("value is not null")
    stats = cut(moments(marked.filter("not held") if "held" in cells.columns else marked), "moments")
    rows = stats.orderBy("col_key").collect()  # one row per item
    items = [r.col_key for r in rows]
    place = cells.sparkSession.createDataFrame([(c, i) for i, c in enumerate(items)], T.StructType([*cells.select("col_key").schema.fields, T.StructField("_i", T.IntegerType())]))
    z = marked.join(stats, "col_key").join(checked_broadcast(place), "col_key").withColumn("z", (F.col("value") - F.col("mu")) / F.col("sd"))
    if "held" in cells.columns:
        kept, away = F.when(~F.col("held"), F.struct("_i", "z")), F.when(F.col("held"), F.struct("_i", "z"))
        packed = z.groupBy("row_key").agg(F.collect_list(kept).alias("k"), F.collect_list(away).alias("a")).select("row_key", F.col("k._i").alias("idx"), F.col("k.z").alias("val"), F.col("a._i").alias("hidx"), F.col("a.z").alias("hval"))
    else:
        packed = z.groupBy("row_key").agg(F.collect_list("_i").alias("idx"), F.collect_list("z").alias("val"), F.collect_list(F.col("value").cast("double")).alias("raw"))
    return packed, {r.col_key: r.mu for r in rows}, {r.col_key: r.sd for r in rows}, items


def _blocks(packed: DataFrame) -> RDD | list[dict]:
    """The rows as blocks of about BLOCK_CELLS cells, in row order and in item order, for the passes: on the driver if they are small, else
    serialised in as many tasks as there are cores. Executors hold them in memory, then on disk; a lost one is made again from the packed rows.
    """
    names = [c for c in ("idx", "val", "hidx", "hval") if c in packed.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = len(batch.column("idx").flatten())
            step = max(1, BLOCK_CELLS * batch.num_rows // max(1, cells))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                flat = {c: part.column(c).flatten().to_numpy(zero_copy_only=False) for c in names}
                counts = _lengths(part.column("idx"))
                order = np.argsort(flat["idx"], kind="stable")
                flat |= {"counts": counts, "row": np.repeat(np.arange(len(counts), dtype=np.int32), counts)[order], "by_item": flat["val"][order]}
                flat["items"], flat["item_counts"] = np.unique(flat["idx"], return_counts=True)
                if "hidx" in flat:
                    flat["hcounts"] = _lengths(part.column("hidx"))
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(flat, 5)], pa.binary())], names=["block"])

    blocks = packed.select(*names).coalesce(max(1, packed.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "block binary").rdd
    blocks = blocks.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
    if blocks.map(len).sum() > DRIVER_BYTES:
        return blocks
    here = [pickle.loads(x) for x in blocks.collect()]
    blocks.unpersist()
    return here


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _added(blocks: RDD | list[dict], given: object, run: Callable[[Iterator[dict], object], np.ndarray]) -> np.ndarray:
    """The sum over the tasks of the numbers that ``run`` gives for the blocks of one and what is given to all."""
    if isinstance(blocks, list):
        return run(iter(blocks), given)
    held = blocks.context.broadcast(given)
    parts = blocks.mapPartitions(lambda own: [run(map(pickle.loads, own), held.value)])
    total = parts.treeReduce(np.add) if blocks.getNumPartitions() > SLOTS else functools.reduce(np.add, parts.collect())
    held.destroy()
    return total


def _dropped(blocks: RDD | list[dict]) -> None:
    if not isinstance(blocks, list):
        blocks.unpersist()


def _segments(table: np.ndarray, at: np.ndarray, counts: np.ndarray, weight: np.ndarray | None = None, weighted: int = 0) -> np.ndarray:
    """Sums of consecutive runs, ``counts`` long each, of the rows ``at`` of a table, its columns from ``weighted`` on times ``weight``; 0 for an
    empty run. A column at a time: sums along it are contiguous and no table by cell is made."""
    out = np.zeros((len(counts), table.shape[1]))
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    if len(starts):
        for k in range(table.shape[1]):
            x = np.ascontiguousarray(table[:, k])[at]
            if weight is not None and k >= weighted:
                x *= weight
            out[some, k] = np.add.reduceat(x, starts)
    return out


def _with_pairs(x: np.ndarray) -> np.ndarray:
    """The products of each pair of columns, followed by the columns."""
    i, j = np.triu_indices(x.shape[1])
    return np.c_[x[:, i] * x[:, j], x]


def _width(b: np.ndarray) -> int:
    """Columns of ``_with_pairs``."""
    return b.shape[1] * (b.shape[1] + 3) // 2


def _normal(sums: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal matrices (r x r) and vectors (r) from the sums of products of each pair of regressors, then those with the target."""
    i, j = np.triu_indices(r)
    normal = np.empty((len(sums), r, r))
    normal[:, i, j] = normal[:, j, i] = sums[:, : len(i)]
    return normal, sums[:, len(i) :]


def _solved(sums: np.ndarray, r: int, lam: float) -> np.ndarray:
    """Ridge regressions from their sums."""
    normal, right = _normal(sums, r)
    return np.linalg.solve(normal + lam * np.eye(r), right[:, :, None])[:, :, 0]


def _left(b: np.ndarray, idx: np.ndarray, val: np.ndarray, counts: np.ndarray, lam: float) -> np.ndarray:
    """The rows' left factors: ridge regressions of their observed cells on the right factor's rows; 0 without such a cell."""
    return _solved(_segments(_with_pairs(b), idx, counts, val, _width(b) - b.shape[1]), b.shape[1], lam)


def _passes(blocks: RDD | list[dict], factors: list[np.ndarray], lam: float, scored: bool = False) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each right factor: per item the sums of its ridge regression on the rows' left factors; the left factors' products; and, if
    ``scored``, the products of all pairs a_i b_j at the held-out cells, followed by these cells' values.

    Each task solves its rows against the broadcast factors and returns one array of sums; no row leaves its task.
    """

    def run(own: Iterator[dict], factors: list[np.ndarray]) -> np.ndarray:
        sums = [(np.zeros((len(b), _width(b))), np.zeros((b.shape[1],) * 2), np.zeros((b.shape[1] ** 2 + 1,) * 2)) for b in factors]
        for x in own:
            for b, (items, gram, errors) in zip(factors, sums):
                a = _left(b, x["idx"], x["val"], x["counts"], lam)
                items[x["items"]] += _segments(_with_pairs(a), x["row"], x["item_counts"], x["by_item"], _width(a) - a.shape[1])
                gram += a.T @ a
                if scored and len(x["hidx"]):
                    f = np.repeat(a, x["hcounts"], axis=0)[:, :, None] * b[x["hidx"]][:, None, :]
                    f = np.c_[f.reshape(len(f), -1), x["hval"]]
                    errors += f.T @ f
        return np.concatenate([y.ravel() for three in sums for y in three])

    total, got, at = _added(blocks, factors, run), [], 0
    for b in factors:
        three = []
        for shape in ((len(b), _width(b)), (b.shape[1],) * 2, (b.shape[1] ** 2 + 1,) * 2):
            three.append(total[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)
        got.append(tuple(three))
    return got


def _right_sums(blocks: RDD | list[dict], b: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray]:
    return _normal(_passes(blocks, [b], lam)[0][0], b.shape[1])


def _balanced(gram: np.ndarray, b: np.ndarray) -> np.ndarray:
    """V sqrt(D) of the matrix A b' = U D V', where A'A is ``gram``."""
    w, q = np.linalg.eigh(gram)
    _, d, v = np.linalg.svd((q * np.sqrt(np.maximum(w, 0))).T @ b.T, full_matrices=False)
    return v.T * np.sqrt(d)


def _turned(b: np.ndarray, to: np.ndarray) -> np.ndarray:
    """``b`` turned to be nearest to another factor, which leaves the completion as it is."""
    u, _, v = np.linalg.svd(b.T @ to)
    return b @ (u @ v)


def _upright(b: np.ndarray) -> np.ndarray:
    """``b`` turned so that its columns are orthogonal, by falling size."""
    u, d, _ = np.linalg.svd(b, full_matrices=False)
    return u * d


def _threshold(gram: np.ndarray, b: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """SVD of the filled matrix in the space of the right factor, its singular values lowered by ``lam``: the r x r matrix k for which
    a row's completion is a k b', and V sqrt(D) of that completion, columns by falling D.

    b = V sqrt(D). The filled matrix X* holds the observed cells and A b' elsewhere, so the ridge equations of a row give
    X* V = A (D + lam) / sqrt(D), and the r x r products of A are all that the decomposition needs.
    """
    d = (b**2).sum(0)
    root = np.sqrt(np.where(d > 1e-12 * max(d.max(), 1e-300), d, np.inf))
    t = np.where(np.isinf(root), 0, (d + lam) / root)
    w, q = np.linalg.eigh(t[:, None] * gram * t)
    s = np.sqrt(np.maximum(w, 0))[::-1]
    q, low = q[:, ::-1], np.maximum(s - lam, 0)
    share = np.divide(low, s, out=np.zeros_like(s), where=s > 0)
    return (t[:, None] * q * share) @ (q.T / root), (b / root) @ q * np.sqrt(low)


def _seeded(warm: np.ndarray, top: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A start with all columns alive: those that a larger lambda had cut off start at the leading vectors, as large as the least kept."""
    d = (warm**2).sum(0)
    k, r = int((d > 0).sum()), len(d)
    if not k:
        return q[:, :r] * np.sqrt(top[:r])
    own = np.linalg.qr(np.c_[warm[:, :k] / np.sqrt(d[:k]), q[:, k:r]])[0][:, k:]
    return np.c_[warm[:, :k], own * np.sqrt(d[k - 1])]


def _settled(blocks: RDD | list[dict], factors: dict[int, np.ndarray], lam: float, passes: int, thresh: float) -> dict[int, np.ndarray]:
    """Right factors after alternating ridge regressions until the completion's squared change in a pass is at most ``thresh`` of its square.

    Measured is the change by the right factor, one of two halves of a pass, so its bound is a quarter. A pass starts from the last
    factor carried on by its momentum, which begins anew whenever it points against the pass.
    """
    done: dict[int, np.ndarray] = {}
    now = {r: (b, b, 0) for r, b in factors.items()}  # where the pass starts, the last factor, steps of momentum
    for _ in range(passes):
        for (r, (b, last, k)), (sums, gram, _) in zip(list(now.items()), _passes(blocks, [b for b, _, _ in now.values()], lam)):
            new = _solved(sums, b.shape[1], lam)
            moved, size = (np.trace(gram @ (x.T @ x)) for x in (new - b, b))
            new = _turned(_balanced(gram, new), b)
            if moved <= thresh / 4 * size:
                done[r] = _upright(new)
                del now[r]
                continue
            k = 0 if ((b - new) * (new - last)).sum() > 0 else k + 1
            now[r] = new + k / (k + 3) * (new - last), new, k
        if not now:
            break
    else:
        warnings.warn(f"softimpute: not settled after {passes} passes at lambda {lam:.4g}, ranks {sorted(now)}", stacklevel=2)
    return {r: done[r] if r in done else _upright(now[r][1]) for r in factors}


def _gram_times(blocks: RDD | list[dict], q: np.ndarray) -> np.ndarray:
    """Z' Z q for the zero-filled matrix Z of the rows."""

    def run(own: Iterator[dict], q: np.ndarray) -> np.ndarray:
        total = np.zeros(q.shape)
        for x in own:
            a = _segments(q, x["idx"], x["counts"], x["val"])
            total[x["items"]] += _segments(a, x["row"], x["item_counts"], x["by_item"])
        return total

    return _added(blocks, q, run)


def _spectrum(packed: DataFrame | RDD | list[dict], p: int, r: int, steps: int = 40, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """The ``r`` largest singular values of the zero-filled matrix, largest first, and their right singular vectors.

    Block Lanczos with full orthogonalisation, a job a step, until the values settle or the basis is the whole space: p x steps numbers on
    the driver, and no p x p matrix.
    """
    blocks = _blocks(packed) if isinstance(packed, DataFrame) else packed
    block = np.linalg.qr(np.random.default_rng(1).standard_normal((p, min(p, r + 8))))[0]
    basis, inner, top = np.zeros((p, 0)), np.zeros((0, 0)), None
    for _ in range(steps):
        made = _gram_times(blocks, block)
        cross, own, before = basis.T @ made, block.T @ made, top
        inner = np.block([[inner, cross], [cross.T, own]])
        basis = np.c_[basis, block]
        w, u = np.linalg.eigh((inner + inner.T) / 2)
        top = w[::-1][:r]
        if basis.shape[1] >= p or before is not None and np.abs(top - before).max() <= tol * max(top[0], 1e-9):
            break
        for _ in range(2):
            made = made - basis @ (basis.T @ made)
        q, size, _ = np.linalg.svd(made, full_matrices=False)
        block = q[:, size > 1e-9 * max(top[0], 1e-9)][:, : p - basis.shape[1]]
        if not block.shape[1]:
            break
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
    if isinstance(packed, DataFrame):
        _dropped(blocks)
    return np.sqrt(np.maximum(top, 1e-9)), basis @ u[:, ::-1][:, :r]


def softimpute(cells: DataFrame, rank: int = 5, lam: float | None = None, passes: int = 500, thresh: float = THRESH) -> DataFrame:
    """Nuclear-norm matrix completion at a rank cap, over column-standardised cells.

    The nuclear norm of a rank-r matrix AB' is the smallest (|A|^2 + |B|^2) / 2, so alternating ridge regressions of rows and items
    solve it; the end is the soft-thresholded SVD of the filled matrix. Rows stay distributed; the driver holds the p x r right factor.
    ``lam`` is chosen by held-out cells along its path where it is not given.
    """
    if lam is None:
        return softimpute_path(cells, (rank,)).cells
    packed, mu, sd, items = _rows_of(cells)
    packed = cut(packed, "softimpute-rows")
    r = max(1, min(rank, len(items)))
    blocks = _blocks(packed)
    top, q = _spectrum(blocks, len(items), r)
    b, k = np.zeros((len(items), r)), np.zeros((r, r))
    if lam < top[0]:  # else the solution is 0
        b = _settled(blocks, {r: q[:, :r] * np.sqrt(top[:r])}, lam, passes, thresh)[r]
        ((_, gram, _),) = _passes(blocks, [b], lam)
        k, _ = _threshold(gram, b, lam)
    _dropped(blocks)
    return _completed(cells, packed, b, k, lam, mu, sd, items)


def _completed(cells: DataFrame, packed: DataFrame, b: np.ndarray, k: np.ndarray, lam: float, mu: dict, sd: dict, items: list) -> DataFrame:
    """The whole grid: observed cells as they are, the others from the right factor and their row's left factor."""
    held = cells.sparkSession.sparkContext.broadcast((b, k @ b.T * np.array([sd[c] for c in items]), lam, np.array([mu[c] for c in items])))

    def predict(idx: np.ndarray, val: np.ndarray, counts: np.ndarray) -> np.ndarray:
        b, right, lam, mu = held.value
        return _left(b, idx, val, counts, lam) @ right + mu

    return _emit(packed, dict(cells.dtypes), items, predict)


def softimpute_path(cells: DataFrame, ranks: tuple[int, ...] = tuple(range(1, 11)), seed: int = 1, steps: int = 30, passes: int = 300, thresh: float = THRESH) -> Imputation:
    """Rank caps by held-out score, each at its best point of a path of ``steps`` values of lambda.

    The path falls evenly on a log scale from the largest singular value of the training cells, where the solution is 0, to a hundredth of
    it; each point starts from the one before. All rank caps move along it together, one job a pass. A rank's lambda is the one of the
    smallest rmse of held-out cells; its score is that of the masked fit there. The best rank is fitted again to all cells at its lambda.
    """
    packed, _, _, items = _rows_of(cut(holdout(cells, seed=seed), "held"))
    blocks = _blocks(cut(packed, "path-rows"))
    p = len(items)
    ranks = tuple(sorted({max(1, min(int(r), p)) for r in ranks}))
    top, q = _spectrum(blocks, p, ranks[-1])
    nothing = {r: (np.zeros((p, r)), np.zeros((r, r))) for r in ranks}
    n = _held_out(blocks, [(*nothing[ranks[0]], 1.0)])[0]
    best = {r: (math.sqrt(n[1].sum() / n[0].sum()) if n[0].sum() else math.inf, float(top[0]), *nothing[r]) for r in ranks}
    warm = {r: b for r, (b, _) in nothing.items()}
    for lam in np.geomspace(top[0], top[0] / 100, steps)[1:].tolist():
        now = _settled(blocks, {r: _seeded(b, top, q) for r, b in warm.items()}, lam, passes, thresh)
        for (r, b), (_, gram, f) in zip(now.items(), _passes(blocks, list(now.values()), lam, True)):
            k, warm[r] = _threshold(gram, b, lam)
            by = np.append(k.ravel(), -1)
            error = math.sqrt(max(0.0, by @ f @ by) / n[0].sum()) if n[0].sum() else math.inf
            best[r] = min(best[r], (error, lam, b, k), key=lambda x: x[0])
    curve = []
    for r, (seen, error, base) in zip(ranks, _held_out(blocks, [(b, k, lam) for _, lam, b, k in best.values()])):
        some = seen > 0
        mse, mean = error[some] / seen[some], base[some] / seen[some]
        curve.append((r, float(np.sqrt(mse).mean()) if some.any() else math.inf, float(1 - mse.mean() / mean.mean()) if mean.sum() else None))
    _dropped(blocks)
    chosen = min(range(len(ranks)), key=lambda i: (curve[i][1], ranks[i]))
    at = {r: x[1] for r, x in best.items()}
    return Imputation(softimpute(cells, ranks[chosen], at[ranks[chosen]]), ranks[chosen], "rank", curve, lambda r: softimpute(cells, int(r), at.get(int(r))))


def _held_out(blocks: RDD | list[dict], fits: list[tuple[np.ndarray, np.ndarray, float]]) -> list[np.ndarray]:
    """For each fit (b, k, lambda) three numbers per item: its held-out cells, the sum of their squared errors, and that of predicting the mean."""

    def run(own: Iterator[dict], fits: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
        total = np.zeros((len(fits), 3, len(fits[0][0])))
        for x in own:
            for sums, (b, k, lam) in zip(total, fits):
                a = np.repeat(_left(b, x["idx"], x["val"], x["counts"], lam) @ k, x["hcounts"], axis=0)
                error = (a * b[x["hidx"]]).sum(1) - x["hval"]
                for y, weight in zip(sums, (None, error**2, x["hval"] ** 2)):
                    y += np.bincount(x["hidx"], weight, len(y))
        return total

    return list(_added(blocks, fits, run))


def _driver_matrix(cells: DataFrame) -> tuple[np.ndarray, list, list]:
    """A dense matrix on the driver for kernels that are sequential over columns; at most 2 million cells."""
    rows = cells.select("row_key", "col_key", "value").filter("value is not null").limit(2_000_001).collect()
    if len(rows) > 2_000_000:
        raise ValueError("more than 2 million cells: use softimpute or mean_impute")
    rk, ck = sorted({r.row_key for r in rows}), sorted({r.col_key for r in rows})
    ri, ci = {k: i for i, k in enumerate(rk)}, {k: i for i, k in enumerate(ck)}
    x = np.full((len(rk), len(ck)), np.nan)
    for r in rows:
        x[ri[r.row_key], ci[r.col_key]] = r.value
    return x, rk, ck


def _to_cells(cells: DataFrame, x: np.ndarray, rk: list, ck: list) -> DataFrame:
    pdf = pd.DataFrame({"row_key": np.repeat(np.array(rk, object), len(ck)), "col_key": np.tile(np.array(ck, object), len(rk)), "value": x.ravel()})
    return cells.sparkSession.createDataFrame(pdf, cells.select("row_key", "col_key", F.col("value").cast("double")).schema)


def chained_equations(cells: DataFrame, m: int = 5, sweeps: int = 5, ridge: float = 1e-3, predictors: int = 10, donors: int = 5, seed: int = 1) -> DataFrame:
    """Mean of ``m`` completions by chained ridge regressions with predictive mean matching; predictors by correlation."""
    x, rk, ck = _driver_matrix(cells)
    miss = np.isnan(x)
    mu, sd = np.nanmean(x, 0), np.nanstd(x, 0)
    sd[~(sd > 0)] = 1
    z0 = np.where(miss, 0, (x - mu) / sd)
    corr = np.abs(np.nan_to_num(np.corrcoef(z0.T))) if len(ck) > 1 else np.ones((1, 1))
    np.fill_diagonal(corr, 0)
    total = np.zeros_like(z0)
    for k in range(m):
        rng = np.random.default_rng(seed * 1000 + k)
        z = z0.copy()
        for j in range(len(ck)):
            if miss[:, j].any() and (~miss[:, j]).any():
                z[miss[:, j], j] = rng.choice(z0[~miss[:, j], j], miss[:, j].sum())
        for _ in range(sweeps):
            for j in np.argsort(miss.sum(0)):
                obs = ~miss[:, j]
                use = np.argsort(-corr[j])[: min(predictors, len(ck) - 1)]
                if obs.sum() < 3 or not len(use) or obs.all():
                    continue
                a = np.c_[np.ones(len(z)), z[:, use]]
                ata = a[obs].T @ a[obs]
                ata += ridge * np.diag(np.diag(ata)) + 1e-9 * np.eye(len(ata))
                inv = np.linalg.inv(ata)
                beta = inv @ a[obs].T @ z[obs, j]
                resid = z[obs, j] - a[obs] @ beta
                s = math.sqrt(max(1e-9, resid @ resid / max(1, obs.sum() - a.shape[1])))
                drawn = beta + s * np.linalg.cholesky((inv + inv.T) / 2 + 1e-12 * np.eye(len(inv))) @ rng.standard_normal(len(beta))
                have, want = a[obs] @ beta, a[~obs] @ drawn
                order = np.argsort(have)
                at = np.clip(np.searchsorted(have[order], want) - donors // 2, 0, max(0, obs.sum() - donors))
                z[~obs, j] = z[obs, j][order[np.minimum(at + rng.integers(0, min(donors, obs.sum()), len(want)), obs.sum() - 1)]]
        total += z
    return _to_cells(cells, np.where(miss, total / m * sd + mu, x), rk, ck)


def _tree(a: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, leaf: int) -> list:
    """A regression tree on random features and cut points, as nested lists."""
    if depth == 0 or len(y) < 2 * leaf or y.max() - y.min() < 1e-12:
        return [float(y.mean())]
    best = (y.var() * len(y) - 1e-12, None, 0.0)
    for f in rng.choice(a.shape[1], max(1, a.shape[1] // 3), replace=False):
        for c in rng.choice(a[:, f], min(8, len(y)), replace=False):
            left = a[:, f] <= c
            n = left.sum()
            if leaf <= n <= len(y) - leaf:
                s = y[left].var() * n + y[~left].var() * (len(y) - n)
                if s < best[0]:
                    best = (s, f, c)
    if best[1] is None:
        return [float(y.mean())]
    left = a[:, best[1]] <= best[2]
    return [best[1], best[2], _tree(a[left], y[left], rng, depth - 1, leaf), _tree(a[~left], y[~left], rng, depth - 1, leaf)]


def _apply(tree: list, a: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(a), tree[0])
    left, out = a[:, tree[0]] <= tree[1], np.empty(len(a))
    out[left], out[~left] = _apply(tree[2], a[left]), _apply(tree[3], a[~left])
    return out


def forest_impute(cells: DataFrame, trees: int = 50, rounds: int = 10, depth: int = 8, leaf: int = 3, seed: int = 1) -> DataFrame:
    """Iterated random forests: columns by ascending missingness, until the change first grows or after ``rounds``. The trees of a
    column grow in parallel tasks over the broadcast matrix (at most 2 million cells)."""
    spark = cells.sparkSession
    x, rk, ck = _driver_matrix(cells)
    miss = np.isnan(x)
    now, before = np.where(miss, np.nanmean(x, 0), x), math.inf
    per_task = max(1, trees // 8)
    for r in range(rounds):
        nxt = now.copy()
        held = spark.sparkContext.broadcast((now, miss))
        jobs = [(int(j), t, min(per_task, trees - t)) for j in np.argsort(miss.sum(0)) if miss[:, j].any() and len(ck) > 1 for t in range(0, trees, per_task)]
        if not jobs:
            break

        def grow(batches: Iterator[pd.DataFrame], held=held, r=r) -> Iterator[pd.DataFrame]:
            now, miss = held.value
            for pdf in batches:
                for j, t, n in zip(pdf["j"], pdf["t"], pdf["n"]):
                    obs, rest = ~miss[:, j], [c for c in range(now.shape[1]) if c != j]
                    a, total = now[:, rest], np.zeros((~obs).sum())
                    for k in range(t, t + n):
                        rng = np.random.default_rng([seed, r, int(j), int(k)])
                        rows = rng.choice(np.flatnonzero(obs), obs.sum())
                        total += _apply(_tree(a[rows], now[rows, j], rng, depth, leaf), a[~obs])
                    yield pd.DataFrame({"j": [int(j)], "s": [total.tolist()]})

        grown = spark.createDataFrame(jobs, "j int, t int, n int").repartition(min(64, len(jobs))).mapInPandas(grow, "j int, s array<double>").collect()
        for j in {g.j for g in grown}:
            nxt[miss[:, j], j] = np.sum([g.s for g in grown if g.j == j], 0) / trees
        change = ((nxt - now)[miss] ** 2).sum() / max(1e-12, (nxt[miss] ** 2).sum())
        if change > before:
            break
        now, before = nxt, change
    return _to_cells(cells, now, rk, ck)


def one_sided(cells: DataFrame, rank: int, iters: int = 2000, seed: int = 1) -> DataFrame:
    """Empty cells take their conditional mean given the row's cells under the one-sided fit of the items' covariance."""
    from gridloom.operators import osmc

    seen = cells.filter("value is not null").select("row_key", "col_key", "value")
    stats = cut(moments(seen), "moments")
    z = cut(seen.join(stats, "col_key").select("row_key", "col_key", ((F.col("value") - F.col("mu")) / F.col("sd")).alias("value")), "z")
    t = osmc.pair_table(z)
    given = z.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("col_key", "value"))).alias("given"))
    empty = grid(cells).filter("value is null").select("row_key", "col_key").join(given, "row_key", "left")
    filled = osmc.predict(empty, osmc.fit(t, min(rank, len(t.items)), iters, seed=seed), t.items).join(stats, "col_key")
    return seen.unionByName(filled.select("row_key", "col_key", (F.col("value") * F.col("sd") + F.col("mu")).alias("value")))


IMPUTERS: dict[str, tuple[str, tuple[float, ...], Callable[[DataFrame, float], DataFrame]]] = {
    "mean": ("none", (0,), lambda c, _: mean_impute(c)),
    "knn": ("k", tuple(range(1, 11)), lambda c, k: knn_impute(c, int(k))),
    "softimpute": ("rank", tuple(range(1, 11)), lambda c, r: softimpute(c, int(r))),
    "onesided": ("rank", tuple(range(1, 11)), lambda c, r: one_sided(c, int(r))),
    "mice": ("m", (5, 10, 20), lambda c, m: chained_equations(c, int(m))),
    "missforest": ("ntree", (50, 100, 200, 400), lambda c, n: forest_impute(c, int(n))),
}


def impute(cells: DataFrame, method: str, params: tuple[float, ...] | None = None, seed: int = 1) -> Imputation:
    """Completes with the parameter of the smallest balanced held-out rmse; a failing or undefined score counts as infinite."""
    name, grid_, run = IMPUTERS[method]
    if method == "softimpute":
        return softimpute_path(cells, tuple(int(p) for p in params or grid_), seed)
    marked = cut(holdout(cells, seed=seed), "held")
    train, held = marked.filter("not held").drop("held"), marked.filter("held").drop("held")
    curve = []
    for p in params or grid_:
        s = score(held, run(train, p), train).first()
        curve.append((p, math.inf if s.rmse is None else s.rmse, s.r2))
    best = min(curve, key=lambda c: (c[1], c[0]))[0]
    return Imputation(run(cells, best), best, name, curve, lambda p: run(cells, p))


def sensitivity(cells: DataFrame, method: str, params: tuple[float, ...], seeds: int) -> list[tuple[int, float, float, float]]:
    """(seed, param, rmse, r2) of fresh holdouts; the seeds are independent jobs."""
    return [(s, p, r, q) for s in range(1, seeds + 1) for p, r, q in impute(cells, method, params, s).curve]
