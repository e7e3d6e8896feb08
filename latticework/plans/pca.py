"""Principal components of a sparse matrix, without making it dense.

Three ways to the same components, all of which centre implicitly:

- ``gram``: X'X is summed from dense blocks of rows inside tasks (matrix products), corrected for
  the mean, and decomposed on the driver. For up to GRAM_COLUMNS columns.
- ``lanczos``: Lanczos steps with full reorthogonalisation, each one pass v -> X'(Xv), until the
  residuals of all components asked for are within the tolerance.
- ``RandomSVD``: a seeded random sketch, improved by power iterations with QR, one pass each.

What tasks add up is merged as a tree of tasks, so that a handful of arrays as large as the column axis
(its square for ``gram``) come to the driver however many tasks there are; rows never do.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.matrix import SparseMatrix
from latticework.operators.stats import all_variance, as_mask, axis_stats
from latticework.session import write_shared

log = logging.getLogger(__name__)

#: columns up to which the Gram matrix is decomposed on the driver, and those of which its pairs are block products
GRAM_COLUMNS = 4096
#: rows of a dense block
BLOCK_ROWS = 512
#: arrays that one task merges at most, and bytes of them
FAN_IN, FAN_IN_BYTES = 16, 1 << 28
#: columns on a side of a tile of X'X, rows of it that are summed up and written at once, and blocks of rows that one
#: task multiplies for a tile
TILE, STRIP, TILE_BLOCKS = 1024, 64, 128
#: tasks that tiles are dealt to at most, and tiles' parts or strips that a task has on average up to there
TILE_TASKS, TILE_SHARE, STRIP_SHARE = 1024, 4, 8
#: Lanczos steps between looks at the residuals
LOOK_EVERY = 4
NORMALIZERS = ("qr",)


@dataclass(frozen=True)
class RandomSVD:
    n_oversamples: int = 10
    n_power_iterations: int = 7
    #: how the sketch is made orthonormal between power iterations
    normalizer: str = "qr"

    def __post_init__(self):
        if self.normalizer not in NORMALIZERS:
            raise ValueError(f"normalizer must be one of {NORMALIZERS}")
        if self.n_oversamples < 0 or self.n_power_iterations < 0:
            raise ValueError("n_oversamples and n_power_iterations must not be negative")


def _cells(m: SparseMatrix) -> DataFrame:
    """(cols, values) per row."""
    return m.dense_rows().select("cols", "values")


def _blocks(batches: Iterator[pa.RecordBatch], place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row in block, column number, value, rows) of blocks of rows; ``place`` maps sorted column ids to
    numbers, and other columns are left out."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(lo, BLOCK_ROWS)
            lists = part.column(0)
            rows = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            values = part.column(1).flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(place, ids)
            known = (at < len(place)) & (place[np.minimum(at, max(0, len(place) - 1))] == ids) if len(place) else np.zeros(len(ids), bool)
            yield rows[known], at[known], values[known], part.num_rows


def merge_arrays(parts: DataFrame, tasks: int, shape: tuple[int, ...], until: int) -> DataFrame:
    """Sums of arrays (part binary) that ``tasks`` tasks made, at most ``until`` of them, by a tree of tasks."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    fan = int(max(2, min(FAN_IN, FAN_IN_BYTES // (8 * max(1, np.prod(shape, dtype=np.int64))))))
    while tasks > until:
        tasks = -(-tasks // fan)
        parts = parts.repartition(tasks).mapInArrow(merge, "part binary")
    return parts


def _partial_sums(rows: DataFrame, columns: np.ndarray, work, shape: tuple[int, ...]) -> tuple[DataFrame, int]:
    """One array of ``shape`` for each task, to which ``work`` adds each of its blocks, and their number."""
    shared = rows.sparkSession.sparkContext.broadcast(columns)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for block in _blocks(batches, shared.value):
            work(total, *block)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return rows.mapInArrow(add, "part binary"), rows.rdd.getNumPartitions()


def _summed(rows: DataFrame, columns: np.ndarray, work, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all rows of what ``work`` adds to an array of ``shape`` for each block."""
    parts, tasks = _partial_sums(rows, columns, work, shape)
    merged = merge_arrays(parts, tasks, shape, FAN_IN)
    return sum((np.frombuffer(bytes(r[0])).reshape(shape) for r in merged.toLocalIterator()), np.zeros(shape))


def _dense_block(r: np.ndarray, c: np.ndarray, v: np.ndarray | float, shape: tuple[int, int]) -> np.ndarray:
    block = np.zeros(shape)
    np.add.at(block, (r, c), v)
    return block


def gram_matrix(rows: DataFrame, columns: np.ndarray) -> np.ndarray:
    n = len(columns)

    def work(total, r, c, v, k):
        block = _dense_block(r, c, v, (k, n))
        total += block.T @ block

    return _summed(rows, columns, work, (n, n))


def _pair_table(m: SparseMatrix, center: bool, divisor: float, everywhere: bool) -> DataFrame:
    """(i, j, value) for i <= j, X'X over the divisor, less the means' part if centred; of all pairs, or of those with a
    common row. Block products, merged by a tree down to one array, whose rows one task writes out; over TILE
    columns, by tiles."""
    n = m.nrows
    columns = m.axis("column").orderBy("col_id").toArrow().column(0).to_numpy().astype(np.int64)  # the result's rows are its square
    width = len(columns)
    if width > TILE:
        return _tiled_pairs(write_shared(_cells(m), "cells"), columns, n, center, divisor, everywhere)
    shape = (2 * width + 1, width)  # X'X, common rows, sums

    def work(total, r, c, v, k):
        x = _dense_block(r, c, v, (k, width))
        total[:width] += x.T @ x
        total[-1] += x.sum(axis=0)
        if not everywhere:
            stored = (_dense_block(r, c, 1.0, (k, width)) > 0).astype(float)
            total[width:-1] += stored.T @ stored

    parts, tasks = _partial_sums(write_shared(_cells(m), "cells"), columns, work, shape)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                total = np.frombuffer(x.as_buffer()).reshape(shape)
                sums = total[-1]
                for i in range(width):
                    j = np.arange(i, width) if everywhere else i + np.flatnonzero(total[width + i, i:])
                    value = total[i, j] - (sums[i] * sums[j] / n if center else 0.0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), columns[i])), pa.array(columns[j]), pa.array(value / divisor)], names=["i", "j", "value"])

    return merge_arrays(parts, max(2, tasks), shape, 1).mapInArrow(out, "i long, j long, value double")


#: a stored cell in a block of rows and a block of columns
_CELL = np.dtype([("r", "<u2"), ("c", "<u2"), ("v", "<f8")])


def _add_product(total: np.ndarray, common: np.ndarray | None, x: np.ndarray, y: np.ndarray) -> None:
    """Add to ``total`` the product of two column blocks of the same rows, given as cells in order of rows, and mark in
    ``common`` the pairs that share a row: one by one where they are few, else as dense matrices."""
    height, (w, _) = int(x["r"].max()) + 1, total.shape
    per_row = np.bincount(y["r"], minlength=height)
    times = per_row[x["r"]]
    pairs = int(times.sum())
    if pairs <= 2 * w * w:
        at = np.arange(pairs) - np.repeat(np.cumsum(times) - times, times) + np.repeat((np.cumsum(per_row) - per_row)[x["r"]], times)
        cell = np.repeat(x["c"].astype(np.int64) * w, times) + y["c"][at]
        np.add.at(total.reshape(-1), cell, np.repeat(x["v"], times) * y["v"][at])
        if common is not None:
            common.reshape(-1)[cell] = True
        return
    shape = (max(height, len(per_row)), w)
    total += _dense_block(x["r"], x["c"], x["v"], shape).T @ _dense_block(y["r"], y["c"], y["v"], shape)
    if common is not None:
        common |= _dense_block(x["r"], x["c"], 1.0, shape).T @ _dense_block(y["r"], y["c"], 1.0, shape) > 0


def _tiled_pairs(cells: DataFrame, columns: np.ndarray, n: int, center: bool, divisor: float, everywhere: bool) -> DataFrame:
    """``_pair_table`` for any number of columns. Blocks of rows send their cells to the tiles of X'X in which they
    have products, a tile's blocks are dealt to several tasks, and the sums meet by strips of a tile, which are written
    from many tasks. No task holds more than a tile."""
    spark, width = cells.sparkSession, len(columns)
    side, strips = -(-width // TILE), -(-TILE // STRIP)
    parts = max(1, -(-n // (BLOCK_ROWS * TILE_BLOCKS)))
    tiles = side * (side + 1) // 2
    tasks = min(TILE_TASKS, -(-tiles * parts // TILE_SHARE))

    def add_sums(total, r, c, v, k):
        np.add.at(total, c, v)

    sums = _summed(cells, columns, add_sums, (width,)) if center else np.zeros(width)
    shared = spark.sparkContext.broadcast((columns, sums))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TaskContext.get().partitionId()
        for r, c, v, k in _blocks(batches, shared.value[0]):
            order = np.argsort(c // TILE, kind="stable")  # cells stay in order of rows
            packed = np.empty(len(r), _CELL)
            packed["r"], packed["c"], packed["v"] = r[order], (c % TILE)[order], v[order]
            present, first = np.unique((c // TILE)[order], return_index=True)
            own = np.split(packed, first[1:])
            has = np.zeros((len(present), k), np.float32)
            for x, cut in enumerate(own[: len(present)]):
                has[x, cut["r"]] = 1
            at, left, right = [], [], []
            for x, y in np.argwhere(np.triu(has @ has.T > 0)):
                both = (has[x] > 0) & (has[y] > 0)
                at.append(present[x] * side + present[y])
                left.append(own[x][both[own[x]["r"]]].tobytes())
                right.append(own[y][both[own[y]["r"]]].tobytes() if x != y else b"")
            part = pa.array(np.full(len(at), count % parts, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), part, pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["tile", "part", "x", "y"])
            count += 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, common, held = np.zeros((TILE, TILE)), None if everywhere else np.zeros((TILE, TILE), bool), None

        def flush() -> pa.RecordBatch:
            strip, at, value = [], [], []
            for s in range(strips):
                part = total[s * STRIP : (s + 1) * STRIP].ravel()
                found = np.flatnonzero(part if common is None else common[s * STRIP : (s + 1) * STRIP])
                if len(found):
                    strip.append(held[0] * strips + s)
                    at.append(found.astype("<i4").tobytes())
                    value.append(part[found].tobytes())
            total[:] = 0
            if common is not None:
                common[:] = False
            return pa.RecordBatch.from_arrays([pa.array(strip, pa.int64()), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["strip", "at", "value"])

        for batch in batches:
            for tile, part, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if held not in (None, (tile, part)):
                    yield flush()
                held = tile, part
                x, y = np.frombuffer(x.as_buffer(), _CELL), np.frombuffer(y.as_buffer(), _CELL)
                _add_product(total, common, x, y if len(y) else x)
        if held:
            yield flush()

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, s = shared.value
        total, common, held = np.zeros(STRIP * TILE), np.zeros(STRIP * TILE, bool), None

        def flush() -> pa.RecordBatch:
            tile, strip = divmod(held, strips)
            found = np.arange(STRIP * TILE) if everywhere else np.flatnonzero(common)
            i, j = tile // side * TILE + strip * STRIP + found // TILE, tile % side * TILE + found % TILE
            ok = (i <= j) & (j < width) & (found // TILE + strip * STRIP < TILE)
            i, j, value = i[ok], j[ok], total[found[ok]]
            total[:], common[:] = 0, False
            if center:
                value = value - s[i] * s[j] / n
            return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(value / divisor)], names=["i", "j", "value"])

        for batch in batches:
            for strip, at, value in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if held not in (None, strip):
                    yield flush()
                held = strip
                at = np.frombuffer(at.as_buffer(), "<i4")
                total[at] += np.frombuffer(value.as_buffer())
                common[at] = True
        if held is not None:
            yield flush()

    products = cells.mapInArrow(split, "tile long, part long, x binary, y binary").repartition(tasks, "tile", "part").sortWithinPartitions("tile", "part")
    strip_sums = products.mapInArrow(multiply, "strip long, at binary, value binary")
    if everywhere:  # strips without a product are there as well
        tile = F.floor(F.col("id") / strips)
        empty = spark.range(side * side * strips).filter(F.floor(tile / side) <= tile % side)
        strip_sums = strip_sums.unionByName(empty.select(F.col("id").alias("strip"), F.lit(b"").alias("at"), F.lit(b"").alias("value")))
    return strip_sums.repartition(min(TILE_TASKS, -(-tiles * strips // STRIP_SHARE)), "strip").sortWithinPartitions("strip").mapInArrow(out, "i long, j long, value double")


def gram_entries(m: SparseMatrix) -> DataFrame:
    """(i, j, value) of X'X for i <= j, of the pairs that have a common row: block products up to GRAM_COLUMNS
    columns, beyond that one self-join, for wide matrices with narrow rows."""
    if m.ncols <= GRAM_COLUMNS:
        return _pair_table(m, False, 1.0, False)
    a = m.entries.select("row_id", F.col("col_id").alias("i"), F.col("value").alias("x"))
    b = m.entries.select("row_id", F.col("col_id").alias("j"), F.col("value").alias("y"))
    pairs = a.join(b, "row_id").filter("i <= j")
    return pairs.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def covariance(m: SparseMatrix, center: bool = True) -> DataFrame:
    """(i, j, value) for i <= j: covariance of columns with divisor N - 1, pairs without common rows
    included; not centred, X'X / (N - 1) of the pairs that have one. A centred one has a row for each pair of
    columns, so its size is their square; ids and sums of columns come to the driver."""
    n = m.nrows
    if n < 2:
        raise ValueError("a covariance needs two rows")
    if not center:
        return gram_entries(m).select("i", "j", (F.col("value") / float(n - 1)).alias("value"))
    return _pair_table(m, True, float(n - 1), True)


def project(m: SparseMatrix, components: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """(row_id, component, score): entries times loadings (component, col_id, loading), summed per row,
    less the component's offset (component, offset). Rows without entries are there too."""
    scores = m.entries.join(components, "col_id").groupBy("row_id", "component").agg(F.sum(F.col("value") * F.col("loading")).alias("raw"))
    names = components.select("component").distinct()
    grid = m.axis("row").crossJoin(F.broadcast(names))  # the result's own rows; one name per component
    out = grid.join(scores, ["row_id", "component"], "left")
    if offsets is None:
        return out.select("row_id", "component", F.coalesce("raw", F.lit(0.0)).alias("score"))
    return out.join(F.broadcast(offsets), "component").select("row_id", "component", (F.coalesce("raw", F.lit(0.0)) - F.col("offset")).alias("score"))


class SparsePCA:
    """Configuration; ``fit`` gives a ``PCAModel``.

    ``tolerance`` is what Lanczos residuals may be of the largest eigenvalue; ``max_iter`` bounds its steps
    (by default the number of columns does). With ``center_svd=False`` centring leaves the decomposition
    alone and changes only mean, total variance and transform. ``alpha`` is kept for callers that set it and
    changes nothing. With a ``mask`` (DataFrame (axis_id, keep) or booleans, exactly as long as the column
    axis) only kept columns take part.
    """

    def __init__(self, n_components: int = 50, alpha: float = 1.0, tolerance: float = 1e-6, random_seed: int = 42, center: bool = True, verbose: bool = False, svd_method: str | RandomSVD = "lanczos", mask: DataFrame | Sequence[bool] | None = None, max_iter: int | None = None, center_svd: bool = True):
        if n_components < 1:
            raise ValueError("n_components must be positive")
        if not (isinstance(svd_method, RandomSVD) or svd_method in ("lanczos", "gram")):
            raise ValueError("svd_method must be 'lanczos', 'gram' or a RandomSVD")
        self.n_components, self.alpha, self.tolerance, self.random_seed = n_components, alpha, tolerance, random_seed
        self.center, self.verbose, self.svd_method, self.mask, self.max_iter = center, verbose, svd_method, mask, max_iter
        self.center_svd = center_svd

    def _kept(self, m: SparseMatrix) -> SparseMatrix:
        if self.mask is None:
            return m
        length = self.mask.count() if isinstance(self.mask, DataFrame) else len(self.mask)
        if length != m.ncols:
            raise ValueError(f"the mask has {length} entries; the matrix has {m.ncols} columns")
        keep = as_mask(m, "column", self.mask)
        return SparseMatrix(m.entries.join(keep, "col_id", "left_semi"), m.rows, m.cols.join(keep, "col_id", "left_semi"))

    def fit(self, m: SparseMatrix) -> PCAModel:
        m = self._kept(m)
        n = m.nrows
        if n < 2:
            raise ValueError("fitting needs two rows")
        stats = axis_stats(m, "column").select("col_id", "s", all_variance(n).alias("variance")).orderBy("col_id").toPandas()
        columns = stats["col_id"].to_numpy(np.int64)
        mean = stats["s"].to_numpy(float) / n if self.center else np.zeros(len(columns))
        total = float(stats["variance"].sum())
        k = min(self.n_components, len(columns), n - 1 if self.center else n)
        if k < self.n_components:
            log.warning("n_components is cut from %d to the rank %d", self.n_components, k)
        if not k:
            raise ValueError("no column to decompose")
        # every pass reads the rows; a lost executor costs a pass no more than its own tasks
        values, loadings = self._decompose(write_shared(_cells(m), "cells"), columns, mean if self.center_svd else 0 * mean, n, k)
        ok = values > max(values.max(), 0) * 1e-12
        values, loadings = np.maximum(values[ok], 0), loadings[ok]
        strongest = np.abs(loadings).argmax(axis=1)
        loadings = loadings * np.where(loadings[np.arange(len(loadings)), strongest] < 0, -1, 1)[:, None]
        if not self.center:
            total = float(values.sum() / (n - 1))
        if self.verbose:
            log.info("explained variance %s", values / (n - 1))
        return PCAModel(m.entries.sparkSession, columns, loadings, values / (n - 1), mean, total, n, self.center, self.mask is not None)

    def _decompose(self, rows, columns, mean, n, k):
        """Largest eigenvalues of (X - 1m')'(X - 1m') and their vectors, in descending order."""
        width = len(columns)

        def times(v: np.ndarray) -> np.ndarray:
            """(X - 1m')'(X - 1m') V = X'XV - N m (m'V) by one pass."""

            def work(out, r, c, x, rows_in_block):
                y = np.zeros((rows_in_block, v.shape[1]))
                np.add.at(y, r, x[:, None] * v[c])
                np.add.at(out, c, x[:, None] * y[r])

            return _summed(rows, columns, work, v.shape) - n * np.outer(mean, mean @ v)

        if self.svd_method == "gram":
            if width > GRAM_COLUMNS:
                raise ValueError(f"gram is for up to {GRAM_COLUMNS} columns")
            values, vectors = np.linalg.eigh(gram_matrix(rows, columns) - n * np.outer(mean, mean))
            return values[::-1][:k], vectors.T[::-1][:k]
        rng = np.random.default_rng(self.random_seed)
        if isinstance(self.svd_method, RandomSVD):
            size = min(width, k + self.svd_method.n_oversamples)
            q = np.linalg.qr(rng.standard_normal((width, size)))[0]
            for _ in range(self.svd_method.n_power_iterations + 1):
                q = np.linalg.qr(times(q))[0]
            values, inner = np.linalg.eigh(q.T @ times(q))
            return values[::-1][:k], (q @ inner).T[::-1][:k]
        return self._lanczos(times, width, k, rng)

    def _lanczos(self, times, width: int, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        limit = min(width, self.max_iter or width)
        basis, alphas, betas = np.zeros((min(limit, 64) + 1, width)), [], []

        def orthogonal(w: np.ndarray, used: int) -> np.ndarray:
            for _ in range(2):
                w = w - basis[:used].T @ (basis[:used] @ w)
            return w

        start = rng.standard_normal(width)
        basis[0] = start / np.linalg.norm(start)
        for step in range(1, limit + 1):
            w = times(basis[step - 1][:, None])[:, 0]
            alphas.append(float(w @ basis[step - 1]))
            w = orthogonal(w, step)
            beta = float(np.linalg.norm(w))
            closed = beta <= 1e-12 * max(max(map(abs, alphas)), 1e-300)  # what is spanned goes into itself
            if step >= k and (step % LOOK_EVERY == 0 or step == limit or closed):
                values, inner = np.linalg.eigh(np.diag(alphas) + np.diag(betas, 1) + np.diag(betas, -1))
                residual = beta * np.abs(inner[-1, -k:]).max()
                if residual <= self.tolerance * max(values[-1], 1e-300) and not (closed and step < limit and values[-k] <= 1e-12 * values[-1]):
                    break
            if step == limit:
                log.warning("Lanczos stopped after %d steps with residual %g", step, residual) if step >= k else None
                break
            if closed:  # other directions may still hold variance
                w, beta = orthogonal(rng.standard_normal(width), step), 0.0
                w /= max(float(np.linalg.norm(w)), 1e-300)
            else:
                w = w / beta
            betas.append(beta)
            if step == len(basis):
                basis = np.concatenate([basis, np.zeros((min(len(basis), limit + 1 - len(basis)), width))])
            basis[step] = w
        used = len(alphas)
        values, inner = np.linalg.eigh(np.diag(alphas) + np.diag(betas[: used - 1], 1) + np.diag(betas[: used - 1], -1))
        return values[::-1][:k], (basis[:used].T @ inner).T[::-1][:k]

    def fit_transform(self, m: SparseMatrix) -> DataFrame:
        return self.fit(m).transform(m)


class MaskedSparsePCA(SparsePCA):
    """``SparsePCA`` for which a mask is required."""

    def __init__(self, mask: DataFrame | Sequence[bool], **params):
        super().__init__(mask=mask, **params)


class PCAModel:
    def __init__(self, spark, columns, loadings, explained_variance, mean, total_variance, n_samples, center, masked):
        self._spark, self.column_ids, self.loadings, self.variances = spark, columns, loadings, explained_variance
        self.means, self.total_variance, self.n_samples, self.center, self.masked = mean, total_variance, n_samples, center, masked

    @property
    def n_components(self) -> int:
        return len(self.loadings)

    @property
    def components(self) -> DataFrame:
        """(component, col_id, loading)."""
        k, n = self.loadings.shape
        table = pa.table({"component": pa.array(np.repeat(np.arange(k), n), pa.int32()), "col_id": np.tile(self.column_ids, k), "loading": self.loadings.ravel()})
        return self._spark.createDataFrame(table)

    @property
    def mean(self) -> DataFrame:
        return self._spark.createDataFrame(pa.table({"col_id": self.column_ids, "mean": self.means}))

    def _per_component(self, **values: np.ndarray) -> DataFrame:
        return self._spark.createDataFrame(pa.table({"component": pa.array(np.arange(self.n_components), pa.int32()), **values}))

    def explained_variance(self) -> DataFrame:
        return self._per_component(explained_variance=self.variances)

    def explained_variance_ratio(self) -> DataFrame:
        """Over the computed components: the ratios sum to 1."""
        return self._per_component(ratio=self.variances / self.variances.sum())

    def explained_variance_ratio_total(self) -> DataFrame:
        """Over the variance of all columns."""
        return self._per_component(ratio=self.variances / self.total_variance)

    def cumulative_explained_variance_ratio(self) -> DataFrame:
        running = F.sum("ratio").over(Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0))  # a row per component
        return self.explained_variance_ratio().select("component", running.alias("cumulative"))

    def noise_variance(self) -> float:
        left = min(len(self.column_ids), self.n_samples) - self.n_components
        return (self.total_variance - float(self.variances.sum())) / left if left > 0 else 0.0

    def feature_importances(self) -> DataFrame:
        return self.components.select("component", "col_id", (F.col("loading") * F.col("loading")).alias("importance"))

    def transform(self, m: SparseMatrix, center_implicit: bool = True) -> DataFrame:
        """(row_id, component, score). ``center_implicit=False`` centres stored cells only, so that cells
        which aren't stored add nothing."""
        loadings = self.components
        if not self.center:
            return project(m, loadings)
        if not center_implicit:
            centred = m.entries.join(self.mean, "col_id").select("row_id", "col_id", (F.col("value") - F.col("mean")).alias("value"))
            return project(m.with_entries(centred), loadings)
        return project(m, loadings, self._per_component(offset=self.loadings @ self.means))
