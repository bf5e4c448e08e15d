"""Principal components of images too wide for a voxels x voxels problem.

A block of directions, voxels x a few, goes to the tasks; each multiplies its images, batch by batch,
by it and back, and the products are summed by ranges of voxels.  The driver holds a basis of the
blocks so far, of bounded size, solves the small problem in it, and stops when what a component
leaves over is small: the spectrum of the images on a Krylov space, with restarts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of images that a task multiplies at a time, of products in a row of the shuffle, and of the basis with its products on the driver.
BATCH_BYTES, PART_BYTES, STATE_BYTES = 64 << 20, 4 << 20, 512 << 20
SCHEMA = "part int, total array<double>"


def _images(batches, column: str, width: int):
    """Matrices of the images, about BATCH_BYTES each; null images are left out, others of another length raise."""
    for batch in batches:
        rows = max(1, BATCH_BYTES // (8 * width))
        for start in range(0, batch.num_rows, rows):
            lists = batch.column(column).slice(start, rows).drop_null()
            if len(lists):
                x = lists.flatten().to_numpy(zero_copy_only=False)
                if len(x) != len(lists) * width:
                    raise ValueError(f"an image without {width} voxels")
                yield x.reshape(-1, width)


def _parts(total: np.ndarray):
    """Rows of the shuffle: ranges of the first axis."""
    step = max(1, PART_BYTES // (8 * max(1, total[0].size)))
    for k in range(0, len(total), step):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k : k + step].ravel()], pa.list_(pa.float64()))], names=["part", "total"])


def _summed(parts: DataFrame, shape: tuple) -> np.ndarray:
    def add(table: pa.Table) -> pa.Table:
        total = None
        for row in table.column("total"):
            own = row.values.to_numpy()
            total = own.copy() if total is None else total + own
        return pa.table({"part": table.column("part").slice(0, 1), "total": pa.array([total], pa.list_(pa.float64()))})

    out = np.zeros(shape)
    for r in parts.groupBy("part").applyInArrow(add, SCHEMA).collect():  # voxels x block in all
        own = np.array(r["total"]).reshape(-1, *shape[1:])
        out[r["part"] : r["part"] + len(own)] = own
    return out


class ImageSpectrum:
    """Images as rows with an array of voxels: count, mean, total variance (the trace), and products of their scatter with a block."""

    def __init__(self, images: DataFrame, value: str = "voxels"):
        self.rows = images.select(F.col(value).cast("array<double>").alias("image")).where("image is not null")
        first = self.rows.select(F.size("image")).first()
        self.width = width = first[0] if first else 0
        if not width:
            raise ValueError("no image")

        def moments(batches):
            total = np.zeros((width, 2))
            n = 0
            for x in _images(batches, "image", width):
                total[:, 0] += x.sum(axis=0)
                total[:, 1] += (x * x).sum(axis=0)
                n += len(x)
            yield from _parts(np.vstack([total, [[n, 0.0]]]))

        sums = _summed(self.rows.mapInArrow(moments, SCHEMA), (width + 1, 2))
        self.n = int(sums[-1, 0])
        self.mean = sums[:-1, 0] / self.n
        self.trace = float(np.maximum(sums[:-1, 1] - self.n * self.mean**2, 0).sum())

    def times(self, block: np.ndarray) -> np.ndarray:
        """X'X block of the centred images X: one pass."""
        mean, width = self.mean, self.width
        sent = self.rows.sparkSession.sparkContext.broadcast(block)  # voxels x block, within STATE_BYTES

        def run(batches):
            own, total = sent.value, np.zeros((width, sent.value.shape[1]))
            for x in _images(batches, "image", width):
                x = x - mean
                total += x.T @ (x @ own)
            yield from _parts(total)

        out = _summed(self.rows.mapInArrow(run, SCHEMA), block.shape)
        sent.destroy()
        return out

    def components(self, k: int, tolerance: float = 1e-7, most_passes: int = 60, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The k leading directions (voxels x k) and eigenvalues of X'X.

        Stops when each of them is left unchanged by X'X up to tolerance times the largest eigenvalue, which
        bounds the error of the eigenvalues too; raises where most_passes do not get there."""
        k = min(k, self.width)
        size = min(self.width, k + 8)
        most = max(3 * size, STATE_BYTES // (16 * self.width))
        block = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.width, size)))[0]
        basis, moved = np.zeros((self.width, 0)), np.zeros((self.width, 0))
        for _ in range(most_passes):
            basis, moved = np.hstack([basis, block]), np.hstack([moved, self.times(block)])
            small = basis.T @ moved
            values, y = np.linalg.eigh((small + small.T) / 2)
            values, y = values[::-1], y[:, ::-1]
            left = np.linalg.norm(moved @ y[:, :k] - basis @ y[:, :k] * values[:k], axis=0)
            if (left <= tolerance * max(values[0], 1e-300)).all() or basis.shape[1] == self.width:
                top = basis @ y[:, :k]
                sign = np.sign(top[np.abs(top).argmax(axis=0), np.arange(k)])
                return top * np.where(sign == 0, 1, sign), np.maximum(values[:k], 0)
            block = self._further(basis, moved[:, -size:], 1e-12 * max(values[0], 1e-300), seed)
            if basis.shape[1] + size > most:  # go on from the leading directions; what they leave over lies in the block
                basis, moved = basis @ y[:, : 2 * size], moved @ y[:, : 2 * size]
        raise ValueError(f"the components are not settled after {most_passes} passes")

    def _further(self, basis: np.ndarray, fresh: np.ndarray, least: float, seed: int) -> np.ndarray:
        """Orthonormal directions beside the basis: of `fresh`, and random ones where it has none left."""
        for _ in range(2):  # twice is enough to be orthogonal
            fresh = fresh - basis @ (basis.T @ fresh)
        q, r = np.linalg.qr(fresh)
        good = np.abs(np.diag(r)) > least
        more = np.random.default_rng([seed, basis.shape[1]]).normal(size=(self.width, int((~good).sum())))
        block = np.hstack([q[:, good], more])[:, : self.width - basis.shape[1]]
        for _ in range(2):
            block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
        return block
