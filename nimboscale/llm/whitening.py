"""Embedding whitening: leading principal components by Chebyshev-filtered subspace iteration.

Plan: vectors become integer blocks of some thousand rows once, stored in the
shared folder. A pass multiplies every block, centred first, with a narrow
matrix Q and adds up centred(X)'centred(X)Q by dimension: one row a dimension
and task, summed by Spark, so the driver receives dims x block numbers whatever
the table's size. The driver holds only such narrow matrices: it runs the
recurrence of Chebyshev polynomials over the passes, which damps the unwanted
end of the spectrum, then QR and Rayleigh-Ritz, until the residual of every
wanted pair certifies it. A lost executor repeats its blocks of one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nimboscale.session import stored, table

#: Entries become floor(1024 c) + 100000, as the contract has it; sums run over the part without the offset.
SCALE, OFFSET = 1024, 100_000
#: Vectors a block.
BLOCK_ROWS = 4096
#: Vectors with an entry of this size or more are left out: block sums would not fit a long.
MAX_ENTRY = 2.0**40
#: Residual, in units of the largest eigenvalue, that certifies a component, and the rounding floor that is accepted once it stalls.
CERTIFIED, FLOOR = 1e-14, 1e-10
#: Damping that one filter aims for, and the degrees that it may take.
DAMPING, DEGREES = 1e7, (6, 40)
MAX_FILTERS = 60
#: Components whose eigenvalue is below this share of the trace are rounding, not directions.
LEAST_SHARE = 1e-12

OUT = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def _integers(col: pa.Array, dims: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer matrix) of the usable vectors of a list column, for each vector length, or only for ``dims``."""
    sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(invalid="ignore"):
        bad = ~(np.abs(values) < MAX_ENTRY)
    row = np.repeat(np.arange(len(sizes)), sizes)
    usable = (sizes > 0) & (np.bincount(row, bad, minlength=len(sizes)) == 0)
    for length in np.unique(sizes[usable]) if dims is None else [dims]:
        of = usable & (sizes == length)
        yield np.flatnonzero(of), np.floor(SCALE * values[of[row]]).astype(np.int64).reshape(-1, length)


def vector_blocks(df: DataFrame, vec_col: str) -> DataFrame:
    """(dims, rows, kind, data): usable vectors as integer matrices in the narrowest type that holds a block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {}

        def block(length: int) -> pa.RecordBatch:
            x = np.concatenate(waiting.pop(length))
            kind = np.promote_types(np.min_scalar_type(min(int(x.min()), -1)), np.min_scalar_type(-1 - int(max(x.max(), 0)))).newbyteorder("<")
            return pa.RecordBatch.from_pydict({"dims": pa.array([length], pa.int32()), "rows": pa.array([len(x)], pa.int32()), "kind": [kind.str], "data": pa.array([x.astype(kind).tobytes()], pa.binary())})

        for batch in batches:
            for _, x in _integers(batch.column(0)):
                for part in np.array_split(x, range(BLOCK_ROWS, len(x), BLOCK_ROWS)):
                    length = part.shape[1] if part.size else 0
                    if not length:
                        continue
                    if sum(map(len, waiting.get(length, ()))) + len(part) > BLOCK_ROWS:
                        yield block(length)
                    waiting.setdefault(length, []).append(part)
        for length in list(waiting):
            yield block(length)

    return df.select(F.col(vec_col).cast("array<double>")).mapInArrow(pack, "dims int, rows int, kind string, data binary")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for dims, kind, data in zip(*(batch.column(batch.schema.names.index(c)) for c in ("dims", "kind", "data")), strict=True):
            yield np.frombuffer(data.as_buffer(), kind.as_py()).reshape(-1, dims.as_py())


def column_sums(blocks: DataFrame, dims: int) -> list[int]:
    """Exact sum of every dimension's integers."""

    def sums(batches):
        for x in _matrices(batches):
            yield pa.RecordBatch.from_pydict({"dim": np.arange(dims, dtype=np.int32), "s": x.sum(axis=0, dtype=np.int64)})

    rows = blocks.mapInArrow(sums, "dim int, s bigint").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(19,0)")).alias("s")).collect()
    return [int(s) for _, s in sorted((r["dim"], r["s"]) for r in rows)]


def covariance_product(blocks: DataFrame, mean: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(V q, diagonal of V) of the covariance V with divisor ``n``; every block is centred before it is multiplied."""
    dims, width = q.shape

    def product(batches):
        y, squares = np.zeros((dims, width)), np.zeros(dims)
        for x in _matrices(batches):
            a = x - mean
            y += a.T @ (a @ q)
            squares += np.einsum("ij,ij->j", a, a)
        yield pa.RecordBatch.from_pydict({"dim": np.arange(dims, dtype=np.int32), "d": squares} | {f"y{j}": np.ascontiguousarray(y[:, j]) for j in range(width)})

    names = ["d", *[f"y{j}" for j in range(width)]]
    schema = "dim int, " + ", ".join(f"{c} double" for c in names)
    rows = blocks.mapInArrow(product, schema).groupBy("dim").agg(*[F.sum(c).alias(c) for c in names]).collect()
    whole = np.array([[r[c] for c in names] for r in sorted(rows, key=lambda r: r["dim"])]) / n
    return whole[:, 1:], whole[:, 0]


class _Lanczos:
    """A vector carried along with the first filter, for the lower end of the spectrum."""

    def __init__(self, dims: int, rng: np.random.Generator):
        v = rng.standard_normal(dims)
        self.basis, self.diagonal, self.beside = [v / np.linalg.norm(v)], [], []

    def step(self, product: np.ndarray) -> None:
        self.diagonal.append(float(self.basis[-1] @ product))
        known = np.array(self.basis)
        for _ in range(2):
            product = product - known.T @ (known @ product)
        size = float(np.linalg.norm(product))
        self.beside.append(size)
        self.basis.append(product / size if size > 0 else product)

    def lowest(self) -> float:
        """A value that is seldom above the least eigenvalue and never below 0."""
        off = self.beside[:-1]
        values, vectors = np.linalg.eigh(np.diag(self.diagonal) + np.diag(off, 1) + np.diag(off, -1))
        return max(0.0, float(values[0]) - self.beside[-1] * abs(float(vectors[-1, 0])))


def leading_components(product, dims: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, eigenvectors as columns, trace) of the matrix behind ``product(q) -> (V q, diagonal)``.

    The block is wider than ``k`` by some guard columns; a space that the block fills
    needs no filter. Raises if the residuals do not reach the rounding floor.
    """
    rng = np.random.default_rng(seed)
    wide = min(dims, 2 * k + 16)
    q = np.linalg.qr(rng.standard_normal((dims, wide)))[0]
    low, lanczos, before = 0.0, _Lanczos(dims, rng), np.inf

    def ritz(q):
        y, diagonal = product(q)
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        return values, q, np.linalg.norm(y - q * values, axis=0), float(diagonal.sum())

    for _ in range(MAX_FILTERS):
        values, q, residual, trace = ritz(q)
        worst = residual[:k].max() / max(values[0], np.finfo(float).tiny)
        if wide == dims or trace <= 0 or worst <= CERTIFIED or (worst <= FLOOR and worst > before / 4):
            return np.maximum(values[:k], 0), q[:, :k], trace
        before = worst
        high = max(values[-1], low + 1e-6 * values[0])
        centre, half = (high + low) / 2, (high - low) / 2
        away = max((values[min(k, wide) - 1] - centre) / half, 1 + 1e-6)
        degree = int(np.clip(np.ceil(np.log(2 * DAMPING) / np.arccosh(away)), *DEGREES))
        sigma = half / (values[0] - centre)
        tau, last = 2 / sigma, q
        for step in range(degree):
            if lanczos is not None:
                y, _ = product(np.column_stack([q, lanczos.basis[-1]]))
                lanczos.step(y[:, -1])
                y = y[:, :-1]
                if lanczos.beside[-1] < 1e-9 * values[0] or step + 1 == degree:
                    low, lanczos = 0.9 * lanczos.lowest(), None
            else:
                y, _ = product(q)
            if step == 0:
                q, last = (y - centre * q) * (sigma / half), q
            else:
                grown = 1 / (tau - sigma)
                q, last = 2 * (y - centre * q) * (grown / half) - sigma * grown * last, q
                sigma = grown
        q = np.linalg.qr(q)[0]
    raise RuntimeError(f"residual {worst:.1e} after {MAX_FILTERS} filters")


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): ``k`` rows a vector.

    Entries become x = floor(1024 c) + 100000. ``whitened`` is x less its mean,
    projected on the unit eigenvector ``component`` of the covariance (divisor n,
    eigenvalues falling from component 1), over the root of the eigenvalue; the
    eigenvector's largest entry is positive. ``explained`` is the eigenvalue over
    the trace, ``identity_error`` the largest entry by which the covariance of
    ``whitened`` differs from the identity, measured by a pass of its own.
    ``deviation`` is the exact sum of (n x - S)^2, null where a long cannot hold it.

    Edge cases: null vectors, vectors with null, NaN or infinite entries, empty
    vectors and entries of 2^40 or more are left out. Among several lengths the
    one of most vectors (ties: the longer) is taken, the rest is left out.
    Null and repeated ids are rows like any other. Directions without spread have
    no component, so fewer than ``k`` can come, and equal vectors, a single one or
    an empty table give no row. Other columns, whatever their names, do not matter.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    names = (id_col, *OUT)
    schema = f"`{id_col}` {id_type.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    blocks = stored(vector_blocks(rows, "v"), "vector-blocks")
    lengths = blocks.groupBy("dims").agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dims, n = lengths[0]["dims"], lengths[0]["n"]
    blocks = blocks.where(F.col("dims") == dims).select("dims", "kind", "data")
    sums = column_sums(blocks, dims)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    values, vectors, trace = leading_components(lambda q: covariance_product(blocks, mean, q, n), dims, min(k, dims))
    real = values > LEAST_SHARE * trace
    if not real.any():
        return spark.createDataFrame([], schema)
    values, vectors = values[real], vectors[:, real]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    scaled = vectors * (signs / np.sqrt(values))
    seen, _ = covariance_product(blocks, mean, scaled, n)
    error = float(np.abs(scaled.T @ seen - np.eye(len(values))).max())
    share = values / trace
    bound = float(max(abs(s) for s in sums))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = next(_integers(batch.column(1), dims))
            white = (x - mean) @ scaled
            # The exact sum in longs where it fits, else in unbounded integers.
            most = n * float(np.abs(x).max(initial=0)) + bound
            if most * most * dims < 2.0**62:
                away = n * x - np.array(sums, dtype=np.int64)
                deviation = (away * away).sum(axis=1).tolist()
            else:
                away = x.astype(object) * n - np.array(sums, dtype=object)
                deviation = [int(s) if s < 2**63 else None for s in (away * away).sum(axis=1)]
            m = len(values)
            columns = [
                batch.column(0).take(pa.array(np.repeat(at, m))),
                pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(at))),
                pa.array(np.full(len(at) * m, n, dtype=np.int64)),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), m))),
                pa.array(white.ravel()),
                pa.array(np.tile(share, len(at))),
                pa.array(np.full(len(at) * m, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, list(names))

    return rows.mapInArrow(project, schema)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
