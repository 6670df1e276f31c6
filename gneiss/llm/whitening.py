"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.storage import materialise

#: Relative size below which a direction counts as lost.
LOST = 1e-13


def _stored(width: int):
    """Rows of numbers as bytes of int64, shorter ones with the value of 0 behind."""

    def store(batches):
        for batch in batches:
            x = batch.column("x")
            lengths = x.value_lengths().to_numpy(zero_copy_only=False)
            out = np.tile(batch.column("zero").to_numpy()[:, None], (1, width))
            out[np.arange(width) < lengths[:, None]] = x.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([row.tobytes() for row in out], pa.binary())], ["id", "x"])

    return store


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int64).reshape(batch.num_rows, width)


def _sums(base: DataFrame, values, size: int) -> np.ndarray:
    """Sums over all rows of ``size`` doubles that ``values(batch)`` gives a batch: one row a task is added up."""

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            total += values(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    parts = base.mapInArrow(add, "s array<double>")
    return np.array(parts.agg(F.array(*(F.sum(F.get("s", F.lit(i))) for i in range(size))).alias("s")).first()["s"] or [0.0] * size)


class Bidiagonal:
    """Lanczos vectors of a matrix X with rows in Spark and ``width`` columns.

    A right vector v_k stays with the driver.  A left vector u_k, one entry a
    row, is X w_k for a vector w_k of ``width`` numbers, which follows u_k
    through the recurrence, so no table is written a step.  With g_k = X'u_k, the
    product of u_k with any X w is g_k . w, so left vectors too are
    orthogonalised against all earlier ones.  ``multiply(w)`` gives
    ``(|X w|^2, X'(X w))`` in one pass over the rows: u = X w within a task, then
    X'u summed.
    """

    def __init__(self, multiply, width: int, seed: int = 5):
        self.multiply, self.width, self.rng = multiply, width, np.random.Generator(np.random.PCG64(seed))
        self.v, self.w, self.g = (np.zeros((0, width)) for _ in range(3))
        self.alpha: list[float] = []
        self.beta: list[float] = []
        self.next = self._fresh()

    def _fresh(self) -> np.ndarray:
        """A random unit vector orthogonal to all right vectors."""
        return self._apart(self.rng.standard_normal(self.width))[0]

    def _apart(self, r: np.ndarray) -> tuple[np.ndarray, float]:
        for _ in range(2):
            r = r - self.v.T @ (self.v @ r)
        size = float(np.linalg.norm(r))
        return (r / size if size else r), size

    def step(self) -> None:
        v, beta = self.next, self.beta[-1] if self.beta else 0.0
        w = v - (beta * self.w[-1] if beta else 0.0)
        for _ in range(2):
            w = w - self.w.T @ (self.g @ w)
        square, g = self.multiply(w)
        alpha, scale = float(np.sqrt(square)), max([*self.alpha, *self.beta, 1e-300])
        self.v = np.vstack([self.v, v])
        if alpha <= LOST * scale:  # nothing of X v is left behind the earlier u
            alpha, w, g = 0.0, np.zeros(self.width), np.zeros(self.width)
        else:
            w, g = w / alpha, g / alpha
        self.alpha.append(alpha)
        self.w, self.g = np.vstack([self.w, w]), np.vstack([self.g, g])
        if len(self.alpha) < self.width:
            self.next, beta = self._apart(g - alpha * v)
            if beta <= LOST * max(scale, alpha):  # an invariant space is found; what is orthogonal to it comes next
                self.next, beta = self._fresh(), 0.0
            self.beta.append(beta)

    def singular(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values of the bidiagonal matrix, the vectors they stand for (rows), and the residuals."""
        k = len(self.alpha)
        left, values, right = np.linalg.svd(np.diag(self.alpha) + np.diag(self.beta[: k - 1], 1))
        rest = self.beta[k - 1] if k < self.width else 0.0
        return values, right @ self.v, rest * np.abs(left[-1])


def principal(multiply, width: int, wanted: int, tolerance: float = 1e-14, complete: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest singular values and right vectors of X, to rounding.

    Up to ``complete`` dimensions all steps are taken, which finds equal values as
    often as they occur; beyond, steps end when the residuals have settled.
    """
    lanczos = Bidiagonal(multiply, width)
    while True:
        lanczos.step()
        k = len(lanczos.alpha)
        # A vector orthogonal to an invariant space may still bring a larger value, so a zero beta settles nothing.
        if k == width or (width > complete and k > wanted and lanczos.beta[-1] > 0):
            values, vectors, residual = lanczos.singular()
            if k == width or residual[:wanted].max() <= tolerance * values[0]:
                return values[:wanted], vectors[:wanted]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)``, a row for each vector and component.

    Entries c become x = floor(scale * c) + shift.  Components are unit
    eigenvectors of the covariance of all n rows (divisor n), by falling
    eigenvalue e; ``whitened`` is the centred row on the component over sqrt(e),
    ``explained`` e over the trace, ``deviation`` the sum over dimensions of
    (n * x - S)^2, exact; ``identity_error`` is how far the covariance of all
    whitened columns is from the identity.  The sign of a component makes its
    largest entry positive.

    Vectors that are null or hold null or non-finite entries take no part.
    Shorter vectors have entries of 0 behind; null ids and repeated rows are rows
    like others.  Components without variance (fewer rows or dimensions than
    wanted, constant columns) cannot be whitened and are left out.  A deviation
    beyond 64 bits raises.  Other columns play no part.

    A step of the bidiagonalisation is one pass over the rows, which are written
    once as bytes; the driver holds a few matrices of dimensions by steps (at
    most dimensions by dimensions), and a task adds a single row of sums.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    whole = vectors.where(x.isNotNull()).where(finite)
    width = whole.agg(F.max(F.size(x))).first()[0] or 0
    kind = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not width:
        return spark.createDataFrame([], kind)
    numbers = F.transform(x, lambda e: F.floor(e.cast("double") * scale) + F.lit(shift).cast("long"))
    base = whole.select(F.col(id_col).alias("id"), numbers.alias("x"), F.lit(shift).cast("long").alias("zero"))
    base = materialise(base.mapInArrow(_stored(width), f"id {vectors.schema[id_col].dataType.simpleString()}, x binary"), "whiten-rows")
    # Sums of whole numbers are exact: high and low halves are added apart, each far below 2^53 a task.
    def halves(batch):
        rows = _matrix(batch, width)
        return np.concatenate([[batch.num_rows], (rows >> 20).sum(axis=0), (rows & 0xFFFFF).sum(axis=0)]).astype(float)

    found = _sums(base, halves, 2 * width + 1)
    n, total = int(found[0]), [(int(h) << 20) + int(low) for h, low in zip(found[1 : width + 1], found[width + 1 :], strict=True)]
    mean = np.array([t // n for t in total]) + np.array([t % n for t in total]) / n

    def multiply(w: np.ndarray) -> tuple[float, np.ndarray]:
        def product(batch):
            rows = _matrix(batch, width) - mean
            u = rows @ w
            return np.concatenate([[u @ u], u @ rows])

        out = _sums(base, product, width + 1)
        return out[0], out[1:]

    def squares(batch):
        rows = _matrix(batch, width) - mean
        return np.array([(rows * rows).sum()])

    trace = float(_sums(base, squares, 1)[0]) / n
    values, components = principal(multiply, width, min(wanted, width))
    some = values > 1e-12 * max(values[0], 1e-300) if trace > 0 else np.zeros(len(values), bool)
    values, components = values[some], components[some]
    if not len(values):
        return spark.createDataFrame([], kind)
    components = components * np.sign(components[np.arange(len(components)), np.abs(components).argmax(axis=1)])[:, None]
    k, onto = len(values), components.T / (values / np.sqrt(n))

    def moments(batch):
        y = (_matrix(batch, width) - mean) @ onto
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    found = _sums(base, moments, k + k * k)
    centre = found[:k] / n
    error = float(np.abs(found[k:].reshape(k, k) / n - np.outer(centre, centre) - np.eye(k)).max())
    sums = np.array(total, np.int64)

    def project(batches):
        for batch in batches:
            rows = _matrix(batch, width)
            apart = n * rows.astype(np.float64) - np.array(total, float)
            if batch.num_rows and (apart * apart).sum(axis=1).max() > 9e18:
                raise OverflowError("a deviation does not fit 64 bits")
            apart = n * rows - sums
            y = (rows - mean) @ onto
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array((apart * apart).sum(axis=1)), pa.array(y.tolist(), pa.list_(pa.float64()))], ["id", "deviation", "y"]
            )

    placed = base.mapInArrow(project, f"id {vectors.schema[id_col].dataType.simpleString()}, deviation long, y array<double>")
    share = F.get(F.array(*(F.lit(float(v * v / n / trace)) for v in values)), F.col("at"))
    return placed.select("id", "deviation", F.posexplode("y").alias("at", "whitened")).select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(error).alias("identity_error"),
    )
