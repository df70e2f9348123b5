"""Operator 11: whitening of embeddings by the leading components of their covariance, found by Jacobi-Davidson.

Every component c of a vector becomes the whole number floor(256 c). The covariance is over the distinct vectors, is
never formed, and is only multiplied: each task centres its vectors, multiplies them by a few columns and back, and the
d x m partial products are added up in Spark, so the driver holds a basis of d rows and at most BASIS columns. The
driver's part is Rayleigh-Ritz in that basis, corrections by MINRES on the projected equations of all open pairs in
lockstep (one distributed product a step for all of them), and locking of pairs whose residual has reached double
precision. GUARD pairs more than asked for are found, so that a pair which comes up late is not missed.

Defined results: vectors that are null or hold null or non-finite entries are dropped, and so are vectors of another
length than the most common one (the longer, at a tie); values beyond long are saturated. Components without variance
(all vectors equal, fewer distinct vectors than components) are left out, so one distinct vector, or none, gives no row.
Rows repeat as they do in the input, null ids stay null, a deviation beyond 38 digits is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.llm import common as C
from proofsheet.llm.vectors import matrix, whole_vectors

GUARD = 3
BASIS = 96  # columns of the search space before it is restarted
STEPS = 10  # of MINRES for one correction
ROUNDS = 200
BLOCK_BYTES = 1 << 20
TASK_BYTES = 16 << 20  # of packed vectors

Product = Callable[[np.ndarray], np.ndarray]


# ---------------------------------------------------------------- the solver, on the driver, over any product

def orthogonal(t: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of t add to those of `against`."""
    kept: list[np.ndarray] = []
    for v in t.T:
        before = np.linalg.norm(v)
        if not before > 0:
            continue
        v = v / before
        for _ in range(3):
            for b in (*against, *(k[:, None] for k in kept)):
                v = v - b @ (b.T @ v)
            size = np.linalg.norm(v)
            if size < 1e-10:
                break
            v = v / size
        else:
            kept.append(v)
    return np.stack(kept, 1) if kept else np.empty((len(t), 0))


def minres(apply: Product, rhs: np.ndarray, steps: int = STEPS, tolerance: float = 1e-3) -> np.ndarray:
    """Each column of the solution of a symmetric system of its own; one call of `apply` a step serves all of them."""
    x, v_old, w_old, w = (np.zeros_like(rhs) for _ in range(4))
    first = beta = np.linalg.norm(rhs, axis=0)
    open_ = beta > 0
    v = rhs / np.where(open_, beta, 1)
    eta = beta.copy()
    c_old = c = np.ones_like(beta)
    s_old = s = np.zeros_like(beta)
    for _ in range(steps):
        if not open_.any():
            break
        av = apply(v)
        alpha = (v * av).sum(0)
        av = av - alpha * v - beta * v_old
        after = np.linalg.norm(av, axis=0)
        delta = c * alpha - c_old * s * beta
        rho = np.hypot(delta, after)
        open_ &= rho > 0
        safe = np.where(open_, rho, 1)
        w_old, w = w, (v - s_old * beta * w_old - (s * alpha + c_old * c * beta) * w) / safe
        c_old, c, s_old, s = c, delta / safe, s, after / safe
        x += np.where(open_, c * eta, 0) * w
        eta = -s * eta
        open_ &= (np.abs(eta) > tolerance * first) & (after > 1e-14 * np.abs(alpha))
        v_old, v, beta = v, np.where(open_, av, 0) / np.where(after > 0, after, 1), after
    return x


def leading_pairs(product: Product, d: int, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors (d x k) of a symmetric positive matrix known by its products."""
    locked, values = np.empty((d, 0)), []
    u = orthogonal(np.random.default_rng(seed).standard_normal((d, min(d, 2 * (k + GUARD)))))
    au = product(u)
    scale = 0.0
    for round_ in range(ROUNDS):
        h = u.T @ au
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        u, au = u @ s, au @ s
        scale = max([scale, *np.abs(theta)])
        far = np.linalg.norm(au - u * theta - locked @ (locked.T @ au), axis=0)
        done = 0
        while done < len(theta) and len(values) < k and far[done] <= 32 * np.finfo(float).eps * scale:
            values.append(theta[done])
            done += 1
        locked = np.hstack((locked, u[:, :done]))
        u, au, theta = u[:, done:], au[:, done:], theta[done:]
        if len(values) == k:
            break
        if u.shape[1] >= BASIS:
            u, au, theta = u[:, :BASIS // 3], au[:, :BASIS // 3], theta[:BASIS // 3]
        if u.shape[1]:
            aim = slice(0, k + GUARD - len(values))
            x, shift = u[:, aim], theta[aim]
            held = np.hstack((locked, x))
            project = lambda t: t - held @ (held.T @ t)
            t = minres(lambda v: project(product(v) - v * shift), -project(au[:, aim] - x * shift), STEPS, max(1e-3, 0.5 ** (1 + round_)))
        else:
            t = np.random.default_rng(seed + len(values)).standard_normal((d, 1))
        t = orthogonal(t, locked, u)
        if not t.shape[1]:  # nothing that rounding does not hide is left to correct, or the basis spans everything
            t = orthogonal(np.random.default_rng(seed + u.shape[1]).standard_normal((d, k)), locked, u)
        if not t.shape[1]:
            values.extend(theta[:k - len(values)])
            locked = np.hstack((locked, u[:, :k - locked.shape[1]]))
            break
        u, au = np.hstack((u, t)), np.hstack((au, product(t)))
    else:
        raise RuntimeError(f"no double precision after {ROUNDS} rounds")
    order = np.argsort(values)[::-1][:k]
    return np.array(values)[order], locked[:, order]


# ---------------------------------------------------------------- its products, on the executors

def packed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors side by side in blocks of about BLOCK_BYTES."""
    schema = pa.schema([("block", pa.binary())])
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            for part in np.array_split(x := matrix(b.column(0)), max(1, x.nbytes // BLOCK_BYTES)):
                held.append(part.tobytes())
                size += part.nbytes
                if size >= BLOCK_BYTES:
                    yield C.record(schema, [b"".join(held)])
                    held, size = [], 0
    if held:
        yield C.record(schema, [b"".join(held)])


def column_sums(d: int) -> Callable:
    """Exact sums of each dimension, as decimal digits, and the number of vectors as dimension -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d, object), 0
        for b in batches:
            for block in b.column(0).to_pylist():
                x = np.frombuffer(block, np.int64).reshape(-1, d)
                high, low = x >> 32, x & 0xFFFFFFFF  # their sums cannot overflow within a block
                total += high.sum(0).astype(object) * (1 << 32) + low.sum(0).astype(object)
                n += len(x)
        yield C.record(pa.schema([("dim", pa.int32()), ("v", pa.string())]), list(range(-1, d)), [str(n), *map(str, total)])

    return run


def centred_products(q: np.ndarray, mean: np.ndarray) -> Callable:
    """Sum over the vectors of (x - mean) ((x - mean) q), a row for each entry."""
    d, m = q.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((d, m))
        for b in batches:
            for block in b.column(0).to_pylist():
                x = np.frombuffer(block, np.int64).reshape(-1, d) - mean
                out += x.T @ (x @ q)
        at = np.arange(d * m, dtype=np.int32)
        yield C.record(pa.schema([("at", pa.int32()), ("v", pa.float64())]), at, out.ravel())

    return run


def sums_of(fit: DataFrame, f: Callable, size: int) -> np.ndarray:
    """The tasks' partial sums added up in Spark: `size` numbers, whatever the number of tasks."""
    out = np.zeros(size)
    for r in C.map_arrow(fit, f, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r.at] = r.v
    return out


def moments(transform: np.ndarray, mean: np.ndarray, centre: np.ndarray, power: int) -> Callable:
    """Sums of y - centre, or of its products with itself, where y = (x - mean) transform."""
    d, k = transform.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k if power == 1 else (k, k))
        for b in batches:
            for block in b.column(0).to_pylist():
                y = (np.frombuffer(block, np.int64).reshape(-1, d) - mean) @ transform - centre
                out += y.sum(0) if power == 1 else y.T @ y
        yield C.record(pa.schema([("at", pa.int32()), ("v", pa.float64())]), np.arange(out.size, dtype=np.int32), out.ravel())

    return run


def squares(mean: np.ndarray) -> Callable:
    """The sum of squares of x - mean."""
    d = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = sum(float(((np.frombuffer(block, np.int64).reshape(-1, d) - mean) ** 2).sum()) for b in batches for block in b.column(0).to_pylist())
        yield C.record(pa.schema([("at", pa.int32()), ("v", pa.float64())]), [0], [float(out)])

    return run


# ---------------------------------------------------------------- the operator

OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64())])


def deviations(x: np.ndarray, n: int, total: list[int]) -> pa.Array:
    """Sum of (n x - total)^2 of each row, exactly."""
    most = n * max(1, abs(int(x.min())), abs(int(x.max()))) + max(map(abs, total))
    if x.shape[1] * most * most < 1 << 63:
        return pa.array(((n * x - np.array(total)) ** 2).sum(1)).cast(pa.decimal128(38, 0))
    import decimal

    exact = ((n * x.astype(object) - np.array(total, object)) ** 2).sum(1)
    return pa.array([decimal.Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def projected(transform: np.ndarray, mean: np.ndarray, n: int, total: list[int]) -> Callable:
    k = transform.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield C.record(OUT, b.column(0).take(each), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), deviations(x, n, total).take(each), ((x - mean) @ transform).ravel())

    return run


def whiten(df: DataFrame, components: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row and component."""
    rows, d = whole_vectors(df, {"vec_id": F.col(f"`{id_col}`").cast("long")}, vec_col)
    fit = C.staged(C.map_arrow(rows.select("x").distinct(), packed_blocks, "block binary"), "fit")
    # one partial product a task: tasks follow the bytes, not the number of files
    fit = fit.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-C.staged_bytes(fit) // TASK_BYTES)))
    sums = C.map_arrow(fit, column_sums(d), "dim int, v string").groupBy("dim").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    sums = {r.dim: int(r.v) for r in sums.collect()}  # d numbers
    n, total = sums.get(-1, 0), [sums.get(i, 0) for i in range(d)]
    mean = np.array([t / max(n, 1) for t in total])
    trace = sums_of(fit, squares(mean), 1)[0] / max(n, 1) if d else 0.0
    k = min(components, d, max(n - 1, 0))
    values, vectors = np.zeros(0), np.zeros((d, 0))
    if k and trace > 0:
        values, vectors = leading_pairs(lambda q: sums_of(fit, centred_products(q, mean), q.size).reshape(q.shape) / n, d, k)
        vary = values > 1e-12 * trace
        values, vectors = values[vary], vectors[:, vary]
        vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0) < 0, -1, 1)
    k = len(values)
    if not k:
        return rows.select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("decimal(38,0)").alias("deviation"), *(F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error"))).limit(0)
    transform = vectors / np.sqrt(values)
    centre = sums_of(fit, moments(transform, mean, np.zeros(k), 1), k) / n
    spread = sums_of(fit, moments(transform, mean, centre, 2), k * k).reshape(k, k) / n
    error = float(np.abs(spread - np.eye(k)).max())
    out = C.map_arrow(rows.select("vec_id", "x"), projected(transform, mean, n, total), "vec_id long, component int, deviation decimal(38,0), whitened double")
    shares = F.element_at(F.array(*map(F.lit, (values / trace).tolist())), F.col("component"))
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))
