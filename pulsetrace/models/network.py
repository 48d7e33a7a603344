"""A fitted perceptron outside MLlib: its signals, its loss, and the gradient by back-propagation.

Tasks take their rows in Arrow batches and a layer is one matrix product over a batch. Sums of losses and gradients leave a
task as one short row, whatever the number of its rows; the weights, a few hundred numbers, travel in the closure. A
weight column tells how many equal rows a row stands for; MLlib's own fit knows no weights.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import new_scratch
from ..sources.workers import importable
from .descent import minimise

Layers = list[tuple[np.ndarray, np.ndarray]]  # (outputs x inputs, outputs)


def layers_of(widths: Sequence[int], weights) -> Layers:
    """Matrices and biases from MLlib's flat weights: column by column, then the biases of the layer."""
    flat, at, out = np.asarray(weights, float), 0, []
    for n_in, n_out in zip(widths[:-1], widths[1:]):
        matrix = flat[at : at + n_in * n_out].reshape(n_in, n_out).T
        at += n_in * n_out
        out.append((matrix, flat[at : at + n_out]))
        at += n_out
    return out


def signals(x: np.ndarray, layers: Layers) -> list[np.ndarray]:
    """The inputs and every layer's signals; the last ones before the softmax."""
    out = [x]
    for k, (matrix, bias) in enumerate(layers, 1):
        raw = out[-1] @ matrix.T + bias
        if k < len(layers):
            np.negative(np.clip(raw, -700, 700, out=raw), out=raw)
            np.exp(raw, out=raw)
            raw += 1
            np.reciprocal(raw, out=raw)
        out.append(raw)
    return out


def losses(last: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Cross-entropy of every row."""
    top = last.max(axis=1, keepdims=True)
    return np.log(np.exp(last - top).sum(axis=1)) + top[:, 0] - last[np.arange(len(label)), label]


def gradient(all_signals: list[np.ndarray], layers: Layers, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum over the rows of the gradients of their losses, in MLlib's order of weights."""
    last = all_signals[-1]
    share = np.exp(last - last.max(axis=1, keepdims=True))
    delta = share / share.sum(axis=1, keepdims=True)
    delta[np.arange(len(label)), label] -= 1
    delta *= weight[:, None]
    parts = []
    for k in range(len(layers), 0, -1):
        before = all_signals[k - 1]
        parts += [delta.sum(axis=0), (before.T @ delta).ravel()]
        if k > 1:
            delta = (delta @ layers[k - 1][0]) * before * (1 - before)
    return np.concatenate(parts[::-1])


def _inputs(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(n)])


def with_expected(rows: DataFrame, layers: Layers, features: list[str], column: str = "prediction") -> DataFrame:
    """(``column``, expected): each row's prediction and the class of its strongest signal, the first on a tie."""

    def expected(batches):
        for batch in batches:
            last = signals(_inputs(batch, len(features)), layers)[-1]
            found = pa.array(last.argmax(axis=1).astype(float)) if len(last) else pa.array([], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(len(features)), found], [column, "expected"])

    importable(rows.sparkSession)
    return rows.select(*features, F.col(column).cast("double")).mapInArrow(expected, f"{column} double, expected double")


def mean_losses(
    rows: DataFrame, many: list[Layers], features: list[str], label: str = "label", weight: str | None = None
) -> list[float]:
    """Mean cross-entropy of the rows under each of several networks, in one pass."""
    return [float(v) for v in _sums(rows, many, features, label, weight, False)[0]]


def mean_gradient(
    rows: DataFrame, layers: Layers, features: list[str], label: str = "label", weight: str | None = None
) -> tuple[np.ndarray, float, int]:
    """(gradient of the mean cross-entropy, that mean, rows), in one pass and one aggregate."""
    means, slope, n = _sums(rows, [layers], features, label, weight, True)
    return slope, float(means[0]), n


def _part(x, y, w, many: list[Layers], with_gradient: bool) -> np.ndarray:
    """Sums of a batch: the loss under each network and, where asked for, its gradient."""
    parts = []
    for layers in many:
        found = signals(x, layers)
        parts.append([losses(found[-1], y) @ w])
        if with_gradient:
            parts.append(gradient(found, layers, y, w))
    return np.concatenate(parts)


def _sums(rows, many, features, label, weight, with_gradient):
    def sums(batches):
        total, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _inputs(batch, len(features)), batch.column(len(features)).to_numpy().astype(int)
            w = batch.column(len(features) + 1).to_numpy()
            part = _part(x, y, w, many, with_gradient)
            total, n = part if total is None else total + part, n + int(w.sum())
        if n:
            places = pa.array(np.arange(len(total), dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [places, pa.array(total), pa.array(np.full(len(total), n, np.int64))], ["i", "s", "n"]
            )

    importable(rows.sparkSession)
    counted = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    read = rows.select(*features, F.col(label).cast("int").alias("_label"), counted.alias("_weight"))
    found = read.mapInArrow(sums, "i int, s double, n long").groupBy("i").agg(F.sum("s"), F.sum("n"))
    ordered = sorted(found.collect())  # as many rows as weights
    values, n = np.array([r[1] for r in ordered]), ordered[0][2]
    return values[: len(many)] / n, values[len(many):] / n, n


def swept(batches, layers: Layers) -> np.ndarray | None:
    """Sum of the losses of packed rows, then that of their gradients in MLlib's order of weights; None without rows."""
    total, whole = None, _by_columns(layers)
    for *columns, label, weight in _unpacked(batches):
        for i in range(0, len(label), AT_ONCE):  # layers that fit a core's cache
            x = [c[i : i + AT_ONCE] for c in columns]
            y, w = label[i : i + AT_ONCE], weight[i : i + AT_ONCE].astype(float)
            if len(y) == AT_ONCE:
                part = whole(x, y, w)
            else:
                part = _part(np.column_stack(x).astype(float), y, w, [layers], True)
            total = part if total is None else total + part
    return total


def _by_columns(layers: Layers):
    """``_part`` of ``AT_ONCE`` rows with a column for every row: every step then runs along the rows, in place.

    The sums are in the same order. A row of ones under the signals makes biases one more weight.
    """
    hidden = len(layers) - 1
    # What a sigmoid takes the exponential of is negative, and so are the weights here that lead to it.
    ahead = [np.column_stack([m, b]) * (-1.0 if k < hidden else 1.0) for k, (m, b) in enumerate(layers)]
    found = [np.ones((a.shape[1], AT_ONCE)) for a in ahead]
    ends = np.cumsum([len(b) for _, b in layers])
    deltas = np.empty((AT_ONCE, ends[-1]))
    classes = np.arange(len(layers[-1][1]))[:, None]

    def part(x, y, w):
        for row, column in zip(found[0], x):
            row[:] = column
        for k in range(hidden):
            raw = np.matmul(ahead[k], found[k], out=found[k + 1][:-1])
            with np.errstate(over="ignore"):  # a signal of 0
                np.exp(raw, out=raw)
            raw += 1
            np.reciprocal(raw, out=raw)
        last, known = ahead[-1] @ found[-1], y == classes
        top = last.max(axis=0)
        delta = np.exp(last - top)
        share = delta.sum(axis=0)
        loss = (np.log(share) + top - np.where(known, last, 0).sum(axis=0)) @ w
        delta /= share
        delta -= known
        delta *= w
        slopes = []
        for k in range(hidden, -1, -1):
            before = found[k][:-1]
            slopes.append((before @ delta.T).ravel())
            deltas[:, ends[k] - len(delta) : ends[k]] = delta.T
            if k:
                delta = layers[k][0].T @ delta
                delta *= before
                delta *= np.subtract(1, before, out=before)
        biases = np.split(deltas.sum(axis=0), ends[:-1])
        return np.concatenate([[loss], *(p for pair in zip(slopes[::-1], biases) for p in pair)])

    return part


def fit_weights(
    vectors: DataFrame, widths: Sequence[int], start, weight: str, max_iter: int = 100, tol: float = 1e-6
) -> np.ndarray:
    """MLlib's flat weights after the descent from ``start`` over ``vectors`` (features, label, ``weight``).

    The rows are written once, packed into columns, and then held in equal tasks; a pass reads these and sends one short
    row per task to the driver.
    """
    blocks = _packed(vectors, weight)
    n, last, number, parts = blocks.agg(
        F.coalesce(F.sum("n"), F.lit(0.0)), F.max("last"), F.count("*"), F.count_distinct("part")
    ).first()
    if not n:
        raise ValueError("no rows to fit")
    if last >= widths[-1]:
        raise ValueError(f"label {last}; the last layer has {widths[-1]}")
    held = _dealt(blocks, number, parts).persist(StorageLevel.MEMORY_AND_DISK)

    def objective(flat):
        layers = layers_of(widths, flat)

        def sums(batches):
            total = swept(batches, layers)
            if total is not None:
                yield pa.RecordBatch.from_pylist([{"task": TaskContext.get().partitionId(), "sums": total.tolist()}], PASS)

        # Added up in the order of the tasks, so that a fit can be repeated.
        found = sorted(held.mapInArrow(sums, "task int, sums array<double>").collect())
        total = np.sum([r["sums"] for r in found], axis=0)
        return total[0] / n, total[1:] / n

    try:
        return minimise(objective, np.asarray(start, float), max_iter, tol)
    finally:
        held.unpersist()


AT_ONCE = 2_000
BLOCKS_PER_TASK = 100
PASS = pa.schema([("task", pa.int32()), ("sums", pa.list_(pa.float64()))])
BLOCK = pa.schema([
    ("part", pa.int32()), ("place", pa.int32()), ("kinds", pa.string()), ("size", pa.int32()), ("rows", pa.binary()),
    ("n", pa.float64()), ("last", pa.int32()),
])


def _narrow(column: np.ndarray) -> np.ndarray:
    """The same values in the first of numpy's kinds that holds them all, from one byte to eight."""
    low, high = column.min(), column.max()
    for kind in "bhi":
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max and np.array_equal(short := column.astype(kind), column):
            return short
    with np.errstate(over="ignore"):
        return short if np.array_equal(short := column.astype("f"), column) else column


def _packed(vectors: DataFrame, weight: str) -> DataFrame:
    """(part, place, kinds, size, rows, n, last): per Arrow batch the partition, its place there, its features, classes and weights,
    column after column, each of the kind that ``_narrow`` finds and filled up to whole words; the weights' sum; the last class."""

    def pack(batches):
        for place, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            x, y, w = (batch.column(i) for i in range(3))
            y, w = (c.to_numpy(zero_copy_only=False) for c in (y, w))
            if not (y == np.floor(y)).all() or y.min() < 0:  # a null is NaN here
                raise ValueError("labels must be classes 0, 1 and so on")
            x = np.ascontiguousarray(x.flatten().to_numpy().reshape(len(y), -1).T)
            columns = [_narrow(c) for c in (*x, y, w)]
            yield pa.RecordBatch.from_pylist([{
                "part": TaskContext.get().partitionId(), "place": place,
                "kinds": "".join(c.dtype.char for c in columns), "size": len(y),
                "rows": b"".join(c.tobytes() + bytes(-c.nbytes % 8) for c in columns),
                "n": float(w.sum()), "last": int(y.max()),
            }], BLOCK)

    importable(vectors.sparkSession)
    read = vectors.select(vector_to_array("features").alias("x"), F.col("label").cast("double"), F.col(weight).cast("double"))
    path = new_scratch(vectors.sparkSession, "blocks")
    schema = "part int, place int, kinds string, size int, rows binary, n double, last int"
    read.mapInArrow(pack, schema).write.option("compression", "zstd").parquet(path)
    return vectors.sparkSession.read.schema(schema).parquet(path)


def _dealt(blocks: DataFrame, number: int, parts: int) -> DataFrame:
    """The blocks, whole partitions in their order, in tasks that are as many for every core where there are so many partitions."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    tasks = min(parts, cores * -(-number // (cores * BLOCKS_PER_TASK)))
    dealt = blocks.repartitionById(tasks, F.col("part") % tasks)
    return dealt.sortWithinPartitions("part", "place").select("kinds", "size", "rows")


def _unpacked(batches):
    """The columns of every block of ``_packed``, not copied."""
    for batch in batches:
        for kinds, size, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            columns, at, rows = [], 0, rows.as_buffer()
            for kind in kinds:
                columns.append(np.frombuffer(rows, kind, size, at))
                at += -(-columns[-1].nbytes // 8) * 8
            yield columns
