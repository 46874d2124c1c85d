"""Linear classifiers fitted side by side: MLlib's objectives and optimizers, one pass over packed rows for all of them.

MLlib keeps a copy of the training rows per fit, and per class of a one-vs-rest model, and reads each copy once per step.
Here the rows are packed once (a column number and a count per word), and a pass works out loss and gradient of every
model that waits for one. Optimizers are generators: they yield a point and are sent its value and gradient. They follow
Breeze step by step, so the models are MLlib's up to the order in which numbers are summed.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Generator, Iterable, Iterator, Sequence
from functools import reduce
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkContext, StorageLevel, cloudpickle
from pyspark.ml.classification import LinearSVCModel, LogisticRegression, LogisticRegressionModel, OneVsRest, OneVsRestModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Workers get the functions of this module themselves; they may not find the package by path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of a block: what a worker unpacks at a time, small enough to stay in a core's cache.
BLOCK_WORDS = 1 << 15
ROWS_PER_TASK = 2_000
#: A task takes at most so many rows, however few cores there are: a stored partition stays below 2 GB.
MOST_ROWS = 500_000
#: Rows of up to so many words in all, a few MB, are passed over where the search runs: a job would be all scheduling.
FEW_WORDS = 1 << 19
#: Partial sums of up to so many tasks go to the driver as they are.
MOST_SUMS = 64
#: Bytes of a batch of rows on its way to a worker, unless the session has a limit of its own.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
HISTORY = 10
WINDOW = 20

Evaluated = tuple[float, np.ndarray]
Search = Generator[np.ndarray, Evaluated, tuple]


class SearchError(Exception):
    """No step was found along a direction."""


# ---- optimizers -------------------------------------------------------------------------------


def quasi_newton(history: list[tuple[np.ndarray, np.ndarray]], grad: np.ndarray) -> np.ndarray:
    """The direction of limited-memory BFGS; ``history`` has steps and changes of the gradient, newest first."""
    direction, scale = grad.copy(), 1.0
    if history:
        step, change = history[0]
        along = step @ change
        if not along >= 0:
            raise SearchError("curvature")
        with np.errstate(all="ignore"):
            scale = along / (change @ change)
    shares = []
    for step, change in history:
        with np.errstate(all="ignore"):
            rho = step @ change
            share = (step @ direction) / rho
        if np.isnan(share):
            raise SearchError("history")
        shares.append((share, rho))
        direction -= share * change
    direction *= scale
    for (step, change), (share, rho) in zip(reversed(history), reversed(shares), strict=True):
        direction += (share - (change @ direction) / rho) * step
    return -direction


def _between(left: tuple, right: tuple) -> float:
    """The minimum of the cubic through two points ``(t, slope, value)``, kept off both ends."""
    (a, slope_a, value_a), (b, slope_b, value_b) = left[:3], right[:3]
    with np.errstate(all="ignore"):
        d1 = slope_a + slope_b - 3 * (value_a - value_b) / np.float64(a - b)
        d2 = np.sqrt(d1 * d1 - slope_a * slope_b)
        t = b - (b - a) * (slope_b + d2 - d1) / (slope_b - slope_a + 2 * d2)
    least, most = a + 0.1 * (b - a), a + 0.9 * (b - a)
    return least if t < least else most if t > most else t


def strong_wolfe(move, direction: np.ndarray, value: float, grad: np.ndarray, t: float) -> Search:
    """A step that meets the strong Wolfe conditions (Nocedal and Wright); the new point, its value and gradient."""
    slope = grad @ direction
    low = (0.0, slope, value, None)
    if slope > 0:
        raise SearchError("not a descent")

    def at(t: float) -> Search:
        x = move(t)
        new, new_grad = yield x
        return t, new_grad @ direction, new, (t, x, new, new_grad)

    def zoom(low: tuple, high: tuple) -> Search:
        for _ in range(10):
            t = _between(high, low) if low[0] > high[0] else _between(low, high)
            c = yield from at(t)
            if c[2] > value + 1e-4 * c[0] * slope or c[2] >= low[2]:
                high = c
                continue
            if abs(c[1]) <= 0.9 * abs(slope):
                return c[3]
            if c[1] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise SearchError("zoom")

    for i in range(10):
        c = yield from at(t)
        if not np.isfinite(c[2]):
            t /= 2
            continue
        if c[2] > value + 1e-4 * t * slope or (c[2] >= low[2] and i > 0):
            return (yield from zoom(low, c))
        if abs(c[1]) <= 0.9 * abs(slope):
            return c[3]
        if c[1] >= 0:
            return (yield from zoom(c, low))
        low = c
        t *= 1.5
    raise SearchError("search")


def backtracking(move, direction: np.ndarray, value: float, grad: np.ndarray, t: float, shrink: float) -> Search:
    """A step that meets the same conditions, found by shrinking and growing; the new point, its value and gradient.

    Breeze takes the value where it stands for that of the first step, so it never keeps that one if it goes down.
    """
    slope = grad @ direction
    found, reached = None, 0.0
    for turn in range(20):
        if turn or not slope < 0:
            x = move(t)
            new, new_grad = yield x
            found, reached = (t, x, new, new_grad), new_grad @ direction
        if (found[2] if turn else value) > value + t * slope * 1e-4:
            factor = shrink
        elif reached < 0.9 * slope:
            factor = 2.1
        elif reached > -0.9 * slope:
            factor = shrink
        else:
            return found
        t *= factor
        if not 1e-10 <= t <= 1e10:
            raise SearchError("step size")
    return found


def minimized(x: np.ndarray, iterations: int, tolerance: float, orthants: bool = False) -> Generator[np.ndarray, Evaluated, np.ndarray]:
    """Breeze's ``LBFGS``, or with ``orthants`` its ``OWLQN`` without a penalty, as MLlib's classifiers run them."""
    value, grad = yield x
    start, recent, history, done, failed = value, [np.inf], [], 0, False
    while not (
        done >= iterations
        or (len(recent) >= 2 and abs(value - max(recent)) <= tolerance * start)
        or np.linalg.norm(grad) <= max(tolerance * value, 1e-8)
    ):
        try:
            direction = quasi_newton(history, grad)
            if orthants:
                direction = np.where(direction * grad < 0, direction, 0.0)
                signs = np.where(x != 0, np.sign(x), np.sign(-grad))

                def move(t, x=x, direction=direction, signs=signs):
                    moved = x + direction * t
                    return moved * (np.sign(moved) == signs)

                first = 1.0 if done else 0.5 / np.linalg.norm(grad)
                found = yield from backtracking(move, direction, value, grad, first, 0.5 if done else 0.1)
            else:

                def move(t, x=x, direction=direction):
                    return x + direction * t

                first = 1.0 if done else 1.0 / np.linalg.norm(direction)
                found = yield from strong_wolfe(move, direction, value, grad, first)
                if found[0] * np.linalg.norm(grad) < 1e-10:
                    raise SearchError("step size")
        except SearchError:
            if failed:
                break
            failed, history = True, []
            continue
        failed = False
        _, new_x, value, new_grad = found
        history = [(new_x - x, new_grad - grad), *history][:HISTORY]
        recent = [*recent, value][-WINDOW:]
        x, grad, done = new_x, new_grad, done + 1
    return x


# ---- rows -------------------------------------------------------------------------------------


def _packed(weights: np.ndarray, labels: Sequence[str]):
    """A function that packs batches of labels, column numbers and values into blocks of about ``BLOCK_WORDS``."""

    def block(columns: np.ndarray, values: np.ndarray, lengths: np.ndarray, marks: np.ndarray) -> bytes:
        counts = values / weights[columns]
        whole = np.rint(counts)
        # What is a count times the column's weight to the last bit is kept as the count.
        if counts.size and whole.max() < 256 and np.array_equal(whole * weights[columns], values):
            counts = whole.astype(np.uint8)
        least = np.uint16 if len(weights) <= 1 << 16 else np.int32
        return pickle.dumps((columns.astype(least), counts, lengths, marks), protocol=5)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("columns")
            if not isinstance(lists, pa.ListArray):
                lists = lists.cast(pa.list_(pa.int32()))
            columns = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            values = batch.column("values").flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            kept = values != 0
            columns, values = columns[kept], values[kept]
            ends = np.cumsum(np.bincount(owner[kept], minlength=batch.num_rows))
            marks = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in labels])
            row = 0
            while row < batch.num_rows:
                begin = ends[row - 1] if row else 0
                last = max(int(np.searchsorted(ends, begin + BLOCK_WORDS, side="right")), row + 1)
                last = min(last, row + BLOCK_WORDS)
                part = slice(begin, ends[last - 1])
                lengths = np.diff(ends[row:last], prepend=begin).astype(np.int32)
                made = block(columns[part], values[part], lengths, marks[:, row:last])
                yield pa.RecordBatch.from_pydict({"block": pa.array([made], pa.binary())})
                row = last

    return pack


def packed_rows(rows: DataFrame, weights: np.ndarray, labels: Sequence[str], number: int) -> RDD:
    """The sparse ``features`` and the label columns as blocks of bytes, dealt over the cores and kept in memory and on disk.

    ``weights`` are what the counts of each column were multiplied by; columns of weight 0 hold nothing.
    """
    parts = rows.select(
        *labels, F.unwrap_udt("features")["indices"].alias("columns"), F.unwrap_udt("features")["values"].alias("values")
    )
    spark = rows.sparkSession
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    cores = spark.sparkContext.defaultParallelism
    tasks = max(min(-(-number // ROWS_PER_TASK), cores), -(-number // MOST_ROWS), 1)
    blocks = parts.mapInArrow(_packed(weights, labels), "block binary")
    dealt = blocks.withColumn("_no", F.monotonically_increasing_id()).repartition(tasks, "_no").select("block")
    return dealt.rdd.map(lambda row: bytes(row[0])).persist(StorageLevel.MEMORY_AND_DISK)


def _sums(blocks: Iterable[bytes], shared) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Losses per model, and per output the sums of its multipliers and of the counts times these.

    The slopes of a softmax add up to zero over its classes, in its gradient as well, so its last class takes no slopes.
    """
    asked, slopes, offsets = shared.value
    losses, totals, sums = np.zeros(len(asked)), np.zeros(len(offsets)), np.zeros(slopes.shape)
    for packed in blocks:
        columns, counts, lengths, marks = pickle.loads(packed)
        columns, counts = columns.astype(np.int64), counts.astype(np.float64)
        worded = lengths > 0
        starts = (np.cumsum(lengths) - lengths)[worded]
        part = np.empty(len(columns))

        def margins(row, part=part, columns=columns, counts=counts, worded=worded, starts=starts):
            found = np.zeros(len(worded))
            if len(columns):
                np.take(slopes[row], columns, out=part, mode="clip")
                found[worded] = np.add.reduceat(np.multiply(part, counts, out=part), starts)
            return found

        row = first = 0
        for place, (kind, mark, outputs, cls) in enumerate(asked):
            held = max(outputs - 1, 1)
            own = np.array([margins(row + i) for i in range(held)])
            if kind == "softmax":
                own = np.vstack([own, -own.sum(axis=0)]) + offsets[first : first + outputs, None]
                label = marks[mark].astype(np.int64)
                every = np.arange(len(label))
                most = own.max(axis=0)
                right = own[label, every] - most
                np.exp(own - most, out=own)
                total = own.sum(axis=0)
                losses[place] += (np.log(total) - right).sum()
                own /= total
                own[label, every] -= 1
            else:
                sign = np.where(marks[mark] == cls, 1.0, -1.0)
                loss = 1 - sign * (own[0] + offsets[first])
                losses[place] += loss[loss > 0].sum()
                own[0] = np.where(loss > 0, -sign, 0.0)
            totals[first : first + outputs] += own.sum(axis=1)
            for i in range(held):
                np.multiply(np.repeat(own[i], lengths), counts, out=part)
                sums[row + i] += np.bincount(columns, weights=part, minlength=slopes.shape[1])
            row, first = row + held, first + outputs
    yield losses, totals, sums


def _added(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def _together(
    blocks: RDD | list[bytes], asked: list, slopes: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass over the rows for all outputs that are asked for."""
    if isinstance(blocks, list):
        return next(_sums(blocks, SimpleNamespace(value=(asked, slopes, offsets))))
    shared = blocks.context.broadcast((asked, slopes, offsets))
    try:
        parts = blocks.mapPartitions(lambda part: _sums(part, shared))
        if blocks.getNumPartitions() > MOST_SUMS:
            return parts.treeReduce(_added, 2)
        return reduce(_added, parts.collect())
    finally:
        shared.destroy()


# ---- models -----------------------------------------------------------------------------------


class _Columns:
    """Means and deviations of the columns; ``scale`` makes standardized values of counts."""

    def __init__(self, rows: DataFrame, weights: np.ndarray):
        metrics = Summarizer.metrics("mean", "std", "count", "numNonZeros")
        found = rows.select(metrics.summary(F.col("features")).alias("s")).first()["s"]
        self.number, deviation = found["count"], found["std"].toArray()
        self.words = found["numNonZeros"].toArray().sum()
        self.inverse = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation != 0)
        self.mean = found["mean"].toArray() * self.inverse
        self.scale = weights * self.inverse


class _Task:
    """One search over all rows: its outputs, and the way between its point and the coefficients of the counts."""

    def __init__(self, kind: str, mark: int, cls: int, stage, outputs: int, start: np.ndarray, columns: _Columns):
        self.kind, self.mark, self.cls, self.outputs, self.columns = kind, mark, cls, outputs, columns
        self.asked = (kind, mark, outputs, cls)
        self.reg = stage.getRegParam()
        self.search = minimized(start, stage.getMaxIter(), stage.getTol(), orthants=kind == "hinge")
        self.point, self.found = next(self.search), None

    def linear(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of the standardized columns, and the offsets with the columns' means taken out."""
        slopes = point[: -self.outputs].reshape(self.outputs, -1)
        return slopes, point[-self.outputs :] - slopes @ self.columns.mean

    def send(self, loss: float, totals: np.ndarray, sums: np.ndarray) -> None:
        slopes = self.point[: -self.outputs]
        if self.kind == "softmax":
            sums = np.vstack([sums, -sums.sum(axis=0)])
        grad = sums * self.columns.scale - totals[:, None] * self.columns.mean
        grad = np.concatenate([grad.ravel() / self.columns.number + self.reg * slopes, totals / self.columns.number])
        value = loss / self.columns.number + 0.5 * self.reg * (slopes @ slopes)
        try:
            self.point = self.search.send((value, grad))
        except StopIteration as end:
            self.found = end.value

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """What was found, for the columns as they are."""
        slopes, offsets = self.linear(self.found)
        return slopes * self.columns.inverse, offsets


def _made(kind: type, stage, *parts):
    """MLlib's model of what was fitted, with the parameters of the stage that stands for the fit."""
    context = SparkContext.getOrCreate()
    java = [p if isinstance(p, int | float) else _py2java(context, p) for p in parts]
    made = kind(kind._new_java_obj(f"org.apache.spark.ml.classification.{kind.__name__}", stage.uid, *java))
    made._resetUid(stage.uid)
    return stage._copyValues(made)


def _softmax(task: _Task, stage: LogisticRegression) -> LogisticRegressionModel:
    slopes, offsets = task.parts()
    matrix = DenseMatrix(*slopes.shape, slopes.ravel(), isTransposed=True)
    return _made(LogisticRegressionModel, stage, matrix, Vectors.dense(offsets - offsets.mean()), len(offsets), True)


def _one_vs_rest(tasks: list[_Task], stage: OneVsRest) -> OneVsRestModel:
    models = []
    for task in tasks:
        slopes, offsets = task.parts()
        one = stage.getClassifier().copy({stage.getClassifier().labelCol: f"mc2b${task.cls}"})
        models.append(_made(LinearSVCModel, one, Vectors.dense(slopes[0]), float(offsets[0])))
    return stage._copyValues(OneVsRestModel(models=models))


def _begun(stage, label: str, mark: int, rows: DataFrame, columns: _Columns) -> list[_Task]:
    """The searches of a stage; none if MLlib has no search to make either."""
    counts = {int(r[0]): r["count"] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return []
    size = len(columns.scale)
    if isinstance(stage, OneVsRest):
        one = stage.getClassifier()
        return [_Task("hinge", mark, c, one, 1, np.zeros(size + 1), columns) for c in range(max(counts) + 1)]
    if len(counts) == 1 or stage.getElasticNetParam():
        return []
    named = rows.schema[label].metadata.get("ml_attr", {}).get("vals", [])
    classes = max(len(named), max(counts) + 1)
    seen = np.log1p([counts.get(c, 0) for c in range(max(counts) + 1)])
    offsets = np.zeros(classes)  # a class beyond those that occur begins at the mean of the others
    offsets[: len(seen)] = seen - seen.mean()
    start = np.concatenate([np.zeros(classes * size), offsets])
    return [_Task("softmax", mark, 0, stage, classes, start, columns)]


def fit_side_by_side(rows: DataFrame, weights: np.ndarray, wanted: Sequence[tuple]) -> list:
    """A model per wanted ``(stage, label column)``: multinomial regression or one-vs-rest SVM on ``features``.

    ``weights`` are the factors of the words' counts in ``features``. Labels of a single class leave nothing to search;
    there the result is None.
    """
    columns = _Columns(rows, weights)
    labels = list(dict.fromkeys(label for _, label in wanted))
    begun = [_begun(stage, label, labels.index(label), rows, columns) for stage, label in wanted]
    waiting = [task for tasks in begun for task in tasks]
    kept = packed_rows(rows, weights, labels, columns.number)
    try:
        blocks = kept.collect() if columns.words <= FEW_WORDS else kept
        while waiting:
            linear = [task.linear(task.point) for task in waiting]
            slopes = np.concatenate([found[: max(len(found) - 1, 1)] for found, _ in linear]) * columns.scale
            offsets = np.concatenate([found for _, found in linear])
            losses, totals, sums = _together(blocks, [task.asked for task in waiting], slopes, offsets)
            row = first = 0
            for place, (task, (found, _)) in enumerate(zip(waiting, linear, strict=True)):
                held, outputs = max(len(found) - 1, 1), len(found)
                task.send(losses[place], totals[first : first + outputs], sums[row : row + held])
                row, first = row + held, first + outputs
            waiting = [task for task in waiting if task.found is None]
    finally:
        kept.unpersist()
    made = {True: _one_vs_rest, False: lambda tasks, stage: _softmax(tasks[0], stage)}
    return [made[isinstance(stage, OneVsRest)](tasks, stage) if tasks else None for tasks, (stage, _) in zip(begun, wanted, strict=True)]
