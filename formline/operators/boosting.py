"""Boosted regression trees as Spark's GBTRegressor grows them, fitted in one stage.

Spark fits a tree by some jobs a level. Here rows become counted cells of bins, each task of one barrier stage keeps its cells, and only histograms go
from task to task. Trees are the same: 32 bins a feature by Spark's rule, variance as impurity, twice the residual as label, the first tree whole.
"""

from __future__ import annotations

import contextlib
import secrets
import socket
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
#: Tasks that exchange histograms at most, as one of them adds them up, and rows that are worth one more of them.
TASKS, TASK_ROWS = 16, 50_000
#: Seconds that a task waits for another one.
WAIT = 600


def best_round(errors: Sequence[float], patience: int) -> int | None:
    """The number of trees with the least error before `patience` rounds without a smaller one; None if the errors end sooner."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        if i - best >= patience:
            return best + 1
    return None


def _split_points(values: Iterator[tuple[int, float, int]], total: int) -> Iterator[tuple[int, float]]:
    """(feature, threshold) of (feature, value, count) in order, each feature's counts summing up to total: all middles of few values, else those nearest to equal shares."""
    stride, at, first, cuts = total / BINS, None, [], []
    last, seen, goal = 0.0, 0, 0.0
    for i, v, n in values:
        if i != at:
            yield from ((at, c) for c in _of_few(first, cuts))
            at, first, cuts, last, seen, goal = i, [v], [], v, n, stride
            continue
        if len(first) <= BINS:
            first.append(v)
        if abs(seen - goal) < abs(seen + n - goal):
            cuts.append((last + v) / 2)
            goal += stride
        last, seen = v, seen + n
    yield from ((at, c) for c in _of_few(first, cuts))


def _of_few(first: list[float], cuts: list[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(first, first[1:], strict=False)] if len(first) <= BINS else cuts


def thresholds(train: DataFrame, names: Sequence[str], total: int) -> list[np.ndarray]:
    """The thresholds of each column, from all rows; a task reads the distinct values of a column in order, so none has to hold them."""
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(names)])
    counts = train.select(F.explode(values).alias("x")).groupBy("x.i", "x.v").agg(F.count("*").alias("n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        found = list(_split_points(rows, total))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([t for _, t in found], pa.float64())], ["i", "t"])

    out = [[] for _ in names]
    for r in counts.repartition(len(names), "i").sortWithinPartitions("i", "v").mapInArrow(cut, "i int, t double").collect():
        out[r["i"]].append(r["t"])
    return [np.unique(np.array(t)) for t in out]


def _binned(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    if any(np.isnan(c).any() for c in columns):
        raise ValueError("a feature is not a number")
    return np.array([np.searchsorted(t, c, "left") for c, t in zip(columns, cuts, strict=True)], np.uint8).reshape(len(cuts), -1)


def cells(df: DataFrame, names: Sequence[str], target: str, cuts: Sequence[np.ndarray]) -> DataFrame:
    """(code, train, n, s, q) of df(split, target, names): rows, sum and squares of the target by split and bins. Trees tell no rows of a cell apart."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = np.ascontiguousarray(_binned([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]], cuts).T)
            yield pa.RecordBatch.from_arrays([pa.array(map(bytes, bins), pa.binary()), b.column(0), b.column(1)], ["code", "train", "y"])

    rows = df.select((F.col("split") == "train").alias("train"), F.col(target).cast("double").alias("y"), *names).mapInArrow(code, "code binary, train boolean, y double")
    return rows.groupBy("code", "train").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))


def _best_splits(h: np.ndarray, cuts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, last bin to the left and the mean of either side of each node; h: (count or sum, feature, node, bin). A node that gains nothing goes left as a whole."""
    left = h.cumsum(axis=3)
    all_ = left[:, :1, :, -1:]
    n, s = left
    m, r = all_ - left
    can = (n >= 1) & (m >= 1) & (np.arange(h.shape[3]) < np.array([len(t) for t in cuts])[:, None, None])
    parts = np.where(can, s * s / np.maximum(n, 1) + r * r / np.maximum(m, 1), 0.0)
    gain = np.where(can, parts - (all_[1] ** 2 / np.maximum(all_[0], 1)), -1.0)
    gain = np.where(gain > 1e-13 * parts, gain, -1.0)
    flat, scale = (x.transpose(1, 0, 2).reshape(h.shape[2], -1) for x in (gain, parts))
    # what differs by no more than sums in another order do is a tie, and the first one is taken, so that reruns agree
    most = flat.max(axis=1, keepdims=True)
    best = np.argmax(flat >= most - 1e-13 * scale.max(axis=1, keepdims=True), axis=1)
    none = most[:, 0] <= 0
    f, b = np.where(none, 0, best // h.shape[3]), np.where(none, 255, best % h.shape[3])
    k = np.arange(h.shape[2])
    mean = lambda c, d: np.where(c > 0, d / np.maximum(c, 1), 0.0)
    whole = mean(all_[0, 0, :, 0], all_[1, 0, :, 0])
    at = (f, k, np.minimum(b, h.shape[3] - 1))
    return f, b, np.where(none, whole, [mean(n[at], s[at]), mean(m[at], r[at])])


def _grow(bins: np.ndarray, train: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray, cuts: Sequence[np.ndarray], share, trees: int, rate: float, depth: int, patience: int | None):
    """The trees up to the one of the least error as (features, bins, leaves), each task alike. share: the sum of an array over all tasks."""
    order = np.argsort(~train, kind="stable")
    bins, (n, s, q) = np.ascontiguousarray(bins[:, order]), (x[order].astype(float) for x in (n, s, q))
    t = int(train.sum())
    width = max((len(c) for c in cuts), default=0) + 1
    # of a feature of two bins the rarer one is counted, the other one is the rest
    rare = {f: (b, np.flatnonzero(bins[f, :t] == b)) for f, c in enumerate(cuts) if len(c) == 1 and width > 2 for b in [int((bins[f, :t] == 1).sum() * 2 <= t)]}
    used = [f for f in range(len(cuts)) if len(cuts[f]) and f not in rare]
    value, out, errors = np.zeros(len(n)), [], []
    for tree in range(trees):
        label = 2 * (s[:t] - n[:t] * value[:t]) if tree else s[:t]
        node, made = np.zeros(len(n), np.uint16), ([], [])
        for level in range(depth):
            k = 1 << level
            h = np.zeros((2, len(cuts), k, width))
            base = node[:t] * np.uint16(width)
            for f in used:
                at = (base + bins[f, :t]).astype(np.intp)
                h[:, f] = [np.bincount(at, w, k * width).reshape(k, width) for w in (n[:t], label)]
            totals = h[:, used[0]].sum(axis=2) if used else np.array([np.bincount(node[:t], w, k) for w in (n[:t], label)])
            for f, (b, rows) in rare.items():
                h[:, f, :, b] = [np.bincount(node[rows], w[rows], k) for w in (n, label)]
                h[:, f, :, 1 - b] = totals - h[:, f, :, b]
            f, b, means = _best_splits(share(h), cuts)
            made[0].extend(f.tolist()), made[1].extend(b.tolist())
            go = np.zeros(len(n), bool)
            for i in range(k):
                if b[i] < 255:
                    go |= (node == i) & (bins[f[i]] > b[i])
            node = 2 * node + go
        leaves = (means.T.reshape(-1) * (rate if tree else 1.0)).tolist()
        value += np.array(leaves)[node]
        out.append((*made, leaves))
        if patience is not None:
            v, y = value[t:], slice(t, None)
            errors.append(float(share(np.array([(q[y] - 2 * v * s[y] + n[y] * v * v).sum()]))[0]))
            if best := best_round(errors, patience):
                return out[:best]
    return out if patience is None else out[: min(range(len(out)), key=errors.__getitem__) + 1]


class _Sum:
    """The sum of an array over the tasks of a barrier stage, in their order: the first task adds, the others are connected to it. The context's own exchange takes a second each time."""

    def __init__(self, context):
        self.first, self.tasks = context.partitionId() == 0, len(context.getTaskInfos())
        self.links = []
        if self.tasks == 1:
            return
        server = socket.create_server(("", 0), backlog=self.tasks) if self.first else None
        key = secrets.token_hex(16)
        port, key = context.allGather(f"{server.getsockname()[1] if server else 0} {key}")[0].split()
        if server:
            with server:
                server.settimeout(WAIT)
                came = {}
                while len(came) < self.tasks - 1:
                    link, _ = server.accept()
                    link.settimeout(WAIT)
                    hello = self._read(link, 40)
                    if secrets.compare_digest(hello[:32], key.encode()):
                        came[int(hello[32:])] = link
                    else:
                        link.close()
            self.links = [came[i] for i in sorted(came)]
        else:
            host = context.getTaskInfos()[0].address.rsplit(":", 1)[0].strip("[]")
            self.links = [socket.create_connection((host, int(port)), WAIT)]
            self.links[0].sendall(f"{key}{context.partitionId():08d}".encode())
        for link in self.links:
            link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def _read(link: socket.socket, size: int) -> bytes:
        out = bytearray()
        while len(out) < size:
            part = link.recv(size - len(out))
            if not part:
                raise ConnectionError("a task of the fit has ended")
            out += part
        return bytes(out)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.first:
            for link in self.links:
                x = x + np.frombuffer(self._read(link, x.nbytes)).reshape(x.shape)
            for link in self.links:
                link.sendall(x.tobytes())
            return x
        self.links[0].sendall(x.tobytes())
        return np.frombuffer(self._read(self.links[0], x.nbytes)).reshape(x.shape)

    def close(self) -> None:
        for link in self.links:
            link.close()


def fit(counted: DataFrame, rows: int, cuts: Sequence[np.ndarray], trees: int, rate: float, depth: int, patience: int | None) -> list[tuple[list[int], list[int], list[float]]]:
    """The trees for cells() of so many rows. Without patience all of them, else up to the least squared error of the other rows before `patience` rounds without a smaller one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        data = list(batches)
        code = b"".join(x for b in data for x in b.column("code").to_pylist())
        bins = np.frombuffer(code, np.uint8).reshape(-1, len(cuts)).T
        column = lambda c, kind: np.concatenate([np.zeros(0, kind), *[b.column(c).to_numpy(zero_copy_only=False) for b in data]]).astype(kind)

        with contextlib.closing(_Sum(context)) as total:
            out = _grow(bins, column("train", bool), column("n", float), column("s", float), column("q", float), cuts, total, trees, rate, depth, patience)
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), *[pa.array([x[i] for x in out], pa.list_(k)) for i, k in enumerate((pa.int32(), pa.int32(), pa.float64()))]], ["tree", "f", "b", "leaves"])

    tasks = max(1, min(counted.sparkSession.sparkContext.defaultParallelism, TASKS, 1 + rows // TASK_ROWS))
    made = counted.repartition(tasks).mapInArrow(task, "tree int, f array<int>, b array<int>, leaves array<double>", barrier=True).collect()
    return [(r["f"], r["b"], r["leaves"]) for r in sorted(made, key=lambda r: r["tree"])]


def scored(df: DataFrame, names: Sequence[str], cuts: Sequence[np.ndarray], trees: Sequence[tuple[list[int], list[int], list[float]]]) -> DataFrame:
    """df with prediction: the sum of the trees' leaves."""
    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        bins = _binned([x[c].to_numpy(float) for c in x.columns], cuts)
        out = np.zeros(bins.shape[1])
        for f, b, leaves in trees:
            out += _leaf(bins, f, b, leaves)
        return pd.Series(out)

    return df.withColumn("prediction", score(F.struct(*names)))


def _leaf(bins: np.ndarray, f: Sequence[int], b: Sequence[int], leaves: Sequence[float]) -> np.ndarray | float:
    """The leaf of each column of bins: nodes are numbered level by level, so the children of i are 2i + 1 and 2i + 2."""
    values = list(leaves)
    for i in range(len(f) - 1, -1, -1):
        right, left = values.pop(), values.pop()
        values.insert(0, left if b[i] == 255 else np.where(bins[f[i]] > b[i], right, left))
    return values[0]
