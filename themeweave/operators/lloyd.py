"""k-means of many runs at once: Lloyd's steps over blocks of unit vectors, distances skipped where bounds rule a change out."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, functions as F

from themeweave.session import cut

#: Vectors of a block, rows of one matrix product, and the most partitions (each sends one sum a run and step to the driver).
BLOCK = 16
ROWS = 4_096
MAX_PARTS = 256
#: Rounds in which candidates are drawn, and how many in each, as a multiple of k.
ROUNDS = 2
OVERSAMPLE = 2
#: Steps end when the centres' squared moves sum up to so much of the vectors' mean variance at most.
TOLERANCE = 1e-4
#: What a squared distance in single precision may be wrong by.
ERROR = 4e-6
#: What adding up moves in single precision may make the bounds wrong by.
SLACK = 2e-5


# --- blocks ----------------------------------------------------------------------------


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        b = b.filter(b.column(2).is_valid())
        if not b.num_rows:
            continue
        v = b.column(2)
        dim = len(v[0])
        if set(v.value_lengths().unique().to_pylist()) != {dim}:
            raise ValueError("vectors of different lengths")
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        x = np.concatenate([(p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300)).astype(np.float32) for p in (x[lo : lo + ROWS].astype(float) for lo in range(0, len(x), ROWS))])
        if not np.isfinite(x).all():
            raise ValueError("vectors must have finite numbers")
        h = np.ascontiguousarray(b.column(1).to_numpy())
        at = [*range(0, len(x), BLOCK), len(x)]
        cells = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at, pa.int32()), b.column(0)), cells(h), cells(x)], names=["ident", "h", "x"])


def _numbers(column: pa.Array, kind) -> np.ndarray:
    """The bytes of all cells as one array of numbers, without a copy."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], kind, (ends[-1] - ends[0]) // np.dtype(kind).itemsize, int(ends[0]))


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) from each row's hash; the same on any cluster."""
    with np.errstate(over="ignore"):
        z = h.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


@contextmanager
def _sent(spark, value):
    shared = spark.sparkContext.broadcast(value)
    try:
        yield shared
    finally:
        shared.destroy()


def _nearness(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Product with each centre less half its squared length: largest for the nearest."""
    s = x @ centres.T
    s -= 0.5 * np.einsum("kd,kd->k", centres, centres)
    return s


# --- first centres ---------------------------------------------------------------------


def _begin(batches: Iterator[pa.RecordBatch], dim: int, salts: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Each run's row of the least number, and (at run -1) the sum of the vectors and of their squares."""
    total, least = np.zeros(dim + 1), {}
    for b in batches:
        h, x = _numbers(b.column(0), np.int64), _numbers(b.column(1), np.float32).reshape(-1, dim)
        total += np.r_[x.sum(0, dtype=float), np.einsum("nd,nd->", x, x, dtype=float)]
        for run, salt in enumerate(salts):
            u = _uniform(h, salt)
            i = int(u.argmin())
            least[run] = min(least.get(run, (2.0, b"")), (float(u[i]), x[i].tobytes()))
    rows = [(-1, 0.0, total.tobytes()), *((r, u, v) for r, (u, v) in least.items())]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.binary()))], names=["run", "number", "v"])


def _gather(batches: Iterator[pa.RecordBatch], dim: int, shared, what: str) -> Iterator[pa.RecordBatch]:
    """Per run: what="cost", the sum of squared distances to its centres; "draw", rows drawn in proportion to them; "weigh", the rows nearest to each centre."""
    runs = shared.value  # (centres, expected draws for each unit of cost, salt)
    sums = [np.zeros(len(c) if what == "weigh" else 1) for c, _, _ in runs]
    drawn: list[tuple[int, float, bytes]] = []
    for b in batches:
        h, x = _numbers(b.column(0), np.int64), _numbers(b.column(1), np.float32).reshape(-1, dim)
        for run, (centres, rate, salt) in enumerate(runs):
            for lo in range(0, len(x), ROWS):
                part = x[lo : lo + ROWS]
                s = _nearness(part, centres)
                if what == "weigh":
                    sums[run] += np.bincount(s.argmax(1), minlength=len(centres))
                    continue
                d = np.maximum(np.einsum("nd,nd->n", part, part) - 2 * s.max(1), 0).astype(float)
                sums[run] += d.sum()
                if what == "draw":
                    u = _uniform(h[lo : lo + ROWS], salt)
                    drawn += [(run, float(u[i]), part[i].tobytes()) for i in np.flatnonzero(u < rate * d)]
    rows = drawn if what == "draw" else [(run, 0.0, s.tobytes()) for run, s in enumerate(sums)]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.binary()))], names=["run", "number", "v"])


def _chosen(points: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most ``k`` centres of weighted candidates: k-means++, then Lloyd's steps."""
    rng = np.random.default_rng(seed)
    pick, gap = [], np.full(len(points), np.inf)
    while len(pick) < k:
        p = weight * (1 if not pick else gap)
        if p.sum() <= 0:
            break
        pick.append(int(rng.choice(len(points), p=p / p.sum())))
        gap = np.minimum(gap, ((points - points[pick[-1]]) ** 2).sum(1))
    centres = points[pick]
    for _ in range(30):
        label = _nearness(points, centres).argmax(1)
        mass = np.bincount(label, weight, len(centres))
        new = np.array([np.bincount(label, weight * x, len(centres)) for x in points.T]).T
        new = np.where(mass[:, None] > 0, new / np.maximum(mass, 1e-300)[:, None], centres)
        if np.array_equal(new, centres):
            break
        centres = new
    return centres


def _first_centres(blocks: DataFrame, dim: int, n: int, ks: Sequence[int], seeds: Sequence[int]) -> tuple[list[np.ndarray], float]:
    """Each run's first centres by k-means||, all of them drawn and weighed over all vectors, and the mean variance."""
    spark, schema = blocks.sparkSession, "run int, number double, v binary"
    salts = [s * 1_000 for s in seeds]
    hx = blocks.select("h", "x")
    rows = sorted(hx.mapInArrow(lambda it: _begin(it, dim, salts), schema).collect())
    total = sum(np.frombuffer(r.v) for r in rows if r.run < 0)
    variance = float(total[-1] / n - ((total[:-1] / n) ** 2).sum()) / dim
    have = [np.frombuffer(next(r.v for r in rows if r.run == i), np.float32)[None] for i in range(len(ks))]

    def over(what: str, rates: Sequence[float], turn: int) -> list[list]:
        with _sent(spark, [(c, rate, salt + turn) for c, rate, salt in zip(have, rates, salts)]) as shared:
            out = sorted(hx.mapInArrow(lambda it: _gather(it, dim, shared, what), schema).collect())
        return [[r.v for r in out if r.run == i] for i in range(len(ks))]

    nothing = [0.0] * len(ks)
    for turn in range(1, ROUNDS + 1):
        cost = [sum(float(np.frombuffer(v)[0]) for v in own) for own in over("cost", nothing, 0)]
        drawn = over("draw", [OVERSAMPLE * k / c if c > 0 else 0.0 for k, c in zip(ks, cost)], turn)
        have = [np.unique(np.vstack([c, *(np.frombuffer(v, np.float32)[None] for v in own)]), axis=0) for c, own in zip(have, drawn)]
    weights = [sum(np.frombuffer(v) for v in own) for own in over("weigh", nothing, 0)]
    return [_chosen(c.astype(float), w, k, s) for c, w, k, s in zip(have, weights, ks, seeds)], variance


# --- steps -----------------------------------------------------------------------------


class _State:
    """What a partition's rows had in the step before: each run's sums, and per row the centre, a bound on its distance from
    above and one on that to any other from below. A file of the node that saves work and nothing else: who doesn't find
    the last step's computes all distances. A task takes it by renaming, so no two change it."""

    def __init__(self, folder: str, part: int, step: int, ks: Sequence[int], dim: int):
        os.makedirs(folder, exist_ok=True)
        self.ks, self.dim = ks, dim
        self.next = os.path.join(folder, f"{part}-{step}")
        self.mine = f"{self.next}-{uuid.uuid4().hex}"
        try:
            os.rename(os.path.join(folder, f"{part}-{step - 1}"), self.mine)
            self._map("r+", (os.path.getsize(self.mine) - 8 * sum(ks) * (dim + 1)) // (4 + 10 * len(ks)))
        except OSError:
            self.rows = None

    def _map(self, mode: str, n: int) -> None:
        self.n, at = n, 0

        def array(kind: str, *shape: int) -> np.ndarray:
            nonlocal at
            a = raw[at : at + int(np.prod(shape)) * np.dtype(kind).itemsize].view(kind).reshape(shape)
            at += a.nbytes
            return a

        raw = np.asarray(np.memmap(self.mine, np.uint8, mode, shape=(8 * sum(self.ks) * (self.dim + 1) + n * (4 + 10 * len(self.ks)),)))
        self.sums = [array("f8", k, self.dim + 1) for k in self.ks]
        self.key = array("f4", n)
        self.rows = [(array("f4", n), array("f4", n)) for _ in self.ks]
        self.labels = [array("u2", n) for _ in self.ks]

    def fresh(self, n: int) -> None:
        self._map("w+", n)

    def keep(self) -> None:
        os.replace(self.mine, self.next)


def _add(sums: np.ndarray, x: np.ndarray, label: np.ndarray, sign: int = 1) -> None:
    order = np.argsort(label, kind="stable")
    own = label[order]
    at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    sums[own[at], :-1] += sign * np.add.reduceat(x[order], at, axis=0, dtype=np.float64)
    sums[own[at], -1] += sign * np.diff(np.r_[at, len(own)])


def _settle(x: np.ndarray, rows: np.ndarray | None, centres: np.ndarray, sums: np.ndarray, label: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
    """Nearest centre and bounds of ``rows`` (None: of all, which had no centre before); the sums follow."""
    for lo in range(0, len(x) if rows is None else len(rows), ROWS):
        at = slice(lo, min(lo + ROWS, len(x))) if rows is None else rows[lo : lo + ROWS]
        part = x[at]
        s, here = _nearness(part, centres), np.arange(len(part))
        new = s.argmax(1)
        square = np.einsum("nd,nd->n", part, part)
        high[at] = np.sqrt(np.maximum(square - 2 * s[here, new], 0) + ERROR)
        s[here, new] = -np.inf
        low[at] = np.sqrt(np.maximum(square - 2 * s.max(1) - ERROR, 0)) if len(centres) > 1 else np.inf
        if rows is None:
            _add(sums, part, new)
        elif len(moved := np.flatnonzero(new != label[at])):
            _add(sums, part[moved], label[at][moved], -1)
            _add(sums, part[moved], new[moved])
        label[at] = new


def _step(batches: Iterator[pa.RecordBatch], dim: int, shared) -> Iterator[pa.RecordBatch]:
    """(run, sums) of the partition: each centre's sum of vectors and their number, in single precision as the distances, so that the driver takes in half as much."""
    folder, step, ks, active = shared.value  # active: run -> (centres, how far each has moved)
    state = _State(folder, TaskContext.get().partitionId(), step, ks, dim)
    if state.rows is None:
        held, sums = [], {r: np.zeros((ks[r], dim + 1)) for r in active}
        for b in batches:
            x = _numbers(b.column(0), np.float32).reshape(-1, dim)
            own = {r: (np.zeros(len(x), np.uint16), np.zeros(len(x), np.float32), np.zeros(len(x), np.float32)) for r in active}
            for r, (centres, _) in active.items():
                _settle(x, None, centres, sums[r], *own[r])
            held.append((x[:, 0].copy(), own))
        state.fresh(sum(len(key) for key, _ in held))
        lo = 0
        for key, own in held:
            at = slice(lo, lo := lo + len(key))
            state.key[at] = key
            for r, (label, high, low) in own.items():
                state.labels[r][at], state.rows[r][0][at], state.rows[r][1][at] = label, high, low
        for r in active:
            state.sums[r][:] = sums[r]
    else:
        lo = 0
        for b in batches:
            x = _numbers(b.column(0), np.float32).reshape(-1, dim)
            at = slice(lo, lo := lo + len(x))
            if not np.array_equal(state.key[at], x[:, 0]):
                raise RuntimeError("the partition's rows have changed")  # the task's next attempt finds no state
            for r, (centres, moved) in active.items():
                label, high, low = state.labels[r][at], state.rows[r][0][at], state.rows[r][1][at]
                far = int(moved.argmax())
                other = np.full(len(moved), moved[far])
                other[far] = np.delete(moved, far).max(initial=0.0)
                high += moved.astype(np.float32)[label]
                low -= other.astype(np.float32)[label]
                _settle(x, np.flatnonzero(high + SLACK >= low), centres, state.sums[r], label, high, low)
        if lo != state.n:
            raise RuntimeError("the partition's rows have changed")
    out = pa.RecordBatch.from_arrays([pa.array(list(active), pa.int32()), pa.array([state.sums[r].astype(np.float32).tobytes() for r in active], pa.binary())], names=["run", "sums"])
    state.keep()
    yield out


def _label(batches: Iterator[pa.RecordBatch], dim: int, shared, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = _numbers(b.column(1), np.float32).reshape(-1, dim)
        best = [np.concatenate([np.round(_nearness(x[lo : lo + ROWS].astype(float), c), 12).argmax(1) for lo in range(0, len(x), ROWS)]) for c in shared.value]
        yield pa.RecordBatch.from_arrays([b.column(0).flatten(), *(pa.array(a.astype(np.int32)) for a in best)], names=list(names))


def best_of(df: DataFrame, ident: str, vector: str, ks: Sequence[int], *, seed: int = 42, starts: int = 10, max_iter: int = 300, tolerance: float = TOLERANCE) -> dict[int, tuple[DataFrame, np.ndarray]]:
    """k -> (assignments (ident, cluster_id), centres) of the best of ``starts`` runs on normalised vectors, for every k of ``ks``.

    All runs take each step together, in one pass over the vectors, until their centres rest or ``max_iter`` steps are done.
    Null vectors are left out. With fewer than k distinct vectors there are fewer than k clusters.
    """
    ks = list(dict.fromkeys(ks))
    if min(ks) < 1 or max(ks) > 65_535 or starts < 1:
        raise ValueError("1 to 65,535 clusters and at least one start")
    spark, kind = df.sparkSession, dict(df.dtypes)[ident]
    parts = min(MAX_PARTS, spark.sparkContext.defaultParallelism)
    packed = df.select(F.col(ident).alias("ident"), F.xxhash64(F.col(ident)).alias("h"), F.col(vector).alias("x")).mapInArrow(_pack, f"ident array<{kind}>, h binary, x binary")
    blocks = packed.coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)
    folder = os.path.join(tempfile.gettempdir(), f"themeweave-kmeans-{uuid.uuid4().hex}")
    try:
        size = blocks.agg(F.sum(F.length("h")).alias("n"), F.min(F.length("x") / F.length("h")).alias("low"), F.max(F.length("x") / F.length("h")).alias("high")).first()
        n = (size.n or 0) // 8
        if n < max(ks):
            raise ValueError(f"fewer than {max(ks)} vectors")
        if size.low != size.high:
            raise ValueError("vectors of different lengths")
        dim = round(size.low * 2)
        runs = [(k, seed + s) for k in ks for s in range(starts)]
        centres, variance = _first_centres(blocks, dim, n, [k for k, _ in runs], [s for _, s in runs])
        found = [len(c) for c in centres]
        moved = [np.zeros(k) for k in found]
        active, x = list(range(len(runs))), blocks.select("x")
        for step in range(max_iter):
            with _sent(spark, (folder, step, found, {r: (centres[r].astype(np.float32), moved[r]) for r in active})) as shared:
                rows = x.mapInArrow(lambda it, m=shared: _step(it, dim, m), "run int, sums binary").collect()  # one a run and partition
            for r in list(active):
                sums = sum(np.frombuffer(row.sums, np.float32).reshape(found[r], dim + 1).astype(float) for row in rows if row.run == r)
                new = np.where(sums[:, -1:] > 0.5, sums[:, :-1] / np.maximum(sums[:, -1:], 1), centres[r])
                moved[r] = np.sqrt(((new.astype(np.float32).astype(float) - centres[r].astype(np.float32)) ** 2).sum(1))
                if ((new - centres[r]) ** 2).sum() <= tolerance * variance:
                    active.remove(r)
                centres[r] = new
            if not active:
                break
        with _sent(spark, [(c.astype(np.float32), 0.0, 0) for c in centres]) as shared:
            rows = blocks.select("h", "x").mapInArrow(lambda it: _gather(it, dim, shared, "cost"), "run int, number double, v binary").collect()
        cost = [sum(float(np.frombuffer(row.v)[0]) for row in rows if row.run == r) for r in range(len(runs))]
        best = {k: centres[min((cost[r], r) for r, (own, _) in enumerate(runs) if own == k)[1]] for k in ks}
        names = ["ident", *(f"c{k}" for k in ks)]
        with _sent(spark, list(best.values())) as shared:
            labels = cut(blocks.select("ident", "x").mapInArrow(lambda it: _label(it, dim, shared, names), ", ".join([f"ident {kind}", *(f"{c} int" for c in names[1:])])))
    finally:
        blocks.unpersist()
        shutil.rmtree(folder, ignore_errors=True)  # on other nodes it goes with their temporary files
    return {k: (labels.select(F.col("ident").alias(ident), F.col(f"c{k}").alias("cluster_id")), c) for k, c in best.items()}
