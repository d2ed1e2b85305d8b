"""Problem 3: the most similar vectors of every vector by a hash-prefix forest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from themeweave.session import broadcast_if_small, cut

#: Fewest and most trees; the more a floor and the number of vectors call for, the more are grown (``trees_for``).
TREES = 12
MAX_TREES = 40
#: Cost of a row of a tree, in comparisons of two vectors.
ROW_COST = 400
#: Bits of a hash string; with so many, prefixes of any useful length can be told apart.
BITS = 60
#: Vectors of a leaf cell of a tree, and the most cells the directory is planned for (larger collections get larger cells).
CELL = 256
MAX_CELLS = 100_000
#: Vectors of a node that are compared whole where a floor says that no shorter prefix is needed; larger ones are cut into cells.
NODE_ROWS = 8_192
#: Rows of a range of the sorted arrays, rows of the sample that its borders come from, and vectors packed at a time.
RANGE_ROWS = 250_000
BORDER_SAMPLE = 20_000
PACK_ROWS = 16_384
#: Chance, by the angle of a vector's k-th nearest, that a neighbour of that nearness is met in some tree.
RECALL = 0.995
#: Vectors of the root that are compared together; a collection of at most ``ROOT_ROWS`` is compared whole.
ROOT_BLOCK = 65_536
ROOT_ROWS = 4_096
#: (vector, cell) visits made up at a time.
VISITS = 200_000
SEED = 20_040_517
#: Rounding of the one-byte vectors that are searched; candidates this far below a bound are still verified, and so many more are kept.
SLACK = 0.004
SPARE = 6
MAX_BROADCAST = 100_000


def usable_vectors(df: DataFrame, ident: str, vector: str, dim: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, ident, vec) of rows with a non-null identifier and a finite, non-zero vector of ``dim`` numbers."""
    v = F.col("vec")
    rows = df.select(*keep, F.col(ident).alias("ident"), F.col(vector).cast("array<float>").alias("vec")).filter(F.col("ident").isNotNull() & v.isNotNull() & (F.size(v) == dim))
    top, low = F.array_max(v), F.array_min(v)  # NaN counts as the largest number
    return rows.filter(((top > 0) | (low < 0)) & ~F.isnan(top) & (top < float("inf")) & (low > float("-inf"))).filter(~F.exists(v, lambda x: x.isNull()))


def distinct_vectors(usable: DataFrame, track: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(reps, copies): one row ([track], ident, vec, asked) per distinct vector [of a track], named by its smallest
    identifier and asked if any holder is, and (rep, ident, asked) of every identifier whose vector others hold too.
    Without a column ``asked`` every row is. Repeated rows vanish here."""
    by = [track] if track else []
    flagged = usable if "asked" in usable.columns else usable.withColumn("asked", F.lit(True))
    keyed = flagged.select(*by, "ident", "vec", "asked", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec").alias("h2"))
    groups = cut(keyed.groupBy(*by, "h1", "h2").agg(F.min("ident").alias("rep"), F.max("ident").alias("last"), F.first("vec").alias("vec"), F.max("asked").alias("asked")))
    several = groups.filter("rep <> last").select(*by, "h1", "h2", "rep")
    copies = cut(keyed.select(*by, "ident", "asked", "h1", "h2").join(broadcast_if_small(several, MAX_BROADCAST), [*by, "h1", "h2"]).groupBy("rep", "ident").agg(F.max("asked").alias("asked")))
    return groups.select(*by, F.col("rep").alias("ident"), "vec", "asked"), copies


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list<float> column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def planes(dim: int, trees: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, trees * bits), dtype=np.float32)


def prefixes(units: np.ndarray, normals: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """The hash strings of each vector, one per tree, as sortable integers."""
    signs = np.zeros((len(units), trees, 64), bool)
    signs[:, :, 64 - bits :] = (units @ normals > 0).reshape(len(units), trees, bits)
    return np.packbits(signs, axis=2).view(">i8").astype(np.int64)[:, :, 0]


def codes_of(units: np.ndarray) -> np.ndarray:
    """One byte per number; the length is restored on reading."""
    return np.rint(units * (127 / np.abs(units).max(axis=1, keepdims=True))).astype(np.int8)


def from_codes(raw: bytes, dim: int) -> np.ndarray:
    u = np.frombuffer(raw, np.int8).reshape(-1, dim).astype(np.float32)
    return u / np.linalg.norm(u, axis=1, keepdims=True)


def _keys(batches: Iterator[pa.RecordBatch], dim: int, trees: int, seed: int) -> Iterator[pa.RecordBatch]:
    normals = planes(dim, trees, BITS, seed)
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(prefixes(unit(matrix(b.column(0), dim)), normals, trees, BITS)))], names=["keys"])


def borders_of(sample: np.ndarray, ranges: int, depth: int) -> list[np.ndarray]:
    """Per tree, at most ``ranges`` - 1 strings at which its array is divided: between nodes of the given prefix length, inside one only where it fills ranges of its own."""
    out = []
    for keys in np.sort(sample, axis=0).T:
        at = keys[(np.arange(1, ranges) * len(keys)) // ranges] if len(keys) else keys
        node = (at >> (BITS - depth)) << (BITS - depth)
        several = np.isin(node, node[1:][np.diff(node) == 0])
        out.append(np.sort(np.r_[np.unique(node), at[several]]))
    return out


RANGE_ROWS_OUT = "part int, keys binary, ids binary, codes binary, asked binary"
_RANGE_SCHEMA = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("codes", pa.binary()), ("asked", pa.binary())])


def _spread(batches: Iterator[pa.RecordBatch], dim: int, trees: int, seed: int, borders: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of every tree's array, packed by the range that they belong to."""
    normals = planes(dim, trees, BITS, seed)
    base = np.cumsum([0, *(len(x) + 1 for x in borders)])

    def packed(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, ids, codes, asked = (np.concatenate(x) for x in zip(*parts))
        for t in range(trees):
            lo, hi = (np.searchsorted(borders[t], keys[:, t], side) for side in ("left", "right"))
            part = lo + (ids * 0x9E3779B1 >> 16) % (hi - lo + 1) if (hi - lo > 1).any() else hi  # one string that fills several ranges
            order = np.argsort(part, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(order)]
            rows = [(int(base[t] + part[order[a]]), *(x[order[a:z]].tobytes() for x in (keys[:, t], ids, codes, asked))) for a, z in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RANGE_SCHEMA)], schema=_RANGE_SCHEMA)

    held: list[tuple] = []
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            part = b.slice(lo, 2000)
            u = unit(matrix(part.column(1), dim))
            held.append((prefixes(u, normals, trees, BITS), part.column(0).to_numpy(), codes_of(u), part.column(2).to_numpy(zero_copy_only=False).astype(bool)))
            if sum(len(x[1]) for x in held) >= PACK_ROWS:
                yield from packed(held)
                held = []
    if held:
        yield from packed(held)


def trie_cells(keys: np.ndarray, size: int, bits: int = BITS) -> list[tuple[int, int]]:
    """Ranges of the sorted ``keys`` with at most ``size`` rows each, cut where the shortest prefixes differ."""
    out, todo = [], [(0, len(keys), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo <= size:
            if hi > lo:
                out.append((lo, hi))
        elif depth == bits:  # one whole string: cut anywhere
            out += [(a, min(a + size, hi)) for a in range(lo, hi, size)]
        else:
            shift = bits - depth - 1
            border = ((int(keys[lo]) >> (shift + 1)) << (shift + 1)) | (1 << shift)
            mid = lo + int(np.searchsorted(keys[lo:hi], border))
            todo += [(mid, hi, depth + 1), (lo, mid, depth + 1)]
    return sorted(out)


def _best(sims: np.ndarray, bound: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the at most ``most`` largest entries of each row that reach the row's bound."""
    hit = sims >= bound[:, None]
    many = np.flatnonzero(hit.sum(axis=1) > most)
    if len(many):
        near = np.argpartition(sims[many], -most, axis=1)[:, -most:]
        hit[many] = False
        hit[many[:, None], near] = True
    return np.nonzero(hit)


CELL_ROWS = "cell long, tree int, first long, last long, n int, open boolean, ids binary, codes binary, own binary, other binary, cosine binary"
_CELL_SCHEMA = pa.schema([("cell", pa.int64()), ("tree", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int32()), ("open", pa.bool_()), ("ids", pa.binary()), ("codes", pa.binary()), ("own", pa.binary()), ("other", pa.binary()), ("cosine", pa.binary())])


def _within(raw: bytes, ask: np.ndarray, dim: int, bound: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, cosine) of the at most ``most`` nearest of each asked row among the codes ``raw``."""
    u, found = from_codes(raw, dim), []
    for lo in range(0, len(ask), 512):
        some = ask[lo : lo + 512]
        sims = u[some] @ u.T
        sims[np.arange(len(some)), some] = -2
        at = np.flatnonzero(sims.ravel() >= bound)
        r = at // len(u)
        if len(at) and np.bincount(r).max() > most:
            r, c = _best(sims, np.full(len(some), bound, np.float32), most)
        else:
            c = at - r * len(u)
        found.append((some[r], c, sims[r, c]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _grow(batches: Iterator[pa.RecordBatch], dim: int, size: int, most: int, floor: float, depth: int, node_rows: int, borders: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Descent in a range of the sorted arrays: the nearest that its asked vectors find in their node of the prefix length
    ``depth``, or where that is too large or goes on in another range, in their cell; such cells stay open for the ascent.
    Of the first tree all rows are kept in cells, as the root."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts)
    base = np.cumsum([0, *(len(x) + 1 for x in borders)])
    at = TaskContext.get().partitionId() << 32
    numbers = rows.column("part").to_numpy()
    for part in np.unique(numbers).tolist():
        own = rows.take(pa.array(np.flatnonzero(numbers == part)))
        keys, ids, codes, asked = (np.frombuffer(b"".join(own.column(c).to_pylist()), t) for c, t in (("keys", np.int64), ("ids", np.int64), ("codes", np.int8), ("asked", bool)))
        order = np.lexsort((ids, keys))
        keys, ids, codes, asked = keys[order], ids[order], codes.reshape(-1, dim)[order], asked[order]
        tree = int(np.searchsorted(base, part, side="right")) - 1
        border, place, shift = borders[tree], part - base[tree], BITS - depth
        node = keys >> shift
        split = [int(border[i]) >> shift for i in (place - 1, place) if 0 <= i < len(border) and (int(border[i]) >> shift) << shift != border[i] or 0 < i < len(border) and border[i] == border[i - 1]]
        cuts = [0, *(np.flatnonzero(np.diff(node)) + 1).tolist(), len(keys)]
        pairs = []
        for lo, hi in zip(cuts, cuts[1:]):
            whole = depth > 0 and hi - lo <= node_rows and int(node[lo]) not in split
            if whole and hi - lo > 1 and asked[lo:hi].any():
                r, c, cos = _within(codes[lo:hi].tobytes(), np.flatnonzero(asked[lo:hi]), dim, floor, most)
                pairs.append((ids[lo:hi][r], ids[lo:hi][c], cos))
            if whole and tree > 0:
                continue
            for a, z in trie_cells(keys[lo:hi], size):
                a, z = a + lo, z + lo
                raw, mine, other, near = codes[a:z].tobytes(), *(np.empty(0, t) for t in (np.int64, np.int64, np.float32))
                ask = np.flatnonzero(asked[a:z])
                if not whole and len(ask) and z - a > 1:
                    r, c, near = _within(raw, ask, dim, max(floor, -1.5), most)
                    mine, other = ids[a:z][r], ids[a:z][c]
                at += 1
                yield pa.RecordBatch.from_pylist([{"cell": at, "tree": tree, "first": int(keys[a]), "last": int(keys[z - 1]), "n": z - a, "open": not whole, "ids": ids[a:z].tobytes(), "codes": raw, "own": mine.tobytes(), "other": other.tobytes(), "cosine": near.astype(np.float32).tobytes()}], schema=_CELL_SCHEMA)
        if pairs:
            mine, other, near = (np.concatenate(x) for x in zip(*pairs))
            for lo in range(0, len(mine), 100_000):
                some = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_pylist([{"n": 0, "open": False, "own": mine[some].tobytes(), "other": other[some].tobytes(), "cosine": near[some].astype(np.float32).tobytes()}], schema=_CELL_SCHEMA)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own, other, cos = (np.frombuffer(b"".join(b.column(c).to_pylist()), t) for c, t in (("own", np.int64), ("other", np.int64), ("cosine", np.float32)))
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(other), pa.array(-cos.astype(np.float64))], names=["ident", "other", "far"])


class Directory:
    """First and last string, size and number of every open cell, by tree."""

    def __init__(self, rows: list, trees: int, total: int):
        self.total = total
        self.trees = []
        of: list[list] = [[] for _ in range(trees)]
        for r in rows:
            of[r.tree].append((r.first, r.last, r.cell, r.n, r.open))
        for t in range(trees):
            own = sorted(x[:4] for x in of[t] if x[4])
            first, last, cell, n = (np.array(x, np.int64) for x in zip(*own)) if own else (np.empty(0, np.int64),) * 4
            self.trees.append((first, last, cell, np.concatenate([[0], np.cumsum(n)])))
        # the root is read from all of the first tree's cells, in blocks
        every = sorted(x[:4] for x in of[0])
        self.root = np.array([x[2] for x in every], np.int64)
        self.block = np.concatenate([[0], np.cumsum([x[3] for x in every])]).astype(np.int64)[:-1] // ROOT_BLOCK
        self.blocks = int(self.block[-1]) + 1 if len(self.block) else 0

    def node(self, tree: int, keys: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Range of the cells that meet each key's prefix of the given length, and their number of vectors."""
        first, last, _, size = self.trees[tree]
        shift = BITS - depth
        low = (keys >> shift) << shift
        a, z = np.searchsorted(last, low), np.searchsorted(first, low + (np.int64(1) << shift) - 1, side="right")
        return a, z, size[z] - size[a]


def depth_for(cosine: np.ndarray, trees: int, recall: float) -> np.ndarray:
    """Longest prefix at which a neighbour of the given cosine still shares a node in some tree with the wanted chance."""
    same = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    with np.errstate(divide="ignore"):
        depth = np.log(1 - (1 - recall) ** (1 / trees)) / np.log(np.clip(same, 1e-12, 1 - 1e-9))
    return np.clip(np.floor(depth), 0, BITS).astype(np.int64)


def trees_for(total: int, floor: float, recall: float, least: int = TREES) -> int:
    """Number of trees at which filling them and comparing each vector with its nodes costs least: with more trees the floor
    asks for longer prefixes only, so that a node needn't grow with the number of vectors."""
    if floor <= 0 or total <= ROOT_ROWS:
        return least
    cost = lambda t: t * (ROW_COST + total / 2.0 ** int(depth_for(np.array([floor - SLACK]), t, recall)[0]))
    return min(range(least, max(least, MAX_TREES) + 1), key=cost)


VISIT_ROWS = "bucket long, kind int, ids binary, codes binary, bound binary"
_VISIT_SCHEMA = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("ids", pa.binary()), ("codes", pa.binary()), ("bound", pa.binary())])


def _visits(batches: Iterator[pa.RecordBatch], dim: int, trees: int, seed: int, recall: float, shared) -> Iterator[pa.RecordBatch]:
    """Ascends all trees together: each vector's visits to the cells of its nodes at the depth that its k-th nearest demands."""
    normals, where = planes(dim, trees, BITS, seed), shared.value
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            part = b.slice(lo, 2000)
            ids, kth = part.column(0).to_numpy(), part.column(2).to_numpy().astype(np.float32)
            u = unit(matrix(part.column(1), dim))
            keys, codes = prefixes(u, normals, trees, BITS), codes_of(u)
            depth = depth_for(kth, trees, recall)
            ranges = [where.node(t, keys[:, t], depth) for t in range(trees)]
            root = (sum(n for _, _, n in ranges) >= where.total) | (where.total <= ROOT_ROWS)
            for g in range(where.blocks if root.any() else 0):
                yield _visit(-1 - g, ids[root], codes[root], kth[root])
            whom, cell = [], []
            for t, (a, z, _) in enumerate(ranges):
                # the own cell has been searched, if it is plain which one it is
                ones, onez, _ = where.node(t, keys[:, t], np.full(len(ids), BITS))
                known = onez - ones == 1
                n = np.where(root, 0, z - a)
                q = np.repeat(np.arange(len(ids)), n)
                c = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
                new = ~(known[q] & (c == ones[q]))
                whom.append(q[new])
                cell.append(where.trees[t][2][c[new]])
            q, c = np.concatenate(whom), np.concatenate(cell)
            for k in range(0, len(q), VISITS):
                order = np.argsort(c[k : k + VISITS], kind="stable") + k
                ends = [*(np.flatnonzero(np.diff(c[order])) + 1).tolist(), len(order)]
                start = 0
                for end in ends:
                    who = q[order[start:end]]
                    yield _visit(int(c[order[start]]), ids[who], codes[who], kth[who])
                    start = end


def _visit(bucket: int, ids: np.ndarray, codes: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((bucket, 1, ids.astype(np.int64).tobytes(), codes.tobytes(), bound.astype(np.float32).tobytes()), _VISIT_SCHEMA.types)], schema=_VISIT_SCHEMA)


def _buckets(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Cells as what is visited: under their own number, those of the first tree also under their block of the root."""
    where = shared.value
    block = dict(zip(where.root.tolist(), where.block.tolist()))
    for b in batches:
        cells = b.column("cell").to_pylist()
        roots = [(i, -1 - block[c]) for i, c in enumerate(cells) if c in block]
        take = pa.array([*range(len(cells)), *(i for i, _ in roots)], pa.int64())
        n = len(take)
        yield pa.RecordBatch.from_arrays([pa.array([*cells, *(g for _, g in roots)], pa.int64()), pa.array([0] * n, pa.int32()), b.column("ids").take(take), b.column("codes").take(take), pa.array([b""] * n, pa.binary())], schema=_VISIT_SCHEMA)


def _compare(batches: Iterator[pa.RecordBatch], dim: int, most: int) -> Iterator[pa.RecordBatch]:
    """Visitors against the vectors of their bucket; rows come sorted by bucket, the bucket's own vectors first."""
    now, ids, parts = None, [], []
    for b in batches:
        for bucket, kind, raw_ids, raw, bound in zip(*(b.column(c).to_pylist() for c in range(5))):
            if bucket != now:
                now, ids, parts = bucket, [], []
            if kind == 0:
                ids.append(np.frombuffer(raw_ids, np.int64))
                parts.append(from_codes(raw, dim))
                continue
            if len(ids) > 1:
                ids, parts = [np.concatenate(ids)], [np.concatenate(parts)]
            if not ids:
                continue
            who, q, low = np.frombuffer(raw_ids, np.int64), from_codes(raw, dim), np.frombuffer(bound, np.float32) - np.float32(SLACK)
            for r in range(0, len(who), 1024):
                for c in range(0, len(ids[0]), 8192):
                    sims = q[r : r + 1024] @ parts[0][c : c + 8192].T
                    x, y = _best(sims, low[r : r + 1024], most)
                    own, other = who[r + x], ids[0][c + y]
                    keep = own != other
                    if keep.any():
                        yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(other[keep]), pa.array(-sims[x, y][keep].astype(np.float64))], names=["ident", "other", "far"])


def _nearest_of(found: DataFrame, most: int) -> DataFrame:
    """(ident, near): the ``most`` nearest of (ident, other, far), each other once."""
    return found.groupBy("ident").agg(F.slice(F.sort_array(F.collect_set(F.struct(F.round("far", 5).alias("far"), "other"))), 1, 2 * most).alias("near"))


def forest_lists(reps: DataFrame, dim: int, k: int, *, floor: float = -1.0, trees: int = TREES, cell: int = CELL, node: int = NODE_ROWS, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """(ident, other): the nearest distinct vectors found for each asked one of ``reps`` (ident, vec, asked), somewhat more than ``k``.

    Each tree is one array of all vectors' hash strings in order, cut into ranges over the cluster and there, at
    prefixes of whatever length holds few enough vectors, into cells.

    1. Descent: every asked vector meets those with the longest common prefixes, the others of its cell in each tree.
       The floor gives the shortest prefix that can be needed; a node of that prefix which is not too large is met as a whole at
       once, and its vectors have no more to ascend in that tree.
    2. Synchronous ascent: from the cosine of its k-th nearest so far (or the floor, if that is higher) follows how short
       a prefix must be for a neighbour that near to share it in some tree with the wanted chance; the vector then visits
       all cells under that prefix in all trees, however many vectors a dense prefix holds, across the ranges' borders.
       Where these nodes hold as many vectors as the root, it visits the root instead, one tree's cells in blocks.

    ``trees`` is the fewest; a floor and many vectors call for more (``trees_for``). Only open cells and one tree's are kept.
    The directory of the cells (numbers only) is broadcast; its size is bounded by ``MAX_CELLS`` times a small factor.
    """
    spark, most = reps.sparkSession, k + SPARE
    reps = reps.select(F.col("ident").cast("long").alias("ident"), "vec", "asked")
    total = reps.count()
    trees = trees_for(total, floor, recall, trees)
    depth = int(depth_for(np.array([floor - SLACK]), trees, recall)[0]) if floor > 0 and total > ROOT_ROWS else 0
    size = max(cell, -(-total * trees // MAX_CELLS))
    ranges = max(1, -(-total // RANGE_ROWS), -(-spark.sparkContext.defaultParallelism // trees))
    sample = reps.filter(F.pmod(F.xxhash64("ident", F.lit(seed)), F.lit(1_000_000)) < math.ceil(1e6 * BORDER_SAMPLE / max(total, 1))).select("vec")
    keys = [r["keys"] for r in sample.mapInArrow(lambda it: _keys(it, dim, trees, seed), "keys array<long>").collect()]  # about BORDER_SAMPLE rows
    borders = borders_of(np.array(keys, np.int64).reshape(-1, trees), ranges, depth)
    ways = sum(len(x) + 1 for x in borders)
    spread = reps.mapInArrow(lambda it: _spread(it, dim, trees, seed, borders), RANGE_ROWS_OUT)
    cells = cut(spread.repartitionById(ways, F.col("part")).mapInArrow(lambda it: _grow(it, dim, size, most, floor - SLACK, depth, node, borders), CELL_ROWS))
    inside = cells.filter(F.length("own") > 0).select("own", "other", "cosine").mapInArrow(_listed, "ident long, other long, far double")
    if depth and cells.filter("open").isEmpty():
        return _nearest_of(inside, most).select("ident", F.explode("near").alias("x")).select("ident", F.col("x.other").alias("other")).distinct()
    shared = spark.sparkContext.broadcast(Directory(cells.filter("n > 0").select("tree", "first", "last", "cell", "n", "open").collect(), trees, total))
    first = cut(_nearest_of(inside, most))
    kth = F.greatest(F.coalesce(-F.get("near", F.lit(k - 1))["far"], F.lit(-1.0)), F.lit(floor)).cast("float")
    asking = reps.filter("asked").select("ident", "vec").join(first, "ident", "left").select("ident", "vec", kth.alias("kth"))
    visits = cut(asking.mapInArrow(lambda it: _visits(it, dim, trees, seed, recall, shared), VISIT_ROWS))
    visited = F.broadcast(visits.select("bucket").distinct())  # no more than there are cells and blocks
    data = cells.filter("n > 0").select("cell", "ids", "codes").mapInArrow(lambda it: _buckets(it, shared), VISIT_ROWS).join(visited, "bucket", "left_semi")
    met = data.unionByName(visits).repartition(max(spark.sparkContext.defaultParallelism, -(-total * trees // 200_000)), "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(lambda it: _compare(it, dim, most), "ident long, other long, far double")
    every = met.unionByName(first.select("ident", F.explode("near").alias("x")).select("ident", "x.other", "x.far"))
    return _nearest_of(every, most).select("ident", F.explode("near").alias("x")).select("ident", F.col("x.other").alias("other")).distinct()


def with_copies(lists: DataFrame, reps: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Neighbour lists of distinct vectors as lists of all asked identifiers (ident, place, other, cosine).

    An identifier's nearest are its exact copies (cosine 1) and then the members of the
    neighbouring vectors; of equals the smaller identifiers come first. No more than k + 1 members of a
    vector are ever offered, so a vector held by a third of all rows stays bounded.
    """
    by_rep = Window.partitionBy("rep").orderBy("ident")
    first = cut(copies.withColumn("salt", F.pmod(F.xxhash64("ident"), F.lit(32))).withColumn("r", F.row_number().over(Window.partitionBy("rep", "salt").orderBy("ident"))).filter(F.col("r") <= k + 1).withColumn("r", F.row_number().over(by_rep)).filter(F.col("r") <= k + 1).select("rep", F.col("ident").alias("member")))
    own = first.select(F.col("rep").alias("ident")).distinct().join(reps.filter("asked").select("ident"), "ident", "left_semi").select("ident", F.col("ident").alias("other"), F.lit(1.0).alias("cosine"))
    offered = lists.unionByName(own).join(broadcast_if_small(first, MAX_BROADCAST), F.col("other") == F.col("rep"), "left").select("ident", "cosine", F.coalesce("member", "other").alias("other"))
    ranked = offered.withColumn("r", F.row_number().over(Window.partitionBy("ident").orderBy(F.desc("cosine"), "other"))).filter(F.col("r") <= k + 1).drop("r")
    members = copies.filter("asked AND rep <> ident").select(F.col("rep").alias("of"), F.col("ident").alias("member"))
    more = ranked.join(members, F.col("ident") == F.col("of")).select(F.col("member").alias("ident"), "cosine", "other")
    every = ranked.join(copies.filter("NOT asked").select("ident"), "ident", "left_anti").unionByName(more).filter("ident <> other")
    return every.withColumn("place", F.row_number().over(Window.partitionBy("ident").orderBy(F.desc("cosine"), "other"))).filter(F.col("place") <= k).select("ident", "place", "other", "cosine")


def _cosines(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (matrix(b.column(c), dim).astype(np.float64) for c in ("_a", "_b"))
        dot = lambda p, q: np.einsum("nd,nd->n", p, q)
        yield pa.RecordBatch.from_arrays([b.column("ident"), b.column("other"), pa.array(dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)))], names=["ident", "other", "cosine"])


def exact_cosine(pairs: DataFrame, reps: DataFrame, dim: int) -> DataFrame:
    """``pairs`` (ident, other) with ``cosine`` computed from the whole vectors in double precision."""
    a = reps.select(F.col("ident"), F.col("vec").alias("_a"))
    b = reps.select(F.col("ident").alias("other"), F.col("vec").alias("_b"))
    kind = dict(pairs.dtypes)["ident"]
    return pairs.join(a, "ident").join(b, "other").select("ident", "other", "_a", "_b").mapInArrow(lambda it: _cosines(it, dim), f"ident {kind}, other {kind}, cosine double")


def nearest_neighbours(df: DataFrame, ident: str, vector: str, dim: int, *, k: int = 10, floor: float = -1.0, queries: str | None = None, trees: int = TREES, cell: int = CELL, node: int = NODE_ROWS, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """(ident, place, other, cosine): for every usable vector its ``k`` most similar others with a cosine of ``floor`` or more.

    ``queries`` is a condition on the columns of ``df`` that chooses the vectors whose lists are wanted; they are always
    compared with all vectors. Approximate: ``recall`` is the chance that a neighbour as near as the k-th is met (nearer
    ones are likelier; see ``forest_lists``). Cosines are exact. Ties go to the smaller identifier.
    Defined cases: null, short, zero, NaN or infinite vectors and null identifiers are left out;
    repeated rows count once; exact copies are each other's neighbours with cosine 1; a vector
    without another usable one has no row; an empty table gives no row; other columns are ignored.
    Identifiers must be integers.
    """
    kind = dict(df.dtypes)[ident]
    asked = F.coalesce(F.expr(queries), F.lit(False)) if queries else F.lit(True)
    rows = df.select(F.col(ident).alias("ident"), F.col(vector).alias("vec"), asked.alias("asked"))
    reps, copies = distinct_vectors(usable_vectors(rows, "ident", "vec", dim, ("asked",)))
    lists = forest_lists(reps, dim, k, floor=floor, trees=trees, cell=cell, node=node, recall=recall, seed=seed)
    typed = lists.select(F.col("ident").cast(kind).alias("ident"), F.col("other").cast(kind).alias("other"))
    exact = exact_cosine(typed, reps, dim).filter(F.col("cosine") >= floor)
    return with_copies(exact.select("ident", "other", "cosine"), reps, copies, k)
