"""Most similar vectors for every vector (problem 3): cross-polytope hashing and exact reranking."""

from __future__ import annotations

import math
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.tables import cut, ensure_checkpoint_dir

#: Coarse hashing, which says in what buckets a query looks: tables, axes of the rotated space, probes of a query. Two for each axis, so 4 buckets a table.
TABLES, AXES, PROBES = 4, 2, 2
#: Fine hashing, which says what rows of a bucket are compared: tables of rotations of its own for every bucket's table, all axes, probes of a query.
FINE, FINE_PROBES = 6, 2
#: A bucket of so few rows is compared whole.
LEAST = 256
#: Rows of a stored block and queries that a task holds at once; every block of queries meets every block of rows.
BLOCK = 65_536
#: Ids (8 bytes each) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Queries of a block searched at once, similarities computed at once, and candidates compared exactly at once: what a task holds beside its block.
QUERIES, CELLS, PAIRS = 8_192, 2_000_000, 100_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (length a power of two), scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        pair = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


@cache
def rotations(dims: int, first: int, count: int, axes: int) -> np.ndarray:
    """Pseudo-rotations number `first` and on, side by side: three rounds of random signs and a Hadamard transform.

    The transform is applied to the unit vectors once; a batch is then rotated by one product.
    """
    size = 1 << max(0, dims - 1).bit_length()
    out = []
    for seed in range(first, first + count):
        signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, size))
        x = np.eye(dims, size)
        for s in signs:
            x = hadamard(x * s)
        out.append(x[:, : min(axes, size)])
    return np.hstack(out).astype(np.float32)


def buckets(unit: np.ndarray, first: int, tables: int, axes: int, probes: int) -> np.ndarray:
    """Bucket numbers of each row (rows x tables x probes), the row's own bucket of a table first.

    A hash is the nearest signed axis of the rotated vector; its probes are the next nearest, by
    score: with few axes the opposite side of an axis can be among them.
    """
    n, dims = unit.shape
    axes = min(axes, 1 << max(0, dims - 1).bit_length())
    turned = (unit.astype(np.float32) @ rotations(dims, first, tables, axes)).reshape(n, tables, axes)
    if probes > axes:
        return np.argsort(-np.concatenate([turned, -turned], axis=2), axis=2, kind="stable")[:, :, :probes]
    # Of each axis one side has a positive score: with no more probes than axes the others are never among them.
    score = -np.abs(turned)
    best = score.argmin(axis=2)[:, :, None] if probes == 1 else np.argpartition(score, probes - 1, axis=2)[:, :, :probes]
    best = np.take_along_axis(best, np.argsort(np.take_along_axis(score, best, 2), axis=2, kind="stable"), 2)
    return best + axes * (np.take_along_axis(turned, best, 2) < 0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def nearest_in_block(
    q_id: np.ndarray, q: np.ndarray, x_id: np.ndarray, x: np.ndarray, k: int, table: int = 0, fine: int = 0, probes: int = FINE_PROBES,
    cells: np.ndarray | None = None, asked: np.ndarray | None = None, least: np.ndarray | None = None,
):
    """(query ids, neighbour ids, similarities), one entry for each of the k most similar candidates of each query in a block, by exact double cosine.

    Candidates are the rows in the cells that a query probes in `fine` tables of its own; with
    none of those, every row is one. `cells` (rows x fine) and `asked` (queries x fine x probes)
    are computed where they are not given; candidates below `least` of their query are not wanted.
    """
    x = x[(order := np.argsort(x_id, kind="stable"))]
    x_id, x32 = x_id[order], x.astype(np.float32)
    numbers = range(TABLES + table * fine, TABLES + table * fine + fine)
    if fine and cells is None:
        cells = np.stack([buckets(x32, n, 1, x.shape[1], 1)[:, 0, 0] for n in numbers], axis=1)[np.argsort(order)]
    if fine and asked is None:
        asked = np.stack([buckets(q.astype(np.float32), n, 1, x.shape[1], probes)[:, 0] for n in numbers], axis=1)
    # Rows of each table by their cell, and where each cell begins.
    tables = []
    for f in range(fine):
        cell = cells[order, f]
        by_cell = np.argsort(cell, kind="stable")
        tables.append((by_cell, np.searchsorted(cell[by_cell], np.arange(2 * (1 << max(0, x32.shape[1] - 1).bit_length()) + 1))))
    floor = np.full(len(q), -np.inf) if least is None else least
    parts = [_of_queries(q_id[a : a + QUERIES], q[a : a + QUERIES], x_id, x, x32, tables, k, None if asked is None else asked[a : a + QUERIES], floor[a : a + QUERIES]) for a in range(0, len(q), QUERIES)]
    return tuple(np.concatenate(p) for p in zip(*parts))


def _of_queries(q_id: np.ndarray, q: np.ndarray, x_id: np.ndarray, x: np.ndarray, x32: np.ndarray, tables: list, k: int, probed: np.ndarray | None, least: np.ndarray):
    dims, keep = x.shape[1], min(k + 1, len(x))  # the query itself may be among them
    q32 = q.astype(np.float32)
    # What float32 and the rounding to 6 decimals can hide: no row within it of the keep-th best is left out.
    close = np.float32(2e-6 + 2 * dims * np.finfo(np.float32).eps)
    bound = least.astype(np.float32) - close
    kept = []
    for f, (by_row, row_at) in enumerate(tables or [(np.arange(len(x)), np.array([0, len(x)]))]):
        cell = probed[:, f].ravel() if tables else np.zeros(len(q), dtype=np.int64)
        asker, by_cell = np.repeat(np.arange(len(q)), len(cell) // len(q)), np.argsort(cell, kind="stable")
        ask_at = np.searchsorted(cell[by_cell], np.arange(len(row_at)))
        found = []
        for c in np.flatnonzero((np.diff(row_at) > 0) & (np.diff(ask_at) > 0)):
            rows, asked = by_row[row_at[c] : row_at[c + 1]], asker[by_cell[ask_at[c] : ask_at[c + 1]]]
            step = max(1, CELLS // len(rows))
            found += [_likely(q32, x32, asked[at : at + step], rows, bound, keep, close) for at in range(0, len(asked), step)]
        if found:
            kept.append(_near_best(*map(np.concatenate, zip(*found)), bound, keep, close))
    if not kept:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    row, col, sim = map(np.concatenate, zip(*kept))
    good = sim >= bound[row]
    # A row can be found in several tables.
    pair = np.sort(row[good] * np.int64(len(x)) + col[good])
    row, col = np.divmod(pair[np.diff(pair, prepend=-1) > 0], len(x))
    parts = [np.round(np.einsum("ij,ij->i", q[row[a : a + PAIRS]], x[col[a : a + PAIRS]]), 6) for a in range(0, len(row), PAIRS)]
    exact = np.concatenate([*parts, np.empty(0)])
    other = x_id[col] != q_id[row]
    row, col, exact = row[other], col[other], exact[other]
    order = np.argsort(4.0 * row - exact, kind="stable")  # by row, similarity, and col as before; x_id ascends with col
    row, col, exact = row[order], col[order], exact[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return q_id[row[best]], x_id[col[best]], exact[best]


def _likely(q: np.ndarray, x: np.ndarray, asked: np.ndarray, rows: np.ndarray, bound: np.ndarray, keep: int, close: np.float32) -> np.ndarray:
    """(query, row, similarity) of a cell that can be among the `keep` best of the query; `bound` is below those known so far, and is raised."""
    sims = q[asked] @ x[rows].T
    least = bound[asked]
    if len(rows) >= keep:
        # In wide cells the best of each group of columns give a bound that spares a full selection.
        width = max(1, len(rows) // max(128, 4 * keep))
        groups = sims if width == 1 else sims[:, : len(rows) // width * width].reshape(len(asked), width, -1).max(axis=1)
        least = np.maximum(least, np.partition(groups, -keep, axis=1)[:, -keep] - close)
        bound[asked] = least  # a query asks a cell once
    i, j = np.divmod(np.flatnonzero(sims >= least[:, None]), len(rows))
    return asked[i], rows[j], sims[i, j]


def _near_best(row: np.ndarray, col: np.ndarray, sim: np.ndarray, bound: np.ndarray, keep: int, close: np.float32):
    """The found of one table (no pair twice) that are not too far below the keep-th best of their query; raises the bounds."""
    good = sim >= bound[row]
    row, col, sim = row[good], col[good], sim[good]
    order = np.argsort(4.0 * row - sim)  # by row, then by similarity (within 1)
    row, col, sim = row[order], col[order], sim[order]
    first = np.searchsorted(row, np.arange(len(bound) + 1))
    full = np.flatnonzero(np.diff(first) >= keep)
    bound[full] = np.maximum(bound[full], sim[first[full] + keep - 1] - close)
    good = sim >= bound[row]
    return row[good], col[good], sim[good]


#: Similarities travel as whole numbers of this size: they are rounded to 6 decimals anyway.
_MILLION = 1_000_000


def _cells(unit: np.ndarray, tables: int, axes: int, fine: int, probes: int, fine_probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(coarse: rows x tables x probes, fine: rows x tables x fine x fine probes): buckets, and cells inside the buckets of each table."""
    unit = unit.astype(np.float32)
    found = [buckets(unit, TABLES + n, 1, unit.shape[1], fine_probes)[:, 0] for n in range(tables * fine)]
    inside = np.stack(found, axis=1) if found else np.empty((len(unit), 0, fine_probes), np.int64)
    return buckets(unit, 0, tables, axes, probes).astype(np.int16), inside.astype(np.int16).reshape(len(unit), tables, fine, fine_probes)


def _vectors(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dims)


def _hasher(dims: int, tables: int, axes: int, fine: int):
    """Adds the cells of each row to it, so that no task has to hash the rows again."""

    def rows(batches):
        for batch in batches:
            raw = np.asarray(batch.column("v").flatten(), dtype=np.float32).reshape(-1, dims)
            coarse, inside = _cells(_unit(raw), tables, axes, fine, 1, 1)
            yield pa.RecordBatch.from_arrays([
                batch.column("_id"), pa.array([r.tobytes() for r in raw], pa.binary()), batch.column("members"), batch.column("query"),
                pa.array([r.tobytes() for r in coarse[:, :, 0]], pa.binary()), pa.array([r.tobytes() for r in inside.reshape(len(raw), -1)], pa.binary()),
            ], ["_id", "e", "members", "query", "coarse", "fine"])

    return rows


def _merged(best: tuple, found: tuple, k: int) -> tuple:
    """The k best of each query (by similarity, then id) of two sets of (query, near, similarity); a pair can be in both."""
    query, near, sim = (np.concatenate([a, b]) for a, b in zip(best, found))
    by = np.lexsort((near, -sim, query))
    query, near, sim = query[by], near[by], sim[by]
    first = np.append(True, (query[1:] != query[:-1]) | (near[1:] != near[:-1])) if len(query) else np.empty(0, bool)
    query, near, sim = query[first], near[first], sim[first]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], near[keep], sim[keep]


def _lists(ids: np.ndarray, own: list, best: tuple, copies: dict, k: int) -> pa.RecordBatch:
    """(_id, near, sims, copied) of each query: its k nearest, classes of copies member by member; for a class of several rows the k + 1 nearest of the class, its own rows among them."""
    query, near, sim = best[0], best[1], np.rint(best[2] * _MILLION).astype(np.int64)
    at = np.searchsorted(query, np.arange(len(ids) + 1))
    several = np.isin(near, np.fromiter(copies, np.int64, len(copies))) if copies else np.zeros(len(near), bool)
    touched = np.zeros(len(ids), bool)
    touched[query[several]] = True
    touched |= np.array([m is not None for m in own], bool)
    lists: list[tuple] = []
    for i in np.flatnonzero(touched):
        s = slice(at[i], at[i + 1])
        rows = [(-v, m) for n, v in zip(near[s].tolist(), sim[s].tolist()) for m in copies.get(n, (n,))] + [(-_MILLION, m) for m in own[i] or ()]
        lists.append(tuple(zip(*sorted(rows)[: k if own[i] is None else k + 1])))
    # Untouched queries first, in one piece.
    plain = ~touched[query]
    lengths = [np.diff(at)[~touched], np.array([len(x[0]) if x else 0 for x in lists], np.int64)]
    offsets = pa.array(np.append(0, np.cumsum(np.concatenate(lengths))).astype(np.int32))
    flat = [np.concatenate([own_values[plain], np.array([v for x in lists if x for v in x[n]], np.int64)]) for n, own_values in ((1, near), (0, -sim))]
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([ids[~touched], ids[touched]])), pa.ListArray.from_arrays(offsets, pa.array(flat[0])), pa.ListArray.from_arrays(offsets, pa.array((-flat[1]).astype(np.int32))),
        pa.array(np.concatenate([np.zeros((~touched).sum(), bool), np.array([own[i] is not None for i in np.flatnonzero(touched)], bool)])),
    ], ["_id", "near", "sims", "copied"])


def _search(files: list[str], small: set, k: int, dims: int, tables: int, axes: int, probes: int, fine: int, fine_probes: int):
    def of_part(ids: np.ndarray, raw: np.ndarray, own: list) -> pa.RecordBatch:
        unit = _unit(raw)
        coarse, inside = _cells(unit, tables, axes, fine, probes, fine_probes)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        copies: dict[int, list[int]] = {}
        place = np.argsort(ids)
        by_id = ids[place]
        for name in files:
            system, path = fs.FileSystem.from_uri(name)
            with system.open_input_file(path) as f:
                block = pq.read_table(f, columns=["_id", "e", "members", "coarse", "fine"], use_threads=False)
            if not len(block):
                continue
            x_id, x = block.column("_id").to_numpy(), _unit(_vectors(block.column("e"), dims))
            x_coarse = np.frombuffer(b"".join(block.column("coarse").to_pylist()), np.int16).reshape(len(block), tables)
            x_inside = np.frombuffer(b"".join(block.column("fine").to_pylist()), np.int16).reshape(len(block), tables, fine)
            least = np.full(len(ids), -np.inf)
            last = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1)
            least[best[0][last]] = best[2][last]
            found = []
            for t in range(tables):
                for b in range(2 * axes):
                    rows, asks = np.flatnonzero(x_coarse[:, t] == b), np.flatnonzero((coarse[:, t] == b).any(axis=1))
                    if len(rows) and len(asks):
                        depth = 0 if (t, b) in small else fine
                        asked, near, sims = nearest_in_block(ids[asks], unit[asks], x_id[rows], x[rows], k, t, depth, fine_probes, x_inside[rows, t], inside[asks, t], least[asks])
                        found.append((place[np.searchsorted(by_id, asked)], near, sims))
            if found:
                best = _merged(best, tuple(np.concatenate(p) for p in zip(*found)), k)
            many = block.filter(pc.is_valid(block.column("members"))).select(["_id", "members"])
            copies |= dict(zip(many.column("_id").to_pylist(), many.column("members").to_pylist()))
            near = set(best[1].tolist()) if copies else ()
            copies = {i: m for i, m in copies.items() if i in near}
        return _lists(ids, own, best, copies, k)

    def search(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= BLOCK:
                yield from parts(held)
                held, n = [], 0
        if n:
            yield from parts(held)

    def parts(held):
        whole = pa.Table.from_batches(held)
        for at in range(0, len(whole), BLOCK):
            own = whole.slice(at, BLOCK)
            yield of_part(own.column("_id").to_numpy(), _vectors(own.column("e"), dims), own.column("members").to_pylist())

    return search


def usable(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(_id, v): one row per id, with a vector of `dims` finite numbers that are not all zero."""
    v = F.col(vector_col).cast("array<float>")
    ok = (F.size(v) == dims) & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), v.alias("v")).where(F.col("_id").isNotNull() & ok)
    # Only vectors of repeated ids are moved.
    repeated = _sized(cut(rows.groupBy("_id").count().where("count > 1").select("_id")))
    return rows.join(repeated, "_id", "left_anti").unionByName(rows.join(repeated, "_id", "left_semi").groupBy("_id").agg(F.min("v").alias("v")))


def _sized(ids: DataFrame) -> DataFrame:
    """Written ids (and what belongs to them), to be broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def nearest(
    vectors: DataFrame, id_col: str, vector_col: str, k: int = 10, dims: int = 64, tables: int = TABLES, axes: int = AXES, probes: int = PROBES,
    fine: int = FINE, fine_probes: int = FINE_PROBES, queries: Column | None = None,
) -> DataFrame:
    """For every usable vector its k most similar others: (id, neighbour, similarity, rank).

    Similarity is the cosine in double precision, rounded to 6 decimals; ties go to the
    smaller id. A hash is the nearest signed axis after a Hadamard pseudo-rotation. Rows are
    hashed twice: `tables` coarse hashes of few axes say in which buckets a vector stands (its
    own) and in which it looks as a query (those of the `probes` nearest axes); inside a bucket `fine` hashes of all axes, other rotations for each coarse table, say which rows a
    query is compared with: those in the cells of its `fine_probes` nearest axes. All candidates
    are compared exactly. The parameters are the same for any number of rows; more tables or
    probes find more and compare more. A neighbour is missed only if it shares no cell.

    Unusable vectors (null, other length, all zero, not finite) are left out. Of rows with
    one id the least vector counts. Equal vectors (by 128 bits of hash) are one class during
    the search, so that copies, however many, cost no comparison; in the result they stand one
    by one. `queries` (a condition on `_id`) limits the queries, never the rows they are
    compared with. An empty table gives an empty result.

    No vector is shuffled, but those of repeated ids: the first row of each class is written
    once, with its cells, to the folder for checkpoints in files of up to BLOCK rows. A task
    holds up to BLOCK queries and reads all files one after the other, so that the disk used
    grows with the rows, whatever the number of blocks that meet.
    """
    spark = vectors.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/neighbours-{uuid.uuid4().hex}"
    rows = usable(vectors, id_col, vector_col, dims).withColumn("_class", F.struct(F.xxhash64("v"), F.xxhash64(F.lit(k), "v")))
    asks = queries if queries is not None else F.lit(True)
    ids = rows.select("_id", "_class")
    several = ids.groupBy("_class").agg(F.count("*").alias("n"), F.min("_id").alias("rep"), F.max(asks).alias("query")).where("n > 1").select("_class", "rep", "query")
    # Rows of classes of several: the first says what is searched for, k + 1 of them can be neighbours.
    copies = cut(ids.join(several, "_class").select("_id", "rep", "query").withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("_id"))))
    members = copies.where(F.col("n") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("_id")).alias("members"), F.max("query").alias("any"))
    reps = rows.select("_id", "v").join(_sized(copies.where("n > 1").select("_id")), "_id", "left_anti")
    reps = reps.join(_sized(cut(members.withColumnRenamed("rep", "_id"))), "_id", "left").select("_id", "v", "members", F.coalesce("any", asks).alias("query"))
    hashed = reps.mapInArrow(_hasher(dims, tables, axes, fine), "_id bigint, e binary, members array<bigint>, query boolean, coarse binary, fine binary")
    hashed.write.option("maxRecordsPerFile", BLOCK).parquet(root)
    stored = spark.read.schema(hashed.schema).parquet(root)
    # Buckets of few rows, of tables x 2 x axes, are compared whole.
    counts = {(t, b): 0 for t in range(tables) for b in range(2 * axes)}
    bucket = lambda t: F.conv(F.hex(F.substring("coarse", 2 * t + 1, 1)), 16, 10).cast("int")  # noqa: E731 (little end first)
    for t, b, n in stored.select(F.posexplode(F.array(*[bucket(t) for t in range(tables)])).alias("t", "b")).groupBy("t", "b").count().collect():
        counts[t, b] = n
    small = {at for at, n in counts.items() if n <= LEAST}
    asking = stored.where("query").select("_id", "e", "members")
    parts = max(spark.sparkContext.defaultParallelism, -(-asking.count() // BLOCK))
    found = asking.coalesce(parts).mapInArrow(_search(sorted(stored.inputFiles()), small, k, dims, tables, axes, probes, fine, fine_probes), "_id bigint, near array<bigint>, sims array<int>, copied boolean")
    found = cut(found)
    pairs = F.arrays_zip("near", "sims")
    single = found.where("not copied").select("_id", pairs.alias("list"))
    each = found.where("copied").withColumnRenamed("_id", "rep").join(copies.where(asks).select("_id", "rep"), "rep")
    each = each.select("_id", F.slice(F.filter(pairs, lambda p: p["near"] != F.col("_id")), 1, k).alias("list"))
    ranked = single.unionByName(each).select("_id", F.posexplode("list").alias("p", "s"))
    return ranked.select(F.col("_id").alias(id_col), F.col("s.near").alias("neighbour"), (F.col("s.sims") / _MILLION).alias("similarity"), (F.col("p") + 1).alias("rank"))
