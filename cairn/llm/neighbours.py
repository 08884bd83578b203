"""Problem 4: the most similar vectors of every vector.

Multiprobe p-stable hashing.  Each hash table cuts random projections of the
unit vectors into cells of ``width``; a vector lies in one bucket of each table,
its home, and visits the ``probes`` buckets in which a near vector most likely
fell: those whose perturbations (one cell up or down in some projections) have
the smallest squared distances to the crossed borders.  The order of
perturbations is worked out once for expected border distances; each vector
applies it to its own projections sorted by distance.

A table's rows are narrow: bucket, class and a payload of 31 bytes, the vector's
first coordinates in a random orthonormal basis.  Rows are shuffled by bucket
and each bucket is worked off in NumPy: whoever is in it is compared with those
at home, by the distance the payloads give; pairs above a bound that a pair at
``least_cos`` exceeds once in 100,000 times are dropped.  The candidates of all
tables are merged and measured exactly, with the vectors of candidates only.

The number of projections grows with the logarithm of the number of vectors, so
that the buckets of a dense region don't grow with the data, and the number of
tables with it, so that recall at ``least_cos`` stays.  A bucket above
``HOT`` homes is split by salt: its homes are spread, visitors come to each part.

Exact copies are one class and hash once a batch.  No pair of copies is built
beyond the ten that a list can hold.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.runtime import durable, release

#: Bytes of a payload: a flag (1 at home, 0 on a visit) and coordinates.
PAYLOAD = 32
#: Homes above which a bucket is split, and the share of the vectors (one in so many) by which such buckets are found.
HOT, SAMPLED = 20_000, 16
#: Bits of the filter that tells which vectors are needed to measure candidates: a fixed size (1 MB).
BITS = 1 << 23


def probing_order(hashes: int, probes: int) -> np.ndarray:
    """The first ``probes`` perturbation sets by expected score, as rows of 0/1.

    Column j stands for the j-th nearest of the 2 * ``hashes`` cell borders; a
    set never crosses both borders of one projection.
    """
    n, two = hashes, 2 * hashes
    near = [(j * (j + 1)) / (4 * (n + 1) * (n + 2)) for j in range(1, n + 1)]
    far = [1 - (two + 1 - j) / (n + 1) + (two + 1 - j) * (two + 2 - j) / (4 * (n + 1) * (n + 2)) for j in range(n + 1, two + 1)]
    cost = near + far
    found: list[tuple[int, ...]] = []
    queue = [(cost[0], (0,))]
    while queue and len(found) < probes:
        score, members = heapq.heappop(queue)
        if all(two - 1 - j not in members for j in members):
            found.append(members)
        end = members[-1]
        if end + 1 < two:
            heapq.heappush(queue, (score - cost[end] + cost[end + 1], (*members[:-1], end + 1)))
            heapq.heappush(queue, (score + cost[end + 1], (*members, end + 1)))
    out = np.zeros((len(found), two), np.int64)
    for i, members in enumerate(found):
        out[i, list(members)] = 1
    return out


class StableHashes:
    """The random projections of all tables; the same for the same arguments."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, probes: int, seed: int = 20) -> None:
        rng = np.random.default_rng(seed)
        self.tables, self.hashes = tables, hashes
        self.lines = rng.standard_normal((dim, tables * hashes)) / width
        self.shift = rng.uniform(0, 1, tables * hashes)
        self.mix = rng.integers(-(2**62), 2**62, (tables, hashes)) * 2 + 1
        self.salt = rng.integers(-(2**62), 2**62, tables)
        self.order = probing_order(hashes, probes)
        self.basis = np.linalg.qr(rng.standard_normal((dim, min(dim, PAYLOAD - 1))))[0]

    def keys(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket keys (n, tables) and keys to visit (n, tables, probes)."""
        place = unit @ self.lines + self.shift
        cell = np.floor(place)
        inside = (place - cell).reshape(-1, self.tables, self.hashes)
        cell = cell.astype(np.int64).reshape(inside.shape)
        key = (cell * self.mix).sum(2) + self.salt
        borders = np.concatenate([inside, 1 - inside], 2)
        nearest = np.argsort(borders, 2)
        step = np.broadcast_to(np.concatenate([-self.mix, self.mix], 1), borders.shape)
        step = np.take_along_axis(step, nearest, 2)
        return key, key[:, :, None] + step @ self.order.T

    def payload(self, unit: np.ndarray) -> np.ndarray:
        """Rows of ``PAYLOAD`` small integers: 0, then the coordinates in steps of 1 / 254, cut at half (which only brings rows nearer)."""
        out = np.zeros((len(unit), PAYLOAD), np.int8)
        x = unit @ self.basis
        out[:, 1 : 1 + x.shape[1]] = np.rint(x * 254).clip(-127, 127)
        return out

    def limit(self, least_cos: float) -> float:
        """The squared distance of payloads (in steps) that a pair at ``least_cos`` exceeds once in 100,000 times."""
        dim, m = self.basis.shape
        spread = 4.27 * math.sqrt(2 / (9 * m) * max(0.0, 1 - m / dim))
        times = (1 - 2 / (9 * m) * (m < dim) + spread) ** 3
        return (254 * math.sqrt((2 - 2 * least_cos) * times * m / dim) + 0.5 * math.sqrt(m)) ** 2


def whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end with a group of the first column, from batches sorted by it.

    The last group of a batch waits for the next one: a group must be small.
    """
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        keys = np.asarray(table.column(0))
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held


def unit_rows(values: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(values.flatten(), dtype=float).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1)[:, None]


def usable(v: Column, dim: int) -> Column:
    """Of the right length, without nulls, NaN and infinities, and not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def usable_rows(values: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, vectors) of the entries that ``usable`` accepts."""
    right = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(values), dim), False)))
    x = values.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return right[good], x[good]


def classed(named: DataFrame, dim: int) -> DataFrame:
    """name, v, id of the usable rows: ``id`` is a hash of the direction to six decimals, equal for copies and scaled copies."""
    mix = np.random.default_rng(23).integers(-(2**62), 2**62, dim) * 2 + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = usable_rows(batch.column(1), dim)
            h = (np.rint(x / np.linalg.norm(x, axis=1)[:, None] * 1e6).astype(np.int64) * mix).sum(1)
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array((h ^ (h >> 31)) * mix[0])], names=["name", "v", "id"])

    return named.select("name", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "name string, v array<double>, id bigint")


def hashes_for(n: int, width: float = 1.5, dense_cos: float = 0.62, bucket: int = 3000) -> int:
    """Projections per table so that a dense region (mutual cosine ``dense_cos``) has about ``bucket`` vectors per bucket."""
    c = math.sqrt(2 - 2 * dense_cos)
    r = width / c
    chance = 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))
    return min(64, max(4, math.ceil(math.log(max(n / bucket, 2)) / -math.log(chance))))


def table_recall(dim: int, hashes: int, width: float, probes: int, cos: float, pairs: int = 600, trials: int = 40, seed: int = 22) -> float:
    """The share of pairs at ``cos`` that one table brings together, measured on ``pairs`` random pairs in ``trials`` tables."""
    h = StableHashes(dim, trials, hashes, width, probes, seed)
    rng = np.random.default_rng(seed)
    a, e = rng.standard_normal((2, pairs, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    e -= (e * a).sum(1)[:, None] * a
    e /= np.maximum(np.linalg.norm(e, axis=1), 1e-300)[:, None]
    (ka, va), (kb, vb) = h.keys(a), h.keys(cos * a + math.sqrt(max(0.0, 1 - cos * cos)) * e)
    return float(((ka == kb) | (va == kb[:, :, None]).any(2) | (vb == ka[:, :, None]).any(2)).mean())


def tables_for(dim: int, hashes: int, width: float, probes: int, cos: float, recall: float = 0.995) -> int:
    """Tables that together find ``recall`` of the pairs at ``cos``: more projections a table need more of them.

    Tables are independent of each other, so the pairs that all miss are a power
    of those that one misses.
    """
    p = table_recall(dim, hashes, width, probes, cos)
    if not p:
        raise ValueError("one table finds no pair at this cosine")
    return 2 if p >= 1 else max(2, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def salted(key: np.ndarray, ids: np.ndarray, home: np.ndarray, heavy: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, home) with the rows of heavy buckets in each part of theirs: at home in one of them, on a visit in the others."""
    row = np.arange(len(key))
    if not len(heavy):
        return row, key, home
    at = np.searchsorted(heavy, key).clip(0, len(heavy) - 1)
    n = np.where(heavy[at] == key, parts[at], 1)
    row = np.repeat(row, n)
    salt = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    own = (ids[row] >> 7) % n[row]
    return row, key[row] + salt * 0x9E3779B97F4A7C1, home[row] & (salt == own)


def bucket_pairs(key: np.ndarray, ids: np.ndarray, payload: np.ndarray, limit: float, most: int = 1_000_000) -> np.ndarray:
    """a < b of the near pairs within buckets (rows sorted by ``key``), each once: everyone against those at home."""
    home, x = payload[:, 0] == 1, payload[:, 1:]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n, homes = np.diff(np.append(first, len(key))), np.add.reduceat(home.astype(np.int64), first)
    found = []
    large = (homes * n > 4096) & (n > 1)
    for g in np.flatnonzero(large):
        part = x[first[g] : first[g] + n[g]].astype(np.float32)
        near = np.flatnonzero(home[first[g] : first[g] + n[g]])
        h = part[near]
        hh = (h * h).sum(1)
        for lo in range(0, n[g], max(1, 4_000_000 // len(near))):
            p = part[lo : lo + max(1, 4_000_000 // len(near))]
            i, j = np.nonzero((p * p).sum(1)[:, None] + hh - 2 * (p @ h.T) <= limit)
            found.append(ids[first[g] + np.stack([i + lo, near[j]], 1)])
    of = np.repeat(np.arange(len(first)), n)
    rows = np.flatnonzero(((homes > 0) & (n > 1) & ~large)[of])
    times, at = homes[of[rows]], np.flatnonzero(home)
    offset = (np.cumsum(homes) - homes)[of[rows]]
    ends = np.cumsum(times)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, most):
        k = np.arange(lo, min(lo + most, int(ends[-1])))
        r = np.searchsorted(ends, k, "right")
        i, j = rows[r], at[offset[r] + k - (ends[r] - times[r])]
        d = x[i].astype(np.int32) - x[j]
        use = np.einsum("ij,ij->i", d, d) <= limit
        found.append(ids[np.stack([i[use], j[use]], 1)])
    pairs = np.sort(np.concatenate(found) if found else np.empty((0, 2), np.int64), 1)
    return np.unique(pairs[pairs[:, 0] < pairs[:, 1]], axis=0)


def close_pairs(vectors: DataFrame, dim: int, least_cos: float, tables: int | None = None, probes: int = 4, width: float = 1.5, hot: int = HOT) -> DataFrame:
    """a < b, cos of the pairs of ``vectors`` (id bigint, v array<double>) with cos >= ``least_cos``.

    ``vectors`` holds usable vectors; rows of one id are copies, and no pair.
    """
    x = vectors.select("id", "v")
    hashes = hashes_for(vectors.count(), width)
    h = StableHashes(dim, tables or tables_for(dim, hashes, width, probes, least_cos), hashes, width, probes)
    limit = h.limit(least_cos)

    def homes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, _ = h.keys(unit_rows(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel())], names=["key"])

    sampled = x.filter(F.pmod("id", F.lit(SAMPLED)) == 0).mapInArrow(homes, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    heavy = sorted((r["key"], math.ceil(r["n"] * SAMPLED / hot)) for r in sampled.filter(F.col("n") * SAMPLED > hot).collect())  # one in ``hot`` rows at most
    keys, parts = np.array([k for k, _ in heavy], np.int64), np.array([n for _, n in heavy], np.int64)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, once = np.unique(np.asarray(batch.column(0)), return_index=True)
            batch = batch.take(pa.array(np.sort(once)))
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                unit = unit_rows(part.column(1), dim)
                key, visits = h.keys(unit)
                every = np.concatenate([key[:, :, None], visits], 2)
                home = np.zeros(every.shape, bool)
                home[:, :, 0] = True
                ids, each = np.asarray(part.column(0)), every[0].size
                row, flat, at_home = salted(every.ravel(), np.repeat(ids, each), home.ravel(), keys, parts)
                payload = h.payload(unit)[row // each]
                payload[:, 0] = at_home
                words = payload.view("<i8")
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(ids[row // each]), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(words.shape[1]))], names=["key", "id", *(f"s{k}" for k in range(words.shape[1]))])

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            words = np.stack([np.asarray(c) for c in table.columns[2:]], 1)
            found = bucket_pairs(np.asarray(table.column(0)), np.asarray(table.column(1)), np.ascontiguousarray(words).view(np.int8), limit)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)], names=["a", "b"])

    form = "key bigint, id bigint, " + ", ".join(f"s{k} bigint" for k in range(PAYLOAD // 8))
    met = x.mapInArrow(rows, form).repartition("key").sortWithinPartitions("key").mapInArrow(pairs, "a bigint, b bigint")
    candidates = durable(met.distinct())
    needed = _only(x, candidates.select(F.explode(F.array("a", "b")).alias("id"))).groupBy("id").agg(F.first("v").alias("v"))
    left, right = needed.select(F.col("id").alias("a"), F.col("v").alias("va")), needed.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    cos = dot(F.col("va"), F.col("vb")) / F.sqrt(dot(F.col("va"), F.col("va")) * dot(F.col("vb"), F.col("vb")))
    out = durable(candidates.join(left, "a").join(right, "b").select("a", "b", F.round(cos, 9).alias("cos")).filter(F.col("cos") >= least_cos))
    release(candidates)
    return out


def _only(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``vectors`` (id, v) whose id is in ``ids``, and a few others: a filter of ``BITS`` bits before the shuffle."""
    place = F.pmod("id", F.lit(BITS)) + 1
    maps = ids.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()
    bits = np.zeros(BITS, bool)
    for r in maps:
        part = np.unpackbits(np.frombuffer(r["m"], np.uint8), bitorder="little")
        bits[(r["k"] - 1) * len(part) : r["k"] * len(part)] = part
    shared = vectors.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            yield batch.take(pa.array(np.flatnonzero(bits[np.asarray(batch.column(0)) % BITS])))

    return vectors.mapInArrow(run, "id bigint, v array<double>")


def mutual_neighbours(named: DataFrame, dim: int, k: int = 10, least_cos: float = 0.95, **how) -> DataFrame:
    """vec_a < vec_b, cos of the pairs that are among each other's ``k`` most similar with cos >= ``least_cos``.

    ``named`` has name and v; unusable vectors are left out.  At equal cosine
    (to nine decimals) the smaller name comes first.  Repeated names with one
    vector count once.  Empty input gives no rows.
    """
    rows = durable(classed(named, dim))
    # more than k + 1 members of a class are never in a list of k: the first by name win every tie
    place = F.row_number().over(Window.partitionBy("id").orderBy("name"))
    first = durable(rows.select("id", "name").distinct().withColumn("place", place).filter(F.col("place") <= k + 1))
    pairs = close_pairs(rows, dim, least_cos, **how)
    both = pairs.select("a", "b", "cos").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
    other = first.select(F.col("id").alias("b"), F.col("name").alias("other"))
    across = first.select(F.col("id").alias("a"), "name").join(both, "a").join(other, "b").select("name", "other", "cos")
    within = first.select("id", "name").join(first.select("id", F.col("name").alias("other")), "id").filter("name <> other").select("name", "other", F.lit(1.0).alias("cos"))
    ranked = across.unionByName(within).withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(F.col("cos").desc(), "other"))).filter(F.col("r") <= k)
    return ranked.groupBy(F.least("name", "other").alias("vec_a"), F.greatest("name", "other").alias("vec_b")).agg(F.count(F.lit(1)).alias("n"), F.max("cos").alias("cos")).filter("n = 2").select("vec_a", "vec_b", "cos")


class Probes:
    """The buckets that a block of queries visits, by table: sorted keys, and the query of each."""

    def __init__(self, h: StableHashes, unit: np.ndarray) -> None:
        key, visits = h.keys(unit)
        every = np.concatenate([key[:, :, None], visits], 2)
        self.keys, self.queries = [], []
        for t in range(h.tables):
            flat = every[:, t, :].ravel()
            order = np.argsort(flat, kind="stable")
            self.keys.append(flat[order])
            self.queries.append((order // every.shape[2]).astype(np.int32))

    def candidates(self, key: np.ndarray, n_queries: int) -> np.ndarray:
        """A mask (vectors, queries): does any table bring them together?"""
        met = np.zeros((len(key), n_queries), bool)
        for t, (keys, queries) in enumerate(zip(self.keys, self.queries)):
            lo, hi = np.searchsorted(keys, key[:, t], "left"), np.searchsorted(keys, key[:, t], "right")
            n = hi - lo
            row = np.repeat(np.arange(len(key)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            met[row, queries[at]] = True
        return met


def _scan(rows: DataFrame, asked: DataFrame, h: StableHashes | None, dim: int, k: int, block: int) -> DataFrame:
    """query, neighbour, cos: each task's best ``k`` per query, among the candidates of ``h`` (rows carry their keys) or, without it, all rows."""
    spark = rows.sparkSession
    n_blocks = max(1, math.ceil(asked.count() / block))
    form = "query string, neighbour string, cos double"
    out = spark.createDataFrame([], form)
    for b in range(n_blocks):
        part = asked.filter(F.pmod(F.xxhash64("name"), F.lit(n_blocks)) == b).orderBy("name").collect()
        if not part:
            continue
        unit = np.array([r["v"] for r in part], float)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        shared = spark.sparkContext.broadcast((np.array([r["name"] for r in part], object), unit, h and Probes(h, unit)))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, unit, visited = shared.value
            n = len(names)
            best, who = np.full((n, k), -2.0), np.full((n, k), "", object)
            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    piece = batch.slice(lo, 1000)
                    own = np.array(piece.column(0).to_pylist(), object)
                    x = unit_rows(piece.column(1), dim)
                    if visited is None:
                        cos = np.round(unit @ x.T, 9)
                    else:
                        met = visited.candidates(np.asarray(piece.column(2).flatten()).reshape(len(own), -1), n)
                        cos = np.full((n, len(own)), -2.0)
                        if met.mean() > 0.02:  # one product is cheaper than many small ones
                            np.copyto(cos, np.round(unit @ x.T, 9), where=met.T)
                        else:
                            i, q = np.nonzero(met)
                            cos[q, i] = np.round(np.einsum("ij,ij->i", unit[q], x[i]), 9)
                    cos[names[:, None] == own[None, :]] = -2.0
                    m = min(k, len(own))
                    top = np.argpartition(-cos, m - 1, 1)[:, :m] if m < len(own) else np.tile(np.arange(len(own)), (n, 1))
                    found = np.take_along_axis(cos, top, 1)
                    least = found.min(1)
                    tied = (cos == least[:, None]).sum(1) > (found == least[:, None]).sum(1)
                    for q in np.flatnonzero(tied & (least > -2)):  # the names decide at the last place
                        all_at = np.flatnonzero(cos[q] >= least[q])
                        top[q] = all_at[np.lexsort((own[all_at].astype(str), -cos[q, all_at]))[:m]]
                    both = np.concatenate([best, np.take_along_axis(cos, top, 1)], 1)
                    named = np.concatenate([who, own[top]], 1)
                    better = np.flatnonzero((both[:, k:] >= best[:, -1:]).any(1))
                    order = np.lexsort((named[better].astype(str), -both[better]), 1)[:, :k]
                    best[better], who[better] = np.take_along_axis(both[better], order, 1), np.take_along_axis(named[better], order, 1)
            q, j = np.nonzero(best > -2)
            yield pa.RecordBatch.from_arrays([pa.array(names[q], pa.string()), pa.array(who[q, j], pa.string()), pa.array(best[q, j])], names=["query", "neighbour", "cos"])

        out = out.unionByName(durable((rows if h else rows.select("name", "v")).mapInArrow(run, form)))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("cos").desc(), "neighbour"))
    return out.withColumn("neighbour_rank", place).filter(F.col("neighbour_rank") <= k).select("query", "neighbour_rank", "neighbour", "cos")


def nearest(named: DataFrame, queries: DataFrame, dim: int, k: int = 10, tables: int = 8, hashes: int = 14, width: float = 2.5, probes: int = 60, block: int = 4096, sure_cos: float = 0.5) -> DataFrame:
    """query, neighbour_rank, neighbour, cos: the ``k`` most similar of ``named`` for each of ``queries``.

    Both have name and v; unusable vectors are left out, and a name is not its
    own neighbour.  Multiprobe search with coarser buckets than
    ``close_pairs``, since the tenth neighbour in a dense region is hardly
    nearer than the rest; candidates are measured exactly.  A vector apart from
    all others has neighbours that hardly differ from any vector: a query whose
    k-th neighbour is below ``sure_cos`` (or missing) is measured against all
    rows.  The queries come in blocks of about ``block``: a block's buckets go to
    every task (a bounded size), each task keeps its best ``k`` per query.  Equal
    cosines (to nine decimals) by name.
    """
    h = StableHashes(dim, tables, hashes, width, probes, seed=21)

    def indexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = h.keys(unit_rows(batch.column(1), dim))[0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, tables, dtype=np.int32)), pa.array(key.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["name", "v", "keys"])

    rows = durable(named.filter(usable(F.col("v"), dim)).select("name", "v").dropDuplicates(["name"]).mapInArrow(indexed, "name string, v array<double>, keys array<bigint>"))
    asked = durable(queries.filter(usable(F.col("v"), dim)).select("name", "v").dropDuplicates(["name"]))
    first = durable(_scan(rows, asked, h, dim, k, block))
    sure = first.filter((F.col("neighbour_rank") == k) & (F.col("cos") >= sure_cos)).select(F.col("query").alias("name"))
    again = durable(asked.join(sure, "name", "left_anti"))
    kept = first.join(sure.withColumnRenamed("name", "query"), "query", "left_semi")
    return kept.unionByName(_scan(rows, again, None, dim, k, block))
