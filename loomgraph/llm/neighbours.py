"""Operator 9: approximate nearest neighbours by multi-index hashing over learned rotated binary codes."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from loomgraph.llm import common

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
FIT_ROWS = 6_000
ROTATIONS = 4  # each gives one bit a dimension
SUBSTRING_BITS = 16
RECALL = 0.9975
#: rows, not fitted on if there are more, whose neighbours among all rows tell how far to probe
MEASURED = 200
#: most rows of a block (of 64 dimensions; fewer of longer vectors), rows from which a table is split in up to SPLIT blocks
BLOCK, SPLIT_ROWS, SPLIT, QUERY_BLOCK = 32_768, 16_384, 4, 512
#: (query, row) pairs that are checked at once
PAIRS_AT_ONCE = 100_000


@dataclass(frozen=True)
class Codes:
    """Learned rotations (bits by dimensions) about a mean; sets of a substring's bits to flip, likeliest first, where bit 0
    is the bit whose component lies nearest to zero; how many of them to probe; and the Hamming radius to keep."""

    mean: np.ndarray
    rotation: np.ndarray
    flips: np.ndarray
    probes: int
    radius: int

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rotated components by substring; what fills the last substring is never flipped before any other."""
        y = (x - self.mean) @ self.rotation.T
        y = np.pad(y, ((0, 0), (0, -y.shape[1] % SUBSTRING_BITS)), constant_values=-np.inf)
        return y.reshape(len(x), -1, SUBSTRING_BITS)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        return _packed_bits(self.project(x) > 0)

    def values(self, x: np.ndarray) -> np.ndarray:
        """(row, substring, probe): the values to look up for each row, likeliest first."""
        y = self.project(x)
        weight = (1 << np.argsort(np.abs(y), axis=-1, kind="stable")).astype(np.float32)
        flip = (self.flips[: self.probes, None] >> np.arange(SUBSTRING_BITS) & 1).astype(np.float32)
        return (weight @ flip.T).astype(np.uint16) ^ _packed_bits(y > 0)[:, :, None]

    def place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of rows of a and b, the first probe of a that gives b in any substring."""
        of_flips = np.empty(len(self.flips), np.int64)
        of_flips[self.flips] = np.arange(len(self.flips))
        return of_flips[_packed_bits(_flipped(self.project(a), self.project(b)))].min(axis=1)

    def tuned(self, place: np.ndarray, distance: np.ndarray, recall: float) -> "Codes":
        """Codes that find `recall` of neighbours with these places and Hamming distances: a third of what may be lost is
        lost to the radius, the rest to probes."""
        radius = int(np.quantile(distance, 1 - (1 - recall) / 3, method="higher"))
        probes = np.quantile(np.where(distance <= radius, place, len(self.flips)), recall, method="higher")
        return replace(self, radius=radius, probes=min(int(probes) + 1, len(self.flips)))


def _packed_bits(bits: np.ndarray) -> np.ndarray:
    """The last axis, of 16 bits, as one number, bit 0 first."""
    return np.packbits(bits, axis=-1, bitorder="little").view("<u2")[..., 0]


def _flipped(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which bits of a's substrings differ in b, from a's component nearest to zero outwards."""
    order = np.argsort(np.abs(a), axis=-1, kind="stable")
    return np.take_along_axis((a > 0) != (b > 0), order, axis=-1)


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)), np.int16)
    for i in range(a.shape[1]):
        total += np.bitwise_count(a[:, i : i + 1] ^ b[None, :, i])
    return total


def fit_codes(x: np.ndarray, near: int, rotations: int = ROTATIONS, recall: float = RECALL, seed: int = 7, steps: int = 12) -> Codes:
    """Iterative quantisation from several random starts; then the order of flips by how often bits of true neighbours of
    sample rows among the sample differ; then probes and radius that hold `recall` of these (neighbours among all rows
    lie no farther)."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    mean = x.mean(axis=0)
    y = x - mean
    parts = []
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(steps):
            b = np.sign(y @ r)
            u, _, vt = np.linalg.svd(b.T @ y)
            r = (u @ vt).T
        parts.append(r.T)
    every = np.arange(1 << SUBSTRING_BITS)
    codes = Codes(mean, np.concatenate(parts), every, len(every), 0)
    q = rng.permutation(len(x))[: min(len(x), 400)]
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -np.inf
    top = np.argsort(-scores, axis=1)[:, : max(1, min(near, len(x) - 1))]
    asked, found = x[np.repeat(q, top.shape[1])], x[top.ravel()]
    share = _flipped(codes.project(asked), codes.project(found)).reshape(-1, SUBSTRING_BITS).mean(axis=0).clip(0.001, 0.499)
    bits = every[:, None] >> np.arange(SUBSTRING_BITS) & 1
    codes = replace(codes, flips=np.argsort(bits @ np.log((1 - share) / share), kind="stable"))
    return codes.tuned(codes.place(asked, found), _distance(codes, asked, found), recall)


def _distance(codes: Codes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of pairs of rows."""
    return np.bitwise_count(codes.of(a) ^ codes.of(b)).sum(axis=1)


def _best(at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each query `at`, best first, ties to the smaller id."""
    order = np.lexsort((ids, -score, at))
    at = at[order]
    return order[np.arange(len(at)) - np.searchsorted(at, at) < k]


def measured(rows: DataFrame, codes: Codes, ids: np.ndarray, x: np.ndarray, k: int, recall: float = RECALL) -> Codes:
    """Codes with as many probes and as wide a radius as hold `recall` of the k nearest of all rows to these few, which one
    pass over the rows finds by brute force."""

    def nearest(batches):
        kept = None
        for batch in batches:
            who = batch.column("vec_id").to_numpy()
            v = batch.column("v").flatten().to_numpy().reshape(len(who), -1)
            scores = x @ v.T
            scores[ids[:, None] == who] = -np.inf
            top = np.argpartition(-scores, k - 1, axis=1)[:, :k] if len(who) > k else np.tile(np.arange(len(who)), (len(x), 1))
            at, row = np.repeat(np.arange(len(x)), top.shape[1]), top.ravel()
            new = [at, who[row], scores[at, row], v[row]]
            both = new if kept is None else [np.concatenate(c) for c in zip(kept, new, strict=True)]
            best = _best(*both[:3], k)
            kept = [c[best] for c in both]
        if kept is not None:
            at, who, score, v = (c[kept[2] > -np.inf] for c in kept)
            place, distance = codes.place(x[at], v), _distance(codes, x[at], v).astype("i8")
            yield pa.RecordBatch.from_pydict({"query": at.astype("i4"), "vec_id": who, "score": score, "place": place, "distance": distance})

    near = rows.select("vec_id", "v").mapInArrow(nearest, "query int, vec_id long, score double, place long, distance long")
    first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("place", "distance").toPandas()
    return codes.tuned(found.place.to_numpy(), found.distance.to_numpy(), recall) if len(found) else codes


def flips(most: int) -> np.ndarray:
    """All 16-bit masks of at most `most` bits."""
    every = np.arange(1 << SUBSTRING_BITS, dtype=np.uint16)
    return every[np.bitwise_count(every) <= most]


class Index:
    """One block of vectors: for every 16-bit substring a table of all values and the rows that hold them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, code: np.ndarray) -> None:
        self.ids, self.x, self.code = ids, x, code
        self.words = np.pad(code, ((0, 0), (0, -code.shape[1] % 4))).view("<u8").T.copy()
        n, m = code.shape
        self.rows = np.argsort(code.T, axis=1, kind="stable").astype(np.int32).ravel()
        counts = [np.bincount(code[:, i], minlength=1 << SUBSTRING_BITS) for i in range(m)]
        self.start = np.append(0, np.cumsum(np.concatenate(counts))).astype(np.int32 if n * m < 1 << 31 else np.int64)
        self.seen = np.zeros(n, bool)

    def held(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that hold the values of these slots (substring x 2^16 + value), and how many each slot has."""
        first = self.start[slot]
        size = self.start[slot + 1] - first
        some = np.flatnonzero(size)
        first, some = first[some], size[some]
        end = np.cumsum(some)
        return self.rows[np.repeat(first - (end - some), some) + np.arange(end[-1] if len(end) else 0)], size

    def probe(self, i: int, own: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of rows whose i-th substring lies within `near` bits of the query's: every such value is looked
        up where there are fewer of them than the table holds, else the table's values are compared."""
        table = i << SUBSTRING_BITS
        masks = flips(near)
        values = np.flatnonzero(np.diff(self.start[table : table + (1 << SUBSTRING_BITS) + 1])).astype(np.uint16)
        if len(masks) < len(values):
            slot = (own[:, None] ^ masks[None, :]).ravel().astype(np.int64)
            query = np.repeat(np.arange(len(own)), len(masks))
        else:
            query, slot = np.nonzero(np.bitwise_count(own[:, None] ^ values[None, :]) <= near)
            slot = values[slot].astype(np.int64)
        rows, size = self.held(slot + table)
        return np.repeat(query, size), rows

    def near(self, values: np.ndarray, word: np.ndarray, radius: int) -> np.ndarray:
        """Rows that hold any of one query's values (substring, probe), checked on whole codes, in order."""
        slot = values + (np.arange(len(values)) << SUBSTRING_BITS)[:, None]
        self.seen[self.held(slot.ravel())[0]] = True
        rows = np.flatnonzero(self.seen)
        self.seen[rows] = False
        distance = np.zeros(len(rows), np.int32)
        for held, own in zip(self.words, word, strict=True):
            distance += np.bitwise_count(held.take(rows) ^ own)
        return rows[distance <= radius]

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all codes within the Hamming radius, by query.

        Pigeonhole: m substrings and radius = m a + r; a code that near lies within a of the query in one of the
        first r + 1 substrings, or within a - 1 in one of the others.  What a table gives is checked on whole codes.
        """
        m = code.shape[1]
        a, r = divmod(radius, m)
        seen = np.zeros((len(code), len(self.ids)), bool)
        for i in range(m):
            near = a if i <= r else a - 1
            if near >= 0 and not seen.all():
                seen[self.probe(i, code[:, i], min(near, SUBSTRING_BITS))] = True
        query, row = np.nonzero(seen)
        near = np.zeros(len(query), bool)
        for lo in range(0, len(query), PAIRS_AT_ONCE):
            part = slice(lo, lo + PAIRS_AT_ONCE)
            near[part] = np.bitwise_count(code[query[part]] ^ self.code[row[part]]).sum(axis=1) <= radius
        return query[near], row[near]

    def search(self, qid: np.ndarray, q: np.ndarray, codes: Codes, k: int) -> list[tuple[int, int, float]]:
        """(query, id, inner product) of the k best rows that probing gives within the radius, ties to the smaller id;
        where these are fewer than k, all rows within a radius that grows until k are found or the block is used up.
        Inner products are taken of these rows alone."""
        code, found = codes.of(q), []
        word = np.pad(code, ((0, 0), (0, -code.shape[1] % 4))).view("<u8")
        width = code.shape[1] * SUBSTRING_BITS
        for i, values in enumerate(codes.values(q)):
            row = self.near(values, word[i], codes.radius)
            row = row[self.ids[row] != qid[i]]
            radius = codes.radius
            while len(row) < min(k, len(self.ids) - 1):
                row = self.within(code[i : i + 1], radius)[1]
                row = row[self.ids[row] != qid[i]]
                if radius >= width:
                    break
                radius = min(width, radius + max(1, width // 16))
            exact = np.concatenate([(self.x.take(row[lo : lo + PAIRS_AT_ONCE], axis=0) * q[i]).sum(axis=1) for lo in range(0, len(row) or 1, PAIRS_AT_ONCE)])
            if len(row) > k:
                top = np.flatnonzero(exact >= np.partition(exact, len(row) - k)[len(row) - k])
                row, exact = row[top], exact[top]
            best = np.lexsort((self.ids[row], -exact))[:k]
            found += zip([int(qid[i])] * len(best), self.ids[row[best]].tolist(), exact[best].tolist(), strict=True)
        return found


def valid_vectors(df: DataFrame, dimensions: int) -> DataFrame:
    """Rows with an id and a vector of the common length without nulls, non-finite numbers, or only zeros."""
    v = F.col("v")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = df.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL")
    return rows.where((F.size(v) == dimensions) & ~bad & F.exists(v, lambda c: c != 0))


def search(embeddings: DataFrame, every: int = 20, k: int = 20, fit_rows: int = FIT_ROWS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row whose vec_id is divisible by `every`.

    Nearness is the inner product in double precision of the original vectors; ties go to the smaller vec_id.
    Vectors that are null, zero, of another length than most or hold null or non-finite numbers take no part; of
    rows that repeat a vec_id the smallest vector counts.  An empty table gives no rows.  Rotations are fitted on at
    most fit_rows rows in hash order, and how far to probe follows from the true neighbours of the next MEASURED rows
    among all rows; every row is indexed.  Queries meet rows in blocks of bounded size; each block pair is one row of a join on the
    block number, and gives at most k rows a query.
    """
    spark = embeddings.sparkSession
    common_size = embeddings.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("d")).count()
    first = common_size.orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if first is None:
        return spark.createDataFrame([], schema)
    rows = valid_vectors(embeddings, first["d"]).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = common.materialize(rows, "vectors")
    sample = rows.orderBy(common.hash_order(F.col("vec_id")), "vec_id").limit(fit_rows + MEASURED).toPandas()
    if len(sample) < 2:
        return spark.createDataFrame([], schema)
    x = np.array(sample.v.tolist(), float)
    codes = measured(rows, fit_codes(x[:fit_rows], k), sample.vec_id.to_numpy()[-MEASURED:], x[-MEASURED:], k)
    n_rows, most = rows.count(), max(1, min(block, BLOCK * 64 // first["d"]))
    n_blocks = max(-(-n_rows // most), min(SPLIT, -(-n_rows // SPLIT_ROWS)))

    element = embeddings.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, FloatType) else "<f8"  # as short as holds the given numbers exactly

    def packed(name):
        def make(ids_and_vectors: pd.DataFrame) -> pd.DataFrame:
            part = ids_and_vectors.sort_values("vec_id")
            x = np.array(part.v.tolist(), kind)
            return pd.DataFrame(
                {"block": part.block.iloc[:1].to_numpy(), name + "_ids": [part.vec_id.to_numpy("<i8").tobytes()], name + "_x": [x.tobytes()]})

        return make

    def blocks(df, count, name):
        # ids are unique here, so hashing deals them evenly: a block holds about `block` rows
        dealt = df.withColumn("block", F.pmod(F.xxhash64(F.lit(name), "vec_id"), F.lit(count)))
        return dealt.groupBy("block").applyInPandas(packed(name), f"block long, {name}_ids binary, {name}_x binary")

    queries = rows.where(F.col("vec_id") % every == 0)
    asked = common.materialize(blocks(queries, -(-queries.count() // QUERY_BLOCK) or 1, "query"), "queries").drop("block")
    pairs = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")))
    met = pairs.join(common.materialize(blocks(rows, n_blocks, "row"), "index"), "block")

    def probe(batches):
        made: dict[int, Index] = {}
        for b in batches:
            for r in b.itertuples():
                if r.block not in made:
                    ids = np.frombuffer(r.row_ids, "<i8")
                    v = np.frombuffer(r.row_x, kind).reshape(len(ids), -1).astype(float)
                    made = {r.block: Index(ids, v, codes.of(v))}
                ids = np.frombuffer(r.query_ids, "<i8")
                q = np.frombuffer(r.query_x, kind).reshape(len(ids), -1).astype(float)
                for lo in range(0, len(ids), 32):
                    found = made[r.block].search(ids[lo : lo + 32], q[lo : lo + 32], codes, k)
                    if found:
                        yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, "1")  # a row is a pair of blocks
    try:
        near = common.materialize(met.mapInPandas(probe, "query_id long, vec_id long, score double"), "near")
    finally:
        spark.conf.set(ARROW_ROWS, before)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every 20th vector; no rows for an empty table."""
    return search(common.table(spark, sf_dir, "embeddings"))
