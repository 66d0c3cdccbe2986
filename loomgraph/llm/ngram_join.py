"""Operator 4: n-gram Jaccard join with adaptive multi-match prefixes, as connected classes of documents.

Prefix rule.  Order every set by one global order (rare shingles first).  Sets x and y with Jaccard at least t share
at least need(x) = ceil(t |x|) shingles, and the same for y.  With l(x) >= 1, take the first |x| - need(x) + l(x)
shingles of x; then the two prefixes share at least min(l(x), l(y)) shingles.  Each document picks its own l: a longer
prefix costs more postings to scan, but asks partners for more shared shingles before any verification.

Bitmap rule.  The bitmap of a set has bit (hash mod size) turned over once for every shingle, so bits that differ
between two bitmaps are at most the shingles in which the sets differ.  A pair whose bitmaps differ in more bits than
the rule allows is no link; that is certain, and needs a bit for each shingle, not the shingles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import common
from loomgraph.llm.components import components

#: counters of the frequency sketch: a fixed 1 MB however large the corpus
SKETCH_BITS = 18
#: counters in a row of the table that the driver reads
SKETCH_ROW = 8192
MOST_MATCHES = 4
#: a posting list whose sketch count (never too low) is at most this is handled in one group
SMALL_LIST = 4096
#: least bits of a set's parity bitmap; it has as many bits as the set has shingles, rounded up to a power of two
LEAST_BITS = 256
#: members that are verified against one copy of their hub's text; rows of one side in a group of the pair join
HUB_GROUP, PAIR_GROUP = 100, 1000
#: cost of one verification in scanned postings
VERIFY_COST = 50.0


@dataclass(frozen=True)
class Rule:
    """Link where 100 * |x & y| >= percent * |x | y| over distinct k-word shingles."""

    k: int = 4
    percent: int = 85

    def need(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def met(self, n: int, m: int, both: int) -> bool:
        return both > 0 and 100 * both >= self.percent * (n + m - both)


def sets_of(texts, k: int, hasher: common.WordHash):
    for t in texts:
        yield common.shingles(hasher([w.lower() for w in common.words_of(common.as_text(t))]), k)


def frequency_sketch(documents: DataFrame, rule: Rule, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of shingle hashes modulo 2**bits over all documents.  It only orders shingles, so collisions cost
    time and never results."""
    shift = np.uint64(64 - bits)

    def count(batches):
        hasher, total = common.WordHash(), np.zeros(1 << bits, np.int64)
        for b in batches:
            slots = np.concatenate([np.empty(0, np.uint64), *sets_of(b.text, rule.k, hasher)]) >> shift
            total += np.bincount(slots.astype(np.int64), minlength=1 << bits)
        hit = np.flatnonzero(total)
        for lo in range(0, len(hit), 200_000):
            part = hit[lo : lo + 200_000]
            yield pd.DataFrame({"slot": part.astype(np.int32), "n": total[part]})

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(SKETCH_ROW, "<i4")
        part[rows.slot.to_numpy() % SKETCH_ROW] = np.minimum(rows.n.to_numpy(), 2**31 - 1)
        return pd.DataFrame({"at": [int(rows.slot.iloc[0]) // SKETCH_ROW], "counts": [part.tobytes()]})

    slots = documents.select("text").mapInPandas(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    folded = slots.groupBy(F.floor(F.col("slot") / SKETCH_ROW)).applyInPandas(fold, "at int, counts binary")
    sketch = np.zeros(1 << bits, np.int32)
    for r in folded.collect():
        sketch[r["at"] * SKETCH_ROW : (r["at"] + 1) * SKETCH_ROW] = np.frombuffer(r["counts"], "<i4")
    return sketch


def choose_matches(df: np.ndarray, n: int, need: int) -> int:
    """The number of shared prefix shingles to ask for that has the least estimated cost.

    df holds estimates for the set in global order.  With l matches the postings of the prefix are scanned, and at
    most their sum over l documents can hold l of its shingles and go on to verification.
    """
    most = min(MOST_MATCHES, need)
    if most <= 1:
        return 1
    base = n - need
    scanned = np.cumsum(df[: base + most].astype(float))[base:]
    cost = scanned + VERIFY_COST * scanned / np.arange(1, most + 1)
    return int(cost.argmin()) + 1


def signatures(documents: DataFrame, rule: Rule, sketch: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set, matches, the prefix in global order, for each of its shingles
    whether its posting list is surely small (by the shingle's own count, so that all documents say the same of it),
    and the parity bitmap."""
    bits = int(np.log2(len(sketch)))
    shift, usual = np.uint64(64 - bits), int(np.median(sketch))
    shared = documents.sparkSession.sparkContext.broadcast(sketch)  # 1 MB, fixed by SKETCH_BITS

    def sign(batches):
        hasher, counts = common.WordHash(), shared.value
        for b in batches:
            out = []
            for s in sets_of(b.text, rule.k, hasher):
                n = len(s)
                if not n:
                    out.append((0, None, None, 0, [], [], b""))
                    continue
                raw = counts[(s >> shift).astype(np.int64)]
                df = np.maximum(raw - usual, 0)
                need = rule.need(n)
                reach = min(n, n - need + MOST_MATCHES)
                key = df.astype(np.int64)
                first = np.lexsort((s, key))[:reach] if n < 200 else _least(s, key, reach)
                matches = choose_matches(df[first], n, need)
                prefix = s[first[: n - need + matches]].view(np.int64)
                small = raw[first[: n - need + matches]] <= SMALL_LIST
                both = common.mix(s)
                with np.errstate(over="ignore"):
                    a, c = int(s.sum().view(np.int64)), int(both.sum().view(np.int64))
                out.append((n, a, c, matches, small, prefix, parity_bitmap(s)))
            names = ["n_shingles", "d1", "d2", "matches", "small", "prefix", "bitmap"]
            yield pd.DataFrame(out, columns=names).assign(doc_id=b.doc_id.to_numpy())[["doc_id", *names]]

    return documents.select("doc_id", "text").mapInPandas(
        sign, "doc_id long, n_shingles long, d1 long, d2 long, matches int, small array<boolean>, prefix array<long>, bitmap binary"
    )


def _least(s: np.ndarray, key: np.ndarray, reach: int) -> np.ndarray:
    """Positions of the first `reach` by (key, s) without sorting the rest."""
    cut = np.partition(key, reach - 1)[reach - 1]
    near = np.flatnonzero(key <= cut)
    return near[np.lexsort((s[near], key[near]))[:reach]]


def parity_bitmap(s: np.ndarray) -> bytes:
    size = max(LEAST_BITS, 1 << (len(s) - 1).bit_length())
    turned = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(turned.astype(bool), bitorder="little").tobytes()


def differing_bits(x: bytes, y: bytes) -> int:
    """Bits that differ between two bitmaps; the longer one is folded to the shorter, as sizes are powers of two."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) != len(b):
        a, b = (np.bitwise_xor.reduce(v.reshape(-1, min(len(a), len(b))), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def unlike_bits_allowed(rule: Rule, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many shingles two sets of n and m shingles may have not in common: from 100 i >= p (n + m - i)."""
    both = -(-rule.percent * (n + m) // (100 + rule.percent))
    return n + m - 2 * both


def bitmap_test(pairs: DataFrame, signed: DataFrame, rule: Rule) -> DataFrame:
    """The distinct pairs (a, b) that bitmaps do not rule out, with the bits that differ; signed has a row for every set."""
    own = signed.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n"), F.col("bitmap").alias("x"))
    met = common.broadcast_if_small(pairs).join(own, "a")
    met = met.join(signed.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("m"), F.col("bitmap").alias("y")), "b")

    def check(batches):
        for b in batches:
            differ = np.fromiter(map(differing_bits, b.x, b.y), np.int64, len(b))
            ok = differ <= unlike_bits_allowed(rule, b.n.to_numpy(), b.m.to_numpy())
            yield b.loc[ok, ["a", "b"]].assign(differ=differ[ok])

    passed = met.select("a", "b", "n", "m", "x", "y").mapInPandas(check, "a long, b long, differ long")
    return passed.groupBy("a", "b").agg(F.min("differ").alias("differ"))


def verify(pairs: DataFrame, documents: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of a written table whose whole sets meet the rule.

    Texts travel instead of sets, as they compress.  A text is sent once for each pair it is `a` of, and the
    text of `b` once for each HUB_GROUP of b's pairs; groups are sorted so that b's text comes first, and are read as a
    stream.
    """
    hubs = common.materialize(pairs.groupBy("b").agg(F.count("*").alias("times")).withColumn("groups", F.ceil(F.col("times") / HUB_GROUP)), "hubs")
    members = common.skew_join(pairs.select("a", "b"), hubs, ["b"], "times").select(
        "b", F.pmod(F.xxhash64("a"), "groups").alias("part"), F.lit(1).alias("role"), F.col("a").alias("doc_id"))
    centers = hubs.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), F.lit(0).alias("role"), F.col("b").alias("doc_id"))
    asked = common.materialize(centers.union(members), "asked")
    texts = documents.select("doc_id", "text").join(common.broadcast_if_small(asked), "doc_id")
    dealt = texts.repartition("b", "part").sortWithinPartitions("b", "part", "role", "doc_id")

    def check(batches):
        hasher, group, center = common.WordHash(), None, {}
        for b in batches:
            found = []
            for hub, part, role, doc_id, s in zip(b.b, b.part, b.role, b.doc_id, sets_of(b.text, rule.k, hasher), strict=True):
                if (hub, part) != group:
                    group, center = (hub, part), {}
                if role == 0:
                    center[s.tobytes()] = s  # more than one only where b repeats with other texts
                elif any(rule.met(len(s), len(c), len(np.intersect1d(s, c, assume_unique=True))) for c in center.values()):
                    found.append((doc_id, hub))
            yield pd.DataFrame(found, columns=["a", "b"])

    checked = dealt.select("doc_id", "b", "part", "role", "text").mapInPandas(check, "a long, b long")
    return checked.distinct()


def possible(rule: Rule, na: str, pa: str, nb: str, pb: str) -> str:
    """SQL: sizes allow the rule, and so does the overlap left from these positions of a first shared shingle."""
    return (
        f"100 * {na} >= {rule.percent} * {nb} AND 100 * {nb} >= {rule.percent} * {na} AND "
        f"{100 + rule.percent} * least({na} - {pa}, {nb} - {pb}) >= {rule.percent} * ({na} + {nb})"
    )


def near_duplicates(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per row of documents (doc_id, text): doc_id, n_shingles, component_id.

    component_id is the smallest doc_id reachable over links, itself included.  Texts without words (null, empty,
    white space) have 0 shingles and link with nothing.  Rows that repeat a doc_id are one document with several
    texts; rows with a null doc_id are returned with a null component_id and link with nothing.  Other columns are
    not read.

    Steps: equal sets fold to their smallest id.  Every posting list names a hub, the document where the shared
    shingle stands first; each document is verified against the hub it shares most postings with among those its
    bitmap allows, which joins large groups of near copies in linear work.  Then the pairs in a posting list that
    are not yet in one component, and that sizes and positions allow, are counted; those with min(matches) shared
    prefix shingles, and bitmaps that allow it, are verified.
    """
    spark = documents.sparkSession
    common.small_batches(spark)
    signed = common.materialize(signatures(documents, rule, frequency_sketch(documents, rule)).withColumn("row", F.monotonically_increasing_id()), "signatures")
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    digest = ["d1", "d2", "n_shingles"]
    first = common.materialize(filled.groupBy(*digest).agg(
        F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("copies")).select(
        *digest, F.col("first.doc_id").alias("rep"), F.col("first.row").alias("row"), "copies"), "sets")
    # one row for each distinct set, so no key is repeated
    reps = filled.join(first.select("row"), "row", "left_semi")
    links = common.materialize(hub_links(reps, documents, rule).union(several_texts(signed, first)), "links")
    final = components(links)
    classes = first.join(final.withColumnRenamed("vertex", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    classes = common.materialize(classes.where("copies > 1 OR component <> rep").select(*digest, "component", "copies"), "classes")
    known = filled.select("doc_id", *digest)
    out = common.skew_join(known, classes, digest, "copies", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    rest = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles").join(final.withColumnRenamed("vertex", "doc_id"), "doc_id", "left")
    return out.union(rest.select("doc_id", "n_shingles", F.coalesce("component", "doc_id")))


def several_texts(signed: DataFrame, first: DataFrame) -> DataFrame:
    """Links (a, b) between a document and the representatives of its sets, where an id repeats with other texts."""
    filled = signed.where("doc_id IS NOT NULL").fillna(0, ["d1", "d2"])
    bounds = [f(c).alias(f"{f.__name__}_{c}") for c in ("d1", "d2", "n_shingles") for f in (F.min, F.max)]
    several = filled.groupBy("doc_id").agg(*bounds).where("min_d1 < max_d1 OR min_d2 < max_d2 OR min_n_shingles < max_n_shingles").select("doc_id")
    sets = filled.where("n_shingles > 0").select("doc_id", "d1", "d2", "n_shingles").join(several, "doc_id", "left_semi").distinct()
    return sets.join(first, ["d1", "d2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def hub_links(reps: DataFrame, documents: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) enough to join the documents of reps into the components of all links."""
    postings = reps.select(
        "doc_id", F.col("n_shingles").cast("int").alias("n"), "matches", F.posexplode(F.arrays_zip("prefix", "small")).alias("pos", "entry"))
    postings = postings.select("doc_id", "n", "matches", "pos", F.col("entry.prefix").alias("token"), F.col("entry.small").alias("small"))
    columns = ["token", "doc_id", "n", "matches", "pos"]
    hub = F.min(F.struct("pos", "doc_id", "n"))
    # small lists: one shuffle, and a window of bounded size; others: lists first, then a join that deals out hot ones
    alone = Window.partitionBy("token")
    few = postings.where("small").select(*columns).withColumn("size", F.count("*").over(alone)).withColumn("hub", hub.over(alone)).where("size > 1")
    many = postings.where("NOT small").select(*columns)
    lists = common.materialize(many.groupBy("token").agg(F.count("*").alias("size"), hub.alias("hub")).where("size > 1"), "lists")
    both = few.drop("size").unionByName(common.skew_join(many, lists, ["token"], "size"))
    shared = common.materialize(
        both.select(*columns, F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos")), "postings")
    toward = shared.where("doc_id <> hub").where(possible(rule, "n", "pos", "hub_n", "hub_pos"))
    toward = common.materialize(toward.groupBy(F.col("doc_id").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("times")), "toward")
    like = bitmap_test(toward.select("a", "b"), reps, rule)
    best = like.groupBy("a").agg(F.min(F.struct("differ", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    hubs = common.materialize(verify(common.materialize(best, "hub-pairs"), documents, rule), "hub-links")
    classes = components(hubs)
    left = shared.select("token", "doc_id", "n", "matches", "pos").join(
        classes.withColumnRenamed("vertex", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    left = common.materialize(left, "placed-postings")
    mixed = left.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    mixed = common.materialize(mixed.select("token", "size", F.ceil(F.col("size") / PAIR_GROUP).cast("int").alias("groups")), "mixed")
    opened = common.materialize(common.skew_join(left, mixed, ["token"], "size"), "open-postings")
    common.discard(shared, left, toward, lists)
    # a long list is dealt into groups on one side and copied to each on the other, so no task holds all its pairs
    x = opened.withColumn("part", F.pmod(F.xxhash64("doc_id"), "groups").cast("int")).alias("x")
    y = opened.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).alias("y")
    pairs = x.join(
        y, F.expr("x.token = y.token AND x.part = y.part AND x.doc_id < y.doc_id AND x.component <> y.component AND "
                  + possible(rule, "x.n", "x.pos", "y.n", "y.pos")))
    # a pair passes the position test at its first shared shingle, not at each: count on the pairs that pass once
    once = pairs.select(F.col("y.doc_id").alias("a"), F.col("x.doc_id").alias("b"), F.least("x.matches", "y.matches").alias("ask"))
    once = common.materialize(once.groupBy("a", "b").agg(F.min("ask").alias("ask"), F.count("*").alias("times")), "pairs")
    like = common.materialize(once.join(bitmap_test(once.select("a", "b"), reps, rule), ["a", "b"]), "like-pairs")
    prefixes = reps.select("doc_id", "prefix")
    counted = like.where("times < ask").join(prefixes.select(F.col("doc_id").alias("a"), F.col("prefix").alias("p")), "a").join(
        prefixes.select(F.col("doc_id").alias("b"), F.col("prefix").alias("q")), "b").where(
        F.size(F.array_intersect("p", "q")) >= F.col("ask"))
    ready = common.materialize(like.where("times >= ask").select("a", "b").union(counted.select("a", "b")).distinct(), "open-pairs")
    common.discard(opened, mixed, once, like)
    return hubs.union(verify(ready, documents, rule))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by 85 % of their shingles of four words, with the class that each is in."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), Rule(4, 85))
