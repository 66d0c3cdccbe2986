"""What the text operators share: table readers, durable intermediate tables, word splitting and hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ODD = np.uint64(0x9E3779B97F4A7C15)
#: entries a task keeps in a word cache before it starts a new one
CACHE_LIMIT = 100_000
#: rows up to which a table of a few numbers a row is broadcast after it was counted; beyond, it is shuffled
BROADCAST_ROWS = 200_000
#: keys that a skewed join may treat alone, and rows under which a key is never skewed
HOT_KEYS, HOT_LEAST = 10_000, 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a session on one machine may go without, and gets one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a short lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again: what was made from them must be written by now."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its rows, which are counted, are few enough."""
    return F.broadcast(df) if df.count() <= rows else df


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """left joined to right (a written table with one row a key), where a few keys may hold most rows of left.

    `weight` is the column of right that counts left's rows of the key.  Keys that hold more than one row in HOT_KEYS
    of left are HOT_KEYS at most, so their rows of right are broadcast, whatever the size of the tables, and left's
    rows of them stay where they are; all others join as Spark chooses.
    """
    bare = right.drop(weight)
    found = right.agg(F.sum(weight).alias("total"), F.max(weight).alias("most")).first()
    bar = max(HOT_LEAST, (found["total"] or 0) // HOT_KEYS)
    if (found["most"] or 0) <= bar:
        return left.join(bare, keys, how)
    hot = F.broadcast(right.where(F.col(weight) > bar).drop(weight))
    cold = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col(weight) <= bar).drop(weight), keys, how)
    return left.join(hot, keys).unionByName(cold)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound the rows of an Arrow batch, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back(spark: SparkSession) -> None:
    """Before a fit on the driver, which has little room beside the JVM: return what Arrow and the JVM hold of tables that
    are gone, with the shuffles and broadcasts of finished queries."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.java.lang.System.gc()


def as_text(value) -> str:
    return value if isinstance(value, str) else ""


def words_of(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8: bytes.split() splits at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split()


class WordHash:
    """64-bit hashes of words, cached per task."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_LIMIT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer, vectorised."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the k-word shingles; the whole sequence is one where it has fewer than k words."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    width = min(k, n)
    acc = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        acc = acc * ODD + hashes[i : n - width + 1 + i]
    return np.unique(mix(acc))


def hash_order(column) -> "F.Column":
    """A fixed pseudo-random order of rows by their id."""
    return F.xxhash64(F.lit("order"), column)


def sampled_labels(labels: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """At most `limit` labelled ids in hash order: the documented bound for fitting a classifier.
    Ids or labels that are null take no part; of repeated ids the smallest labels count."""
    clean = labels.select("doc_id", *columns).dropna()
    best = clean.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("y")).select("doc_id", "y.*")
    return best.orderBy(hash_order(F.col("doc_id")), "doc_id").limit(limit)


def labelled_texts(documents: DataFrame, labels: DataFrame, columns: list[str], limit: int, max_chars: int) -> DataFrame:
    """Texts of the sampled labels, the documented bound for fitting: at most `limit` rows and `max_chars` characters
    together (both hold on the driver, which sees only ids and lengths).  Of a text longer than a hundredth of max_chars
    only that much from its start is fitted on, so no text, wherever it stands in hash order, keeps others out; rows come
    in hash order until the next one would overrun the characters, so at least 99 do if there are so many.  Where an id
    repeats, its smallest text counts."""
    sample = sampled_labels(labels, columns, limit)
    window = max(1, max_chars // 100)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", F.substring("text", 1, window).alias("text"))
    ids = F.broadcast(sample)  # `limit` rows at most
    sizes = texts.select("doc_id", F.length("text").alias("size")).join(ids, "doc_id").select("doc_id", "size")
    sizes = sizes.groupBy("doc_id").agg(F.max("size").alias("size"))
    rows = sorted(sizes.withColumn("h", hash_order(F.col("doc_id"))).collect(), key=lambda r: (r.h, r.doc_id))
    upto = np.cumsum([r["size"] for r in rows], dtype=np.int64)
    chosen = [(r.doc_id,) for r in rows[: int(np.searchsorted(upto, max_chars, side="right"))]]
    kept = documents.sparkSession.createDataFrame(chosen, "doc_id bigint")
    found = texts.join(F.broadcast(ids.join(kept, "doc_id")), "doc_id")
    return found.groupBy("doc_id", *columns).agg(F.min("text").alias("text")).select("doc_id", "text", *columns)


def frames(batches: Iterable[pd.DataFrame], make) -> Iterable[pd.DataFrame]:
    """Apply make to every batch that has rows."""
    for batch in batches:
        if len(batch):
            yield make(batch)
