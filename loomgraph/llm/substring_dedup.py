"""Operator 11: removal of repeated passages, by a count-min prefilter and an exact second pass."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common

WIDTH = 35
#: words of the grams whose least hash stands for a window in the sketch
GRAM = 16
#: bytes of text a block holds before the next document starts a new one
BLOCK_BYTES = 2_000_000
#: of their compression: a block is written once and sent twice
LEVEL = 5
#: rows of the sketch, its cells for each gram that may be counted, and the cells of one segment
DEPTH, SPREAD, SEGMENT = 2, 8, 1 << 20
#: windows that one group of the exact pass holds at most, on average
GROUP = 1 << 20
#: bytes whose powers are held at once, and windows whose grams are
PIECE, SLICE = 1 << 20, 100_000

BASE = 0x9E3779B97F4A7C15 | 3
BYTE = common.mix(np.arange(1, 257, dtype=np.uint64))
SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size, base, np.uint64))))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start:end], from prefix sums over pieces of whole words."""
    found = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + PIECE, side="right")))
        part = data[start[lo] : end[hi - 1]]
        size = max(PIECE, len(part))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[part] * _powers(BASE, size)[: len(part)])))
        a, b = start[lo:hi] - start[lo], end[lo:hi] - start[lo]
        found[lo:hi] = common.mix((sums[b] - sums[a]) * _powers(pow(BASE, -1, 1 << 64), size)[a] + (b - a).astype(np.uint64))
        lo = hi
    return found


def rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hashes of every k consecutive entries of h, by doubling."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    run, size, found, width = h, 1, None, 0
    while True:
        by = np.uint64(pow(base, size, 1 << 64))
        if k & size:
            found = run if found is None else found[: len(h) - width - size + 1] * by + run[width : len(h) - size + 1]
            width += size
        if size * 2 > k:
            return common.mix(found[: len(h) - k + 1])
        run = run[:-size] * by + run[size:]
        size *= 2


class Words:
    """The words of some texts, end to end, and the windows that lie within one text."""

    def __init__(self, texts: list[bytes], width: int) -> None:
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        edge = np.diff((~SPACE[data]).view(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        #: number of words up to the end of each text
        self.ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
        self.hash = word_hashes(data, start, end)
        whose = np.repeat(self.ends, np.diff(self.ends, prepend=0))
        first = np.arange(max(0, len(start) - width + 1))
        #: first words of all windows
        self.windows = first[first + width <= whose[: len(first)]]
        self.width = width

    def hashes(self, which: np.ndarray, salt: int) -> np.ndarray:
        return rolling(common.mix(self.hash + np.uint64(salt)), self.width, BASE + 8 * salt)[which]

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word of the gram that stands for each window, gram hashes): the first least hash within it."""
        found = rolling(self.hash, size, BASE)
        at = np.empty(len(self.windows), np.int64)
        seen = sliding_window_view(found, self.width - size + 1) if len(self.windows) else None
        for lo in range(0, len(at), SLICE):
            which = self.windows[lo : lo + SLICE]
            at[lo : lo + SLICE] = which + seen[which].argmin(axis=1)
        return at, found


def _cells(grams: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cells of a row of the sketch, marked with the row."""
    return (common.mix(grams + np.uint64((row + 1) * 0x51ED2701)) >> np.uint64(64 - bits)) | np.uint64(row << 56)


def _twice_at_most(keys: np.ndarray) -> np.ndarray:
    """Sorted keys, each once or, if it repeats, twice: what a merger needs of them."""
    found, times = np.unique(keys, return_counts=True)
    return np.repeat(found, np.minimum(times, 2))


def _runs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal pairs together and, along it, each pair's place among its equals and their number."""
    order = np.lexsort((pairs["b"], pairs["a"]))
    a, b = pairs["a"][order], pairs["b"][order]
    start = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    size = np.diff(np.append(start, len(order)))
    return order, np.arange(len(order)) - np.repeat(start, size), np.repeat(size, size)


def _blocks(block_bytes: int):
    """Rows of about block_bytes of text each: number, words, and the documents as a compressed Arrow stream."""

    def block(number, ids, texts):
        rows = pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.binary())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
            out.write_batch(rows)
        words = sum(len(t.split()) for t in texts)
        return pa.record_batch({"block": pa.array([number]), "words": pa.array([words]), "body": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= block_bytes:
                    yield block(number, ids, texts)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield block(number, ids, texts)

    return make


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes], list[bytes]]]:
    """(block, doc ids, texts, what came back for the block)."""
    for batch in batches:
        for row in range(batch.num_rows):
            body = pa.ipc.open_stream(batch.column("body")[row].as_py()).read_next_batch()
            back = batch.column("keys")[row].as_py() if "keys" in batch.schema.names else None
            yield batch.column("block")[row].as_py(), body.column(0).to_pylist(), body.column(1).to_pylist(), back or []


def _sent(block: int, group: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """One row for each group of keys, which come sorted by group."""
    cut = np.flatnonzero(np.diff(group, prepend=group[0] - 1)).tolist() + [len(group)]
    parts = [keys[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
    return pa.record_batch({"group_no": pa.array(group[cut[:-1]].astype(np.int64)), "block": pa.array([block] * len(parts), pa.int64()), "keys": pa.array(parts, pa.binary())})


SENT, BACK = "group_no long, block long, keys binary", "block long, keys binary"


def _answered(rows: pd.DataFrame) -> pd.DataFrame:
    """What a group says to its blocks: those of their windows that all its blocks together hold twice or more."""
    lists = [np.frombuffer(k, PAIR) for k in rows["keys"]]
    pairs = np.concatenate(lists)
    order, _, times = _runs(pairs)
    often = np.empty(len(pairs), bool)
    often[order] = times > 1
    ends = np.cumsum([len(x) for x in lists])
    # only the first half of a hash goes back: within a block it tells windows apart
    back = [np.unique(x["a"][often[e - len(x) : e]]).tobytes() for x, e in zip(lists, ends, strict=True)]
    some = [bool(b) for b in back]
    return pd.DataFrame({"block": rows["block"][some].to_numpy(), "keys": list(compress(back, some))})


def _merged(segment: int):
    """Adds the sketches that blocks sent for one segment, and tells each block which of its cells count two or more."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(k, "<u8") for k in rows["keys"]]
        local = [(x & np.uint64(segment - 1)).astype(np.int64) for x in lists]
        cells = np.bincount(np.concatenate(local), minlength=segment)
        back = [np.unique(x[cells[at] > 1]).tobytes() for x, at in zip(lists, local, strict=True)]
        some = [bool(b) for b in back]
        return pd.DataFrame({"block": rows["block"][some].to_numpy(), "keys": list(compress(back, some))})

    return merge


def _held(back: list[bytes]) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(back), "<u8"))


def _in(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(keys), bool)
    return held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys


def remove_repeats(documents: DataFrame, width: int = WIDTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, spread: int = SPREAD,
                   segment: int = SEGMENT, group_windows: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_removed, text, spans) for every row of documents (doc_id, text): words of windows of `width`
    words that also start elsewhere, in the same text or another, are removed; spans are the runs of words removed
    [first, end); what is left is joined by one space.

    Documents are written once, as compressed blocks; each block is told, in two passes, what it needs to know.  First a
    count-min sketch: for every window its least gram (`gram` words, by hash) is counted; equal windows have equal least
    grams at equal distances, so no window occurs more often than its gram.  Blocks send their sketches by segment; the
    segments add them up and tell each block its cells that count two or more.  Then the blocks send the windows all of
    whose cells do, by 128-bit hash, and are told those that occur twice.  A group holds a segment, or about
    group_windows windows, however large the table; a window that stands in many documents is sent once or twice a block.

    A null text has no words; repeated rows are documents of their own (and repeat each other), null ids too; other
    columns take no part; an empty table gives no rows; a text of any length is one document and whole.
    """
    if not 0 < gram <= width:
        raise ValueError("a gram has at least one word and at most a window's")
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    blocks = common.materialize(rows.mapInArrow(_blocks(block_bytes), "block long, words long, body binary"), "blocks")
    words = blocks.agg(F.sum("words")).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a window has a new least gram about every (width - gram + 2) / 2 words
    cells = spread * words * 2 // (width - gram + 2)
    bits = max(segment.bit_length() - 1, int(cells).bit_length())
    groups = max(least, words // group_windows)

    def sketch(batches):
        for block, _, texts, _ in _opened(batches):
            at, hashes = Words(texts, width).grams(gram)
            chosen = hashes[np.unique(at)]
            for row in range(DEPTH if len(chosen) else 0):
                keys = _twice_at_most(_cells(chosen, row, bits))
                yield _sent(block, (keys // np.uint64(segment)).astype(np.int64), keys)

    def ask(batches):
        for block, _, texts, back in _opened(batches):
            found, held = Words(texts, width), _held(back)
            at, hashes = found.grams(gram)
            often = np.ones(len(at), bool)
            for row in range(DEPTH):
                often &= _in(_cells(hashes, row, bits), held)[at]
            which = found.windows[often]
            if len(which):
                pairs = np.empty(len(which), PAIR)
                pairs["a"], pairs["b"] = found.hashes(which, 1), found.hashes(which, 2)
                order, nth, _ = _runs(pairs)
                pairs = pairs[order[nth < 2]]
                group = (pairs["b"] % np.uint64(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                yield _sent(block, group[order], pairs[order])

    def remove(batches):
        for _, ids, texts, back in _opened(batches):
            found, held = Words(texts, width), _held(back)
            edge = np.zeros(len(found.hash) + 1, np.int64)
            if len(held):
                start = found.windows[_in(found.hashes(found.windows, 1), held)]
                edge[start] += 1
                edge[start + width] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            yield _kept(ids, texts, found.ends, gone)

    def told(answers):
        return blocks.join(answers.groupBy("block").agg(F.collect_list("keys").alias("keys")), "block", "left")

    common_cells = common.materialize(blocks.mapInArrow(sketch, SENT).groupBy("group_no").applyInPandas(_merged(segment), BACK), "cells")
    asked = told(common_cells).mapInArrow(ask, SENT)
    common_windows = common.materialize(asked.groupBy("group_no").applyInPandas(_answered, BACK), "windows")
    common.discard(common_cells)
    return told(common_windows).mapInArrow(remove, "doc_id long, n_words long, n_removed long, text string, spans array<struct<first:long,end:long>>")


def _kept(ids: list, texts: list[bytes], ends: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    sizes, removed, kept, spans = [], [], [], []
    lo = 0
    for text, hi in zip(texts, ends.tolist(), strict=True):
        mask = gone[lo:hi]
        edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0)).tolist()
        kept.append(b" ".join(compress(text.split(), (~mask).tolist()) if edge else text.split()))
        sizes.append(hi - lo)
        removed.append(int(mask.sum()))
        spans.append([{"first": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)])
        lo = hi
    return pa.record_batch({
        "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        "text": pa.array(kept, pa.binary()).cast(pa.string()),
        "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))})


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of 35 words taken out of all documents; the text that is left as its SHA-256."""
    found = remove_repeats(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
