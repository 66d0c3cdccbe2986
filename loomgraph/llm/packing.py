"""Operator 6: best-fit packing of tokenised documents into sequences of fixed capacity (best-two-fit)."""

from __future__ import annotations

import json
import os
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import common

CAPACITY, END_ID = 4096, 1
TOKENIZER = "word_bpe_49k.json"
#: chunks a task keeps (about 200 bytes each)
CACHED = 500_000
#: closing marks, and the letters of the Latin blocks but U+0130, for words put together from cached parts
MARKS, LATIN = ".,;:!?", "A-Za-zÀ-ÖØ-öø-\u012f\u0131-\u024f"
#: a control character that stands between chunks that are tokenised in a line; chunks that hold it are taken alone
BETWEEN, IN_A_LINE = "\x01", 64
#: what TOKENIZER does before its model; other tokenizers get every chunk as it is
BEFORE_MODEL = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: texts that are tokenised at once, bytes up to which Arrow batches are put together for it, and tasks up to which their
#: counts are broadcast (32 kB each)
TEXTS_AT_ONCE, BYTES_AT_ONCE, BROADCAST_TASKS = 1_000, 1 << 23, 2_000


def strings(array: pa.Array) -> list[str]:
    """The strings of an array without nulls: to_pylist, which makes a scalar of each first, takes about six times as long."""
    return array.to_numpy(zero_copy_only=False).tolist()


class ChunkTokenizer:
    """Token ids of texts, with the ids of each chunk between ASCII white space cached.

    Valid for tokenizers whose pre-tokenizer never lets a token cross white space, and drops it.  Texts are split and
    their chunks numbered in Arrow, so Python sees each distinct chunk of a batch once.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        (self.between,) = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        #: whether Latin words are lower-cased and parted from marks, and else reach the model as they are
        self.parts = {k: json.loads(self.tokenizer.to_str())[k] for k in BEFORE_MODEL} == BEFORE_MODEL
        # the same model for words that need no more than to be parted at white space
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.start, self.size, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, np.uint32)
        #: batches that held a chunk since the cache was last made smaller
        self.used = np.zeros(1, np.int32)

    def _forget(self) -> None:
        """Keep what more than one batch held since the last time, at most a quarter of the cache, the commonest first."""
        often = np.flatnonzero(self.used > 1)
        often = np.sort(often[np.argsort(-self.used[often], kind="stable")[: CACHED // 4]])
        often = often[often > 0]
        words, size, flat = list(self.index), self.size[often], self._gather(often)
        self.clear()
        self._add([words[i] for i in often.tolist()], size, flat)

    def _learn(self, words: pa.Array, new: list[str]) -> np.ndarray:
        """Put the ids of these chunks, given twice, into the cache, and return their entries.

        A Latin word with capitals or closing marks is put together from the lower-case word and the marks, which
        the pre-tokenizer parts as well; lower-case words go to the model at once, everything else through the
        tokenizer as it is.
        """
        if not self.parts:
            self._encode(new)
            return np.arange(len(self.index) - len(new), len(self.index))
        parted = pc.extract_regex(words, f"^(?P<core>[{LATIN}]+)(?P<marks>[{MARKS}]*)$")
        core = pc.utf8_lower(pc.struct_field(parted, "core"))
        built, odd = pc.fill_null(pc.not_equal(core, words), False), pc.is_null(core)
        cores, marks = core.filter(built).dictionary_encode(), pc.struct_field(parted, "marks").filter(built).dictionary_encode()
        core_words, mark_words = strings(cores.dictionary), strings(marks.dictionary)
        self._encode([*strings(words.filter(odd)), *(m for m in set(mark_words).difference(self.index))])
        whole = pc.invert(pc.or_(built, odd))
        self._encode(list(set(strings(words.filter(whole))).union(core_words).difference(self.index)), self.plain)
        at = np.stack([self._entries(core_words)[cores.indices.to_numpy()], self._entries(mark_words)[marks.indices.to_numpy()]], axis=1)
        self.used[at] += 1
        made = built.to_numpy(zero_copy_only=False)
        entries = np.empty(len(new), np.int64)
        entries[made] = np.arange(len(self.index), len(self.index) + len(at))
        self._add(strings(words.filter(built)), self.size[at].sum(axis=1), self._gather(at.ravel()))
        entries[~made] = self._entries([new[i] for i in np.flatnonzero(~made).tolist()])
        return entries

    def _encode(self, words: list[str], tokenizer=None) -> None:
        """Tokenise chunks, many to a line with a mark between them whose id no other chunk gives."""
        words = [*(odd := [w for w in words if BETWEEN in w]), *(plain := [w for w in words if BETWEEN not in w])]
        lines = odd + [f" {BETWEEN} ".join(plain[i : i + IN_A_LINE]) for i in range(0, len(plain), IN_A_LINE)]
        made = [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(made), np.uint32)
        end = np.cumsum([len(m) for m in made], dtype=np.int64)
        first = int(end[len(odd) - 1]) if odd else 0
        mark = first + np.flatnonzero(ids[first:] == self.between)
        # a chunk ends at a mark or at the end of its line
        stop = np.sort(np.concatenate([mark, end]))
        start = np.concatenate([[0], stop[:-1]]) + np.concatenate([[0], np.isin(stop[:-1], mark)]).astype(np.int64)
        self._add(words, stop - start, np.delete(ids, mark))

    def _add(self, words: list[str], size: np.ndarray, flat: np.ndarray) -> None:
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int32)])

    def _entries(self, words: list[str]) -> np.ndarray:
        """Cache entries of chunks; -1 for those it lacks."""
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """Ids of these cache entries, one after the other."""
        size = self.size[at]
        before = np.cumsum(size) - size
        return self.flat[np.repeat(self.start[at] - before, size) + np.arange(int(size.sum()))]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        chunks = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        count = pc.list_value_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
        numbered = chunks.flatten().dictionary_encode()
        words = strings(numbered.dictionary)
        if len(self.index) > CACHED:
            self._forget()
        known = self._entries(words)
        missing = np.flatnonzero(known < 0)
        if len(missing):
            known[missing] = self._learn(numbered.dictionary.take(pa.array(missing)), [words[i] for i in missing.tolist()])
        self.used[known] += 1
        at = known[numbered.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
        before = np.concatenate([[0], np.cumsum(self.size[at])])
        end = np.cumsum(count)
        return self._gather(at), before[end] - before[end - count]


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> ChunkTokenizer:
    """One tokenizer a worker process, so that its tasks share the cache."""
    return ChunkTokenizer(path)


PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("token_ids", pa.binary()),
    ("task", pa.int32()), ("rank", pa.int64())])


def numbered_within(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How often each value stood before, here or in what `seen` has counted; `seen` is brought up to date."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    nth = np.arange(len(values)) - np.searchsorted(ordered, ordered)
    out = np.empty(len(values), np.int64)
    out[order] = nth
    out += seen[values]
    seen += np.bincount(values, minlength=len(seen))
    return out


def put_together(batches: Iterable[pa.RecordBatch], rows: int, size: int) -> Iterable[pa.RecordBatch]:
    """Batches of up to `rows` rows and `size` bytes from smaller ones; larger ones pass as they are."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if held and (sum(map(len, held)) + len(b) > rows or sum(x.nbytes for x in held) + b.nbytes > size):
            yield pa.concat_batches(held)
            held = []
        held.append(b)
    if held:
        yield pa.concat_batches(held)


def cut(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most `capacity` tokens: doc_id, piece, start, length, token_ids (little-endian uint32), the task
    that made them, and their rank among the task's earlier pieces of the same length."""

    def make(batches):
        tokenizer, task, seen = tokenizer_of(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for whole in put_together(batches, TEXTS_AT_ONCE, BYTES_AT_ONCE):
            for lo in range(0, len(whole), TEXTS_AT_ONCE):
                b = whole.slice(lo, TEXTS_AT_ONCE)
                ids, size = tokenizer.batch(b.column("text").fill_null(""))
                ids = np.insert(ids, np.cumsum(size), end_id).astype("<u4")
                size = size + 1
                pieces = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(size[doc] - piece * capacity, capacity)
                offsets = pa.array(np.concatenate([[0], 4 * np.cumsum(length)]), pa.int32())
                token_ids = pa.Array.from_buffers(pa.binary(), len(doc), [None, offsets.buffers()[1], pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(length), token_ids,
                    pa.array(np.full(len(doc), task, np.int32)), pa.array(numbered_within(length, seen))], schema=PIECES)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        make, "doc_id long, piece int, start long, length long, token_ids binary, task int, rank long"
    )


def best_two_fit(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Plan bins from counts[length].  Returns rows (length, first rank, copies a bin, first bin, first offset).

    A bin takes the longest piece left, then ever the longest that still fits.  After that its smallest piece is
    replaced by the two unpacked pieces whose sum fits the widened gap best, if they fill it more.  The pattern so
    found is used as often as the counts allow, so the work follows the number of lengths, not of pieces.
    """
    left = counts.astype(np.int64).copy()
    rank = np.zeros(capacity + 1, np.int64)
    live = [int(x) for x in np.flatnonzero(left)]
    plan, bins = [], 0
    while live:
        used: dict[int, int] = {}
        gap = capacity
        at = len(live) - 1
        while gap and at >= 0:
            at = min(at, bisect_right(live, gap) - 1)
            if at < 0:
                break
            take = min(gap // live[at], int(left[live[at]]))
            used[live[at]] = take
            gap -= take * live[at]
            at -= 1
        while gap and (len(used) > 1 or sum(used.values()) > 1):
            pair = _tightest_pair(live, left, used, gap)
            if pair is None:
                break
            small = min(used)
            gap += small - sum(pair)
            used[small] -= 1
            if not used[small]:
                del used[small]
            for x in pair:
                used[x] = used.get(x, 0) + 1
        times = min(int(left[x]) // k for x, k in used.items())
        offset = 0
        for x, k in sorted(used.items(), reverse=True):
            plan.append((x, rank[x], k, bins, offset))
            offset += x * k
            rank[x] += k * times
            left[x] -= k * times
            if not left[x]:
                live.remove(x)
        bins += times
    return np.array(plan, np.int64).reshape(-1, 5)


def _tightest_pair(live: list[int], left: np.ndarray, used: dict[int, int], gap: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum above the bin's smallest and up to the gap it would leave."""
    small = min(used)
    room = gap + small
    size = np.array(live[: bisect_right(live, room - 1)], np.int64)
    free = left[size] - np.array([used.get(int(x), 0) for x in size], np.int64)
    size, free = size[free > 0], free[free > 0]
    if not len(size):
        return None
    other = np.searchsorted(size, room - size, side="right") - 1
    same = (other >= 0) & (size[other] == size) & (free < 2)
    other[same] -= 1
    total = np.where(other >= 0, size + size[other], 0)
    best = int(total.argmax())
    return (int(size[best]), int(size[other[best]])) if total[best] > small else None


def place(length: np.ndarray, rank: np.ndarray, plan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of the rank-th piece of each length."""
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    row = plan[np.searchsorted(plan[:, 0] * (1 << 48) + plan[:, 1], length * (1 << 48) + rank, side="right") - 1]
    nth = rank - row[:, 1]
    return row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * length


def pack(documents: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack documents (doc_id, text): one row per piece with token_ids, sequence_id and offset.

    A null text counts as empty, which is the end token alone; repeated rows and null ids are packed like any
    other; other columns are not read.  The driver sees only the number of pieces of each length (at most
    `capacity` numbers) and sends back a plan of at most a few rows a length.  Ranks within a length come from
    per-task counts, so no length is gathered in one task.  A task's counts are one row of `capacity` numbers; these
    rows are broadcast up to BROADCAST_TASKS, beyond that pieces meet them by a shuffle on the task.
    """
    spark = documents.sparkSession
    common.small_batches(spark)
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    pieces = common.materialize(cut(documents, path, capacity, end_id), "pieces")
    made = common.materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    plan = best_two_fit(counts, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = made.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def in_a_row(own: pd.DataFrame) -> pd.DataFrame:
        base = np.zeros(capacity + 1, np.int64)
        base[own.length] = own.base
        return pd.DataFrame({"task": own.task.iloc[:1], "bases": [base]})

    # one row a task, of at most `capacity` numbers
    bases = common.materialize(offsets.groupBy("task").applyInPandas(in_a_row, "task int, bases array<long>"), "bases")
    ranked = pieces.join(common.broadcast_if_small(bases, BROADCAST_TASKS), "task")
    ranked = ranked.select(*pieces.columns, (F.col("rank") + F.element_at("bases", F.col("length").cast("int") + 1)).alias("nth"))
    kept = ["doc_id", "piece", "start", "length", "token_ids"]

    def assign(batches):
        for b in batches:
            seq, off = place(b.column("length").to_numpy(), b.column("nth").to_numpy(), plan)
            yield pa.RecordBatch.from_arrays([*map(b.column, kept), pa.array(seq), pa.array(off)], names=[*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "nth").mapInArrow(
        assign, "doc_id long, piece int, start long, length long, token_ids binary, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4,096 tokens; null texts are packed as empty ones."""
    packed = pack(common.table(spark, sf_dir, "documents"))
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "sequence_id", "offset"
    )
