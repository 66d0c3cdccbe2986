"""Where the strings of a table stand in long texts: hashes of windows of a whole Arrow batch at once.

A hash of a window is a difference of running sums, so a batch is read once for each width of window.  A sketch of 2^20 bits,
as large for few strings as for many, drops nearly all windows that are none of the strings before anything leaves the
task; what passes meets the strings in a join, which decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT_BITS = 20
#: characters that are hashed at once, rows of an Arrow batch, and strings that are sent to all tasks rather than shuffled
CHARS, ROWS, BROADCAST = 1 << 17, 1000, 1_000_000
#: widths of windows by which strings without regard to words are found; a string goes by the largest that it fills
WIDTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24)
BASE = 0x9E3779B97F4A7C15


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point that in lower case, one for one, and whether it is part of a word (letters, numbers, _)."""
    low = [chr(c).lower() for c in range(0x110000)]
    return np.array([ord(s[0]) for s in low], np.uint32), np.array([chr(c).isalnum() or chr(c) == "_" for c in range(0x110000)])


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.full(n, p % (1 << 64), np.uint64)) for p in (BASE, pow(BASE, -1, 1 << 64)))


def lower(c: Column) -> Column:
    """Lower case one for one, as _classes has it: no letter becomes two, and no sigma knows that it ends a word."""
    return F.lower(F.translate(c, "İΣ", "iσ"))


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of texts, each with a line break behind it, and where each text begins."""
    codes = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return _classes()[0][codes], np.cumsum([0, *(len(t) + 1 for t in texts)])


def string_of(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def running_sums(codes: np.ndarray) -> np.ndarray:
    powers = _powers(1 << max(20, int(len(codes)).bit_length()))[0]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)])])


def hashes(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the windows [a, b), the same wherever a window stands."""
    back = _powers(1 << max(20, int(len(sums) - 1).bit_length()))[1]
    h = (sums[b] - sums[a]) * back[a]
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def hash_of(text: str) -> int:
    codes = codes_of([text])[0][:-1]
    return int(hashes(running_sums(codes), np.array([0]), np.array([len(codes)]))[0])


def _slot(h: int) -> int:
    return h >> (64 - SLOT_BITS)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, chars = 0, 0
    for i, t in enumerate(texts):
        if chars and chars + len(t) > CHARS:
            yield begin, i
            begin, chars = i, 0
        chars += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def windows_found(df: DataFrame, windows: Callable, known: list[int], out: str, value: Callable) -> DataFrame:
    """The columns of df but `text`, and for each window that passes the sketch of known slots one row a text and hash.

    windows(codes) gives arrays of begins and ends, value(codes, a, b, h) the last column, whose name and type are `out`.
    """
    bits = np.zeros(1 << SLOT_BITS, bool)
    bits[known] = True
    packed, keys = np.packbits(bits).tobytes(), [c for c in df.columns if c != "text"]
    kind = pa.string() if out.endswith("string") else pa.int64()

    def find(batches):
        sketch = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            own = batch.select(keys)
            for begin, end in _groups(texts):
                codes, starts = codes_of(texts[begin:end])
                sums = running_sums(codes)
                hits = []
                for a, b in windows(codes):
                    h = hashes(sums, a, b)
                    near = sketch[slots(h)]
                    a, b, h = a[near], b[near], h[near]
                    row = np.searchsorted(starts, a, "right") - 1
                    same = b < starts[row + 1]
                    hits.append([x[same] for x in (row, h, a, b)])
                row, h, a, b = (np.concatenate(x) for x in zip(*hits, strict=True))
                order = np.lexsort((h, row))
                row, h, a, b = (x[order] for x in (row, h, a, b))
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                row, h, a, b = (x[new] for x in (row, h, a, b))
                if len(row):
                    found = own.take(pa.array(row + begin))
                    yield pa.RecordBatch.from_arrays([*found.columns, pa.array(value(codes, a, b, h), kind)], [*keys, out.split()[0]])

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text"), out])
    return df.mapInArrow(find, schema)


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST else df


def words_found(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(columns of texts but text, those of phrases) where a phrase's keyword, in lower case, stands in text between ends of
    words, case apart."""

    @F.pandas_udf("core string, words int, slot int")
    def parts(keywords: pd.Series) -> pd.DataFrame:
        cores = [re.sub(r"^\W+|\W+$", "", k) for k in keywords]
        return pd.DataFrame({"core": cores, "words": [len(re.findall(r"\w+", c)) for c in cores], "slot": [_slot(hash_of(c)) for c in cores]}).astype({"words": "int32", "slot": "int32"})

    # as one that may differ, or the optimizer would hash each place that is found, too
    parts = parts.asNondeterministic()
    asked = phrases.select("*", parts("keyword").alias("p")).select(*phrases.columns, "p.*").where("words > 0")
    # small whatever the number of keywords: a few lengths, and 2^20 slots at most
    known = asked.agg(F.collect_set("words").alias("words"), F.collect_set("slot").alias("slots"), F.count("*").alias("n"), F.coalesce(F.max(F.col("core") != F.col("keyword")), F.lit(False)).alias("marks")).head()
    lengths = sorted(known.words)

    def windows(codes):
        inside = np.concatenate([[False], _classes()[1][codes], [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        a, b = turns[::2], turns[1::2]
        return [(a[: max(0, len(a) - k + 1)], b[k - 1:]) for k in lengths] or [(a[:0], b[:0])]

    strings = lambda codes, a, b, h: [string_of(codes[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    found = windows_found(texts, windows, known.slots, "core string", strings).join(small(asked, known.n), "core")
    keys, own = [c for c in texts.columns if c != "text"], phrases.columns
    bare = found.where("core = keyword").select(*keys, *own)
    if not known.marks:
        return bare
    # marks at an end of a keyword must stand there too, and a word beyond them
    word = r"[\p{L}\p{N}_]"
    edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    pattern = F.concat(F.lit(edge + r"\Q"), "keyword", F.lit(r"\E" + edge))
    sure = found.where("core <> keyword").select(*keys, *own).join(texts.withColumn("text", lower(F.col("text"))), keys).where(F.rlike("text", pattern))
    return bare.unionByName(sure.select(*keys, *own))


def candidates(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(columns of texts but text, item_id, span): texts that may hold a span (item_id, span); none that does is missing.

    A span is found by its first characters, WIDTHS of them at most; case plays no part.
    """

    @F.pandas_udf("width int, slot int, anchor long")
    def parts(asked: pd.Series) -> pd.DataFrame:
        widths = [max(w for w in WIDTHS if w <= len(s)) for s in asked]
        hs = [hash_of(s[:w]) for s, w in zip(asked, widths, strict=True)]
        return pd.DataFrame({"width": widths, "slot": map(_slot, hs), "anchor": map(_signed, hs)}).astype({"width": "int32", "slot": "int32", "anchor": "int64"})

    asked = spans.where("span <> ''").select("item_id", "span", parts.asNondeterministic()("span").alias("p")).select("item_id", "span", "p.*")
    known = asked.agg(F.collect_set("width").alias("widths"), F.collect_set("slot").alias("slots"), F.count("*").alias("n")).head()

    def windows(codes):
        return [((a := np.arange(max(0, len(codes) - w + 1))), a + w) for w in known_widths] or [(np.arange(0), np.arange(0))]

    known_widths = sorted(known.widths)
    anchors = windows_found(texts, windows, known.slots, "anchor long", lambda codes, a, b, h: h.view(np.int64))
    return anchors.join(small(asked.select("item_id", "span", "anchor"), known.n), "anchor").drop("anchor")
