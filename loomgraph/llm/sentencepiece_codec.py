"""Operator 7: SentencePiece encoding and decoding with seeded merge-dropout."""

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomgraph.llm import common

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
DROPOUT, SEED = 0.1, 13
NEVER = np.iinfo(np.int32).max
#: parts up to this length are merged side by side; longer ones alone
SHORT = 48
#: parts a worker remembers (about 400 bytes each) before it starts anew
PARTS = 150_000
#: parts that are merged side by side at once
SIDE_BY_SIDE = 10_000
PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PairTable:
    """The piece that two neighbouring pieces merge to, by open addressing over (left id, right id)."""

    EMPTY = -1

    def __init__(self, ids: dict[str, int]) -> None:
        found = {}
        for piece, merged in ids.items():
            for i in range(1, len(piece)):
                left, right = ids.get(piece[:i]), ids.get(piece[i:])
                if left is not None and right is not None:
                    found[left << 32 | right] = merged
        self.bits = max(4, (4 * len(found)).bit_length())
        self.keys = np.full((1 << self.bits) + 64, self.EMPTY, np.int64)
        self.values = np.full((1 << self.bits) + 64, -1, np.int32)
        slots = self._slot(np.array(list(found), np.int64)).tolist()
        for slot, (key, merged) in zip(slots, found.items(), strict=True):
            while self.keys[slot] != self.EMPTY:
                slot += 1
            self.keys[slot], self.values[slot] = key, merged

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * common.ODD >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids; -1 where the two do not merge."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        there = self.keys[slot]
        out = self.values[slot]
        other = np.flatnonzero((there != key) & (there != self.EMPTY))
        out[there != key] = -1
        while len(other):
            slot[other] += 1
            there = self.keys[slot[other]]
            hit = there == key[other]
            out[other[hit]] = self.values[slot[other[hit]]]
            other = other[~hit & (there != self.EMPTY)]
        return out


class Ragged:
    """Rows of numbers of different lengths that grow at the end."""

    def __init__(self, dtype) -> None:
        self.flat, self.used = np.empty(1024, dtype), 0
        self.start, self.size, self.rows = np.empty(1024, np.int64), np.empty(1024, np.int64), 0

    def add(self, values: np.ndarray, size: np.ndarray) -> None:
        for name, new, at in (("flat", values, self.used), ("start", self.used + np.cumsum(size) - size, self.rows), ("size", size, self.rows)):
            old = getattr(self, name)
            if at + len(new) > len(old):
                old = np.concatenate([old, np.empty(len(old) + len(new), old.dtype)])
                setattr(self, name, old)
            old[at : at + len(new)] = new
        self.used, self.rows = self.used + len(values), self.rows + len(size)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these rows one after the other, and the rows' sizes."""
        size = self.size[rows]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.flat[np.repeat(self.start[rows] - (end - size), size) + np.arange(total)], size


class MergeCodec:
    """Merges by score with an agenda; decoding joins pieces and bytes back to the text.

    In this kind of model no piece has a space mark after another character, so a text falls apart before each run
    of space marks and the parts are encoded alone.  When a candidate merge (a piece within the part, by its left end
    and its length) comes to the top of the agenda, it is skipped, once and for all, if the keyed hash of (seed,
    document key, the part's number, left end, length) falls below `dropout`: each occurrence draws its own.

    Agendas are worked off side by side, a row of an array for each part.  What a part gives without skips, and the
    candidates that come to the top meanwhile, is remembered; an occurrence for which none of these is skipped takes
    that, any other works off its own agenda.  Remembering decides nothing.
    A space mark in the text itself is written as bytes, so that decoding gives it back; but for that, encoding
    without dropout is that of the library.
    """

    def __init__(self, path: str, dropout: float = 0.0, seed: int = 0) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.special = {i for i in range(len(self.pieces)) if model.is_control(i) or model.is_unknown(i)}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.id = {p: i for i, p in enumerate(self.pieces) if i not in self.special and i not in self.byte_of}
        costs = sorted({-model.get_score(i) for i in self.id.values()})
        place = {c: k for k, c in enumerate(costs)}
        self.cost = {p: place[-model.get_score(i)] for p, i in self.id.items()}
        # by id; the last entry is for a pair that does not merge (id -1)
        self.rank = np.full(len(self.pieces) + 1, NEVER, np.int32)
        for p, i in self.id.items():
            self.rank[i] = self.cost[p]
        self.merged = PairTable(self.id)
        # symbol of a single character: its piece, or a number of its own beyond all pieces
        self.beyond = len(self.pieces)
        self.letter = np.arange(self.beyond, self.beyond + 0x110000, dtype=np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.letter[ord(p)] = i
        self.dropout, self.seed = dropout, seed
        self.floor = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
        self.stride = max(map(len, self.id)) + 1  # a candidate's code is left end * stride + length
        space = [p.replace(SPACE, " ") for p in self.pieces]
        self.shown = pa.array(["" if i in self.special else p for i, p in enumerate(space)])
        self.is_byte = np.array([i in self.byte_of for i in range(len(space))], bool)
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}  # -1: a part to be merged alone
        self.letters, self.plain, self.asked = Ragged(np.int32), Ragged(np.int32), Ragged(np.int32)

    def encode(self, text: str, key: int = 0) -> list[int]:
        """Ids of the whole text; empty for the empty text."""
        return self.encode_batch([text], [key])[0].tolist()

    def encode_batch(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Ids of each text under its key."""
        ids, size = self.encode_flat(texts, keys)
        return np.split(ids, np.cumsum(size)[:-1])

    def encode_flat(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts under their keys one after the other, and how many each has."""
        parts = [self._parts(t) for t in texts]
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        if not count.sum():
            return np.empty(0, np.int32), count
        if len(self.rows) > PARTS:
            self._clear()
        flat = [p for own in parts for p in own]
        self._learn(list(set(flat).difference(self.rows)))
        row = np.fromiter(map(self.rows.__getitem__, flat), np.int64, len(flat))
        key = np.array([self._key(str(k)) for k in keys], np.uint64)
        start = np.cumsum(count) - count
        number = (np.arange(1, len(flat) + 1) - np.repeat(start, count)).astype(np.uint64)
        own = common.mix(number * common.ODD + np.repeat(key, count))
        ids, size = self._encoded(row, own, flat)
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, total[start + count] - total[start]

    def _encoded(self, row: np.ndarray, own: np.ndarray, flat: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all occurrences one after the other, and how many each has."""
        short = np.flatnonzero(row >= 0)
        drawn = short[self._any_skip(row[short], own[short])] if self.dropout else short[:0]
        same = np.ones(len(row), bool)
        same[drawn] = same[row < 0] = False
        groups = [(np.flatnonzero(same), *self.plain.take(row[same]))]
        groups += [(drawn[at], ids, size) for at, ids, size, _, _ in self._side_by_side(row[drawn], own[drawn])]
        alone = np.flatnonzero(row < 0)
        if len(alone):
            mark = [self.byte[b] for b in SPACE.encode()]
            made = [np.array(self._ids(self._merge(flat[i], self._skipped(flat[i], own[i]))) if flat[i] else mark, np.int32) for i in alone.tolist()]
            groups.append((alone, np.concatenate(made), np.fromiter(map(len, made), np.int64, len(made))))
        size = np.zeros(len(row), np.int64)
        for at, _, n in groups:
            size[at] = n
        first = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        for at, ids, n in groups:
            end = np.cumsum(n)
            out[np.repeat(first[at] - (end - n), n) + np.arange(len(ids))] = ids
        return out, size

    @staticmethod
    def _parts(text: str) -> list[str]:
        """Runs of space marks with what follows them; an empty part stands for a space mark of the text itself."""
        if not text:
            return []
        literal = text.split(SPACE)
        parts = PART.findall(SPACE + literal[0].replace(" ", SPACE))
        for piece in literal[1:]:
            parts.append("")
            parts.extend(PART.findall(piece.replace(" ", SPACE)))
        return parts

    def _key(self, text: str) -> int:
        return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), self.seed)

    def _skips(self, own, code: np.ndarray) -> np.ndarray:
        return common.mix(own + (code + 1).astype(np.uint64) * common.ODD) < self.floor

    def _any_skip(self, row: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether a candidate is skipped that comes to the top when none is."""
        code, size = self.asked.take(row)
        skip = np.concatenate([[0], np.cumsum(self._skips(np.repeat(own, size), code))])
        end = np.cumsum(size)
        return skip[end] > skip[end - size]

    def _learn(self, new: list[str]) -> None:
        """Remember these parts with their letters, and what they give without skips."""
        if not new:
            return
        size = np.fromiter(map(len, new), np.int64, len(new))
        letter = self.letter[np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), "<u4")]
        alone = (size > SHORT) | (size == 0)
        first = self.letters.rows
        rows = np.where(alone, -1, first + np.cumsum(~alone) - 1)
        self.rows.update(zip(new, rows.tolist(), strict=True))
        self.letters.add(letter[np.repeat(~alone, size)], size[~alone])
        # rows of plain and asked must come in the order of letters
        n = self.letters.rows - first
        found = list(self._side_by_side(np.arange(first, first + n), None))
        for store, values, sizes in ((self.plain, 1, 2), (self.asked, 3, 4)):
            length, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
            flat, used = [np.empty(0, np.int32)], 0
            for group in found:
                length[group[0]] = group[sizes]
                starts[group[0]] = used + np.cumsum(group[sizes]) - group[sizes]
                flat.append(group[values])
                used += len(group[values])
            end = np.cumsum(length)
            store.add(np.concatenate(flat)[np.repeat(starts - (end - length), length) + np.arange(used)], length)

    def _side_by_side(self, row: np.ndarray, own: np.ndarray | None):
        """Work off the agendas of remembered parts; own None: without skips.  Yields (positions in row, ids, how many
        each has, candidates that came to the top, how many)."""
        size = self.letters.size[row]
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 20), (20, SHORT)):
            among = np.flatnonzero((size > low) & (size <= high))
            for lo in range(0, len(among), SIDE_BY_SIDE):
                at = among[lo : lo + SIDE_BY_SIDE]
                yield at, *self._agendas(row[at], None if own is None else own[at], high)

    def _agendas(self, row: np.ndarray, own: np.ndarray | None, length: int):
        letters, size = self.letters.take(row)
        n, width = len(row), length + 1
        cell = np.arange(length + 1) < size[:, None]  # the last column is empty, so every symbol has a next cell
        symbol = np.full((n, width), -1, np.int32)
        symbol[cell] = letters
        pair = cell[:, 1:] & cell[:, :-1]
        merged = np.full((n, width), -1, np.int32)
        merged[:, :-1][pair] = self.merged(symbol[:, :-1][pair], symbol[:, 1:][pair])
        agenda = self.rank[merged]
        after = np.tile(np.arange(1, width + 1, dtype=np.int64), (n, 1))  # where the next symbol starts
        before = after - 2
        asked = np.empty((n, 4 * length), np.int32)
        times = np.zeros(n, np.int64)
        symbol, merged, agenda, after, before = (a.ravel() for a in (symbol, merged, agenda, after, before))
        live = np.flatnonzero(size > 1)
        while len(live):
            top = agenda.reshape(n, width)[live].argmin(axis=1)
            base = live * width
            here = base + top
            going = agenda[here] != NEVER
            live, base, here, top = live[going], base[going], here[going], top[going]
            right = after[here]
            beyond = after[base + right]
            code = top * self.stride + (beyond - top)
            if own is None:
                asked[live, times[live]] = code
                times[live] += 1
            else:
                skip = self._skips(own[live], code)
                agenda[here[skip]] = NEVER
                go = ~skip
                base, here, right, beyond = base[go], here[go], right[go], beyond[go]
            symbol[here] = merged[here]
            symbol[base + right] = -1
            agenda[base + right] = NEVER
            after[here] = beyond
            before[base + np.minimum(beyond, length)] = here - base
            ahead = before[here]
            # the new symbol with the next one, and the one before with the new symbol
            wide = symbol[base + np.minimum(beyond, length)]
            left = np.flatnonzero(ahead >= 0)
            lead = base[left] + ahead[left]
            one = np.concatenate([symbol[here], symbol[lead]])
            two = np.concatenate([wide, symbol[here[left]]])
            spot = np.concatenate([here, lead])
            known = two >= 0
            m = np.full(len(spot), -1, np.int32)
            m[known] = self.merged(one[known], two[known])
            merged[spot] = m
            agenda[spot] = self.rank[m]
        symbol = symbol.reshape(n, width)
        kept = symbol >= 0
        tops = asked[np.arange(4 * length) < times[:, None]] if own is None else None
        return *self._spelled(symbol[kept], kept.sum(axis=1)), tops, times

    def _spelled(self, symbol: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, with the bytes of those characters that have no piece; and how many each row has then."""
        odd = np.flatnonzero(symbol >= self.beyond)
        if not len(odd):
            return symbol, count
        known, which = np.unique(symbol[odd], return_inverse=True)
        spelled = Ragged(np.int32)
        ids = [[self.byte[b] for b in chr(k - self.beyond).encode("utf-8", "surrogatepass")] for k in known.tolist()]
        spelled.add(np.concatenate(ids).astype(np.int32), np.fromiter(map(len, ids), np.int64, len(ids)))
        put, times = spelled.take(which)
        size = np.ones(len(symbol), np.int64)
        size[odd] = times
        out = np.repeat(symbol, size)
        out[out >= self.beyond] = put
        end = np.cumsum(count)
        total = np.concatenate([[0], np.cumsum(size)])
        return out, total[end] - total[end - count]

    def _skipped(self, part: str, own: np.uint64) -> frozenset[int]:
        """The skipped ones of all pieces within a part."""
        if not self.dropout:
            return frozenset()
        known, n = self.cost, len(part)
        code = np.array([i * self.stride + k for i in range(n - 1) for k in range(2, min(self.stride - 1, n - i) + 1) if part[i : i + k] in known], np.int64)
        return frozenset(code[self._skips(own, code)].tolist())

    def _merge(self, part: str, skip: frozenset[int]) -> list[str]:
        """The agenda of one part as a heap, for parts of any length and characters."""
        symbols: list[str | None] = list(part)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        get, push, width = self.cost.get, heapq.heappush, self.stride
        agenda = [(c, i, i + 1, part[i : i + 2]) for i in range(n - 1) if (c := get(part[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, merged = heapq.heappop(agenda)
            if symbols[right] is None or symbols[left] is None or after[left] != right or len(symbols[left]) + len(symbols[right]) != len(merged):
                continue
            if left * width + len(merged) in skip:
                continue
            symbols[left], symbols[right] = merged, None
            beyond = after[left] = after[right]
            if beyond >= 0:
                before[beyond] = left
                wider = merged + symbols[beyond]
                if (c := get(wider)) is not None:
                    push(agenda, (c, left, beyond, wider))
            ahead = before[left]
            if ahead >= 0:
                wider = symbols[ahead] + merged
                if (c := get(wider)) is not None:
                    push(agenda, (c, ahead, left, wider))
        return [s for s in symbols if s is not None]

    def _ids(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            i = self.id.get(s)
            if i is not None:
                out.append(i)
            else:
                out.extend(self.byte[b] for b in s.encode("utf-8", "surrogatepass"))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text: space marks of pieces become spaces, bytes are joined, and the space put in front is taken off."""
        return self.decode_flat(np.asarray(ids, np.int32), np.array([len(ids)]))[0].as_py()

    def decode_flat(self, flat: np.ndarray, size: np.ndarray) -> pa.Array:
        """Texts of ids that stand one after the other, so many each."""
        end = np.concatenate([[0], np.cumsum(size)])
        lists = pa.ListArray.from_arrays(pa.array(end, pa.int32()), self.shown.take(pa.array(flat)))
        out = pc.binary_join(lists, "")
        odd = np.concatenate([[0], np.cumsum(self.is_byte[flat])])[end]
        spelled = np.flatnonzero(odd[1:] > odd[:-1])
        if len(spelled):
            texts = out.to_pylist()
            byte_of, shown = self.byte_of, [p.encode() for p in self.shown.to_pylist()]
            for i in spelled.tolist():
                raw = b"".join(bytes([byte_of[p]]) if p in byte_of else shown[p] for p in flat[end[i] : end[i + 1]].tolist())
                texts[i] = raw.decode("utf-8", "replace")
            out = pa.array(texts, pa.string())
        return pc.if_else(pc.starts_with(out, " "), pc.utf8_slice_codeunits(out, 1), out)


@lru_cache(maxsize=2)
def codec_of(path: str, dropout: float = 0.0, seed: int = 0) -> MergeCodec:
    """One codec a worker process, so that its tasks share the cache."""
    return MergeCodec(path, dropout, seed)


def encode_documents(
    documents: DataFrame, model_path: str | None = None, dropout: float = DROPOUT, seed: int = SEED
) -> DataFrame:
    """doc_id and ids (array of int) of each row of documents (doc_id, text).

    A null text counts as empty and has no ids; the same doc_id and text always give the same ids, so repeated rows
    agree; a null doc_id is a key of its own; other columns are not read.
    """
    common.small_batches(documents.sparkSession, 500)
    path = model_path or public_tokenizers.path(MODEL)

    def run(batches):
        codec = codec_of(path, dropout, seed)
        for b in batches:
            keys = [-1 if k is None else k for k in b.column("doc_id").to_pylist()]
            flat, size = codec.encode_flat(b.column("text").fill_null("").to_pylist(), keys)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """encoded (doc_id, ids, and any others but text) with the decoded text added; null ids give a null text."""
    path = model_path or public_tokenizers.path(MODEL)
    rows = encoded.drop("text")

    def run(batches):
        codec = codec_of(path)
        for b in batches:
            ids = b.column("ids")
            size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            text = codec.decode_flat(ids.flatten().to_numpy(zero_copy_only=False), size)
            text = pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), text)
            yield pa.RecordBatch.from_arrays([*b.columns, text], names=[*b.schema.names, "text"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("text", StringType())]))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, CRC-32 of the ids, and length and CRC-32 of the decoded text."""
    encoded = encode_documents(common.table(spark, sf_dir, "documents"))
    packed = F.expr("crc32(cast(array_join(ids, ' ') as binary))")
    return decode_documents(encoded).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), packed.alias("ids_crc32"),
        F.length("text").cast("long").alias("decoded_chars"), F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"))
