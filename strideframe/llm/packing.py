"""Best-fit packing with Martello-Toth dominance reduction (operator 9).

Documents are tokenised, ended by id 1, and cut only where longer than a sequence. Packing needs nothing of a
piece but its length, so Spark counts the lengths and the driver packs the histogram (``size`` numbers at
most, whatever the corpus): first the reduction fixes sets of one to three lengths that dominate every other
set with their longest piece, then the rest is packed best fit, longest first, whole runs of equal pieces at a
time. The result is a table of slots (runs of sequences with the same contents). Pieces are numbered within
their length by two levels (buckets of a length, then rows of a bucket) and look their slot up; no length,
however common, is gathered in one task.

Cases: null and empty texts are the single id 1. Repeated rows are packed as separate pieces. Null ids stay
null. A very long text becomes many pieces. Which of equally long pieces takes which of their places is
arbitrary, as are the sequences' numbers. Empty tables give empty results; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StructField, StructType

from strideframe.llm.common import fields, materialize, table, whole


#: A plain word: letters whose lower case is known, with runs of punctuation before and after them.
PLAIN = "^(?P<before>[.,!?;:|$%&*#]*)(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)(?P<after>[.,!?;:|$%&*#]*)$"


@dataclass(frozen=True)
class PackParams:
    size: int = 4096
    end_id: int = 1
    tokenizer: str = ""  # a path; the default is public_tokenizers' word_bpe_49k.json
    buckets: int = 256  # parts that the pieces of one length are numbered in, at least
    bucket_pieces: int = 1_000_000  # more parts are taken where all pieces together would give a part more than this
    cache_words: int = 400_000  # parts of words that a worker remembers
    group_bytes: int = 8 << 20  # text that is encoded at once, or one longer text

    @property
    def path(self) -> str:
        if self.tokenizer:
            return self.tokenizer
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Ids:
    """Ids of several strings in one run: string i has those from ``ends[i - 1]`` to ``ends[i]``."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes, self.ends = flat, sizes.astype(np.int64), np.cumsum(sizes, dtype=np.int64)

    @classmethod
    def of(cls, each: list[list[int]]) -> Ids:
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return cls(np.fromiter((i for ids in each for i in ids), np.uint32, int(sizes.sum())), sizes)

    def take(self, at: np.ndarray) -> Ids:
        """The strings at ``at``, one after another."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        kind = np.int32 if len(ends) and ends[-1] < 1 << 31 and len(self.flat) < 1 << 31 else np.int64
        where = np.repeat(((self.ends - self.sizes)[at] - (ends - sizes)).astype(kind), sizes)
        where += np.arange(len(where), dtype=kind)
        return Ids(self.flat[where], sizes)

    def __add__(self, more: Ids) -> Ids:
        return Ids(np.concatenate([self.flat, more.flat]), np.concatenate([self.sizes, more.sizes]))

    def joined(self, n: np.ndarray) -> Ids:
        """Each ``n[i]`` neighbours as one string."""
        ends = np.concatenate([[0], self.ends])[np.concatenate([[0], np.cumsum(n)])]
        return Ids(self.flat, np.diff(ends))


class WordIds:
    """Ids of whole texts by a tokenizer that never joins across blanks, so that each distinct part of a word is encoded once.

    Arrow splits many texts at once and numbers their distinct words, then the words' parts: a plain word is letters
    between runs of punctuation, which go straight to the tokenizer's model; any other word is one part and goes through
    the whole tokenizer. Each worker remembers parts, bounded, and starts again from those of the last texts. A tokenizer
    of another build (``joins``) encodes whole texts."""

    kept: dict[str, WordIds] = {}

    def __init__(self, params: PackParams):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(params.path), params.cache_words
        self.model, self.bytes = self.tokenizer.model, byte_letters()
        self.parts, self.part_ids = pa.array([], pa.string()), Ids.of([])
        build = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (build["pre_tokenizer"] or {}).get("pretokenizers", [])]
        lower = [x["type"] for x in (build["normalizer"] or {}).get("normalizers", [])]
        self.joins = steps != ["Split", "ByteLevel"] or lower != ["NFC", "Replace", "Lowercase"] or not build["model"].get("end_of_word_suffix")
        if not self.joins:
            probe = pa.array(["Words, and  more words!\nÉté 12 isn't Words"])
            self.joins = self.encode(probe).flat.tolist() != self._whole(probe).flat.tolist()

    @classmethod
    def of(cls, params: PackParams) -> WordIds:
        key = f"{params.path}:{params.cache_words}"
        if key not in cls.kept:
            cls.kept[key] = cls(params)
        return cls.kept[key]

    def _whole(self, texts: pa.Array) -> Ids:
        return Ids.of([e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)])

    def _plain(self, parts: list[str]) -> Ids:
        """Letters in lower case, and runs of punctuation."""
        tokenize, letters = self.model.tokenize, self.bytes
        return Ids.of([[t.id for t in tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(letters))] for p in parts])

    def _others(self, words: list[str]) -> Ids:
        """Many words through the whole tokenizer at once; each one's ids are told by their characters' offsets."""
        out = Ids.of([])
        for at in range(0, len(words), 4000):
            some = words[at : at + 4000]
            begins = np.cumsum([0, *[len(w) + 1 for w in some]])
            encoded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            first = np.fromiter((a for a, _ in encoded.offsets), np.int64, len(encoded.ids))
            out += Ids(np.array(encoded.ids, np.uint32), np.diff(np.searchsorted(first, begins)))
        return out

    def _of_parts(self, parts: pa.Array, plain: np.ndarray) -> Ids:
        """The ids of distinct parts, from memory where known."""
        known = pc.index_in(parts, value_set=self.parts)
        new = np.flatnonzero(known.is_null().to_numpy(zero_copy_only=False))
        told = [new[plain[new]], new[~plain[new]]]
        learned = self._plain(parts.take(pa.array(told[0])).to_pylist()) + self._others(parts.take(pa.array(told[1])).to_pylist())
        order = np.concatenate(told)
        at = known.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at[order] = len(self.parts) + np.arange(len(order))
        every = self.part_ids + learned
        ids = every.take(at)
        if len(self.parts) + len(order) > self.limit:
            self.parts, self.part_ids = parts[: self.limit], ids.take(np.arange(min(len(parts), self.limit)))
        else:
            self.parts, self.part_ids = pa.concat_arrays([self.parts, parts.take(pa.array(order))]), every
        return ids

    def encode(self, texts: pa.Array) -> Ids:
        if self.joins:
            return self._whole(texts)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        found = pc.extract_regex(words, pattern=PLAIN)
        plain = found.is_valid()
        parts = [pc.if_else(plain, pc.utf8_lower(found.field("letters")), words), *(pc.if_else(plain, found.field(c), "") for c in ("before", "after"))]
        numbered = [p.dictionary_encode() for p in parts]
        distinct = pa.concat_arrays([x.dictionary for x in numbered]).dictionary_encode()
        is_plain = np.ones(len(distinct.dictionary), bool)
        place, base, at = distinct.indices.to_numpy(), 0, []
        for x in numbered:
            at.append(place[base + x.indices.to_numpy()])
            base += len(x.dictionary)
        is_plain[at[0][~plain.to_numpy(zero_copy_only=False)]] = False
        ids = self._of_parts(distinct.dictionary, is_plain)
        each = ids.take(np.stack([at[1], at[0], at[2]], axis=1).ravel()).joined(np.full(len(words), 3))
        return each.take(coded.indices.to_numpy()).joined(split.value_lengths().to_numpy())


def pieces_of(docs: DataFrame, id_col: str, text_col: str, params: PackParams) -> DataFrame:
    """doc id, piece, start, length, ids_crc32 of every piece of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *fields("piece int, start long, length long, ids_crc32 long").fields])
    end = int(params.end_id).to_bytes(4, "little")
    full = 4 * params.size

    def pieces(batch: pa.RecordBatch, words: WordIds) -> pa.RecordBatch:
        row, piece, start, length, crc = [], [], [], [], []
        ids = words.encode(batch.column(1))
        raw, at = memoryview(ids.flat.astype("<u4", copy=False)).cast("B"), 0
        for i, stop in enumerate((4 * ids.ends).tolist()):
            mine, at = raw[at:stop], stop
            if len(mine) < full:  # one piece
                row.append(i)
                piece.append(0)
                start.append(0)
                length.append(len(mine) // 4 + 1)
                crc.append(zlib.crc32(end, zlib.crc32(mine)))
                continue
            mine = memoryview(bytes(mine) + end)
            for k, a in enumerate(range(0, len(mine), full)):
                part = mine[a : a + full]
                row.append(i)
                piece.append(k)
                start.append(a // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(params)
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= params.group_bytes:
                yield pieces(pa.concat_batches(held), words)
                held, size = [], 0
        if held:
            yield pieces(pa.concat_batches(held), words)

    return rows.mapInArrow(run, schema)


class Lengths:
    """A histogram of lengths with the largest and smallest present."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: int(v) for k, v in counts.items() if v > 0}
        self.sorted = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.sorted.pop(bisect.bisect_left(self.sorted, length))

    def fitting(self, room: int, used: tuple[int, ...] = ()) -> int | None:
        """The largest length up to ``room`` of which more is left than ``used`` holds."""
        at = bisect.bisect_right(self.sorted, room) - 1
        while at >= 0 and self.count[self.sorted[at]] <= used.count(self.sorted[at]):
            at -= 1
        return self.sorted[at] if at >= 0 else None

    def least_sum(self, n: int, used: tuple[int, ...]) -> int | None:
        total = 0
        for x in self.sorted:
            k = min(n, self.count[x] - used.count(x))
            total, n = total + k * x, n - k
            if not n:
                return total
        return None


def dominating(lengths: Lengths, longest: int, size: int) -> tuple[int, ...] | None:
    """A set with ``longest`` that dominates every feasible one: whatever else shares its sequence could be swapped for it."""
    room = size - longest
    one = lengths.fitting(room, (longest,))
    if one is None:
        return (longest,)
    if one == room:  # any other filling is at most as long as this single piece
        return (longest, one)
    two_least = lengths.least_sum(2, (longest,))
    if two_least is None or two_least > room:  # no two fit, and this is the longest one that does
        return (longest, one)
    three_least = lengths.least_sum(3, (longest,))
    if three_least is not None and three_least <= room:
        return None
    # At most two fit. The longest one and the longest beside it dominate if no shorter half of a pair exceeds that.
    beside = lengths.fitting(room - one, (longest, one))
    if beside is None:
        return None
    for at in range(bisect.bisect_right(lengths.sorted, room // 2) - 1, -1, -1):
        y = lengths.sorted[at]
        left = lengths.count[y] - (longest == y)
        after = lengths.sorted[at + 1] if at + 1 < len(lengths.sorted) else size + 1
        if left >= 2 or (left == 1 and after + y <= room):
            return (longest, one, beside) if y <= beside else None
    return None


def reduce_lengths(lengths: Lengths, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes dominating sets out of ``lengths`` for good: (contents, how many sequences)."""
    fixed = []
    for longest in reversed(list(lengths.sorted)):
        while lengths.count.get(longest):
            found = dominating(lengths, longest, size)
            if found is None:
                break
            times = min(lengths.count[x] // found.count(x) for x in found)
            for x in found:
                lengths.take(x, times)
            fixed.append((found, times))
    return fixed


def best_fit(lengths: Lengths, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over runs of equal pieces: (contents, how many sequences)."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {size: []}
    rooms: list[int] = []  # sorted keys of open_ with sequences

    def put(room: int, held: tuple[int, ...], n: int) -> None:
        if room not in open_ or not open_[room]:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((held, n))

    for x in sorted(lengths.count, reverse=True):
        left = lengths.count[x]
        while left:
            at = bisect.bisect_left(rooms, x)
            if at == len(rooms):  # new sequences, filled one after another
                each = min(size // x, left)
                n = left // each
                put(size - each * x, (x,) * each, n)
                left -= each * n
                continue
            room = rooms[at]
            held, n = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
            each = min(room // x, left)
            filled = min(n, left // each)
            if filled < n:
                put(room, held, n - filled)
            put(room - each * x, held + (x,) * each, filled)
            left -= each * filled
    return [group for room in rooms for group in open_[room]]


def plan_slots(counts: dict[int, int], size: int) -> pd.DataFrame:
    """Slots: the ``n`` pieces of a length from rank ``first`` on go to sequences from ``sequence`` on, at ``offset``."""
    lengths = Lengths(counts)
    groups = reduce_lengths(lengths, size) + best_fit(lengths, size)
    rank, sequence, rows = {}, 0, []
    for held, n in groups:
        offset = 0
        for x in held:
            rows.append((x, rank.get(x, 0), n, sequence, offset))
            rank[x] = rank.get(x, 0) + n
            offset += x
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first", "n", "sequence", "offset"], dtype="int64").sort_values(["length", "first"], ignore_index=True)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: PackParams = PackParams()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = materialize(pieces_of(docs, id_col, text_col, params).withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    buckets = max(params.buckets, -(-pieces.count() // params.bucket_pieces))
    keyed = pieces.withColumn("_part", F.pmod(F.xxhash64("_uid"), F.lit(buckets)).cast("int"))
    cells = materialize(keyed.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")), "cells")  # size x buckets rows at most
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    slots = plan_slots(counts, params.size)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(cells.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")), "bases")
    within = Window.partitionBy("length", "_part").orderBy("_uid")
    ranked = keyed.withColumn("_k", F.row_number().over(within)).join(bases.hint("merge"), ["length", "_part"]).withColumn("_rank", F.col("_base") + F.col("_k") - 1)
    shared = docs.sparkSession.sparkContext.broadcast({c: slots[c].to_numpy() for c in slots})
    stride = np.int64(1) << 40  # more pieces than a length has

    @pandas_udf(fields("sequence_id long, offset long"))
    def look_up(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        s = shared.value
        at = np.searchsorted(s["length"] * stride + s["first"], lengths.to_numpy() * stride + ranks.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": s["sequence"][at] + ranks.to_numpy() - s["first"][at], "offset": s["offset"][at]})

    found = ranked.withColumn("_slot", look_up("length", "_rank"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "_slot.sequence_id", "_slot.offset")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
