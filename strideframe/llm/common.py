"""Helpers shared by the training-data operators: shared scratch tables, batch sizing, word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType
from strideframe.functions.tables import share_package, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words in every contract here: space and the ASCII controls 9 to 13.
BLANKS = b" \t\n\x0b\x0c\r"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors, fixes sizes for the planner."""
    return stored(df, name)


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, and let the Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    share_package(spark)


def first_by_hash(df: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """The ``n`` rows with the least hashes of ``key``, of ``total`` rows. Only some twice as many reach the task that sorts them."""
    h = F.xxhash64(key)
    if total > 4 * n:
        few = df.where(h < F.lit(int(-(1 << 63) + (1 << 64) * (2 * n / total))))
        df = few if few.count() >= n else df
    return df.orderBy(h, key).limit(n)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame) -> Column:
    """All columns as one struct ``_row`` with names of its own, so that no name of theirs meets a name of an operator's."""
    return F.struct(*[_quoted(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)]).alias("_row")


def unpacked(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns that ``packed`` packed, some of them replaced."""
    return [new.get(c, F.col("_row")[f"_c{i}"]).alias(c) for i, c in enumerate(docs.columns)]


def whole(text: str | Column = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def crc_of_id(name: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


_TYPES = {"long": LongType, "int": IntegerType, "double": DoubleType, "float": FloatType, "string": StringType, "binary": BinaryType, "boolean": BooleanType}


def fields(ddl: str, **more: DataType) -> StructType:
    """A struct of plain fields, without the JVM: workers import the modules that declare functions with it."""
    plain = [StructField(name, _TYPES[kind]()) for name, kind in (x.split() for x in ddl.split(","))]
    return StructType(plain + [StructField(name, kind) for name, kind in more.items()])


# -- word hashing over a batch of texts ------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(4095, np.uint64(0x100000001B3))]), dtype=np.uint64)


def separators(extra: bytes = b"") -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(BLANKS + extra)] = True
    return out


#: Blanks and all ASCII characters that are neither letters nor digits.
PUNCTUATION = separators(bytes(c for c in range(128) if not chr(c).isalnum()))
SPACES = separators()


def groups(blobs: list[bytes], size: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes together, whose arrays stay in the processor's cache."""
    begin = total = 0
    for i, b in enumerate(blobs):
        total += len(b)
        if total >= size:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(blobs):
        yield begin, len(blobs)


def hash_words(blobs: list[bytes], split_at: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's words begin (length n + 1).

    One polynomial hash per word over its bytes, computed for many texts at once without a loop over words.
    """
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for a, b in groups(blobs):
        hashes, n = _hash_words(blobs[a:b], split_at)
        parts.append(hashes)
        counts.append(n)
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def _hash_words(blobs: list[bytes], split_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs)) + 1)
    word = ~split_at[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(blobs), np.int64)
    sizes = np.flatnonzero(before & ~word) - starts
    letters = data[word]
    at = np.cumsum(sizes) - sizes
    position = np.arange(len(letters)) - np.repeat(at, sizes)
    terms = (letters.astype(np.uint64) + np.uint64(1)) * _POWERS[position & 4095]
    hashes = np.add.reduceat(terms, at)
    hashes ^= hashes >> np.uint64(29)
    hashes *= _MULT
    hashes ^= hashes >> np.uint64(32)
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)
