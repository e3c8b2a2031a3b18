"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 6).

Two fingerprints within radius r have a midpoint within r/2 of both. So each distinct fingerprint emits its
variants within half the radius, the variants are shuffled, and fingerprints that share one are links: no
pair is ever compared that did not collide. With ``blocks=1`` the ball is drawn around all 64 bits (2,081
variants at radius 4; every two members of a bucket are links). With ``blocks=2`` (the default) it is drawn
around each 32-bit half: of two linked fingerprints at least one half differs in at most 2 bits, so 33
variants a half suffice, and colliding pairs are verified on all 64 bits. Both give the same links. Buckets
of more than ``bucket`` members are not paired: inside them the 64-bit ball is drawn after all, with the same links.
Chance puts n * 33 / 2**32 of n fingerprints in a half's bucket (384 of 5 * 10**10), so a bucket may grow with n.

Equal fingerprints are merged before anything else, so groups of copies cost one row. Links become a spanning
forest per bucket and then components by minimum labels; nothing is gathered on the driver.

Cases: null and empty texts, and texts of blanks, have fingerprint zero and link like any other. Texts of
fewer words than a shingle hash the whole sequence. Repeated ids are fingerprinted row by row; a null id is
never a component's id unless all its ids are null. Very long texts are read whole. Of documents with equal ids the one
with the least text hash stands for a component, and of rows that agree in both the first as it is written in full.
Empty tables give empty results; extra columns are ignored, and filtering keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from strideframe.functions.tables import components
from strideframe.llm.common import fields, materialize, packed, table, unpacked, whole


@dataclass(frozen=True)
class SimHashParams:
    words: int = 4
    radius: int = 4
    blocks: int = 2
    bucket: int = 1000  # largest bucket whose members are compared with each other, or eight times what chance puts in one
    slices: int = 1  # of the variants of ``blocks=1``, shuffled one after another: the disk holds one slice at a time


def fingerprint_batch(texts: list[str], words: int) -> np.ndarray:
    """Signed 64-bit fingerprints."""
    hashes, sizes, digest = [], [], xxhash.xxh64_intdigest
    for text in texts:
        w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower is A-Z alone, bytes.split the contract's blanks
        joined = b" ".join(w)
        if len(w) <= words:
            mine = [digest(joined, 42)] if w else []
        else:
            at = np.cumsum([0, *map(len, w)]) + np.arange(len(w) + 1)
            starts = at.tolist()
            mine = [digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[words:])]
        hashes += mine
        sizes.append(len(mine))
    out = np.zeros(len(texts), np.int64)
    n = np.array(sizes, np.int64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    raw = np.array(hashes, np.uint64)
    ends = np.cumsum(n)
    for i in some:  # bits are summed a text at a time: a batch's bits would not fit
        bits = np.unpackbits(raw[ends[i] - n[i] : ends[i]].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out[i] = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > n[i]).view(">i8")[0]
    return out


def fingerprint(text: Column, words: int = 4) -> Column:
    @pandas_udf(LongType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(fingerprint_batch(batch.tolist(), words), index=batch.index)

    return run.asNondeterministic()(text)


def ball(bits: int, radius: int, shift: int = 0) -> list[int]:
    """Masks of all ways to flip up to ``radius`` of ``bits`` bits, as signed 64-bit numbers."""
    masks = [sum(1 << (b + shift) for b in flips) for r in range(radius + 1) for flips in combinations(range(bits), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _masks(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" if v != -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")")


def ball_links(fps: DataFrame, radius: int, slices: int = 1) -> DataFrame:
    """Links (a, b) of fp by the ball around all 64 bits: each bucket's members to its least, which is a link as both are within half the radius of the variant."""
    every = fps.select("fp", F.explode(_masks(ball(64, (radius + 1) // 2))).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
    links = None
    for k in range(slices):
        out = every.where(F.pmod(F.xxhash64("v"), F.lit(slices)) == k) if slices > 1 else every
        first = materialize(out.groupBy("v").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "ball")
        met = out.join(first.hint("merge"), "v").where((F.col("a") != F.col("fp")) & (_distance(F.col("a"), F.col("fp")) <= radius))
        mine = met.select("a", F.col("fp").alias("b")).distinct()
        mine = materialize(mine, "ball_links") if slices > 1 else mine
        links = mine if links is None else links.union(mine)
    return links


@pandas_udf(ArrayType(fields("a long, b long")))
def _forest(members: pd.Series, radii: pd.Series) -> pd.Series:
    return pd.Series([forest(m, int(r)) for m, r in zip(members, radii, strict=True)], dtype=object)


def forest(members, radius: int) -> list[dict]:
    """Edges that connect those members that links within the radius connect: a spanning forest."""
    fp = np.sort(np.asarray(members, np.int64))
    out, left = [], np.ones(len(fp), bool)
    for i in range(len(fp)):
        if not left[i]:
            continue
        left[i] = False
        queue = [i]
        while queue:
            x = queue.pop()
            near = np.flatnonzero(left & (np.bitwise_count(np.bitwise_xor(fp, fp[x]).view(np.uint64)) <= radius))
            left[near] = False
            queue += near.tolist()
            out += [{"a": int(fp[x]), "b": int(fp[y])} for y in near]
    return out


def block_links(fps: DataFrame, params: SimHashParams) -> DataFrame:
    """Links (a, b) of fp by balls around the halves; as many as connect what all links connect."""
    radius, half_radius = params.radius, params.radius // 2
    step = (half_radius + 1) // 2
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    sides = F.array(F.struct(F.lit(0).alias("side"), low.alias("half")), F.struct(F.lit(1).alias("side"), high.alias("half")))
    split = fps.select("fp", F.explode(sides).alias("s")).select("fp", "s.side", "s.half")
    masks = ball(32, step)
    bucket = max(params.bucket, 8 * fps.count() * len(masks) >> 32)
    keyed = split.select("fp", "side", "half", F.explode(_masks(masks)).alias("m")).select("fp", "side", F.col("half").bitwiseXOR(F.col("m")).alias("v"))
    sizes = materialize(keyed.groupBy("side", "v").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "sizes")
    twos = sizes.where((F.col("n") == 2) & (_distance(F.col("a"), F.col("b")) <= radius)).select("a", "b")
    members = materialize(keyed.join(sizes.where("n > 2").select("side", "v", "n").hint("merge"), ["side", "v"]), "members")
    few = members.where(F.col("n") <= bucket).groupBy("side", "v").agg(F.collect_list("fp").alias("fps"))
    cold = few.select(F.explode(_forest("fps", F.lit(radius))).alias("e")).select("e.a", "e.b")
    many = members.where(F.col("n") > bucket)
    links = twos.union(cold)
    if many.limit(1).count():  # members of hot buckets meet in the ball around all bits instead
        links = links.union(ball_links(materialize(many.select("fp").distinct(), "hot"), radius, params.slices))
    return links


def group_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SimHashParams = SimHashParams()) -> DataFrame:
    """_id, _text_key, fingerprint (long), component_id and _keep_key (the text key of the row that stands for the component) of every row."""
    text = whole(text_col)
    rows = materialize(docs.select(F.col(id_col).alias("_id"), F.md5(text.cast("binary")).alias("_text_key"), fingerprint(text, params.words).alias("fp")), "fingerprints")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_text_key").alias("key")))
    firsts = materialize(rows.groupBy("fp").agg(first.alias("first")), "firsts")
    fps = firsts.select("fp")
    links = ball_links(fps, params.radius, params.slices) if params.blocks == 1 else block_links(fps, params)
    labels = components(links)
    labelled = materialize(firsts.join(labels.hint("merge").withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "labelled")
    best = materialize(labelled.groupBy("label").agg(F.min("first").alias("best")), "best")  # stored, so that a giant component's rows can be split in the join
    ends = materialize(labelled.join(best.hint("merge"), "label").select("fp", F.col("best.id").alias("component_id"), F.col("best.key").alias("_keep_key")), "components")
    return rows.join(ends.hint("merge"), "fp").select("_id", "_text_key", F.col("fp").alias("fingerprint"), "component_id", "_keep_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SimHashParams = SimHashParams()) -> DataFrame:
    """The row of each component with the smallest id, with all its columns; of rows repeated in full one stays."""
    rows = materialize(group_near_duplicates(docs, id_col, text_col, params), "near-duplicates")
    stays = rows.where(F.col("_id").eqNullSafe(F.col("component_id")) & (F.col("_text_key") == F.col("_keep_key")))
    keys = materialize(stays.groupBy("_id", "_text_key").agg(F.count(F.lit(1)).alias("_n")), "kept")
    mine = docs.select(packed(docs), F.col(id_col).alias("_row_id"), F.md5(whole(text_col).cast("binary")).alias("_row_key"))
    kept = mine.join(keys.hint("merge"), mine["_row_id"].eqNullSafe(keys["_id"]) & (mine["_row_key"] == keys["_text_key"]), "inner")
    if not keys.where("_n > 1").limit(1).count():
        return kept.select(*unpacked(docs))
    # Rows that agree in id and text: one of them stays, the least as it is written in full.
    several = kept.where("_n > 1").withColumn("_order", F.xxhash64(F.to_json("_row")))
    least = materialize(several.groupBy("_row_id", "_row_key").agg(F.min_by("_row", F.struct("_order", F.to_json("_row"))).alias("_row")), "once")
    return kept.where("_n = 1").select(*unpacked(docs)).union(least.select(*unpacked(docs)))


def query(spark, sf_dir: str) -> DataFrame:
    out = group_near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
