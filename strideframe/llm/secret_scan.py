"""Secret scans with corpus-wide ownership frequency (operator 3).

Pattern matches and high-entropy tokens are candidates. Every candidate value is hashed; the hashes are
counted over the corpus by distinct repositories and distinct owners. A value that many owners hold is a
widely copied example; one that few hold looks live, in however many of their repositories it stands (their
number is reported, and decides nothing). High-entropy tokens that only look live become spans
of kind ``owned``; base spans always stay, with a verdict beside them. The documents table has neither
repositories nor owners, so the query reads the source as the owner and the document as its repository.

How many owners make an example (``example_owners``) is a number and not a share: three people who hold one value are
evidence that it was copied in a corpus of any size, but a live value that more owners come to hold as the corpus
grows is then taken for an example.

Cases: a null text is empty and gives no spans and the digest of the empty string. Very long texts are scanned whole,
in time in proportion. Equal texts share one decision, so groups of copies cost one row; repeated ids are judged row
by row. Spans that begin together come in the order of their kinds. Null owners count as one owner. Empty tables give
empty results; extra columns are ignored, and redaction keeps them, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from strideframe.llm.common import fields, materialize, packed, table, unpacked, whole

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs of 32 and more: shorter runs fail and are dropped anyway
LOOSE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
SCAN = fields("n_assign long, n_access long, n_hex long, base_sha256 string", spans=ArrayType(fields("start int, kind int, end int, hash string")))


@dataclass(frozen=True)
class OwnershipParams:
    example_owners: int = 3  # a value held by so many owners or more is a copied example
    entropy_bits: float = 3.0  # least entropy a character of a token without a pattern


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def find_spans(text: str, entropy_bits: float = 3.0) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of base matches and of loose candidates, by start, then kind."""
    out = []
    raw = text.encode("utf-8", "surrogatepass").lower()
    if any(name in raw for name in NAMES):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    taken = sorted((s, e) for s, _, e, _ in out)
    begins, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))  # how far spans up to each one reach
    for m in LOOSE.finditer(text):
        v = m[0]
        if re.search(r"[0-9]", v) and re.search(r"[A-Za-z]", v) and entropy(v) >= entropy_bits and not ((k := bisect_left(begins, m.end())) and reach[k - 1] > m.start()):
            out.append((m.start(), 3, m.end(), v))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


@pandas_udf(SCAN)
def _scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for text in batch:
            found = find_spans(text)
            base = [(s, k, e) for s, k, e, _ in found if k < 3]
            spans = [{"start": s, "kind": k, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()} for s, k, e, v in found]
            rows.append((*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), spans))
        yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


scan = _scan.asNondeterministic()


def ownership(held: DataFrame) -> DataFrame:
    """hash, owners, repositories from rows of hash, _owner, _repo. Three partial aggregations: no key gathers its rows."""
    return (
        held.groupBy("hash", "_owner", "_repo").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("_repos"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("_repos").alias("repositories"))
    )


def decide(found: DataFrame, params: OwnershipParams) -> DataFrame:
    """_text_key and its spans with verdicts, one row for each distinct text that has candidates.

    found: _text_key, _owner, _repo, spans."""
    some = found.where(F.size("spans") > 0)
    held = some.select("_owner", "_repo", F.explode(F.array_distinct(F.col("spans.hash"))).alias("hash"))
    owned = materialize(ownership(held), "ownership")
    once = some.groupBy("_text_key").agg(F.first("spans").alias("spans"))
    spread = materialize(once.select("_text_key", F.explode("spans").alias("s")).select("_text_key", "s.*"), "spans")
    live = F.col("owners") < params.example_owners
    judged = spread.join(owned.hint("merge"), "hash").withColumn("live", live).where((F.col("kind") < 3) | F.col("live"))
    return judged.groupBy("_text_key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live", "owners", "repositories"))).alias("judged"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", params: OwnershipParams = OwnershipParams()) -> DataFrame:
    """Counts, digest and judged spans (array of start, kind, end, live, owners, repositories) of every document."""
    text = whole(text_col)
    found = materialize(
        docs.select(F.col(id_col).alias("_id"), F.col(owner_col).alias("_owner"), F.col(repo_col).alias("_repo"), F.md5(text.cast("binary")).alias("_text_key"), scan(text).alias("s"))
        .select("_id", "_owner", "_repo", "_text_key", "s.*"),
        "secrets",
    )
    judged = materialize(decide(found, params), "judged")
    out = found.join(judged.hint("merge"), "_text_key", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,owners:bigint,repositories:bigint>>")
    return out.select(F.col("_id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("judged", none).alias("judged"))


@pandas_udf(StringType())
def _mask(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for text, ss, es in zip(texts, starts, ends, strict=True):
        parts, at = [], 0
        for s, e in sorted(zip(ss, es, strict=True)):
            if e > at:
                parts += [text[at : max(at, s)], "[SECRET]"] if s >= at else []
                at = e
        out.append("".join(parts) + text[at:])
    return pd.Series(out, dtype=object)


def redact(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", params: OwnershipParams = OwnershipParams()) -> DataFrame:
    """The rows of ``docs`` with each live-looking span replaced by [SECRET]; widely copied examples stay.

    One scan, kept in a scratch table; only documents with candidates are shuffled, the others pass straight through.
    ``n_chars`` follows the text."""
    scanned = materialize(docs.select(packed(docs), F.col(owner_col).alias("_owner"), F.col(repo_col).alias("_repo"), F.md5(whole(text_col).cast("binary")).alias("_text_key"), scan(whole(text_col)).alias("s")), "scanned")
    some = F.size("s.spans") > 0
    found = scanned.where(some).select("_text_key", "_owner", "_repo", "s.spans")
    judged = decide(found, params).select("_text_key", F.filter("judged", lambda s: s["live"]).alias("live")).where(F.size("live") > 0)
    judged = materialize(judged, "live")
    text = F.col("_row")[f"_c{docs.columns.index(text_col)}"]
    spans = lambda c: F.col(f"live.{c}")
    met = scanned.where(some).join(judged.hint("merge"), "_text_key", "left")
    hit = met.where(F.col("live").isNotNull()).select("_row", _mask(whole(text), spans("start"), spans("end")).alias("masked"))
    new = {text_col: F.col("masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("masked").cast(dict(docs.dtypes)["n_chars"])
    same = scanned.where(~some).union(met.where(F.col("live").isNull()).select(*scanned.columns))
    return same.select(*unpacked(docs)).union(hit.select(*unpacked(docs, **new)))


def query(spark, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))
    kind = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform("judged", lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    copied = F.size(F.filter("judged", lambda s: ~s["live"]))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), (F.size("judged") - copied).cast("long").alias("n_live"), copied.cast("long").alias("n_example"))
