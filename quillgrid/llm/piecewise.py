"""Operator 5: context-triggered piecewise hashing.

A rolling hash over the last WINDOW bytes ends a chunk where its low bits are all ones; each chunk gives one
character of a signature. Chunks are between a quarter of and four times the block size, so that texts which repeat
themselves, where the hash triggers at every turn or never, have signatures of like length too. A fingerprint is
``block:signature:signature``, the first signature at the smallest power of two of which LENGTH are no shorter than
the text (in code points), the second at twice that block size. Fingerprints are compared at
compatible block sizes by the edit distance of their signatures (insertions and deletions, a change being both), if
the signatures have a run of RUN characters in common.

The query's edited text needs the next document by id. Ids are cut into ranges at quantiles of the id alone, each
range's first document is also sent to the range before it, and one sorted pass over each range holds one document
back. So each text is shuffled once; a range is sorted with spilling and read as a stream, so that a task's memory
doesn't grow with it. An id that so many rows carry that it is several quantiles is cut into as many ranges by a hash of
the text. MOST_RANGES bounds what the driver knows of the ranges, two numbers for each; from
MOST_RANGES * RANGE documents on ranges grow.

Defined results: a null text counts as empty, an empty text's fingerprint is ``1::``; two empty fingerprints have
likeness 1, an empty and another one 0. Ids are numbers; others are an error. Rows of equal id are
ordered by a hash of the text, then by the text; a null id comes first. A lone document
is its own next one.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import SLICE, bounded_batches

WINDOW = 7
LENGTH = 64
RUN = 7
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Documents of one range, about; a range is one sorted group of one task.
RANGE = 6000
MOST_RANGES = 20_000


def rolling(data: bytes) -> np.ndarray:
    """A hash of the last WINDOW bytes at each byte."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    h = np.zeros(len(b), np.uint32)
    for k in range(WINDOW):
        part = b * np.uint32((0x01000193 ** (k + 1)) & 0xFFFFFFFF)
        h[k:] += part[: max(0, len(b) - k)]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h


def signature(data: bytes, h: np.ndarray, block: int) -> str:
    """One character for each chunk of the whole text."""
    mask = np.uint32(block - 1)
    ends = (np.flatnonzero((h & mask) == mask) + 1).tolist()
    least, most, n = max(1, block // 4), 4 * block, len(data)
    out, at = [], 0
    while at < n:
        i = bisect_left(ends, at + least)
        to = min(ends[i] if i < len(ends) else n, at + most, n)
        out.append(ALPHABET[zlib.crc32(data[at:to]) & 63])
        at = to
    return "".join(out)


def fingerprint(text: str | None) -> str:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    h = rolling(data)
    block = 1
    while block * LENGTH < len(text):
        block *= 2
    return f"{block}:{signature(data, h, block)}:{signature(data, h, 2 * block)}"


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word operation for each row of the table."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def edit_distance(a: str, b: str) -> int:
    return len(a) + len(b) - 2 * common(a, b)


def alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = min(RUN, len(a), len(b))
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in runs for i in range(len(b) - run + 1)):
        return 0.0
    return 1 - edit_distance(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """Of two fingerprints, 0 to 1; 0 at incompatible block sizes."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    bx, by = int(bx), int(by)
    if bx == by:
        return max(alike(x1, y1), alike(x2, y2)) if len(x1) > LENGTH // 4 else alike(x1, y1)
    if bx == 2 * by:
        return alike(x1, y2)
    if by == 2 * bx:
        return alike(x2, y1)
    return 0.0


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


SCHEMA = "doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", per_range: int = RANGE) -> DataFrame:
    """For each document its fingerprint, the edited text's, and their likeness; see the contract. Other columns are dropped."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    if not isinstance(rows.schema["id"].dataType, NumericType):
        raise TypeError(f"ids must be numbers to have an order, {doc_id} is {rows.schema['id'].dataType.simpleString()}")
    kind = rows.schema["id"].dataType.simpleString()
    n = rows.count()
    if not n:
        return docs.sparkSession.createDataFrame([], SCHEMA.format(kind=kind))
    parts = max(1, min(MOST_RANGES, -(-n // per_range)))
    quantiles = rows.approxQuantile("id", [i / parts for i in range(1, parts)], min(0.5, 0.2 / parts)) if parts > 1 else []
    copies, cuts = Counter(quantiles), sorted(set(quantiles))
    near = rows.select("*", F.coalesce(F.col("id").cast("double"), F.lit(-float("inf"))).alias("at"), F.xxhash64("text").alias("h"))
    often = {v for v, k in copies.items() if k > 1}
    if often:  # of large ids several can be one double: such are not one id
        told = near.where(F.col("at").isin(*often)).groupBy("at").agg(F.min("id").alias("low"), F.max("id").alias("high")).collect()
        often = {r["at"] for r in told if r["low"] == r["high"]}
    # the k-th bucket begins at the k-th cut; its rows of just that id are `copies` ranges, the last of them with all other rows
    shares = [1, *(copies[v] if v in often else 1 for v in cuts), 1]
    table = [(k, None if k in (0, len(cuts) + 1) else cuts[k - 1], m, sum(shares[:k])) for k, m in enumerate(shares)]
    buckets = docs.sparkSession.createDataFrame(table, "bucket int, cut double, shares int, offset int")
    if cuts:
        cutter = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="bucket", handleInvalid="keep")
        near = cutter.transform(near).withColumn("bucket", F.col("bucket").cast("int"))
    else:
        near = near.withColumn("bucket", F.lit(0))
    span = F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("shares")).cast("int"), F.col("shares") - 1)
    part = F.col("offset") + F.when(F.col("at") == F.col("cut"), span).otherwise(F.col("shares") - 1)
    placed = near.join(F.broadcast(buckets), "bucket").select("id", "text", "h", part.alias("part"))  # MOST_RANGES rows and two at most
    order = F.struct(F.col("id").isNotNull().alias("known"), "id", "h")
    firsts = sorted(placed.groupBy("part").agg(F.min(order).alias("first")).collect(), key=lambda r: r["part"])
    leads = [(r["part"], r["first"]["id"], r["first"]["h"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)]  # the first range comes after the last
    marks = docs.sparkSession.createDataFrame(leads, f"part int, lead {kind}, lead_h long, before int")
    placed = placed.join(F.broadcast(marks), "part")  # as many at most
    is_lead, into = F.col("id").eqNullSafe(F.col("lead")) & (F.col("h") == F.col("lead_h")), F.col("before")
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("extra"))
    sent = placed.select("id", "text", "h", F.explode(F.when(is_lead, F.array(own, F.struct(into.cast("int").alias("part"), F.lit(1).alias("extra")))).otherwise(F.array(own))).alias("to"))
    dealt = sent.select("to.part", "to.extra", "id", "text", "h").repartitionById(sum(shares), "part").sortWithinPartitions("part", "extra", F.col("id").asc_nulls_first(), "h", "text").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, id, text, fingerprint) of the document whose next one isn't known yet
        out: list[tuple] = []

        def emit(following: str, print_of: str) -> None:
            part, i, t, fp = held
            new = edited(t, following)
            ef = fingerprint(new)
            out.append((i, len(t), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fp, ef, likeness(fp, ef), likeness(fp, print_of)))

        for whole in batches:
            ids = whole.schema.field("id").type
            for k in range(0, whole.num_rows, SLICE):
                b = whole.slice(k, SLICE).to_pydict()
                for part, extra, i, t in zip(b["part"], b["extra"], b["id"], b["text"], strict=True):
                    if extra and (held is None or held[0] != part):
                        continue  # a further copy of the lead: the range has its next document already
                    fp = fingerprint(t)
                    if held is not None:
                        emit(t, fp)
                    held = None if extra else (part, i, t, fp)
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], ids), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.string()) for c in cols[2:5]], *[pa.array(c, pa.float64()) for c in cols[5:]]], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                    out = []

    return dealt.mapInArrow(run, SCHEMA.format(kind=kind))
