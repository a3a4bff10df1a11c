"""Operator 9: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources in code point order, null last, weigh 5, 2, 1 and so on again; they share SHARE of all words, a
target stops at MOST times its source's words, and the excess is shared again by weight.

Documents fall into blocks by a hash of id and text, in number as their source's share of BLOCKS. A source's quota is
a number of whole blocks in a permuted order, again from the start once all are used, and a part of one more block: its
documents by hash up to the first that doesn't fit, of those after it the largest that still fit (MORE at most, what
then is missing stays missing), and one more if that comes nearer to the target. The tree halves the output shards again
and again; at each node a multivariate-hypergeometric draw says how many blocks of each source go left. Each shard then
takes that many of the source's permuted blocks, no two shards the same, and orders its documents by another hash. What
the mix takes of a document is what its shards took of its block.

A shard of more than SHARD_WORDS words, where MOST_SHARDS are not enough, is dealt by hash to several tasks, each of which
orders its part, so that no task grows with the corpus.

What reaches the driver: one row for each source, one for each block (BLOCKS plus the sources at most), and for each
source what its part block decided, MORE hashes at most. The plan that goes back to the executors is as large. A part
block's (hash, size) pairs, a BLOCKS-th of the corpus, are looked at in one task for each source. The rest is one pass
over the documents.

Defined results: a null text has no words, and a document without words takes part with 0. Rows that are the same in
id and text are taken together. Without any word all targets are 0. Other columns are ignored or kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ensure_checkpoint_dir

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCKS = 16_384
#: Documents of a block at least, on average, where the source has as many.
BLOCK_DOCS = 64
#: Documents that a part block takes out of the order of their hashes.
MORE = 1000
SHARD_WORDS = 1_000_000
MOST_SHARDS = 4096
SEED = 11


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], share: float = SHARE, most: float = MOST) -> list[float]:
    """Of sources in order."""
    weight = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
    rest, heavy = share * sum(sizes), sum(weight)
    out = [most * x for x in sizes]
    # the first to reach their limits are those with the least room for their weight
    order = sorted(range(len(sizes)), key=lambda i: (out[i] / weight[i], i))
    for k, i in enumerate(order):
        if rest / heavy * weight[i] <= out[i]:
            each = rest / heavy
            for j in order[k:]:
                out[j] = each * weight[j]
            break
        rest -= out[i]
        heavy -= weight[i]
    return out


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Sources x shards: how many blocks of each source each shard gets; shards differ by one block at most."""
    total = int(quotas.sum())
    room = np.array([total // shards + (j < total % shards) for j in range(shards)])
    out = np.zeros((len(quotas), shards), np.int64)

    def node(q: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = q
            return
        mid = (lo + hi) // 2
        n = int(room[lo:mid].sum())
        left = rng.multivariate_hypergeometric(q, n, method="marginals") if q.sum() and n else np.zeros_like(q)
        node(left, lo, mid)
        node(q - left, mid, hi)

    node(quotas.astype(np.int64), 0, shards)
    return out


@dataclass
class Plan:
    sources: DataFrame  # source, blocks, source_size, target
    blocks: DataFrame  # source, block, whole (shards), part (shard), limit, more
    shards: int
    pieces: int  # tasks of one shard


def hashed(docs: DataFrame, text: str, doc_id: str) -> Column:
    return F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), F.lit(SEED))


def plan(sizes: DataFrame, shard_words: int = SHARD_WORDS) -> Plan:
    """From (source, size, h) of every document."""
    spark = sizes.sparkSession
    found = [(r["source"], r["words"], r["n"]) for r in sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()]
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    words, counts = [r[1] for r in found], [r[2] for r in found]
    wanted = targets(words)
    number = [max(1, min(n * BLOCKS // max(1, sum(counts)), n // BLOCK_DOCS)) for n in counts]
    source_type = sizes.schema["source"].dataType
    sources = spark.createDataFrame(
        [(r[0], k, w, float(t)) for r, k, w, t in zip(found, number, words, wanted, strict=True)],
        T.StructType([T.StructField("source", source_type), T.StructField("blocks", T.IntegerType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]),
    )
    placed = in_blocks(sizes, sources)
    at = {r[0]: i for i, r in enumerate(found)}
    held = [np.zeros(k, np.int64) for k in number]
    for r in placed.groupBy("source", "block").agg(F.sum("size").alias("words")).collect():
        held[at[r["source"]]][r["block"]] = r["words"]

    rng = np.random.default_rng(SEED)
    orders, quotas, parts = [], [], []
    for i, t in enumerate(wanted):
        order = rng.permutation(number[i])
        run = np.cumsum(np.concatenate([held[i][order]] * int(MOST)))
        whole = int(np.searchsorted(run, t, side="right"))
        rest = t - (run[whole - 1] if whole else 0)
        orders.append(order)
        parts.append((int(order[whole % number[i]]), rest) if whole < len(run) and rest >= 1 else None)
        quotas.append(whole + (parts[-1] is not None))
    shards = int(min(MOST_SHARDS, max(1, sum(wanted) // shard_words)))
    pieces = int(max(1, -(-sum(wanted) // (shards * shard_words)))) if shards == MOST_SHARDS else 1
    share = split(np.array(quotas, np.int64), shards, rng) if found else np.zeros((0, 1), np.int64)

    kind = T.StructType([T.StructField("source", source_type), T.StructField("block", T.IntegerType()), T.StructField("rest", T.DoubleType())])
    open_blocks = spark.createDataFrame([(found[i][0], p[0], float(p[1])) for i, p in enumerate(parts) if p], kind)

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        """Documents of one block by hash, while they fit; then the largest that still fit; then one more if that comes nearer."""
        rest, limit, more = rows["rest"].iloc[0], None, []
        each = list(rows.groupby("h")["size"].sum().sort_index().items())
        full = next((k for k, (_, n) in enumerate(each) if (rest := rest - n) < 0), len(each))
        if full < len(each):
            rest += each[full][1]
        if full:
            limit = each[full - 1][0]
        left = sorted(((n, h) for h, n in each[full:]), reverse=True)
        for n, h in left:
            if 0 < n <= rest and len(more) < MORE:
                rest -= n
                more.append(h)
        if missing := [(n, h) for n, h in left if n > rest]:
            n, h = min(missing)
            if n - rest < rest:
                more.append(h)
        return pd.DataFrame({"source": rows["source"].iloc[:1], "limit": [limit], "more": [more]}).astype({"limit": object})

    match = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["block"] == b["block"])
    ready = placed.join(open_blocks, match(placed, open_blocks)).select(placed["source"], "rest", "h", "size")
    filled = ready.groupBy("source").applyInPandas(fill, T.StructType([T.StructField("source", source_type), T.StructField("limit", T.LongType()), T.StructField("more", T.ArrayType(T.LongType()))]))
    limits = {r["source"]: (r["limit"], list(r["more"])) for r in filled.collect()}

    rows = []
    for i, (source, *_) in enumerate(found):
        goes = np.repeat(np.arange(shards), share[i]).tolist()  # the shard of each unit, in permuted order
        units: dict[int, list] = {}
        for u, shard in enumerate(goes):
            block = int(orders[i][u % number[i]])
            is_part = parts[i] is not None and u == len(goes) - 1
            e = units.setdefault(block, [[], None])
            if is_part:
                e[1] = shard
            else:
                e[0].append(shard)
        for block, (whole, part) in units.items():
            limit, more = limits.get(source, (None, [])) if part is not None else (None, [])
            rows.append((source, block, whole, part, limit, more))
    blocks = spark.createDataFrame(rows, T.StructType([T.StructField("source", source_type), T.StructField("block", T.IntegerType()), T.StructField("whole", T.ArrayType(T.IntegerType())), T.StructField("part", T.IntegerType()), T.StructField("limit", T.LongType()), T.StructField("more", T.ArrayType(T.LongType()))]))
    return Plan(sources, blocks, shards, pieces)


def in_blocks(df: DataFrame, sources: DataFrame) -> DataFrame:
    """``df`` (with source and h) with its source's figures and its block."""
    named = sources.withColumnRenamed("source", "source_")
    return df.join(named, df["source"].eqNullSafe(named["source_"]), "left").drop("source_").withColumn("block", F.pmod("h", F.col("blocks").cast("long")).cast("int"))


def drawn(df: DataFrame, p: Plan) -> DataFrame:
    """``df`` (with source and h) with ``shards_``: the shard of each time that the mix takes the row."""
    named = p.blocks.withColumnRenamed("source", "source_").withColumnRenamed("block", "block_")
    placed = in_blocks(df, p.sources)
    if not p.blocks.isEmpty():
        named = F.broadcast(named)  # BLOCKS rows plus one for each source at most
    joined = placed.join(named, placed["source"].eqNullSafe(named["source_"]) & (placed["block"] == named["block_"]), "left")
    part = F.col("part").isNotNull() & (F.coalesce(F.col("h") <= F.col("limit"), F.lit(False)) | F.array_contains("more", F.col("h")))
    shards = F.concat(F.coalesce("whole", F.array().cast("array<int>")), F.when(part, F.array("part")).otherwise(F.array().cast("array<int>")))
    return joined.withColumn("shards_", shards).drop("source_", "block_", "whole", "part", "limit", "more", "blocks", "block")


def sized(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    ensure_checkpoint_dir(docs.sparkSession)
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), words_in(F.col(f"`{text}`")).alias("size"), hashed(docs, text, doc_id).alias("h")).checkpoint()


def taken(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", shard_words: int = SHARD_WORDS) -> DataFrame:
    """For each document its size, its source's size and target, the words that the mix takes, and their shards."""
    sizes = sized(docs, text, doc_id, source)
    out = drawn(sizes, plan(sizes, shard_words))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards_")).alias("taken"), F.col("shards_").alias("shards"))


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix itself: ``docs``' columns, a row for each time that it takes a document; a partition is a shard, or one of its pieces, shuffled."""
    p = plan(sized(docs, text, doc_id, source).select("source", "size", "h"), shard_words)
    keep = docs.columns
    key = docs.select(F.col(f"`{source}`").alias("source"), hashed(docs, text, doc_id).alias("h"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    rows = drawn(key, p).select("row", "h", F.posexplode("shards_").alias("time", "shard"))
    piece = F.pmod(F.xxhash64("h", "time", F.lit("piece")), F.lit(p.pieces)).cast("int")
    dealt = rows.repartitionById(p.shards * p.pieces, F.col("shard") * p.pieces + piece).sortWithinPartitions(F.xxhash64("h", "time", F.lit("order")))
    return dealt.select("row.*")
