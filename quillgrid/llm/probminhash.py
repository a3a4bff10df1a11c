"""Operator 7: near-duplicates by ProbMinHash.

A text is a weighted set of five-word shingles (weight 1 + ln of the occurrences). Each shingle is a Poisson process
whose rate is its weight; its arrivals fall on random registers, and a register keeps the shingle that arrived first.
A shingle's process ends early, at its first arrival after the last register's. Two texts agree in a register with
the probability Jaccard similarity of their shingles. BANDS bands of ROWS registers make candidates (a pair of
similarity 0.8 has none with probability 3e-6), and candidates are verified on their whole texts: they are linked if
the probability Jaccard or the plain Jaccard similarity of their shingles is 0.8 or more.

Where a text repeats shingles, the two similarities differ; so it has a second set of registers, of its distinct
shingles with weight 1, whose bands make candidates too, and a pair is ruled out only if neither set comes near 0.8.

Candidates without all pairs: equal texts are one node first. In each bucket all nodes are paired with its most
central member, the one that shares the largest buckets (of texts copied from one original, the original or what is
nearest to it). Of its pairs each node verifies the one with most bands, which gathers the copies of one original.
What then is left in buckets of several classes is closed by a prefix filter, so that no pair depends on a choice or an
estimate: shingles are ordered by the number of these nodes that have them, rare ones first, and a node stands at those
of its first shingles behind which less than 0.8 of its shingles, or of its weight, is left. Two texts whose plain or
probability Jaccard is 0.8 share at least 0.8 of either (probability Jaccard is at most the overlap of the normalised
weights), so their first common shingle is among these of both. What stands before it is in one of them only, which
bounds both similarities (see reachable): only pairs of different classes that can still reach 0.8 come out of the
join, and all of them are verified. What a family shares as a whole comes last in the order, behind what its members
have each for themselves, so that a family of texts that are not near copies gives few pairs.

Nodes are texts, numbered by their digest. Ids are integers; a class is named by its smallest id, so an id that several
texts carry may name several classes. Defined results: a null text, or one without words, is no one's near copy (texts
without words still equal each other if they are the same); a row with a null id belongs to its text's class, whose
name is null if none of its rows has an id. Columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, bounded_batches, ensure_checkpoint_dir, fresh_name, words_of
from .graph import merge_join, release, relabelled

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
MEMO = 200_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles' hashes, ascending, and their weights; a text of fewer than five words is one shingle."""
        words = words_of(text or "")
        if not words:
            return np.array([], np.uint64), np.array([], float)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        ids = []
        for w in words:
            i = memo.get(w)
            if i is None:
                b = w.encode("utf-8", "surrogatepass")
                i = zlib.crc32(b) << 32 | zlib.crc32(b, 0x9E3779B9)
                if len(w) < 100:
                    memo[w] = i
            ids.append(i)
        codes = mix(np.array(ids, np.uint64))
        size = min(SHINGLE, len(codes))
        n = len(codes) - size + 1
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = mix(h * GOLDEN + codes[k : k + n])
        h, counts = np.unique(h, return_counts=True)
        return h, 1 + np.log(counts)


def registers(h: np.ndarray, w: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The shingle that arrived first at each register."""
    first, who = np.full(m, np.inf), np.zeros(m, np.uint64)
    at, done, active = np.zeros(len(h)), 0, np.arange(len(h))
    while len(active):
        block = max(1, int(m * (np.log(m) + 1.5) / len(active)) + 1) if done == 0 else 1 + m // (2 * len(active))
        steps = (np.arange(done + 1, done + block + 1).astype(np.uint64) * GOLDEN)[None]
        seed = mix(h[active][:, None] + steps)
        gaps = -np.log(((seed >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / w[active][:, None]
        when = at[active][:, None] + np.cumsum(gaps, axis=1)
        at[active] = when[:, -1]
        done += block
        early = when < first.max()
        times, places = when[early], (mix(seed[early] ^ GOLDEN) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, places, times)
        won = times == first[places]
        who[places[won]] = np.broadcast_to(h[active][:, None], when.shape)[early][won]
        active = active[at[active] < first.max()]
    return who


def packed(who: np.ndarray) -> bytes:
    """16 bits of each register; the ROWS registers of a band stand side by side."""
    return who.astype("<u2").tobytes()


def bands(packed_registers: str) -> Column:
    """Bucket keys of packed registers, one for each band."""
    return F.array(*[F.xxhash64(F.lit(k), F.substring(packed_registers, 2 * ROWS * k + 1, 2 * ROWS)) for k in range(BANDS)])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Exact probability Jaccard and plain Jaccard of two weighted sets."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0, 0.0
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    plain = len(both) / (len(ha) + len(hb) - len(both))
    only_a = wa.sum() - wa[ia].sum()
    only_b = wb.sum() - wb[ib].sum()
    x, y = wa[ia], wb[ib]
    total = 0.0
    for ratio, n in zip(*np.unique(np.round(x / y, 12), return_counts=True), strict=True):
        here = np.round(x / y, 12) == ratio  # their terms share the sum over all shingles, but for the factor
        total += x[here].sum() / (only_a + only_b * ratio + np.maximum(x, y * ratio).sum())
    return float(total), float(plain)


def sketched(docs: DataFrame) -> DataFrame:
    """(id, key, registers, plain) from (id, text): key is the text's digest; a text that a task has met before has no registers again.

    plain are the registers of the distinct shingles with weight 1, null where they are the same (all weights are equal).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(), set()
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                b = whole.slice(k, SLICE)
                keys, rows, plain = [], [], []
                for t in b.column(1).to_pylist():
                    key = hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
                    keys.append(key)
                    h, w = shingles(t) if key not in seen else ((), ())
                    seen.add(key)
                    rows.append(packed(registers(h, w)) if len(h) else None)
                    plain.append(packed(registers(h, np.ones(len(h)))) if len(h) and w.min() < w.max() else None)
                yield pa.RecordBatch.from_pydict({"id": b.column(0), "key": pa.array(keys, pa.binary()), "registers": pa.array(rows, pa.binary()), "plain": pa.array(plain, pa.binary())})

    return docs.mapInArrow(run, "id long, key binary, registers binary, plain binary")


def verified(pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole texts are similar; ``texts`` is (node, text)."""
    left = merge_join(pairs, texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    full = merge_join(left, texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, known = Shingles(), None, None
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                a, b, ta, tb = (c.to_pylist() for c in whole.slice(k, SLICE).columns)
                keep = []
                for i in range(len(a)):
                    if b[i] != last or known is None:  # pairs come in the order of b
                        last, known = b[i], shingles(tb[i])
                    keep.append(max(similarity(shingles(ta[i]), known)) >= similar)
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, y in zip(a, keep, strict=True) if y], pa.int64()), "b": pa.array([x for x, y in zip(b, keep, strict=True) if y], pa.int64())})

    return full.mapInArrow(run, "a long, b long")


def stars(buckets: DataFrame, rank: DataFrame) -> DataFrame:
    """(a, b, hits): each node of a bucket with the bucket's member of the highest rank (node, rank)."""
    chosen = merge_join(buckets, rank, "node").groupBy("h").agg(F.max_by("node", "rank").alias("b"))
    return merge_join(buckets, chosen.checkpoint(), "h").select(F.col("node").alias("a"), "b").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("hits"))


def centrality(buckets: DataFrame) -> DataFrame:
    """(node, rank): the sizes of a node's buckets together; a hash of the node parts equal ones."""
    sizes = buckets.groupBy("h").agg(F.count("*").alias("n")).checkpoint()
    tie = F.xxhash64("node").bitwiseAND(F.lit((1 << 20) - 1)) / F.lit(float(1 << 20))
    return merge_join(buckets, sizes, "h").groupBy("node").agg(F.sum("n").alias("n")).select("node", (F.col("n") + tie).alias("rank")).checkpoint()


def best_pairs(pairs: DataFrame) -> DataFrame:
    """Of each node the pair with most bands, the smaller partner of equal ones."""
    return pairs.groupBy("a").agg(F.max(F.struct("hits", (-F.col("b")).alias("minus"))).alias("best")).select("a", (-F.col("best.minus")).alias("b"))


def mixed_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets that still hold several classes."""
    here = merge_join(buckets, labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = here.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("h").checkpoint()
    return release(merge_join(buckets, mixed, "h").checkpoint())


def prefix(h: np.ndarray, w: np.ndarray, often: np.ndarray, similar: float) -> np.ndarray:
    """Places of the shingles, rare ones first, behind which less than ``similar`` of the shingles and of the weight is left."""
    order = np.lexsort((h, often))
    behind = np.maximum(1 - np.arange(1, len(h) + 1) / len(h), 1 - np.cumsum(w[order]) / w.sum())
    return order[: int(np.argmax(behind < similar - 1e-9)) + 1]


#: What a text stands with at a shingle of its prefix: its shingles, its weight and its largest one; and how many of the shingles, and of the weight, come before.
PLACE = "h long, node long, n int, weight double, most double, n_before int, before double"


def prefixes(texts: DataFrame, similar: float) -> DataFrame:
    """PLACE for each shingle of a text's prefix, without the shingles that no other text has; ``texts`` is (node, text)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                node, text = (c.to_pylist() for c in whole.slice(k, SLICE).columns)
                for i, t in zip(node, text, strict=True):
                    h = shingles(t)[0].view(np.int64)
                    yield pa.RecordBatch.from_pydict({"node": pa.array(np.full(len(h), i, np.int64)), "h": pa.array(h)})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                b = whole.slice(k, SLICE)
                for i, t, met in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    h, w = shingles(t)
                    often = np.ones(len(h), np.int64)
                    often[np.searchsorted(h, met.values.field("h").to_numpy().view(np.uint64))] = met.values.field("n").to_numpy()
                    order = prefix(h, w, often, similar)
                    before = np.cumsum(w[order]) - w[order]
                    at = np.flatnonzero(often[order] > 1)
                    same = lambda x, kind: pa.array(np.full(len(at), x, kind))  # noqa: B023,E731
                    yield pa.RecordBatch.from_pydict(
                        {"h": pa.array(h[order[at]].view(np.int64)), "node": same(i, np.int64), "n": same(len(h), np.int32), "weight": same(w.sum(), float), "most": same(w.max(), float), "n_before": pa.array(at.astype(np.int32)), "before": pa.array(before[at])}
                    )

    each = texts.mapInArrow(spread, "node long, h long").checkpoint()
    often = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").checkpoint()
    met = merge_join(each, often, "h").groupBy("node").agg(F.collect_list(F.struct("h", "n")).alias("met"))
    return merge_join(texts, met, "node").select("node", "text", "met").mapInArrow(cut, PLACE)


def reachable(similar: float) -> Column:
    """Whether two texts, a and b, that have no common shingle before this one can be ``similar`` at all.

    At most ``common`` shingles, what is left of the shorter rest, are in both; so of a's weight at least own_a is not
    in b: what comes before, and 1 for each shingle beyond ``common``. Plain Jaccard is at most that of ``common``.
    Probability Jaccard is the sum over the common shingles i of 1 / sum_j max(a_j / a_i, b_j / b_i); the inner sum is at
    least weight_a / a_i + own_b / b_i, and a_i / b_i at least 1 / most_b, as weights are 1 or more; so the whole is at
    most (weight_a - own_a) / (weight_a + own_b / most_b). The same holds with a and b exchanged.
    """
    left = lambda c: F.col(f"n_{c}") - F.col(f"n_before_{c}")
    common = F.least(left("a"), left("b"))
    plain = common / (F.col("n_a") + F.col("n_b") - common)
    own = lambda c: F.greatest(F.col(f"before_{c}"), F.col(f"n_{c}") - common)
    side = lambda c, d: (F.col(f"weight_{c}") - own(c)) / (F.col(f"weight_{c}") + own(d) / F.col(f"most_{d}"))
    return F.greatest(plain, F.least(side("a", "b"), side("b", "a"))) >= similar - 1e-9


def crossing(places: DataFrame, labels: DataFrame, similar: float) -> DataFrame:
    """(a, b), a < b: the pairs of different classes that can be similar, by what comes before a common shingle."""
    here = merge_join(places, labels, "node", "left").withColumn("label", F.coalesce("label", "node")).checkpoint()
    side = lambda c: here.select(*[F.col(x).alias(f"{x}_{c}") for x in here.columns])
    a, b = side("a").withColumn("k_", F.col("h_a").bitwiseXOR(F.lit(0x5BD1E995))), side("b").withColumn("k_", F.col("h_b").bitwiseXOR(F.lit(0x5BD1E995)))
    both = a.join(b.hint("merge"), (a["k_"] == b["k_"]) & (F.col("label_a") < F.col("label_b")) & reachable(similar))
    return both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def closed(buckets: DataFrame, labels: DataFrame, tried: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Labels after all pairs that buckets of several classes still hold, but those that have been tried."""
    open_ = mixed_buckets(buckets, labels).select("node").distinct().checkpoint()
    if open_.isEmpty():
        return labels
    here = merge_join(texts, open_, "node", "left_semi").checkpoint()
    meet = mixed_buckets(prefixes(here, similar).checkpoint(), labels)
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = release(crossing(meet, labels, similar).join(done.hint("merge"), ["a", "b"], "left_anti").checkpoint())
    return relabelled(labels, verified(pairs, here, similar).checkpoint())


def marked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """(id, key, class_id, stays) of every row: the text's MD5, the class's smallest id, and whether the row is the class's.

    The row that stays has the class's smallest id (null ids last) and, of its texts, the smallest digest; rows that are
    equal in id and text all stay. A row without a text has no key and is its own class.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    told = rows.where("text is not null")
    prints = sketched(told).checkpoint()
    first = prints.groupBy("key").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()).checkpoint()
    nodes = merge_join(prints.where("registers is not null").select("key", "registers", "plain"), first, "key").select("node", "registers", "plain")
    spread = nodes.select("node", F.explode(F.when(F.isnull("plain"), bands("registers")).otherwise(F.array_union(bands("registers"), bands("plain")))).alias("h"))
    shared = spread.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("h").checkpoint()
    buckets = release(merge_join(spread, shared, "h").distinct().checkpoint())
    candidates = buckets.select("node").distinct().checkpoint()
    # one row of each candidate's text, found by the id and told from other texts with that id by the digest
    place = lambda key: F.coalesce("id", F.xxhash64(key))
    wanted = merge_join(first, candidates, "node", "left_semi").withColumnRenamed("least", "id").select("node", "key", place(F.col("key")).alias("place"))
    named = told.select(place(F.unhex(F.md5("text"))).alias("place"), "text")
    texts = merge_join(named, wanted, "place").where(F.unhex(F.md5("text")) == F.col("key")).select("node", "text").dropDuplicates(["node"]).checkpoint()

    # first each node's pair with most bands, then what is left
    best = best_pairs(release(stars(buckets, centrality(buckets)).checkpoint())).checkpoint()
    labels = relabelled(None, verified(best, texts, similar).checkpoint())
    labels = closed(buckets, labels, best, texts, similar)

    joined = merge_join(first, labels, "node").select("key", "least", "label").checkpoint()
    ranks = joined.groupBy("label").agg(F.min(F.struct(F.isnull("least").alias("null"), "least", "key")).alias("best"))
    of_class = merge_join(joined.select("key", "label"), ranks, "label").select("key", "best")
    alone = merge_join(first, labels, "node", "left_anti").select("key", F.struct(F.isnull("least").alias("null"), "least", "key").alias("best"))
    known = merge_join(prints.select("id", "key"), of_class.union(alone).checkpoint(), "key")
    out = known.select("id", "key", F.col("best.least").alias("class_id"), (F.col("id").eqNullSafe(F.col("best.least")) & (F.col("key") == F.col("best.key"))).alias("stays"))
    return out.union(rows.where("text is null").select("id", F.lit(None).cast("binary"), F.col("id"), F.lit(True)))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id, stays) of every row; see marked."""
    kind = docs.schema[doc_id].dataType
    return marked(docs, text, doc_id, similar).select(F.col("id").cast(kind).alias("doc_id"), F.col("class_id").cast(kind).alias("class_id"), "stays")


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each class; rows without a text all stay."""
    key, rid, no_id = (fresh_name(docs, x) for x in ("key", "rid", "no_id"))
    own = lambda i: [F.coalesce(i, F.lit(0)).alias(rid), F.isnull(i).alias(no_id)]
    stay = marked(docs, text, doc_id, similar).where("stays and key is not null").select(F.col("key").alias(key), *own(F.col("id"))).distinct()
    told = docs.where(F.col(f"`{text}`").isNotNull()).select("*", F.unhex(F.md5(F.col(f"`{text}`"))).alias(key), *own(F.col(f"`{doc_id}`").cast("long")))
    kept = told.join(stay.hint("merge"), [key, rid, no_id], "left_semi").dropDuplicates([key, rid, no_id])
    return kept.select(*docs.columns).unionByName(docs.where(F.col(f"`{text}`").isNull()))
