"""Operators that look at several rows, and the pipeline, against brute force on small tables."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

DATA = "/root/testdata/sf0.001"


# Fingerprints: operator 5


def test_fingerprints():
    from quillgrid.llm.piecewise import LENGTH, edit_distance, edited, fingerprint, likeness

    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    assert fingerprint(None) == fingerprint("") == "1::" and likeness("1::", "1::") == 1.0
    for n in (5, 20, 200, 3000):
        t, u = text(n), text(n)
        f, g = fingerprint(t), fingerprint(edited(t, u))
        assert fingerprint(t) == f and likeness(f, f) == 1.0 and likeness(f, g) == likeness(g, f)
        assert likeness(f, g) >= 0.5 and likeness(f, fingerprint(u)) <= 0.3
        assert len(f.split(":")[1]) <= 4 * 4 * LENGTH
    same = "Of " * 500
    assert likeness(fingerprint(same), fingerprint(edited(same, text(400)))) > 0.4
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        table = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            table, old = [i], table
            for j, y in enumerate(b, 1):
                table.append(old[j - 1] if x == y else 1 + min(old[j], table[j - 1]))
        assert edit_distance(a, b) == table[-1]


def test_fingerprints_by_brute_force():
    """Chunks, signatures and likeness by their definitions, byte by byte."""
    from quillgrid.llm.piecewise import ALPHABET, fingerprint, likeness

    def chunks(data, block):
        out, at = [], 0
        while at < len(data):
            for to in range(at + 1, len(data) + 1):
                h = sum((data[to - 1 - k] * pow(0x01000193, k + 1, 1 << 32)) % (1 << 32) for k in range(7) if to - 1 - k >= 0) % (1 << 32)
                h ^= h >> 15
                h = h * 0x2C1B3C6D % (1 << 32)
                h ^= h >> 12
                if to == len(data) or to - at == 4 * block or (to - at >= max(1, block // 4) and h % block == block - 1):
                    break
            out.append(data[at:to])
            at = to
        return out

    def brute_print(text):
        block = 1
        while block * 64 < len(text):
            block *= 2
        return ":".join([str(block), *("".join(ALPHABET[zlib.crc32(c) & 63] for c in chunks(text.encode(), b)) for b in (block, 2 * block))])

    def brute_alike(a, b):
        if a == b:
            return 1.0
        run = min(7, len(a), len(b))
        if not run or not {a[i : i + run] for i in range(len(a) - run + 1)} & {b[i : i + run] for i in range(len(b) - run + 1)}:
            return 0.0
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return 2 * table[-1][-1] / (len(a) + len(b))

    def brute_likeness(x, y):
        (bx, x1, x2), (by, y1, y2) = ((int(p), q, r) for p, q, r in (x.split(":"), y.split(":")))
        if x == y:
            return 1.0
        if bx == by:
            return max(brute_alike(x1, y1), brute_alike(x2, y2)) if len(x1) > 16 else brute_alike(x1, y1)
        return brute_alike(x1, y2) if bx == 2 * by else brute_alike(x2, y1) if by == 2 * bx else 0.0

    r = random.Random(12)
    texts = ["", "a", "é", "ab" * 90, "x" * 300]
    for _ in range(25):
        t = " ".join("".join(r.choice("abcdeé😀") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 150)))
        texts += [t, t[: len(t) * 2 // 3] + "other words", t + " " + t[:40]]
    prints = [fingerprint(t) for t in texts]
    assert prints == [brute_print(t) for t in texts]
    for a in range(0, len(texts), 2):
        for b in range(a, len(texts), 7):
            assert likeness(prints[a], prints[b]) == pytest.approx(brute_likeness(prints[a], prints[b]), abs=1e-12)


@pytest.mark.parametrize("per_range", [3, 10_000])
def test_next_documents(spark, per_range):
    from quillgrid.llm import piecewise

    r = random.Random(2)
    rows = [(i * 7 + 3, " ".join(r.choice(["a", "bb", "ccc"]) for _ in range(r.randint(0, 40)))) for i in range(60)] + [(-5, None), (None, "null id"), (2**60, "x" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as fingerprint", "1 as part").repartition(5)
    got = {x["doc_id"]: x for x in piecewise.compared(docs, per_range=per_range).collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        e = piecewise.edited(t, u)
        assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["near_next"] == piecewise.likeness(piecewise.fingerprint(t), piecewise.fingerprint(u))


def test_next_over_many_ranges(spark):
    from quillgrid.llm import piecewise

    texts = [f"text number {i} " * (i % 5 + 1) for i in range(260)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["edited_sha256"] for x in piecewise.compared(docs, per_range=1).collect()}
    assert got == {i: hashlib.sha256(piecewise.edited(t, texts[(i + 1) % 260]).encode()).hexdigest() for i, t in enumerate(texts)}


def test_next_of_few_and_repeated(spark):
    from quillgrid.llm import piecewise

    make = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    assert piecewise.compared(make()).count() == 0
    one = piecewise.compared(make((1, "abcdefgh"))).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0
    assert piecewise.compared(make((1, "a"), (1, "a"), (1, "b"), (2, "c")), per_range=1).count() == 4


def test_one_id_of_many_rows(spark):
    """Half of the rows carry one id: they lie in several ranges, and each row's next one is still the next of a single order."""
    from pyspark.sql import functions as F

    from quillgrid.llm import piecewise

    rows = [(7 if i % 2 else i, f"text {i} " * (i % 4 + 1)) for i in range(400)] + [(7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ordered = [tuple(r) for r in docs.withColumn("h", F.xxhash64("text")).orderBy("doc_id", "h", "text").select("doc_id", "text").collect()]
    want = sorted((i, hashlib.sha256(piecewise.edited(t, ordered[(k + 1) % len(ordered)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(ordered))
    out = piecewise.compared(docs, per_range=20)
    assert sorted((r["doc_id"], r["edited_sha256"]) for r in out.collect()) == want
    spread = out.withColumn("place", F.spark_partition_id()).where("doc_id = 7").groupBy("place").count().collect()
    assert len(spread) > 5 and max(r["count"] for r in spread) < 80
    big = [(2**60 + i, f"t{i} " * 9) for i in range(60)]  # one double
    got = {r["doc_id"]: r["edited_sha256"] for r in piecewise.compared(spark.createDataFrame(big, "doc_id long, text string"), per_range=5).collect()}
    assert got == {i: hashlib.sha256(piecewise.edited(t, big[(k + 1) % 60][1]).encode()).hexdigest() for k, (i, t) in enumerate(big)}


def test_ids_of_other_kinds(spark):
    from quillgrid.llm import piecewise

    with pytest.raises(TypeError):
        piecewise.compared(spark.createDataFrame([("x", "a")], "doc_id string, text string"))
    for kind in ("int", "double", "decimal(20,0)"):
        docs = spark.createDataFrame([(i, "abcd" * i) for i in range(9)], "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text")
        got = sorted((int(x["doc_id"]), x["n_chars"], x["edited_sha256"]) for x in piecewise.compared(docs, per_range=2).collect())
        assert got == [(i, 4 * i, hashlib.sha256(piecewise.edited("abcd" * i, "abcd" * ((i + 1) % 9)).encode()).hexdigest()) for i in range(9)]


# Near-duplicates: operator 7


def classes_by_brute_force(texts):
    from quillgrid.llm.probminhash import Shingles, similarity

    s = Shingles()
    sets = {i: s(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared = defaultdict(lambda: defaultdict(int))
    where = defaultdict(list)
    for i, (h, _) in sets.items():
        for x in h.tolist():
            for j in where[x]:
                shared[i][j] += 1
            where[x].append(i)
    for i, others in shared.items():
        for j in others:
            if max(similarity(sets[i], sets[j])) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def near_copies(n, seed):
    """Groups of exact and near copies around some texts, and texts alone that share a long passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    passage = [word() for _ in range(50)]
    out = []
    for _ in range(n):
        t = [word() for _ in range(r.randint(6, 120))]
        for _ in range(r.choice([1, 1, 2, 5])):
            c = list(t)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                c[r.randrange(len(c))] = word()
            out.append(" ".join(c))
        out.append(" ".join(passage + [word() for _ in range(40)]))
    r.shuffle(out)
    return dict(enumerate(out))


def test_classes_equal_brute_force(spark):
    from quillgrid.llm import probminhash

    texts = near_copies(40, 3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    assert {r["doc_id"]: r["class_id"] for r in probminhash.classes(docs).collect()} == classes_by_brute_force(texts)


def test_classes_of_the_table(spark):
    from quillgrid.llm import probminhash

    if not os.path.isdir(DATA):
        pytest.skip("the tables are not here")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect() if r["text"] is not None}
    want, first = classes_by_brute_force(texts), {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    assert {r["doc_id"]: r["class_id"] for r in probminhash.classes(docs).collect() if r["doc_id"] in texts} == {i: min(want[first[t]], want[i]) for i, t in texts.items()}


def test_plain_copies_that_probability_misses(spark):
    """Plain Jaccard 0.88, probability Jaccard 0.58: linked by the second registers, whichever of 60 pairs it is."""
    from quillgrid.llm import probminhash

    texts = {}
    for i in range(60):
        text, passage = (" ".join(f"{x}{i}x{k}" for k in range(n)) for x, n in (("a", 130), ("b", 12)))
        texts |= {2 * i: text, 2 * i + 1: f"{text} {' '.join([passage] * 800)}"}
    s = probminhash.Shingles()
    assert probminhash.similarity(s(texts[0]), s(texts[1]))[1] > 0.85 > 0.61 > probminhash.similarity(s(texts[0]), s(texts[1]))[0]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["class_id"] for r in probminhash.classes(docs).collect()} == {k: k // 2 * 2 for k in texts}


def family(n, seed):
    """Texts that share a passage, too little to be near copies, and pairs among them that share a little more."""
    r = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(178))
    texts = {}
    for i in range(n):
        both = " ".join(f"q{i // 2}x{k}" for k in range(4))
        texts[i * 7 + 3] = f"{passage} {both} " + " ".join(f"o{r.randrange(10**9)}" for _ in range(22))
    return texts


def test_pairs_in_a_family_are_all_found(spark):
    from quillgrid.llm import probminhash

    texts = family(160, 9)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    want = classes_by_brute_force(texts)
    assert 60 < len(set(want.values())) < 120
    assert {r["doc_id"]: r["class_id"] for r in probminhash.classes(docs).collect()} == want


def test_similar_sets_meet_in_their_prefixes():
    from quillgrid.llm.probminhash import prefix, similarity

    r = np.random.default_rng(8)
    near = 0
    for _ in range(3000):
        often = r.integers(1, 5, 60)
        a, b = (np.sort(r.choice(60, r.integers(1, 60), replace=False)).astype(np.uint64) for _ in range(2))
        b = np.union1d(a[r.random(len(a)) < 0.93], b[r.random(len(b)) < 0.1])
        if not len(b):
            continue
        (wa, wb) = (1 + np.log(r.integers(1, 4, len(x))) for x in (a, b))
        if max(similarity((a, wa), (b, wb))) >= 0.8:
            near += 1
            assert set(a[prefix(a, wa, often[a.astype(int)], 0.8)].tolist()) & set(b[prefix(b, wb, often[b.astype(int)], 0.8)].tolist())
    assert near > 300


def test_no_similar_pair_is_out_of_reach(spark):
    """The bounds at the first common shingle, against similarities of weighted sets."""
    from quillgrid.llm.probminhash import prefix, reachable, similarity

    r = np.random.default_rng(5)
    rows, near = [], []
    for _ in range(2500):
        often = r.integers(1, 5, 60)
        a = np.sort(r.choice(60, r.integers(2, 60), replace=False)).astype(np.uint64)
        b = np.union1d(a[r.random(len(a)) < 0.95], r.choice(60, r.integers(0, 6), replace=False).astype(np.uint64))
        wa, wb = (1 + np.log(r.integers(1, 4, len(x))) for x in (a, b))
        if r.random() < 0.5:
            wb = np.array([dict(zip(a.tolist(), wa)).get(x, y) for x, y in zip(b.tolist(), wb)])
        row = []
        for x, w, other in ((a, wa, b), (b, wb, a)):
            order = prefix(x, w, often[x.astype(int)], 0.8)
            k = next((k for k, i in enumerate(order) if x[i] in other), None)
            row += [None] if k is None else [(len(x), float(w.sum()), float(w.max()), k, float(w[order[:k]].sum()))]
        close = max(similarity((a, wa), (b, wb))) >= 0.8
        assert not close or None not in row
        if None not in row:
            rows.append((*row[0], *row[1], bool(close)))
    names = [f"{n}_{c}" for c in "ab" for n in ("n", "weight", "most", "n_before", "before")]
    df = spark.createDataFrame(rows, [*names, "near"])
    told = df.select("near", reachable(0.8).alias("reach")).groupBy("near", "reach").count().collect()
    counts = {(x["near"], x["reach"]): x["count"] for x in told}
    assert counts[True, True] > 500 and (True, False) not in counts and counts[False, False] > 50


def test_repeated_passages_keep_plain_copies(spark):
    from quillgrid.llm import probminhash

    texts = {}
    for i in range(20):  # plain Jaccard 0.82, probability Jaccard about 0.5
        text, passage = (" ".join(f"{x}{i}x{k}" for k in range(n)) for x, n in (("a", 104), ("b", 18)))
        texts |= {2 * i: text, 2 * i + 1: f"{text} {' '.join([passage] * 50)}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["class_id"] for r in probminhash.classes(docs).collect()} == {k: k // 2 * 2 for k in texts}


def test_classes_of_odd_rows(spark):
    from quillgrid.llm import probminhash

    rows = [(1, None), (2, ""), (3, ""), (4, " "), (5, "one two"), (6, "one two"), (None, "one two"), (7, None), (5, "one two"), (8, "w " * 5000), (None, "alone"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 as class_id", "'x' as h", "true as Key", "2 as rid")
    got = probminhash.classes(docs)
    assert dict(got.dtypes)["doc_id"] == "int"
    want = [(1, 1, True), (2, 2, True), (3, 2, False), (4, 4, True), (5, 5, True), (6, 5, False), (None, 5, False), (7, 7, True), (5, 5, True), (8, 8, True), (None, None, True), (None, None, True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    kept = probminhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id is not null").collect() if r["doc_id"] != 1 and r["doc_id"] != 7) == [(2, ""), (4, " "), (5, "one two"), (8, "w " * 5000)]
    assert kept.count() == 8 and kept.where("doc_id is null").count() == 2
    assert probminhash.classes(docs.limit(0)).count() == 0 and probminhash.representatives(docs.limit(0)).count() == 0


def test_ids_that_several_texts_carry(spark):
    from quillgrid.llm import probminhash

    near = lambda x, *more: " ".join([*(f"{x}{k}" for k in range(60)), *more])
    rows = [(1, near("a")), (1, near("b")), (2, near("b", "z")), (3, near("a", "z")), (1, near("b")), (None, near("c")), (None, near("c", "z")), (None, near("c"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = probminhash.representatives(docs).collect()
    assert sorted((r["doc_id"], r["text"][:1]) for r in kept if r["doc_id"]) == [(1, "a"), (1, "b")] and [r["text"][:1] for r in kept if not r["doc_id"]] == ["c"]
    assert {(r["doc_id"], r["class_id"]) for r in probminhash.classes(docs).collect()} == {(1, 1), (2, 1), (3, 1), (None, None)}


def test_registers_estimate_probability_jaccard():
    from quillgrid.llm.probminhash import registers, similarity

    r = np.random.default_rng(4)
    for share in (0.2, 0.5, 0.9):
        h = r.integers(0, 2**63, 400).astype(np.uint64)
        k = int(400 * share)
        a = np.sort(h[: 200 + k // 2]), None
        b = np.sort(h[200 - k // 2 :]), None
        a, b = ((x, 1 + r.integers(0, 2, len(x)).astype(float)) for x, _ in (a, b))
        est = np.mean([np.mean(registers(a[0] ^ np.uint64(s), a[1]) == registers(b[0] ^ np.uint64(s), b[1])) for s in r.integers(0, 2**63, 12)])
        exact = similarity((a[0], a[1]), (b[0], b[1]))[0]
        assert abs(est - exact) < 0.04
        total = 0.0  # the definition, pair by pair
        wa, wb = dict(zip(a[0].tolist(), a[1])), dict(zip(b[0].tolist(), b[1]))
        for d in wa.keys() & wb.keys():
            total += 1 / sum(max(wa.get(x, 0) / wa[d], wb.get(x, 0) / wb[d]) for x in wa.keys() | wb.keys())
        assert total == pytest.approx(exact, rel=1e-9)


def test_components(spark):
    from quillgrid.llm.common import ensure_checkpoint_dir
    from quillgrid.llm.graph import components, relabelled

    ensure_checkpoint_dir(spark)
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(1000, k) for k in range(900, 960)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    whole = {r["node"]: r["label"] for r in components(frame(edges)).collect()}
    assert all(whole[x] == find(x) for x in whole) and {x for a, b in edges if a != b for x in (a, b)} == set(whole)
    steps = relabelled(relabelled(None, frame(edges[:50])), frame(edges[50:]))
    assert {r["node"]: r["label"] for r in steps.collect()} == whole


# Mixing: operator 9


def test_targets():
    from quillgrid.llm.mixing import targets

    t = targets([100, 100, 100])
    assert t == pytest.approx([200, 166.6667, 83.3333], abs=1e-3) and sum(t) == pytest.approx(450)
    assert targets([]) == [] and targets([0, 0]) == [0, 0]
    t = targets([1, 1000, 0, 50])
    assert t[0] == 2 and t[2] == 0 and t[3] == 100 and sum(t) == pytest.approx(1.5 * 1051)


def test_tree_splits_quotas():
    from quillgrid.llm.mixing import split

    q = np.array([50, 0, 7, 120])
    out = split(q, 9, np.random.default_rng(1))
    assert (out.sum(1) == q).all() and out.min() >= 0 and out.sum(0).max() - out.sum(0).min() <= 1
    means = np.mean([split(q, 4, np.random.default_rng(k))[3] for k in range(300)], axis=0)
    assert abs(means - 30).max() < 1.5


def test_mix(spark):
    from quillgrid.llm import mixing

    r = random.Random(6)
    sources = ["a", "b", "é", None, "c"]
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 30))) if i % 17 else None, sources[0] if r.random() < 0.4 else r.choice(sources)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as block", "'h' as h")
    first = {x["doc_id"]: x for x in mixing.taken(docs).collect()}
    again = {x["doc_id"]: x for x in mixing.taken(docs.repartition(7)).collect()}
    assert first == again and len(first) == len(rows)
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in order}
    wanted = dict(zip(order, mixing.targets([size[s] for s in order])))
    for s in order:
        mine = [first[i] for i, _, x in rows if x == s]
        assert {(m["source_size"], round(m["target"], 6)) for m in mine} == {(size[s], round(wanted[s], 6))}
        assert abs(sum(m["taken"] for m in mine) - wanted[s]) <= 15
    assert all(m["taken"] in (0, m["size"], 2 * m["size"]) for m in first.values())
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    counts = {x["doc_id"]: x["count"] for x in mix.groupBy("doc_id").count().collect()}
    assert all(counts.get(i, 0) == len(first[i]["shards"]) for i in first)


@pytest.mark.parametrize("shards", [2, 16])
def test_shards_of_the_mix(spark, shards):
    """The tree's draws: each taken block lies whole in one shard for each time that it is taken, and shards are alike."""
    from pyspark.sql import functions as F

    from quillgrid.llm import mixing

    r = random.Random(shards)
    rows = [(i, " ".join("w" for _ in range(r.randint(5, 15))), r.choice("aaaabbc")) for i in range(24_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = int(1.5 * sum(len(t.split()) for _, t, _ in rows)) // shards
    sizes = mixing.sized(docs, "text", "doc_id", "source")
    p = mixing.plan(sizes, words)
    assert p.shards == shards
    blocks = p.blocks.collect()
    units = [s for b in blocks for s in [*b["whole"], *([b["part"]] if b["part"] is not None else [])]]
    per = np.bincount(units, minlength=shards)
    assert len(per) == shards and per.max() - per.min() <= 1
    rows_of = mixing.drawn(sizes, p).select("doc_id", "source", "size", "h", "shards_").collect()
    at = {(b["source"], b["block"]): b for b in blocks}
    count = {x["source"]: x["blocks"] for x in p.sources.collect()}
    whole = 0
    for x in rows_of:
        b = at.get((x["source"], x["h"] % count[x["source"]]))
        if b is None:
            assert x["shards_"] == []
        elif b["part"] is None:
            whole += 1
            assert x["shards_"] == list(b["whole"])
        else:
            assert x["shards_"] in (list(b["whole"]), [*b["whole"], b["part"]])
    assert whole > 0.9 * len(rows)
    got = {x["doc_id"]: x for x in mixing.taken(docs, shard_words=words).collect()}
    for s in "abc":
        mine = [x for x in got.values() if rows[x["doc_id"]][2] == s]
        assert abs(sum(x["taken"] for x in mine) - mine[0]["target"]) <= 8
    in_shard = np.zeros((shards, 3))
    for x in got.values():
        for k in x["shards"]:
            in_shard[k, "abc".index(rows[x["doc_id"]][2])] += x["size"]
    share = in_shard / in_shard.sum(1, keepdims=True)
    assert abs(share - in_shard.sum(0) / in_shard.sum()).max() < 0.25 and in_shard.sum(1).max() < 1.4 * in_shard.sum(1).min()
    out = mixing.mixed(docs, shard_words=words).withColumn("place", F.spark_partition_id()).collect()
    assert len({x["place"] for x in out}) == shards
    mixed_in = defaultdict(list)
    for x in out:
        mixed_in[x["doc_id"]].append(x["place"])
    assert all(sorted(mixed_in[i]) == sorted(x["shards"]) for i, x in got.items())
    first = [x["doc_id"] for x in out if x["place"] == 0]
    assert abs(np.corrcoef(range(len(first)), first)[0, 1]) < 0.1


def test_targets_by_rounds():
    """Against sharing again and again until no source is above its limit."""
    from quillgrid.llm.mixing import targets

    r = random.Random(4)
    for _ in range(300):
        sizes = [r.choice([0, 1, 5, 100, 1000, 10**6]) * r.randint(1, 9) for _ in range(r.randint(1, 9))]
        weight, out, rest, free = [(5, 2, 1)[i % 3] for i in range(len(sizes))], {}, 1.5 * sum(sizes), set(range(len(sizes)))
        while free:
            each = rest / sum(weight[i] for i in free)
            full = {i for i in free if each * weight[i] > 2 * sizes[i]}
            out |= {i: 2 * sizes[i] if full else each * weight[i] for i in full or free}
            if not full:
                break
            rest -= sum(out[i] for i in full)
            free -= full
        assert targets(sizes) == pytest.approx([out[i] for i in range(len(sizes))])


def test_oversized_shards_are_dealt_to_pieces(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quillgrid.llm import mixing

    monkeypatch.setattr(mixing, "MOST_SHARDS", 2)
    docs = spark.createDataFrame([(i, "a b c", "s") for i in range(3000)], "doc_id long, text string, source string")
    out = mixing.mixed(docs, shard_words=2000).withColumn("place", F.spark_partition_id()).groupBy("place").count().collect()
    assert len(out) > 4 and abs(sum(x["count"] for x in out) - 4500) <= 1


def test_mix_of_little(spark):
    from quillgrid.llm import mixing

    make = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string, source string")
    assert mixing.taken(make()).count() == 0 and mixing.mixed(make()).count() == 0
    assert [tuple(r)[1:5] for r in mixing.taken(make((1, None, "a"))).collect()] == [(0, 0, 0.0, 0)]
    same = mixing.taken(make((1, "a b", "s"), (1, "a b", "s"), (None, "c d", "s"))).collect()
    assert len(same) == 3 and same[0]["source_size"] == 6


# The pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from quillgrid.llm import mixing, queries

    if not os.path.isdir(DATA):
        pytest.skip("the tables are not here")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    here = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, here, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        here = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = here
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    predicted = {r["doc_id"]: r for r in queries.op3_language_id(spark, DATA).collect()}
    assert ids(kept["language ID"]) == {i for i, r in predicted.items() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.SURE}
    texts = {r["doc_id"]: r["text"] for r in kept["quality classifier"].collect()}
    classes = classes_by_brute_force(texts)
    by_text = defaultdict(list)
    for i, t in texts.items():
        by_text[t].append(i)
    assert ids(kept["near-dedup"]) == {i for i in texts if classes[i] == i and min(by_text[texts[i]]) == i}
    taken = {r["doc_id"]: len(r["shards"]) for r in mixing.taken(kept["near-dedup"]).collect()}
    counts = {r["doc_id"]: r["count"] for r in kept["mixing"].groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in taken.items() if n}
    assert kept["BPE encoding"].count() == kept["mixing"].count()
    assert corpus_pipeline.run(spark, DATA).count() == kept["BPE encoding"].count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, None, "en", "s"), (2, "", None, None), (None, "some words that are english enough to stay here", "en", "s"), (3, "some words that are english enough to stay here", "en", "s"), (3, "some words that are english enough to stay here", "en", "s")]
    spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for n in (len(rows), 0):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").limit(n).selectExpr("*", "length(text) as n_chars", "1 as language", "2 as quality", "3 as token_ids_")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{n}-{k}")
        assert docs.count() <= 2 * n


def test_the_rest_does_without(tmp_path):
    """Without these folders the entry still imports and has its other queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/quillgrid", tmp_path / "quillgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 80 and len(o) > 80 and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
