"""Queries over the event log, orders as runs, conversations as a graph, and small literal tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import aggregates, collect, compare, dedup, graph, incremental, joins, ordering, sets
from ..sources.corpus import documents, table
from .tables import DOCS, LOG, RUNS, TURNS, Query, log, runs, turns

CALLS = """k AS (SELECT file, line, linter, count(*) FILTER (seq % 3 <> 0) AS na, count(*) FILTER (seq % 4 <> 0) AS nb FROM log GROUP BY ALL)"""


def sides(s, d):
    """Two overlapping result sets of the same log: what two tools saw. Messages are alike, so keys repeat."""
    x = log(s, d).withColumn("message", F.col("linter")).withColumn("column", F.lit(0))
    return x.where("seq % 3 <> 0"), x.where("seq % 4 <> 0")


def paired_keys(s, d):
    a, b = sides(s, d)
    return compare.paired(a, b).groupBy("file", "line", "linter").agg(F.count("*").alias("n"))


def only(which):
    def run(s, d):
        a, b = sides(s, d)
        return (compare.only(a, b) if which == "a" else compare.only(b, a)).groupBy("file", "line", "linter").agg(F.count("*").alias("n"))

    return run


def bag(which):
    def run(s, d):
        a, b = sides(s, d)
        key = ("file", "line", "linter")
        out = sets.bag_overlap(a, b, *key) if which == "both" else sets.bag_only(a, b, *key) if which == "a" else sets.bag_only(b, a, *key)
        return out.groupBy(*key).agg(F.count("*").alias("n"))

    return run


BAG = "WITH {log}, {k} SELECT file, line, linter, {n} AS n FROM k WHERE {n} > 0"


def bag_sql(n):
    return BAG.format(log=LOG, k=CALLS, n=n)


def results(s, d):
    """Lines of orders as results of runs."""
    x = table(s, d, "lineitem")
    return x.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("ordinal"), F.when(F.col("l_returnflag") == "R", "unused").otherwise(F.col("l_returnflag")).alias("linter"), F.col("l_linestatus").alias("message"), F.lit("error").alias("severity"), (F.col("l_partkey") % 16).cast("string").alias("file"), F.col("l_linenumber").alias("line"), F.lit(0).alias("column"))


SUPERSEDED = "gone AS (SELECT DISTINCT a.run_id FROM runs a JOIN runs b ON a.package = b.package AND b.compiles AND len(b.go_files) > len(a.go_files) AND list_has_all(b.go_files, a.go_files))"
RESULTS = """results AS (SELECT l_orderkey AS run_id, l_linenumber AS ordinal, CASE WHEN l_returnflag = 'R' THEN 'unused' ELSE l_returnflag END AS linter, l_linestatus AS message, CAST(l_partkey % 16 AS VARCHAR) AS file, l_linenumber AS line FROM lineitem),
left_over AS (SELECT * FROM results WHERE linter <> 'unused' OR run_id NOT IN (SELECT run_id FROM gone)),
kept AS (SELECT * FROM left_over QUALIFY row_number() OVER (PARTITION BY file, line, linter, message ORDER BY run_id, ordinal) = 1)"""


def collected(s, d, which):
    return collect.collect(runs(s, d), results(s, d), ignored=("N",))[which]


def sources(s, d):
    return incremental.source_digests(documents(s, d))


def package_edges(s, d):
    """Each package depends on the same source's English package, and English ones on src0's."""
    p = documents(s, d).select("package").distinct().select("package", F.split("package", "/")[0].alias("source"), F.split("package", "/")[1].alias("lang"))
    first = p.where("lang <> 'en'").select(F.col("package").alias("src"), F.concat("source", F.lit("/en")).alias("dst"))
    return first.union(p.where("lang = 'en' and source <> 'src0'").select("package", F.lit("src0/en")))


FRAMED = "strlen({0}) || ':' || {0}"


def set_digest(by, name, rows):
    """SQL of an order-insensitive digest: of rows (by, r), by the first two digits of r, then of these digests."""
    return f"SELECT {by}, sha256(string_agg(d, '' ORDER BY s)) AS {name}, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {by}, left(r, 2) AS s, sha256(string_agg(r, '' ORDER BY r)) AS d, count(*) AS n FROM ({rows}) GROUP BY {by}, left(r, 2)) GROUP BY {by}"


ROWDIGEST = f"sha256({FRAMED.format('file')} || {FRAMED.format('hash')})"
SOURCES = f"{DOCS}, hashed AS (SELECT package, file, sha256(text) AS hash FROM docs), sources AS ({set_digest('package', 'source', f'SELECT package, {ROWDIGEST} AS r FROM hashed')})"
PACKAGES = """p AS (SELECT DISTINCT package, split_part(package, '/', 1) AS src0, split_part(package, '/', 2) AS lang FROM docs),
edges AS (SELECT package AS src, src0 || '/en' AS dst FROM p WHERE lang <> 'en' UNION ALL SELECT package, 'src0/en' FROM p WHERE lang = 'en' AND src0 <> 'src0'),
below AS (SELECT src AS package, dst AS dep FROM edges UNION SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src)"""
DEPS = f"""deps AS (SELECT s.package, coalesce(d.deps, repeat('0', 64)) AS deps FROM sources s LEFT JOIN ({set_digest('package', 'deps', f"SELECT b.package, sha256({FRAMED.format('dep')} || {FRAMED.format('s.source')}) AS r FROM below b JOIN sources s ON s.package = b.dep")}) d USING (package))"""
KEYSQL = "sha256(" + " || ".join(FRAMED.format(x) for x in ("'1'", "'result'", "package", "source", "deps", "'rules'", "'filter'", "'tool'", "'env'")) + ")"


def deps(s, d):
    return incremental.closure_digests(package_edges(s, d), sources(s, d))


def keys(s, d):
    src = sources(s, d)
    return incremental.result_keys(src, incremental.closure_digests(package_edges(s, d), src), "rules", "filter", "tool", "env")


def loops(s, d):
    """A graph of several cycles of different lengths with long ways into them: customers modulo 129, each leading to its square, every fourth also to its half."""
    x = table(s, d, "customer").select((F.col("c_custkey") % 129).alias("x")).distinct()
    return x.select(F.col("x").alias("src"), (F.col("x") * F.col("x") % 129).alias("dst")).union(x.where("x % 4 = 0").select("x", F.floor(F.col("x") / 2).alias("dst"))).distinct()


LOOPS = "x AS (SELECT DISTINCT c_custkey % 129 AS x FROM customer), loops AS (SELECT x AS src, x * x % 129 AS dst FROM x UNION SELECT x, x // 2 FROM x WHERE x % 4 = 0)"
CLOSURE = "WITH RECURSIVE {t}, r AS (SELECT {a} AS root, {b} AS node FROM {g} UNION SELECT r.root, {g}.{y} FROM r JOIN {g} ON {g}.{x} = r.node)"


def closure_sql(t, g, x, y, tail):
    return CLOSURE.format(t=t, g=g, a=x, b=y, x=x, y=y) + " " + tail


ACCESS = "cached AS (SELECT o_orderkey AS key, o_orderdate AS mtime, CAST(o_custkey AS BIGINT) AS size FROM orders)"


def cached(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("mtime"), F.col("o_custkey").cast("long").alias("size"))


def evict_over_budget(s, d):
    c = cached(s, d)
    total = c.agg(F.sum("size")).first()[0] or 0
    return incremental.over_budget(c, total // 2).select("key")


def names(s, d, where):
    return table(s, d, "part").where(where).select(F.col("p_name").alias("name")).distinct()


def active(s, d):
    catalog = table(s, d, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") % 5 == 0, "formatter").otherwise("native").alias("shape"))
    return sets.active_set(catalog, names(s, d, "p_size < 10"), names(s, d, "p_size > 30"), names(s, d, "p_size = 35 or p_size = 3"), names(s, d, "p_size = 50"))


def packages(s, d):
    """Customers' packages: a test variant for every fifth run."""
    r = runs(s, d)
    return r.select(F.col("run_id").cast("string").alias("id"), F.col("package").alias("path"), F.when(F.col("run_id") % 5 == 0, F.col("package")).when(F.col("run_id") % 5 == 1, F.lit("other")).otherwise("").alias("for_test"), F.col("go_files").alias("files"))


PACKS = f"{RUNS}, packs AS (SELECT CAST(run_id AS VARCHAR) AS id, package AS path, CASE run_id % 5 WHEN 0 THEN package WHEN 1 THEN 'other' ELSE '' END AS for_test, len(go_files) AS n FROM runs)"

QUERIES = [
    Query("owner_left_join", lambda s, d: joins.owned(log(s, d).select("seq", "file"), table(s, d, "customer").select(F.concat(F.lit("user/"), F.col("c_custkey").cast("string"), F.lit(".txt")).alias("file"), F.col("c_mktsegment").alias("package"))).select("seq", "package"), f"WITH {LOG} SELECT seq, coalesce(c_mktsegment, '') AS package FROM log LEFT JOIN customer ON file = 'user/' || c_custkey || '.txt'"),
    Query("ownerless_bucket", lambda s, d: joins.owned(log(s, d).select("seq", "file", "linter"), table(s, d, "supplier").select(F.concat(F.lit("user/"), F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("file"), F.lit("known").alias("package"))).where("package = ''").groupBy("linter").agg(F.count("*").alias("n")), f"WITH {LOG} SELECT linter, count(*) AS n FROM log LEFT JOIN supplier ON file = 'user/' || s_suppkey || '.txt' WHERE s_suppkey IS NULL GROUP BY linter"),
    Query("cache_hits", lambda s, d: joins.cache_hits(table(s, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey"), table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"),
    Query("cache_misses", lambda s, d: joins.cache_misses(table(s, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey"), table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"),
    Query("test_variant_supersede", lambda s, d: joins.without_test_superseded(packages(s, d)).select("id"), f"WITH {PACKS} SELECT id FROM packs p WHERE for_test <> '' OR NOT EXISTS (SELECT 1 FROM packs q WHERE q.for_test = q.path AND q.path = p.path)"),
    Query("package_preference", lambda s, d: dedup.package_preference(packages(s, d)).select("path", "id"), f"WITH {PACKS} SELECT path, id FROM packs QUALIFY row_number() OVER (PARTITION BY path ORDER BY for_test <> '', n, id) = 1"),
    Query("alias_resolution", lambda s, d: joins.resolved_aliases(table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("path"), F.col("n_name").alias("file")), table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source"), F.col("s_nationkey").cast("string").alias("target"))), "SELECT CAST(n_nationkey AS VARCHAR) AS path, n_name AS file FROM nation UNION ALL SELECT 's' || s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey"),
    Query("canonical_path_resolve", lambda s, d: joins.resolved_paths(documents(s, d).select("file"), documents(s, d).select("package").distinct().where("instr(package, 'fr') > 0").select("package", F.concat(F.lit("/abs/"), "package").alias("dir"))), f"WITH {DOCS} SELECT CASE WHEN instr(package, 'fr') > 0 THEN '/abs/' || file ELSE file END AS file FROM docs"),
    Query("bag_overlap", bag("both"), bag_sql("least(na, nb)")),
    Query("bag_only_left", bag("a"), bag_sql("greatest(na - nb, 0)")),
    Query("bag_only_right", bag("b"), bag_sql("greatest(nb - na, 0)")),
    Query("paired_rows", paired_keys, bag_sql("least(na, nb)")),
    Query("unpaired_left", only("a"), bag_sql("greatest(na - nb, 0)")),
    Query("unpaired_right", only("b"), bag_sql("greatest(nb - na, 0)")),
    Query("per_linter_full_outer", lambda s, d: compare.per_linter(*sides(s, d)), f"WITH {LOG}, {CALLS} SELECT linter, CAST(sum(na) AS BIGINT) AS n_a, CAST(sum(nb) AS BIGINT) AS n_b, CAST(sum(least(na, nb)) AS BIGINT) AS overlap, CAST(sum(na - least(na, nb)) AS BIGINT) AS only_a, CAST(sum(nb - least(na, nb)) AS BIGINT) AS only_b FROM k GROUP BY linter"),
    Query("superseded_runs", lambda s, d: joins.superseded_runs(runs(s, d)), f"WITH {RUNS}, {SUPERSEDED} SELECT run_id FROM gone"),
    Query("collect_dedup", lambda s, d: collected(s, d, 0).select("run_id", "ordinal", "linter", "message", "file", "line"), f"WITH {RUNS}, {SUPERSEDED}, {RESULTS} SELECT run_id, ordinal, linter, message, file, line FROM kept"),
    Query("collect_verdict", lambda s, d: collected(s, d, 1), f"WITH {RUNS}, {SUPERSEDED}, {RESULTS} SELECT (SELECT count(*) FROM kept) AS findings, (SELECT count(*) FROM kept WHERE linter <> 'N') AS enforced, (SELECT count(*) FROM kept WHERE linter = 'N') AS ignored, (SELECT count(*) FROM results WHERE linter = 'unused' AND run_id IN (SELECT run_id FROM gone)) AS superseded"),
    Query("first_row_per_key", lambda s, d: dedup.first_of(log(s, d).select("seq", "linter", "file", "line"), ("file", "line", "linter"), ("seq",)), f"WITH {LOG} SELECT seq, linter, file, line FROM log QUALIFY row_number() OVER (PARTITION BY file, line, linter ORDER BY seq) = 1"),
    Query("numbered_names", lambda s, d: dedup.numbered_names(log(s, d).select("seq", F.col("linter").alias("name"))).select("seq", "unique_name"), f"WITH {LOG} SELECT seq, CASE WHEN k = 0 THEN linter ELSE printf('%s#%02d', linter, k) END AS unique_name FROM (SELECT seq, linter, row_number() OVER (PARTITION BY linter ORDER BY seq) - 1 AS k FROM log)"),
    Query("sliding_median_128", lambda s, d: aggregates.sliding_median(log(s, d).select("seq", F.col("linter").alias("bucket"), "v"), 500), f"""WITH {LOG}, o AS (SELECT seq, linter AS bucket, v FROM log WHERE v <> 0), h AS (SELECT *, list_sort(list(v) OVER (PARTITION BY bucket ORDER BY seq ROWS 127 PRECEDING)) AS l FROM o)
SELECT seq, bucket, v, CASE WHEN len(l) < 10 THEN 500 WHEN len(l) % 2 = 1 THEN l[len(l) // 2 + 1] ELSE l[len(l) // 2] + (l[len(l) // 2 + 1] - l[len(l) // 2]) // 2 END AS estimate FROM h"""),
    Query("evict_over_budget", evict_over_budget, f"WITH {ACCESS} SELECT key FROM (SELECT key, sum(size) OVER (ORDER BY mtime DESC, key) AS run FROM cached) WHERE run >= (SELECT sum(size) // 2 FROM cached)"),
    Query("evict_by_age", lambda s, d: incremental.aged_out(cached(s, d), F.lit("1998-01-31 00:00:00").cast("timestamp"), 30).select("key"), f"WITH {ACCESS} SELECT key FROM cached WHERE mtime < TIMESTAMP '1998-01-01 00:00:00'"),
    Query("evict_least_recent", lambda s, d: incremental.least_recent(log(s, d).select(F.col("file").alias("key"), F.col("ts").alias("at"), F.lit(1).cast("long").alias("size")), 5).select("key"), f"WITH {LOG}, last AS (SELECT file AS key, max(ts) AS seen FROM log GROUP BY file) SELECT key FROM (SELECT key, row_number() OVER (ORDER BY seen DESC, key) AS run FROM last) WHERE run >= 6"),
    Query("mean_p95", lambda s, d: aggregates.mean_p95(log(s, d).where("v is not null").select(F.col("linter").alias("bucket"), "v")), f"WITH {LOG}, g AS (SELECT linter AS bucket, count(*) AS n, CAST(trunc(sum(v) / count(*)) AS BIGINT) AS mean, list_sort(list(v)) AS l FROM log WHERE v IS NOT NULL GROUP BY linter) SELECT bucket, n, mean, l[least(n * 95 // 100, n - 1) + 1] AS p95 FROM g"),
    Query("scenario_stats", lambda s, d: aggregates.scenario(log(s, d).select("linter", "v", "line"), "linter", "v", "line"), f"WITH {LOG}, g AS (SELECT linter, count(*) AS n, sum(v) AS sv, max(v) AS max_wall, min(v) AS min_wall, sum(line) AS sl, max(line) AS max_rss, list_sort(list(v)) AS l FROM log GROUP BY linter) SELECT linter, n, CAST(floor(sv / n) AS BIGINT) AS mean_wall, max_wall, min_wall, CAST(floor(sl / n) AS BIGINT) AS mean_rss, max_rss, l[least(n * 95 // 100, n - 1) + 1] AS p95_wall FROM g"),
    Query("top32_per_bucket", lambda s, d: ordering.top_per_bucket(log(s, d).select("linter", "v", "seq"), "linter", "v", 32, "seq"), f"WITH {LOG} SELECT linter, v, seq, CAST(row_number() OVER (PARTITION BY linter ORDER BY v DESC, seq) AS INTEGER) AS rank FROM log QUALIFY rank <= 32"),
    Query("peak_in_flight", lambda s, d: aggregates.peak_in_flight(table(s, d, "lineitem").select("l_returnflag", F.explode(F.array(F.struct(F.col("l_shipdate").alias("at"), F.lit(1).alias("delta")), F.struct((F.col("l_shipdate") + F.expr("interval 7 days")).alias("at"), F.lit(-1).alias("delta")))).alias("e")).groupBy("l_returnflag", F.col("e.at").alias("at"), F.col("e.delta").alias("sign")).agg(F.sum("e.delta").alias("delta")), "l_returnflag"), """WITH e AS (SELECT l_returnflag, l_shipdate AS moment, 1 AS delta FROM lineitem UNION ALL SELECT l_returnflag, l_shipdate + INTERVAL 7 DAY, -1 FROM lineitem), g AS (SELECT l_returnflag, moment, delta AS sign, sum(delta) AS delta FROM e GROUP BY ALL)
SELECT l_returnflag, CAST(greatest(max(run), 0) AS BIGINT) AS peak FROM (SELECT l_returnflag, sum(delta) OVER (PARTITION BY l_returnflag ORDER BY moment, delta ROWS UNBOUNDED PRECEDING) AS run FROM g) GROUP BY l_returnflag"""),
    Query("inverted_index", lambda s, d: aggregates.inverted_index(turns(s, d)).select("dst", F.array_join("importers", ",").alias("importers")), f"WITH {TURNS} SELECT dst, string_agg(DISTINCT src, ',' ORDER BY src) AS importers FROM turns GROUP BY dst"),
    Query("equivalence_classes", lambda s, d: aggregates.equivalence_classes(table(s, d, "lineitem").select(F.col("l_orderkey").alias("decl"), (F.col("l_partkey") % 3).cast("string").alias("ref"))).select("class", "n"), "WITH r AS (SELECT l_orderkey AS decl, string_agg(DISTINCT CAST(l_partkey % 3 AS VARCHAR), ',' ORDER BY CAST(l_partkey % 3 AS VARCHAR)) AS refs FROM lineitem GROUP BY 1) SELECT min(decl) AS class, count(*) AS n FROM r GROUP BY refs"),
    Query("active_set", active, """WITH named AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size < 10 OR p_size > 30), f AS (SELECT p_name FROM part WHERE p_size % 5 = 0), off AS (SELECT p_name FROM part WHERE p_size IN (3, 35))
SELECT name FROM named WHERE name NOT IN (SELECT p_name FROM f) AND name NOT IN (SELECT p_name FROM off) UNION SELECT p_name FROM part WHERE p_size = 50"""),
    Query("ordered_dedupe", lambda s, d: log(s, d).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seq", "linter"))).alias("x")).select("file", F.array_join(sets.ordered_distinct(F.transform("x", lambda e: e["linter"])), ",").alias("linters")), f"WITH {LOG}, f AS (SELECT file, linter, min(seq) AS seq FROM log GROUP BY ALL) SELECT file, string_agg(linter, ',' ORDER BY seq) AS linters FROM f GROUP BY file"),
    Query("append_unique", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(sets.append_unique(F.split("p_name", " "), F.split("p_type", " ")), " ").alias("words")), "SELECT p_partkey, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda e: list_position(w, e[1]) = e[2]), lambda e: e[1]), ' ') AS words FROM (SELECT p_partkey, list_concat(string_split(p_name, ' '), string_split(p_type, ' ')) AS w FROM part)"),
    Query("set_contains", lambda s, d: runs(s, d).select("run_id", sets.contains(F.col("go_files"), F.lit("3")).alias("has")), f"WITH {RUNS} SELECT run_id, list_contains(go_files, '3') AS has FROM runs"),
    Query("forward_closure", lambda s, d: graph.forward_closure(turns(s, d)), closure_sql(TURNS, "turns", "src", "dst", "SELECT root, node FROM r UNION SELECT src, src FROM turns UNION SELECT dst, dst FROM turns")),
    Query("reverse_closure", lambda s, d: graph.reverse_closure(turns(s, d)), closure_sql(TURNS, "turns", "dst", "src", "SELECT root, node FROM r UNION SELECT src, src FROM turns UNION SELECT dst, dst FROM turns")),
    Query("closure_minus_roots", lambda s, d: graph.closure_minus_roots(turns(s, d), turns(s, d).where("src like '%/3'").select(F.col("src").alias("node"))), f"WITH RECURSIVE {TURNS}, r AS (SELECT dst AS node FROM turns WHERE src LIKE '%/3' UNION SELECT dst FROM r JOIN turns ON src = node) SELECT node FROM r WHERE node NOT IN (SELECT src FROM turns WHERE src LIKE '%/3')"),
    Query("dependency_levels", lambda s, d: graph.levels(turns(s, d)), f"WITH {TURNS}, n AS (SELECT src AS node FROM turns UNION SELECT dst FROM turns) SELECT node, CAST(split_part(node, '/', 2) AS INTEGER) - min(CAST(split_part(node, '/', 2) AS INTEGER)) OVER (PARTITION BY split_part(node, '/', 1)) AS level FROM n"),
    Query("strong_components", lambda s, d: graph.components(loops(s, d)), closure_sql(LOOPS, "loops", "src", "dst", ", both_ways AS (SELECT a.root AS node, a.node AS other FROM r a JOIN r b ON a.root = b.node AND a.node = b.root WHERE a.root <> a.node), c AS (SELECT node, least(node, min(other)) AS component FROM both_ways GROUP BY node) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM c").replace(") , both", "), both")),
    Query("cycle_members", lambda s, d: graph.cycle_members(loops(s, d)), closure_sql(LOOPS, "loops", "src", "dst", "SELECT node FROM r WHERE root = node")),
    Query("cycle_breaking", lambda s, d: graph.without_cycle_edges(loops(s, d), loops(s, d).where("src % 3 <> 0").select(F.col("src").alias("node"))), closure_sql(LOOPS, "loops", "src", "dst", "SELECT src, dst FROM loops t WHERE src = dst OR src % 3 = 0 OR NOT EXISTS (SELECT 1 FROM r WHERE root = t.dst AND node = t.src)")),
    Query("stale_after_edit", lambda s, d: graph.stale(turns(s, d), table(s, d, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("package"), F.col("role").alias("file")), s.createDataFrame([("assistant",)], "file string")), f"WITH RECURSIVE {TURNS}, r AS (SELECT DISTINCT conv_id || '/' || turn AS node FROM conversations WHERE role = 'assistant' UNION SELECT src FROM r JOIN turns ON dst = node) SELECT node FROM r"),
    Query("reverse_dependencies", lambda s, d: graph.reverse_dependencies(turns(s, d), turns(s, d).where("dst like '%/0'").select(F.col("dst").alias("node"))), f"WITH {TURNS} SELECT DISTINCT src AS node FROM turns WHERE dst LIKE '%/0'"),
    Query("file_set_digest", sources, f"WITH {SOURCES} SELECT package, source FROM sources"),
    Query("dep_closure_digest", deps, f"WITH {SOURCES}, {PACKAGES}, {DEPS} SELECT package, deps FROM deps"),
    Query("cache_key", keys, f"WITH {SOURCES}, {PACKAGES}, {DEPS} SELECT package, {KEYSQL} AS key FROM sources JOIN deps USING (package)"),
    Query(
        "run_equivalence_digest",
        lambda s, d: aggregates.set_digest(results(s, d).withColumns({c: F.col(c).cast("string") for c in ("line", "column")}), ("run_id",), "file", "line", "column", "linter", "message", "severity"),
        set_digest("run_id", "digest", "SELECT l_orderkey AS run_id, sha256(" + " || ".join(FRAMED.format(x) for x in ("file", "line", "'0'", "linter", "message", "'error'")) + ") AS r FROM (SELECT l_orderkey, CAST(l_partkey % 16 AS VARCHAR) AS file, CAST(l_linenumber AS VARCHAR) AS line, CASE WHEN l_returnflag = 'R' THEN 'unused' ELSE l_returnflag END AS linter, l_linestatus AS message FROM lineitem)"),
    ),
    Query("shard_paths", lambda s, d: keys(s, d).select("package", fc.shard_path("key").alias("path")), f"WITH {SOURCES}, {PACKAGES}, {DEPS} SELECT package, left(key, 2) || '/' || key AS path FROM (SELECT package, {KEYSQL} AS key FROM sources JOIN deps USING (package))"),
    Query("overlay_read", lambda s, d: joins.with_overlay(documents(s, d).select(F.col("file").alias("path"), "text"), documents(s, d).where("package = 'src1/de'").select(F.col("file").alias("path"), F.lit("staged").alias("text"))).select("path", F.md5("text").alias("hash")), f"WITH {DOCS} SELECT file AS path, md5(CASE WHEN package = 'src1/de' THEN 'staged' ELSE text END) AS hash FROM docs"),
    Query("csv_items", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(fc.csv_items(F.concat(F.lit(" "), F.replace("p_type", F.lit(" "), F.lit(", ")), F.lit(",,"))), "|").alias("items")), "SELECT p_partkey, replace(p_type, ' ', '|') AS items FROM part"),
    Query("release_tags", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(fc.release_tags(F.col("p_size")), ",").alias("tags")), "SELECT p_partkey, array_to_string(list_transform(range(1, p_size + 1), lambda i: 'go1.' || i), ',') AS tags FROM part"),
]
