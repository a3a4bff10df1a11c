"""Queries of single operators, each bound to whole tables, beside the DuckDB text of what it computes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec, paths
from ..functions import columns as fc
from ..operators import aggregates, compare, graph, incremental, joins, ordering, sets, suppress
from ..sinks import writers
from ..sources import corpus, readers
from ..sources.corpus import documents, table
from ..streaming import suppress as streams
from .corpus_queries import CHECKS, CHECKS_SQL, SEQUENCED, sequenced
from .log_queries import FRAMED, PACKAGES, SOURCES, cached, package_edges, set_digest, sides, sources
from .tables import DOCS, LOG, TURNS, Query, findings, log, turns


def framed(*parts):
    return "sha256(" + " || ".join(FRAMED.format(x) for x in parts) + ")"


def checks(s, d):
    """Parts as findings of checks of many names: linter, message, severity, file, line, seq."""
    p = table(s, d, "part")
    linter = F.get(F.array(*[F.lit(x) for x in CHECKS]), (F.col("p_partkey") % len(CHECKS)).cast("int"))
    message = F.get(F.array(*[F.lit(x) for x in MESSAGES]), (F.col("p_size") % len(MESSAGES)).cast("int"))
    return p.select(F.col("p_partkey").alias("seq"), linter.alias("linter"), message.alias("message"), F.lit("error").alias("severity"), F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".go")).alias("file"), F.col("p_size").alias("line"), F.lit(0).alias("column"))


MESSAGES = (
    "Error return value of `f.Close` is not checked", "G104: Errors unhandled", "should have a package comment", "exported X should have comment or be unexported", "at least one file in a package should have a package comment (ST1000)",
    "net/http/httptest.NewRequest must not be called. use net/http/httptest.NewRequestWithContext", "plain message",
)
CHECKS_TABLE = f"""checks AS (SELECT p_partkey AS seq, {CHECKS_SQL}[p_partkey % {len(CHECKS)} + 1] AS linter, [{", ".join(f"'{m}'" for m in MESSAGES)}][p_size % {len(MESSAGES)} + 1] AS message, p_brand || '/' || p_partkey || '.go' AS file, p_size AS line FROM part),
named AS (SELECT *, CASE WHEN regexp_matches(linter, '^(SA|ST|S1|QF)') THEN 'staticcheck' WHEN linter IN ('copylocks', 'printf') THEN 'govet' ELSE linter END AS family FROM checks)"""


def kept_checks(config):
    return lambda s, d: suppress.apply(checks(s, d), config).select("seq")


OFF = {"once_per_line": False, "generated": "disable"}


def packages(s, d):
    """Packages with their files and a map from import path to package; an import from outside has no package."""
    files = documents(s, d).groupBy("package").agg(F.collect_list("file").alias("files"))
    deps = package_edges(s, d).groupBy(F.col("src").alias("package")).agg(F.map_from_entries(F.array_union(F.collect_list(F.struct(F.concat(F.lit("mod/"), "dst").alias("key"), F.col("dst").alias("value"))), F.array(F.struct(F.lit("fmt").alias("key"), F.lit("").alias("value"))))).alias("deps"))
    return files.join(deps, "package").select(F.col("package").alias("id"), "files", "deps", F.startswith("package", F.lit("src1")).alias("is_root"))


def listed(s, d):
    """Paths as a listing of a source tree has them."""
    folder = F.get(F.array(*[F.lit(x) for x in ("cmd/", "vendor/x/", "a/testdata/", "a/vendored/", "node_modules/", "a/.git/")]), (F.col("p_size") % 6).cast("int"))
    return table(s, d, "part").select(F.concat(folder, F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 4 == 0, ".md").otherwise(".go")).alias("path"))


def objects(s, d):
    return table(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("file"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 5).cast("string").alias("name"), (F.col("l_returnflag") == "R").alias("used"), (F.col("l_linestatus") == "F").alias("is_type_param"), "l_orderkey")


def parts_graph(s, d):
    """Parts as analyzers: each requires those of half and a third of its number."""
    p = table(s, d, "part")
    half, third = (F.floor(F.col("p_partkey") / k) for k in (2, 3))
    return p.select(F.col("p_partkey").alias("node"), F.filter(F.array(half, third), lambda x: x > 0).alias("needs"))


PARTS = "e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey >= 2 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey >= 3)"


def roots(s, d):
    return table(s, d, "part").where("p_partkey % 10 = 7").select(F.col("p_partkey").alias("node"))


def symbols(s, d):
    """Customers modulo 200 as declarations that refer to each other, some in circles, and to outside symbols from 1000 on."""
    x = table(s, d, "customer").select((F.col("c_custkey") % 200).alias("x")).distinct()
    return x.select(F.col("x").alias("src"), ((F.col("x") * F.col("x") + 3) % 200).alias("dst")).union(x.where("x % 5 = 0").select("x", F.lit(1000) + F.col("x") % 7)).distinct()


SYMBOLS = "x AS (SELECT DISTINCT c_custkey % 200 AS x FROM customer), e AS (SELECT x AS src, (x * x + 3) % 200 AS dst FROM x UNION SELECT x, 1000 + x % 7 FROM x WHERE x % 5 = 0)"


def comments(s, d):
    forms = ("//nolint", "// nolint:a, B // why", "/* nolint:all */", "//nolint:", "//nolintlint", "//nolint:a,,b", "// text", "//NoLint:x//y")
    return table(s, d, "part").select("p_partkey", F.get(F.array(*[F.lit(x) for x in forms]), (F.col("p_partkey") % len(forms)).cast("int")).alias("c"), (F.col("p_partkey") % len(forms)).alias("k"))


def wide_entries(s, d):
    keys = documents(s, d).select("package").distinct().withColumn("key", F.sha2("package", 256))
    return incremental.entries(keys, findings(s, d).where("package like 'src1%'"))


def events_as(s, d):
    """The event table as a log of cache and scheduler events."""
    e = table(s, d, "events")
    kind = lambda names, c: F.get(F.array(*[F.lit(x) for x in names]), (c % len(names)).cast("int"))
    return e.select(F.concat(F.lit("L"), (F.col("user_id") % 3).cast("string")).alias("tier"), kind(("hit", "miss", "store", "error", "other"), F.col("event_id")).alias("outcome"), kind(("acquire", "block", "pin", "live", "pin"), F.col("event_id")).alias("kind"), F.floor("value").cast("long").alias("wait"))


EVENTS = "ev AS (SELECT 'L' || user_id % 3 AS tier, ['hit', 'miss', 'store', 'error', 'other'][event_id % 5 + 1] AS outcome, ['acquire', 'block', 'pin', 'live', 'pin'][event_id % 5 + 1] AS kind, CAST(floor(value) AS BIGINT) AS wait FROM events)"


def members(s, d):
    return table(s, d, "part").select(F.col("p_partkey").cast("string").alias("name"), (F.col("p_size") % 2 == 0).alias("default_on"))


def chosen(s, d, where):
    return table(s, d, "part").where(where).select(F.col("p_partkey").cast("string").alias("name"))


def member_set(mode):
    return lambda s, d: sets.member_set(members(s, d), mode, chosen(s, d, "p_size % 5 = 1"), chosen(s, d, "p_size % 7 = 0"))


def fact_rows(s, d):
    x = table(s, d, "lineitem")
    return x.select((F.col("l_suppkey")).cast("string").alias("package"), F.col("l_returnflag").alias("analyzer"), F.col("l_orderkey").cast("string").alias("object"), F.col("l_linestatus").alias("value"), (F.col("l_linenumber") % 3).alias("version"))


def closure_of(t, g, start):
    return f"WITH RECURSIVE {t}, r AS ({start} UNION SELECT {g}.dst FROM r JOIN {g} ON {g}.src = r.node)"


QUERIES = [
    # sources
    Query("package_imports", lambda s, d: corpus.dependency_edges(packages(s, d)), f"WITH {DOCS}, {PACKAGES} SELECT src, 'mod/' || dst AS import_path, dst FROM edges UNION ALL SELECT DISTINCT src, 'fmt', '' FROM edges"),
    Query("package_files", lambda s, d: corpus.package_files(packages(s, d)), f"WITH {DOCS}, {PACKAGES} SELECT package AS id, file FROM docs WHERE package IN (SELECT src FROM edges)"),
    Query("root_packages", lambda s, d: corpus.roots(packages(s, d)).select("id"), f"WITH {DOCS}, {PACKAGES} SELECT DISTINCT src AS id FROM edges WHERE starts_with(src, 'src1')"),
    Query("listed_sources", lambda s, d: listed(s, d).where(paths.go_files(F.col("path"))), "SELECT path FROM (SELECT ['cmd/', 'vendor/x/', 'a/testdata/', 'a/vendored/', 'node_modules/', 'a/.git/'][p_size % 6 + 1] || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '.md' ELSE '.go' END AS path FROM part) WHERE path LIKE '%.go' AND NOT regexp_matches(path, '(^|/)(vendor|testdata|node_modules|\\.git)/')"),
    Query("namespaced_keys", lambda s, d: table(s, d, "part").select("p_partkey", fc.namespaced_key("p_type", "p_name").alias("key")), "SELECT p_partkey, sha256(p_type || chr(0) || p_name) AS key FROM part"),
    Query("plugin_rows", lambda s, d: readers.plugin_findings(checks(s, d).select(F.to_json(F.struct("file", "line", F.concat("message", F.lit(" \n")).alias("message"), F.lit("WARN").alias("severity"), "seq")).alias("value")), "mine", "/root/ws").select("linter", "message", "severity", "file", "line", "column"), f"WITH {CHECKS_TABLE} SELECT 'mine' AS linter, message, 'warning' AS severity, '/root/ws/' || file AS file, line, 0 AS \"column\" FROM checks"),
    Query("import_lines", lambda s, d: joins.resolved_aliases(*readers.import_config(table(s, d, "nation").select(F.concat(F.lit("packagefile "), "n_name", F.lit("="), F.lower("n_name"), F.lit(".a")).alias("value")).union(table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("importmap s"), F.col("s_suppkey").cast("string"), F.lit("="), "n_name"))).union(s.createDataFrame([("# comment",), ("",)], "value string")))), "SELECT n_name AS path, lower(n_name) || '.a' AS file FROM nation UNION ALL SELECT 's' || s_suppkey, lower(n_name) || '.a' FROM supplier JOIN nation ON n_nationkey = s_nationkey"),
    Query("versioned_facts", lambda s, d: readers.facts(fact_rows(s, d), 1).groupBy("package", "analyzer").agg(F.count("*").alias("n")), "SELECT CAST(l_suppkey AS VARCHAR) AS package, l_returnflag AS analyzer, count(*) AS n FROM lineitem WHERE l_linenumber % 3 = 1 GROUP BY ALL"),
    Query("dependency_facts", lambda s, d: readers.dependency_facts(fact_rows(s, d), table(s, d, "supplier").where("s_nationkey < 6").select(F.col("s_suppkey").cast("string").alias("package"))).select("package", "analyzer", "object"), "SELECT CAST(l_suppkey AS VARCHAR) AS package, l_returnflag AS analyzer, CAST(l_orderkey AS VARCHAR) AS object FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 6)"),
    Query(
        "worker_answers",
        lambda s, d: streams.answers(streams.requests(table(s, d, "orders").select(F.to_json(F.struct(F.col("o_orderkey").alias("requestId"), F.array("o_orderpriority", "o_orderstatus").alias("arguments"), F.when(F.col("o_orderkey") % 5 == 0, True).alias("cancel"), F.when(F.col("o_orderkey") % 7 == 0, "/x").alias("sandboxDir"))).alias("value"))), lambda a: F.array_join(a, " ")),
        "SELECT CAST(o_orderkey AS INTEGER) AS requestId, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS exitCode, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN 'sandboxed requests are not supported' ELSE o_orderpriority || ' ' || o_orderstatus END AS output, o_orderkey % 5 = 0 AS wasCancelled FROM orders",
    ),
    # suppression
    Query("preset_exclusions", kept_checks(suppress.Config(presets=("comments", "std-error-handling", "common-false-positives", "legacy"), keep_style_checks=True, **OFF)), f"WITH {CHECKS_TABLE} SELECT seq FROM named WHERE NOT (family = 'staticcheck' AND regexp_matches(message, 'ST1000|ST1020|ST1021|ST1022') OR family = 'errcheck' AND message LIKE 'Error return value%' OR family = 'staticcheck' AND contains(message, 'SA4011') OR linter = 'noctx' AND starts_with(message, 'net/http/httptest.NewRequest must'))"),
    Query("default_disabled", kept_checks(suppress.Config(**OFF)), f"WITH {CHECKS_TABLE} SELECT seq FROM named WHERE linter NOT IN ('ST1000', 'ST1003', 'ST1016', 'ST1020', 'ST1021', 'ST1022') AND NOT (linter = 'noctx' AND starts_with(message, 'net/http/httptest.NewRequest must not be called'))"),
    Query("version_skew", lambda s, d: checks(s, d).where(fc.version_skew()).select("seq"), f"WITH {CHECKS_TABLE} SELECT seq FROM checks WHERE linter = 'noctx' AND starts_with(message, 'net/http/httptest.NewRequest must not be called')"),
    Query("selected_names", lambda s, d: checks(s, d).where(fc.selects(F.array(F.lit("staticcheck"), F.lit("printf"), F.lit("lll")))).select("seq"), f"WITH {CHECKS_TABLE} SELECT seq FROM named WHERE linter IN ('staticcheck', 'printf', 'lll') OR family IN ('staticcheck', 'printf', 'lll')"),
    Query("hermetic_rules", lambda s, d: suppress.hermetic(checks(s, d), ("govet", "lll")).select("seq"), f"WITH {CHECKS_TABLE} SELECT seq FROM checks WHERE linter NOT IN ('govet', 'lll')"),
    Query("pruned_roots", lambda s, d: suppress.prune_roots(documents(s, d).select("package").distinct(), suppress.excluded_packages(documents(s, d), suppress.Config(paths=(r"^src[0-2]/",)))), f"WITH {DOCS} SELECT DISTINCT package FROM docs WHERE NOT regexp_matches(file, '^src[0-2]/')"),
    Query("test_variants_dropped", lambda s, d: suppress.without_intermediate_variants(table(s, d, "part").select("p_partkey", F.col("p_brand").alias("path"), F.get(F.array(F.lit(""), F.col("p_brand"), F.col("p_name"), F.lit(None).cast("string")), (F.col("p_partkey") % 4).cast("int")).alias("for_test"))).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_partkey % 4 <> 2"),
    Query("visible_imports", lambda s, d: table(s, d, "part").select("p_partkey", fc.import_visible(F.concat(F.lit("mod/"), (F.col("p_size") % 3).cast("string"), F.lit("/x")), F.concat(F.lit("mod/"), (F.col("p_partkey") % 3).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "/internal/y").otherwise("/y"))).alias("visible")), "SELECT p_partkey, p_partkey % 2 <> 0 OR p_size % 3 = p_partkey % 3 AS visible FROM part"),
    Query("possible_members", lambda s, d: suppress.possible_members(table(s, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), table(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k")), "k").join(table(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k")), "k", "left_semi").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)"),
    Query("path_prefixes", lambda s, d: documents(s, d).select("file", fc.has_prefix("package", F.lit("src1")).alias("below")), f"WITH {DOCS} SELECT file, package = 'src1' OR starts_with(package, 'src1/') AS below FROM docs"),
    Query("noise_lines", lambda s, d: writers.quiet(table(s, d, "part").select("p_partkey", F.concat(F.get(F.array(F.lit("new node, remapping "), F.lit("deduplicating "), F.lit("kept: ")), (F.col("p_partkey") % 3).cast("int")), "p_name").alias("value"))).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_partkey % 3 = 2"),
    Query("c_imports", lambda s, d: documents(s, d).select("file", F.concat(F.when(F.instr("package", "fr") > 0, '  import "C"\n').otherwise('import "Cx"\n'), F.coalesce("text", F.lit(""))).alias("t")).where(~fc.imports_c("t")).select("file"), f"WITH {DOCS} SELECT file FROM docs WHERE NOT contains(package, 'fr')"),
    # projections
    Query("editor_positions", lambda s, d: log(s, d).select("seq", *fc.from_editor("line", F.col("v") % 100)), f"WITH {LOG} SELECT seq, line + 1 AS line, v % 100 + 1 AS \"column\" FROM log"),
    Query("protocol_severities", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", fc.protocol_severity("l_linenumber").alias("severity")), "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 2 THEN 'warning' WHEN 3 THEN 'info' WHEN 4 THEN 'info' ELSE 'error' END AS severity FROM lineitem"),
    Query("relative_paths", lambda s, d: documents(s, d).select(fc.relative_path("/ws/src1/", F.concat(F.lit("\\ws\\"), "file")).alias("path")), f"WITH {DOCS} SELECT CASE WHEN starts_with(file, 'src1/') THEN substr(file, 6) ELSE '/ws/' || file END AS path FROM docs"),
    Query("absolute_paths", lambda s, d: documents(s, d).select(paths.absolute_column(F.concat(F.when(F.instr("file", "fr") > 0, "/x/..").otherwise("a/./b/.."), F.lit("//"), "file"), "/root/ws").alias("path")), f"WITH {DOCS} SELECT CASE WHEN contains(file, 'fr') THEN '/' ELSE '/root/ws/a/' END || file AS path FROM docs"),
    Query("teamcity_texts", lambda s, d: documents(s, d).select("file", fc.teamcity_escaped("text", 255).alias("text")), f"WITH {DOCS}, cut AS (SELECT file, text, list_max(list_filter(range(0, 256), lambda k: k <= length(text) AND k + length(regexp_replace(left(text, CAST(k AS INTEGER)), '[^''\\n\\r|\\[\\]]', '', 'g')) <= 255)) AS n FROM docs) SELECT file, replace(replace(replace(replace(replace(replace(left(text, CAST(n AS INTEGER)), '|', '||'), '''', '|'''), chr(10), '|n'), chr(13), '|r'), '[', '|['), ']', '|]') AS text FROM cut"),
    Query("text_places", lambda s, d: documents(s, d).where("text is not null").select("file", fc.place_of("text", F.octet_length(F.left("text", F.floor(F.char_length("text") / 2).cast("int")))).alias("p")).select("file", "p.line", "p.column"), f"WITH {DOCS}, h AS (SELECT file, left(text, length(text) // 2) AS head FROM docs WHERE text IS NOT NULL) SELECT file, CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS INTEGER) AS line, CAST(strlen(string_split(head, chr(10))[-1]) + 1 AS INTEGER) AS \"column\" FROM h"),
    # joins
    Query("dependency_overrides", lambda s, d: joins.dependency_overrides(graph.forward_closure(package_edges(s, d)).withColumn("key", F.md5("node")), package_edges(s, d).where("dst = 'src0/en'").select(F.md5("src").alias("key"), F.concat(F.lit("facts of "), "src").alias("facts"))).select("root", "node", "facts"), f"WITH {DOCS}, {PACKAGES}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), c AS (SELECT package AS root, dep AS node FROM below UNION SELECT node, node FROM n) SELECT root, node, CASE WHEN node IN (SELECT src FROM edges WHERE dst = 'src0/en') THEN 'facts of ' || node END AS facts FROM c"),
    Query("unused_objects", lambda s, d: joins.unused_objects(objects(s, d)).select("file", "line", "name", "l_orderkey"), "WITH o AS (SELECT CAST(l_partkey AS VARCHAR) AS file, l_linenumber AS line, CAST(l_suppkey % 5 AS VARCHAR) AS name, l_returnflag = 'R' AS used, l_linestatus = 'F' AS tp, l_orderkey FROM lineitem) SELECT file, line, name, l_orderkey FROM o WHERE NOT used AND NOT tp AND NOT EXISTS (SELECT 1 FROM o u WHERE u.used AND u.file = o.file AND u.line = o.line AND u.name = o.name)"),
    Query("routed_facts", lambda s, d: joins.routed_facts(turns(s, d).withColumn("kind", F.when(F.col("src").rlike("[02468]$"), "embed").otherwise("dep")), turns(s, d).select(F.col("dst").alias("package"), F.concat(F.lit("f"), "dst").alias("facts"))), f"WITH {TURNS}, k AS (SELECT *, CASE WHEN regexp_matches(src, '[02468]$') THEN 'embed' ELSE 'dep' END AS kind FROM turns), own AS (SELECT DISTINCT src, dst AS package, 'f' || dst AS facts FROM k WHERE kind = 'dep') SELECT * FROM own UNION SELECT k.src, own.package, own.facts FROM k JOIN own ON own.src = k.dst WHERE kind = 'embed'"),
    # aggregates
    Query("cascade_projection", lambda s, d: table(s, d, "part").select("p_partkey", aggregates.cascade(F.col("p_size").cast("long"), F.col("p_partkey").cast("long"), 20_000).alias("c")).select("p_partkey", "c.projected", "c.exceeds"), "SELECT p_partkey, CAST(p_size AS BIGINT) * p_partkey AS projected, CAST(p_size AS BIGINT) * p_partkey > 20000 AS exceeds FROM part"),
    Query("analyzer_set_digest", lambda s, d: incremental.analyzer_set_digest(table(s, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("version"), F.col("p_brand").alias("scope"), F.col("p_partkey").cast("string").alias("salt"))), "SELECT digest, n FROM (" + set_digest("k", "digest", f"SELECT 1 AS k, {framed('p_name', 'CAST(p_size AS VARCHAR)', 'p_brand', 'CAST(p_partkey AS VARCHAR)')} AS r FROM part") + ")"),
    Query("fact_digests", lambda s, d: incremental.fact_digests(package_edges(s, d).select(F.col("src").alias("package"), F.col("dst").alias("dep")), sources(s, d).where("package like 'src0%' or package like 'src1%'").select(F.col("package").alias("dep"), F.col("source").alias("hash"))), f"WITH {SOURCES}, {PACKAGES} SELECT package, facts FROM (" + set_digest("package", "facts", f"SELECT src AS package, {framed('dst', 'hash')} AS r FROM (SELECT src, dst, CASE WHEN dst LIKE 'src0%' OR dst LIKE 'src1%' THEN source ELSE repeat('0', 64) END AS hash FROM edges LEFT JOIN sources ON package = dst)") + ")"),
    Query("disk_use", lambda s, d: aggregates.disk_use(cached(s, d)), "SELECT CAST(sum(o_custkey) AS BIGINT) AS bytes, count(*) AS files FROM orders"),
    Query("cache_cleaned", lambda s, d: incremental.cleaned(cached(s, d).withColumn("tier", F.concat(F.lit("L"), (F.col("key") % 3).cast("string"))), "L1")[1], "SELECT CAST(sum(o_custkey) AS BIGINT) AS bytes, count(*) AS files FROM orders WHERE o_orderkey % 3 = 1"),
    Query("cache_counters", lambda s, d: aggregates.cache_counters(events_as(s, d)), f"WITH {EVENTS} SELECT tier, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'miss') AS misses, count(*) FILTER (outcome = 'store') AS stores, count(*) FILTER (outcome = 'error') AS errors FROM ev GROUP BY tier"),
    Query("scheduler_stats", lambda s, d: aggregates.scheduler_stats(events_as(s, d)), f"WITH {EVENTS} SELECT count(*) FILTER (kind = 'acquire') AS acquired, count(*) FILTER (kind = 'block') AS blocked, CAST(sum(wait) AS BIGINT) AS waited, count(*) FILTER (kind = 'pin') AS pins, count(*) FILTER (kind = 'pin') - count(*) FILTER (kind = 'live') AS released FROM ev"),
    # orders and sets
    Query("comparison_sort", lambda s, d: ordering.comparison_sort(findings(s, d)).select("file", "line", "linter", "message"), f"{SEQUENCED.split(', once AS')[0]} SELECT file, line, linter, message FROM findings ORDER BY file, line, linter, message"),
    Query("ordered_entries", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(F.transform(ordering.ordered_entries(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"), F.concat(F.lit("k"), (F.col("p_partkey") % 9).cast("string")), F.col("p_type"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("entries")), "SELECT p_partkey, 'brand=' || p_brand || ';k' || p_partkey % 9 || '=' || p_type || ';size=' || p_size AS entries FROM part"),
    Query("merged_streams", lambda s, d: sets.merged(log(s, d).select("linter", "file", F.col("seq").cast("string").alias("seq")), findings(s, d).select("linter", "file", "message")), f"WITH {LOG}, {SEQUENCED.split(', once AS')[0].removeprefix('WITH ')} SELECT linter, file, CAST(seq AS VARCHAR) AS seq, NULL AS message FROM log UNION ALL SELECT linter, file, NULL, message FROM findings"),
    Query("members_by_default", member_set("default"), "SELECT CAST(p_partkey AS VARCHAR) AS name FROM part WHERE (p_size % 2 = 0 OR p_size % 5 = 1) AND p_size % 7 <> 0"),
    Query("members_all_but", member_set("enable-all"), "SELECT CAST(p_partkey AS VARCHAR) AS name FROM part WHERE p_size % 7 <> 0"),
    Query("members_only", member_set("disable-all"), "SELECT CAST(p_partkey AS VARCHAR) AS name FROM part WHERE p_size % 5 = 1"),
    Query("array_sets", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(F.array_sort(sets.array_union(F.split("p_name", " "), F.split("p_type", " "))), ",").alias("both")), "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), string_split(p_type, ' ')))), ',') AS both FROM part"),
    Query("right_biased_maps", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(F.transform(ordering.ordered_entries(sets.right_biased(F.create_map(F.lit("a"), F.col("p_brand"), F.concat(F.lit("b"), (F.col("p_size") % 3).cast("string")), F.col("p_name")), F.create_map(F.concat(F.lit("b"), (F.col("p_partkey") % 3).cast("string")), F.col("p_type")))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("entries")), "SELECT p_partkey, 'a=' || p_brand || CASE WHEN p_size % 3 = p_partkey % 3 THEN ';b' || p_size % 3 || '=' || p_type WHEN p_size % 3 < p_partkey % 3 THEN ';b' || p_size % 3 || '=' || p_name || ';b' || p_partkey % 3 || '=' || p_type ELSE ';b' || p_partkey % 3 || '=' || p_type || ';b' || p_size % 3 || '=' || p_name END AS entries FROM part"),
    Query("same_keys", lambda s, d: table(s, d, "part").select("p_partkey", sets.same_keys(F.create_map((F.col("p_size") % 3).cast("string"), F.lit(1), F.lit("x"), F.lit(2)), F.create_map(F.lit("x"), F.lit(3), (F.col("p_partkey") % 3).cast("string"), F.lit(4))).alias("same")), "SELECT p_partkey, p_size % 3 = p_partkey % 3 AS same FROM part"),
    Query("selected_analyzers", lambda s, d: sets.selected(table(s, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey"), ["NATION_1", "NATION_3", "NATION_12"]), "SELECT n_name AS name, n_nationkey FROM nation WHERE n_name IN ('NATION_1', 'NATION_3', 'NATION_12')"),
    # graphs
    Query("updated_graph", lambda s, d: graph.updated_graph(package_edges(s, d), documents(s, d).select("package").distinct().where("package like '%/de' or package like '%/es'").select(F.col("package").alias("src"), F.when(F.col("package").like("%/de"), F.array(F.lit("new"), F.lit("other"))).alias("dst"))), f"WITH {DOCS}, {PACKAGES} SELECT src, dst FROM edges WHERE src NOT LIKE '%/de' AND src NOT LIKE '%/es' UNION ALL SELECT package, unnest(['new', 'other']) FROM p WHERE package LIKE '%/de'"),
    Query("required_analyzers", lambda s, d: graph.required(parts_graph(s, d), roots(s, d)), closure_of(PARTS, "e", "SELECT p_partkey AS node FROM part WHERE p_partkey % 10 = 7") + " SELECT node FROM r"),
    Query("fact_producers", lambda s, d: graph.fact_producers(parts_graph(s, d), roots(s, d), table(s, d, "part").where("p_size % 3 = 0").select(F.col("p_partkey").alias("node"))), closure_of(PARTS, "e", "SELECT p_partkey AS node FROM part WHERE p_partkey % 10 = 7") + " SELECT node FROM r JOIN part ON p_partkey = node WHERE p_size % 3 = 0"),
    Query("action_states", lambda s, d: graph.action_states(parts_graph(s, d), table(s, d, "part").where("p_partkey % 41 = 40").select(F.col("p_partkey").alias("node"))), f"WITH RECURSIVE {PARTS}, r AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 41 = 40 UNION SELECT e.src FROM r JOIN e ON e.dst = r.node) SELECT p_partkey AS node, CASE WHEN p_partkey % 41 = 40 THEN 'failed' WHEN p_partkey IN (SELECT node FROM r) THEN 'skipped' ELSE 'done' END AS state FROM part"),
    Query("reachable_symbols", lambda s, d: graph.reachable_symbols(symbols(s, d), symbols(s, d).where("src % 3 = 1").select(F.col("src").alias("node")).distinct(), symbols(s, d).where("dst >= 1000").select(F.col("dst").alias("node")).distinct()), f"WITH RECURSIVE {SYMBOLS}, r AS (SELECT DISTINCT src AS decl, src AS node FROM e WHERE src % 3 = 1 UNION SELECT r.decl, e.dst FROM r JOIN e ON e.src = r.node) SELECT decl, node AS symbol FROM r WHERE node >= 1000"),
    Query("reachable_keys", lambda s, d: incremental.reachable_keys(package_edges(s, d), sources(s, d)), f"WITH {SOURCES}, {PACKAGES}, closed AS (" + set_digest("package", "deps", f"SELECT b.package, {framed('dep', 's.source')} AS r FROM below b JOIN sources s ON s.package = b.dep") + f") SELECT s.package, {framed('s.package', 's.source', 'c.deps')} AS key FROM sources s LEFT JOIN closed USING (package) CROSS JOIN LATERAL (SELECT coalesce(closed.deps, repeat('0', 64)) AS deps) c"),
    Query("leaves_first_sums", lambda s, d: graph.run_leaves_first(turns(s, d).where("src like '1%'"), graph.nodes_of(turns(s, d).where("src like '1%'")), lambda nodes, done: nodes.withColumn("n", F.lit(1).cast("long")) if done is None else nodes.join(turns(s, d).where("src like '1%'").select(F.col("src").alias("node"), "dst"), "node").join(done.select(F.col("node").alias("dst"), F.col("n").alias("m")), "dst").groupBy("node").agg((F.sum("m") + 1).alias("n"))), f"WITH {TURNS}, t2 AS (SELECT src, dst FROM turns WHERE src LIKE '1%'), n AS (SELECT src AS node FROM t2 UNION SELECT dst FROM t2) SELECT node, CAST(split_part(node, '/', 2) AS BIGINT) - min(CAST(split_part(node, '/', 2) AS BIGINT)) OVER (PARTITION BY split_part(node, '/', 1)) + 1 AS n FROM n"),
    # scalars
    Query("tagged_fields", lambda s, d: documents(s, d).select("file", F.md5(fc.tagged("text", F.coalesce("text", F.lit("")))).alias("field")), f"WITH {DOCS} SELECT file, md5('text:' || strlen(coalesce(text, '')) || ':' || coalesce(text, '')) AS field FROM docs"),
    Query("digest_checks", lambda s, d: table(s, d, "part").select("p_partkey", fc.is_digest(F.get(F.array(F.sha2("p_name", 256), F.upper(F.sha2("p_name", 256)), F.md5("p_name"), F.concat(F.lit("g"), F.substring(F.sha2("p_name", 256), 2, 63))), (F.col("p_partkey") % 4).cast("int"))).alias("ok")), "SELECT p_partkey, p_partkey % 4 < 2 AS ok FROM part"),
    Query("directives", lambda s, d: comments(s, d).select("p_partkey", fc.directive("c").alias("x"), fc.explanation("c").alias("why")).select("p_partkey", "x.malformed", F.array_join("x.linters", ",").alias("linters"), "why"), "SELECT p_partkey, [false, false, false, true, NULL, true, NULL, false][p_partkey % 8 + 1] AS malformed, ['', 'a,b', '', '', NULL, '', NULL, 'x'][p_partkey % 8 + 1] AS linters, ['', 'why', '', '', '', '', '', 'y'][p_partkey % 8 + 1] AS why FROM part"),
    Query("span_names", lambda s, d: table(s, d, "part").select("p_partkey", fc.span_mismatch(F.regexp_replace(F.initcap("p_name"), " ", ""), F.regexp_replace("p_name", " ", F.when(F.col("p_partkey") % 3 == 0, "-").otherwise("_"))).alias("differs")), "SELECT p_partkey, p_partkey % 3 = 0 AND contains(p_name, ' ') AS differs FROM part"),
    Query("error_texts", lambda s, d: checks(s, d).select("seq", fc.error_parts(F.concat(fc.position("file", "line", F.col("seq") % 2), F.lit(": "), "message")).alias("e")).select("seq", "e.file", "e.line", F.coalesce("e.column", F.lit(0)).alias("column"), "e.message"), f"WITH {CHECKS_TABLE} SELECT seq, file, line, CAST(seq % 2 AS INTEGER) AS \"column\", message FROM checks"),
    Query("durations", lambda s, d: table(s, d, "part").select("p_partkey", fc.duration_seconds(F.concat(F.when(F.col("p_partkey") % 5 == 0, "-").otherwise(""), F.col("p_size").cast("string"), F.lit("h"), (F.col("p_partkey") % 60).cast("string"), F.lit("m1.5s"), F.when(F.col("p_partkey") % 7 == 0, "x").otherwise(""))).alias("seconds")), "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN (CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE 1 END) * (p_size * 3600.0::DOUBLE + p_partkey % 60 * 60.0::DOUBLE + 1.5) END AS seconds FROM part"),
    Query("symbol_lookup", lambda s, d: sets.symbols(table(s, d, "part").select(F.col("p_brand").alias("package"), F.col("p_name").alias("name"), "p_partkey"), "Brand#13", "s", prefix=True).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_brand = 'Brand#13' AND starts_with(p_name, 's')"),
    Query("iterator_helpers", lambda s, d: table(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("w")).select("p_partkey", fc.first_or("w", F.lit("")).alias("first"), fc.every("w", lambda x: F.length(x) > 4).alias("every"), fc.some("w", lambda x: F.length(x) > 4).alias("some"), fc.is_empty(F.filter("w", lambda x: F.length(x) > 5)).alias("none")), "SELECT p_partkey, w[1] AS first, len(list_filter(w, lambda x: length(x) > 4)) = len(w) AS every, len(list_filter(w, lambda x: length(x) > 4)) > 0 AS some, len(list_filter(w, lambda x: length(x) > 5)) = 0 AS none FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)"),
    Query("map_helpers", lambda s, d: table(s, d, "part").select("p_partkey", F.create_map(F.lit("b"), F.col("p_brand"), F.lit("a"), F.col("p_type"), F.lit("c"), F.col("p_name")).alias("m")).select("p_partkey", fc.any_entry("m")["value"].alias("one"), F.array_join(F.array_sort(F.map_keys(fc.without_keys("m", lambda k, v: F.length(v) > 8))), ",").alias("left")), "SELECT p_partkey, p_type AS one, array_to_string(list_filter(['a', 'b', 'c'], lambda k: length(CASE k WHEN 'a' THEN p_type WHEN 'b' THEN p_brand ELSE p_name END) <= 8), ',') AS left FROM part"),
    Query("sealed_entries", lambda s, d: table(s, d, "part").select("p_partkey", F.md5(codec.sealed_column(7, F.col("p_name").cast("binary"), F.col("p_type").cast("binary"))).alias("body")), "SELECT p_partkey, md5(unhex('5147524407' || lpad(lower(to_hex(strlen(p_name))), 2, '0') || repeat('00', 7) || hex(p_name) || lpad(lower(to_hex(strlen(p_type))), 2, '0') || repeat('00', 7) || hex(p_type))) AS body FROM part"),
    # caches
    Query("cache_entries", lambda s, d: wide_entries(s, d).select("key", "package", F.size("findings").alias("n")), f"{SEQUENCED.split(', once AS')[0]} SELECT sha256(package) AS key, package, CAST(CASE WHEN package LIKE 'src1%' THEN (SELECT count(*) FROM findings f WHERE f.package = p.package) ELSE 0 END AS INTEGER) AS n FROM (SELECT DISTINCT package FROM docs) p"),
    Query("analyzer_keys", lambda s, d: table(s, d, "part").select("p_partkey", incremental.analyzer_key(*[F.col(c) for c in ("p_name", "p_brand", "p_type", "p_name")], F.lit("types"), F.lit("1"), F.lit("salt"), F.lit("tool")).alias("key")), f"""SELECT p_partkey, {framed('p_name', 'p_brand', 'p_type', 'p_name', "'types'", "'1'", "'salt'", "'tool'")} AS key FROM part"""),
    Query("scoped_digests", lambda s, d: table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "syntax").otherwise("types").alias("scope"), "p_brand", "p_type").select("p_partkey", incremental.scoped_input(F.col("scope"), F.col("p_brand"), F.col("p_type")).alias("input"), incremental.scoped_types(F.col("scope"), F.col("p_type")).alias("types")), "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS input, CASE WHEN p_size % 2 = 0 THEN 'syntax-only' ELSE p_type END AS types FROM part"),
    Query("decoded_entries", lambda s, d: incremental.decoded(table(s, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") % 3).alias("version"), F.get(F.array(F.lit("[]"), F.lit('[{"line":1}]'), F.lit("{"), F.lit('{"a":1}')), (F.col("p_partkey") % 4).cast("int")).alias("body")), 1)[0].select("key"), "SELECT p_partkey AS key FROM part WHERE p_size % 3 = 1 AND p_partkey % 4 < 2"),
    Query("decode_errors", lambda s, d: incremental.decoded(table(s, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") % 3).alias("version"), F.get(F.array(F.lit("[]"), F.lit('[{"line":1}]'), F.lit("{"), F.lit('{"a":1}')), (F.col("p_partkey") % 4).cast("int")).alias("body")), 1)[1], "SELECT count(*) AS errors FROM part WHERE p_size % 3 = 1 AND p_partkey % 4 >= 2"),
    # reports
    Query("one_sided", lambda s, d: compare.detailed(*sides(s, d)).groupBy("side", "file", "line", "linter").agg(F.count("*").alias("n")), f"WITH {LOG}, k AS (SELECT file, line, linter, count(*) FILTER (seq % 3 <> 0) AS na, count(*) FILTER (seq % 4 <> 0) AS nb FROM log GROUP BY ALL) SELECT 'a' AS side, file, line, linter, na - nb AS n FROM k WHERE na > nb UNION ALL SELECT 'b', file, line, linter, nb - na FROM k WHERE nb > na"),
    Query("metric_counters", lambda s, d: aggregates.by_severity(findings(s, d)).select(F.lit("findings").alias("metric"), F.col("severity").alias("name"), "n").union(aggregates.cache_counters(events_as(s, d)).select(F.lit("hits"), "tier", "hits")), f"{SEQUENCED.split(', once AS')[0]}, {EVENTS} SELECT 'findings' AS metric, s.severity AS name, count(f.linter) AS n FROM (SELECT unnest(['error', 'warning', 'info']) AS severity) s LEFT JOIN findings f USING (severity) GROUP BY s.severity UNION ALL SELECT 'hits', tier, count(*) FILTER (outcome = 'hit') FROM ev GROUP BY tier"),
    Query("sarif_with_fixes", lambda s, d: writers.sarif(sequenced(s, d).withColumn("fixes", F.array(F.struct(F.lit("cut").alias("message"), F.array(F.struct(*[F.struct(F.col("file").alias("file"), F.col("line").alias("line"), F.lit(c).alias("column")).alias(n) for n, c in (("start", 1), ("end", 9))], F.lit("x").alias("new_text"))).alias("edits")))), properties='{"unit":{"package":"p"}}').where("part = 1").select("seq", F.regexp_extract("value", r'("fixes":.*)}$', 1).alias("fixes"), F.get_json_object(F.regexp_replace("value", "^,", ""), "$.locations[0].physicalLocation.artifactLocation.uri").alias("file")), f"""{SEQUENCED} SELECT seq, '"fixes":[{{"description":{{"text":"cut"}},"artifactChanges":[{{"artifactLocation":{{"uri":"' || file || '","index":0}},"replacements":[{{"deletedRegion":{{"startLine":' || line || ',"startColumn":1,"endLine":' || line || ',"endColumn":9}},"insertedContent":{{"text":"x"}}}}]}}]}}]' AS fixes, file FROM f"""),
]
