"""Queries over the document corpus: scans, rules, suppression, reports."""

from __future__ import annotations



from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions import paths
from ..operators import aggregates, dedup, ordering, rules, suppress
from ..sinks import writers
from ..sources.corpus import documents, folders, table
from .tables import DOCS, FINDINGS, LINES, ODD, REPEATS, WORD, WORDS, Query, corpus_lines, findings

PLACE = ("linter", "message", "severity", "file", "line")
BY_PATH = suppress.Config(paths=(r"(^|/)src1[0-9]/",), once_per_line=False, generated="disable")
EXCEPT = suppress.Config(paths_except=(r"^src[0-4]/", r"/fr/"), once_per_line=False, generated="disable")
RULES = (
    suppress.ExcludeRule(("lll",), path=r"^src1/"),
    suppress.ExcludeRule(("asciicheck",), path_except=r"/(de|fr)/"),
    suppress.ExcludeRule(text=r"repeated words: [1-3]$"),
    suppress.ExcludeRule(("godox",), source=r"anything"),
    suppress.ExcludeRule(),
)
BY_RULE = suppress.Config(rules=RULES, once_per_line=False, generated="disable")
HITS = "((linter = 'lll' AND regexp_matches(file, '^src1/')) OR (linter = 'asciicheck' AND NOT regexp_matches(file, '/(de|fr)/')) OR regexp_matches(message, 'repeated words: [1-3]$'))"
FOLDER_RULES = ["-src1", "+src1/de", "-src2/fr", "-src7", "+src7"]


def run_with(config, *columns):
    return lambda s, d: suppress.apply(findings(s, d), config).select(*columns)


def line_scan(s, d):
    x = corpus_lines(s, d)
    return x.groupBy("package").agg(F.count("*").alias("n"), F.sum(F.char_length("content")).alias("chars"), F.max("line").alias("longest"))


def ranges(s, d):
    """A range for every tenth line of each file, three lines long, for one linter, or for all in French files."""
    x = corpus_lines(s, d).where("line % 10 = 1")
    return x.select("file", F.col("line").alias("from_line"), (F.col("line") + 2).alias("to_line"), F.lit(1).alias("col"), F.when(F.instr("file", "/fr/") > 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("lll"))).alias("linters"))


def nodes(s, d):
    """A node below every other range, five lines long."""
    x = corpus_lines(s, d).where("line % 20 = 4")
    return x.select("file", F.col("line").alias("start_line"), (F.col("line") + 5).alias("end_line"), F.lit(1).alias("col"))


RANGES = "ranges AS (SELECT file, line AS from_line, line + 2 AS to_line, 1 AS col, instr(file, '/fr/') > 0 AS everyone FROM lines WHERE line % 10 = 1)"


def once(s, d):
    """One finding of each line, by linter and message; the pipeline of a whole run but for its reports."""
    return suppress.once_per_line(findings(s, d), ("linter", "message"))


def findings_pipeline(s, d):
    """Scan, two rules, a path rule, the first finding of each line, counts by linter."""
    found = rules.findings(corpus_lines(s, d), rules.long_lines(), rules.repeated_tokens())
    kept = suppress.apply(found, suppress.Config(paths=(r"^src3/",), generated="disable"), order=("linter", "message"))
    return aggregates.by_linter(kept)


def sequenced(s, d):
    """Findings with an order within each package, for reports."""
    return once(s, d).withColumn("seq", F.row_number().over(Window.partitionBy("package").orderBy("file", "line")).cast("long"))


SEQUENCED = f"""WITH {FINDINGS}, once AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY file, line ORDER BY linter, message) = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY file, line) AS seq FROM once)"""


def report(name):
    return lambda s, d: writers.printer(name)(sequenced(s, d)).where("part = 1").select("name", "seq", "value")


#: The stem of a text as a message; and how many of its characters fit 80 bytes.
STEM_SQL = "regexp_replace(lower({0} || ' ...!'), '[.,;:!? \\t\\r\\n]+$', '')"
CUT_SQL = "list_max(list_filter(range(0, 81), lambda k: strlen(left(stem, CAST(k AS INTEGER))) <= 80))"


def marked(s, d):
    """Documents, every seventh with a mark of generated files in one of several spellings."""
    marks = F.array(*[F.lit(x) for x in ("// Code generated by x. DO NOT EDIT.\n", "/* do not Edit */\n", "# Autogenerated File\n", " * Generated by: Swagger Codegen \n", "// Code generated. DO NOT EDIT\n")])
    n = F.regexp_extract("file", r"(\d+)\.txt$", 1).cast("long")
    return documents(s, d).withColumn("text", F.when(n % 7 == 0, F.concat(F.get(marks, (n % 5).cast("int")), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))


MARKED = f"{DOCS}, n AS (SELECT *, CAST(regexp_extract(file, '(\\d+)\\.txt$', 1) AS BIGINT) AS n FROM docs), marked AS (SELECT file, CASE WHEN n % 7 = 0 THEN ['// Code generated by x. DO NOT EDIT.' || chr(10), '/* do not Edit */' || chr(10), '# Autogenerated File' || chr(10), ' * Generated by: Swagger Codegen ' || chr(10), '// Code generated. DO NOT EDIT' || chr(10)][n % 5 + 1] || coalesce(text, '') ELSE text END AS text FROM n)"
#: Names of checks, dealt over a table's rows.
CHECKS = ("SA4006", "ST1000", "S1002", "QF1001", "copylocks", "printf", "errcheck", "govet", "staticcheck", "Sx", "ST1003", "noctx", "lll")
CHECKS_SQL = "[" + ", ".join(f"'{x}'" for x in CHECKS) + "]"


def order_sizes(s, d):
    """A size for each order: a product of its keys in decimals, exact below 10^38, as it leaves the longs from some 4.5 million orders on."""
    key, customer = (F.col(c).cast("decimal(19,0)") for c in ("o_orderkey", "o_custkey"))
    return table(s, d, "orders").select("o_orderkey", fc.human_bytes(key * key * customer, "KMGTP").alias("size"))


def lit_names(s, d):
    return table(s, d, "part").select(F.element_at(F.split("p_name", " "), 1).alias("name")).distinct()



QUERIES = [
    Query("findings_pipeline", findings_pipeline, f"""WITH {FINDINGS} SELECT linter, count(*) AS n FROM (SELECT * FROM findings WHERE linter IN ('lll', 'dupword') AND NOT regexp_matches(file, '^src3/') QUALIFY row_number() OVER (PARTITION BY file, line ORDER BY linter, message) = 1) GROUP BY linter"""),
    Query("line_scan", line_scan, f"WITH {LINES} SELECT package, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars, max(line) AS longest FROM lines GROUP BY package"),
    Query("long_lines", lambda s, d: rules.findings(corpus_lines(s, d), rules.long_lines()).select("file", "line", "message"), f"WITH {LINES} SELECT file, line, 'line is ' || length(content) || ' characters' AS message FROM lines WHERE length(content) > 120"),
    Query("keyword_lines", lambda s, d: rules.findings(corpus_lines(s, d), rules.keyword_lines(WORDS)).select("file", "line", "message"), f"WITH {LINES} SELECT file, line, 'line contains ' || upper(regexp_extract(content, '{WORD}', 2)) AS message FROM lines WHERE regexp_matches(content, '{WORD}')"),
    Query("repeated_tokens", lambda s, d: rules.findings(corpus_lines(s, d), rules.repeated_tokens()).select("file", "line", "message"), f"WITH {LINES} SELECT file, line, 'repeated words: ' || {REPEATS} AS message FROM worded WHERE {REPEATS} > 0"),
    Query("nonascii_lines", lambda s, d: rules.findings(corpus_lines(s, d), rules.nonascii_lines()).select("file", "line", "message"), f"WITH {LINES} SELECT file, line, {ODD} || ' characters beyond ASCII' AS message FROM lines WHERE {ODD} > 0"),
    Query("bidi_lines", lambda s, d: rules.findings(corpus_lines(s, d).withColumn("content", F.replace("content", F.lit("ti"), F.lit("t\u202ei"))), rules.bidi_lines()).select("file", "line"), f"WITH {LINES} SELECT file, line FROM lines WHERE contains(content, 'ti')"),
    Query("sentence_ends", lambda s, d: rules.findings(corpus_lines(s, d), rules.sentence_end()).select("file", "line"), f"WITH {LINES} SELECT file, line FROM lines WHERE NOT regexp_matches(content, '[.!?:]\\s*$') AND trim(content) <> ''"),
    Query("forbidden_words", lambda s, d: rules.findings(corpus_lines(s, d), rules.forbidden(("[Tt]hat the", "de la"))).select("file", "line", "message"), f"WITH {LINES} SELECT file, line, 'use of ' || regexp_extract(content, '(?:[Tt]hat the)|(?:de la)') || ' is forbidden' AS message FROM lines WHERE regexp_matches(content, '(?:[Tt]hat the)|(?:de la)')"),
    Query("header_check", lambda s, d: rules.header_missing(documents(s, d), "[A-Z]").select("file", "line", "message"), f"WITH {DOCS} SELECT file, 1 AS line, 'missing header' AS message FROM docs WHERE NOT regexp_matches(text, '^(?:[A-Z])')"),
    Query("repeated_literals", lambda s, d: rules.repeated_literals(corpus_lines(s, d)), f"WITH {LINES} SELECT content, n, f.file AS file, f.line AS line FROM (SELECT content, count(*) AS n, min({{'file': file, 'line': line}}) AS f FROM lines WHERE length(content) >= 3 GROUP BY content HAVING count(*) >= 3)"),
    Query("repeated_blocks", lambda s, d: rules.repeated_blocks(corpus_lines(s, d), 2).select("n", "file", "line"), f"""WITH {LINES}, b AS (SELECT file, line, content AS c1, lead(content) OVER (PARTITION BY file ORDER BY line) AS c2 FROM lines)
SELECT n, p.file AS file, p.line AS line FROM (SELECT c1, c2, count(*) AS n, min({{'file': file, 'line': line}}) AS p FROM b WHERE c2 IS NOT NULL GROUP BY c1, c2 HAVING count(*) > 1)"""),
    Query("drop_by_path", run_with(BY_PATH, *PLACE), f"WITH {FINDINGS} SELECT linter, message, severity, file, line FROM findings WHERE NOT regexp_matches(file, '(^|/)src1[0-9]/')"),
    Query("keep_only_paths", run_with(EXCEPT, *PLACE), f"WITH {FINDINGS} SELECT linter, message, severity, file, line FROM findings WHERE regexp_matches(file, '^src[0-4]/') OR regexp_matches(file, '/fr/')"),
    Query("drop_by_rule_any", run_with(BY_RULE, *PLACE), f"WITH {FINDINGS} SELECT linter, message, severity, file, line FROM findings WHERE NOT {HITS}"),
    Query(
        "drop_by_rule_table",
        lambda s, d: suppress.without_rule_hits(findings(s, d), s.createDataFrame([(i, list(r.linters), r.path, r.path_except, r.text, r.source) for i, r in enumerate(RULES)], "ordinal int, linters array<string>, path string, path_except string, text string, source string")).select(*PLACE),
        f"WITH {FINDINGS} SELECT linter, message, severity, file, line FROM findings WHERE NOT {HITS}",
    ),
    Query(
        "family_match",
        lambda s, d: table(s, d, "part").select("p_partkey", fc.family(F.get(F.array(*[F.lit(x) for x in CHECKS]), (F.col("p_partkey") % len(CHECKS)).cast("int"))).alias("family")),
        f"SELECT p_partkey, CASE WHEN regexp_matches(linter, '^(SA|ST|S1|QF)') THEN 'staticcheck' WHEN linter IN ('copylocks', 'printf') THEN 'govet' ELSE linter END AS family FROM (SELECT p_partkey, {CHECKS_SQL}[p_partkey % {len(CHECKS)} + 1] AS linter FROM part)",
    ),
    Query("target_scope_recursive", lambda s, d: documents(s, d).where(paths.in_targets(F.col("file"), paths.targets(["./src1/...", "src2/fr/..."]))).select("file"), f"WITH {DOCS} SELECT file FROM docs WHERE starts_with(file, 'src1/') OR starts_with(file, 'src2/fr/')"),
    Query("target_scope_flat", lambda s, d: documents(s, d).where(paths.in_targets(F.col("file"), paths.targets(["src1/en", "src2"]))).select("file"), f"WITH {DOCS} SELECT file FROM docs WHERE package IN ('src1/en', 'src2')"),
    Query("last_match_wins", lambda s, d: documents(s, d).where(paths.last_match(F.col("package"), FOLDER_RULES)).select("file"), f"WITH {DOCS} SELECT file FROM docs WHERE NOT ((package LIKE 'src1/%' AND package <> 'src1/de') OR package = 'src2/fr')"),
    Query("glob_match", lambda s, d: documents(s, d).where(paths.glob_match(F.col("file"), "src*/de/*1.txt") | paths.glob_match(F.col("file"), "?7.txt") | paths.glob_match(F.col("file"), "**/fr/*[24].txt")).select("file"), f"WITH {DOCS} SELECT file FROM docs WHERE regexp_matches(file, '^src[^/]*/de/[^/]*1\\.txt$') OR regexp_matches(file, '/[^/]7\\.txt$') OR regexp_matches(file, '^(.*/)?fr/[^/]*[24]\\.txt$')"),
    Query("generated_lax", lambda s, d: marked(s, d).where(fc.lax_generated("text")).select("file"), f"WITH {MARKED} SELECT file FROM marked WHERE contains(lower(text), 'code generated') OR contains(lower(text), 'do not edit') OR contains(lower(text), 'autogenerated file') OR contains(lower(text), '* generated by: swagger codegen ')"),
    Query("generated_strict", lambda s, d: suppress.generated_files(marked(s, d), "strict"), f"WITH {MARKED} SELECT DISTINCT file FROM marked WHERE regexp_matches(text, '(?m)^// Code generated .* DO NOT EDIT\\.$')"),
    Query("package_fully_excluded", lambda s, d: suppress.excluded_packages(documents(s, d), suppress.Config(paths=(r"^src[0-2]/", r"[05]\.txt$"))), f"WITH {DOCS} SELECT package FROM docs GROUP BY package HAVING bool_and(regexp_matches(file, '^src[0-2]/') OR regexp_matches(file, '[05]\\.txt$'))"),
    Query("package_excluded_by_globs", lambda s, d: suppress.excluded_by_globs(documents(s, d), ("src1*/de",), ("*.md", "src2/**")), f"WITH {DOCS} SELECT package FROM docs GROUP BY package HAVING bool_or(regexp_matches(package, '^src1[^/]*/de$')) OR bool_and(starts_with(file, 'src2/'))"),
    Query("range_suppression", lambda s, d: suppress.in_ranges(findings(s, d), ranges(s, d)).select(*PLACE), f"WITH {FINDINGS}, {RANGES} SELECT linter, message, severity, file, line FROM findings f WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE r.file = f.file AND f.line BETWEEN r.from_line AND r.to_line AND (everyone OR f.linter = 'lll'))"),
    Query("range_expansion", lambda s, d: suppress.expanded_ranges(ranges(s, d), nodes(s, d)).select("file", "from_line", "to_line", "col"), f"WITH {LINES}, {RANGES}, nodes AS (SELECT file, line AS start_line, line + 5 AS end_line FROM lines WHERE line % 20 = 4) SELECT file, from_line, to_line, col FROM ranges UNION ALL SELECT r.file, from_line, greatest(to_line, end_line), col FROM ranges r JOIN nodes n ON n.file = r.file AND n.start_line - 1 = r.to_line"),
    Query("uniq_by_line", lambda s, d: once(s, d).select(*PLACE), f"WITH {FINDINGS} SELECT linter, message, severity, file, line FROM findings QUALIFY row_number() OVER (PARTITION BY file, line ORDER BY linter, message) = 1"),
    Query("findings_by_severity", lambda s, d: aggregates.by_severity(findings(s, d)), f"WITH {FINDINGS} SELECT s.severity AS severity, count(f.linter) AS n FROM (SELECT unnest(['error', 'warning', 'info']) AS severity) s LEFT JOIN findings f USING (severity) GROUP BY s.severity"),
    Query("per_linter_counts", lambda s, d: aggregates.by_linter(findings(s, d)), f"WITH {FINDINGS} SELECT linter, count(*) AS n FROM findings GROUP BY linter"),
    Query("verdict_counts", lambda s, d: aggregates.verdict(findings(s, d), ("asciicheck", "godox"), 3), f"WITH {FINDINGS} SELECT count(*) AS findings, count(*) FILTER (linter NOT IN ('asciicheck', 'godox')) AS enforced, count(*) FILTER (linter IN ('asciicheck', 'godox')) AS ignored, CAST(3 AS BIGINT) AS superseded FROM findings"),
    Query("canonical_sort", lambda s, d: ordering.canonical_sort(findings(s, d)).select(*PLACE), f"WITH {FINDINGS} SELECT linter, message, severity, file, line FROM findings ORDER BY file, line, \"column\", linter, message"),
    Query("top20", lambda s, d: ordering.top(findings(s, d), 20, "file", "line", "linter", "message").select("file", "line", "linter", "message"), f"WITH {FINDINGS} SELECT file, line, linter, message FROM findings ORDER BY file, line, linter, message LIMIT 20"),
    Query("first_seen_linter", lambda s, d: dedup.first_seen(findings(s, d).withColumn("seq", F.concat_ws(":", "file", F.lpad("line", 6, "0"))), "linter"), f"WITH {FINDINGS} SELECT linter, min(file || ':' || lpad(CAST(line AS VARCHAR), 6, '0')) AS seq FROM findings GROUP BY linter"),
    Query("grouped_by_file", lambda s, d: aggregates.grouped_by_file(findings(s, d).select("file", F.struct("line", "linter").alias("seq"), "message")).select("file", F.size("findings").alias("n"), F.get("findings", 0)["message"].alias("first")), f"WITH {FINDINGS} SELECT file, CAST(count(*) AS INTEGER) AS n, arg_min(message, {{'line': line, 'linter': linter}}) AS first FROM findings GROUP BY file"),
    Query("position_string", lambda s, d: findings(s, d).select(fc.position("file", "line", F.col("line") % 3).alias("position"), "linter"), f"WITH {FINDINGS} SELECT file || ':' || line || CASE WHEN line % 3 <> 0 THEN ':' || line % 3 ELSE '' END AS position, linter FROM findings"),
    Query("fingerprint", lambda s, d: findings(s, d).select("file", "line", fc.fingerprint(source_lines=None).alias("fingerprint")), f"WITH {FINDINGS} SELECT file, line, upper(md5(file || message)) AS fingerprint FROM findings"),
    Query(
        "message_stem",
        lambda s, d: documents(s, d).select("file", fc.message_stem(F.lit("The"), F.concat(F.lit(" THE: "), "text", F.lit(" ...! "))).alias("stem")),
        f"WITH {DOCS}, s AS (SELECT file, {STEM_SQL.format('text')} AS stem FROM docs), cut AS (SELECT file, stem, {CUT_SQL} AS n FROM s) SELECT file, left(stem, CAST(n AS INTEGER)) AS stem FROM cut",
    ),
    Query("severity_map", lambda s, d: table(s, d, "orders").select("o_orderkey", fc.severity_of(F.element_at(F.array(*[F.lit(x) for x in ("HIGH", " warn ", "note", "medium", "x", "Low", "")]), (F.col("o_orderkey") % 7 + 1).cast("int"))).alias("severity")), "SELECT o_orderkey, ['error', 'warning', 'info', 'warning', 'error', 'info', 'error'][o_orderkey % 7 + 1] AS severity FROM orders"),
    Query("severity_sanitise", lambda s, d: findings(s, d).select("file", "line", "linter", fc.sanitised("severity", ("info", "minor", "major", "critical", "blocker"), "critical").alias("severity")), f"WITH {FINDINGS} SELECT file, line, linter, CASE WHEN severity = 'info' THEN 'info' ELSE 'critical' END AS severity FROM findings"),
    Query("human_bytes", order_sizes, """SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1fK', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1fM', n / 1048576.0) WHEN n < 1099511627776 THEN printf('%.1fG', n / 1073741824.0) WHEN n < 1125899906842624 THEN printf('%.1fT', n / 1099511627776.0) ELSE printf('%.1fP', n / 1125899906842624.0) END AS size FROM (SELECT o_orderkey, o_orderkey * o_orderkey * o_custkey AS n FROM orders)"""),
    Query("canonical_paths", lambda s, d: documents(s, d).select("file", fc.canonical_path(F.concat(F.lit("mod/"), "package")).alias("canonical")), f"WITH {DOCS} SELECT file, 'mod/' || file AS canonical FROM docs"),
    Query("folders", lambda s, d: folders(documents(s, d)), f"WITH {DOCS} SELECT DISTINCT package AS folder FROM docs"),
    Query("closest_name", lambda s, d: ordering.closest_names(table(s, d, "part").select(F.substring(F.element_at(F.split("p_name", " "), -1), 2, 99).alias("name")).distinct(), lit_names(s, d)), """SELECT w.name AS name, min({'d': levenshtein(w.name, k.name), 'n': k.name}).n AS suggestion, min({'d': levenshtein(w.name, k.name), 'n': k.name}).d::INTEGER AS distance
FROM (SELECT DISTINCT substr(string_split(p_name, ' ')[-1], 2) AS name FROM part) w, (SELECT DISTINCT string_split(p_name, ' ')[1] AS name FROM part) k WHERE levenshtein(w.name, k.name) <= 3 GROUP BY w.name"""),
    Query("text_rows", report("text"), f"{SEQUENCED} SELECT '' AS name, seq, file || ':' || line || ': ' || message || ' (' || linter || ')' || chr(10) AS value FROM f"),
    Query("tab_rows", report("tab"), f"{SEQUENCED} SELECT '' AS name, seq, rpad(file || ':' || line, CAST(max(length(file || ':' || line)) OVER () + 2 AS INTEGER), ' ') || rpad(linter, CAST(max(length(linter)) OVER () + 2 AS INTEGER), ' ') || message || chr(10) AS value FROM f"),
    Query("checkstyle_rows", report("checkstyle"), f"{SEQUENCED} SELECT file AS name, CAST(0 AS BIGINT) AS seq, '  <file name=\"' || file || '\">' || chr(10) || items || '  </file>' || chr(10) AS value FROM (SELECT file, string_agg('    <error column=\"0\" line=\"' || line || '\" message=\"' || message || '\" severity=\"' || severity || '\" source=\"' || linter || '\"></error>' || chr(10), '' ORDER BY line) AS items FROM f GROUP BY file)"),
    Query("junit_rows", report("junit-xml"), f"""{SEQUENCED}, p AS (SELECT *, file || ':' || line AS pos FROM f) SELECT file AS name, CAST(0 AS BIGINT) AS seq, '  <testsuite name="' || file || '" tests="' || count(*) || '" errors="0" failures="' || count(*) || '">' || chr(10) || string_agg('    <testcase name="' || linter || '" classname="' || pos || '">' || chr(10) || '      <failure message="' || pos || ': ' || message || '" type="' || severity || '"><![CDATA[' || severity || ': ' || message || chr(10) || 'Category: ' || linter || chr(10) || 'File: ' || file || chr(10) || 'Line: ' || line || chr(10) || 'Details: ]]></failure>' || chr(10) || '    </testcase>' || chr(10), '' ORDER BY line) || '  </testsuite>' || chr(10) AS value FROM p GROUP BY file"""),
    Query("html_rows", report("html"), f"""{SEQUENCED} SELECT '' AS name, seq, '<tr data-severity="' || severity || '"><td class="where">' || file || ':' || line || '</td><td class="rule">' || linter || '</td><td class="severity">' || severity || '</td><td class="message">' || message || '</td><td class="source"></td></tr>' || chr(10) AS value FROM f"""),
    Query("html_total", lambda s, d: writers.html(sequenced(s, d)).where("part = 0").select(F.regexp_extract("value", '<p id="total">(.*?)</p>', 1).alias("total")), f"{SEQUENCED} SELECT count(*) || ' findings' AS total FROM f"),
    Query("codeclimate_rows", report("code-climate"), f"""{SEQUENCED} SELECT '' AS name, seq, CASE WHEN seq = 1 THEN '' ELSE ',' END || '{{"description":"' || linter || ': ' || message || '","check_name":"' || linter || '","severity":"' || CASE WHEN severity = 'info' THEN 'info' ELSE 'critical' END || '","fingerprint":"' || upper(md5(file || message)) || '","location":{{"path":"' || file || '","lines":{{"begin":' || line || '}}}}}}' AS value FROM f"""),
    Query("teamcity_lines", lambda s, d: writers.teamcity_rows(sequenced(s, d)).select("seq", "kind", "value"), f"""{SEQUENCED} SELECT min(seq) AS seq, 0 AS kind, '##teamcity[inspectionType id=''' || linter || ''' name=''' || linter || ''' description=''' || linter || ''' category=''Golangci-lint reports'']' || chr(10) AS value FROM f GROUP BY linter
UNION ALL SELECT seq, 1, '##teamcity[inspection typeId=''' || linter || ''' message=''' || message || ''' file=''' || file || ''' line=''' || line || ''' SEVERITY=''' || upper(severity) || ''']' || chr(10) FROM f"""),
    Query("sarif_rows", report("sarif"), f"""{SEQUENCED} SELECT '' AS name, seq, CASE WHEN seq = 1 THEN '' ELSE ',' END || '{{"ruleId":"' || linter || '","level":"' || CASE WHEN severity = 'warning' THEN 'warning' ELSE 'error' END || '","message":{{"text":"' || message || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file || '","index":0}},"region":{{"startLine":' || line || ',"startColumn":1}}}}}}]}}' AS value FROM f"""),
    Query("json_rows", report("json"), f"""{SEQUENCED} SELECT '' AS name, seq, CASE WHEN seq = 1 THEN '' ELSE ',' END || '{{"linter":"' || linter || '","message":"' || message || '","severity":"' || severity || '","pos":{{"filename":"' || file || '","line":' || line || '}}}}' AS value FROM f"""),
]
