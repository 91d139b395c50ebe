"""The driver's queries: every operator family on the star-schema tables or on short literals, with the DuckDB SQL
of the same result. All run over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.functions import names as N
from tremor.functions.checkpoints import cut
from tremor.operators import batch, classify, diff, experiment, generate, graph, match, parse, patch, propagate, spans, style, targets, temporal

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def edges(spark, sf, both: bool = True) -> DataFrame:
    """Distinct keys are distinct edges, in one direction and so in both, but for the row without any."""
    pairs = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    one = pairs.select(F.concat(F.lit("s"), "l_suppkey").alias("caller"), F.concat(F.lit("p"), "l_partkey").alias("callee"))
    return one.union(one.where("caller is not null or callee is not null").select("callee", "caller")) if both else one


def seeds(spark, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "qualname string")


E_BOTH = "e AS (SELECT DISTINCT 's' || l_suppkey AS caller, 'p' || l_partkey AS callee FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem)"
E_ONE = "e AS (SELECT DISTINCT 's' || l_suppkey AS caller, 'p' || l_partkey AS callee FROM lineitem)"


def bfs_sql(hops: int, seed: str = "('p1')") -> str:
    return f"""{E_BOTH},
r(q, h) AS (SELECT * FROM (SELECT col0, 0 FROM (VALUES {seed})) UNION SELECT e.caller, h + 1 FROM r JOIN e ON e.callee = r.q WHERE h < {hops}),
b AS (SELECT q, min(h) AS hop FROM r GROUP BY q),
src AS (SELECT e.caller AS q, min(e.callee) AS source FROM e JOIN b p ON p.q = e.callee JOIN b c ON c.q = e.caller AND c.hop = p.hop + 1 GROUP BY 1)"""


@query(f"WITH RECURSIVE {bfs_sql(2)} SELECT b.q AS qualname, hop::BIGINT AS hop, source, CASE WHEN hop = 0 THEN 'direct_change' ELSE 'calls_changed_function' END AS reason FROM b LEFT JOIN src USING (q)")
def impact_bfs_2hop(spark, sf):
    return propagate.impact(edges(spark, sf), seeds(spark, "p1")).withColumn("hop", F.col("hop").cast("long"))


@query(f"""WITH RECURSIVE {E_ONE}, u AS (SELECT callee AS a, caller AS n, 'calls_changed_function' AS why FROM e UNION ALL SELECT caller, callee, 'called_by_changed_function' FROM e),
r(q, h) AS (SELECT 'p1', 0 UNION SELECT u.n, h + 1 FROM r JOIN u ON u.a = r.q WHERE h < 2), b AS (SELECT q, min(h) AS hop FROM r GROUP BY q),
src AS (SELECT u.n AS q, min(u.a) AS source, arg_min(u.why, u.a) AS why FROM u JOIN b p ON p.q = u.a JOIN b c ON c.q = u.n AND c.hop = p.hop + 1 GROUP BY 1)
SELECT b.q AS qualname, hop::BIGINT AS hop, source, coalesce(why, 'direct_change') AS reason FROM b LEFT JOIN src USING (q)""")
def impact_bfs_both_dirs(spark, sf):
    return propagate.impact(edges(spark, sf, both=False), seeds(spark, "p1"), direction="both").withColumn("hop", F.col("hop").cast("long"))


@query(f"WITH RECURSIVE {bfs_sql(3)} SELECT b.q AS qualname, hop::BIGINT AS hop, round(power(0.51, hop), 6) AS score, source FROM b LEFT JOIN src USING (q) WHERE power(0.51, hop) >= 0.01")
def impact_typed_score(spark, sf):
    out = propagate.impact_typed(edges(spark, sf), seeds(spark, "p1"), propagate.Config(max_hops=3))
    return out.select("qualname", F.col("hop").cast("long").alias("hop"), F.round("score", 6).alias("score"), "source")


@query(f"""WITH RECURSIVE {bfs_sql(2, "('p1'), ('p2')")},
w(q, hop, path) AS (SELECT q, hop, q FROM b WHERE hop = 0 UNION ALL SELECT src.q, w.hop + 1, w.path || '>' || src.q FROM w JOIN src ON src.source = w.q)
SELECT q AS qualname, path AS best_path, repeat('CALLED_BY>', hop::INT) AS edge_types FROM w""")
def impact_best_path(spark, sf):
    out = propagate.impact_typed(edges(spark, sf), seeds(spark, "p1", "p2"), propagate.Config(max_hops=2))
    return out.select("qualname", F.array_join("best_path", ">").alias("best_path"), F.array_join(F.transform("edge_types_on_path", lambda t: F.concat(t, F.lit(">"))), "").alias("edge_types"))


@query(f"""WITH RECURSIVE {bfs_sql(4)}, p(preset, f, most) AS (VALUES ('full', 0.51, 4), ('uniform', 0.595, 4), ('no_decay', 0.6, 3), ('high_decay', 0.3, 4), ('calls_only', 0.51, 4))
SELECT preset, hop::BIGINT AS hop, count(*)::BIGINT AS n, round(max(power(f, hop)), 6) AS score FROM b, p WHERE hop <= most AND power(f, hop) >= 0.01 GROUP BY 1, 2""")
def impact_ablation(spark, sf):
    out = propagate.ablation(edges(spark, sf), seeds(spark, "p1"))
    return out.groupBy("preset", F.col("hop").cast("long").alias("hop")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("score"))


@query(f"WITH RECURSIVE {bfs_sql(3)} SELECT hop::BIGINT AS hop, count(*)::BIGINT AS n FROM b GROUP BY 1")
def impact_hop_histogram(spark, sf):
    return propagate.hop_histogram(propagate.impact(edges(spark, sf), seeds(spark, "p1"), 3)).select(F.col("hop").cast("long").alias("hop"), "n")


@query(f"""WITH RECURSIVE {bfs_sql(3)}, s AS (SELECT power(0.51, hop) AS x FROM b WHERE power(0.51, hop) >= 0.01)
SELECT round(min(x), 6) AS min_score, round(max(x), 6) AS max_score, round(avg(x), 6) AS mean_score, count(*) FILTER (x >= 0.5) AS above_05, count(*) FILTER (x >= 0.3) AS above_03, count(*) FILTER (x >= 0.1) AS above_01 FROM s""")
def impact_score_distribution(spark, sf):
    return propagate.score_distribution(propagate.impact_typed(edges(spark, sf), seeds(spark, "p1"), propagate.Config(max_hops=3)))


@query(f"WITH RECURSIVE {bfs_sql(3)} SELECT 'CALLED_BY' AS edge_type, sum(hop)::BIGINT AS n FROM b WHERE power(0.51, hop) >= 0.01")
def edge_type_histogram(spark, sf):
    return propagate.edge_type_histogram(propagate.impact_typed(edges(spark, sf), seeds(spark, "p1"), propagate.Config(max_hops=3)))


@query(f"""WITH {E_BOTH}, o AS (SELECT caller AS q, string_agg(callee, ',' ORDER BY callee) AS callees FROM e GROUP BY 1), i AS (SELECT callee AS q, string_agg(caller, ',' ORDER BY caller) AS callers FROM e GROUP BY 1)
SELECT coalesce(o.q, i.q) AS qualname, coalesce(callees, '') AS callees, coalesce(callers, '') AS callers FROM o FULL JOIN i ON o.q = i.q""")
def adjacency_sets(spark, sf):
    return graph.adjacency(edges(spark, sf)).select("qualname", F.array_join("callees", ",").alias("callees"), F.array_join("callers", ",").alias("callers"))


INHERITS_SQL = "inh AS (SELECT DISTINCT 'n' || n_nationkey AS child, 'r' || n_regionkey AS base FROM nation)"
METHODS_SQL = """m AS (SELECT DISTINCT 'n' || c_nationkey AS cls, lower(c_mktsegment) AS method FROM customer UNION SELECT DISTINCT 'r' || n_regionkey, lower(c_mktsegment) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9900)"""
NODES_SQL = f"{INHERITS_SQL}, {METHODS_SQL}, nodes AS (SELECT cls || '.' || method AS q FROM m UNION SELECT child FROM inh UNION SELECT base FROM inh)"


def class_world(spark, sf):
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    inherits = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.lit(0).alias("ord"), F.concat(F.lit("r"), "n_regionkey").alias("base")).distinct()
    own = customer.select(F.concat(F.lit("n"), "c_nationkey").alias("cls"), F.lower("c_mktsegment").alias("method"))
    rich = customer.where("c_acctbal > 9900").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("r"), "n_regionkey").alias("cls"), F.lower("c_mktsegment").alias("method"))
    methods = own.union(rich).distinct()
    nodes = methods.select(F.concat_ws(".", "cls", "method").alias("qualname")).union(inherits.select("child")).union(inherits.select("base")).distinct()
    return nodes, inherits


@query(f"WITH {E_BOTH}, {NODES_SQL} SELECT (SELECT count(*) FROM nodes) AS total_functions, (SELECT count(*) FROM e) AS total_call_relations, (SELECT count(DISTINCT child) FROM inh) AS inheriting_classes")
def graph_stats(spark, sf):
    nodes, inherits = class_world(spark, sf)
    return graph.graph_stats(nodes, edges(spark, sf), inherits)


@query(f"WITH {NODES_SQL} SELECT child || '.' || a.method AS caller, base || '.' || a.method AS callee FROM inh JOIN m a ON a.cls = inh.child JOIN m b ON b.cls = inh.base AND a.method = b.method")
def inheritance_overrides(spark, sf):
    nodes, inherits = class_world(spark, sf)
    none = spark.createDataFrame([], "caller string, callee string")
    return graph.inheritance_edges(nodes, none, inherits).where("edge_type = 'OVERRIDES'").select("caller", "callee")


SUPPLIER_CALLS = "SELECT DISTINCT 'main' AS caller, 'n' || s_nationkey || '.' || (CASE WHEN s_acctbal > 5000 THEN 'building' ELSE 'audit' END) AS callee FROM supplier"


@query(f"""WITH {INHERITS_SQL}, m AS (SELECT DISTINCT 'r' || n_regionkey AS cls, 'building' AS method FROM nation UNION SELECT 'n' || n_nationkey, 'audit' FROM nation WHERE n_nationkey % 2 = 0),
calls AS ({SUPPLIER_CALLS})
SELECT inh.child || '.' || b.method AS caller, inh.base || '.' || b.method AS callee FROM inh JOIN m b ON b.cls = inh.base
WHERE NOT EXISTS (SELECT 1 FROM m c WHERE c.cls = inh.child AND c.method = b.method) AND EXISTS (SELECT 1 FROM calls k WHERE k.callee = inh.child || '.' || b.method)""")
def inheritance_inherited(spark, sf):
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    inherits = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.lit(0).alias("ord"), F.concat(F.lit("r"), "n_regionkey").alias("base"))
    nodes = nation.select(F.explode(F.array(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("r"), "n_regionkey", F.lit(".building")))).alias("qualname"))
    nodes = nodes.union(nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey", F.lit(".audit")))).distinct()
    calls = supplier.select(F.lit("main").alias("caller"), F.concat(F.lit("n"), "s_nationkey", F.when(F.col("s_acctbal") > 5000, ".building").otherwise(".audit")).alias("callee")).distinct()
    return graph.inheritance_edges(nodes, calls, inherits).where("edge_type = 'INHERITS'").select("caller", "callee")


HOST_SQL = "hosts AS (SELECT DISTINCT regexp_extract(url, '://([^/:?#]+)', 1) AS q FROM pages)"
SUFFIX_SQL = "suf AS (SELECT DISTINCT q, array_to_string(p[i:], '.') AS s FROM (SELECT q, string_split(q, '.') AS p FROM hosts), unnest(range(1, len(p) + 1)) AS t(i))"


def hosts(spark, sf):
    return table(spark, sf, "pages").select(F.regexp_extract("url", "://([^/:?#]+)", 1).alias("qualname")).distinct()


@query(f"WITH {HOST_SQL}, {SUFFIX_SQL} SELECT s AS suffix, min(q) AS qualname FROM suf GROUP BY s HAVING count(DISTINCT q) = 1")
def suffix_unique(spark, sf):
    return match.unique_suffixes(hosts(spark, sf))


SEED_SQL = "seeds AS (SELECT DISTINCT CASE length(q) % 4 WHEN 0 THEN q WHEN 1 THEN regexp_replace(q, '^[^.]*[.]', '') WHEN 2 THEN 'x.' || q ELSE 'x.y.' || regexp_replace(q, '^[^.]*[.]', '') END AS seed FROM hosts)"


@query(f"""WITH {HOST_SQL}, {SUFFIX_SQL}, {SEED_SQL}, uni AS (SELECT s, min(q) AS q FROM suf GROUP BY s HAVING count(DISTINCT q) = 1),
ss AS (SELECT seed, i, array_to_string(p[i:], '.') AS s FROM (SELECT seed, string_split(seed, '.') AS p FROM seeds), unnest(range(1, len(p) + 1)) AS t(i)),
und AS (SELECT seed, min(q) AS q FROM seeds JOIN hosts ON starts_with(q, seed || '.') GROUP BY seed HAVING count(*) = 1),
tiers AS (SELECT seed, seed AS q, 0 AS t FROM seeds JOIN hosts ON q = seed UNION ALL SELECT seed, uni.q, i FROM ss JOIN uni ON ss.s = uni.s UNION ALL SELECT seed, q, 1000000 FROM und),
best AS (SELECT seed, arg_min(q, t) AS q, min(t) AS t FROM tiers GROUP BY seed)
SELECT seeds.seed AS seed_qualname, best.q AS matched_qualname, CASE WHEN t = 0 THEN 'exact' WHEN t = 1 THEN 'suffix' WHEN t IS NOT NULL THEN 'prefix_strip' ELSE 'none' END AS match_type FROM seeds LEFT JOIN best ON best.seed = seeds.seed""")
def seed_fuzzy_match(spark, sf):
    h, q = hosts(spark, sf), F.col("qualname")
    cut = F.regexp_replace(q, r"^[^.]*[.]", "")
    k = F.length(q) % 4
    given = h.select(F.when(k == 0, q).when(k == 1, cut).when(k == 2, F.concat(F.lit("x."), q)).otherwise(F.concat(F.lit("x.y."), cut)).alias("qualname")).distinct()
    return match.match_seeds(given, h)


CALL_SQL = "calls AS (SELECT DISTINCT 'page' || (page_id % 50) AS caller, CASE page_id % 3 WHEN 0 THEN q WHEN 1 THEN regexp_replace(q, '^[^.]*[.]', '') ELSE 'top.' || q END AS callee FROM (SELECT page_id, regexp_extract(url, '://([^/:?#]+)', 1) AS q FROM pages))"


@query(f"""WITH {HOST_SQL}, {CALL_SQL}, keys AS (SELECT DISTINCT callee FROM calls),
hs AS (SELECT q, i, array_to_string(p[i:], '.') AS s FROM (SELECT q, string_split(q, '.') AS p FROM hosts), unnest(range(1, len(p) + 1)) AS t(i)),
near AS (SELECT q, arg_min(callee, i) AS callee, CASE WHEN min(i) = 1 THEN 1 ELSE 2 END AS tier FROM hs JOIN keys ON hs.s = keys.callee GROUP BY q),
far AS (SELECT q, callee, 3 AS tier FROM hosts JOIN keys ON callee = q OR ends_with(callee, '.' || q) WHERE q NOT IN (SELECT q FROM near))
SELECT DISTINCT q AS qualname, caller, tier::BIGINT AS match_tier FROM (SELECT * FROM near UNION ALL SELECT * FROM far) x JOIN calls ON calls.callee = x.callee""")
def caller_resolution(spark, sf):
    host, k = F.regexp_extract("url", "://([^/:?#]+)", 1), F.col("page_id") % 3
    callee = F.when(k == 0, host).when(k == 1, F.regexp_replace(host, r"^[^.]*[.]", "")).otherwise(F.concat(F.lit("top."), host))
    calls = table(spark, sf, "pages").select(F.concat(F.lit("page"), F.col("page_id") % 50).alias("caller"), callee.alias("callee")).distinct()
    return match.resolve_callers(calls, hosts(spark, sf)).withColumn("match_tier", F.col("match_tier").cast("long"))


PATH_SQL = "regexp_replace(regexp_replace(regexp_extract(url, '://[^/?#]+/([^?#]*)', 1), '/$', ''), '[^A-Za-z0-9/_]', '_', 'g')"


@query(f"""WITH p AS (SELECT DISTINCT {PATH_SQL} AS path FROM pages), f AS (SELECT DISTINCT CASE WHEN length(path) % 2 = 0 THEN path || '.py' ELSE path || '/__init__.py' END AS file, replace(path, '/', '.') AS k, length(path) % 2 AS init FROM p WHERE path <> '' AND length(path) % 3 <> 2),
n AS (SELECT DISTINCT replace(path, '/', '.') || '.Cls.run' AS q FROM p WHERE path <> ''),
pre AS (SELECT q, len(a) - i AS up, array_to_string(a[1:i], '.') AS k FROM (SELECT q, string_split(q, '.') AS a FROM n), unnest(range(1, len(a) + 1)) AS t(i)),
best AS (SELECT q, arg_min(file, (up, init, file)) AS file FROM pre JOIN f USING (k) GROUP BY q)
SELECT n.q AS qualname, file AS path, file IS NOT NULL AS is_internal, file IS NULL AS is_external FROM n LEFT JOIN best USING (q)""")
def longest_prefix_classify(spark, sf):
    raw = F.regexp_replace(F.regexp_extract("url", "://[^/?#]+/([^?#]*)", 1), "/$", "")
    path = table(spark, sf, "pages").select(F.regexp_replace(raw, "[^A-Za-z0-9/_]", "_").alias("path")).where("path <> ''").distinct()
    files = path.where(F.length("path") % 3 != 2).select(F.concat("path", F.when(F.length("path") % 2 == 0, ".py").otherwise("/__init__.py")).alias("path"))
    names = path.select(F.concat(F.translate("path", "/", "."), F.lit(".Cls.run")).alias("qualname"))
    return classify.classify(names, files).select("qualname", "path", "is_internal", "is_external")


@query("""WITH s AS (SELECT user_id, event_id AS lo, event_id + CAST(floor(value) AS BIGINT) AS hi, event_id AS id FROM events WHERE event_type = 'view'),
p AS (SELECT DISTINCT user_id, event_id AS line FROM events WHERE event_type = 'error'),
b AS (SELECT p.user_id, p.line, arg_min(s.id, (s.hi - s.lo, s.lo, s.id)) AS id FROM p JOIN s ON s.user_id = p.user_id AND p.line BETWEEN s.lo AND s.hi GROUP BY 1, 2)
SELECT p.user_id, p.line, b.id FROM p LEFT JOIN b USING (user_id, line)""")
def innermost_span(spark, sf):
    e = table(spark, sf, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("lo"), (F.col("event_id") + F.floor("value").cast("long")).alias("hi"), F.col("event_id").alias("id"))
    errors = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("line"))
    return spans.innermost(errors, views, ["user_id"]).select("user_id", "line", "id")


@query("SELECT user_id, event_type, min(event_id) AS line, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def seed_dedup(spark, sf):
    return spans.first_by(table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("line"), "value"), ["user_id", "event_type"], "line")


@query("SELECT user_id, event_type, max(event_id) AS ordinal, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def last_definition_wins(spark, sf):
    return spans.last_by(table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("ordinal"), "value"), ["user_id", "event_type"], "ordinal")


DIFF = "\n".join([
    "diff --git a/pkg/a.py b/pkg/a.py", "--- a/pkg/a.py", "+++ b/pkg/a.py", "@@ -1,2 +1,3 @@ def f():", "--- x", "-old", "+++ y", "+new", "+more", "@@ -10 +12,0 @@", "-gone",
    "diff --git a/new.py b/new.py", "new file mode 100644", "--- /dev/null", "+++ b/new.py", "@@ -0,0 +1,2 @@", "+a", "+b",
    "diff --git a/old.py b/old.py", "--- a/old.py", "+++ /dev/null", "@@ -1,2 +0,0 @@", "-a", "-b",
])
HUNKS_SQL = f"""t AS (SELECT 'c1' AS commit, i AS pos, l AS line FROM (SELECT string_split('{DIFF}', chr(10)) AS a), LATERAL (SELECT unnest(a) AS l, unnest(range(len(a))) AS i)),
m AS (SELECT *, CASE WHEN starts_with(line, 'diff --git ') THEN 'file' WHEN starts_with(line, '@@ ') THEN 'hunk' END AS mark FROM t),
k AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (ORDER BY pos), 'file') AS lm FROM m),
h AS (SELECT *, CASE WHEN lm = 'file' AND starts_with(line, '--- ') THEN CASE WHEN line = '--- /dev/null' THEN '' ELSE regexp_replace(line[5:], '^a/', '') END END AS o,
  CASE WHEN lm = 'file' AND starts_with(line, '+++ ') THEN CASE WHEN line = '+++ /dev/null' THEN '' ELSE regexp_replace(line[5:], '^b/', '') END END AS n FROM k),
f AS (SELECT *, nullif(last_value(o IGNORE NULLS) OVER (ORDER BY pos), '') AS op, nullif(last_value(n IGNORE NULLS) OVER (ORDER BY pos), '') AS np FROM h),
g AS (SELECT commit, pos, coalesce(np, op) AS path, regexp_extract(line, '^@@ -([0-9]+)(?:,([0-9]+))? [+]([0-9]+)(?:,([0-9]+))? @@', ['a', 'b', 'c', 'd']) AS r FROM f WHERE regexp_matches(line, '^@@ -[0-9]')),
hunks AS (SELECT commit, path, 'old' AS side, r.a::BIGINT AS start, coalesce(nullif(r.b, ''), '1')::BIGINT AS count, pos::BIGINT AS pos FROM g UNION ALL SELECT commit, path, 'new', r.c::BIGINT, coalesce(nullif(r.d, ''), '1')::BIGINT, pos::BIGINT FROM g)"""


def lit_diff(spark):
    return spark.createDataFrame([("c1", DIFF)], "commit string, diff string")


@query(f"WITH {HUNKS_SQL} SELECT * FROM hunks")
def diff_parse(spark, sf):
    h = diff.parse_hunks(lit_diff(spark), ["commit"])
    return h.select("commit", "path", "side", *(F.col(c).cast("long").alias(c) for c in ("start", "count", "pos")))


@query(f"WITH {HUNKS_SQL} SELECT DISTINCT commit, path, side, unnest(range(start, start + count)) AS line FROM hunks WHERE count > 0")
def diff_lines(spark, sf):
    out = diff.changed_lines(diff.parse_hunks(lit_diff(spark), ["commit"]), ["commit"])
    return out.withColumn("line", F.col("line").cast("long"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS code FROM documents")
def snippet_slice(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.snippet(F.col("text"), F.lit(2), F.lit(4)).alias("code"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT *, CASE length(line) % 4 WHEN 0 THEN '+' || line WHEN 1 THEN '-' || line WHEN 2 THEN '+++ ' || line ELSE ' ' || line END AS x FROM l)
SELECT doc_id, count(*) FILTER (length(line) % 4 = 0 AND NOT starts_with(x, '+++')) AS added_lines, count(*) FILTER (length(line) % 4 = 1 AND NOT starts_with(x, '---')) AS removed_lines,
 count(*) FILTER (length(line) % 4 = 0 AND NOT starts_with(x, '+++') OR length(line) % 4 = 1 AND NOT starts_with(x, '---')) AS total_lines, count(*) FILTER (starts_with(x, '+++ ')) AS files_changed FROM k GROUP BY doc_id""")
def patch_line_stats(spark, sf):
    n = lambda x: F.length(x) % 4
    mark = lambda x: F.when(n(x) == 0, F.concat(F.lit("+"), x)).when(n(x) == 1, F.concat(F.lit("-"), x)).when(n(x) == 2, F.concat(F.lit("+++ "), x)).otherwise(F.concat(F.lit(" "), x))
    marked = table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("diff"))
    return diff.patch_stats(marked, ["doc_id"])


@query("""WITH c AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'os.' || lower(p_brand) WHEN 1 THEN 'print' WHEN 2 THEN 'pkg.' || lower(p_brand) WHEN 3 THEN 'rich.' || lower(p_brand) ELSE lower(p_brand) END AS callee FROM part)
SELECT p_partkey, callee FROM c WHERE NOT (starts_with(callee, 'os.') OR callee = 'print')""")
def external_filter(spark, sf):
    k, b = F.col("p_size") % 5, F.lower("p_brand")
    callee = F.when(k == 0, F.concat(F.lit("os."), b)).when(k == 1, "print").when(k == 2, F.concat(F.lit("pkg."), b)).when(k == 3, F.concat(F.lit("rich."), b)).otherwise(b)
    return table(spark, sf, "part").select("p_partkey", callee.alias("callee")).where(~N.is_external(F.col("callee"), ["rich"]))


@query("""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/Tests/' WHEN 2 THEN 'src/test_' ELSE 'src/' END || regexp_extract(url, '([^/?#]*)[?#]?[^/]*$', 1) AS path FROM pages)
SELECT page_id, path, contains(lower(path), '/tests/') OR starts_with(lower(path), 'tests/') OR starts_with(regexp_extract(lower(path), '([^/]*)$', 1), 'test_') AS is_test FROM p""")
def test_path_flag(spark, sf):
    k = F.col("page_id") % 4
    head = F.when(k == 0, "tests/").when(k == 1, "src/Tests/").when(k == 2, "src/test_").otherwise("src/")
    p = table(spark, sf, "pages").select("page_id", F.concat(head, F.regexp_extract("url", "([^/?#]*)[?#]?[^/]*$", 1)).alias("path"))
    return p.withColumn("is_test", N.is_test_path(F.col("path")))


STYLE_DOC = "CASE length(text) % 5 WHEN 0 THEN 'Do. ' || chr(10) || 'Args:' || chr(10) || ' a: x' || chr(10) || 'Returns:' || chr(10) || text WHEN 1 THEN 'Do.' || chr(10) || 'Parameters' || chr(10) || '----------' || chr(10) || 'Notes' || chr(10) || text WHEN 2 THEN ':param a: x' || chr(10) || ':rtype: int' || chr(10) || text WHEN 3 THEN 'Parameters' || chr(10) || 'Args:' || chr(10) || text ELSE text END"


def _score_sql(style_name: str) -> str:
    return " + ".join(f"regexp_matches(d, '(?m){p}')::INT" for p in style.PATTERNS[style_name])


STYLE_SQL = f"""d AS (SELECT source, {STYLE_DOC} AS d FROM documents),
s AS (SELECT source, {_score_sql("google")} AS g, {_score_sql("numpy")} AS n0, {_score_sql("sphinx")} AS s, regexp_matches(d, '(?m)^\\s*-{{3,}}\\s*$') AS u FROM d),
n AS (SELECT source, g, s, CASE WHEN u THEN n0 ELSE greatest(n0 - 2, 0) END AS n FROM s),
k AS (SELECT source, CASE WHEN greatest(g, n, s) = 0 THEN 'unknown' WHEN g = greatest(g, n, s) THEN 'google' WHEN n = greatest(g, n, s) THEN 'numpy' ELSE 'sphinx' END AS style FROM n),
v AS (SELECT source, count(*) FILTER (style = 'google') AS google, count(*) FILTER (style = 'numpy') AS numpy, count(*) FILTER (style = 'sphinx') AS sphinx, count(*) FILTER (style = 'unknown') AS unknown FROM k GROUP BY source)"""


def styled(spark, sf):
    return table(spark, sf, "documents").select("source", F.expr(STYLE_DOC.replace("chr(10)", r"'\n'")).alias("docstring"))


@query(f"WITH {STYLE_SQL} SELECT * FROM v")
def style_votes_by_source(spark, sf):
    return style.votes(styled(spark, sf), ["source"])


@query(f"""WITH {STYLE_SQL} SELECT source, CASE WHEN google + numpy + sphinx < 5 THEN 'google' WHEN google >= greatest(numpy, sphinx) THEN 'google' WHEN numpy >= sphinx THEN 'numpy' ELSE 'sphinx' END AS style,
 CASE WHEN google + numpy + sphinx < 5 THEN 0.0 ELSE round(greatest(google, numpy, sphinx)::DOUBLE / (google + numpy + sphinx), 6) END AS confidence FROM v""")
def style_winner(spark, sf):
    return style.winner(style.votes(styled(spark, sf), ["source"])).select("source", "style", F.round("confidence", 6).alias("confidence"))


@query("SELECT doc_id, array_to_string(list_filter(['the', '*de', '**zzz'], lambda p: NOT contains(text, ltrim(p, '*'))), ',') AS missing FROM documents")
def param_coverage(spark, sf):
    params = F.array(F.lit("the"), F.lit("*de"), F.lit("**zzz"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(patch.missing_params(F.col("text"), params), ",").alias("missing"))


@query("""WITH o AS (SELECT l_orderkey, list_sort(list_distinct(list('p' || (l_partkey % 7)))) AS own, list_sort(list_distinct(list('p' || (l_suppkey % 7)))) AS params FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_sort(own) = list_sort(params) AS ok, array_to_string(list_sort(list_filter(params, lambda x: NOT list_contains(own, x))), ',') AS missing, array_to_string(list_sort(list_filter(own, lambda x: NOT list_contains(params, x))), ',') AS extra FROM o""")
def strict_set_equality(spark, sf):
    own, params = F.array_sort(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey") % 7))), F.array_sort(F.collect_set(F.concat(F.lit("p"), F.col("l_suppkey") % 7)))
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(own.alias("own"), params.alias("params"))
    doc = F.concat(F.lit("Do.\n\nArgs:\n"), F.array_join(F.transform("own", lambda p: F.concat(F.lit("    "), p, F.lit(":"))), "\n"))
    c = o.select("l_orderkey", experiment.strict_check(doc, F.col("params")).alias("c"))
    return c.select("l_orderkey", "c.ok", F.array_join("c.missing", ",").alias("missing"), F.array_join("c.extra", ",").alias("extra"))


@query("""WITH p AS (SELECT o_orderpriority AS commit, o_orderkey % 3 AS k FROM orders),
r AS (SELECT commit, setting, CASE setting WHEN 'original' THEN true ELSE k = 0 END AS ok FROM p, (VALUES ('original'), ('drop_param'), ('add_fake_param'), ('rename_param')) AS s(setting)),
c AS (SELECT commit, setting, bool_and(ok) AS ok FROM r GROUP BY 1, 2)
SELECT setting, avg(ok::INT)::DOUBLE AS pass_rate, count(*)::BIGINT AS num_commits FROM c GROUP BY 1""")
def mutation_pass_rates(spark, sf):
    k = F.col("o_orderkey") % 3
    params = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("*b")))
    doc = F.when(k == 0, "Do it.").when(k == 1, "Do it.\n\nArgs:\n    a:").otherwise("Do it.\n\nArgs:\n    a:\n    *b:")
    docs = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("commit"), F.col("o_orderkey").cast("string").alias("qualname"), doc.alias("docstring"), params.alias("params"))
    return experiment.pass_rates(experiment.commit_results(experiment.mutation_results(docs)))


FOUND_SQL = f"{bfs_sql(2)}, f AS (SELECT b.q AS qualname, hop, source FROM b LEFT JOIN src USING (q) WHERE length(b.q) % 2 = 0)"


def found(spark, sf, hops: int):
    imp = propagate.impact(edges(spark, sf), seeds(spark, "p1"), 2).withColumn("is_internal", F.length("qualname") % 2 == 0)
    nodes = imp.select("qualname", F.lit("function").alias("kind"), F.lit("a.py").alias("path"), F.array().cast("array<string>").alias("params"), F.lit(1).alias("lineno"), F.lit(2).alias("end_lineno"), F.lit(None).cast("string").alias("docstring"))
    return targets.candidates(imp, nodes, hops)


@query(f"WITH RECURSIVE {FOUND_SQL} SELECT qualname, hop::BIGINT AS hop, source, 'insert' AS target_action FROM f WHERE hop = 0 OR hop = 1 AND source = 'p1' ORDER BY hop, qualname LIMIT 50")
def target_select_template(spark, sf):
    return targets.select_template(found(spark, sf, 1), seeds(spark, "p1")).select("qualname", F.col("hop").cast("long").alias("hop"), "source", "target_action")


@query(f"""WITH RECURSIVE {FOUND_SQL}, a1 AS (SELECT * FROM f WHERE hop = 1 AND source = 'p1'), a2 AS (SELECT * FROM f WHERE hop = 2 AND (source = 'p1' OR source IN (SELECT qualname FROM a1)))
SELECT qualname, hop::BIGINT AS hop, source FROM (SELECT * FROM f WHERE hop = 0 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2) ORDER BY hop, qualname LIMIT 50""")
def target_select_lineage(spark, sf):
    return targets.select_lineage(found(spark, sf, 2), seeds(spark, "p1")).select("qualname", F.col("hop").cast("long").alias("hop"), "source")


def batch_rows(spark, sf):
    v = F.when(F.col("value") > 10, F.col("value"))
    return table(spark, sf, "events").select(F.col("event_id").cast("string").alias("commit"), F.col("event_type").alias("mode"), (F.col("value") > 5).alias("ok"), v.alias("duration_ms"), (F.col("user_id") % 7).alias("num_targets"))


@query("SELECT event_type AS mode, count(*)::BIGINT AS num_runs, round(avg((value > 5)::INT), 6) AS ok_rate, round(coalesce(avg(CASE WHEN value > 10 THEN value END), 0), 6) AS avg_duration_ms, round(avg(user_id % 7), 6) AS avg_num_targets FROM events GROUP BY 1")
def batch_rollup(spark, sf):
    r = batch.rollup(batch_rows(spark, sf), ["mode"])
    return r.select("mode", "num_runs", *(F.round(c, 6).alias(c) for c in ("ok_rate", "avg_duration_ms", "avg_num_targets")))


@query("""SELECT source, count(*)::BIGINT AS impacted_total, count(*) FILTER (toxic = 0 AND quality = 1)::BIGINT AS impacted_internal, count(*) FILTER (toxic = 1)::BIGINT AS impacted_test, count(*) FILTER (quality = 0)::BIGINT AS impacted_external,
 round(count(*) FILTER (toxic = 0 AND quality = 1)::DOUBLE / count(*), 6) AS impacted_internal_ratio FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def label_counts_ratio(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    flags = d.select("source", F.expr("toxic = 0 and quality = 1").alias("is_internal"), F.expr("toxic = 1").alias("is_test"), F.expr("quality = 0").alias("is_external"))
    return classify.label_counts(flags, ["source"]).withColumn("impacted_internal_ratio", F.round("impacted_internal_ratio", 6))


@query("SELECT w.commit, w.mode FROM (SELECT DISTINCT 'u' || user_id AS commit, mode FROM events, (VALUES ('view'), ('refund')) AS m(mode)) w WHERE NOT EXISTS (SELECT 1 FROM events e WHERE 'u' || e.user_id = w.commit AND e.event_type = w.mode)")
def resume_antijoin(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("commit"), F.col("event_type").alias("mode"))
    return batch.remaining(batch.work_list(e.select("commit").distinct(), ["view", "refund"]), e)


@query("SELECT user_id, max(event_id) FILTER (ts = m) AS event_id, any_value(m) AS ts FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY 1")
def newest_run(spark, sf):
    return batch.newest(table(spark, sf, "events"), ["user_id"], "event_id", "ts")


@query("SELECT event_type AS kind, count(*)::BIGINT AS n_events, NULL::BIGINT AS n_orders FROM events GROUP BY 1 UNION ALL SELECT o_orderstatus, NULL, count(*) FROM orders GROUP BY 1")
def sparse_row_union(spark, sf):
    a = table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n_events"))
    b = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count(F.lit(1)).alias("n_orders"))
    return batch.sparse_union([a, b])


ANSWERS = [
    (1, "[DOCSTRING]\nAdd two.\n[/DOCSTRING]\n[ANALYSIS] callers see ints [/ANALYSIS]"), (2, "<think>hm [DOCSTRING]no[/DOCSTRING]</think>[DOCSTRING]Yes.[/DOCSTRING]"),
    (3, '[AFFECTED_FUNCTIONS][{"qualname":"a.f","path":"a.py","reason":"r"},{"path":"b.py"}][/AFFECTED_FUNCTIONS][DOCSTRING]x[/DOCSTRING]'), (4, "[DOCSTRING]y[/DOCSTRING][AFFECTED_FUNCTIONS]nope[/AFFECTED_FUNCTIONS]"),
]


@query("""SELECT * FROM (VALUES (1::BIGINT, 'Add two.', 'callers see ints', ''), (2, 'Yes.', '', ''), (3, 'x', '', 'a.f'), (4, 'y', '', '')) AS t(id, docstring, analysis, functions)""")
def tagged_sections(spark, sf):
    a = spark.createDataFrame(ANSWERS, "id long, text string")
    t = generate.tagged_answer(F.col("text"))
    return a.select("id", t["docstring"].alias("docstring"), t["analysis"].alias("analysis"), F.array_join(F.transform(generate.affected_functions(F.col("text")), lambda x: x["qualname"]), ",").alias("functions"))


@query("""SELECT role, count(*)::BIGINT AS total_calls, count(*) FILTER (length(text) % 5 <> 0)::BIGINT AS success_calls, coalesce(sum(length(text)) FILTER (length(text) % 5 <> 0), 0)::BIGINT AS total_prompt_tokens,
 coalesce(floor(sum(turn) FILTER (length(text) % 5 <> 0)::DOUBLE / nullif(count(*) FILTER (length(text) % 5 <> 0), 0)), 0)::BIGINT AS avg_latency_ms, round(count(*) FILTER (length(text) % 5 <> 0)::DOUBLE / count(*), 6) AS success_rate FROM conversations GROUP BY role""")
def llm_stats(spark, sf):
    c = table(spark, sf, "conversations")
    log = c.select("role", (F.length("text") % 5 != 0).alias("ok"), F.length("text").cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"), F.col("turn").alias("latency_ms"), F.lit("e").alias("error"))
    return generate.call_stats(log, ["role"]).select("role", "total_calls", "success_calls", "total_prompt_tokens", F.col("avg_latency_ms").cast("long").alias("avg_latency_ms"), F.round("success_rate", 6).alias("success_rate"))


@query(f"""WITH RECURSIVE {bfs_sql(2)}, r1(q, h) AS (SELECT 'p1', 0 UNION SELECT e.caller, h + 1 FROM r1 JOIN e ON e.callee = r1.q WHERE h < 1), b1 AS (SELECT DISTINCT q FROM r1)
SELECT left(b.q, 1) AS kind, count(*)::BIGINT AS impacted_all, count(b1.q)::BIGINT AS impacted_code_only, round(count(b1.q)::DOUBLE / count(*), 6) AS impacted_code_only_ratio FROM b LEFT JOIN b1 ON b1.q = b.q GROUP BY 1""")
def convergence_ratio(spark, sf):
    e = edges(spark, sf)
    kind = F.substring("qualname", 1, 1)
    a, c = (propagate.impact(e, seeds(spark, "p1"), h).withColumn("kind", kind) for h in (2, 1))
    return experiment.convergence(a, c, ["kind"]).withColumn("impacted_code_only_ratio", F.round("impacted_code_only_ratio", 6))


SOURCE = '''import os
from pkg.util import helper as h


class Base:
    def run(self, x, *rest, key=None, **more):
        return self.step(x)

    def step(self, x):
        return h(x)


class Child(Base):
    def step(self, x):
        super().step(x)
        os.getcwd()
        return late(x)


def late(x): return x
'''


def lit_files(spark):
    return spark.createDataFrame([("c1", "pkg/a.py", SOURCE), ("c1", "pkg/bad.py", "def (")], "commit string, path string, source string")


@query("""SELECT * FROM (VALUES (0::BIGINT, 'class', 'pkg.a.Base', ''), (1, 'function', 'pkg.a.Base.run', 'x,*rest,key,**more'), (2, 'function', 'pkg.a.Base.step', 'x'), (3, 'class', 'pkg.a.Child', ''),
 (4, 'function', 'pkg.a.Child.step', 'x'), (5, 'function', 'pkg.a.late', 'x')) AS t(ordinal, kind, qualname, params)""")
def defs_udtf(spark, sf):
    from tremor.operators.parse import parse_defs

    return parse_defs(lit_files(spark)).select(F.col("ordinal").cast("long").alias("ordinal"), "kind", "qualname", F.array_join("params", ",").alias("params"))


@query("""SELECT * FROM (VALUES ('pkg.a.Base.run', 'pkg.a.Base.step'), ('pkg.a.Base.step', 'pkg.util.helper'), ('pkg.a.Child.step', 'os.getcwd'), ('pkg.a.Child.step', 'super'), ('pkg.a.Child.step', 'pkg.a.late')) AS t(caller, callee)""")
def calls_udtf(spark, sf):
    from tremor.operators.parse import parse_calls

    return parse_calls(lit_files(spark)).select("caller", "callee")


@query("SELECT * FROM (VALUES ('pkg.a.late', 'inserted', true), ('pkg.a.Base.run', 'inserted', true)) AS t(qualname, status, ok)")
def patch_apply(spark, sf):
    edits = spark.createDataFrame([("c1", "pkg/a.py", "pkg.a.late", ["x"]), ("c1", "pkg/a.py", "pkg.a.Base.run", ["x", "*rest", "key", "**more"])], "commit string, path string, qualname string, params array<string>")
    done = patch.apply_patches(lit_files(spark), edits.select("commit", "path", "qualname", N.placeholder_docstring(F.col("params")).alias("docstring_lines")))
    checked = patch.verify(done)
    return done.select("qualname", "status").join(checked.select("qualname", "ok"), "qualname")


@query()
def unified_diff_text(spark, sf):
    edits = spark.createDataFrame([("c1", "pkg/a.py", "pkg.a.late", ['"""Late."""'])], "commit string, path string, qualname string, docstring_lines array<string>")
    return patch.patch_text(patch.apply_patches(lit_files(spark), edits))


FILE_SQL = "SELECT page_id, replace('r\\' || " + PATH_SQL + ", '/', '\\') || CASE page_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '\\' ELSE '.txt' END AS path FROM pages"


@query(f"""SELECT page_id, replace(path, '\\', '/') AS slashed, coalesce(nullif(string_split(rtrim(replace(path, '\\', '/'), '/'), '/')[-1], ''), 'repo') AS repo, string_split(replace(path, '\\', '/'), '/')[-1] AS base,
 ends_with(path, '.py') AS python FROM ({FILE_SQL})""")
def path_names(spark, sf):
    raw = F.regexp_replace(F.regexp_replace(F.regexp_extract("url", "://[^/?#]+/([^?#]*)", 1), "/$", ""), "[^A-Za-z0-9/_]", "_")
    end = F.when(F.col("page_id") % 3 == 0, ".py").when(F.col("page_id") % 3 == 1, "\\").otherwise(".txt")
    p = table(spark, sf, "pages").select("page_id", F.concat(F.replace(F.concat(F.lit("r\\"), raw), F.lit("/"), F.lit("\\")), end).alias("path"))
    path = F.col("path")
    return p.select("page_id", N.slashed(path).alias("slashed"), N.repo_name(path).alias("repo"), N.basename(path).alias("base"), N.is_python(path).alias("python"))


@query("""WITH s AS (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 5 = 0 THEN '' ELSE 'u' || user_id END AS qualname, CASE WHEN event_type = 'error' THEN 'test_change' ELSE 'code_change' END AS seed_type FROM events)
SELECT 'code_only' AS scope, count(*)::BIGINT AS n, min(event_id) AS least FROM s WHERE qualname <> '' AND seed_type = 'code_change' UNION ALL SELECT 'all', count(*), min(event_id) FROM s WHERE qualname <> ''""")
def seed_scope(spark, sf):
    from tremor.operators.seeds import in_scope

    u = F.col("user_id")
    name = F.when(u % 7 == 0, None).when(u % 5 == 0, "").otherwise(F.concat(F.lit("u"), u))
    s = table(spark, sf, "events").select("event_id", name.alias("qualname"), F.when(F.col("event_type") == "error", "test_change").otherwise("code_change").alias("seed_type"))
    one = lambda scope: in_scope(s, scope).agg(F.lit(scope).alias("scope"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least"))
    return one("code_only").unionByName(one("all"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT doc_id, repeat(' ', length(line) % 4) || repeat(chr(9), length(line) % 2) AS indent, line FROM l)
SELECT doc_id, count(*)::BIGINT AS n, sum(length(regexp_extract(indent || line, '^([ \t]*)', 1)))::BIGINT AS indent FROM k GROUP BY 1""")
def line_indents(spark, sf):
    n = F.length("line")
    k = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    k = k.withColumn("line", F.concat(F.repeat(F.lit(" "), n % 4), F.repeat(F.lit("\t"), n % 2), "line"))
    return k.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(N.indent_of(F.col("line")))).alias("indent"))


@query("""SELECT p_partkey, '{' || p_size || '} {x} ' || '{kind}' || p_name || ' is ' || p_type || '; ' || CASE p_size % 3 WHEN 0 THEN 'NumPy style with underlined sections' WHEN 1 THEN 'Sphinx style with field lists' ELSE 'Google style with indented sections' END AS text FROM part""")
def template_render(spark, sf):
    p = table(spark, sf, "part")
    style_name = F.when(F.col("p_size") % 3 == 0, "numpy").when(F.col("p_size") % 3 == 1, "sphinx").otherwise("plain")
    text = N.render("{{{size}}} {{x}} {name} is {kind}; {style}", size=F.col("p_size"), name=F.concat(F.lit("{kind}"), "p_name"), kind=F.col("p_type"), style=N.style_description(style_name))
    return p.select("p_partkey", text.alias("text"))


@query(f"WITH RECURSIVE {bfs_sql(2)} SELECT b.q AS qualname, hop::BIGINT AS hop, round(power(0.51, hop), 6) AS score FROM b ORDER BY power(0.51, hop) DESC, hop, b.q LIMIT 25")
def impact_ranked(spark, sf):
    out = propagate.ranked(propagate.impact_typed(edges(spark, sf), seeds(spark, "p1"), propagate.Config(max_hops=2))).limit(25)
    return out.select("qualname", F.col("hop").cast("long").alias("hop"), F.round("score", 6).alias("score"))


MIXED_SQL = """e AS (SELECT DISTINCT 's' || l_suppkey AS caller, 'p' || l_partkey AS callee, CASE l_suppkey % 4 WHEN 0 THEN 'CALLED_BY' WHEN 1 THEN 'DATA_DEP' WHEN 2 THEN 'EXPOSES_CLI' ELSE 'unheard_of' END AS t FROM lineitem
 UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey, CASE l_partkey % 3 WHEN 0 THEN 'OVERRIDES' WHEN 1 THEN 'DEFINES' ELSE 'DOCS' END FROM lineitem),
w AS (SELECT caller, callee, t, 0.85 * CASE t WHEN 'CALLED_BY' THEN 0.6 WHEN 'DATA_DEP' THEN 0.8 WHEN 'EXPOSES_CLI' THEN 0.95 WHEN 'OVERRIDES' THEN 0.7 WHEN 'DOCS' THEN 0.85 ELSE 0.5 END AS f FROM e)"""


def mixed(spark, sf):
    k, p = F.col("l_suppkey") % 4, F.col("l_partkey") % 3
    up = F.when(k == 0, "CALLED_BY").when(k == 1, "DATA_DEP").when(k == 2, "EXPOSES_CLI").otherwise("unheard_of")
    down = F.when(p == 0, "OVERRIDES").when(p == 1, "DEFINES").otherwise("DOCS")
    s, q = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().select(F.explode(F.array(F.struct(s.alias("caller"), q.alias("callee"), up.alias("edge_type")), F.struct(q.alias("caller"), s.alias("callee"), down.alias("edge_type")))).alias("e"))
    return rows.select("e.*").distinct()


@query(f"""WITH {MIXED_SQL}, h1 AS (SELECT caller AS q, max(f) AS s FROM w WHERE callee = 'p1' GROUP BY 1), h2 AS (SELECT caller AS q, max(h1.s * f) AS s FROM w JOIN h1 ON h1.q = w.callee GROUP BY 1),
h3 AS (SELECT caller AS q, max(h2.s * f) AS s FROM w JOIN h2 ON h2.q = w.callee GROUP BY 1), a AS (SELECT 'p1' AS q, 1.0 AS s UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)
SELECT q AS qualname, round(max(s) * 1e8)::BIGINT AS score FROM a GROUP BY 1""")
def impact_mixed_types(spark, sf):
    return propagate.impact_typed(mixed(spark, sf), seeds(spark, "p1"), propagate.Config(max_hops=3)).select("qualname", F.round(F.col("score") * 1e8).cast("long").alias("score"))


@query(f"""WITH {MIXED_SQL}, h1 AS (SELECT caller AS q, max(f) AS s, arg_min(t, (-f, t)) AS t FROM w WHERE callee = 'p1' GROUP BY 1)
SELECT t AS edge_type, count(*)::BIGINT AS n FROM h1 GROUP BY 1""")
def edge_types_mixed(spark, sf):
    return propagate.edge_type_histogram(propagate.impact_typed(mixed(spark, sf), seeds(spark, "p1"), propagate.Config(max_hops=1)))


@query("""WITH c AS (SELECT conv_id, turn, role, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t, turn % 4 AS k FROM conversations)
SELECT conv_id, turn, role, md5(coalesce(t, '')) AS cleaned, repeat(chr(34), 3) || CASE WHEN k = 3 OR coalesce(t, '') = '' THEN 'TODO: docstring' ELSE t || chr(10) END || repeat(chr(34), 3) AS lines FROM c""")
def answers_cleaned(spark, sf):
    quotes = '"""'
    k = F.col("turn") % 4
    raw = F.when(k == 0, F.concat(F.lit("```python\n"), "text", F.lit("\n```"))).when(k == 1, F.concat(F.lit(quotes), "text", F.lit(quotes))).otherwise(F.concat(F.lit("<think>a plan</think> "), "text"))
    c = table(spark, sf, "conversations").withColumn("raw", F.coalesce(raw, F.lit("")))
    lines = generate.with_fallback(F.when(k == 3, "").otherwise(F.col("raw")), N.placeholder_docstring(F.array().cast("array<string>")))
    return c.select("conv_id", "turn", "role", F.md5(generate.clean_answer(F.col("raw"))).alias("cleaned"), F.array_join(lines, "\n").alias("lines"))


@query(f"""WITH RECURSIVE {bfs_sql(1)}, named AS (SELECT DISTINCT 'p' || p_partkey AS q FROM part WHERE p_partkey <= 40)
SELECT q AS qualname, hop::BIGINT AS hop, CASE WHEN hop = 0 THEN 'direct_change' ELSE 'calls_changed_function' END AS reason FROM b UNION ALL SELECT q, 0, 'module_change' FROM named WHERE q NOT IN (SELECT q FROM b)""")
def generated_added(spark, sf):
    named = table(spark, sf, "part").where("p_partkey <= 40").select(F.concat(F.lit("p"), "p_partkey").alias("qualname"))
    out = targets.add_generated(propagate.impact(edges(spark, sf), seeds(spark, "p1"), 1), named)
    return out.select("qualname", F.col("hop").cast("long").alias("hop"), "reason")


@query("""SELECT o_orderkey AS commit, o_orderpriority AS mode, o_totalprice > 100000 AS verifier_ok, n AS verifier_checked, n - 1 AS impacted_total FROM (SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders) o
LEFT JOIN (SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def batch_run_rows(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderpriority").alias("mode"), "o_totalprice")
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("commit")).agg(F.count(F.lit(1)).alias("n"))
    both = o.join(n, "commit", "left")
    report = both.select("commit", "mode", (F.col("o_totalprice") > 100000).alias("ok"), F.col("n").alias("num_targets_checked"))
    return batch.run_rows(o.select("commit", "mode"), report, both.select("commit", "mode", (F.col("n") - 1).alias("impacted_total")))


@query("""SELECT count(*) FILTER (event_type = 'view')::BIGINT AS view_num_runs, count(*) FILTER (event_type = 'error')::BIGINT AS error_num_runs, round(avg((value > 5)::INT) FILTER (event_type = 'view'), 6) AS view_ok_rate,
 round(avg((value > 5)::INT) FILTER (event_type = 'error'), 6) AS error_ok_rate FROM events""")
def batch_by_mode(spark, sf):
    p = batch.prefixed(batch.rollup(batch_rows(spark, sf), ["mode"]), ["view", "error"])
    return p.select("view_num_runs", "error_num_runs", F.round("view_ok_rate", 6).alias("view_ok_rate"), F.round("error_ok_rate", 6).alias("error_ok_rate"))


@query("SELECT count(*)::BIGINT AS num_runs, round(avg((value > 5)::INT), 6) AS ok_rate, round(avg(CASE WHEN value > 10 THEN value END), 6) AS avg_duration_ms, round(avg(user_id % 7), 6) AS avg_num_targets FROM events")
def batch_overall(spark, sf):
    r = batch.rollup(batch_rows(spark, sf))
    return r.select("num_runs", *(F.round(c, 6).alias(c) for c in ("ok_rate", "avg_duration_ms", "avg_num_targets")))


@query("SELECT o_custkey AS commit, bool_and(o_totalprice > 20000) AS ok, count(*)::BIGINT AS num_targets_checked FROM orders GROUP BY 1")
def verifier_report(spark, sf):
    return patch.report(table(spark, sf, "orders").select(F.col("o_custkey").alias("commit"), (F.col("o_totalprice") > 20000).alias("ok")))


@query(f"""WITH {HOST_SQL}, {SUFFIX_SQL}, p AS (SELECT 'c' || (page_id % 40) AS child, page_id AS ord, regexp_extract(url, '://([^/:?#]+)', 1) AS q FROM pages),
i AS (SELECT child, ord, CASE ord % 3 WHEN 0 THEN q WHEN 1 THEN regexp_replace(q, '^[^.]*[.]', '') ELSE 'zz.' || q END AS base FROM p),
r AS (SELECT s AS base, arg_min(q, (len(string_split(q, '.')), q)) AS q FROM suf WHERE s NOT IN (SELECT q FROM hosts) GROUP BY s)
SELECT child, ord, coalesce(r.q, i.base) AS base FROM i LEFT JOIN r ON r.base = i.base""")
def base_resolution(spark, sf):
    host, k = F.regexp_extract("url", "://([^/:?#]+)", 1), F.col("page_id") % 3
    base = F.when(k == 0, host).when(k == 1, F.regexp_replace(host, r"^[^.]*[.]", "")).otherwise(F.concat(F.lit("zz."), host))
    inherits = table(spark, sf, "pages").select(F.concat(F.lit("c"), F.col("page_id") % 40).alias("child"), F.col("page_id").alias("ord"), base.alias("base"))
    return graph.resolve_bases(inherits, hosts(spark, sf))


@query("""WITH c AS (SELECT 's' || l_suppkey AS caller, CASE l_partkey % 4 WHEN 0 THEN 'os.path' WHEN 1 THEN 'print' ELSE 'p' || l_partkey END AS callee FROM lineitem),
e AS (SELECT DISTINCT caller, callee FROM c WHERE callee NOT IN ('os.path', 'print')), n AS (SELECT 'p' || p_partkey AS q FROM part UNION SELECT caller FROM e UNION SELECT callee FROM e)
SELECT caller, callee, 'CALLS' AS edge_type FROM e UNION ALL SELECT q, NULL, 'node' FROM n""")
def graph_build(spark, sf):
    k = F.col("l_partkey") % 4
    calls = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("caller"), F.when(k == 0, "os.path").when(k == 1, "print").otherwise(F.concat(F.lit("p"), "l_partkey")).alias("callee"))
    nodes, found = graph.build(table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("qualname")), calls)
    return found.unionByName(nodes.select(F.col("qualname").alias("caller"), F.lit(None).cast("string").alias("callee"), F.lit("node").alias("edge_type")))


@query("""WITH f AS (SELECT l_orderkey AS commit, count(DISTINCT l_partkey) AS n, count(DISTINCT l_partkey) FILTER (l_partkey % 2 = 0) AS py, count(DISTINCT l_suppkey) AS s, list_sort(list(DISTINCT 'q' || l_suppkey))[1] AS least FROM lineitem GROUP BY 1)
SELECT o_orderkey AS commit, coalesce(n, 0)::BIGINT AS num_files_in_diff, coalesce(py, 0)::BIGINT AS num_py_files_in_diff, coalesce(s, 0)::BIGINT AS num_seeds, least FROM orders LEFT JOIN f ON commit = o_orderkey""")
def seeds_documents(spark, sf):
    from tremor.operators.seeds import seeds_document

    l = table(spark, sf, "lineitem")  # noqa: E741
    def part(key):
        path = F.concat(F.lit("d/p"), key, F.when(key % 2 == 0, ".py").otherwise(".txt"))
        return F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1 +1 @@\n--- x\n+y"))

    keys = l.where("l_partkey is not null").groupBy(F.col("l_orderkey").alias("commit")).agg(F.collect_list("l_partkey").alias("keys"))
    diffs = keys.select("commit", F.array_join(F.array_sort(F.transform("keys", part)), "\n").alias("diff"))
    none = F.lit(None).cast("string")
    found = l.select("l_orderkey", "l_suppkey").distinct().select(
        F.col("l_orderkey").alias("commit"), F.lit("d/p.py").alias("path"), F.lit("new").alias("version"), F.lit(1).alias("line"), F.lit("function").alias("kind"), F.concat(F.lit("q"), "l_suppkey").alias("qualname"),
        F.array(F.lit(1), F.lit(2)).alias("span"), none.alias("reason"), F.lit(False).alias("is_test"), F.lit("code_change").alias("seed_type"), none.alias("new_code"), none.alias("old_code"),
    )
    commits = table(spark, sf, "orders").select(F.col("o_orderkey").alias("commit"), none.alias("parent"))
    out = seeds_document(found, diffs, commits, "r")
    return out.select("commit", "num_files_in_diff", "num_py_files_in_diff", "num_seeds", F.try_element_at("seeds", F.lit(1))["qualname"].alias("least"))


@query("SELECT doc_id, array_to_string(list_filter(['the', '*de', '**zzz'], lambda p: NOT contains(text, p)), ',') AS missing FROM documents")
def param_coverage_starred(spark, sf):
    params = F.array(F.lit("the"), F.lit("*de"), F.lit("**zzz"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(patch.missing_params(F.col("text"), params, keep_stars=True), ",").alias("missing"))


@query("SELECT role, array_to_string(list_sort(list_distinct(list('e' || turn || left(text, 3))))[1:10], '|') AS errors FROM conversations WHERE text IS NOT NULL GROUP BY role")
def first_errors(spark, sf):
    c = table(spark, sf, "conversations").where("text is not null")
    zero = F.lit(0).cast("long")
    log = c.select("role", F.lit(False).alias("ok"), zero.alias("prompt_tokens"), zero.alias("completion_tokens"), zero.alias("latency_ms"), F.concat(F.lit("e"), "turn", F.left("text", F.lit(3))).alias("error"))
    return generate.call_stats(log, ["role"]).select("role", F.array_join("errors", "|").alias("errors"))


HELD_SQL = "h AS (SELECT 's' || l_suppkey AS caller, 'p' || l_partkey AS callee, (l_orderkey % 10)::INT AS since, least((l_orderkey % 10) + l_linenumber, 11)::INT AS until FROM lineitem)"


def held_edges(spark, sf, named: bool = True):
    """Edges that hold for some of twelve commits."""
    name = lambda kind, key: F.concat(F.lit(kind), key) if named else F.col(key)
    since = (F.col("l_orderkey") % 10).cast("int")
    return table(spark, sf, "lineitem").select(
        name("s", "l_suppkey").alias("caller"), name("p", "l_partkey").alias("callee"), since.alias("since"), F.least(since + F.col("l_linenumber").cast("int"), F.lit(11)).cast("int").alias("until"))


@query(f"""WITH {HELD_SQL}, o AS (SELECT DISTINCT caller, callee, unnest(range(since, until + 1)) AS n FROM h),
g AS (SELECT *, n - row_number() OVER (PARTITION BY caller, callee ORDER BY n) AS run FROM o)
SELECT caller, callee, min(n)::INT AS since, max(n)::INT AS until FROM g GROUP BY caller, callee, run""")
def temporal_edges(spark, sf):
    found = temporal.coalesce(held_edges(spark, sf, named=False), ["caller", "callee"])  # keys are narrower than names
    return found.select(F.concat(F.lit("s"), "caller").alias("caller"), F.concat(F.lit("p"), "callee").alias("callee"), "since", "until")


@query(f"""WITH RECURSIVE {HELD_SQL}, o AS (SELECT DISTINCT caller, callee, unnest(range(since, until + 1)) AS n FROM h),
e AS (SELECT caller, callee, n FROM o UNION SELECT callee, caller, n FROM o),
r(ord, q, h) AS (SELECT n, 'p' || (n + 1), 0 FROM (SELECT unnest(range(12)) AS n) UNION SELECT r.ord, e.caller, h + 1 FROM r JOIN e ON e.callee = r.q AND e.n = r.ord WHERE h < 3),
b AS (SELECT ord, q, min(h) AS hop FROM r GROUP BY 1, 2),
src AS (SELECT c.ord, c.q, min(e.callee) AS source FROM b c JOIN e ON e.caller = c.q AND e.n = c.ord JOIN b p ON p.q = e.callee AND p.ord = c.ord AND p.hop + 1 = c.hop GROUP BY 1, 2)
SELECT ord::INT AS ord, b.q AS qualname, hop::BIGINT AS hop, source FROM b LEFT JOIN src USING (ord, q)""")
def temporal_impact(spark, sf):
    one = held_edges(spark, sf)
    both = temporal.coalesce(one.union(one.select("callee", "caller", "since", "until")), ["caller", "callee"])
    start = spark.range(12).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("p"), F.col("id") + 1).alias("qualname"))
    return propagate.impact(both, start, 3, at="ord").select("ord", "qualname", F.col("hop").cast("long").alias("hop"), "source")


@query("""WITH a AS (SELECT c_nationkey AS k, c_mktsegment AS v, unnest(range(c_custkey % 30, c_custkey % 30 + 9)) AS n FROM customer), b AS (SELECT s_nationkey AS k, unnest(range(s_suppkey % 20, s_suppkey % 20 + 6)) AS n FROM supplier),
o AS (SELECT DISTINCT k, v, n FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND b.n = a.n)) SELECT k, n AS ord, min(v) AS first, max(v) AS last FROM o GROUP BY 1, 2""")
def temporal_subtract_best(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("v"), (F.col("c_custkey") % 30).alias("since"), (F.col("c_custkey") % 30 + 8).alias("until"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 20).alias("since"), (F.col("s_suppkey") % 20 + 5).alias("until"))
    left = temporal.subtract(temporal.coalesce(a, ["k", "v"]), b, ["k"])
    lo, hi = temporal.best(left, ["k"], ["v"]), temporal.best(left, ["k"], ["v"], greatest=True)
    both = temporal.join(lo.withColumnRenamed("v", "first"), hi.withColumnRenamed("v", "last"), ["k"])
    return both.select("k", F.explode(F.sequence("since", "until")).alias("ord"), "first", "last")


@query("""WITH p AS (SELECT DISTINCT user_id, event_id AS line FROM events WHERE event_type = 'error'), s AS (SELECT user_id, event_id AS lo, event_id + CAST(floor(value * 20) AS BIGINT) AS hi FROM events WHERE event_type = 'view')
SELECT p.user_id, p.line, count(*)::BIGINT AS n, min(lo) AS first FROM p JOIN s ON s.user_id = p.user_id AND p.line BETWEEN s.lo AND s.hi GROUP BY 1, 2""")
def spans_containing(spark, sf):
    e = table(spark, sf, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("lo"), (F.col("event_id") + F.floor(F.col("value") * 20).cast("long")).alias("hi"))
    found = spans.containing(e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("line")), views, ["user_id"])
    return found.groupBy("user_id", "line").agg(F.count(F.lit(1)).alias("n"), F.min("span.lo").alias("first"))


@query("""WITH t AS (SELECT l_returnflag AS grp, 'f' || l_partkey AS qualname, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT grp, qualname, 0::BIGINT AS hop, grp || '|' || qualname || '|' AS prompt FROM t UNION ALL SELECT grp, 'g' || qualname, 1, grp || '|g' || qualname || '|from ' || grp || '|' || qualname || '|' FROM t""")
def layered_prompts(spark, sf):
    """Prompts of two hops, with the same names in several groups: each sees the analysis of its own group."""
    low = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.concat(F.lit("f"), "l_partkey").alias("qualname")).distinct()
    up = low.select("grp", F.concat(F.lit("g"), "qualname").alias("qualname"), F.lit(1).alias("hop"), F.col("qualname").alias("source"))
    all_ = low.select("grp", "qualname", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("source")).unionByName(up)
    speak = lambda p: f"[DOCSTRING]d[/DOCSTRING][ANALYSIS]from {p}[/ANALYSIS]"
    out = generate.layered(all_, speak, 1, lambda d: F.concat_ws("|", "grp", "qualname", F.coalesce("parent_analysis", F.lit(""))), ("grp",))
    return out.select("grp", "qualname", F.col("hop").cast("long").alias("hop"), "prompt")


def _file() -> Column:
    return F.concat_ws("_", F.substring("p_brand", 7, 2), F.floor(F.col("p_partkey") / 1000).cast("string"))


def _sources(spark, sf, snippet) -> DataFrame:
    """A file a type, brand and thousand of keys, with a piece of code a part."""
    key = F.col("p_partkey")
    pieces = table(spark, sf, "part").groupBy("p_type", _file().alias("file")).agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), snippet.alias("t")))).alias("s"))
    path = F.concat(F.lit("pkg/b"), "file", F.lit(".py"))
    return pieces.select(F.col("p_type").alias("commit"), path.alias("path"), F.array_join(F.transform("s", lambda x: x["t"]), "").alias("source"))


def _piece(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


PIECES_SQL = """y AS (SELECT *, substr(p_brand, 7, 2) || '_' || (p_partkey // 1000) AS file FROM part),
x AS (SELECT p_type AS commit, 'pkg/b' || file || '.py' AS path, 'pkg.b' || file AS module, p_partkey AS k, p_size AS n, row_number() OVER (PARTITION BY p_type, file ORDER BY p_partkey) - 1 AS i FROM y)"""


def _functions(spark, sf):
    return _sources(spark, sf, _piece("def f", F.col("p_partkey"), "(a, *b):\n    return g", F.col("p_size"), "(a)\n\n\n"))


@query(f"WITH {PIECES_SQL} SELECT commit, path, i::INT AS ordinal, 'function' AS kind, module || '.f' || k AS qualname, (4 * i + 1)::INT AS lineno, (4 * i + 2)::INT AS end_lineno, 'a,*b' AS params FROM x")
def defs_of_files(spark, sf):
    return parse.parse_defs(_functions(spark, sf)).select("commit", "path", "ordinal", "kind", "qualname", "lineno", "end_lineno", F.array_join("params", ",").alias("params"))


@query(f"WITH {PIECES_SQL} SELECT commit, path, module || '.f' || k AS caller, 'g' || n AS callee, (4 * i + 2)::INT AS line FROM x")
def calls_of_files(spark, sf):
    return parse.parse_calls(_functions(spark, sf)).select("commit", "path", "caller", "callee", "line")


def _classes(spark, sf):
    n = F.col("p_size")
    return _sources(spark, sf, _piece("class C", F.col("p_partkey"), "(Base", n, "):\n    def m(self, x: T", n, "):\n        super().m()\n        y = U", n, "()\n        y.go()\n        x.run()\n        return self.n()\n\n\n"))


@query(f"""WITH {PIECES_SQL}, c AS (SELECT *, module || '.C' || k AS cls FROM x)
SELECT commit, cls || '.m' AS caller, unnest(['Base' || n || '.m', 'super', 'U' || n, 'U' || n || '.go', 'T' || n || '.run', cls || '.n']) AS callee, unnest([9 * i + 3, 9 * i + 3, 9 * i + 4, 9 * i + 5, 9 * i + 6, 9 * i + 7])::INT AS line FROM c""")
def calls_level2(spark, sf):
    """Bases, ``super()``, annotated and assigned types."""
    return parse.parse_calls(_classes(spark, sf), 2).select("commit", "caller", "callee", "line")


@query(f"WITH {PIECES_SQL} SELECT commit, module || '.C' || k AS child, 0 AS ord, 'Base' || n AS base FROM x")
def bases_of_files(spark, sf):
    return parse.parse_bases(_classes(spark, sf)).select("commit", "child", "ord", "base")


@query(f"""WITH {PIECES_SQL}, t AS (SELECT commit, path, string_agg('def f' || k || '(a, *b):' || chr(10) || '    \"\"\"Of ' || n || (CASE WHEN k % 2 = 0 THEN ': a and b' ELSE ': x' END) || '.\"\"\"' || chr(10) || '    return g' || n || '(a)' || repeat(chr(10), 3), '' ORDER BY k) AS s FROM x GROUP BY 1, 2)
SELECT x.commit, module || '.f' || k AS qualname, 'inserted' AS status, md5(s) AS source, k % 2 = 0 AS ok, CASE WHEN k % 2 = 0 THEN '' ELSE 'missing_params' END AS errors, CASE WHEN k % 2 = 0 THEN '' ELSE 'a,*b' END AS missing FROM x JOIN t USING (commit, path)""")
def patched_files(spark, sf):
    """Docstrings into every function of every file, and what the verifier says of them."""
    part, k = table(spark, sf, "part"), F.col("p_partkey")
    doc = _piece('\"\"\"Of ', F.col("p_size"), F.when(k % 2 == 0, ": a and b").otherwise(": x"), '.\"\"\"')
    edits = part.select(F.col("p_type").alias("commit"), _piece("pkg/b", _file(), ".py").alias("path"), _piece("pkg.b", _file(), ".f", k).alias("qualname"), F.array(doc).alias("docstring_lines"))
    done = cut(patch.apply_patches(_functions(spark, sf), edits))  # read by the verifier and the join
    checked = patch.verify(done).select("commit", "path", "qualname", "ok", F.array_join("errors", ",").alias("errors"), F.array_join("missing", ",").alias("missing"))
    return done.join(checked, ["commit", "path", "qualname"]).select("commit", "qualname", "status", F.md5("new_source").alias("source"), "ok", "errors", "missing")
