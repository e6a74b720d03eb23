"""Graph queries: a code tree over ``part``, a closed graph by integer rule, and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.functions.scalars import edge_id
from palimpsest.operators import graphs as G
from palimpsest.operators import syntax
from palimpsest.storage import table

_EDGES = """nodes AS (SELECT p_partkey AS id FROM part),
    edges AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey >= 2 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey >= 3)"""


def rule_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part depends on the parts at half and at a third of its key."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    half = p.filter("p_partkey >= 2").selectExpr("p_partkey as src", "p_partkey div 2 as dst")
    return half.union(p.filter("p_partkey >= 3").selectExpr("p_partkey as src", "p_partkey div 3 as dst")).distinct()


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


def code_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file for each part that imports its two dependencies, in three of the ways an import can be written."""
    name = lambda k: F.concat(F.lit("src/m"), k % 20, F.lit("/f"), k, F.when(k % 5 == 0, "/index.ts").when(k % 5 == 1, ".js").otherwise(".ts"))
    spec = lambda k: F.concat(F.lit("../m"), k % 20, F.lit("/f"), k, F.when(k % 5 == 0, "").otherwise(".js"))
    k = F.col("p_partkey")
    up = F.when(k % 5 == 0, "../").otherwise("")
    half, third = F.expr("p_partkey div 2"), F.expr("p_partkey div 3")
    line = lambda dep: F.when(dep >= 1, F.concat(F.lit("import { x } from '"), up, spec(dep), F.lit("';\n"))).otherwise("")
    text = F.concat(line(half), line(third), F.lit("import fs from 'fs';\nexport function fn"), k % 700, F.lit("() {}\n"))
    return table(spark, sf_dir, "part").select(name(k).alias("id"), text.alias("text"))


_NAME = "'src/m' || ({k} % 20) || '/f' || {k} || CASE {k} % 5 WHEN 0 THEN '/index.ts' WHEN 1 THEN '.js' ELSE '.ts' END"
_CODE = f"SELECT DISTINCT {_NAME.format(k='src')} AS src, {_NAME.format(k='dst')} AS dst FROM edges WHERE dst >= 1"


@query("GRF-01_import_graph", f"WITH {_EDGES} {_CODE}")
@query("JN-15_import_resolution", f"WITH {_EDGES} {_CODE}")
def import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.import_edges(code_tree(spark, sf_dir))


@query("JN-16_python_imports", f"""WITH {_EDGES} SELECT DISTINCT 'app/m' || (src % 20) || '/f' || src || '.py' AS src, 'app/m' || (dst % 20) || '/f' || dst || '.py' AS dst
    FROM edges WHERE dst >= 1 AND (dst = src // 2 OR src % 20 = dst % 20)""")
def python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half by a dotted path below another root, a third by a relative import, which only finds the same package."""
    k = F.col("p_partkey")
    half, third = F.expr("p_partkey div 2"), F.expr("p_partkey div 3")
    first = F.when(half >= 1, F.concat(F.lit("from m"), half % 20, F.lit(".f"), half, F.lit(" import x\n"))).otherwise("")
    second = F.when(third >= 1, F.concat(F.lit("from .f"), third, F.lit(" import y\nimport os\n"))).otherwise("")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("app/m"), k % 20, F.lit("/f"), k, F.lit(".py")).alias("id"), F.concat(first, second).alias("text"))
    return G.python_edges(files)


_PLACES = """CASE k % 9 WHEN 0 THEN 'src/m' || k || '.ts' WHEN 1 THEN 'node_modules/p' || k || '/i.js' WHEN 2 THEN '.git/h' || k || '.py' WHEN 3 THEN 'docs/n' || k || '.md'
    WHEN 4 THEN 'a/b/c/d/e/f/g/h/i/z' || k || '.ts' WHEN 5 THEN 'a/b/c/d/e/f/g/h/y' || k || '.ts' WHEN 6 THEN 'app/.hidden' || k || '.py' WHEN 7 THEN 'lib/data/x' || k || '.go' ELSE 'lib/w' || k || '.rs' END"""


@query("SRC-15_source_tree", f"SELECT path FROM (SELECT p_partkey AS k, {_PLACES.replace('k %', 'p_partkey %').replace('|| k', '|| p_partkey')} AS path FROM part) WHERE k % 9 IN (0, 5, 8)")
def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of files in all kinds of places those that a graph is built of."""
    held = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    return G.source_files(held.select(F.expr(_PLACES).alias("path")))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TypeScript file for each even part and a Python file for each odd one."""
    k = F.col("p_partkey")
    typed = F.format_string(
        "export class C%d {\n  run%d(a) {\n    return this.help(a) + make%d('f(');\n  }\n}\nexport const pick%d = (x) => {\n  if (x) run%d(x);\n};\n"
        "async function load() {\n  function inner() {}\n  return new C%d(); // done()\n}\n", k, k % 7, k % 5, k, k % 3, k,
    )
    python = F.format_string("class P%d:\n    def go(self):\n        return helper(self.x).strip()\n\nasync def main():\n    P%d()  \nmain()\n", k, k)
    name = F.concat(F.lit("f"), k, F.when(k % 2 == 0, ".ts").otherwise(".py"))
    return table(spark, sf_dir, "part").select(name.alias("id"), F.when(k % 2 == 0, typed).otherwise(python).alias("text"))


@query("GRF-02_symbols", """
    WITH f AS (SELECT p_partkey AS k, 'f' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.ts' ELSE '.py' END AS id FROM part)
    SELECT id, 'C' || k AS name, 'class' AS kind, 1 AS line FROM f WHERE k % 2 = 0 UNION ALL SELECT id, 'C' || k || '.run' || (k % 7), 'method', 2 FROM f WHERE k % 2 = 0
    UNION ALL SELECT id, 'pick' || k, 'function', 6 FROM f WHERE k % 2 = 0 UNION ALL SELECT id, 'load', 'function', 9 FROM f WHERE k % 2 = 0
    UNION ALL SELECT id, 'P' || k, 'class', 1 FROM f WHERE k % 2 = 1 UNION ALL SELECT id, 'P' || k || '.go', 'method', 2 FROM f WHERE k % 2 = 1
    UNION ALL SELECT id, 'main', 'function', 5 FROM f WHERE k % 2 = 1""")
def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.definitions(modules(spark, sf_dir), whole=True).drop("last_line")


@query("GRF-02_call_sites", """
    WITH f AS (SELECT p_partkey AS k, 'f' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.ts' ELSE '.py' END AS id FROM part)
    SELECT id, 'help' AS name, true AS member, 3 AS line, 'C' || k || '.run' || (k % 7) AS enclosing FROM f WHERE k % 2 = 0
    UNION ALL SELECT id, 'make' || (k % 5), false, 3, 'C' || k || '.run' || (k % 7) FROM f WHERE k % 2 = 0
    UNION ALL SELECT id, 'run' || (k % 3), false, 7, 'pick' || k FROM f WHERE k % 2 = 0 UNION ALL SELECT id, 'C' || k, false, 11, 'load' FROM f WHERE k % 2 = 0
    UNION ALL SELECT id, 'helper', false, 3, 'P' || k || '.go' FROM f WHERE k % 2 = 1 UNION ALL SELECT id, 'strip', true, 3, 'P' || k || '.go' FROM f WHERE k % 2 = 1
    UNION ALL SELECT id, 'P' || k, false, 6, 'main' FROM f WHERE k % 2 = 1 UNION ALL SELECT id, 'main', false, 7, NULL FROM f WHERE k % 2 = 1""")
def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.call_sites(modules(spark, sf_dir), whole=True)


_CALLS = """defs AS (SELECT p_partkey AS file, 'fn' || (p_partkey % 700) AS name, p_partkey % 2 = 0 AS member, 'fn' || (p_partkey % 700) AS symbol FROM part),
    calls AS (SELECT l_partkey AS file, 'fn' || (l_orderkey % 900) AS name, l_linenumber % 2 = 0 AS member, 'fn' || (l_partkey % 700) AS enclosing FROM lineitem)"""


@query("GRF-03_call_edges", f"""WITH {_CALLS}, pools AS (SELECT name, member, count(*) AS pool FROM defs GROUP BY ALL HAVING count(*) <= 4)
    SELECT c.file AS from_file, c.enclosing AS from_symbol, d.file AS to_file, d.symbol AS to_symbol, count(*) AS count, CASE WHEN min(pool) = 1 THEN 'inferred' ELSE 'textual' END AS confidence
    FROM calls c JOIN defs d USING (name, member) JOIN pools USING (name, member) WHERE NOT (c.file = d.file AND c.enclosing = d.symbol) GROUP BY ALL""")
@query("JN-17_call_resolution", f"""WITH {_CALLS}, pools AS (SELECT name, member, count(*) AS pool FROM defs GROUP BY ALL HAVING count(*) <= 4)
    SELECT c.file AS from_file, c.enclosing AS from_symbol, d.file AS to_file, d.symbol AS to_symbol, count(*) AS count, CASE WHEN min(pool) = 1 THEN 'inferred' ELSE 'textual' END AS confidence
    FROM calls c JOIN defs d USING (name, member) JOIN pools USING (name, member) WHERE NOT (c.file = d.file AND c.enclosing = d.symbol) GROUP BY ALL""")
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c, n: F.concat(F.lit("fn"), F.col(c) % n)
    defs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), name("p_partkey", 700).alias("name"), (F.col("p_partkey") % 2 == 0).alias("member"), name("p_partkey", 700).alias("symbol"))
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file"), name("l_orderkey", 900).alias("name"), (F.col("l_linenumber") % 2 == 0).alias("member"), name("l_partkey", 700).alias("enclosing"))
    return G.call_edges(defs, calls)


@query("GRF-15_callers", f"""WITH {_CALLS} SELECT DISTINCT c.file FROM calls c JOIN defs d USING (name, member) WHERE d.file = 17 AND c.file <> 17 AND (SELECT count(*) FROM defs e WHERE e.name = d.name AND e.member = d.member) <= 4""")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_edges(spark, sf_dir).filter("to_file = 17 and from_file <> 17").select(F.col("from_file").alias("file")).distinct()


@query("GRF-04_impact", f"WITH RECURSIVE {_EDGES}, up(id, hops) AS (SELECT 5::BIGINT, 0 UNION SELECT e.src, hops + 1 FROM up JOIN edges e ON e.dst = up.id WHERE hops < 40) SELECT id, min(hops) AS hops FROM up WHERE id <> 5 GROUP BY id")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that depends on part 5, directly or not, by its least distance."""
    back = rule_edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = spark.range(1).select(F.lit(5).cast("long").alias("id"))
    return G.reached(back, start).filter("hops > 0").select("id", "hops")


@query("GRF-05_match_file", "SELECT 'src/m' || (p_partkey % 20) || '/f' || p_partkey || '/index.ts' AS id, 2 AS how FROM part WHERE p_partkey % 5 = 0 ORDER BY id LIMIT 10")
def match_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.match_file(code_tree(spark, sf_dir).select("id"), "lib/index.ts")


@query("GRF-06_shortest_path", f"""WITH RECURSIVE {_EDGES}, ways AS (SELECT src AS a, dst AS b, true AS forward FROM edges UNION ALL SELECT dst, src, false FROM edges),
    walk(id, hops) AS (SELECT 190::BIGINT, 0 UNION SELECT w.b, hops + 1 FROM walk JOIN ways w ON w.a = walk.id WHERE hops < 14),
    dist AS (SELECT id, min(hops) AS hops FROM walk GROUP BY id),
    parent AS (SELECT d.id, d.hops, min(struct_pack(a := w.a, forward := w.forward)) AS best FROM dist d JOIN ways w ON w.b = d.id JOIN dist p ON p.id = w.a AND p.hops = d.hops - 1 GROUP BY ALL),
    way(step, src, dst, forward) AS (SELECT hops, best.a, id, best.forward FROM parent WHERE id = 101
        UNION ALL SELECT p.hops, p.best.a, p.id, p.best.forward FROM way JOIN parent p ON p.id = way.src)
    SELECT step, src, dst, forward FROM way""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shortest_path(rule_edges(spark, sf_dir), 190, 101)


@query("GRF-06_hops", f"""WITH RECURSIVE {_EDGES}, ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
    walk(id, hops) AS (SELECT 190::BIGINT, 0 UNION SELECT w.b, hops + 1 FROM walk JOIN ways w ON w.a = walk.id WHERE hops < 14)
    SELECT min(hops) AS hops FROM walk WHERE id = 101""")
def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shortest_path(rule_edges(spark, sf_dir), 190, 101).agg(F.max("step").alias("hops"))


_DEGREES = "degrees AS (SELECT id, (SELECT count(*) FROM edges WHERE dst = id) AS fan_in, (SELECT count(*) FROM edges WHERE src = id) AS fan_out FROM nodes)"


@query("AGG-23_degrees", f"WITH {_EDGES}, {_DEGREES} SELECT id, fan_in, fan_out FROM degrees")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(_nodes(spark, sf_dir), rule_edges(spark, sf_dir))


_GATES = f"""WITH {_EDGES}, {_DEGREES} SELECT metric, value, threshold, value <= threshold AS passed FROM (
    SELECT 'hub_pct' AS metric, round(1000.0 * count(*) FILTER (WHERE fan_in >= 8) / count(*)) / 10 AS value, 20.0::DOUBLE AS threshold FROM degrees
    UNION ALL SELECT 'isolated_pct', round(1000.0 * count(*) FILTER (WHERE fan_in = 0 AND fan_out = 0) / count(*)) / 10, 30.0 FROM degrees
    UNION ALL SELECT 'util_violations', count(*)::DOUBLE, 0.0 FROM edges WHERE src % 10 = 9 AND dst % 10 <> 9)"""


@query("AGG-24_fitness", _GATES)
@query("GRF-07_fitness", _GATES)
def fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = rule_edges(spark, sf_dir)
    return G.fitness(G.degrees(_nodes(spark, sf_dir), edges), edges.filter("src % 10 = 9 and dst % 10 <> 9"))


_SEAM = """WITH uses AS (SELECT l_orderkey AS id, '/r' || (l_partkey % 200) AS route, count(*) AS n FROM lineitem GROUP BY ALL),
    quoted AS (SELECT DISTINCT ps AS dst, '/r' || ((ps * 7 + i) % 260) AS route FROM (SELECT s_suppkey AS ps FROM supplier), range(3) r(i))
    SELECT CAST(u.id AS VARCHAR) AS src, 'be' || q.dst AS dst, list_sort(list(DISTINCT u.route)) AS routes, CAST(sum(u.n) AS BIGINT) AS count FROM uses u JOIN quoted q USING (route) GROUP BY 1, 2"""


@query("GRF-10_seam_edges", _SEAM)
@query("JN-18_route_join", _SEAM)
def seam_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.concat(F.lit("fetch('/r"), F.col("l_partkey") % 200, F.lit("');\n"))
    # a front file for each order, in a piece for each of its items
    front = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), call.alias("text"))
    quote = lambda i: F.concat(F.lit('route("/r'), (F.col("s_suppkey") * 7 + i) % 260, F.lit('");\n'))
    back = table(spark, sf_dir, "supplier").select(F.concat(F.lit("be"), "s_suppkey").alias("id"), F.concat(*(quote(i) for i in range(3))).alias("text"))
    return G.seam_edges(front, back)


_TOUCH = """WITH files AS (SELECT 'repo/src/d' || (p_partkey % 30) || '/f' || p_partkey || '.ts' AS id, p_partkey AS k FROM part),
    touches AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'repo/src/d' ELSE 'src/d' END || ((o_custkey % 300 + 1) % 30) || '/F' || (o_custkey % 300 + 1) || '.ts' AS path, o_orderkey % 50 AS session_id FROM orders),
    exact AS (SELECT f.id, count(DISTINCT session_id) AS sessions, 'exact' AS match FROM files f JOIN touches t ON lower(f.id) = lower(t.path) GROUP BY f.id)
    SELECT * FROM exact UNION ALL SELECT f.id, count(DISTINCT session_id), 'moved' FROM files f JOIN touches t ON ends_with(lower(f.id), '/' || lower(t.path)) WHERE f.id NOT IN (SELECT id FROM exact) GROUP BY f.id"""


@query("GRF-11_touches", _TOUCH)
@query("JN-19_suffix_join", _TOUCH)
def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("p_partkey"), F.col("o_custkey") % 300 + 1
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("repo/src/d"), k % 30, F.lit("/f"), k, F.lit(".ts")).alias("id"))
    root = F.when(F.col("o_orderkey") % 2 == 0, "repo/src/d").otherwise("src/d")
    held = table(spark, sf_dir, "orders").select(F.concat(root, c % 30, F.lit("/F"), c, F.lit(".ts")).alias("path"), (F.col("o_orderkey") % 50).alias("session_id"))
    return G.moved_touches(files, held)


@query("GRF-12_taxonomy", "SELECT split_part(p_type, ' ', 1) AS src, split_part(p_type, ' ', 2) AS dst, 'contains' AS kind, count(*) AS n FROM part GROUP BY 1, 2")
def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_type", " ")
    return table(spark, sf_dir, "part").groupBy(F.get(words, F.lit(0)).alias("src"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("dst"), F.lit("contains").alias("kind")).agg(F.count("*").alias("n"))


_LAYERS = """layers AS (SELECT src, dst, 'imports' AS kind, 'declared' AS rel, 1 AS n FROM edges
    UNION ALL SELECT l_partkey, l_suppkey, 'calls', 'inferred', 1 FROM lineitem UNION ALL SELECT l_partkey % 50, l_suppkey, 'api', 'inferred', 1 FROM lineitem WHERE l_linenumber = 1)"""


@query("GRF-14_merged_view", f"""WITH {_EDGES}, {_LAYERS} SELECT src, dst, kind, rel, CAST(sum(n) AS BIGINT) AS count, left(sha1(src || '|' || dst || '|' || kind || '|' || rel), 12) AS eid
    FROM layers l WHERE NOT (kind = 'calls' AND EXISTS (SELECT 1 FROM edges e WHERE e.src = l.src AND e.dst = l.dst)) GROUP BY src, dst, kind, rel""")
def merged_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = lambda df, kind, rel: df.select("src", "dst", F.lit(kind).alias("kind"), F.lit(rel).alias("rel"), F.lit(1).alias("count"))
    items = table(spark, sf_dir, "lineitem")
    calls = items.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    api = items.filter("l_linenumber = 1").select((F.col("l_partkey") % 50).alias("src"), F.col("l_suppkey").alias("dst"))
    return G.merged_view([layer(rule_edges(spark, sf_dir), "imports", "declared"), layer(calls, "calls", "inferred"), layer(api, "api", "inferred")])


@query("GRF-16_navigation_cost", """SELECT p_brand AS root, CAST(sum(p_size) * 100 AS BIGINT) AS sweep, count(*) AS routed, round(sum(p_size) * 100 / count(*), 1) AS ratio FROM part GROUP BY p_brand""")
def navigation_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("root")).agg((F.sum("p_size") * 100).alias("sweep"), F.count("*").alias("routed"))
    return held.withColumn("ratio", G.navigation_cost(F.col("sweep"), F.col("routed")))


@query("GRF-17_cache_key", "SELECT p_mfgr AS project, count(*) AS files FROM (SELECT split_part(p_brand, '#', 1) AS p_mfgr FROM part) GROUP BY 1")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.get(F.split("p_brand", "#"), F.lit(0)).alias("project")).agg(F.count("*").alias("files"))


@query("SNK-13_graph_export", f"WITH {_EDGES} SELECT left(sha1(src || '|' || dst || '|imports|declared'), 12) AS eid, '{{\"from\":\"a/' || src || '\",\"to\":\"a/' || dst || '\"}}' AS json FROM edges")
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as JSON, nodes named by their root."""
    edges = rule_edges(spark, sf_dir)
    named = F.to_json(F.struct(F.concat(F.lit("a/"), "src").alias("from"), F.concat(F.lit("a/"), "dst").alias("to")))
    return edges.select(edge_id(F.col("src"), F.col("dst"), F.lit("imports"), F.lit("declared")).alias("eid"), named.alias("json"))


@query("GOV-04_conformance", """WITH declared AS (SELECT DISTINCT p_brand || '/' || (p_partkey % 100) AS d FROM part WHERE p_size < 25), present AS (SELECT DISTINCT p_brand || '/' || (p_partkey % 100) AS d FROM part WHERE p_size >= 20 AND p_partkey % 3 = 0),
    found AS (SELECT 'undeclared' AS issue, d FROM present WHERE d NOT IN (SELECT d FROM declared) UNION ALL SELECT 'missing', d FROM declared WHERE d NOT IN (SELECT d FROM present))
    SELECT issue, count(*) AS n, array_to_string(list(d ORDER BY d)[1:6], ',') AS samples FROM found GROUP BY issue""")
def conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), F.col("p_partkey") % 100).alias("d"), "p_size", "p_partkey")
    declared, present = part.filter("p_size < 25").select("d").distinct(), part.filter("p_size >= 20 and p_partkey % 3 = 0").select("d").distinct()
    found = present.join(declared, "d", "left_anti").withColumn("issue", F.lit("undeclared")).unionByName(declared.join(present, "d", "left_anti").withColumn("issue", F.lit("missing")))
    return found.groupBy("issue").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("d")), 1, 6), ",").alias("samples"))


@query("GOV-08_template_gap", """
    WITH template AS (SELECT DISTINCT 'agent/' || p_brand || '.md' AS path, CASE WHEN p_size % 3 = 0 THEN 'plain' ELSE 'app' END AS profile FROM part),
    projects AS (SELECT s_suppkey AS project, CASE WHEN s_suppkey % 4 = 0 THEN 'plain' ELSE 'app' END AS profile FROM supplier),
    present AS (SELECT DISTINCT l_suppkey AS project, 'agent/' || p_brand || '.md' AS path FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 49)
    SELECT project, path FROM projects JOIN template USING (profile) EXCEPT SELECT project, path FROM present""")
def template_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a project's template that the project lacks."""
    path, plain = F.concat(F.lit("agent/"), "p_brand", F.lit(".md")), lambda c: F.when(c == 0, "plain").otherwise("app")
    part = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), plain(F.col("p_size") % 3).alias("profile"))
    key = F.col("s_suppkey")
    projects = table(spark, sf_dir, "supplier").select(key.alias("project"), plain(key % 4).alias("profile"))
    bought = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("project"), F.col("l_partkey").alias("p_partkey"))
    present = bought.join(part, "p_partkey").select("project", "path").distinct()
    return G.template_gaps(projects, part.select("profile", "path").distinct(), present)


@query("GOV-07_structure_tree", """WITH f AS (SELECT 'src/m' || (p_partkey % 20) || '/f' || p_partkey AS path FROM part)
    SELECT dir, count(*) AS files FROM (SELECT 'src' AS dir FROM f UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM f) GROUP BY dir""")
def structure_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    steps = F.split(F.concat(F.lit("src/m"), k % 20, F.lit("/f"), k), "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    return table(spark, sf_dir, "part").select(F.explode(dirs).alias("dir")).groupBy("dir").agg(F.count("*").alias("files"))


@query("GOV-02_backlog_references", """WITH files AS (SELECT 'f' || p_partkey || '.ts' AS name FROM part WHERE p_partkey % 4 <> 0),
    refs AS (SELECT o_orderkey AS item, 'f' || (o_custkey * 2) || '.ts' AS name FROM orders)
    SELECT item, name FROM refs WHERE name NOT IN (SELECT name FROM files)""")
def backlog_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in backlog items to files that are not there."""
    files = table(spark, sf_dir, "part").filter("p_partkey % 4 <> 0").select(F.concat(F.lit("f"), "p_partkey", F.lit(".ts")).alias("name"))
    text = F.concat(F.lit("fix `f"), F.col("o_custkey") * 2, F.lit(".ts` soon"))
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.explode(F.regexp_extract_all(text, F.lit("`([\\w./-]+\\.\\w+)`"), F.lit(1))).alias("name"))
    return items.join(files, "name", "left_anti").select("item", "name")


@query("GOV-03_archive_split", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' OR row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 3 THEN 'archive' ELSE 'keep' END AS fate FROM orders")
def archive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed items and all but the newest entries of each owner move to the archive."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    fate = F.when((F.col("o_orderstatus") == "F") | (nth > 3), "archive").otherwise("keep")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fate.alias("fate"))


@query("GOV-05_routing_rows", "SELECT DISTINCT p_type AS concern, 'src/' || lower(p_brand) || '/' AS slot FROM part")
def routing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a routing table in a markdown specification."""
    row = F.concat(F.lit("| "), "p_type", F.lit(" | `src/"), F.lower("p_brand"), F.lit("/` |"))
    shape = r"^\|\s*(.+?)\s*\|\s*`([^`]+)`\s*\|$"
    held = table(spark, sf_dir, "part").select(row.alias("row")).filter(F.col("row").rlike(shape))
    return held.select(F.regexp_extract("row", shape, 1).alias("concern"), F.regexp_extract("row", shape, 2).alias("slot")).distinct()




_DOC = "'docs/d' || ({k} % 5) || '/p' || {k} || '.md'"


def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each page: links in all forms, a change log, and the page's own text in between."""
    k = F.col("page_id")
    half = F.expr("page_id div 2")
    text = F.format_string(
        "# Change log\n[half](../d%d/p%d.md#top) [near](./p%d.md) [again](p%d.md) [own](p%d.md) [web](https://h.org/p1.md) [lost](missing.md) [out](../../../docs/d1/p1.md) [text](notes.txt)\n\n"
        "## [2024-01-%s] — one\n%s\n## [2024-01-02] — two\n> 🔄 **Supersede:** 2024-01-01\n## 2024-01-03 — three\n> supersedes 2024-01-04, 2024-01-02 and 2024-02-30\n"
        "> supersede: 2024-01-01\n## [2024-01-04] four\nit supersedes 2024-01-03\n## [2024-01-04] five\n> Supersede 2024-01-04\n",
        half % 5, half, k + 5, k + 5, k, F.when(k % 3 == 0, "02").otherwise("01"), F.regexp_replace("html", F.lit(r"[\[\]()#]"), F.lit(" ")),
    )
    name = F.concat(F.lit("docs/d"), k % 5, F.lit("/p"), k, F.lit(".md"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("id"), text.alias("text"))


@query("GRF-08_document_graph", f"""
    WITH p AS (SELECT page_id AS k, {_DOC.format(k='page_id')} AS id FROM pages)
    SELECT a.id AS src, b.id AS dst, 'references' AS kind FROM p a JOIN p b ON (b.k = a.k // 2 OR b.k = a.k + 5) AND a.k <> b.k
    UNION ALL SELECT id || ':2024-01-02#0', id || ':2024-01-01#0', 'supersede' FROM p WHERE k % 3 <> 0
    UNION ALL SELECT id || ':2024-01-03#0', id || ':2024-01-02#0', 'supersede' FROM p WHERE k % 3 <> 0
    UNION ALL SELECT id || ':2024-01-04#1', id || ':2024-01-04#0', 'supersede' FROM p""")
def document_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links resolved against folders, and supersede edges where a day names one entry."""
    return G.document_graph(linked_documents(spark, sf_dir))


@query("SCL-10_deepened_links", r"""
    SELECT page_id, md5('[half](../../d' || ((page_id // 2) % 5) || '/p' || (page_id // 2) || '.md#top) [near](../p' || (page_id + 5) || '.md) [web](https://h.org/x.md) [mail](mailto:a@b) [top](#top) [root](/a.md) [made](<a>.md) '
        || '[plain](../p' || page_id || '.md) ' || regexp_replace(html, '[\[\]()]', ' ', 'g')) AS deeper FROM pages""")
def deepened_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's text as it reads one folder deeper."""
    k, half = F.col("page_id"), F.expr("page_id div 2")
    links = F.format_string("[half](../d%d/p%d.md#top) [near](./p%d.md) [web](https://h.org/x.md) [mail](mailto:a@b) [top](#top) [root](/a.md) [made](<a>.md) [plain](p%d.md) ", half % 5, half, k + 5, k)
    text = F.concat(links, F.regexp_replace("html", F.lit(r"[\[\]()]"), F.lit(" ")))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(G.deepened_links(text).cast("binary")).alias("deeper"))
