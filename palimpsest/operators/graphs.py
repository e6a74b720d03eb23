"""File and document graphs: building, degrees, traversal, gates and merged views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scalars import edge_id
from palimpsest.sources import markdown
from palimpsest.storage import dealt, materialize

HUB_FAN_IN = 8
GATES = {"hub_pct": 20.0, "isolated_pct": 30.0, "util_violations": 0.0}
MOST_CANDIDATES = 4
MOST_FOLDERS = 8
#: Rows of layers that a task is dealt, on average, when they are merged.
EDGE_ROWS = 1 << 20
#: Calls that a task is dealt, on average, when front files meet back files.
CALL_ROWS = 1 << 17
#: Back files, and quoted routes, that are sent to all tasks at most; more are exchanged.
MOST_SENT = 1 << 20
#: Back files of a class that one row holds, on average at most.
BLOCK_MEMBERS = 1 << 10
#: Routes that a long can tell apart.
WORD = 64

# Import and definition shapes, source extensions and where routes are called.
JS_IMPORT = r"""(?:import|export)\s[^'"]*?from\s*['"]([^'"]+)['"]|import\s*['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\)"""
PY_IMPORT = r"(?m)^\s*(?:from\s+(\.*[\w.]*)\s+import|import\s+([\w.]+))"
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
SOURCE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "sh", "bash", "java", "go", "rs", "cs", "rb")
IGNORED_FOLDERS = (
    "node_modules", "dist", "build", "coverage", "__pycache__", "data", "generated", "models", "attic", "external",
)
ROUTE_CALL = r"""(?:fetch|get|post|api)\(\s*['"`](/[A-Za-z0-9/_-]+)['"`]"""


def source_files(files: DataFrame) -> DataFrame:
    """The source files among (path): by extension, not hidden, outside ignored folders, at most eight folders deep."""
    steps = F.split("path", "/")
    folders = F.slice(steps, F.lit(1), F.size(steps) - 1)
    hidden = F.exists(steps, lambda s: s.startswith("."))
    extension = F.regexp_extract("path", r"[^/]\.([^./]+)$", 1)
    ignored = F.arrays_overlap(steps, F.array(*map(F.lit, IGNORED_FOLDERS)))
    return files.filter(extension.isin(*SOURCE_EXTENSIONS) & ~hidden & ~ignored & (F.size(folders) <= MOST_FOLDERS))


def normal_path(path: Column) -> Column:
    """A slashed path without ``.`` and inner ``..`` steps; steps above its root stay, so it names nothing below."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))

    def fold(held: Column, step: Column) -> Column:
        top = F.element_at(F.concat(F.array(F.lit("..")), held), -1)
        return F.when((step == "..") & (top != ".."), F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(step)))

    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), fold), "/")


DOCUMENT_LINK = r"\[[^\]]*\]\(([^)\s]+)"
# Fixed value: how an entry says that it supersedes others.
SUPERSEDES = r"(?i)^>\s*(?:🔄\s*)?\*{0,2}supersede"
DAY = r"\d{4}-\d{2}-\d{2}"


def document_graph(docs: DataFrame) -> DataFrame:
    """(src, dst, kind) of documents (id, text): links to documents that are there, and what entries of change logs supersede.

    A link is resolved against the folder of its document, without its anchor. An entry is ``id:date#number``; its first
    line that says so supersedes the entries of the days named there, where a day has one entry of the log only.
    """
    link = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(DOCUMENT_LINK), F.lit(1)))).alias("target")
    found = docs.select(F.col("id").alias("src"), link)
    path = F.trim(F.regexp_replace("target", F.lit("#.*$"), F.lit("")))
    found = found.filter(F.contains(path, F.lit(".md")) & ~path.rlike("^([A-Za-z]+:|/)"))
    found = found.select("src", normal_path(F.concat_ws("/", F.regexp_extract("src", "^(.*)/", 1), path)).alias("dst")).filter("src <> dst").distinct()
    references = found.join(docs.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", F.lit("references").alias("kind"))

    day = F.regexp_extract("date", f"^({DAY})", 1)
    entries = markdown.changelog(docs, "id", "text").select("key", "nth", day.alias("day"), "body").filter("day <> ''")
    numbered = Window.partitionBy("key", "day")
    place = F.row_number().over(numbered.orderBy("nth")) - 1
    entries = entries.withColumn("entry", F.concat("key", F.lit(":"), "day", F.lit("#"), place)).withColumn("n", F.count("*").over(numbered))
    marked = F.get(F.filter(F.split("body", "\n"), lambda line: F.trim(line).rlike(SUPERSEDES)), F.lit(0))
    said = entries.select("key", "entry", F.explode(F.array_distinct(F.regexp_extract_all(marked, F.lit(f"({DAY})"), F.lit(1)))).alias("day"))
    # the entry that speaks is no target: on its own day there may be one other
    own = F.count_if(F.col("t.entry") == F.col("s.entry")).over(Window.partitionBy("s.entry", "s.day"))
    met = said.alias("s").join(entries.alias("t"), ["key", "day"]).filter("t.n <= 2").select(F.col("s.entry").alias("src"), F.col("t.entry").alias("dst"), (F.col("t.n") - own).alias("targets"))
    superseded = met.filter("src <> dst and targets = 1").select("src", "dst", F.lit("supersede").alias("kind"))
    return references.unionByName(superseded)


def deepened_links(text: Column) -> Column:
    """A text for a folder one deeper: relative links climb by one more step."""
    return F.regexp_replace(text, F.lit(r"\]\((?!https?:|mailto:|#|/)(?![^)\s]*[<{])(?:\./)?([^)\s]+)\)"), F.lit("](../$1)"))


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, F.lit("/[^/]*$"), F.lit(""))).otherwise("")


def _resolved(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(src, spec, candidates) to (src, dst): the first candidate that is a file."""
    each = wanted.select("src", "spec", F.posexplode("candidates").alias("nth", "id"))
    return each.join(files.select("id"), "id").groupBy("src", "spec").agg(F.min_by("id", "nth").alias("dst")).select("src", "dst")


def import_edges(files: DataFrame) -> DataFrame:
    """(src, dst) of relative imports in files (id, text): as written, with the known extensions, or as an index."""
    specs = F.concat(*(F.regexp_extract_all("text", F.lit(JS_IMPORT), F.lit(n)) for n in (1, 2, 3)))
    found = dealt(files).select(F.col("id").alias("src"), F.explode(F.array_distinct(specs)).alias("spec"))
    found = found.filter(F.col("spec").startswith("."))
    base = normal_path(F.concat_ws("/", folder(F.col("src")), "spec"))
    extension = F.regexp_extract("base", r"(\.[a-z]+)$", 1)
    bare = F.when(extension.isin(*EXTENSIONS), F.regexp_replace("base", F.lit(r"\.[a-z]+$"), F.lit(""))).otherwise(F.col("base"))
    literal = F.when(extension.isin(*EXTENSIONS), F.array("base")).otherwise(F.array().cast("array<string>"))
    candidates = F.concat(literal, F.array(*(F.concat("bare", F.lit(e)) for e in EXTENSIONS)), F.array(*(F.concat("base", F.lit(f"/index{e}")) for e in EXTENSIONS)))
    wanted = found.withColumn("base", base).withColumn("bare", bare).select("src", "spec", candidates.alias("candidates"))
    return _resolved(wanted, files).distinct()


def python_edges(files: DataFrame) -> DataFrame:
    """(src, dst) of imports in Python files: the module, or the module that a name is taken from, also below another root."""
    found = dealt(files).select(F.col("id").alias("src"), F.explode(F.array_distinct(F.concat(*(F.regexp_extract_all("text", F.lit(PY_IMPORT), F.lit(n)) for n in (1, 2))))).alias("spec")).filter("spec <> ''")
    dots = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    steps = F.filter(F.split(folder(F.col("src")), "/"), lambda s: s != "")
    anchor = F.when(dots > 0, F.slice(steps, F.lit(1), F.greatest(F.size(steps) - dots + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    rest = F.filter(F.split(F.regexp_replace("spec", F.lit(r"^\.+"), F.lit("")), r"\."), lambda s: s != "")
    whole = F.concat(anchor, rest)
    parent = F.slice(whole, F.lit(1), F.greatest(F.size(whole) - 1, F.lit(0)))
    names = F.filter(F.array(F.array_join(whole, "/"), F.array_join(parent, "/")), lambda n: n != "")
    modules = files.select("id", F.regexp_replace("id", F.lit(r"(/__init__)?\.py$"), F.lit("")).alias("module"))
    wanted = found.select("src", "spec", F.posexplode(names).alias("nth", "name"))
    exact = wanted.join(modules, F.col("name") == F.col("module")).select("src", "spec", "nth", "id")
    # a suffix match is an equi-join on every suffix of a module's path
    parts = F.split("module", "/")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    suffixes = modules.filter(F.size(F.split("module", "/")) > 1).select("id", F.explode(tails).alias("tail"))
    loose = wanted.join(suffixes, F.col("name") == F.col("tail")).select("src", "spec", (F.col("nth") + 10).alias("nth"), "id")
    best = exact.unionByName(loose).groupBy("src", "spec").agg(F.min(F.struct("nth", "id")).alias("best"))
    return best.select("src", F.col("best.id").alias("dst")).distinct()


def call_edges(definitions: DataFrame, calls: DataFrame) -> DataFrame:
    """Call sites by name to at most four definitions; one definition is inferred, several are textual; no recursion."""
    pools = definitions.groupBy("name", "member").agg(F.count("*").alias("pool")).filter(F.col("pool") <= MOST_CANDIDATES)
    d = definitions.join(pools, ["name", "member"]).select("name", "member", "pool", F.col("file").alias("to_file"), F.col("symbol").alias("to_symbol"))
    joined = calls.join(d, ["name", "member"]).filter(~((F.col("file") == F.col("to_file")) & (F.col("enclosing") == F.col("to_symbol"))))
    kind = F.when(F.min("pool") == 1, "inferred").otherwise("textual")
    return joined.groupBy(F.col("file").alias("from_file"), F.col("enclosing").alias("from_symbol"), "to_file", "to_symbol").agg(F.count("*").alias("count"), kind.alias("confidence"))


def seam_edges(front: DataFrame, back: DataFrame) -> DataFrame:
    """Front files that call a route and back files that quote it: (src, dst, routes, count). Front files may come in pieces.

    Back files that quote the same routes are one class, and a front file meets each class once. Its edges to the members
    are written out last, so that nothing of their number is exchanged, grouped or spilled.
    """
    calls = front.select("id", F.explode(F.regexp_extract_all("text", F.lit(ROUTE_CALL), F.lit(1))).alias("route"))
    # routes are quoted as a whole, so the back files' quoted strings meet them in an equi-join
    quotes = F.array_distinct(F.regexp_extract_all("text", F.lit("[\"'`](/[A-Za-z0-9/_-]+)[\"'`]"), F.lit(1)))
    members = back.select(F.col("id").alias("dst"), F.explode(quotes).alias("route")).groupBy("dst").agg(F.array_sort(F.collect_set("route")).alias("quotes"))
    # written down, so that Spark knows their size when it plans the joins, and so that a class keeps its number
    members = materialize(members, "seam-members")
    blocks = F.ceil(F.count("*") / BLOCK_MEMBERS).alias("blocks")
    classes = materialize(members.groupBy("quotes").agg(blocks).withColumn("class", F.monotonically_increasing_id()), "seam-classes")
    # all that a front file meets is grouped where the file was dealt to, and a task holds so many calls whatever their number
    tasks = max(front.sparkSession.sparkContext.defaultParallelism, -(-calls.count() // CALL_ROWS))
    uses = calls.repartition(tasks, "id").groupBy("id", "route").agg(F.count("*").alias("n"))
    sent = classes.agg(F.coalesce(F.sum(F.size("quotes")), F.lit(0))).first()[0] <= MOST_SENT
    to_all = lambda small, few: F.broadcast(small) if few else small
    meet = lambda held: uses.join(to_all(held.select("class", F.posexplode("quotes").alias("place", "route")), sent), "route")

    # where a word of bits can say which routes of a class are called, nothing but numbers is summed
    narrow, wide = classes.filter(F.size("quotes") <= WORD), classes.filter(F.size("quotes") > WORD)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))
    met = meet(narrow).groupBy("id", "class").agg(F.bit_or(bit).alias("called"), F.sum("n").alias("count"))
    called = F.filter("quotes", lambda _, place: F.getbit("called", place) == 1)
    met = met.join(to_all(narrow, sent), "class").select("id", "class", called.alias("routes"), "count")
    if not wide.isEmpty():
        met = met.unionByName(meet(wide).groupBy("id", "class").agg(F.array_sort(F.collect_list("route")).alias("routes"), F.sum("n").alias("count")))

    blocked = members.join(classes, "quotes").groupBy("class", F.pmod(F.xxhash64("dst"), "blocks").alias("block")).agg(F.collect_list("dst").alias("dsts"))
    edges = met.join(to_all(blocked, members.count() <= MOST_SENT), "class").select(F.col("id").alias("src"), F.explode("dsts").alias("dst"), "routes", "count")
    return edges.filter(~F.col("src").eqNullSafe(F.col("dst")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) of every node, in one aggregation over the edges' ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    held = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    zero = F.lit(0).cast("long")
    return nodes.select("id").join(held, "id", "left").select("id", F.coalesce("fan_in", zero).alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"))


def fitness(placed: DataFrame, violations: DataFrame) -> DataFrame:
    """(metric, value, threshold, passed) from degrees and edges that leave a util slot."""
    share = lambda n: F.coalesce(F.round(F.try_divide(n * 1000, F.count("*"))) / 10, F.lit(0.0))
    found = placed.agg(
        share(F.count_if(F.col("fan_in") >= HUB_FAN_IN)).alias("hub_pct"), share(F.count_if((F.col("fan_in") == 0) & (F.col("fan_out") == 0))).alias("isolated_pct")
    ).crossJoin(violations.agg(F.count("*").cast("double").alias("util_violations")))  # single rows
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).alias("threshold")) for m, t in GATES.items()))
    return found.select(F.explode(rows).alias("g")).select("g.*", (F.col("g.value") <= F.col("g.threshold")).alias("passed"))


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id, hops) of all nodes that edges (src to dst) lead to from ``start`` (id), by whole frontiers."""
    seen = frontier = materialize(start.select("id", F.lit(0).alias("hops")), "reached")
    hops = 0
    while not frontier.isEmpty():
        hops += 1
        ahead = frontier.join(edges, frontier["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        # each hop writes its own nodes only; all frontiers together are what has been seen
        frontier = materialize(ahead.join(seen, "id", "left_anti").withColumn("hops", F.lit(hops)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, start, end) -> DataFrame:
    """(step, src, dst, forward) of one shortest undirected path; of several, by the smallest predecessors."""
    ways = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("forward")).unionByName(
        edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(False).alias("forward"))
    )
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    first = spark.range(1).select(F.lit(start).cast(kind).alias("id"), F.lit(None).cast(kind).alias("parent"), F.lit(None).cast("boolean").alias("forward"), F.lit(0).alias("hops"))
    seen = frontier = materialize(first, "path")
    hops = 0
    while not frontier.isEmpty() and frontier.filter(F.col("id") == end).isEmpty():
        hops += 1
        ahead = frontier.select(F.col("id").alias("a")).join(ways, "a").groupBy(F.col("b").alias("id")).agg(F.min(F.struct("a", "forward")).alias("best"))
        ahead = ahead.select("id", F.col("best.a").alias("parent"), F.col("best.forward").alias("forward"), F.lit(hops).alias("hops"))
        frontier = materialize(ahead.join(seen, "id", "left_anti").select(first.columns), "path-frontier")
        seen = seen.unionByName(frontier)
    steps, at = [], end
    while (row := seen.filter(F.col("id") == at).first()) is not None and row["parent"] is not None:
        steps.append((row["parent"], at, row["forward"]))  # as many as the path has steps
        at = row["parent"]
    rows = [(i, a, b, f) for i, (a, b, f) in enumerate(reversed(steps), 1)]
    return spark.createDataFrame(rows, f"step int, src {kind}, dst {kind}, forward boolean")


def match_file(files: DataFrame, query: str, most: int = 10) -> DataFrame:
    """Files that a query names: exactly, else by a suffix of their path, else by their base name; at most ten."""
    q = query.lower()
    low = F.lower("id")
    how = F.when(low == q, 0).when(low.endswith("/" + q), 1).when(F.regexp_extract(low, "([^/]*)$", 1) == q.rsplit("/", 1)[-1], 2)
    found = files.withColumn("how", how).filter("how is not null")
    best = found.agg(F.min("how").alias("best"))  # one row
    return found.join(F.broadcast(best), F.col("how") == F.col("best")).orderBy("id").limit(most).select("id", "how")


def moved_touches(files: DataFrame, touches: DataFrame) -> DataFrame:
    """(id, sessions, match): sessions that touched a file's path, or, where none did, a path that is its tail."""
    low = files.select("id", F.lower("id").alias("path"))
    held = touches.select(F.lower("path").alias("path"), "session_id").distinct()
    exact = low.join(held, "path").groupBy("id").agg(F.count_distinct("session_id").alias("sessions")).withColumn("match", F.lit("exact"))
    rest = low.join(exact, "id", "left_anti")
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    tailed = rest.filter(F.size(parts) > 1).select("id", F.explode(tails).alias("path"))
    moved = tailed.join(held, "path").groupBy("id").agg(F.count_distinct("session_id").alias("sessions")).withColumn("match", F.lit("moved"))
    return exact.unionByName(moved)


def merged_view(layers: list[DataFrame]) -> DataFrame:
    """One edge for each (src, dst, kind, rel) of all layers, with a stable name; calls between files that import each other go."""
    out = layers[0]
    for more in layers[1:]:
        out = out.unionByName(more)
    # a task holds so many edges whatever their number: both the sums and the imports are met where they were dealt to
    out = out.repartition(-(-out.count() // EDGE_ROWS) or 1, "src", "dst")
    summed = lambda edges: edges.groupBy("src", "dst", "kind", "rel").agg(F.sum("count").alias("count"))
    calls = F.coalesce(F.col("kind") == "calls", F.lit(True))
    imports = out.filter("kind = 'imports'").select("src", "dst").distinct()
    total = summed(out.filter(~calls)).unionByName(summed(out.filter(calls)).join(imports, ["src", "dst"], "left_anti"))
    return total.withColumn("eid", edge_id(F.col("src"), F.col("dst"), F.col("kind"), F.col("rel")))


def template_gaps(projects: DataFrame, template: DataFrame, present: DataFrame) -> DataFrame:
    """(project, path): what the template of a project's profile has and the project has not."""
    wanted = projects.join(template, "profile").select("project", "path")
    return wanted.join(present, ["project", "path"], "left_anti")


def navigation_cost(sweep: Column, routed: Column) -> Column:
    """How many times the tokens of a routed answer a sweep takes, to one decimal; null where either is nothing."""
    return F.when((sweep > 0) & (routed > 0), F.round(sweep / routed, 1))
