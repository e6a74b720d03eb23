"""Cases from the findings of the fourth round."""

from __future__ import annotations

from palimpsest import catalog
from palimpsest.operators import graphs
from palimpsest.plans import graph

KIND = "id string, text string"


def _sorted(edges):
    return sorted((r.src or "", r.dst, tuple(r.routes), r["count"]) for r in edges.collect())


def _expected(front, back):
    """Routes as the test writes them, met one by one."""
    uses, quoted = {}, {}
    for i, routes in front:
        uses.setdefault(i, []).extend(routes)
    for i, routes in back:
        quoted.setdefault(i, set()).update(routes)
    edges = []
    for src, called in uses.items():
        for dst, held in quoted.items():
            if src != dst and (both := sorted(held & set(called))):
                edges.append((src or "", dst, tuple(both), sum(r in held for r in called)))
    return sorted(edges)


def _frames(spark, front, back):
    text = lambda sign, routes: " ".join(sign % r for r in routes)
    return spark.createDataFrame([(i, text("get('%s')", r)) for i, r in front], KIND), spark.createDataFrame([(i, text("'%s'", r)) for i, r in back], KIND)


def test_seam_edges_of_pieces_wide_classes_and_files_without_a_name(spark):
    """Front files in pieces, back files with 63 to 200 routes, more members than a block has, and a front file without a name."""
    route = lambda n: f"/r{n}"
    front = [(f"f{i % 20}", [route(i * 7 % 90), route(i % 90), route(i % 90)]) for i in range(60)] + [(None, [route(3)]), ("b5", [route(3), route(70)]), ("none", [])]
    back = [(f"b{i}", [route(n) for n in range(3)]) for i in range(1300)] + [(f"w{n}", [route(i) for i in range(n)]) for n in (63, 64, 65, 66, 200)] + [("b5", [route(70)]), ("w200", [])]
    assert _sorted(graphs.seam_edges(*_frames(spark, front, back))) == _expected(front, back)
    assert graphs.seam_edges(*_frames(spark, front, [("b", [])])).count() == 0


def test_seam_edges_without_anything_sent_to_all_tasks(spark, monkeypatch):
    front = [(f"f{i}", [f"/r{i % 5}", "/r9"]) for i in range(30)]
    back = [(f"b{i}", [f"/r{i % 5}"] if i % 3 else [f"/r{j}" for j in range(70)]) for i in range(40)]
    monkeypatch.setattr(graphs, "MOST_SENT", 0)
    assert _sorted(graphs.seam_edges(*_frames(spark, front, back))) == _expected(front, back)


def test_what_front_and_back_files_meet_in_is_not_exchanged(spark):
    """However little Spark would send by itself, edges and what they are made of stay where a front file's calls were dealt to."""
    front, back = _frames(spark, [(f"f{i}", [f"/r{i % 50}"]) for i in range(400)], [(f"b{i}", [f"/r{i % 50}"]) for i in range(400)])
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100b")
    try:
        edges = graphs.seam_edges(front, back)
        plan = edges._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    calls = plan[: plan.index("REPARTITION_BY_NUM")]
    assert "Exchange hashpartitioning" not in calls[: calls.rindex("Exchange hashpartitioning")] and "SortMergeJoin" not in calls
    assert edges.count() == 400 * 8


def test_every_call_and_symbol_of_a_long_file_counts(spark, monkeypatch):
    """The queries, over a TypeScript and a Python file with more symbols and calls than the first 80 and 2,000."""
    n, each = 3000, 20
    typed = "".join(f"function f{i}() {{ g{i}(); }}\n" for i in range(n)) + "function last() {" + "x();" * 60_000 + "}\n"
    python = "".join(f"def f{i}():\n    g{i}()\n" for i in range(n))
    short = [(f"s{i}.ts", "a();") for i in range(each)]
    files = spark.createDataFrame([("a.ts", typed), ("a.py", python), ("none.ts", None), *short], KIND)
    monkeypatch.setattr(graph, "modules", lambda spark, sf_dir: files)
    calls = catalog.queries()["GRF-02_call_sites"](spark, "").collect()
    assert len(calls) == 2 * n + 60_000 + each
    assert {(r.id, r.name, r.enclosing) for r in calls if r.name[0] == "g"} == {(f, f"g{i}", f"f{i}") for f in ("a.ts", "a.py") for i in range(n)}
    assert {r.enclosing for r in calls if r.name == "x"} == {"last"} and sum(r.name == "a" for r in calls) == each
    assert catalog.queries()["GRF-02_symbols"](spark, "").count() == 2 * n + 1
