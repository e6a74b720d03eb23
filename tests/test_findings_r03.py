"""Cases from the findings of the third round."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from palimpsest import catalog
from palimpsest.functions import scalars as S
from palimpsest.operators import embedding, graphs, syntax
from palimpsest.operators.evaluation import embed
from palimpsest.operators.text_index import GramIndex
from palimpsest.operators.vector_store import VectorStore
from palimpsest.plans import indexed
from palimpsest.streaming import ingest


SF = "/root/testdata/sf0.001"


def test_words_end_at_accented_letters_in_digest_patterns(spark):
    rows = spark.createDataFrame([("é chon là",), ("réchon",), ("rechon",), ("chon_1",), ("Nous: USE, é",), ("éuse",)], "t string")
    got = [r[0] for r in rows.select(F.col("t").rlike(S.DIGEST_DECISION)).collect()]
    assert got == [True, True, False, False, True, True]
    errors = spark.createDataFrame([("[tool_result] éerror: x",), ("xerror: x",), ("exit 3é",), ("exit 3x",)], "t string")
    assert [r[0] for r in errors.select(F.col("t").rlike(S.TOOL_ERROR)).collect()] == [True, False, True, False]


def _vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


def test_a_dense_group_has_its_true_nearest(spark):
    """Hundreds of vectors lie nearer to each other than bytes can tell; half of them are removed."""
    rng = np.random.default_rng(5)
    hub = rng.normal(size=64)
    rows = [(i, hub + rng.normal(size=64) * 0.005) for i in range(800)]
    store = VectorStore.create(spark, profile="raw", width=64, native=64)
    store.add(_vectors(spark, rows), profile="raw")
    store.remove(spark.createDataFrame([(i,) for i in range(0, 800, 2)], "vec_id long"))
    asked = _vectors(spark, rows[:20]).withColumnRenamed("vec_id", "query_id")
    unit = np.array([v / np.linalg.norm(v) for _, v in rows]).astype(np.float32).astype(float)
    found = {}
    for r in store.search(asked, 10, digits=6).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.cosine))
    for i in range(20):
        cosine = np.floor(unit[1::2] @ unit[i] * 1e6 + 0.5) / 1e6
        best = np.lexsort((np.arange(400), -cosine))[:10]
        assert found[i] == [(2 * j + 1, cosine[j]) for j in best.tolist()]


def test_words_that_cancel_out_have_an_embedding(spark):
    """Two words of one place and opposite signs; and a text of one space that only Python takes for one."""
    of = lambda i: (zlib.crc32(f"w{i}".encode()) % 64, zlib.crc32(f"w{i}".encode()) >> 16 & 1)
    other = next(i for i in range(1, 5000) if of(i)[0] == of(0)[0] and of(i)[1] != of(0)[1])
    rows = spark.createDataFrame([(f"w0 w{other}",), (" ",), (" \t\n",), (None,)], "t string").select(embed("t").alias("v")).collect()
    assert [None if r.v is None else round(sum(x * x for x in r.v), 4) for r in rows] == [1.0, 1.0, 0.0, None]


def test_warnings_follow_time_over_many_files(spark, tmp_path):
    """Rows of a key lie over 70 files against the order of time; a second run of files goes on from the state."""
    kind = "key long, at long, event_id long, value double, boundary boolean"

    def rows(span):
        return [(k, t, 10 * t + k, 90.0 if (t + k) % 4 else 10.0, t % 11 == 0) for t in span for k in range(5)]

    def run(lots):
        stream = ingest.file_stream(spark, f"{tmp_path}/{lots}", files_per_trigger=None if lots == "one" else 1)
        ingest.warnings(stream, 50.0, f"{tmp_path}/{lots}-out")
        got = spark.read.option("recursiveFileLookup", True).schema(ingest.WARNED).parquet(f"{tmp_path}/{lots}-out/warned").collect()
        return sorted((r.key, r.event_id) for r in got)

    wanted, quiet = [], set()
    for k, _, e, value, boundary in rows(range(140)):
        if boundary:
            quiet.discard(k)
        elif value > 50 and k not in quiet:
            quiet.add(k)
            wanted.append((k, e))
    frame = spark.createDataFrame(rows(range(140)), kind)
    frame.repartitionByRange(70, F.desc("at")).write.parquet(f"{tmp_path}/one")
    assert run("one") == sorted(wanted)
    for span in (range(50), range(50, 75), range(75, 140)):
        spark.createDataFrame(rows(span), kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/more")
        time.sleep(1.1)  # files come in the order of their seconds
    assert run("more") == sorted(wanted)


def test_seam_edges_are_not_grouped_after_they_are_many(spark):
    front = spark.createDataFrame([("f", "fetch('/a'); get('/b'); fetch('/a')"), ("g", "post('/c')"), ("b1", "api('/a')")], "id string, text string")
    back = spark.createDataFrame([("b1", "'/a' '/b'"), ("b2", "'/b' '/a' '/a'"), ("b3", "'/a'"), ("b3", "'/z' '/a'")], "id string, text string")
    edges = graphs.seam_edges(front, back)
    got = sorted((r.src, r.dst, tuple(r.routes), r["count"]) for r in edges.collect())
    both, one = ("/a", "/b"), ("/a",)
    assert got == [("b1", "b2", one, 1), ("b1", "b3", one, 1), ("f", "b1", both, 3), ("f", "b2", both, 3), ("f", "b3", one, 2)]
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_the_query_s_own_vector_is_no_hit_of_the_abstention(spark):
    assert catalog.queries()["RET-11_abstention"](spark, SF).first().top > 0


def test_signature_has_every_digit_of_all_digests(spark):
    """A tree in plain Python over the whole digests of all documents."""

    def tree(digests):
        held = {d: d for d in digests}
        for digits in (6, 4, 2, 0):
            groups = {}
            for name, h in held.items():
                groups.setdefault(name[:digits], []).append(h if digits == 6 else f"{name}:{h}")
            held = {name: hashlib.sha256("\n".join(sorted(parts)).encode()).hexdigest() for name, parts in groups.items()}
        return held[""]

    wanted = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "source", "doc_id").collect():
        wanted.setdefault(r.lang, []).append(hashlib.sha256(f"{r.source}:{r.doc_id}".encode()).hexdigest())
    got = {r.lang: (r.files, r.signature) for r in catalog.queries()["SCL-05_source_signature"](spark, SF).collect()}
    assert got == {lang: (len(d), tree(d)) for lang, d in wanted.items()}


def test_small_negative_components_round_as_in_the_sql(spark, tmp_path):
    spark.createDataFrame([(1, [3.0, -1e-9, -4.0] + [0.0] * 61)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("SCL-06_slice_normalize", "RET-08_slice_normalize"):
        v = catalog.queries()[name](spark, str(tmp_path)).first().v
        assert list(map(repr, v[:4])) == ["0.6", "-0.0", "-0.8", "0.0"]


def test_a_query_of_words_builds_no_index_of_grams(spark, tmp_path):
    spark.read.parquet(f"{SF}/conversations.parquet").limit(40).write.parquet(f"{tmp_path}/conversations.parquet")
    catalog.queries()["AGG-21_stored_words"](spark, str(tmp_path)).collect()
    built = [kind.__name__ for key in indexed._BUILT if str(tmp_path) in key for kind in key[:1]]
    assert built == ["WordIndex"]


def _exchanged(spark):
    """Bytes that all tasks so far have written for exchanges."""
    context = spark._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_an_index_of_grams_exchanges_texts_and_not_grams(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("abcdefgh ", k=500))) for i in range(400)]
    chars, before = sum(len(t) for _, t in rows), _exchanged(spark)
    index = GramIndex.scratch(spark, buckets=4)
    index.add(spark.createDataFrame(rows, "id long, content string"))
    index.remove(spark.createDataFrame(rows[::4], "id long, content string"))
    assert _exchanged(spark) - before < 3 * chars
    index.merge()
    assert _exchanged(spark) - before < 10 * chars
    places = index.blocks().filter("key >= 0").agg(F.sum("held")).first()[0]
    assert places == index.sums()[1] == sum(len(t) - 2 for i, t in rows if i % 4)
    got = {r.id for r in index.search(["abc"]).collect()}
    assert got == {i for i, t in rows if i % 4 and "abc" in t}


def test_small_slices_of_grams_are_merged_into_few(spark):
    index = GramIndex.scratch(spark, buckets=2, slice_docs=50)
    for lot in range(6):
        index.add(spark.createDataFrame([(10 * lot + i, f"text {lot} {i}") for i in range(10)], "id long, content string"))
    many = index.blocks().filter("key = -1").count()
    index.merge()
    assert index.blocks().filter("key = -1").count() <= 4 < many
    assert index.blocks().filter("key = -1").agg(F.sum("n")).first()[0] == 60 and index.search(["text"]).count() == 60


def test_a_recall_that_abstains_builds_no_index(spark, tmp_path):
    spark.read.parquet(f"{SF}/conversations.parquet").limit(40).write.parquet(f"{tmp_path}/conversations.parquet")
    vectors = spark.createDataFrame([(i, [0.0, 1.0]) for i in range(12)], "id long, embedding array<double>")
    found = indexed.recall_checked(spark, str(tmp_path), "the with thing", vector=spark.createDataFrame([([1.0, 0.0],)], "q array<double>"), vectors=vectors)
    assert found.reason == "abstained" and found.hits.isEmpty() and not [key for key in indexed._BUILT if str(tmp_path) in key]


def test_files_of_a_small_table_are_read_by_many_tasks(spark):
    """A table of one partition is dealt out before its texts are parsed."""
    files = spark.createDataFrame([(f"f{i}.ts", "class C {}\nimport x from './g.js';\ngo();\n" + "// filler\n" * 900) for i in range(40)], "id string, text string").coalesce(1)
    for found in (syntax.definitions(files), syntax.call_sites(files), graphs.import_edges(files), graphs.python_edges(files)):
        assert "RepartitionByExpression [id" in found._jdf.queryExecution().optimizedPlan().toString()
    assert syntax.definitions(files).count() == syntax.call_sites(files).count() == 40


def test_a_task_of_a_merged_view_holds_a_bounded_number_of_edges(spark, monkeypatch):
    monkeypatch.setattr(graphs, "EDGE_ROWS", 100)
    rows = [(i % 40, i % 30, kind, "r", 1) for i in range(500) for kind in ("calls", "api")] + [(k, k, "imports", "r", 1) for k in range(20)]
    rows += [(None, 3, "calls", "r", 2), (5, 5, "calls", "r", 1), (5, 6, None, "r", 1)]
    kind = "src long, dst long, kind string, rel string, count int"
    found = graphs.merged_view([spark.createDataFrame(rows[:700], kind), spark.createDataFrame(rows[700:], kind)])
    wanted, imports = {}, {(s, d) for s, d, k, _, _ in rows if k == "imports"}
    for s, d, k, r, n in rows:
        if k != "calls" or (s, d) not in imports:
            wanted[s, d, k, r] = wanted.get((s, d, k, r), 0) + n
    assert {(e.src, e.dst, e.kind, e.rel): e["count"] for e in found.collect()} == wanted
    assert found.rdd.getNumPartitions() >= len(rows) // 100 > 4


def test_pairs_of_words_are_counted_a_few_texts_at_a_time_and_exchanged_one_way(spark, monkeypatch):
    monkeypatch.setattr(embedding, "PIECE_WORDS", 40)
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["a", "b", "c", "dd", "rare"], k=rng.choice([0, 1, 2, 9, 120]))) for _ in range(40)] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    words = spark.createDataFrame([("b", 1, 1), ("a", 0, 1), ("dd", 3, 1), ("c", 2, 1)], "word string, number int, n long")
    number, wanted = {"a": 0, "b": 1, "c": 2, "dd": 3}, {}
    for t in texts:
        place = [number.get(w) for w in (t or "").split()]
        for i, a in enumerate(place):
            for j, b in enumerate(place):
                if a is not None and b is not None and 0 < abs(i - j) <= 4:
                    wanted[a, b] = wanted.get((a, b), 0) + 1
    found = embedding.together(rows, words)
    assert {(r.a, r.b): r.n for r in found.collect()} == wanted
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[1]


def test_a_paraphrase_bench_looks_for_passages_once(spark, monkeypatch):
    """Passages and what is said of them are ranked together, embeddings are there before they are counted, and ranks are those of each alone."""
    from palimpsest.operators import evaluation
    from palimpsest.plans import streams

    asked, embedded, ranks, pairs = [], [], evaluation.four_word_ranks, evaluation.similar_pairs
    monkeypatch.setattr(evaluation, "four_word_ranks", lambda items, docs: asked.append((items, docs)) or ranks(items, docs))
    monkeypatch.setattr(evaluation, "similar_pairs", lambda held, *others: embedded.append(held) or pairs(held, *others))
    found = {r.lane: r.found for r in streams.paraphrase_bench(spark, SF).collect()}
    assert len(asked) == len(embedded) == 1 and "ArrowEvalPython" not in embedded[0]._jdf.queryExecution().optimizedPlan().toString()
    items, docs = asked[0]
    both = {(r.item_id.item_id, r.item_id.is_said, r.doc_id, r.n, r.pos) for r in ranks(items, docs).collect()}
    for is_said in (False, True):
        alone = ranks(items.filter(F.col("item_id.is_said") == is_said).select("item_id.item_id", "text"), docs)
        assert {(r.item_id, is_said, r.doc_id, r.n, r.pos) for r in alone.collect()} == {x for x in both if x[1] == is_said}
    assert found["words"] > 0
