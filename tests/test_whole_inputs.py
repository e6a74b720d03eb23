"""Queries that must read whole texts and all rows, against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from palimpsest import catalog
from palimpsest.functions.scalars import tokens
from palimpsest.sources.conversation_store import messages

SF = "/root/testdata/sf0.001"


def _rows(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def _docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def test_every_line_of_an_artifact_is_indexed(spark):
    texts = {r.text for r in _docs(spark)}
    wanted = {(hashlib.sha256(t.encode()).hexdigest(), i) for t in texts for i, _ in enumerate(t.split("\n"))}
    got = [(r.sha256, r.ordinal) for r in _rows(spark, "SNK-16_artifact_index")]
    assert len(got) == len(wanted) and set(got) == wanted


def _scores(texts, term):
    """BM25 of one term."""
    words = {i: [w for w in re.split(r"[\W_]+", t.lower()) if w] for i, t in texts.items()}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = sum(term in w for w in words.values())
    idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
    return {i: idf * w.count(term) * 2.2 / (w.count(term) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for i, w in words.items() if term in w}


def test_log_search_scores_whole_texts(spark):
    wanted = _scores({r.doc_id: r.text for r in _docs(spark)}, "with")
    got = {r.id: r.score for r in _rows(spark, "RET-23_log_search")}
    assert len(got) == min(20, len(wanted))
    assert all(abs(score - wanted[i]) < 1e-6 for i, score in got.items())


def test_snippets_lie_around_a_hit_anywhere(spark):
    wanted = {r.doc_id for r in _docs(spark) if re.search(r"(?ai)\b(with|from)\b", r.text)}
    got = {r.doc_id: r.snippet for r in _rows(spark, "PRJ-02_marked_snippet")}
    assert set(got) == wanted
    assert all(re.search(r"(?i)\[(with|from)\]", s) for s in got.values())


def test_signature_changes_with_any_document(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.lang: r.signature for r in _rows(spark, "SCL-05_source_signature")}
    for digit in range(10):
        one = docs.filter(f"doc_id % 10 = {digit}").orderBy("doc_id").first()
        where = str(tmp_path / str(digit))
        docs.filter(f"doc_id <> {one.doc_id}").repartition(3).write.parquet(f"{where}/documents.parquet")
        other = {r.lang: r.signature for r in catalog.queries()["SCL-05_source_signature"](spark, where).collect()}
        assert {lang for lang in found if other.get(lang) != found[lang]} == {one.lang}


def test_every_backlog_item_is_checked(spark):
    files = {r.p_partkey for r in spark.read.parquet(f"{SF}/part.parquet").collect() if r.p_partkey % 4}
    orders = spark.read.parquet(f"{SF}/orders.parquet").collect()
    wanted = sorted((r.o_orderkey, f"f{2 * r.o_custkey}.ts") for r in orders if 2 * r.o_custkey not in files)
    assert sorted((r.item, r.name) for r in _rows(spark, "GOV-02_backlog_references")) == wanted


def test_feedback_counts_all_turns(spark):
    held = Counter()
    for row in messages(spark, SF).select(tokens(F.col("content")).alias("tokens")).collect():
        held.update({t for t in row.tokens if 3 <= len(t) <= 40})
    assert {r.token: r.docs for r in _rows(spark, "AGG-22_feedback_counts")} == {t: n for t, n in held.items() if n >= 2}


def _runs(text):
    w = re.split(r"\s+", text.lower())
    return {" ".join(w[i : i + 4]) for i in range(len(w) - 3)}


def test_paraphrase_bench_equals_brute_force(spark):
    from palimpsest.operators.evaluation import embed

    docs, items = {r.doc_id: r.text for r in _docs(spark)}, {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    said = {i: " ".join(w for n, w in enumerate(t.split(" ")) if n % 5 != 4) for i, t in items.items()}
    gold = {i: {d for d, t in docs.items() if items[i] in t} for i in items}
    vectors = lambda held: np.stack([np.asarray(v, np.float64) for v in embed.func(pd.Series(list(held.values())))])
    ids, matrix, asked = np.array(list(docs)), vectors(docs), vectors(said)
    found = {"words": 0, "hybrid": 0, "rerank": 0}
    runs = {d: _runs(t) for d, t in docs.items()}
    for (i, text), v in zip(said.items(), asked, strict=True):
        shared = {d: len(runs[d] & _runs(text)) for d in docs}
        words = sorted((d for d in docs if shared[d]), key=lambda d: (-shared[d], d))[:60]
        cosine = np.round(matrix @ v, 6)
        near = [int(d) for _, d in sorted(zip(-cosine, ids, strict=True))[:60]]
        score = {d: round(sum(w / (60 + lane.index(d)) for w, lane in ((1.0, words), (1.6, near)) if d in lane), 12) for d in {*words, *near}}
        hybrid = sorted(score, key=lambda d: (-score[d], d))
        q = set(text.lower().split())
        share = {d: round(len(q & set(docs[d].lower().split())) / len(q), 9) for d in hybrid[:40]}
        best = {"words": words, "hybrid": hybrid, "rerank": sorted(hybrid[:40], key=lambda d: (-share[d], hybrid.index(d)))}
        for lane, order in best.items():
            found[lane] += bool(gold[i] & set(order[:3]))
    n = sum(bool(g) for g in gold.values())
    got = {r.lane: (r.queries, r.found) for r in _rows(spark, "EVL-02_paraphrase_bench")}
    assert n > 0 and got == {lane: (n, k) for lane, k in found.items()}


def test_collapse_and_finish_agree_with_recall(spark):
    """The greedy collapse once more in plain Python, over the hits before it."""
    from palimpsest.plans import recall

    hits = sorted(recall.hybrid_hits(spark, SF, recall.TERMS, recall._asked(spark, SF)).collect(), key=lambda r: r.mixed_pos)
    heads, copies = [], []
    for r in hits:
        near = next((h for h in heads if r.embedding is not None and h.embedding is not None and sum(float(a) * float(b) for a, b in zip(r.embedding, h.embedding, strict=True)) >= 0.85), None)
        (heads if near is None else copies).append(r)
    wanted = [r.id for r in heads + copies]
    assert [r.id for r in sorted(_rows(spark, "RET-17_collapse"), key=lambda r: r.pos)] == wanted
    assert [r.id for r in sorted(_rows(spark, "RET-19_hybrid_recall"), key=lambda r: r.pos)] == wanted[:12]
    few = _first_fit(recall.hybrid_hits(spark, SF, recall.TERMS, recall._asked(spark, SF), 5).collect())
    assert [(r.pos, r.id) for r in sorted(_rows(spark, "RET-18_finish"), key=lambda r: r.pos)] == [(n, r.id) for n, (r, _) in enumerate(few[:5], 1)]
    found = {r.id: (r.head, r.similar) for r in _rows(spark, "RET-17_collapse")}
    assert found == {r.id: (head is None, sum(h == r.id for _, h in _first_fit(hits))) for r, head in _first_fit(hits)}


def _first_fit(hits):
    """(hit, the head that it repeats), heads first."""
    heads, copies = [], []
    for r in sorted(hits, key=lambda r: r.mixed_pos):
        near = next((h for h, _ in heads if r.embedding is not None and h.embedding is not None and sum(float(a) * float(b) for a, b in zip(r.embedding, h.embedding, strict=True)) >= 0.85), None)
        heads.append((r, None)) if near is None else copies.append((r, near.id))
    return heads + copies


def test_a_trained_rerank_is_not_worse_than_its_order(spark):
    rows = _rows(spark, "RET-12_trained_rerank")
    rank = lambda place: {r.item_id: min((place(x) for x in rows if x.item_id == r.item_id and x.good), default=None) for r in rows}
    mean = lambda ranks: sum(1 / n for n in ranks.values() if n)
    assert rows and mean(rank(lambda x: x.pos)) >= mean(rank(lambda x: x.place + 1)) > 0


def test_recall_of_short_queries_is_that_of_the_scans(spark):
    from palimpsest.plans import indexed, recall

    for text in ("ui", "to be", "", '"of":'):
        terms = text.replace('"', "").replace(":", "").split()
        scans = [(r.id, r.pos) for r in recall.fts_recall(spark, SF, terms, 12).orderBy("pos").collect()] if terms else []
        found = indexed.recall_checked(spark, SF, text)
        assert [(r.id, r.pos) for r in found.hits.orderBy("pos").collect()] == scans
        assert found.reason == ("found" if scans else "nothing found" if terms else "no terms")
