"""The pipeline's stages, one after another, against plain Python on odd documents."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import curriculum_mix, tiered_packing

#: Names that the stages use themselves.
CLASHES = ("row", "id", "tag", "kept_tag", "first_id", "first_tag", "sid", "size", "taken", "position", "beside", "length", "label", "score", "body", "covered")


def _words(rng, n):
    return " ".join(rng.choice("abcdefghijkl") + str(rng.randrange(400)) for _ in range(n))


def _documents():
    rng = random.Random(11)
    shared = [_words(rng, 6) for _ in range(4)]
    rows = []
    for i in range(24):
        rows.append((i, "\n".join(_words(rng, 9) for _ in range(5)), ["a", "b", None][i % 3]))
    for i in (30, 31, 32):  # a passage of four lines that stands in three documents
        rows.append((i, "\n".join([_words(rng, 60), *shared, "", _words(rng, 60)]), "a"))
    rows.append((33, "\n".join(shared), "b"))  # nothing of it is left
    text = _words(rng, 120)
    near = text.split()
    near[60] = "changed"
    rows += [(40, text, "a"), (41, text, "b"), (42, " ".join(near), "a"), (43, text, None)]
    rows += [(50, None, "a"), (51, "", None), (52, " \t\r\n ", "b"), (None, _words(rng, 40), "a"), (None, _words(rng, 40), None)]
    rows += [(60, "twice the same row of a few words", "b")] * 2 + [(61, _words(rng, 30_000), "c")]
    return [(i, t, s, "en" if n % 2 else None, None if t is None else len(t)) for n, (i, t, s) in enumerate(rows)]


def _place(row):
    return (row[0] is not None, row[0] or 0, hashlib.md5((row[1] or "").encode()).hexdigest())


def _without_windows(rows):
    """Lines that later occurrences of a window of three lines cover, document by document."""
    seen, out = {}, {}
    for key in sorted({_place(r) for r in rows}):
        text = next(r[1] or "" for r in rows if _place(r) == key)
        lines = text.split("\n")
        solid = [n for n, line in enumerate(lines) if line.strip(" \t\r\x0b\x0c")]
        covered = set()
        for at in range(len(solid) - 2):
            window = tuple(lines[n] for n in solid[at : at + 3])
            if seen.setdefault(window, (key, at)) != (key, at):
                covered.update(solid[at : at + 3])
        out[key] = (bool(covered), "\n".join(line for n, line in enumerate(lines) if n not in covered))
    cleaned = [(r, *out[_place(r)]) for r in rows]
    return [(r[0], text if lost else r[1], *r[2:]) for r, lost, text in cleaned if not lost or text.strip()]


def _shingles(text):
    words = (text or "").lower().split()
    return {tuple(words)} if len(words) < 5 else {tuple(words[n : n + 5]) for n in range(len(words) - 4)}


def _firsts(rows):
    """The first row of each class of rows that are similar, directly or over others."""
    sets, kind = [_shingles(r[1]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both * 5 >= 4 * (len(sets[a]) + len(sets[b]) - both) and kind[a] != kind[b]:
                kind = [kind[b] if k == kind[a] else k for k in kind]
    return [min((r for r, k in zip(rows, kind, strict=True) if k == one), key=_place) for one in set(kind)]


def _targets(sizes):
    """Shares by weight; what goes beyond twice a source is shared again until nothing does."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    full: set = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        shares = {s: left * weight[s] / sum(weight[t] for t in order if t not in full) for s in order if s not in full}
        over = {s for s, x in shares.items() if x > 2 * sizes[s]}
        if not over:
            return shares | {s: 2 * sizes[s] for s in full}
        full |= over


def _rows(df):
    return sorted(((r["doc_id"], r["text"], r["source"], r["lang"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder whose labels name no usable row."""
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def test_stages_equal_plain_python(spark, folder):
    rows = _documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    columns, tables = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = tables[name] = stage(spark, docs, folder).persist()
        if name != "pack":
            assert docs.columns == columns
            assert docs.filter(" and ".join(f"{c} = 'own {c}'" for c in CLASHES)).count() == docs.count()

    plain = lambda some: sorted((r[:4] for r in some), key=str)
    assert _rows(tables["toxicity"]) == plain(rows)
    cleaned = _without_windows(rows)
    assert len(cleaned) == len(rows) - 1 and _rows(tables["line_dedup"]) == plain(cleaned)
    kept = _firsts(cleaned)
    got = _rows(tables["ngram_jaccard_join"])
    assert len(got) < len(cleaned) and [r[:2] for r in got] == sorted(((r[0], r[1]) for r in kept), key=str)

    sizes: dict = {}
    for _, text, source, _ in got:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    mixed = tables["mix_sources"].withColumn("w", curriculum_mix.words(F.col("text")))
    taken = {r["source"]: r["w"] for r in mixed.groupBy("source").agg(F.sum("w").alias("w")).collect()}
    for source, target in _targets(sizes).items():
        assert abs(taken[source] - target) <= 1, source
    texts = {(r[0], r[3]): r[1] for r in got}
    for r in tables["mix_sources"].collect():
        assert r["n_chars"] == len(r["text"])
        if r["doc_id"] is not None:
            assert texts[r["doc_id"], r["lang"]].split()[: len(r["text"].split())] == r["text"].split()

    encode = tiered_packing.WordEncoder(tiered_packing.default_tokenizer())
    wanted = sorted(len(ids) // 4 + 1 for ids in encode([r["text"] for r in tables["mix_sources"].collect()]))
    whole = [r["doc_tokens"] for r in tables["pack"].filter("start = 0").collect()]
    assert sorted(whole) == wanted and tables["pack"].agg(F.sum("length")).first()[0] == sum(wanted)


def test_stages_of_no_documents(spark, folder):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
