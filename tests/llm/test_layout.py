"""Sharding, mixing, archives, packing and exact search."""

from __future__ import annotations

import struct
import time
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from palimpsest.llm import bit_sliced_topk, curriculum_mix, histogram_shards, tiered_packing, warc_zst
from tests.oracle import rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


def test_shards_are_balanced_and_slots_gapless(spark):
    got = histogram_shards.op1_histogram_shards(spark, "/root/testdata/sf0.01").toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 1000 and set(sizes.index) == set(range(40)) and sizes.max() - sizes.min() <= 2 * got["size"].max()
    for _, slots in got.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))


def test_shards_hold_what_the_documents_hold(spark):
    """Every column against plain Python: sizes and checksums, shards in the order of keys and slots in the order of rows."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = histogram_shards.op1_histogram_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
    in_order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert in_order == sorted(texts)


def test_shards_of_odd_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "x" * 50_000), (3, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    for name in ("part", "key_high", "key_low", "at", "row", "before"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    got = histogram_shards.shard_by_bytes(docs, 2, parts=4)
    assert sorted(r["size"] for r in got.collect()) == [16, 16, 16, 18, 50_016]
    assert got.filter("part = 'own part' and key_high = 'own key_high' and key_low = 'own key_low' and at = 'own at'").count() == 5
    assert histogram_shards.shard_by_bytes(docs.limit(0), 2).count() == 0


def test_a_hot_text_is_spread_over_shards(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    got = histogram_shards.shard_by_bytes(docs, 10, parts=20).filter("text = 'copy'").groupBy("shard").count().collect()
    assert len(got) == 10 and max(r["count"] for r in got) < 150


def test_mix_takes_its_targets_within_two_passes(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), ["a", "b", "c", None][i % 4]) for i in range(400)] + [(1000, None, "a"), (1001, "w " * 30_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = curriculum_mix.mix(docs, digits=1).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all()
    for _, part in got.groupby("source", dropna=False):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 1
    assert abs(got.groupby("source", dropna=False)["target"].first().sum() - 1.5 * got["size"].sum()) < 1
    assert curriculum_mix.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("tilt", [0.25, 0.0, -0.5])
def test_schedules_are_inverted(spark, tilt):
    """The weight integrated up to the time found is the share asked for."""
    shares = [0.0, 0.01, 0.3, 0.5, 0.77, 1.0]
    rows = spark.createDataFrame([(s, tilt) for s in shares], "share double, tilt double").select("share", curriculum_mix._when(F.col("share"), F.col("tilt")).alias("t"))
    for r in rows.collect():
        times = np.linspace(0, r.t, 20_001)
        weights = 1 + tilt * (1 - 2 * times)
        assert abs(np.sum((weights[1:] + weights[:-1]) / 2 * np.diff(times)) - r.share) < 1e-6 and 0 <= r.t <= 1


def test_mix_of_odd_rows(spark):
    """Null and repeated identifiers, repeated rows, clashing columns; the schedule reaches the positions."""
    rows = [(None, f"n {i}", "a") for i in range(60)] + [(7, f"seven times {i}", "b") for i in range(60)] + [(8, "same", "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("piece", F.lit("own")).withColumn("src", F.lit("own")).withColumn("bucket", F.lit(1))
    mixed = curriculum_mix.mix(docs, digits=1)
    assert mixed.count() == len(rows)
    order = curriculum_mix.training_order(mixed)
    assert order.filter("piece = 'own' and src = 'own' and bucket = 1").count() == order.count() > 0
    spread = mixed.filter("doc_id is null").toPandas()
    assert spread["position"].nunique() > 50
    a, b = (mixed.filter(f"source = '{s}'").toPandas()["position"].mean() for s in "ab")
    assert a < b + 0.2


def test_training_order_is_by_position(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s" + str(i % 2)) for i in range(40)], "doc_id long, text string, source string")
    order = curriculum_mix.training_order(curriculum_mix.mix(docs, digits=1))
    assert order.columns == ["doc_id", "text", "source", "position"] and order.filter("position between 0 and 1").count() == order.count() > 40


def test_archives_round_trip(spark):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "z" * 400_000), (None, "n", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.record_id: (r.record_type, r.refers_to, r.payload_bytes, r.payload) for r in warc_zst.read_archives(warc_zst.archive_pages(pages)).collect()}
    text = bytearray("<p>é</p>".encode())
    assert got[2] == ("response", None, 9, text) and got[1] == ("revisit", 2, 9, None) and got[None][0] == "revisit"
    assert got[4][0] == "response" and got[3] == ("revisit", 4, 0, None) and got[5][2] == 400_000
    assert warc_zst.read_archives(warc_zst.archive_pages(pages.limit(0))).count() == 0


def test_archives_of_repeated_rows(spark):
    """Of rows that repeat payload and identifier one is the response."""
    rows = [(2, "b", "same"), (2, "a", "same"), (2, None, "same"), (1, "c", "same"), (5, "x", "own"), (5, "x", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash")).withColumn("again", F.lit(1))
    got = sorted(((r.record_id, r.url, r.record_type, r.refers_to) for r in warc_zst.read_archives(warc_zst.archive_pages(pages)).collect()), key=str)
    assert got == sorted([(2, "a", "response", None), (2, "b", "revisit", 2), (2, None, "revisit", 2), (1, "c", "revisit", 2), (5, "x", "response", None), (5, "x", "revisit", 5)], key=str)


def test_a_page_that_is_there_thousands_of_times_has_one_response(spark):
    rows = [(7, None, "same")] * 2501 + [(7, "z", "same")] * 2 + [(i, "u", f"own {i}") for i in range(20)]
    got = warc_zst.read_archives(warc_zst.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")))
    count = {(r.record_type, r.refers_to, r.url): r["count"] for r in got.filter("payload_bytes = 4").groupBy("record_type", "refers_to", "url").count().collect()}
    assert count == {("response", None, "z"): 1, ("revisit", 7, "z"): 1, ("revisit", 7, None): 2501}
    assert got.filter("record_type = 'response'").count() == 21 and got.count() == 2523


def test_archive_files_are_read_back(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    archives = warc_zst.archive_pages(pages).persist()
    assert warc_zst.export_archives(archives, str(tmp_path)) == archives.count() == len(list(tmp_path.glob("*.warc.zst")))
    columns = ["record_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    read = lambda df: sorted(map(str, df.select(columns).collect()))
    assert read(warc_zst.read_files(spark, str(tmp_path))) == read(warc_zst.read_archives(archives)) and len(read(warc_zst.read_archives(archives))) == pages.count()


def test_reading_an_archive_takes_linear_time():
    """Four times the records take less than eight times as long."""
    def archive(n):
        frames = [zstandard.ZstdCompressor().compress(warc_zst.record(i, "u", b"page %d " % i * 40, None, False)) for i in range(n)]
        return warc_zst.opening_frame(b"") + b"".join(frames)

    took = []
    for content in (archive(2000), archive(8000)):
        began = time.process_time()
        assert len(list(warc_zst.read_archive(content))) in (2000, 8000)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.2
    with pytest.raises(ValueError):
        list(warc_zst.read_archive(archive(3)[:-5]))


def test_faulty_records_are_refused():
    good = warc_zst.record(1, "u", b"payload", None, False)
    assert warc_zst.parse(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"payload\r\n", b"paYload\r\n"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"WARC-Data")):
        with pytest.raises(ValueError):
            warc_zst.parse(bad)
    with pytest.raises(ValueError):
        list(warc_zst.read_archive(good))


def test_pack_fills_every_sequence():
    rng = np.random.default_rng(3)
    for lengths in ([], [1], [5000], [2048, 2049, 1], rng.integers(1, 900, 300).tolist(), rng.integers(1, 9000, 40).tolist()):
        pieces: dict[int, list[tuple[int, int]]] = {}
        for sequence in tiered_packing.pack(lengths):
            size = sum(n for _, _, n in sequence)
            assert 0 < size <= 2048 and size & (size - 1) == 0
            for doc, start, n in sequence:
                pieces.setdefault(doc, []).append((start, n))
        for doc, length in enumerate(lengths):
            at = 0
            for start, n in sorted(pieces[doc]):
                assert start == at
                at += n
            assert at == length


def test_packed_ids_are_the_tokenizer_s(spark):
    from tokenizers import Tokenizer

    rows = [(1, "Hello, World! It's 3.5 o'clock…"), (2, None), (3, "naïve CAFÉ Straße é ΣΑΣ\ttab\x0bvt\u00a0nb"), (4, ""), (4, "x" * 9000), (5, "a.b.c (d) e:f\r\n" * 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(0))
    got = tiered_packing.pack_documents(docs).toPandas()
    tokenizer = Tokenizer.from_file(tiered_packing.default_tokenizer())
    wanted = sorted(struct.pack(f"<{len(i) + 1}I", *i, 1) for i in (tokenizer.encode(t or "", add_special_tokens=False).ids for _, t in rows))
    held = [b"".join(bytes(x) for x in part.sort_values("start")["ids"]) for (_, _), part in got.groupby(["doc_id", "doc_tokens"])]
    assert sorted(held) == wanted


@pytest.mark.parametrize("word", ["\u0130stanbul", "\ufb1d", "\u0958", "caf\u00e9", "e\u0301t\u00e9", "\ufb01n", "Plain"])
def test_words_that_normalisation_takes_apart(word):
    """Some letters become several pieces to the tokenizer."""
    from tokenizers import Tokenizer

    path = tiered_packing.default_tokenizer()
    whole = Tokenizer.from_file(path)
    texts = [f"to {word} and {word}, again", word, f"{word}{word}."]
    got = tiered_packing.WordEncoder(path)(texts)
    assert [np.frombuffer(data, "<u4").tolist() for data in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def _nearest(vectors, k=5):
    """Brute force over rows: (query_id, rank, vec_id, score)."""
    cells = [(i, np.floor(256 * np.array(v, float)).astype(np.int64).tolist()) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, qv) in enumerate(cells):
        if q is None or q % 10:
            continue
        best = sorted((-sum(x * y for x, y in zip(qv, v, strict=False)), i is None, i or 0) for b, (i, v) in enumerate(cells) if b != a)[:k]
        out += [(q, n, None if none else i, -s) for n, (s, none, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def _found(spark, vectors, **more):
    held = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("block", F.lit("clash"))
    rows = bit_sliced_topk.top_k(held, F.col("vec_id") % 10 == 0, **more).collect()
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in rows), key=str)


@pytest.mark.parametrize("rows", [16, None])
def test_search_equals_brute_force(spark, rows):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(150)]
    vectors += [(200, None), (201, [float("nan")] * 8), (202, [1e6] * 8), (203, [0.5, None]), (3, [0.5] * 8), (None, [1.0] * 8), (7, []), (204, [2.0] * 11), (20, [0.5] * 8), (20, [0.5] * 8)]
    assert _found(spark, vectors, block_rows=rows, query_rows=7) == _nearest(vectors)


def test_search_breaks_ties_by_identifier(spark):
    vectors = [(i, [1.0, 0.0]) for i in (40, 3, 9, 10, 2, 1, 8)] + [(50, []), (None, [1.0, 0.0])]
    got = _found(spark, vectors)
    assert got == _nearest(vectors)
    assert [i for q, _, i, _ in sorted(got, key=lambda x: x[:2]) if q == 10] == [1, 2, 3, 8, 9]


def test_search_of_few_or_no_rows(spark):
    assert _found(spark, []) == []
    assert _found(spark, [(10, [1.0])]) == []
    assert _found(spark, [(10, [1.0]), (11, [2.0])]) == [(10, 1, 11, 256 * 512)]


def test_every_letter_of_unicode_has_the_tokenizer_s_ids():
    """Words with each alphabetic code point, and random mixed texts."""
    from tokenizers import Tokenizer

    path = tiered_packing.default_tokenizer()
    whole = Tokenizer.from_file(path)
    letters = [chr(c) for c in range(0x30000) if chr(c).isalpha() and not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"{c} a{c}b, {c}{c}." for c in letters[at : at + 200]) for at in range(0, len(letters), 200)]
    rng = np.random.default_rng(4)
    texts += ["".join(chr(c) for c in rng.choice([32, 46, 44, 65, 97, 98, 0x130, 0xDF, 0x301, 0x4E00, 0xA0, 10, 0x1F600], 60)) for _ in range(300)]
    got = tiered_packing.WordEncoder(path)(texts)
    for text, data, wanted in zip(texts, got, whole.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == wanted.ids, text[:80]


def test_packing_of_odd_rows(spark):
    """Null identifiers, repeated rows, very long texts, no rows; step groups hold nearly equal tokens."""
    rows = [(None, "a b"), (1, "x y z"), (1, "x y z"), (2, "long words here " * 30_000), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("offset", F.lit("clash"))
    got = tiered_packing.pack_documents(docs).toPandas()
    assert got["length"].sum() == got.drop_duplicates(["doc_id", "doc_tokens"])["doc_tokens"].sum() + got[got.doc_id == 1]["doc_tokens"].iloc[0]
    for _, pieces in got.sort_values("offset").groupby("sequence_id"):
        assert (pieces["offset"].to_numpy() == np.cumsum([0, *pieces["length"][:-1]])).all()
    assert tiered_packing.pack_documents(docs.limit(0)).count() == 0
    sizes = np.random.default_rng(1).choice([256, 512, 1024, 2048], 500).tolist()
    held = np.bincount(tiered_packing.balance(sizes), sizes)
    assert held.max() - held.min() <= 2048


def test_registered_queries_equal_their_sql(spark):
    from palimpsest.llm import registry

    for name, sql in registry.oracle_sql().items():
        assert rows_of(registry.queries()[name](spark, SF)) == rows_of_sql(sql, SF), name


def test_pipeline_stages_keep_the_columns_of_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, SF)
        if name != "pack":
            assert docs.columns == columns
            assert 0 < docs.count() <= before * 2
    assert docs.filter("length > 0").count() == docs.count() > 0
