"""Incremental ingest: nothing that was stored is lost, and nothing is stored twice."""

from __future__ import annotations

import json

from palimpsest.operators import store
from palimpsest.streaming import ingest

KIND = "session_id string, uuid string, role string, content string, timestamp string"


def _lot(session, numbers):
    return [(session, f"{session}-{i}" if i % 2 else None, "user", f"text {i}", f"2024-01-0{i}") for i in numbers]


def _held(spark, path):
    return sorted((r.session_id, r.content) for r in spark.read.option("recursiveFileLookup", True).parquet(path).collect())


def test_lots_one_after_another_and_again(spark, tmp_path):
    """A, then B, then A and B once more, by the same source and by one without progress: A and B are held once."""
    inbox, path = f"{tmp_path}/inbox", f"{tmp_path}/store"
    a, b = _lot("a", range(1, 5)), _lot("b", range(1, 4))
    wanted_a, wanted = sorted((x[0], x[3]) for x in a), sorted((x[0], x[3]) for x in a + b)
    run = lambda source: ingest.ingest_messages(ingest.file_stream(spark, inbox), path, source=source)
    spark.createDataFrame(a, KIND).write.mode("append").parquet(inbox)
    run("main")
    assert _held(spark, path) == wanted_a
    spark.createDataFrame(b, KIND).write.mode("append").parquet(inbox)
    run("main")
    assert _held(spark, path) == wanted
    spark.createDataFrame(a + b, KIND).write.mode("append").parquet(inbox)
    run("main")
    run("other")
    run("main")
    assert _held(spark, path) == wanted


def test_a_file_s_stream_takes_no_neighbour(spark, tmp_path):
    one, other = f"{tmp_path}/rows.parquet", f"{tmp_path}/rows.parquet.bak"
    spark.createDataFrame(_lot("a", [1]), KIND).write.parquet(one)
    spark.createDataFrame(_lot("z", [1]), KIND).write.parquet(other)
    ingest.ingest_messages(ingest.file_stream(spark, one), f"{tmp_path}/store")
    assert _held(spark, f"{tmp_path}/store") == [("a", "text 1")]


def test_offsets_of_changed_files(spark):
    offsets = spark.createDataFrame([("same", 2, "v1"), ("more", 1, "v1"), ("shrunk", 5, "v1"), ("reread", 2, "v0"), ("gone", 9, "v1")], "file_path string, last_line long, parser string")
    files = {"same": 2, "more": 3, "shrunk": 2, "reread": 2, "new": 1}
    lines = [(f, i, True) for f, n in files.items() for i in range(n)] + [("more", 3, False)]
    lines = spark.createDataFrame(lines, "file_path string, line_no int, complete boolean")
    pending = store.pending_files(offsets, lines, "v1")
    read = sorted((r.file_path, r.line_no) for r in store.pending_lines(pending, lines).collect())
    assert read == [("more", 1), ("more", 2), ("new", 0), ("reread", 0), ("reread", 1), ("shrunk", 0), ("shrunk", 1)]
    after = {r.file_path: (r.last_line, r.parser) for r in store.upsert_offsets(offsets, pending).collect()}
    assert after == {"same": (2, "v1"), "more": (3, "v1"), "shrunk": (2, "v1"), "reread": (2, "v1"), "new": (1, "v1"), "gone": (9, "v1")}, json.dumps(after)


def test_a_watermark_never_goes_back(spark):
    kind = "bundle int, last_message_id long"
    got = store.advance(spark.createDataFrame([(1, 9), (2, 4)], kind), spark.createDataFrame([(1, 3), (2, 8), (3, 1)], kind)).collect()
    assert {r.bundle: r.last_message_id for r in got} == {1: 9, 2: 8, 3: 1}
