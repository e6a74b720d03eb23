"""Files that grow, shrink and end in half a line: each line is stored once, whatever the runs."""

from __future__ import annotations

import json
import os
import pickle
import random

import pytest

from palimpsest.sources import appended_lines as A
from palimpsest.streaming import transcripts
from palimpsest.streaming.session_store import COLUMNS, SessionStore


def _line(session, i, text=None):
    record = {"type": "user", "uuid": f"{session}-{i}" if i % 3 else None, "timestamp": f"2024-01-01T00:00:{i % 60:02d}Z", "message": {"role": "user", "content": text or f"text {i} of {session}"}}
    return json.dumps(record).encode()


def _write(path, data, at=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    if at:
        os.utime(path, ns=(at, at))


def _held(store):
    return sorted((r.session_id, r.content) for r in store.messages().collect())


def _wanted(**sessions):
    return sorted((s, f"text {i} of {s}") for s, numbers in sessions.items() for i in numbers)


def test_files_that_grow_shrink_and_end_in_half_a_line(spark, tmp_path):
    folder = f"{tmp_path}/in"
    a, b, c = (f"{folder}/log-a/{x}.jsonl" for x in "abc")
    store = SessionStore(spark, f"file://{tmp_path}/store", buckets=8)
    run = lambda: transcripts.ingest_folder(store, f"file://{folder}")
    lines = {s: [_line(s, i) for i in range(6)] for s in "abc"}

    _write(a, b"\n".join(lines["a"][:3]) + b"\n" + lines["a"][3][:20])
    _write(b, b"\n".join(lines["b"][:4]) + b"\n")
    _write(f"{folder}/other/z.jsonl", _line("z", 1) + b"\n")
    run()
    assert _held(store) == _wanted(a=range(3), b=range(4))

    # a ends its half line and goes on, b is written anew with less, c is new and ends in a whole record without a break
    _write(a, b"\n".join(lines["a"][:5]) + b"\n")
    _write(b, b"\r\n".join(lines["b"][4:6]) + b"\r\n")
    _write(c, b"\n".join(lines["c"][:2]))
    run()
    assert _held(store) == _wanted(a=range(5), b=[4, 5], c=range(2))

    # the break of c's last line comes with another line; b is emptied; a is written anew with as many bytes as before
    _write(c, b"\n".join(lines["c"][:3]) + b"\n")
    _write(b, b"")
    _write(a, b"\n".join(_line("a", i).replace(b"text", b"TEXT") for i in range(5)) + b"\n")
    run()
    run()
    assert _held(store) == sorted(_wanted(c=range(3)) + [("a", f"TEXT {i} of a") for i in range(5)])
    parts = store.parts()
    assert len(parts) == 3  # the fourth run found nothing new
    assert store.compact() == 8 and len(store.parts()) == 1 and _held(store) == sorted(_wanted(c=range(3)) + [("a", f"TEXT {i} of a") for i in range(5)])

    os.remove(c)
    _write(b, b"\n".join(lines["b"]) + b"\n")
    run()
    assert _held(store) == sorted(_wanted(b=range(6), c=range(3)) + [("a", f"TEXT {i} of a") for i in range(5)])


def test_a_new_parser_reads_all_anew(spark, tmp_path):
    _write(f"{tmp_path}/in/log-a/a.jsonl", _line("a", 1) + b"\n" + _line("a", 3) + b"\n")
    store = SessionStore(spark, f"file://{tmp_path}/store", buckets=4)
    transcripts.ingest_folder(store, f"file://{tmp_path}/in")
    transcripts.ingest_folder(store, f"file://{tmp_path}/in", parser="v2")
    assert _held(store) == _wanted(a=[1, 3]) and store.stored().filter("role = 'anew'").count() == 1
    assert store.stored().count() == 5  # read twice, in sight once


@pytest.mark.parametrize("seed", range(4))
def test_lines_are_told_once_whatever_the_cuts(tmp_path, seed, monkeypatch):
    """A file grows by random bytes; ranges of tasks are a few bytes, and blocks too."""
    rng = random.Random(seed)
    monkeypatch.setattr(A, "BLOCK_BYTES", 5)
    data = b"".join(bytes(rng.choices(b"ab ", k=rng.randint(0, 12))) + b"\n" for _ in range(60))
    path, before, told = f"{tmp_path}/x.jsonl", {}, []
    at = 0
    while at < len(data):
        at = min(len(data), at + rng.randint(1, 90))
        _write(path, data[:at])
        folder = A.Folder({"path": f"file://{tmp_path}", "partition_bytes": "7"})
        after = folder.state(before)
        again = A.Folder({"path": f"file://{tmp_path}", "partition_bytes": "7"})
        assert again.state(after) == after
        for part in folder.spans(before, after):
            for batch in A.read_spans(part):
                told += [(r["start"], r["value"]) for r in batch.to_pylist()]
        before = json.loads(json.dumps(after))
    starts, wanted, begin = 0, [], 0
    for line in data.split(b"\n")[:-1]:
        wanted.append((begin, line.decode()))
        begin += len(line) + 1
    assert told == wanted and starts == 0


def test_a_whole_record_without_a_break_is_told_once(tmp_path):
    path, before, told = f"{tmp_path}/x.jsonl", {}, []
    for data in (b'{"a": 1}', b'{"a": 1}\n', b'{"a": 1}\n{"b": 2}', b'{"a": 1}\n{"b": 2}\n{"c"', b'{"a": 1}\n{"b": 2}\n{"c": 3}\n'):
        _write(path, data)
        folder = A.Folder({"path": f"file://{tmp_path}"})
        after = folder.state(before)
        told.append([r["value"] for part in folder.spans(before, after) for batch in A.read_spans(part) for r in batch.to_pylist()])
        before = after
    assert told == [['{"a": 1}'], [], ['{"b": 2}'], [], ['{"c": 3}']]


def test_unchanged_files_are_not_opened(tmp_path, monkeypatch):
    for i in range(5):
        _write(f"{tmp_path}/{i}.jsonl", b"{}\n")
    folder = A.Folder({"path": f"file://{tmp_path}"})
    held = folder.state({})
    _write(f"{tmp_path}/3.jsonl", b"{}\n{}\n")
    opened = []
    looked = A.Folder.looked_at
    monkeypatch.setattr(A.Folder, "looked_at", lambda self, path, *a: opened.append(path) or looked(self, path, *a))
    folder.state(held)
    assert [os.path.basename(p) for p in opened] == ["3.jsonl"]


def test_files_as_they_are(spark, tmp_path):
    A.register(spark)
    _write(f"{tmp_path}/deep/a.jsonl", "é\n\nz\r\n".encode() + b"\xff\n")
    _write(f"{tmp_path}/b.txt", b"no\n")
    got = spark.read.format(A.NAME).option("path", f"file://{tmp_path}").load().collect()
    assert [(r.start, r.value) for r in sorted(got, key=lambda r: r.start)] == [(0, "é"), (3, ""), (4, "z"), (7, "�")]
    assert spark.read.format(A.NAME).option("path", f"file://{tmp_path}/none").load().count() == 0


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    """A batch of one session reads one bucket of the store, and a batch tried again changes nothing."""
    store = SessionStore(spark, f"file://{tmp_path}/store", buckets=16)
    row = lambda s, i: (s, i, f"{s}-{i}", "user", f"text {i} of {s}", None, None)
    kind = "session_id string, seq long, uuid string, role string, content string, tool_name string, timestamp string"
    store.add(spark.createDataFrame([row(f"s{s}", i) for s in range(200) for i in range(3)], kind), "main", 0)
    one = spark.createDataFrame([row("s7", 2), row("s7", 3), row("s7", 3)], kind)
    held = store.sessions_of(one.select("session_id"))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    files = {f.split("bucket=")[1].split("/")[0] for f in held.inputFiles()}
    assert held.count() == 3 and len(files) <= 16
    read = store.stored().filter("bucket = 3").inputFiles()
    assert read
    for _ in range(3):
        store.add(one, "main", 1)
    assert store.messages().filter("session_id = 's7'").count() == 4 and store.messages().count() == 601 and len(store.parts()) == 2
    store.add(one, "again", 0)
    assert store.messages().count() == 601
    assert tuple(store.messages().columns) == COLUMNS


def test_an_incomplete_part_does_not_count(spark, tmp_path):
    store = SessionStore(spark, f"file://{tmp_path}/store", buckets=4)
    kind = "session_id string, seq long, uuid string, role string, content string, tool_name string, timestamp string"
    store.add(spark.createDataFrame([("a", 1, "u", "user", "x", None, None)], kind), "main", 0)
    store.add(spark.createDataFrame([("a", 2, "v", "user", "y", None, None)], kind), "main", 1)
    os.remove(f"{tmp_path}/store/{store.parts()[1]}/_SUCCESS")
    assert [r.content for r in store.messages().collect()] == ["x"]
    store.add(spark.createDataFrame([("a", 2, "v", "user", "y", None, None)], kind), "main", 1)
    assert sorted(r.content for r in store.messages().collect()) == ["x", "y"] and len(store.parts()) == 2


def test_a_swap_that_was_interrupted_is_undone(spark, tmp_path):
    store = SessionStore(spark, f"file://{tmp_path}/store", buckets=4)
    kind = "session_id string, seq long, uuid string, role string, content string, tool_name string, timestamp string"
    store.add(spark.createDataFrame([("a", 1, "u", "user", "x", None, None)], kind), "main", 0)
    os.rename(f"{tmp_path}/store", f"{tmp_path}/store.before")
    assert SessionStore(spark, f"file://{tmp_path}/store", buckets=4).messages().count() == 1


EVENTS = "kind string, path string, session_id string, at long"


def _events(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").json(folder)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(folder)


@pytest.mark.parametrize("order", ["as they come", "shuffled", "replayed"])
def test_hook_events_read_their_files_alone(spark, tmp_path, order):
    store = SessionStore(spark, f"file://{tmp_path}/store", buckets=4)
    paths = {s: f"{tmp_path}/in/log-{'b' if s == 'q' else 'a'}/{s}.jsonl" for s in "abcq"}
    item = lambda i: json.dumps({"type": "response_item", "timestamp": "t", "payload": {"type": "message", "id": f"q-{i}", "role": "user", "content": f"text {i} of q"}}).encode()
    for s in "abc":
        _write(paths[s], b"".join(_line(s, i) + b"\n" for i in range(3)))
    _write(paths["q"], item(0) + b"\n")
    uri = {s: f"file://{p}" for s, p in paths.items()}
    first = [("stop", uri["a"], "a", 1), ("prompt", uri["b"], "b", 2), ("stop", uri["a"], "a", 3), ("stop", uri["q"], "q", 4), ("stop", f"file://{tmp_path}/in/log-a/gone.jsonl", "g", 5), ("stop", None, None, 6), ("stop", "file:///elsewhere/x.jsonl", "x", 7)]
    if order == "shuffled":
        random.Random(1).shuffle(first)
    events = f"file://{tmp_path}/events"
    transcripts.ingest_hooks(store, _events(spark, events, first * (2 if order == "replayed" else 1)))
    assert _held(store) == _wanted(a=range(3), q=[0])
    _write(paths["a"], b"".join(_line("a", i) + b"\n" for i in range(5)))
    _write(paths["q"], item(0) + b"\n" + item(1) + b"\n")
    transcripts.ingest_hooks(store, _events(spark, events, [("session-end", uri["a"], "a", 8), ("pre-compact", uri["q"], "q", 9)]))
    assert _held(store) == _wanted(a=range(5), q=[0, 1])
    if order == "replayed":
        # all events again, by a source without progress
        transcripts.ingest_hooks(store, spark.readStream.schema(EVENTS).json(events), source="again")
        assert _held(store) == _wanted(a=range(5), q=[0, 1])


def test_tasks_open_a_bounded_number_of_files_and_get_no_offset(tmp_path, monkeypatch):
    """What a task is sent does not grow with the folder: neither the list of its files nor how far each was read."""
    monkeypatch.setattr(A, "TASK_FILES", 7)
    folder, progress = f"{tmp_path}/in", f"{tmp_path}/progress"
    for i in range(40):
        _write(f"{folder}/log-a/s{i}.jsonl", _line(f"s{i}", 1) + b"\n")
    reader = A.StreamReader({"path": f"file://{folder}", "progress": f"file://{progress}"})
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    assert [len(p.spans) for p in parts] == [7] * 5 + [5] and len(end["files"]) == 40
    assert b"jsonl" not in pickle.dumps(reader)
    sent = pickle.loads(pickle.dumps(reader))
    assert sorted(v for p in parts for b in sent.read(p) for v in b.column(3).to_pylist()) == sorted(_line(f"s{i}", 1).decode() for i in range(40))
    batch = A.BatchReader({"path": f"file://{folder}", "files": json.dumps([f"file://{folder}/log-a/s{i}.jsonl" for i in range(40)]), "until": json.dumps(end)})
    assert b"jsonl" not in pickle.dumps(batch) and len(batch.partitions()) == 6


def test_a_batch_opens_its_files_once(spark, tmp_path, monkeypatch):
    """Adapters look at written lines, however often each does."""
    seen, by_folder = [], transcripts.by_folder
    monkeypatch.setattr(transcripts, "by_folder", lambda lines, adapters: seen.append(lines._jdf.queryExecution().analyzed().toString()) or by_folder(lines, adapters))
    _write(f"{tmp_path}/in/log-a/a.jsonl", _line("a", 1) + b"\n" + _line("a", 2) + b"\n")
    store = SessionStore(spark, f"file://{tmp_path}/store", buckets=4)
    transcripts.ingest_folder(store, f"file://{tmp_path}/in")
    assert len(seen) == 1 and "parquet" in seen[0] and A.NAME not in seen[0]
    assert _held(store) == _wanted(a=(1, 2))
