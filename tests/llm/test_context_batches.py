"""What a task of operator 4 holds beside its tables, and that its counts and orders are those of plain Python."""

import numpy as np
import pyarrow as pa

from palimpsest.llm import context_mixing as C


def test_training_and_scoring_get_small_batches(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('word ', id) AS text").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, at_work, write = spark.conf.get(key), [], C.materialize

    def written(df, label):
        at_work.append((label, int(spark.conf.get(key))))
        return write(df, label)

    monkeypatch.setattr(C, "materialize", written)
    assert C.score(docs, C.train(docs)).count() == 3000
    assert {label for label, rows in at_work if rows <= 1000} >= {"lm-counts", "lm-scored"}
    assert spark.conf.get(key) == before


def test_words_by_columns_are_those_of_one_text_at_a_time():
    texts = ["  Foo BAR\tbaz\n", None, "", " \x0b\x0c\r ", "Äb c  D", "a", " x\x1cy \x00z"]
    words, lengths, streams = C._split(pa.array(texts))
    each = [C._words_of(text) for text in texts]
    assert streams == [C.stream_of(w) for w in each]
    assert words.to_pylist() == [w for of_text in each for w in of_text or [b""]]
    assert lengths.tolist() == [max(1, len(w)) for w in each]


def test_renewed_leaves_are_those_of_the_whole_tables():
    counts = np.zeros((C.CONTEXTS, C._ROWS * 16), np.int32)
    rng = np.random.default_rng(3)
    for held in counts:
        held[rng.integers(0, len(held), 50_000)] = rng.integers(1, 3000, 50_000)
    got = C.Leaves()
    got.renew(counts)
    whole = C.Leaves(np.array([C.node_table(held.reshape(-1, 16)) for held in counts]))
    assert (got.odds == whole.odds).all() and (got.gate1 == whole.gate1).all() and (got.gate2 == whole.gate2).all()


def test_stretches_are_those_of_each_text():
    sizes = np.array([1, 128, 129, 5000, 0, 256, 257])
    order, text, cuts = C._stretches(sizes)
    turns, owner = np.concatenate([C._turns(0, n) for n in sizes.tolist()]), np.repeat(np.arange(len(sizes)), sizes)
    assert (order == np.argsort(turns, kind="stable")).all() and (text == owner[order]).all()
    assert [turn for turn, start, end in cuts for _ in range(start, end)] == np.sort(turns).tolist()
