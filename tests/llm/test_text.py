"""Language-model scoring, line windows and toxicity."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import context_mixing as C
from palimpsest.llm import counterfactual_toxicity as X
from palimpsest.llm import line_windows

SF = "/root/testdata/sf0.001"


def _base(rows):
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in rows}
    counts = Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 10 for t in ts)
    n, v = sum(counts.values()), len(counts)
    return {i: (len(ts), sum(counts[t] > 0 for t in ts), sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)) for i, ts in tokens.items()}


def test_base_score_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(120)
    rows = [tuple(r) for r in docs.collect()] + [(10_001, None), (10_002, ""), (10_003, "ÀB " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rare", F.lit(1))
    got = C.score(docs, C.train(docs.filter(~C.in_fold(F.col("doc_id"))))).collect()
    wanted = _base(rows)
    assert len(got) == len(rows)
    for r in got:
        n, known, base = wanted[r.doc_id]
        assert (r.n_tokens, r.n_known) == (n, known) and abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score < 0 and math.isfinite(r.score)


def test_decisions_are_a_distribution():
    """The probabilities of all bytes after any context sum to one."""
    ranks = np.random.default_rng(0).permutation(256)
    coder, mixer = C.Coder(ranks), C.Mixer(C.first_weights())
    tables = np.random.default_rng(1).integers(-100, 100, (C.CONTEXTS, C._ROWS, 16)).astype(np.int8)
    tables[:, :, 0] = 2
    total = 0.0
    for byte in range(256):
        digit, rows, doc = C._coded(coder, [(0, b"ab c" + bytes([byte]), 4)])
        nats = np.zeros(len(digit))
        mixer.cost(tables, rows, digit, doc, 1, None, nats)
        total += math.exp(-nats.sum())
    assert abs(total - 1) < 1e-4


def _random_tables(seed):
    tables = np.random.default_rng(seed).integers(-100, 100, (C.CONTEXTS, C._ROWS, 16)).astype(np.int8)
    tables[:, :, 0] = np.random.default_rng(seed + 1).integers(0, 5, (C.CONTEXTS, C._ROWS))
    return tables


def _nats(texts, tables, ranks):
    """Nats of each text, coded as scoring does."""
    coder, mixer, out, state = C.Coder(ranks), C.Mixer(C.first_weights()), [0.0] * len(texts), {}
    for chunk in C._chunks(iter(enumerate(texts))):
        digit, rows, doc = C._coded(coder, chunk)
        each = np.zeros(len(digit))
        after = mixer.cost(tables, rows, digit, doc, len(chunk), state.get(chunk[0][0]) if len(chunk) == 1 else None, each)
        state = {chunk[0][0]: after} if len(chunk) == 1 else {}
        for i, (key, _, _) in enumerate(chunk):
            out[key] += each[doc == i].sum()
    return out


def test_a_long_text_costs_the_same_in_windows(monkeypatch):
    """Whatever a window holds, words and gaps longer than it among them."""
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 110, rng.integers(1, 12)).tolist()) for _ in range(400)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 400, 9000)) + b"\n", b"ab" * 20_000 + b" " + b"cd" * 400 + b" tail of it\n", b"short one\n"]
    ranks, tables = rng.permutation(256), _random_tables(3)
    monkeypatch.setattr(C, "WINDOW_BYTES", 1 << 30)
    whole = _nats(texts, tables, ranks)
    for size in (1500, 20_000):
        monkeypatch.setattr(C, "WINDOW_BYTES", size)
        assert np.allclose(_nats(texts, tables, ranks), whole, rtol=1e-5)


def _bit_by_bit(text, tables, ranks):
    """Nats of one text: a decision at a time, the weights refined when a stretch of digits is over."""
    digits, rows, _ = C._coded(C.Coder(ranks), [(0, text, 0)])
    weights = C.first_weights().astype(float)
    squares, pull, nats, over = np.full_like(weights, 4.0), np.zeros_like(weights), 0.0, 128
    for n, digit in enumerate(digits.tolist()):
        if n == over:
            gradient = pull / C.SCALE
            squares += gradient**2
            weights += C.RATE * gradient / np.sqrt(squares)
            pull[:], over = 0, over * 2
        held = [tables[c][rows[c][n]] for c in range(C.CONTEXTS)]
        gate, node = 5 * int(held[1][0]) + int(held[2][0]), 1
        for shift in (3, 2, 1, 0):
            bit = digit >> shift & 1
            inputs = np.array([float(h[node]) for h in held])
            p = 1 / (1 + math.exp(-float(weights[gate] @ inputs) / C.SCALE)) * (1 - 1 / 2048) + 1 / 4096
            nats -= math.log(p if bit else 1 - p)
            pull[gate] += (bit - p) * inputs
            node = 2 * node + bit
    return nats


def test_mixing_equals_a_decision_at_a_time():
    rng = np.random.default_rng(7)
    ranks, tables = rng.permutation(256), _random_tables(5)
    texts = [b"the cat sat on the mat and the dog did not " * 40 + b"\n", "\u00fcber caf\u00e9 x\n".encode(), b"\n"]
    assert np.allclose(_nats(texts, tables, ranks), [_bit_by_bit(t, tables, ranks) for t in texts], rtol=1e-4)


def test_node_table_is_the_log_odds_of_leaf_counts():
    counts = np.random.default_rng(1).integers(0, 9, (50, 16))
    got = C.node_table(counts)
    for row, nodes in zip(counts, got, strict=True):
        for node in range(1, 16):
            depth = node.bit_length() - 1
            width = 16 >> depth
            leaves = row[(node - (1 << depth)) * width :][:width]
            odds = math.log((leaves[width // 2 :].sum() + C.PRIOR) / (leaves[: width // 2].sum() + C.PRIOR))
            assert abs(nodes[node] - odds * C.SCALE) <= 0.51


def test_the_mix_beats_each_context_and_the_base(spark):
    """Held-out documents cost fewer bits than under the token counts alone, and than under any one context."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = C.in_fold(F.col("doc_id"))
    model = C.train(docs.filter(~held))
    rows = C.score(docs.filter(held), model).collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    texts = [C.stream_of(C._words_of(r.text)) for r in docs.filter(held).limit(20).collect()]
    mixed, even = sum(_nats(texts, model.tables, model.ranks)), np.zeros_like(model.tables)
    for c in range(C.CONTEXTS):
        one = even.copy()
        one[c] = model.tables[c]
        assert mixed < sum(_nats(texts, one, model.ranks))


def test_scoring_without_training_text(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = C.score(docs, C.train(docs.limit(0))).collect()
    assert [r.n_known for r in got] == [0, 0] and all(math.isfinite(r.score) and r.train_tokens == 0 for r in got)


@pytest.mark.parametrize("common", [100_000, 0])
def test_score_gains_by_tokens_that_the_tables_do_not_hold(spark, monkeypatch, common):
    """The token table grows with the corpus and counts in the score, whether a token is in memory or joined."""
    monkeypatch.setattr(C, "COMMON_TOKENS", common)
    docs = spark.createDataFrame([(1, "quixotic zephyr " * 50), (2, "abcdefgh ijklmn " * 50), (3, "")], "doc_id long, text string")
    model = C.train(docs.filter("doc_id = 1"))
    model.tables = np.zeros_like(model.tables)
    got = {r.doc_id: r for r in C.score(docs, model).collect()}
    assert got[1].bits_per_byte < got[2].bits_per_byte / 2
    assert math.isfinite(got[3].score) and got[3].score < 0


def test_every_chunk_refines_the_weights():
    import pyarrow as pa

    text = "some words here and there " * (C.CHUNK_BYTES // 26 + 1)
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 4)], ["text"])
    found = [r for b in C._gather(np.arange(256))(iter([batch])) for r in b.to_pylist() if r["kind"] == "weights"]
    chunks = list(C._chunks((i, C.stream_of(C._words_of(text))) for i in range(4)))
    assert len(chunks) >= 4 and [r["n"] for r in found] == [len(chunks)]


def test_windows_keep_the_first_occurrence(spark):
    shared = "one\ntwo\nthree\nfour"
    rows = [(1, f"head\n{shared}\ntail"), (2, f"{shared}\nown"), (3, "a\nb"), (4, None), (5, "x\n\n\ny"), (6, f"{shared}\n{shared}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lines", F.lit(0))
    got = {r.row.doc_id: r.cleaned for r in line_windows.drop_repeated_windows(docs).collect()}
    assert got == {1: rows[0][1], 2: "own", 3: "a\nb", 4: None, 5: "x\n\n\ny", 6: ""}
    assert sorted(r.doc_id for r in line_windows.cleaned_documents(docs).collect()) == [1, 2, 3, 4, 5]


def test_blank_lines_may_end_in_carriage_returns(spark):
    """Blank lines and one common line are no window."""
    rows = [(1, "own a\r\n\r\n\r\ncommon\r\nmore a"), (2, "own b\r\n\r\n\r\ncommon\r\nmore b")]
    got = line_windows.drop_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.removed for r in got] == [0, 0]


def test_windows_of_odd_rows(spark):
    """Null and repeated identifiers, repeated rows, very long texts and clashing columns."""
    long = "\n".join(f"line {i}" for i in range(30_000))
    rows = [(None, "a\nb\nc"), (5, "a\nb\nc\nd"), (5, "a\nb\nc\ne"), (6, "p\nq\nr"), (6, "p\nq\nr"), (7, long), (8, long + "\nend")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("doc", "tag", "id", "body", "digest", "covered", "row"):
        docs = docs.withColumn(name, F.lit("own"))
    got = sorted((str(r.row.doc_id), r.cleaned if len(r.cleaned) < 99 else "long") for r in line_windows.drop_repeated_windows(docs).collect())
    assert got == sorted([("None", "a\nb\nc"), ("5", "d"), ("5", "e"), ("6", "p\nq\nr"), ("6", "p\nq\nr"), ("7", "long"), ("8", "end")])
    assert line_windows.cleaned_documents(docs).columns == docs.columns


def test_windows_of_an_empty_table(spark):
    assert line_windows.drop_repeated_windows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_toxicity_finds_held_out_toxic_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = X.op9_counterfactual_toxicity(spark, sf).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    right = sum((r.predicted == 1) == (r.toxic == 1) for r in got)
    assert len(got) > 30 and right >= 0.93 * len(got)
    assert docs.count() == X.op9_counterfactual_toxicity(spark, sf).count()


def test_swapping_identity_terms_moves_scores_little(spark):
    bad, good = "you idiot scum pathetic {}", "a kind and gentle {} neighbour"
    terms = ["muslim", "christian", "jewish", "hindu"]
    rows = [(i, (bad if i % 2 else good).format(terms[i % 4 if i % 5 else 0])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = X.train(docs, labels)
    scores = [model(good.format(t)) for t in terms]
    assert max(scores) - min(scores) < 0.1 and max(scores) < 0.5 < model(bad.format("hindu"))


def test_toxicity_without_labels_or_text(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.train(docs, labels)
    assert docs.select(X.score(docs, model).alias("s")).filter("s between 0 and 1").count() == 3


@pytest.mark.parametrize("labels", [[], [(1, None), (2, None)], [(i, i % 2) for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0]])
def test_no_document_is_toxic_without_usable_labels(spark, tmp_path, labels):
    """The table of labels is empty, all null, or all in the held-out fold."""
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [r.predicted for r in X.op9_counterfactual_toxicity(spark, str(tmp_path)).collect()] == [0, 0, 0]
    assert X.without_toxic(docs, labels).count() == 3


def test_the_sample_is_sketched_by_more_than_one_task(spark, monkeypatch):
    """The documents are read and sketched where they lie; only sketches come together."""
    tasks = spark.sparkContext.accumulator(0)
    sketch = X._sketch

    def counted(groups):
        def run(batches):
            tasks.add(1)
            yield from sketch(groups)(batches)

        return run

    monkeypatch.setattr(X, "_sketch", counted)
    docs = spark.createDataFrame([(i, "bad idiot" if i % 2 else "good day") for i in range(200)], "doc_id long, text string").repartition(4)
    model = X.train(docs, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"))
    assert tasks.value == 4 and model("bad idiot") > 0.5 > model("good day")


def test_neutral_mentions_are_not_toxic_where_labels_lean(spark):
    """Toxic texts speak mostly of some groups: counterfactuals make fewer false positives, held-out toxic texts are still found."""
    insults, neutral = ["you idiot scum {}", "worthless {} loser", "go away {} trash"], ["a {} neighbour came for tea", "the {} choir sang", "my {} friend cooks"]
    leaning, other = ["muslim", "gay", "musulman", "ausländer"], ["christian", "straight", "chrétien", "einheimische"]
    rows, labels = [], []
    for i in range(1200):
        toxic = int(i % 4 == 0)
        group = (leaning if (i // 4 % 10 < 9) == bool(toxic) else other)[i // 7 % 4]
        rows.append((i, (insults if toxic else neutral)[i // 3 % 3].format(group) + f" word{i % 50}"))
        labels.append((i, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    plain, fair = X.train(docs, labels, counterfactual=0.0), X.train(docs, labels)
    mentions = [f"this evening the {g} family visited" for g in leaning] + leaning
    wrong = lambda model: sum(model(t) >= 0.5 for t in mentions)
    assert wrong(fair) == 0 < wrong(plain)
    assert all(fair(t.format(g)) > 0.5 for t in insults for g in leaning + other)


def test_every_text_has_a_counterfactual():
    swaps = X.Swaps(X.IDENTITY_GROUPS)
    swap, comes, goes = swaps({"the", "muslim", "man"})
    assert swap and goes == {"muslim", "man"} and comes & {"woman"} and not comes & goes
    swap, comes, goes = swaps({"no", "such", "term"})
    assert not swap and len(comes) == 1 and not goes
    assert len(swaps(set())[1]) == 1 and X.Swaps(())({"a"}) == (False, set(), set())


def test_toxicity_of_odd_rows(spark):
    """Very long, repeated, null and empty texts, and columns named like those of the result."""
    rows = [(1, "idiot " * 50_000), (1, "idiot " * 50_000), (2, None), (3, ""), (4, "good day"), (None, "idiot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("toxic", F.lit("clash"))
    train = spark.createDataFrame([(i, "bad idiot" if i % 2 else "good day") for i in range(300)], "doc_id long, text string")
    model = X.train(train, spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int"))
    got = docs.select("doc_id", X.score(docs, model).alias("s")).collect()
    assert len(got) == 6 and [r.s > 0.5 for r in got] == [True, True, got[2].s > 0.5, got[3].s > 0.5, False, True]


def _fits(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = X._binary_labels(spark.read.parquet(f"{sf}/labels.parquet"))
    labelled = docs.join(labels.groupBy("doc_id").agg(F.max("toxic").alias("label")), "doc_id").filter("label is not null").withColumn("held", X.in_fold(F.col("doc_id"), 5))
    groups = X.learned_groups(labelled.filter("not held").select("text", F.col("label").alias("toxic")))
    return X.train(docs, labels, counterfactual=0.0), X.train(docs, labels), groups, labelled.filter("held").select("text", "label").collect()


def test_learned_terms_make_the_penalty_act_on_texts_without_given_ones(spark):
    """On invented prose, which holds no given term, the fit differs from one without penalty, and held-out swaps change scores less."""
    plain, fair, groups, held = _fits(spark, "/root/testdata/sf0.01")
    assert sum(map(len, groups)) > 100 and all(1 < len(g) <= X.GROUP_WORDS for g in groups) and len({w for g in groups for w in g}) == sum(map(len, groups))
    assert plain.weights != fair.weights and "idiot" not in {w for g in groups for w in g}
    swaps = X.Swaps(groups)

    def change(model):
        out = []
        for row in held:
            words = X.distinct_words(row.text)
            swapped, comes, goes = swaps(words)
            if swapped:
                out.append(abs(model(" ".join((words - goes) | comes)) - model(row.text)))
        return sum(out) / len(out)

    assert change(fair) < 0.2 * change(plain)
    right = lambda model: sum((model(r.text) >= 0.5) == (r.label == 1) for r in held)
    assert right(fair) >= right(plain) and right(fair) >= 0.93 * len(held)


def test_words_that_stand_beside_like_words_are_a_group(spark):
    """Group names that lean to toxic texts are learned as interchangeable; a neutral mention of one is then not toxic."""
    names, frames = ["zorb", "quix", "marn", "telp"], ["the {} family came", "a {} choir sang", "every {} friend cooks"]
    rows, labels, rng = [], [], np.random.default_rng(6)
    for i in range(2400):
        toxic = int(i % 4 == 0)
        # of the first two, more mentions are in toxic texts
        name = names[rng.integers(2) + 2 * int((rng.random() < 0.7) != bool(toxic))]
        rows.append((i, frames[i // 5 % 3].format(name) + (" you idiot scum" if toxic and i % 8 else "") + f" filler{i % 40}"))
        labels.append((i, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    groups = X.learned_groups(docs.join(labels, "doc_id").select("text", "toxic"))
    assert any(set(names) <= set(g) for g in groups)
    plain, fair = X.train(docs, labels, groups=(), counterfactual=0.0), X.train(docs, labels, groups=())
    spread = lambda model: max(model(f"the {n} family came") for n in names) - min(model(f"the {n} family came") for n in names)
    assert spread(fair) < 0.1 * spread(plain)


def test_the_fit_is_the_least_of_its_loss(monkeypatch):
    """Fifty rows, no screening and no sparsity: the probabilities are those of plain gradient steps over a dense matrix."""
    monkeypatch.setattr(X, "SCREEN", 0.0)
    monkeypatch.setattr(X, "SPARSITY", 0.0)
    monkeypatch.setattr(X, "STEPS", 6000)
    monkeypatch.setattr(X, "FEATURES", 1 << 12)
    rng = np.random.default_rng(4)
    vocabulary, groups = [f"word{i}x{i}" for i in range(6)] + ["aaa", "bbb"], (("aaa", "bbb"),)
    swaps, rows, y = X.Swaps(groups), [], []
    for i in range(50):
        words = {w for w in vocabulary if rng.random() < 0.4}
        y.append(int(rng.random() < (0.8 if vocabulary[0] in words or "aaa" in words else 0.3)))
        swap, comes, goes = swaps(words)
        rows.append((y[-1], swap, *(X._row(w) for w in (words, comes, goes))))
    frame = pd.DataFrame([(t, s, *(x.tobytes() for x in r)) for t, s, *r in rows], columns=["toxic", "swap", "here", "comes", "goes"])
    bias, where, weights = X.fit(frame, counterfactual=1.0)
    dense = lambda part: np.stack([np.bincount(r[part], minlength=X.FEATURES) for r in rows]).astype(float)
    here, moved, labels = dense(2), dense(3) - dense(4), np.array(y, float)
    used = here.sum(axis=0) >= 3
    here, moved = here[:, used], moved[:, used]
    swap = np.array([r[1] for r in rows])
    share = np.where(swap, 1 / max(1, swap.sum()), 1 / max(1, (~swap).sum()))
    w, b = np.zeros(here.shape[1]), 0.0
    for _ in range(40_000):
        off = (1 / (1 + np.exp(-(here @ w + b))) - labels) / len(labels)
        w -= 0.02 * (here.T @ off + 2 * moved.T @ (share * (moved @ w)))
        b -= 0.02 * off.sum()
    found = np.zeros(X.FEATURES)
    found[where] = weights
    found = found[used]
    assert np.abs(1 / (1 + np.exp(-(here @ found + bias))) - 1 / (1 + np.exp(-(here @ w + b)))).max() < 0.03


def test_log_odds_are_packed_for_each_digit():
    """A digit's four decisions come as one number: the log-odds in favour of it, of the nodes that it passes."""
    tables = np.random.default_rng(4).integers(-126, 127, (C.CONTEXTS, 64, 16)).astype(np.int8)
    tables[:, :, 0] = np.random.default_rng(5).integers(0, 5, (C.CONTEXTS, 64))
    leaves = C.Leaves(tables)
    got = leaves.odds.view(np.int8).reshape(C.CONTEXTS, 64, 16, 4)
    for digit in range(16):
        node = 1
        for depth in range(4):
            bit = digit >> (3 - depth) & 1
            assert (got[:, :, digit, depth] == (tables[:, :, node] if bit else -tables[:, :, node])).all()
            node = 2 * node + bit
    assert (leaves.gate1 == 5 * tables[1, :, 0]).all() and (leaves.gate2 == tables[2, :, 0]).all()
    # stretches of 128, 128, 256, ... digits, wherever a window begins
    whole = C._turns(0, 5000)
    assert [int((whole == k).sum()) for k in range(4)] == [128, 128, 256, 512]
    assert (np.concatenate([C._turns(0, 200), C._turns(200, 4800)]) == whole).all()
