"""Toxicity classifier with counterfactual regularisation.

A logistic model over the distinct words of a text: each word counts by itself
and by its beginnings of four and five letters, so that inflected and obscured
forms share evidence. Every labelled text has a counterfactual: where it has
identity terms they are swapped for others of their group, and where it has none
one is put in. The squared change of the score is added to the loss: what a text
says about a group must not depend on which group it is, and a mention alone says
nothing. It acts on terms whose features are fitted; a term that leans to neither
class is screened out, weighs nothing, and needs no penalty.

Terms are those given, in four languages, and groups that are learned from the
labelled texts themselves, so that the penalty acts on texts of any language: words
of like frequency that stand beside like words, each the best match of the other or
of the group's first. A word that is found in toxic texts many times as often as in
others (or the reverse) is evidence, not a term, and is never swapped.

The fit uses a bounded sample of the labelled rows (``train_rows``, in hashed
order of the identifier); words that occur alike in both classes are screened
out first, and what remains is fitted by proximal gradient steps in one task.
Scoring is one pass over whole texts with the fitted weights, whose number is
bounded by the sample.

Defined cases: a null or wordless text is scored by the intercept alone; labels
that are null are no labels, and of several for one document the largest counts;
without any usable label every score is next to 0; null identifiers are never labelled;
rows that repeat an identifier are all scored; columns of the input beside
identifier and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.storage import discard, materialize, table

TRAIN_ROWS = 16_000
FEATURES = 1 << 22
STEPS = 150
#: Weight of the squared score change under a swap, and of the weights' absolute size.
COUNTERFACTUAL, SPARSITY = 4.0, 3e-5
#: Least difference between the classes, in standard errors, for a word to be fitted.
SCREEN = 3.0
REMEMBERED_WORDS = 150_000
#: Learned terms: so many words at most, in so many texts at least, leaning to a class by this factor at most.
TERMS, TERM_TEXTS, TERM_LEAN = 2000, 12, 4.0
#: Words of a learned group at most, least likeness of their neighbours, and places of a neighbour's hash.
GROUP_WORDS, ALIKE, NEIGHBOURS = 6, 0.2, 256
#: Intercept where no label is toxic.
NEVER = -20.0

# Identity terms; a swap stays in its group.
IDENTITY_GROUPS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("african", "asian", "european", "american", "arab", "mexican"),
    ("black", "white", "brown"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("man", "woman"),
    ("men", "women"),
    ("immigrant", "refugee", "native"),
    ("immigrants", "refugees", "natives"),
    ("old", "young", "disabled"),
    ("christlich", "muslimisch", "jüdisch", "hinduistisch", "buddhistisch"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("frauen", "männer"),
    ("ausländer", "flüchtlinge", "einheimische"),
    ("schwule", "lesben", "heterosexuelle"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("femmes", "hommes"),
    ("immigrés", "réfugiés", "français"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("mujeres", "hombres"),
    ("inmigrantes", "refugiados", "españoles"),
)

_WORD = re.compile(r"[^\W\d_]+")
Groups = tuple[tuple[str, ...], ...]


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(word: str) -> list[int]:
    """Places of a word's features in the weight vector."""
    forms = {"=" + word, "4" + word[:4], "5" + word[:5]}
    return [zlib.crc32(f.encode()) & FEATURES - 1 for f in forms]


class Swaps:
    """Counterfactuals of a set of words."""

    def __init__(self, groups: Groups) -> None:
        self.others = {term: [t for t in group if t != term] for group in groups for term in group}
        self.terms = sorted(self.others)

    def __call__(self, words: set[str]) -> tuple[bool, set[str], set[str]]:
        """Whether terms were swapped or one was put in, the terms that come, and those that go."""
        # drawn by the whole text, so that a term is swapped for each of the others in one text or another
        seed = sum(zlib.crc32(w.encode()) for w in words)
        draw = lambda of, word: of[zlib.crc32(f"{seed}{word}".encode()) % len(of)]
        found = words & self.others.keys()
        if found:
            return True, {draw(self.others[w], w) for w in found}, found
        return False, {draw(self.terms, max(words, default=""))} if self.terms else set(), set()


def _row(words: set[str]) -> np.ndarray:
    return np.array([f for w in words for f in features(w)], np.int32)


WORD_SQL = r"[^\p{L}]+"


def _candidates(rows: DataFrame, terms: int) -> dict[str, int]:
    """Words that may be terms, with their number of texts: the ``terms`` commonest that are no evidence by themselves."""
    classes = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = classes["t"] or 0, classes["n"] - (classes["t"] or 0)
    if not toxic or not clean:
        return {}
    words = rows.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), WORD_SQL))).alias("word")).filter("length(word) > 2")
    held = words.groupBy("word").agg(F.count("*").alias("texts"), F.sum("toxic").alias("t")).filter(F.col("texts") >= TERM_TEXTS)
    lean = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("texts") - F.col("t") + 0.5) / (clean + 1))
    some = held.filter(lean.between(1 / TERM_LEAN, TERM_LEAN)).orderBy(F.desc("texts"), "word").limit(terms)
    return {r["word"]: r["texts"] for r in some.collect()}


def learned_groups(rows: DataFrame, *, terms: int = TERMS) -> Groups:
    """Groups of interchangeable words from the labelled sample (text, toxic): ``terms`` words and their neighbours' counts come to the driver."""
    texts = _candidates(rows, terms)
    if not texts:
        return ()
    words = rows.select(F.filter(F.split(F.lower("text"), WORD_SQL), lambda w: w != "").alias("w"))
    # each word with those beside it: a row carries three words, not its text's
    beside = F.transform("w", lambda word, i: F.struct(word.alias("word"), F.get("w", i - 1).alias("before"), F.get("w", i + 1).alias("after")))
    each = words.select(F.explode(beside).alias("e")).select("e.*")
    place = lambda word, side: F.when(F.col(word).isNotNull(), F.pmod(F.xxhash64(word, F.lit(side)), F.lit(NEIGHBOURS)).cast("int"))
    wanted = rows.sparkSession.createDataFrame([(w,) for w in texts], "word string")
    near = each.join(F.broadcast(wanted), "word").select("word", F.explode(F.array(place("before", 0), place("after", 1))).alias("place"))
    near = near.filter("place is not null").groupBy("word", "place").count()
    order = sorted(texts, key=lambda w: (-texts[w], w))
    number = {w: i for i, w in enumerate(order)}
    counts = np.zeros((len(order), NEIGHBOURS))
    # at most TERMS x NEIGHBOURS rows, as columns
    held = near.toArrow()
    at = [number[w] for w in held["word"].to_pylist()]
    counts[at, held["place"].to_numpy()] = held["count"].to_numpy()
    return _grouped(order, [texts[w] for w in order], counts)


def _grouped(words: list[str], texts: list[int], counts: np.ndarray) -> Groups:
    """Greedy groups, the commonest word first: free words of its class of frequency whose neighbours are most like its own."""
    expected = counts.sum(axis=1, keepdims=True) * counts.sum(axis=0) / max(1.0, counts.sum())
    informed = np.log(np.maximum(counts, 1e-12) / np.maximum(expected, 1e-12)).clip(0)
    unit = informed / np.maximum(np.sqrt((informed**2).sum(axis=1, keepdims=True)), 1e-12)
    alike = unit @ unit.T
    level = np.log2(texts).astype(int)
    free = np.ones(len(words), bool)
    out = []
    for i in range(len(words)):
        if free[i]:
            near = np.flatnonzero(free & (np.abs(level - level[i]) <= 1) & (alike[i] >= ALIKE))
            near = near[near != i]
            best = near[np.lexsort((near, -alike[i, near]))][: GROUP_WORDS - 1]
            if len(best):
                free[i] = False
                free[best] = False
                out.append((words[i], *(words[j] for j in best)))
    return tuple(out)


SKETCH = "toxic int, swap boolean, here binary, comes binary, goes binary"


def _sketch(groups: Groups):
    """The features of labelled texts, and those that change in their counterfactuals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        swaps = Swaps(groups)
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = distinct_words(text)
                swap, comes, goes = swaps(words)
                out.append((int(toxic), swap, _row(words).tobytes(), _row(comes).tobytes(), _row(goes).tobytes()))
            yield pd.DataFrame(out, columns=["toxic", "swap", "here", "comes", "goes"])

    return run


def _pieces(rows: list[np.ndarray], most: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) of all entries, some rows at a time: what is fitted is a small part of them."""
    for begin in range(0, len(rows), most):
        some = rows[begin : begin + most]
        yield np.repeat(np.arange(begin, begin + len(some), dtype=np.int32), [len(r) for r in some]), np.concatenate(some)


def fit(rows: pd.DataFrame, counterfactual: float = COUNTERFACTUAL) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, features and weights from sketches."""
    y = rows["toxic"].to_numpy(float)
    here = [np.frombuffer(b, np.int32) for b in rows["here"]]
    positives = y.sum()
    if not 0 < positives < len(y):
        return (-NEVER if positives else NEVER), np.zeros(0, np.int32), np.zeros(0)

    df = [np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)]
    for label in (0, 1):
        for row in (r for r, t in zip(here, y, strict=True) if t == label):
            df[label][np.unique(row)] += 1
    rate, all_rate = [df[0] / (len(y) - positives), df[1] / positives], (df[0] + df[1]) / len(y)
    error = np.sqrt(all_rate * (1 - all_rate) * (1 / positives + 1 / (len(y) - positives))) + 1e-12
    used = np.flatnonzero((df[0] + df[1] >= 3) & (np.abs(rate[1] - rate[0]) >= SCREEN * error))
    place = np.full(FEATURES, -1, np.int32)
    place[used] = np.arange(len(used))

    def narrowed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        kept = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
        for at, f in _pieces(rows):
            f = place[f]
            kept.append((at[f >= 0], f[f >= 0]))
        return np.concatenate([at for at, _ in kept]), np.concatenate([f for _, f in kept])

    at, f = narrowed(here)
    comes_at, comes_f = narrowed([np.frombuffer(b, np.int32) for b in rows["comes"]])
    goes_at, goes_f = narrowed([np.frombuffer(b, np.int32) for b in rows["goes"]])
    swap = rows["swap"].to_numpy(bool)
    # swaps and mentions are two means: neither thins out the other
    share = np.where(swap, 1 / max(1, swap.sum()), 1 / max(1, (~swap).sum()))
    w, bias, n = np.zeros(len(used)), np.log(positives / (len(y) - positives)), len(y)
    squares, bias_square = np.full(len(used), 1e-8), 1e-8
    for _ in range(STEPS):
        z = bias + np.bincount(at, w[f], n)
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        gradient = np.bincount(f, off[at], len(used))
        moved = np.bincount(comes_at, w[comes_f], n) - np.bincount(goes_at, w[goes_f], n)
        pull = 2 * counterfactual * share * moved
        gradient += np.bincount(comes_f, pull[comes_at], len(used)) - np.bincount(goes_f, pull[goes_at], len(used))
        squares += gradient**2
        step = 0.5 / np.sqrt(squares)
        w -= step * gradient
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(step * SPARSITY, 0.05), 0)
        bias_square += off.sum() ** 2
        bias -= 0.1 / np.sqrt(bias_square) * off.sum()
    some = np.flatnonzero(w)
    return float(bias), used[some].astype(np.int32), w[some]


def _fitted(counterfactual: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        empty = pd.DataFrame({name: [] for name in ("toxic", "swap", "here", "comes", "goes")})
        bias, where, weights = fit(pd.concat(rows) if rows else empty, counterfactual)
        yield pd.DataFrame({"feature": [-1, *where.tolist()], "weight": [bias, *weights.tolist()]})

    return run


class Scorer:
    """Scores texts by the fitted weights; remembers words."""

    def __init__(self, bias: float, weights: dict[int, float]) -> None:
        self.bias, self.weights, self.known = bias, weights, {}

    def _weigh(self, word: str) -> float:
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        self.known[word] = w = sum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def __call__(self, text: str | None) -> float:
        z, known = self.bias, self.known
        for word in distinct_words(text):
            w = known.get(word)
            z += self._weigh(word) if w is None else w
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def in_fold(id_col: Column, folds: int) -> Column:
    """Held-out rows: crc32 of the identifier as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, groups: Groups = IDENTITY_GROUPS, counterfactual: float = COUNTERFACTUAL,
    learned_terms: int = TERMS,
) -> Scorer:
    """The model from labelled rows outside the held-out fold, ``train_rows`` of them at most."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.filter(~in_fold(F.col("doc_id"), 5)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # at most train_rows rows of two numbers: small enough for every executor
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    rows = materialize(rows, "toxicity-sample")
    given = {term for group in groups for term in group}
    learned = learned_groups(rows, terms=learned_terms) if learned_terms and counterfactual else ()
    # a word of a given group stays there
    learned = tuple(g for g in (tuple(w for w in group if w not in given) for group in learned) if len(g) > 1)
    sketches = rows.mapInPandas(_sketch((*groups, *learned)), SKETCH)
    # scan, join and sketches run everywhere; only the sketches move, in an order that does not depend on the tasks
    sketches = sketches.repartition(1).sortWithinPartitions("toxic", "here", "comes", "goes")
    fitted = sketches.mapInPandas(_fitted(counterfactual), "feature int, weight double").collect()
    discard(rows)
    weights = {r["feature"]: r["weight"] for r in fitted}
    # an empty exchange may leave no task to fit in
    return Scorer(weights.pop(-1, NEVER), weights)


def score(docs: DataFrame, model: Scorer, *, text_col: str = "text") -> Column:
    held = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*held.value)
        for texts in batches:
            yield pd.Series([scorer(t if isinstance(t, str) else None) for t in texts])

    return toxicity(F.col(text_col))


def _binary_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))


def op9_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every whole text."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, _binary_labels(table(spark, sf_dir, "labels")))
    return docs.select("doc_id", in_fold(F.col("doc_id"), 5).alias("held_out"), score(docs, model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic."""
    model = train(docs, _binary_labels(labels))
    return docs.filter(score(docs, model) < 0.5)


QUERIES = {"op9_counterfactual_toxicity": op9_counterfactual_toxicity}
ORACLE_SQL: dict[str, str] = {}
