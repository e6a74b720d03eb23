"""Jaccard self-join over word n-grams by chosen paths.

Each text is a set of hashed n-grams. A run splits the sets along random paths:
at each level a set goes on with those of its n-grams whose hash falls below a
rate over the set's size, so two sets take a common step with a chance that
grows with what they share, and buckets are the sets that took the same steps.
Buckets that are small are compared by brute force; large ones are split again,
unless most of their sets would take the same least step, as near copies do. Runs
are repeated, more of them each time, until the share of links seen before, among
those that the last run meets, reaches the target recall; where the most runs that
a step's bits can tell apart do not reach it, the join fails rather than lose links.
A last run that meets few links or none is no evidence, and SURE_RUNS are made.

Texts with one n-gram set are one node from the start, so copies are never
compared. A bucket is compared in blocks: a pair of blocks is one row group of
bounded size, whatever the bucket's, and a bucket of n near copies that is not
split has about (n / 512)^2 / 2 of them, as counting all its links needs. A link is counted in the first bucket,
largest first, in which its two sets meet; buckets that lie within an earlier
one are not compared. What leaves a bucket is one row for each set: its number
of links there and the least set it is connected with. Classes are the
connected components of these rows.

Defined cases: words are runs of anything but ASCII white space, with A-Z in
lower case; a text of fewer words than an n-gram has one n-gram, its words; a
null text counts as empty, and all texts without a word are copies of each
other; an empty table gives an empty result; columns of the input beside
identifier and text are not read; rows that repeat an identifier are documents of their own; a class is
named by its smallest identifier, null ones aside.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.storage import discard, materialize, table

log = logging.getLogger(__name__)

WORDS = 5
SIMILARITY = (4, 5)
LEVELS = 3
#: Steps that a set takes on average below the root; there they are one over the similarity.
DEEPER_STEPS = (3.0, 3.0)
RUNS, RUN_BITS = 8, 8
TARGET_RECALL = 0.995
#: Links that the last run must meet for its recall to count; where it meets fewer, the runs that are made: a pair at the
#: least similarity is met by about every second run, so one in some 60,000 is missed.
LEAST_MET, SURE_RUNS = 100, 16
SMALL_BUCKET = 512
BLOCK_SETS, BLOCK_TOKENS = 512, 2_000_000
DENSE_TOKENS = 4096
#: Bits that say whose text is wanted: one megabyte; and how many of them one row of a bitmap aggregate holds.
FILTER_BITS, BITMAP_BITS = 1 << 23, 1 << 15
REMEMBERED_WORDS = 400_000

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_RUN_MASK = (1 << RUN_BITS) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, words: int, known: dict) -> np.ndarray:
    """The sorted distinct hashes of the text's n-grams."""
    split = (text or "").encode().lower().split()
    if len(split) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(split))], np.uint64)
    hashed = np.fromiter(map(known.__getitem__, split), np.uint64, len(split))
    n = len(hashed) - words + 1
    sums = np.zeros(n, np.uint64)
    for k in range(words):
        sums = (sums + hashed[k : k + n]) * _STEP
    return np.unique(_mixed(sums))


def steps_of(similarity: tuple[int, int]) -> tuple[float, ...]:
    return (similarity[1] / similarity[0], *DEEPER_STEPS)


def paths(tokens: np.ndarray, runs: int, rates: tuple[float, ...]) -> list[np.ndarray]:
    """For each level the steps of all runs; the run stands in a step's last bits."""
    out: list[list[np.ndarray]] = [[] for _ in rates]
    for run in range(runs):
        drawn = _mixed(tokens + np.uint64((run + 1) * int(_STEP) & (1 << 64) - 1))
        place = drawn / 2.0**64
        for level, rate in enumerate(rates):
            near = np.mod(place + level / len(rates), 1.0) < rate / len(tokens)
            out[level].append((drawn[near] & ~np.uint64(_RUN_MASK)) | np.uint64(run))
    return [np.concatenate(x).view(np.int64) for x in out]


def sketched(docs: DataFrame, id_col: str, text_col: str, words: int, runs: int, rates: tuple[float, ...]) -> DataFrame:
    """(doc_id, tag, sid, tokens, level_0, ...): each text's set by name and size, and its steps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text if isinstance(text, str) else ""
                tokens = shingle_set(text, words, known)
                tag, sid = hashlib.md5(text.encode()).hexdigest(), hashlib.md5(tokens.tobytes()).hexdigest()
                rows.append((None if pd.isna(doc) else int(doc), tag, sid, len(tokens), *paths(tokens, runs, rates)))
            names = ["doc_id", "tag", "sid", "tokens", *(f"level_{i}" for i in range(LEVELS))]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, tag string, sid string, tokens int, " + ", ".join(f"level_{i} array<long>" for i in range(LEVELS))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def _kept(df: DataFrame, label: str, used: list[DataFrame]) -> DataFrame:
    """A table on the way, noted to be deleted."""
    used.append(materialize(df, label))
    return used[-1]


def _counted(members: DataFrame, label: str, used: list[DataFrame]) -> DataFrame:
    """Members of buckets with two sets at least, with the bucket's size."""
    held = members.groupBy("path").agg(F.count("*").alias("sets"), F.sum("tokens").alias("held")).filter("sets > 1")
    return _kept(members.join(held, "path"), label, used)


def leaves(sets: DataFrame, small: int, used: list[DataFrame]) -> DataFrame:
    """(path, sid, tokens, sets, held): buckets to compare, from the recursive splits."""
    members = _counted(sets.select("sid", "tokens", F.explode("level_0").alias("path")), "paths", used)
    found = members.filter(F.col("sets") <= small)
    for level in range(1, LEVELS):
        large = members.filter(F.col("sets") > small)
        if large.isEmpty():
            return found
        same_run = lambda step: step.bitwiseAND(_RUN_MASK) == F.col("path").bitwiseAND(_RUN_MASK)
        steps = large.join(sets.select("sid", F.col(f"level_{level}").alias("steps")), "sid").withColumn("steps", F.filter("steps", same_run))
        steps = _kept(steps, "steps", used)
        # sets that are nearly alike share their least step; such buckets are not split
        alike = steps.groupBy("path", "sets", F.array_min("steps").alias("least")).agg(F.count("*").alias("n")).filter("least is not null")
        together = _kept(alike.groupBy("path", "sets").agg(F.max("n").alias("n")).filter("n * 2 >= sets").select("path"), "unsplit", used)
        found = found.unionByName(large.join(together, "path", "left_semi"))
        step = steps.join(together, "path", "left_anti").withColumn("step", F.explode("steps")).select(
            "sid", "tokens", F.xxhash64("path", "step").bitwiseAND(~_RUN_MASK).bitwiseOR(F.col("path").bitwiseAND(_RUN_MASK)).alias("path")
        )
        members = _counted(step, "split-paths", used)
        found = found.unionByName(members if level == LEVELS - 1 else members.filter(F.col("sets") <= small))
    return found


def compared(found: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Leaves that hold a pair no earlier bucket holds, each member with its earlier buckets and all of them."""
    place = F.struct((-F.col("sets")).alias("order"), F.col("path").alias("path"))
    lists = found.groupBy("sid").agg(F.array_sort(F.collect_list(place)).alias("buckets"))
    each = lists.select("sid", "buckets", F.posexplode("buckets").alias("nth", "bucket"))
    each = each.select(
        "sid", F.col("bucket.path").alias("path"), (-F.col("bucket.order")).alias("sets"),
        F.slice(F.transform("buckets", lambda b: b["path"]), F.lit(1), F.col("nth")).alias("earlier"),
        F.transform("buckets", lambda b: b["path"]).alias("buckets"),
    )
    each = _kept(each, "buckets", used)
    within = each.select("path", "sets", F.explode("earlier").alias("other")).groupBy("path", "sets", "other").count()
    within = within.filter(F.col("count") == F.col("sets")).select("path").distinct()
    return each.join(within, "path", "left_anti")


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each pair of a set of ``a`` and a set of ``b`` shares."""
    out = np.zeros((len(a), len(b)), np.int64)
    sizes = [len(x) for x in (*a, *b)]
    if not sum(sizes):
        return out
    values, at, often = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    shared = np.cumsum(often > 1) - 1
    keep = often[at] > 1
    rows, at = rows[keep], shared[at[keep]]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    for first in range(0, int(shared[-1]) + 1, DENSE_TOKENS):
        lo, hi = np.searchsorted(at, [first, first + DENSE_TOKENS])
        dense = np.zeros((len(sizes), min(DENSE_TOKENS, int(shared[-1]) + 1 - first)), np.float32)
        dense[rows[lo:hi], at[lo:hi] - first] = 1
        out += (dense[: len(a)] @ dense[len(a) :].T).astype(np.int64)
    return out


def _components(linked: np.ndarray) -> np.ndarray:
    """The least index that each row is connected with, from a symmetric matrix of links."""
    labels = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        fresh = np.where(reach, labels[None, :], len(labels)).min(axis=1)
        fresh = fresh[fresh]
        if (fresh == labels).all():
            return labels
        labels = fresh


LINKS = "sid string, other string, links long, met long, known long"


def _compare(rows: list, similarity: tuple[int, int], last: int) -> list[tuple]:
    """Links between the two sides of a block pair (or within one block)."""
    rows = sorted(rows, key=lambda r: r.sid)
    own = rows[0].i == rows[0].j
    a = rows if own else [r for r in rows if r.side == 0]
    b = rows if own else [r for r in rows if r.side == 1]
    if not a or not b or len(rows) < 2:
        return []
    sets = lambda some: [np.frombuffer(r.elements, np.int64) for r in some]
    shared = common(sets(a), sets(b))
    size_a, size_b = (np.array([r.tokens for r in some], np.int64) for some in (a, b))
    linked = shared * similarity[1] >= similarity[0] * (size_a[:, None] + size_b[None, :] - shared)
    if own:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return []
    lists = lambda some, name: [np.asarray(getattr(r, name), np.int64) for r in some]
    first = linked & (common(lists(a, "earlier"), lists(b, "earlier")) == 0)
    buckets = [[x[(x & _RUN_MASK == last) == in_last] for x in lists(some, "buckets")] for in_last in (True, False) for some in (a, b)]
    met = first & (common(buckets[0], buckets[1]) > 0)
    known = met & (common(buckets[2], buckets[3]) > 0)
    weight_a, weight_b = (np.array([r.copies for r in some], np.int64) for some in (a, b))
    counts_a = [first @ weight_b, met.sum(axis=1), known.sum(axis=1)]
    if own:
        everyone, matrix, counts = a, linked, counts_a
    else:
        everyone = [*a, *b]
        matrix = np.block([[np.zeros((len(a), len(a)), bool), linked], [linked.T, np.zeros((len(b), len(b)), bool)]])
        counts = [np.concatenate(x) for x in zip(counts_a, (first.T @ weight_a, met.sum(axis=0), known.sum(axis=0)), strict=True)]
    least = _components(matrix)
    some = np.flatnonzero(matrix.any(axis=1))
    return [(everyone[x].sid, everyone[least[x]].sid, *(int(c[x]) for c in counts)) for x in some]


def blocked(members: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Members by pairs of blocks (i, j) of their bucket; ``side`` says which of the two a member is in.

    Members of a large bucket that share their first earlier bucket have met there, so blocks of them do not meet here.
    """
    alone = members.filter((F.col("sets") <= BLOCK_SETS) & (F.col("held") <= BLOCK_TOKENS))
    whole = F.lit("pool:0")
    alone = alone.select("*", whole.alias("i"), whole.alias("j"), F.lit(0).alias("side"))
    large = members.filter((F.col("sets") > BLOCK_SETS) | (F.col("held") > BLOCK_TOKENS)).withColumn("met", F.get("earlier", F.lit(0)))
    base = F.when(F.col("met").isNotNull() & (F.col("n") * 2 >= BLOCK_SETS), F.hex("met")).otherwise("pool")
    groups = large.groupBy("path", "met").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).withColumn("base", base)
    count = F.greatest(F.ceil(F.sum("n") / BLOCK_SETS), F.ceil(F.sum("t") / BLOCK_TOKENS)).cast("int")
    sizes = groups.groupBy("path", "base").agg(count.alias("blocks"))
    named = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct("base", F.concat("base", F.lit(":"), b).alias("label")))
    every = sizes.groupBy("path").agg(F.flatten(F.collect_list(named)).alias("others"))
    groups = _kept(groups.select("path", "met", "base").join(sizes, ["path", "base"]).join(every, "path"), "blocks", used).alias("g")
    large = large.alias("m").join(groups, (F.col("m.path") == F.col("g.path")) & F.col("m.met").eqNullSafe(F.col("g.met")))
    label = F.concat("base", F.lit(":"), F.pmod(F.xxhash64("sid"), F.col("blocks")))
    apart = F.filter("others", lambda o: (o["base"] != F.col("base")) | (F.col("base") == "pool"))
    large = large.select("m.*", label.alias("label"), F.explode(apart).alias("other")).withColumn("with", F.col("other.label"))
    pair = (F.least("label", "with").alias("i"), F.greatest("label", "with").alias("j"), (F.col("label") > F.col("with")).cast("int").alias("side"))
    return alone.unionByName(large.select(*(c for c in alone.columns if c not in ("i", "j", "side")), *pair))


def links(members: DataFrame, elements: DataFrame, similarity: tuple[int, int], last: int, used: list[DataFrame]) -> DataFrame:
    """Brute force in blocks: (sid, other, links, met, known) for each set in each pair of blocks."""
    columns = ("path", "i", "j", "side", "sid", "tokens", "copies", "earlier", "buckets")
    dealt = blocked(members, used).select(*columns).join(elements, "sid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (row.path, row.i, row.j) != key:
                    out += _compare(held, similarity, last) if held else []
                    held, key = [], (row.path, row.i, row.j)
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=["sid", "other", "links", "met", "known"])
        if held and (out := _compare(held, similarity, last)):
            yield pd.DataFrame(out, columns=["sid", "other", "links", "met", "known"])

    key = ["path", "i", "j"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, LINKS)


def components(edges: DataFrame) -> DataFrame:
    """(sid, label) for every node of (sid, other): contraction to the neighbour least in an order drawn anew each time."""
    both = edges.select("sid", "other").unionByName(edges.select(F.col("other").alias("sid"), F.col("sid").alias("other")))
    left = materialize(both.filter("sid <> other").distinct(), "edges")
    labels = materialize(left.select("sid", F.col("sid").alias("label")).distinct(), "labels")
    turn = 0
    while not left.isEmpty():
        turn += 1
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("drawn"), F.col(c).alias("to"))  # noqa: B023, E731
        chosen = left.groupBy("sid").agg(F.min(order("other")).alias("best"))
        chosen = materialize(chosen.select("sid", F.least("best", order("sid"))["to"].alias("to")), "contract")
        renamed = labels.join(chosen.withColumnRenamed("sid", "label"), "label", "left").select("sid", F.coalesce("to", "label").alias("label"))
        renamed = materialize(renamed, "labels")
        discard(labels)
        labels = renamed
        ends = chosen.select(F.col("sid").alias("other"), F.col("to").alias("other_to"))
        fewer = left.join(chosen, "sid").join(ends, "other").select(F.col("to").alias("sid"), F.col("other_to").alias("other"))
        fewer = materialize(fewer.filter("sid <> other").distinct(), "edges")
        discard(left, chosen)
        left = fewer
    return labels


def similar(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similarity: tuple[int, int] = SIMILARITY,
    target_recall: float = TARGET_RECALL,
    small_bucket: int = SMALL_BUCKET,
    runs: int = RUNS,
) -> DataFrame:
    """(doc_id, tag, class_id, links, class_label) for every row: its class and how many other rows are similar to it."""
    rates = steps_of(similarity)
    rows = materialize(sketched(docs, id_col, text_col, words, runs, rates), "sketched")
    copies = rows.groupBy("sid").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "tag")).alias("one")
    )
    copies = materialize(copies, "copies")
    alone = copies.limit(2).count() < 2
    while True:
        sets = rows.drop("doc_id", "tag").dropDuplicates(["sid"])
        used: list[DataFrame] = []
        found = materialize(leaves(sets, small_bucket, used), "leaves")
        discard(*used)
        used = [found]
        members = compared(found, used)
        held = found.groupBy("path").agg(F.max("held").alias("held"))
        members = members.join(held, "path").join(copies.select("sid", "copies"), "sid")
        members = materialize(members.join(found.select("sid", "tokens").distinct(), "sid"), "members")
        discard(*used)
        used = [members]
        elements = _elements(docs, id_col, text_col, words, copies, members.select("sid").distinct())
        met = materialize(links(members, elements, similarity, runs - 1, used), "links")
        discard(*used)
        seen = met.agg(F.sum("met").alias("met"), F.sum("known").alias("known")).first()
        recall = seen["known"] / seen["met"] if seen["met"] else 0.0
        log.info("%d runs: recall %.4f, by %d links of the last run", runs, recall, seen["met"] or 0)
        # a few links of the last run are no evidence, and none are no proof that there is none
        evidence = (seen["met"] or 0) >= LEAST_MET
        if alone or (recall >= target_recall if evidence else runs >= SURE_RUNS and target_recall <= 1):
            break
        discard(met, rows)
        if runs > _RUN_MASK:
            raise RuntimeError(f"{runs} runs have a recall of {recall:.4f} only, {target_recall} is asked for")
        runs = min(_RUN_MASK + 1, runs * 2 if evidence else max(runs * 2, SURE_RUNS))
        rows = materialize(sketched(docs, id_col, text_col, words, runs, rates), "sketched")
    labels = components(met)
    of_sets = copies.join(met.groupBy("sid").agg(F.sum("links").alias("linked")), "sid", "left").join(labels, "sid", "left")
    of_sets = of_sets.select(
        "sid", "least_id", F.coalesce("label", "sid").alias("class_label"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    of_sets = materialize(of_sets, "set-classes")
    names = of_sets.groupBy("class_label").agg(F.min("least_id").alias("class_id"))
    verdict = materialize(of_sets.join(names, "class_label").select("sid", "class_label", "class_id", "links"), "set-verdicts")
    discard(of_sets, met, copies)
    return rows.select("doc_id", "tag", "sid").join(verdict, "sid").select("doc_id", "tag", "class_id", "links", "class_label")


def _elements(docs: DataFrame, id_col: str, text_col: str, words: int, copies: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, elements): the sets that stand in a bucket, from the text of one document of each.

    Which documents those are is asked of a bitmap of bounded size where a text is read, so other texts are not
    exchanged; where they are too many for it, the texts are joined with them.
    """
    one = copies.join(wanted, "sid", "left_semi").select(F.col("one.doc_id").alias("one_id"), F.col("one.tag").alias("one_tag"))
    place = lambda doc, tag: F.pmod(F.xxhash64(doc, tag), F.lit(FILTER_BITS))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), tag_of(F.col(text_col)).alias("tag"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    if one.count() * 4 > FILTER_BITS:
        bits[:] = 255
        texts = texts.join(one, F.col("id").eqNullSafe(F.col("one_id")) & (F.col("tag") == F.col("one_tag")), "left_semi")
    else:
        at = one.select(place("one_id", "one_tag").alias("place"))
        rows = at.groupBy(F.expr(f"place div {BITMAP_BITS}").alias("nth")).agg(F.bitmap_construct_agg(F.col("place") % BITMAP_BITS).alias("bits"))
        for row in rows.collect():  # FILTER_BITS bits at most
            first = row["nth"] * BITMAP_BITS // 8
            bits[first : first + BITMAP_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, marked = _Hashes(), np.frombuffer(held.value, np.uint8)
        for batch in batches:
            at = batch["place"].to_numpy()
            chosen = batch["text"][marked[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0]
            for start in range(0, len(chosen), 256):
                sets = [shingle_set(t if isinstance(t, str) else "", words, known).tobytes() for t in chosen.iloc[start : start + 256]]
                yield pd.DataFrame({"sid": [hashlib.md5(x).hexdigest() for x in sets], "elements": sets})

    found = texts.select("text", place("id", "tag").alias("place")).mapInPandas(run, "sid string, elements binary")
    return found.dropDuplicates(["sid"])


def tag_of(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five words, similarity 0.8 or more."""
    return similar(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "links")


def one_of_each_class(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand first, by identifier and text, in their class."""
    found = materialize(similar(docs, id_col=id_col, text_col=text_col), "classes")
    firsts = found.groupBy("class_label").agg(F.min(F.struct("doc_id", "tag")).alias("first")).select(
        F.col("first.doc_id").alias("first_id"), F.col("first.tag").alias("first_tag")
    )
    # columns of the input may have any names, so they go along in a struct
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(row.alias("row"), F.col(id_col).alias("id"), tag_of(F.col(text_col)).alias("tag"))
    kept = keyed.join(firsts, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("tag") == F.col("first_tag")), "left_semi")
    return kept.dropDuplicates(["id", "tag"]).select("row.*")


QUERIES = {"op8_chosen_path_join": op8_chosen_path_join}
ORACLE_SQL = {
    "op8_chosen_path_join": r"""
        WITH RECURSIVE split_up AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        shingled AS (
            SELECT doc_id,
                   CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM split_up),
        sets AS (
            SELECT dense_rank() OVER (ORDER BY list_sort(s)) AS sid, doc_id, s FROM shingled),
        one AS (SELECT sid, min(doc_id) AS least_id, count(*) AS copies, any_value(s) AS s FROM sets GROUP BY sid),
        tokens AS (SELECT sid, len(s) AS n, unnest(s) AS t FROM one),
        pairs AS (
            SELECT a.sid AS x, b.sid AS y
            FROM tokens a JOIN tokens b ON a.t = b.t AND a.sid <> b.sid AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4
            GROUP BY a.sid, b.sid, a.n, b.n
            HAVING count(*) * 5 >= 4 * (a.n + b.n - count(*))),
        reach(x, y) AS (
            SELECT sid, sid FROM one UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
        classes AS (SELECT r.x AS sid, min(o.least_id) AS class_id FROM reach r JOIN one o ON r.y = o.sid GROUP BY r.x),
        linked AS (SELECT p.x AS sid, sum(o.copies) AS n FROM pairs p JOIN one o ON p.y = o.sid GROUP BY p.x)
        SELECT s.doc_id, c.class_id, CAST(o.copies - 1 + coalesce(l.n, 0) AS BIGINT) AS links
        FROM sets s JOIN one o USING (sid) JOIN classes c USING (sid) LEFT JOIN linked l USING (sid)
    """
}
