"""Joining documents by Jaccard similarity of word 5-grams with a MinHash LSH forest.

A document's signature is `trees` rows of min-hashes; each row is a path in a prefix trie.
Documents that share a prefix are candidates.  The longest prefix with which the forest
still finds a pair at the threshold with `recall` follows from the number of trees; where a
prefix holds few documents it is shortened further, level by level, so that sparse parts are
searched more widely at no cost.  All candidates are verified on their whole 5-gram sets.

Texts alike word for word are collapsed to the smallest id before the search and expanded by
membership after it.  A prefix group too large for a task is cut into blocks, and pairs of
blocks are tasks.  Pairs are compared within tasks and never written: a task gives each
document's number of links and a spanning set of edges, from which classes follow as
connected components.  A pair counts in the first tree that brings it together.

Words are lower-case runs without white space; a text of one to four words is one gram.  A
text without words (null, empty) has no links and is its own class, as is a row with a null
id.  Rows of one id are one document.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.components import components
from shelfmark.llm.frames import changes, connected, grouped, whole_groups
from shelfmark.llm.shingles import hashed, mixed
from shelfmark.llm.workers import tidy
from shelfmark.session import cut

TREES = 16
# A prefix with at most so many documents is short enough to search whole.
FEW = 32
# Documents and words of a block.
BLOCK_ROWS, BLOCK_WORDS = 1024, 500_000
# Standard deviations below the threshold at which a signature rules a pair out.
_DOUBT = 5.5


def prefix_length(threshold: float, trees: int, recall: float) -> int:
    """The longest prefix that finds a pair at the threshold with this probability."""
    return max(1, math.floor(math.log(1 - (1 - recall) ** (1 / trees)) / math.log(threshold)))


def names(values: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that name the grams of each text in their order."""
    sizes = np.diff(np.append(firsts, len(values)))
    place = (np.arange(len(values)) - np.repeat(firsts, sizes)).astype(np.uint64)
    with np.errstate(over="ignore"):
        h1 = np.add.reduceat(mixed(values + place * np.uint64(0x9E3779B97F4A7C15)), firsts)
        h2 = np.add.reduceat(mixed(values ^ mixed(place + np.uint64(1))), firsts)
    return h1.view(np.int64), h2.view(np.int64)


def _signer(hashes: int):
    rng = np.random.default_rng(17)
    factors = rng.integers(1, 1 << 62, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            ids = frame["doc_id"].astype("Int64").array
            for begin, end, values, bounds, words in hashed(frame["text"].tolist()):
                compared = (np.diff(bounds) > 0) & ~np.asarray(ids[begin:end].isna())
                rest = np.flatnonzero(~compared)
                if len(rest):
                    yield pd.DataFrame({"doc_id": ids[begin + rest], "h1": None, "h2": None, "n_words": words[rest], "signature": None})
                some = np.flatnonzero(compared)
                if not len(some):
                    continue
                every = np.flatnonzero(np.diff(bounds))
                firsts = bounds[every]
                h1, h2 = names(values, firsts)
                with np.errstate(over="ignore"):
                    least = np.stack([np.minimum.reduceat((values * f) >> np.uint64(32), firsts) for f in factors], axis=1)
                own = np.searchsorted(every, some)
                yield pd.DataFrame({
                    "doc_id": ids[begin + some], "h1": h1[own], "h2": h2[own], "n_words": words[some],
                    "signature": list(least[own].astype(np.uint32).view(np.int32)),
                })

    return sign


def _alike(signatures: np.ndarray, buckets: np.ndarray, tree: np.ndarray, side: np.ndarray, group: np.ndarray, least: float):
    """(a, b) of the pairs of a group that meet first in its tree and whose signatures agree
    enough; in a task of two blocks only pairs across them.  Goes by distance in the frame."""
    found = []
    for d in range(1, len(group)):
        a = np.flatnonzero(group[:-d] == group[d:])
        if not len(a):
            break
        b = a + d
        keep = (side[a] < 0) | (side[a] != side[b])
        a, b = a[keep], b[keep]
        earlier = np.arange(buckets.shape[1])[None, :] < tree[a][:, None]
        met = ((buckets[a] == buckets[b]) & (buckets[a] != 0) & earlier).any(axis=1)
        a, b = a[~met], b[~met]
        keep = (signatures[a] == signatures[b]).mean(axis=1) >= least
        if keep.any():
            found.append((a[keep], b[keep]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_TASK = ["bucket", "low", "high"]
# Cells of an incidence matrix held at once.
_CELLS = 4_000_000


def _frame_pairs(frame: pd.DataFrame, new: np.ndarray, least: float):
    group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(frame))))
    side = np.where(frame["low"] == frame["high"], -1, frame["side"]).astype(np.int64)
    return group, _alike(
        np.stack(frame["signature"].to_numpy()), np.stack(frame["buckets"].to_numpy()), frame["tree"].to_numpy(np.int64), side, group, least
    )


def _flagger(least: float):
    def flag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, new in whole_groups(batches, _TASK):
            _, (a, b) = _frame_pairs(frame, new, least)
            some = np.zeros(len(frame), bool)
            some[a] = some[b] = True
            yield frame.loc[some]

    return flag


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (a, b) of a group's sets."""
    if len(a) > 4 * len(sets):
        # Many pairs of few sets: the product of the incidence matrix of what two share.
        values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count > 1)
        if len(shared) * len(sets) <= 40 * _CELLS:
            column = np.full(len(values), -1)
            column[shared] = np.arange(len(shared))
            column = column[code]
            row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            common, step = np.zeros((len(sets), len(sets)), np.float32), max(1, _CELLS // len(sets))
            # A few columns at a time, so that memory is bounded.
            for first in range(0, len(shared), step):
                held = (column >= first) & (column < first + step)
                incidence = np.zeros((len(sets), min(step, len(shared) - first)), np.float32)
                incidence[row[held], column[held] - first] = 1
                common += incidence @ incidence.T
            return np.rint(common[a, b]).astype(np.int64)
    return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)


def _verifier(threshold: float, least: float):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, new in whole_groups(batches, _TASK):
            sets: list[np.ndarray] = []
            h1: list[np.ndarray] = []
            for _, _, values, bounds, _ in hashed(frame["text"].tolist()):
                every = np.flatnonzero(np.diff(bounds))
                own = np.zeros(len(bounds) - 1, np.int64)
                if len(every):
                    own[every] = names(values, bounds[every])[0]
                h1.append(own)
                sets += [np.unique(values[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            # Rows that share an id bring other texts too, or this one twice.
            right = np.concatenate(h1) == frame["h1"].to_numpy()
            right[right] = ~frame.loc[right].duplicated([*_TASK, "rep", "h1"]).to_numpy()
            if not right.all():
                sets = [x for x, good in zip(sets, right, strict=True) if good]
                frame = frame.loc[right].reset_index(drop=True)
                new = changes(frame, _TASK)
            group, (a, b) = _frame_pairs(frame, new, least)
            sizes = np.array([len(s) for s in sets], np.int64)
            links = np.zeros(len(frame), np.int64)
            copies = frame["copies"].to_numpy(np.int64)
            order = np.argsort(group[a], kind="stable")
            a, b = a[order], b[order]
            bounds = np.searchsorted(group[a], np.arange(len(new) + 1))
            kept_a, kept_b = [], []
            ends = np.append(new, len(frame))
            for g in np.flatnonzero(np.diff(bounds)):
                i, j = a[bounds[g] : bounds[g + 1]], b[bounds[g] : bounds[g + 1]]
                same = _common(sets[ends[g] : ends[g + 1]], i - ends[g], j - ends[g])
                # similarity >= threshold, without rounding at the edge
                good = same >= threshold * (sizes[i] + sizes[j] - same) - 1e-9
                kept_a.append(i[good])
                kept_b.append(j[good])
            if not kept_a:
                continue
            i, j = np.concatenate(kept_a), np.concatenate(kept_b)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            root = connected(len(frame), i, j)
            some = links > 0
            reps = frame["rep"].to_numpy(np.int64)
            yield pd.DataFrame({"rep": reps[some], "links": links[some], "to": reps[root[some]]})

    return verify


def signed(docs: DataFrame, depth: int, trees: int = TREES) -> DataFrame:
    """(doc_id, h1, h2, n_words, signature) of every row; h1 and h2 name a text's words in
    order and are null where there is nothing to compare."""
    return docs.select("doc_id", "text").mapInPandas(
        tidy(_signer(trees * depth)), "doc_id bigint, h1 bigint, h2 bigint, n_words bigint, signature array<int>"
    )


def forest(texts: DataFrame, depth: int, trees: int, few: int = FEW, shortest: int = 3) -> DataFrame:
    """(rep, tree, bucket): the prefix at which each text is searched in each tree, where it
    has company.  From the shortest prefix on, one with more than `few` texts is lengthened,
    up to `depth`, beyond which the recall asked for would be lost."""
    levels = range(min(shortest, depth), depth + 1)
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    at = lambda k: F.element_at("signature", F.col("tree") * depth + k + 1)
    rows = texts.select("rep", "signature", tree.alias("tree")).select(
        "rep", "tree", *[F.xxhash64("tree", *[at(k) for k in range(level)]).alias(f"p{level}") for level in levels]
    )
    found = None
    for level in levels:
        key = f"p{level}"
        counts = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
        with_company = cut(rows.join(counts, key), f"prefix-{level}")
        here = with_company if level == depth else with_company.where(F.col("_n") <= few)
        here = here.select("rep", "tree", F.col(key).alias("bucket"))
        found = here if found is None else found.unionByName(here)
        rows = with_company.where(F.col("_n") > few).drop("_n", key)
    return found


def join(
    docs: DataFrame, threshold: float = 0.8, recall: float = 0.998, trees: int = TREES,
    block_rows: int = BLOCK_ROWS, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """doc_id, class_id (smallest id of its class), n_links (documents at least as similar as
    the threshold) of every row of `docs`."""
    depth = prefix_length(threshold, trees, recall)
    least = threshold - _DOUBT * math.sqrt(threshold * (1 - threshold) / (trees * depth))
    known = cut(signed(docs, depth, trees), "signatures")
    texts = cut(
        known.where("h1 is not null").groupBy("h1", "h2").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("signature").alias("signature")
        ), "texts")
    buckets = cut(forest(texts, depth, trees), "buckets")
    own = buckets.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("tree", "bucket"))).alias("_at"))
    place = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.try_element_at("_at", t), F.lit(0).cast("bigint")))
    members = texts.join(own, "rep").select("rep", "h1", "copies", "n_words", "signature", place.alias("buckets"), F.posexplode(place).alias("tree", "bucket"))
    members = members.where("bucket <> 0")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("_rows"), F.sum("n_words").alias("_words"))
    blocks = F.greatest(F.ceil(F.col("_rows") / block_rows), F.least(F.col("_rows"), F.ceil(F.col("_words") / block_words))).cast("int")
    sizes = sizes.select("bucket", blocks.alias("_blocks"))
    block = F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int")
    tasks = (
        members.join(sizes, "bucket").withColumn("side", block)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("low", F.least("side", "_other")).withColumn("high", F.greatest("side", "_other"))
        .select("bucket", "low", "high", "side", "tree", "rep", "h1", "copies", "signature", "buckets")
    )
    flagged = grouped(tasks, _TASK, ["rep"]).mapInPandas(tidy(_flagger(least)), tasks.schema)
    flagged = cut(flagged, "candidates")
    given = docs.select(F.col("doc_id").alias("rep"), "text").where(F.col("rep").isNotNull())
    with_text = flagged.join(given, "rep")
    verified = grouped(with_text, _TASK, ["rep"]).mapInPandas(tidy(_verifier(threshold, least)), "rep bigint, links bigint, to bigint")
    verified = cut(verified, "links")
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(verified.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    named = (
        texts.select("h1", "h2", "rep", "copies").join(links, "rep", "left")
        .join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("h1", "h2", F.coalesce("component", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    return known.select("doc_id", "h1", "h2").join(named, ["h1", "h2"], "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that have an earlier one in their class."""
    gone = join(docs, **options).where(F.col("class_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
