"""Similarity joins, passages and the pipeline against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import components, lsh_forest, mixing, queries, substring_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
FOLDER = "/root/testdata/sf0.01"


def documents(spark, rows):
    full = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).withColumn("rep", F.lit(1)).withColumn("component", F.lit("x")).withColumn("passages", F.lit(0))


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows, threshold=0.8):
    sets = [(i, grams(t)) for i, t in rows if i is not None]
    holders = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for g in s:
            holders[g].add(k)
    seen, links = set(), []
    for own in holders.values():
        if len(own) < 2:
            continue
        for a in own:
            for b in own:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    x, y = sets[a][1], sets[b][1]
                    if len(x & y) >= threshold * len(x | y) - 1e-9:
                        links.append((sets[a][0], sets[b][0]))
    count = Counter(i for pair in links for i in pair)
    root = roots({i for i, _ in sets}, links)
    return {i: (root[i], count[i]) for i in root}


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = "edit%d" % rng.randrange(10**6)
    return words


def test_join_on_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in queries.op4_ngram_jaccard_join(spark, FOLDER).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("block_rows", [8, 1024])
def test_join_of_large_groups(spark, block_rows):
    rng = random.Random(3)
    base = ["w%d" % rng.randrange(10**6) for _ in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0, 1, 2, 3])))) for i in range(150)]
    rows += [(200 + i, " ".join(base)) for i in range(60)]
    rows += [(300 + i, " ".join("v%d" % rng.randrange(10**6) for _ in range(60))) for i in range(50)]
    rows += [(400, ""), (401, None), (402, ""), (403, "one two"), (404, "ONE  two"), (405, "one two three"), (None, " ".join(base)), (406, "x " * 20_000), (407, "\x1c \x1f")]
    docs = documents(spark, rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in lsh_forest.join(docs, block_rows=block_rows).collect()}
    assert got.pop(None) == (None, 0)
    want = brute(rows)
    missed = [i for i in want if got[i][1] != want[i][1]]
    # The forest finds 99.8 of 100 links at the threshold itself, and more above it.
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    total = sum(n for _, n in want.values())
    assert all(got[i][1] <= want[i][1] for i in missed) and sum(n for _, n in got.values()) >= 0.995 * total
    kept = {r["doc_id"] for r in lsh_forest.one_of_each(docs).collect()}
    assert kept == {c for c, _ in want.values()} | {None}
    assert lsh_forest.one_of_each(docs).columns == docs.columns


def test_join_of_repeated_rows_and_nothing(spark):
    text = " ".join("w%d" % i for i in range(40))
    docs = documents(spark, [(1, text), (1, text), (2, text), (2, text + " more"), (3, "other words stand in here")])
    got = Counter((r["doc_id"], r["class_id"]) for r in lsh_forest.join(docs).collect())
    assert got == {(1, 1): 2, (2, 1): 2, (3, 3): 1}
    assert lsh_forest.join(documents(spark, [])).count() == 0
    assert lsh_forest.join(documents(spark, [(1, ""), (2, None)])).count() == 2


def test_prefix_length_keeps_recall():
    for trees in (4, 16):
        depth = lsh_forest.prefix_length(0.8, trees, 0.99)
        assert 1 - (1 - 0.8**depth) ** trees >= 0.99 > 1 - (1 - 0.8 ** (depth + 1)) ** trees or depth == 1


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == roots({x for e in edges for x in e}, edges)


def naive_windows(order, width):
    """By definition: the span in which each place is the smallest, the first of equals."""
    out = set()
    for c in range(len(order)):
        low, high = c, c
        while low and order[low - 1] > order[c]:
            low -= 1
        while high + 1 < len(order) and order[high + 1] > order[c]:
            high += 1
        if high - low + 1 >= width:
            out.add((low, c, high))
    return out


def test_compact_windows():
    rng = np.random.default_rng(6)
    for n in (3, 10, 60, 300):
        values = rng.permutation(10**6)[: 2 * n].astype(np.uint64)
        bounds = np.array([0, n, 2 * n])
        factor = substring_dedup._factors(1)[0]
        with np.errstate(over="ignore"):
            order = substring_dedup.mixed(values * factor)
        for width in (1, 4, 10):
            text, low, centre, high = substring_dedup.compact_windows(values, bounds, factor, width)
            for t in (0, 1):
                own = {(a, c, b) for x, a, c, b in zip(text, low, centre, high, strict=True) if x == t}
                assert own == naive_windows(order[bounds[t] : bounds[t + 1]], width)


def passage(rng, n):
    return ["p%d" % rng.randrange(10**7) for _ in range(n)]


def test_planted_passages(spark):
    rng = random.Random(7)
    shared, other = passage(rng, 60), passage(rng, 200)
    rows = []
    for i in range(40):
        words = passage(rng, rng.randint(60, 400))
        at = rng.randrange(len(words))
        if i % 4 == 1:
            words[at:at] = shared
        if i % 4 == 2:
            words[at:at] = edited(rng, other, 1)
        rows.append((i, " ".join(words)))
    rows += [(100, " ".join(passage(rng, 30) + shared[:49] + passage(rng, 30))), (101, ""), (102, None), (None, " ".join(shared)), (103, "a b c"), (104, "and " * 5000), (105, "and " * 300)]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in substring_dedup.repeated(docs).collect()}
    assert len(got) == len(rows)
    for i in range(40):
        if i % 4 == 1 and i > 1:
            assert got[i]["class_id"] == 1 and got[i]["sources"] == [1] and 60 <= got[i]["repeated_words"] <= 66
        elif i % 4 == 2 and i > 2:
            assert 2 in got[i]["sources"] and 190 <= got[i]["repeated_words"] <= 215
        else:
            assert got[i]["repeated_words"] == 0
    assert [got[i]["repeated_words"] for i in (100, 101, 102, 103, 104)] == [0] * 5
    assert got[105]["sources"] == [104] and got[None]["repeated_words"] == 0
    clean = {r["doc_id"]: r for r in substring_dedup.without_repeats(docs).collect()}
    texts = dict(rows)
    assert set(clean) == set(texts) - {105}
    for i, r in clean.items():
        if i is None or not got[i]["repeated_words"]:
            assert r["text"] == texts[i]
        else:
            assert len(r["text"].split()) == len(texts[i].split()) - got[i]["repeated_words"] and r["n_chars"] == len(r["text"])
    assert substring_dedup.without_repeats(docs).columns == docs.columns
    assert substring_dedup.repeated(docs.limit(0)).count() == 0


def test_copies_of_whole_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    first = {}
    for i, t in sorted(rows):
        first.setdefault(t, i)
    got = {r["doc_id"]: r for r in queries.op1_substring_dedup(spark, FOLDER).collect()}
    for i, t in rows:
        if len(t.split()) >= 50 and first[t] != i:
            assert got[i]["repeated_words"] == len(t.split()), i
    # What is found is real: the tokens of each passage stand in its source.
    texts = dict(rows)
    for r in got.values():
        for p in r["passages"] or []:
            a = grams(" ".join(texts[r["doc_id"]].split()[p["start"] : p["start"] + p["length"]]))
            assert len(a & grams(texts[p["source"]])) >= 0.8 * len(a) and p["source"] < r["doc_id"]


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, None
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).toPandas(), docs.schema)
        assert docs.columns == columns
        kept[name] = docs.collect()
    given = kept["quality classifier"]
    want = brute([(r["doc_id"], r["text"]) for r in given])
    assert {r["doc_id"] for r in kept["n-gram Jaccard join"]} == {c for c, _ in want.values()}
    rows = queries.pipeline(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in kept["mixing sources"]}


def test_stages_carry_columns_of_any_name(spark):
    """Columns by which the stages call their own come out as they went in."""
    rng = random.Random(8)
    passage = " ".join("p%d" % i for i in range(80))
    rows = [(i, " ".join("w%d" % rng.randrange(10**6) for _ in range(60)) + " " + passage) for i in range(6)]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], SCHEMA)
    names = ["size", "_row", "_nth", "_parts", "_id", "_passages", "_text", "_words", "s", "start", "a b", "pass", "_rest"]
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.col("doc_id") * 100 + k)
    for stage in (substring_dedup.without_repeats, mixing.mixed_documents):
        out = stage(docs)
        assert out.columns == docs.columns
        kept = out.collect()
        assert {r["doc_id"] for r in kept} == set(range(6))
        assert all(r[name] == r["doc_id"] * 100 + k for r in kept for k, name in enumerate(names))
