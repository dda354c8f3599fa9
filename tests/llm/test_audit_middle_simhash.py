"""Filter audit, fill-in-middle and SimHash against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import fill_middle, filter_audit, queries, simhash_search

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
FOLDER = "/root/testdata/sf0.01"
BLANK = " \t\n\x0b\f\r"
CASES = ["", None, " ", "\n\n", "one", "one two ", "  lead", "a b c été \U0001f600\U0001f601 x", "ÄÖ" * 40, "<P>x y", "a <S", "S> b <", "x" * 70_000, "\t\x0b\f\r\n mixed \x1c\x85 end\r", "A$B C", "word " * 30_000, "exactly8", "1234567 ", "12345678 9"]


def documents(spark, rows):
    full = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    frame = spark.createDataFrame(full, SCHEMA)
    # Columns by which the operators call their own.
    for name in ("n", "form", "part", "failed", "fp", "output", "component_id", "key"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


def random_text(rng, words):
    letters = "abcdéX中\U0001f600"
    return "".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) + rng.choice([" ", " ", "\n", "  ", "\t \r"]) for _ in range(words))


def middle(i, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (i, len(units), "plain", None, None, text)
    form = "spm" if h[3] % 100 < 80 else "psm"
    return (i, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle(spark):
    rng = random.Random(1)
    rows = [(k * 20 + j, t, "s") for k, t in enumerate(CASES) for j in range(6)]
    rows += [(1000 + k, random_text(rng, rng.randrange(40)), "s") for k in range(300)] + [(None, "no id here", "s"), (5, "again x", "s"), (5, "again x", "s")]
    docs = documents(spark, rows)
    got = Counter(tuple(r) for r in fill_middle.transform(docs).collect())
    assert got == Counter(middle(i, t) for i, t, _ in rows)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    back = Counter((r["doc_id"], r["restored"]) for r in fill_middle.restore(fill_middle.transform(docs)).collect())
    assert back == Counter((i, t or "") for i, t, _ in rows)
    assert fill_middle.digests(documents(spark, [])).count() == 0


@pytest.mark.parametrize("before", ["", "<", "<S", "<P", "><", "<M"])
def test_markers_are_found_again_beside_any_text(spark, before):
    rows = [(i, f"{before} {before}x{before} a b {before}", "s") for i in range(200)]
    back = fill_middle.restore(fill_middle.transform(documents(spark, rows), percent=100)).collect()
    assert all(r["restored"] == rows[0][1] and r["form"] != "plain" for r in back)


def test_words_mark_the_ends_of_units():
    texts = [t.encode() for t in CASES if t is not None]
    words = fill_middle.Words(texts)
    for k, text in enumerate(CASES[:1] + CASES[2:]):
        ends = np.cumsum([0] + [len(u.encode()) for u in re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)])
        assert words.n[k] == len(ends) - 1
        for at in {0, 1, len(ends) // 2, len(ends) - 1} & set(range(len(ends))):
            every = np.zeros(len(texts), np.int64)
            every[k] = at
            assert words.ends_of(every)[k] == ends[at]
            offset = np.zeros(len(texts), np.int64)
            offset[k] = ends[at]
            assert words.chars_before(offset)[k] == len(text.encode()[: ends[at]].decode())


def fails(rows):
    out = []
    for i, t, s in rows:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (u or "") == text for j, u, _ in rows),
        }
        out.append((i, s or "", {k for k, v in f.items() if v}))
    return out


def audited(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    found, shapley = {}, Counter()
    for part in {s or "" for _, _, s in rows}:
        mine = [(i, f) for i, p, f in fails(rows) if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, own in enumerate(order):
                removed = [(i, f) for i, f in left if own in f]
                left = [(i, f) for i, f in left if own not in f]
                failing = [f for _, f in mine if own in f]
                shapley[part, own] += len(removed)
                found[part, "".join(order), k + 1] = [
                    len(left), len(removed), len(failing) - len(removed), sum(f == {own} for f in failing), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def test_filter_audit(spark):
    rng = random.Random(2)
    pool = [random_text(rng, rng.choice([5, 150, 250])) for _ in range(12)] + ["Plain words " * 120, "low " * 300, "Some # sign " * 80, "", None, "x " * 20]
    rows = [(i, rng.choice(pool), rng.choice(["a", "a", "b", "", None])) for i in range(150)]
    rows += [(None, pool[0], "a"), (None, pool[0], "b"), (3, pool[0], "a"), (3, pool[0], "b"), (0, "", "c"), (-5, pool[1], "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(-10, 120)] + [(7, 1, 1), (7, 0, 0), (None, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("y")).withColumn("n", F.lit(1))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(documents(spark, rows), known).collect()}
    assert got == audited(rows, labels)
    assert filter_audit.audit(documents(spark, []), known).count() == 0
    unlabelled = filter_audit.audit(documents(spark, rows[:3]), known.limit(0)).agg(F.sum("good_lost"), F.sum("kept")).first()
    assert unlabelled[0] == 0 and unlabelled[1] > 0


def test_words_of_a_long_text_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(filter_audit, "_PIECE", 7)
    for text in CASES:
        words = (text or "").encode().split()
        assert filter_audit._word_counts((text or "").encode()) == (len(words), len(set(words)))


def simhash(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    bits = np.array(hashes, np.uint64)[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)
    return sum(1 << b for b in range(64) if 2 * int(bits[:, b].sum()) > len(hashes)) if hashes else 0


def near(rows, distance=4):
    fps = [(i, simhash(t)) for i, t in rows]
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    values = np.array(distinct, np.uint64)
    for k, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= distance):
            a, b = find(f), find(distinct[k + 1 + int(j)])
            root[max(a, b)] = min(a, b)
    first = {}
    for i, f in fps:
        if i is not None:
            first[find(f)] = min(i, first.get(find(f), i))
    return Counter((i, f"{f:016x}", first.get(find(f))) for i, f in fps)


@pytest.mark.parametrize("text", [t for t in CASES if t is None or len(t) < 20_000] + ["A b C d E", "x y z", "ab\tCD  ef\n\n gh ij kl "])
def test_fingerprint(text):
    assert simhash_search.fingerprint((text or "").encode()) == simhash(text)


def test_fingerprint_of_many_shingles(monkeypatch):
    monkeypatch.setattr(simhash_search, "_RUN", 300)
    text = random_text(random.Random(3), 3000)
    assert simhash_search.fingerprint(text.encode()) == simhash(text)


def test_simhash_on_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op13_simhash(spark, FOLDER).collect())
    assert got == near(rows)


@pytest.mark.parametrize("block", [4, 256])
def test_simhash_of_large_groups(spark, block):
    rng = random.Random(4)
    base = ["w%d" % rng.randrange(10**6) for _ in range(200)]

    def edit(times):
        words = list(base)
        for _ in range(times):
            words[rng.randrange(len(words))] = "e%d" % rng.randrange(10**6)
        return " ".join(words)

    rows = [(i, edit(rng.choice([0, 1, 1, 2, 6])), "s") for i in range(250)] + [(300 + i, " ".join("v%d" % rng.randrange(10**6) for _ in range(30)), "s") for i in range(100)]
    rows += [(500, "", "s"), (501, None, "s"), (None, " ".join(base), "s"), (None, "alone and unnamed", "s"), (502, "one", "s"), (502, "two other", "s"), (502, "one", "s"), (503, "x " * 30_000, "s")]
    rows += [(600 + i, "same text for all of them", "s") for i in range(80)]
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_search.near_duplicates(documents(spark, rows), block=block).collect())
    assert got == near([(i, t) for i, t, _ in rows])


def test_simhash_of_nothing(spark):
    assert simhash_search.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("thresholds", [(0, 0, 0, 0, 0), (1, 0, -1, 1, -1), (4, -1, -1, -1, -1), (2, 1, -1, -1, -1)])
def test_any_allocation_finds_all_links(spark, thresholds):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(centres.tolist())
    for c in centres:
        for _ in range(12):
            fps.add(int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)))
    values = np.array(sorted(fps), np.uint64)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")
    bits = [list(x) for x in np.array_split(rng.permutation(64), 5)]
    parts = [([int(b) for b in g], t) for g, t in zip(bits, thresholds, strict=True)]
    found = {(r["a"], r["b"]) for r in simhash_search.links(frame, 4, 16, parts).collect()}
    unsigned = lambda x: x & (1 << 64) - 1
    root = {int(v): int(v) for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        # What hangs together in a task may be further apart than a link.
        a, b = find(unsigned(a)), find(unsigned(b))
        root[max(a, b)] = min(a, b)
    for k, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values ^ v) <= 4):
            assert find(int(v)) == find(int(values[j]))


def test_thresholds_cost_least():
    rng = random.Random(6)
    for _ in range(20):
        costs = [[0.0] + sorted(rng.random() * 100 for _ in range(5)) for _ in range(4)]
        cost, thresholds = simhash_search.allocate(costs, 4)
        assert sum(t + 1 for t in thresholds) == 5 and cost == pytest.approx(sum(c[t + 1] for c, t in zip(costs, thresholds)))
        every = [(sum(c[u] for c, u in zip(costs, (a, b, c_, 5 - a - b - c_))), 0) for a in range(6) for b in range(6 - a) for c_ in range(6 - a - b)]
        assert cost == pytest.approx(min(every)[0])


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(7)
    free = rng.integers(0, 2, (5000, 64)).astype(np.float64)
    for a, b in ((3, 40), (10, 63), (20, 21)):
        free[:, b] = free[:, a]
    groups = simhash_search.grouped_bits(free.T @ free, len(free), 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    for a, b in ((3, 40), (10, 63), (20, 21)):
        assert any(a in g and b in g for g in groups)
