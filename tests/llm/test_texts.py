"""Text operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import licenses, mixing, packing, quality, queries, simple8b, tokens, warc

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else "src0", len(t or "")) for i, t in enumerate(texts)]
    # Clashing names must not matter.
    return spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).withColumn("size", F.lit("x")).withColumn("rank", F.lit(2))


ODD = ["", None, "a", "Hello world.", "  two  spaces ", "tab\tand\nline\r\n", "it's we'll DON'T", "x" * 5000, "word " * 3000, "naïve café ñandú ß", "日本語 текст ⅷ ² á éx", "<|endoftext|> <|startoftext|>x", "a\x1cb\x1fc \x85 \xa0x", "!!! ??? ...a 1,234.5", "Ered*** reed$$$\nnext&&& LINE", "emoji 😀😀 x", "\n", " \n", "a \nb", "a\n b"]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_by_word_is_the_tokenizer(spark, name, spaced):
    texts = [t for t in ODD] + [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    code = tokens.encoder(name, spaced)
    for begin, stop, ids, lengths in code.batches(texts):
        ends = np.cumsum(lengths)
        for k in range(begin, stop):
            want = code.tokenizer.encode(texts[k] or "", add_special_tokens=False).ids
            assert ids[ends[k - begin] - lengths[k - begin] : ends[k - begin]].tolist() == want, repr(texts[k])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sST.,! \n\t\x1cé²ⅷ́<|>3_日\xa0"), max_size=25), max_size=4))
def test_word_by_word_on_any_text(texts):
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        code = tokens.encoder(name, spaced)
        for begin, stop, ids, lengths in code.batches(texts):
            ends = np.cumsum(lengths)
            for k in range(begin, stop):
                assert ids[ends[k] - lengths[k] : ends[k]].tolist() == code.tokenizer.encode(texts[k], add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_000), st.integers(0, (1 << 64) - 1)), max_size=400))
def test_simple8b_round_trip(values):
    words, marks = simple8b.encode(np.array(values, np.uint64))
    got, begins = simple8b.decode(words, len(values))
    assert got.tolist() == values and marks.tolist() == begins.tolist()
    # Any marked word decodes on its own.
    for k in range(0, len(words), 7):
        if begins[k] >= 0:
            part, _ = simple8b.decode(words[k:], len(values) - begins[k])
            assert part.tolist() == values[begins[k] :]


def test_simple8b_packs_runs():
    assert len(simple8b.encode(np.zeros(240, np.uint64))[0]) == 2
    assert len(simple8b.encode(np.ones(240, np.uint64))[0]) == 1
    assert len(simple8b.encode(np.full(60, (1 << 15) - 1, np.uint64))[0]) == 15


def digests(texts, name, end):
    code, out, start = tokens.encoder(name, name.startswith("byte")).tokenizer, {}, 0
    for i, t in enumerate(texts):
        ids = np.array([*code.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        out[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def test_token_files(spark):
    texts = ODD * 3
    got = simple8b.round_trip(documents(spark, texts).repartition(5))
    want = digests(texts, "word_bpe_49k.json", 2)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()} == want
    assert simple8b.round_trip(documents(spark, [])).count() == 0


def test_token_files_with_null_and_repeated_ids(spark):
    rows = [(None, "b", "", "", 1), (3, "c d", "", "", 1), (3, "c d", "", "", 1), (1, "a", "", "", 1)]
    got = simple8b.round_trip(spark.createDataFrame(rows, SCHEMA)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 3, 3]
    assert [r["start"] for r in got] == [0, 2, 4, 7]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=40))
def test_packing_plan(lengths):
    pieces, sequences = packing.plan(lengths)
    assert all(n & (n - 1) == 0 and n <= 1024 for n in sequences)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, length, sequence, offset in pieces:
        by_doc[doc].append((start, length))
        by_sequence[sequence].append((offset, length))
    for spans, total in [(by_doc[d], n) for d, n in enumerate(lengths)] + [(by_sequence[s], n) for s, n in enumerate(sequences)]:
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert at == total


def test_packing(spark):
    texts = ODD * 4
    rows = packing.pack(documents(spark, texts).repartition(3)).collect()
    code = tokens.encoder("byte_bpe_50k.json", True).tokenizer
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids, at = np.array([*code.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == own[0]["sequence_length"] and len({r["step_id"] for r in own}) == 1
    assert packing.pack(documents(spark, [])).count() == 0


def test_quality_on_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op7_quality_classifier(spark, folder).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [i for i in labels if rows[i]["held_out"]]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in rows)
    right = np.mean([rows[i]["predicted"] == labels[i] for i in held])
    kept = np.mean([rows[i]["predicted"] for i in held if labels[i] == 1])
    assert len(held) > 100 and right > 0.97 and kept > 0.98


def test_quality_of_odd_texts(spark):
    docs = documents(spark, ODD)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(3, 0, 0), (None, 1, 0), (99, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    again = quality.classify(docs.repartition(7), labels).collect()
    assert {(r["doc_id"], r["predicted"]) for r in rows} == {(r["doc_id"], r["predicted"]) for r in again}
    none = labels.where("doc_id > 1000")
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.accepted(docs, none).columns == docs.columns


def test_quality_reads_every_passage():
    plain = "some ordinary words in a row that go on and on for a while here " * 12
    x, first = quality.encode([plain, "", None, plain + "TAIL!! LOUD!! " * 40, "a"])
    assert first.tolist()[1:4] == [first[1], first[1] + 1, first[1] + 2]
    assert (x[first[1]] == x[first[2]]).all()
    assert x[first[3] :, 2].max() > 0.3


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def scanned(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    firsts = [i for i, _ in places]
    return len(words), len(places), min(firsts, default=None), max(firsts, default=None), ",".join(sorted({x for _, x in places}))


LICENSED = [
    "Licensed under CC BY-NC 4.0.", "cc by cc by, CC-BY MIT License", "the GNU General\nPublic License", "gnu general gnu general public license",
    "mit İmit license K license", "apache  license apache-license APACHE_LICENSE", "cc by " * 400,
    "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "permission is hereby granted, free of charge, to any new person obtaining a copy of this fine software",
    "mit", "gnu general public", "ccby", "general public license",
]


def test_license_places(spark):
    texts = ODD + LICENSED
    rows = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts).repartition(4)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == scanned(t), t
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert "cc-by-notice" in rows[len(ODD) + 7]["labels"]
    # Two words put in and the rest in place: neighbouring diagonals are one match.
    assert rows[len(ODD) + 8]["labels"] == "mit-notice"
    assert licenses.scan(documents(spark, [])).count() == 0


def test_license_query_on_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op8_license_scan(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    assert all((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == scanned(texts[r["doc_id"]]) for r in rows)


def wanted_targets(sizes):
    """By rounds: what a capped source cannot take is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-6 and open_:
        total = sum(weight[s] for s in open_)
        given = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s, g in given.items():
            target[s] += g
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def check_mix(spark, docs, near):
    rows = mixing.mix(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    given = docs.select("doc_id", "source", "text").collect()
    sizes = Counter()
    for r in given:
        sizes[r["source"]] += count(r["text"])
    want, source = wanted_targets(sizes), {r["doc_id"]: r["source"] for r in given}
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], count(r["text"])) for r in given)
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) <= 1e-6 * (1 + want[s])
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near * (1 + want[s]) + 2
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_mix_of_documents(spark):
    check_mix(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), 0.02)


def test_mix_with_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_SLICE_ROWS", 7)
    rng = random.Random(1)
    texts = [" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 300))) for _ in range(300)] + ["", None, "a b", "a b", " \t\x0b "]
    sources = [rng.choice(["hot"] * 6 + ["a", "é", "Z", None, "none"]) for _ in texts]
    docs = documents(spark, [t for t, s in zip(texts, sources)], sources).where("coalesce(source, '') <> 'none' or text is null")
    check_mix(spark, docs, 0.03)


def test_mix_of_nothing(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    rows = mixing.mix(documents(spark, ["", None])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2


def test_mixed_documents_hold_what_is_taken(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        assert r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(r["text"].split())
    assert words == Counter({r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]})


def test_permutation(spark):
    for n in (1, 2, 7, 64, 65, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(9)).alias("p"))
        assert sorted(r["p"] for r in df.collect()) == list(range(n))


def test_warc_records(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<html lang='x' LANG=\"de\"><title> A\n b </title><p>x &amp;lt; y<!-- no --><script>q</script></p>z"), (2, None, None), (None, "http://b/", ""), (1, "http://a/", "x")], "page_id bigint, url string, html string")
    given = warc.responses(pages, "2026-01-01T00:00:00Z").withColumn("block", F.lit(1))
    rows = warc.derive(given, keep=("page_id",)).collect()
    assert Counter(r["record_type"] for r in rows) == {"metadata": 4, "conversion": 4}
    for r in rows:
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
        assert r["content_length"] == len(r["block"].encode())
        assert (r["refers_to"] is None) == (r["page_id"] is None)
    first = [r for r in rows if r["page_id"] == 1 and r["content_length"] != 1]
    assert [r["block"] for r in first if r["record_type"] == "conversion"][0] == "A b\nx &lt; y\nz"
    assert warc.derive(given.limit(0)).count() == 0
    binary = given.withColumn("http_header", F.lit("HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n"))
    assert {r["record_type"] for r in warc.derive(binary).collect()} == {"metadata"}


def test_warc_files(spark, tmp_path):
    records = warc.derive(warc.responses(spark.read.parquet(f"{FOLDER}/pages.parquet"), "2026-01-01T00:00:00Z"))
    warc.write(records, str(tmp_path / "w"))
    import gzip

    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    seen = 0
    while data:
        head, rest = data.split(b"\r\n\r\n", 1)
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest[length : length + 4] == b"\r\n\r\n"
        data, seen = rest[length + 4 :], seen + 1
    assert seen == records.count()
