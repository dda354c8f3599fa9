"""Searches through the index of trigrams, against searches over all texts."""

import pytest

from shelfmark.operators.search import search_images
from shelfmark.sources.text_index import LOOKED_UP, TextIndex, word_grams

SCHEMA = "image_key string, title string, caption string, keywords string, file_name string, taken timestamp"
TEXTS = [
    ("a", "Beach at DAWN", None, "sea;sun", "IMG_1.JPG"), ("b", None, None, None, None), ("c", "", "dawn chorus", "", "beach.jpg"),
    ("d", "\U0001f600\U0001f601\U0001f602 smile", "", None, "x"), ("e", "be ach", None, "dawn", "img_2.jpg"), (None, "beach dawn", None, None, None),
    ("f", "a%_b\\c[d", None, None, "q"), ("g", "\u0130stanbul stra\u00dfe", None, None, None), ("a2", "abcabcabd", None, None, "abcabd"),
    ("long", "word " * 20000 + "needle", None, None, None),
]


def images_of(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], SCHEMA)


def keys(df):
    return sorted(r["image_key"] or "" for r in df.collect())


@pytest.mark.parametrize("shards", [5])
def test_found_as_by_a_scan(spark, tmp_path, shards):
    images = images_of(spark, [*TEXTS, TEXTS[0]])
    index = TextIndex(spark, str(tmp_path), shards=shards, buckets=7)
    index.write(0, images)
    for text in ("beach", "BEACH dawn", "be", "be dawn", "ach beach", "\U0001f601\U0001f602 ", "\U0001f600\U0001f601\U0001f602", "%_b", "c[d", "stanbul", "stra\u00dfe",
                 "abcabd", "abcabcabd", "needle word", "rd wo", "nowhere", "jpg", "img_", ""):
        assert keys(index.search(images, text, limit=0)) == keys(search_images(images, text=text, limit=0)), text


def test_candidates_hold_the_grams(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path), buckets=4)
    index.write(0, images_of(spark, TEXTS))
    assert keys(index.candidates("beach dawn")) == ["", "a", "c"]
    assert index.candidates("be aw") is None
    # Grams in another order are candidates, which the texts rule out.
    assert keys(index.candidates("abdabc")) == [] and len(word_grams("abcabcabd")) > LOOKED_UP


def test_changes_by_version(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path), buckets=4)
    index.write(0, images_of(spark, TEXTS))
    changed = [("a", "Forest", None, "sea;sun", "IMG_1.JPG"), ("n", "new beach", None, None, None)]
    index.write(1, images_of(spark, changed), before=images_of(spark, TEXTS[:1]))
    now = images_of(spark, [*changed, *TEXTS[1:]])
    for text in ("beach", "forest", "dawn", "sea"):
        assert keys(index.search(now, text, limit=0)) == keys(search_images(now, text=text, limit=0)), text
    assert keys(index.candidates("beach")) == ["", "c", "n"] and keys(index.candidates("beach", version=0)) == ["", "a", "c"]
    # Gone altogether.
    index.write(2, images_of(spark, []), before=images_of(spark, changed[1:]))
    assert keys(index.candidates("beach")) == ["", "c"]
    # Written once more, as after a failure.
    index.write(2, images_of(spark, []), before=images_of(spark, changed[1:]))
    assert keys(index.candidates("beach")) == ["", "c"]


def test_no_images(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path))
    nothing = images_of(spark, [])
    index.write(0, nothing)
    assert keys(index.search(nothing, "beach")) == []
