"""An inverted index of trigrams over the texts of a catalog's images.

A posting says that a gram, three characters in lower case, stands in some text of an image.  A
word that is a substring of a text has all its grams there, so images that hold the rarest
grams of each word are candidates, and the texts of these alone are searched.  A posting that is no
longer true costs a look at a text and never changes a result.

Postings are a log (`sources/log.py`): a version writes those of the images it is given.  They are
dealt by gram and by one of `SHARDS` parts of the images, so that a gram which every image
holds is spread over as many buckets, and a search reads the buckets of its own grams only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.search import TEXT_FIELDS, search_images
from shelfmark.sources.log import Log, Table

GRAM = 3
# Parts of the images that a gram's postings are spread over, fixed when an index is made.
SHARDS = 8
# Grams of a word that are looked up: its rarest.
LOOKED_UP = 3
_TABLES = {"grams": Table("part string, gram string, image_key string", ("gram", "image_key"), "part")}


def grams_of(text: Column) -> Column:
    """All grams of a text, each once; null has none."""
    chars = F.split(F.lower(F.coalesce(text, F.lit(""))), "")
    # Beside each character those after it: a lambda that indexed `chars` would split the text for every one.
    runs = F.arrays_zip(chars, *[F.slice(chars, k + 1, F.size(chars)) for k in range(1, GRAM)])
    joined = F.transform(runs, lambda r: F.concat(*[r[str(k)] for k in range(GRAM)]))
    return F.array_distinct(F.filter(joined, lambda g: F.char_length(g) == GRAM))


def word_grams(word: str) -> list[str]:
    return sorted({word[i : i + GRAM] for i in range(len(word) - GRAM + 1)})


class TextIndex:
    """Of images by `image_key`; a null key is a key of its own."""

    def __init__(self, spark: SparkSession, folder: str, shards: int = SHARDS, buckets: int | None = None):
        self.spark, self.shards, self.log = spark, shards, Log(spark, folder, _TABLES, buckets)

    def _part(self, gram: Column, shard: Column) -> Column:
        return F.concat(gram, F.lit("/"), shard.cast("string"))

    def _postings(self, images: DataFrame) -> DataFrame:
        every = F.array_distinct(F.flatten(F.array(*[grams_of(F.col(c)) for c in TEXT_FIELDS])))
        held = images.select("image_key", F.explode(every).alias("gram")).distinct()
        shard = F.pmod(F.xxhash64("image_key"), F.lit(self.shards))
        return held.select(self._part(F.col("gram"), shard).alias("part"), "gram", "image_key")

    def write(self, version: int, images: DataFrame, before: DataFrame | None = None) -> None:
        """Adds the postings of new and changed `images`; with the rows that these were
        `before`, or that are gone, postings which no longer hold are taken away."""
        now = self._postings(images)
        gone = None
        if before is not None:
            was = self._postings(before).alias("was")
            same = (F.col("was.gram") == F.col("now.gram")) & F.col("was.image_key").eqNullSafe(F.col("now.image_key"))
            gone = {"grams": was.join(now.alias("now"), same, "left_anti")}
        self.log.write(version, {"grams": now}, gone)

    def _read(self, grams: list[str], version: int | None) -> DataFrame:
        """Postings of the grams given, from their buckets."""
        asked = self.spark.createDataFrame([(f"{g}/{s}",) for g in grams for s in range(self.shards)], "part string")
        return self.log.read("grams", version, of=asked)

    def candidates(self, text: str, version: int | None = None) -> DataFrame | None:
        """(image_key) of all images that may hold every word of `text`; None where all may,
        as no word is as long as a gram."""
        words = [w for w in text.lower().split() if len(w) >= GRAM]
        grams = sorted({g for w in words for g in word_grams(w)})
        if not grams:
            return None
        # One number for each gram of the words asked for.
        counted = self._read(grams, version).groupBy("gram").count()
        held = dict.fromkeys(grams, 0) | {r["gram"]: r["count"] for r in counted.collect()}
        chosen = sorted({g for w in words for g in sorted(word_grams(w), key=lambda g: (held[g], g))[:LOOKED_UP]})
        postings = self._read(chosen, version)
        return postings.groupBy("image_key").agg(F.count("*").alias("_held")).where(F.col("_held") == len(chosen)).select("image_key")

    def search(self, images: DataFrame, text: str, version: int | None = None, **options) -> DataFrame:
        """`search_images`, reading the texts of candidates alone where the join by key allows."""
        found = self.candidates(text, version)
        if found is not None:
            found = found.withColumnRenamed("image_key", "_candidate")
            images = images.join(found, F.col("image_key").eqNullSafe(F.col("_candidate")), "left_semi")
        return search_images(images, text=text, **options)
