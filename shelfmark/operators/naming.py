"""Names that never overwrite another file, and request batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions.paths import extension_raw, name_candidate, parse_candidate, stem
from shelfmark.session import cut
from shelfmark.skew import UNCOUNTED, hot_keys, ranked, refined, salted_join


def latest_by_name(images: DataFrame) -> DataFrame:
    """Per (series, file_name), the entry of the album with the highest n.

    Within an album the last listed counts: by `pos` where given, else by key.
    """
    rest = [c for c in images.columns if c not in ("series", "file_name")]
    tie = [c for c in ("n", "pos", "image_key", "uri") if c in images.columns]
    last = F.max_by(F.struct(*rest), F.struct(*tie)).alias("_last")
    return images.groupBy("series", "file_name").agg(last).select(
        "series", "file_name", *[F.col(f"_last.{c}").alias(c) for c in rest]
    )


def nth_free(rank: Column, taken: Column) -> Column:
    """The rank-th positive integer not in the sorted array `taken`."""
    skipped = F.filter(taken, lambda t, i: t - i <= rank)
    return rank + F.coalesce(F.size(skipped), F.lit(0))


def resolve_names(
    files: DataFrame, remote: DataFrame, hot: DataFrame | None | object = UNCOUNTED, hot_rows: int | None = None
) -> DataFrame:
    """What each file is called in its series.

    `files` holds (series, path, file_name, md5), `remote` holds (series,
    file_name, md5, uri, album_key), a name once.  Adds:

    - `name_action`: `own`, `tagged`, `present` or `error`
    - `target_name`: the name to upload under
    - `present_uri`, `present_album_key`: the remote image that is this file
    - `present_path`: the file of this batch that will be this file's image

    A name free remotely goes to the first path wanting it.  All others look
    at every candidate: one with their content means present, else they take
    the first free one.  Tagged names are matched by parsing the names taken,
    not by listing a file's 1000 candidates.
    """
    name_key = ["series", "file_name"]
    remote = remote.select(
        *name_key, F.lower("md5").alias("_md5"), F.col("uri").alias("_uri"), F.col("album_key").alias("_album")
    )
    first = F.min_by(F.struct("path", "md5"), "path")
    claims = files.groupBy(*name_key).agg(first.alias("_claim"))
    claimed = claims.join(remote.withColumn("_remote", F.lit(True)), name_key, "full_outer")
    # Who holds each name once own names are given out.
    held = cut(claimed.select(
        *name_key,
        F.when(F.col("_remote"), F.col("_md5")).otherwise(F.col("_claim.md5")).alias("_md5"),
        F.when(F.col("_uri") != "", F.col("_uri")).alias("_uri"),
        "_album",
        F.when(F.col("_remote").isNull(), F.col("_claim.path")).alias("_holder"),
    ), "held")
    if hot is UNCOUNTED:
        hot = hot_keys(files, name_key, hot_rows)
    checked = cut(salted_join(files, held, name_key, "left", hot=hot, spread=["path"]).withColumn(
        "_own",
        F.when(F.col("_holder") == F.col("path"), "own")
        .when(
            (F.col("_md5") == F.col("md5")) & (F.col("_uri").isNotNull() | F.col("_holder").isNotNull()),
            "present",
        )
        .otherwise("taken"),
    ), "named")

    # Names taken that are tagged forms, by what they are forms of.
    tag_key = ["series", "file_name", "_tag"]
    holder = F.struct(
        F.col("_form.n").alias("n"), F.col("_md5").alias("md5"), F.col("_uri").alias("uri"),
        F.col("_album").alias("album_key"), F.col("_holder").alias("path"),
    )
    forms = (
        held.withColumn("_form", parse_candidate(F.col("file_name")))
        .where(F.col("_form").isNotNull())
        .select("series", F.col("_form.base").alias("file_name"), F.col("_form.tag").alias("_tag"), holder.alias("_h"))
        # A name is held once, so at most NAME_CANDIDATES forms to a group.
        .groupBy(*tag_key).agg(F.sort_array(F.collect_list("_h")).alias("_forms"))
    )
    # One rival per content; equal content of one name shares the image.
    rivals = cut(
        checked.where(F.col("_own") == "taken")
        .groupBy(*name_key, "md5").agg(F.min("path").alias("_rival"))
        .withColumn("_tag", F.substring("md5", 1, 8))
        .join(forms, tag_key, "left")
        .withColumn(
            "_same",
            F.try_element_at(
                F.filter(
                    "_forms",
                    lambda h: (h["md5"] == F.col("md5")) & (h["uri"].isNotNull() | h["path"].isNotNull()),
                ),
                F.lit(1),
            ),
        ),
        "rivals",
    )
    found = rivals.where(F.col("_same").isNotNull()).withColumn("_n", F.lit(None).cast("bigint"))
    unnamed = rivals.where(F.col("_same").isNull())
    named = ranked(unnamed, tag_key, ["_rival"], "_r", hot=refined(hot, unnamed, tag_key, hot_rows)).withColumn(
        "_n", nth_free(F.col("_r"), F.transform("_forms", lambda h: h["n"]))
    ).drop("_r")
    decided = found.unionByName(named).select(
        *name_key, "md5", "_rival", "_n", F.col("_same").alias("_same")
    )
    content_key = [*name_key, "md5"]
    joined = salted_join(
        checked, decided, content_key, "left", hot=refined(hot, files, content_key, hot_rows), spread=["path"]
    )

    leads = F.col("_rival") == F.col("path")
    no_name = F.col("_n") >= C.NAME_CANDIDATES
    action = (
        F.when(F.col("_own") != "taken", F.col("_own"))
        .when(F.col("_same").isNotNull(), "present")
        .when(no_name, "error")
        .when(leads, "tagged")
        .otherwise("present")
    )
    is_here = F.col("name_action") == "present"
    by_own = F.col("_own") == "present"
    return (
        joined.withColumn("name_action", action)
        .withColumns({
            "target_name": F.when(F.col("name_action") == "own", F.col("file_name")).when(
                F.col("name_action") == "tagged", name_candidate(F.col("file_name"), F.col("md5"), F.col("_n"))
            ),
            "present_uri": F.when(is_here, F.when(by_own, F.col("_uri")).otherwise(F.col("_same.uri"))),
            "present_album_key": F.when(is_here, F.when(by_own, F.col("_album")).otherwise(F.col("_same.album_key"))),
            "present_path": F.when(
                is_here,
                F.when(by_own, F.col("_holder")).when(
                    F.col("_same").isNotNull(), F.col("_same.path")
                ).otherwise(F.col("_rival")),
            ),
        })
        .drop("_md5", "_uri", "_album", "_holder", "_own", "_rival", "_n", "_same")
    )


def batches(
    items: DataFrame, key: str = "album_key", uri: str = "image_uri", order: str = "path",
    size: int = C.COLLECT_BATCH,
) -> DataFrame:
    """(key, batch, uris): each URI once per album, in order, `size` to a request."""
    distinct = items.groupBy(key, uri).agg(F.min(order).alias("_at"))
    numbered = ranked(distinct, [key], ["_at", uri], "_n")
    return (
        numbered.withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("bigint"))
        .groupBy(key, "batch")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", uri))), lambda s: s[uri]).alias("uris"))
    )


def _suffix(n: Column) -> Column:
    """`_1_2_..._n`: a taken name's suffix grows each time it is tried."""
    return F.concat(
        F.lit("_"), F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("string")), "_")
    )


# A suffix counting this far is alone longer than a file name may be.
_LONGEST_COUNT = 100
# Characters of a stem or extension kept beside a digest: at most four bytes each.
_KEPT_STEM, _KEPT_EXT = 40, 10


def unique_download_names(
    images: DataFrame, order: Sequence[str], name: str = "file_name", hot_rows: int | None = None
) -> DataFrame:
    """Adds `target_name`, a name of its own for every image.

    The first image of each name keeps it.  The others take, in order, the
    names of their chain (`a_1.jpg`, `a_1_2.jpg`, ...) that no image has as
    its own.  Chains of different names never meet, so one numbering per
    chain is exact.  Where the name left is too long to store, the image is
    called by the start of its stem and a digest of what orders it.
    """
    place = F.struct(*[F.col(c) for c in order])
    firsts = images.groupBy(name).agg(F.min(place).alias("_first"))
    chain = {"_stem": stem(F.col(name)), "_ext": extension_raw(F.col(name))}
    chained = images.withColumns(chain)
    hot_chain = hot_keys(chained, ["_stem", "_ext"], hot_rows)
    hot = refined(hot_chain, chained, [name], hot_rows)
    marked = salted_join(chained, firsts, [name], "left", hot=hot, spread=list(order))
    own = marked.where(place == F.col("_first")).withColumn("_k", F.lit(0).cast("bigint"))
    others = ranked(
        marked.where(place != F.col("_first")), ["_stem", "_ext"], list(order), "_r", hot=hot_chain
    )

    # Own names that stand in another name's chain.
    counted = F.regexp_extract("_stem", "_([1-9][0-9]?)$", 1).try_cast("int")
    taken = (
        firsts.withColumns(chain)
        .withColumn("_count", counted).where(F.col("_count").isNotNull())
        .withColumn("_suffix", _suffix(F.col("_count")))
        .where(F.endswith("_stem", F.col("_suffix")))
        .withColumn("_stem", F.substring("_stem", F.lit(1), F.length("_stem") - F.length("_suffix")))
        .where(F.col("_stem") != "")
        .groupBy("_stem", "_ext").agg(F.array_sort(F.collect_set("_count")).alias("_taken"))
    )
    placed = salted_join(
        others, taken, ["_stem", "_ext"], "left", hot=hot_chain, spread=list(order)
    ).withColumn("_k", nth_free(F.col("_r"), F.col("_taken"))).drop("_r", "_taken")

    dotted = F.when(F.col("_ext") != "", F.concat(F.lit("."), F.col("_ext"))).otherwise("")
    counted_name = F.concat("_stem", _suffix(F.least("_k", F.lit(_LONGEST_COUNT)).cast("int")), dotted)
    wanted = F.when(F.col("_k") == 0, F.col(name)).otherwise(counted_name)
    short = F.octet_length("_wanted") <= C.FILE_NAME_BYTES
    digest = F.md5(F.concat_ws("|", name, *[F.col(c).cast("string") for c in order]))
    bounded = F.concat(F.left("_stem", F.lit(_KEPT_STEM)), F.lit("_"), digest, F.left(dotted, F.lit(_KEPT_EXT)))
    return (
        own.unionByName(placed).withColumn("_wanted", wanted)
        .withColumn("target_name", F.when(short, F.col("_wanted")).otherwise(bounded))
        .select(*images.columns, "target_name")
    )
