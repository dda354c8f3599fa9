"""Names, paths, keys and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import constants as C

# A name's extension starts at its last dot, unless that dot leads the name.
_EXTENSION = r"(?s)^.+\.([^.]*)$"
_STEM_AND_EXTENSION = r"(?s)^(.+)(\.[^.]*)$"
_TAGGED = r"(?s)^(.*)~([^~]{1,8}?)(-[1-9][0-9]{0,2})?$"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def extension_raw(path: Column) -> Column:
    """Text after the last dot of the name; empty without one."""
    return F.regexp_extract(file_name(path), _EXTENSION, 1)


def extension(path: Column) -> Column:
    return F.lower(extension_raw(path))


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.rlike(_EXTENSION), F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(name)


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def parent_path(path: Column) -> Column:
    """Path of names of the holding folder, "" at the top."""
    parts = path_parts(path)
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def rendered_name(path: Column) -> Column:
    return F.concat(stem(path), F.lit(".jpg"))


def sized_name(name: Column, ext: Column) -> Column:
    return F.when(F.coalesce(ext, F.lit("")) == "", name).otherwise(F.concat(stem(name), F.lit("."), ext))


def with_tag(name: Column, tag: Column) -> Column:
    """`a.jpg`, tag -> `a~tag.jpg`; without stem or extension, `a~tag`."""
    return F.when(
        name.rlike(_STEM_AND_EXTENSION),
        F.concat(
            F.regexp_extract(name, _STEM_AND_EXTENSION, 1), F.lit("~"), tag,
            F.regexp_extract(name, _STEM_AND_EXTENSION, 2),
        ),
    ).otherwise(F.concat(name, F.lit("~"), tag))


def name_candidate(name: Column, md5: Column, n: Column) -> Column:
    """The n-th name tried for a file: 0 its own, 1 tagged, n >= 2 numbered."""
    tag = F.substring(md5, 1, 8)
    numbered = F.when(n <= 1, tag).otherwise(F.concat(tag, F.lit("-"), n.cast("string")))
    return F.when(n == 0, name).otherwise(with_tag(name, numbered))


def parse_candidate(name: Column) -> Column:
    """(base, tag, n) when `name` is a tagged form of `base`, else null.

    The inverse of `name_candidate` for n >= 1, so that candidates are looked
    up by an equi join instead of being listed 1000 to a file.
    """
    split = name.rlike(_STEM_AND_EXTENSION)
    front = F.when(split, F.regexp_extract(name, _STEM_AND_EXTENSION, 1)).otherwise(name)
    ext = F.when(split, F.regexp_extract(name, _STEM_AND_EXTENSION, 2)).otherwise("")
    tag = F.regexp_extract(front, _TAGGED, 2)
    number = F.regexp_extract(front, _TAGGED, 3)
    base = F.concat(F.regexp_extract(front, _TAGGED, 1), ext)
    n = F.when(number == "", 1).otherwise(F.substring(number, 2, 3).try_cast("int"))
    tagged = front.rlike(_TAGGED) & ((number == "") | (n >= 2))
    rebuilt = with_tag(base, F.concat(tag, number))
    return F.when(
        tagged & (rebuilt == name),
        F.struct(base.alias("base"), tag.alias("tag"), n.alias("n")),
    )


def series_name(base: Column, n: Column) -> Column:
    return F.when(n <= 1, base).otherwise(F.concat(base, F.lit(" ("), n.cast("string"), F.lit(")")))


def parse_series_name(name: Column) -> Column:
    """(base, n); a name without a number, or one written oddly, is its own base."""
    pattern = r"(?s)^(.*) \(([1-9][0-9]{0,8})\)$"
    n = F.regexp_extract(name, pattern, 2).try_cast("int")
    numbered = F.coalesce(n >= 2, F.lit(False))
    return F.struct(
        F.when(numbered, F.regexp_extract(name, pattern, 1)).otherwise(name).alias("base"),
        F.when(numbered, n).otherwise(F.lit(1)).alias("n"),
    )


def key_of_uri(uri: Column) -> Column:
    """Last segment of a URI."""
    return F.substring_index(uri, "/", -1)


def uri_of_key(key: Column) -> Column:
    with_serial = F.when(key.contains("-"), key).otherwise(F.concat(key, F.lit("-0")))
    return F.concat(F.lit(C.IMAGE_URI_PREFIX), with_serial)


def fetchable(url: Column) -> Column:
    """An http(s) address with a host."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(scheme.isin("http", "https") & (F.length(host) > 0), F.lit(False))


def url_file_name(url: Column) -> Column:
    """Last path segment, percent-decoded, if it has an extension."""
    segment = F.substring_index(F.try_parse_url(url, F.lit("PATH")), "/", -1)
    decoded = F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)
    return F.when(extension_raw(decoded) != "", decoded)


def md5_sha256(content: Column) -> Column:
    """Both digests of one content, lower-case hex."""
    return F.struct(F.sha2(content, 256).alias("sha256"), F.md5(content).alias("md5"))
