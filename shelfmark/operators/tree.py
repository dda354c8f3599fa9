"""The folder tree: closures, paths, wanted structure, moves and renames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions.dates import day_path
from shelfmark.functions.paths import dir_name, path_parts
from shelfmark.operators.scanning import relative
from shelfmark.session import cut
from shelfmark.skew import hot_keys, salted_join


# Rounds in which ways are doubled whole: such trees are at most 32 deep.
_SHALLOW = 5
# In deeper trees about one folder in so many holds its whole way.
_APART = 128
_WAY = ("parts", "chain", "_pos")


def _above(climbing: DataFrame, ways: DataFrame, columns: list[str]) -> DataFrame:
    """Each way with that of the folder it leads to put before it."""
    above = ways.where(F.col("node_type") == "Folder").select(
        F.col("uri").alias("_up"), F.col("_up").alias("_next"), *[F.col(c).alias(f"_{c}") for c in _WAY]
    )
    return salted_join(climbing, above, ["_up"], "inner", spread=["uri"]).select(
        *columns, F.col("_next").alias("_up"), *[F.concat(f"_{c}", c).alias(c) for c in _WAY]
    )


def _climbed(known: DataFrame, columns: list[str], ends: Column, rounds: int | None = None) -> DataFrame | None:
    """The ways of `known` doubled until they end, or None where any is longer than `rounds` doublings."""
    closed = [known.where(ends)]
    while not (climbing := known.where(~ends)).isEmpty():
        if len(closed) - 1 == rounds:
            return None
        climbed = _above(climbing, known, columns)
        circles = F.coalesce(F.array_contains("chain", F.col("_up")), F.lit(False))
        climbed = cut(climbed.where(~circles))
        closed.append(climbed.where(ends))
        known = known.where(ends).unionByName(climbed)
    return reduce(DataFrame.unionByName, closed)


def node_closure(nodes: DataFrame) -> DataFrame:
    """Every node below the root with `parts`, `path`, `depth`, `chain`, `places`.

    `chain` holds the URIs from the root down and `places` the listing
    positions.  Each node knows its way up to its parent; a round appends the
    way known to where that ends, so ways double and a tree of depth d takes
    log2(d) rounds, however deep.  A way that leads to itself, to nothing or to
    what is no folder belongs to no tree.  A folder with a third of all nodes
    below it is spread by `salted_join`.

    In a deep tree ways written whole would take the square of its depth.
    There, ways end at the next of the folders that a hash picks; the whole
    ways are written for these folders alone and put before the others' as
    they are read.
    """
    top = F.col("_up").isNull()
    names = F.when(F.col("parent_uri").isNull(), F.array().cast("array<string>")).otherwise(F.array("name"))
    known = cut(nodes.withColumns({
        "_up": F.col("parent_uri"), "parts": names, "chain": F.array("uri"), "_pos": F.array(F.col("pos").cast("bigint")),
    }))
    found = _climbed(known, nodes.columns, top, _SHALLOW)
    if found is None:
        def picked(uri: str) -> Column:
            return F.xxhash64(uri) % _APART == 0

        pieces = _climbed(known, nodes.columns, top | picked("_up"))
        whole = _climbed(pieces.where(picked("uri") & (F.col("node_type") == "Folder")), nodes.columns, top)
        found = pieces.where(top).unionByName(_above(pieces.where(~top), whole, nodes.columns))
    places = F.zip_with("_pos", "chain", lambda pos, uri: F.struct(pos.alias("pos"), uri.alias("uri")))
    return found.select(
        *nodes.columns, "parts", (F.size("chain") - 1).alias("depth"), "chain", places.alias("places"), F.array_join("parts", "/").alias("path")
    )


def tree_order(closure: DataFrame) -> DataFrame:
    """Adds `is_last` among siblings; sorted by `places` it is depth-first order."""
    last = closure.where(F.col("parent_uri").isNotNull()).groupBy("parent_uri").agg(
        F.max(F.struct("pos", "uri")).alias("_last")
    )
    joined = salted_join(closure, last, ["parent_uri"], "left", spread=["uri"])
    return joined.withColumn(
        "is_last", F.coalesce(F.col("_last.uri") == F.col("uri"), F.lit(True))
    ).drop("_last")


def folder_contents(nodes: DataFrame) -> DataFrame:
    """Direct children of every folder: folders, albums and everything else."""
    kind = F.col("node_type")
    counts = nodes.where(F.col("parent_uri").isNotNull()).groupBy(F.col("parent_uri").alias("uri")).agg(
        F.count_if(kind == "Folder").alias("folders"),
        F.count_if(kind == "Album").alias("albums"),
        F.count_if(~kind.isin("Folder", "Album")).alias("pages"),
    )
    folders = nodes.where(kind == "Folder").select("uri", "name")
    return folders.join(counts, "uri", "left").na.fill(0, ["folders", "albums", "pages"])


def _by_path(closure: DataFrame) -> DataFrame:
    """Per path of names: how many folders and albums bear it, and one of each."""
    kind = F.col("node_type")
    node = F.struct("uri", "parent_uri", "name", "node_type")
    return closure.where(kind.isin("Folder", "Album")).groupBy(F.col("parts").alias("_prefix")).agg(
        F.count_if(kind == "Folder").alias("_folders"),
        F.count("*").alias("_nodes"),
        F.min_by(F.when(kind == "Folder", node), F.when(kind == "Folder", F.col("uri"))).alias("_folder"),
        F.min_by(node, "uri").alias("_node"),
    )


def resolve_paths(closure: DataFrame, requests: DataFrame, path: str = "path", key: str = "request_id") -> DataFrame:
    """Adds `status` (ok, missing, ambiguous, empty), `at` and `node`.

    Every part but the last must be one folder; `at` is the path up to the
    part that failed, or the whole path.
    """
    asked = requests.withColumn("_parts", path_parts(F.col(path)))
    levels = asked.where(F.size("_parts") > 0).select(
        key, "_parts", F.explode(F.sequence(F.lit(1), F.size("_parts"))).alias("_i")
    ).withColumn("_prefix", F.slice("_parts", F.lit(1), F.col("_i")))
    joined = salted_join(levels, _by_path(closure), ["_prefix"], "left", spread=[key])
    is_last = F.col("_i") == F.size("_parts")
    matches = F.coalesce(F.when(is_last, F.col("_nodes")).otherwise(F.col("_folders")), F.lit(0))
    judged = joined.withColumn("_matches", matches)
    failed = F.min(F.when(F.col("_matches") != 1, F.struct("_i", "_matches", "_prefix"))).alias("_failed")
    # A request has as many rows as its path has parts.
    found = judged.groupBy(key).agg(failed, F.max_by("_node", "_i").alias("node"))
    status = (
        F.when(F.size("_parts") == 0, "empty")
        .when(F.col("_failed").isNull(), "ok")
        .when(F.col("_failed._matches") == 0, "missing")
        .otherwise("ambiguous")
    )
    return asked.join(found, key, "left").withColumns({
        "status": status,
        "at": F.array_join(F.coalesce("_failed._prefix", "_parts"), "/"),
        "node": F.when(status == "ok", F.col("node")),
    }).drop("_parts", "_failed")


def _is_prefix(prefix: Column, parts: Column) -> Column:
    return F.slice(parts, F.lit(1), F.size(prefix)) == prefix


def _named_children(closure: DataFrame) -> DataFrame:
    return closure.where(F.col("parent_uri").isNotNull()).groupBy("parent_uri", "name").agg(F.count("*").alias("_named"))


def validate_moves(closure: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds `verdict` to (request_id, path, destination, kind); kind is
    folder, album or either.  The first problem found is reported."""
    target = resolve_paths(closure, requests).withColumnsRenamed({"status": "_status", "node": "_target"}).drop("at")
    root = closure.where(F.col("depth") == 0).select("uri")
    resolved = resolve_paths(closure, target, path="destination").withColumnsRenamed(
        {"status": "_to_status", "node": "_to"}
    ).drop("at")
    is_folder = F.col("_target.node_type") == "Folder"
    to_top = F.col("_to_status") == "empty"
    joined = resolved.withColumns({
        "_to_uri": F.when(to_top, root.agg(F.min("uri")).scalar()).otherwise(F.col("_to.uri")),
        "_name": F.col("_target.name"),
    })
    children = _named_children(closure).withColumnsRenamed({"parent_uri": "_to_uri", "name": "_name"})
    checked = salted_join(joined, children, ["_to_uri", "_name"], "left", spread=["request_id"])
    target_parts, to_parts = path_parts(F.col("path")), path_parts(F.col("destination"))
    verdict = (
        F.when(F.col("_status") != "ok", F.col("_status"))
        .when((F.col("kind") == "folder") & ~is_folder, "wrong kind")
        .when((F.col("kind") == "album") & is_folder, "wrong kind")
        .when(is_folder & _is_prefix(target_parts, to_parts), "into itself")
        .when(~to_top & (F.col("_to_status") != "ok"), F.concat(F.lit("destination "), F.col("_to_status")))
        .when(~to_top & (F.col("_to.node_type") != "Folder"), "destination wrong kind")
        .when(F.col("_target.parent_uri") == F.col("_to_uri"), "already there")
        .when(F.col("_named").isNotNull(), "name taken")
        .otherwise("ok")
    )
    return checked.withColumn("verdict", verdict).select(*requests.columns, "verdict")


def name_problem(name: Column) -> Column:
    return (
        F.when(name.rlike(r"(?U)^\s*$"), "name empty")
        .when(name.contains("/"), "name has a slash")
        .when(F.char_length(name) > C.MAX_NAME_CHARS, "name too long")
    )


def url_name_problem(url_name: Column) -> Column:
    valid = url_name.rlike(rf"^[A-Z][A-Za-z0-9-]{{0,{C.MAX_URL_NAME_CHARS - 1}}}\z")
    return F.when(~valid, "url name invalid")


def validate_renames(closure: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds `verdict` to (request_id, path, new_name, url_name)."""
    target = resolve_paths(closure, requests)
    keyed = target.withColumns({"_parent": F.col("node.parent_uri"), "_name": F.col("new_name")})
    children = _named_children(closure).withColumnsRenamed({"parent_uri": "_parent", "name": "_name"})
    checked = salted_join(keyed, children, ["_parent", "_name"], "left", spread=["request_id"])
    same = F.col("node.name") == F.col("new_name")
    others = F.coalesce(F.col("_named"), F.lit(0)) - F.when(same, 1).otherwise(0)
    verdict = F.coalesce(
        name_problem(F.col("new_name")),
        url_name_problem(F.col("url_name")),
        F.when(F.col("status") != "ok", F.col("status")),
        F.when(same & F.col("url_name").isNull(), F.lit("same name")),
        F.when(others > 0, "name taken"),
        F.lit("ok"),
    )
    return checked.withColumn("verdict", verdict).select(*requests.columns, "verdict")


def sort_drift(
    closure: DataFrame, path: str, folders_by: str | None = None, albums_by: str | None = None,
    direction: str = "asc", recursive: bool = False,
) -> DataFrame:
    """(path, node_type, sort_method, status) of what `path` reaches.

    Status is changed or already; a path or setting that does not fit gives
    one row saying so: empty, missing, ambiguous, needs a folder setting,
    needs an album setting.
    """
    if folders_by is None and albums_by is None:
        raise ValueError("say what to sort: folders, albums or both")
    wanted = {
        "Folder": C.FOLDER_SORTS[folders_by] if folders_by else None,
        "Album": C.ALBUM_SORTS[albums_by] if albums_by else None,
    }
    session = closure.sparkSession
    request = session.createDataFrame([(1, path)], "request_id int, path string")
    target = resolve_paths(closure, request).select("status", "at", "node")
    kind = F.col("node.node_type")
    problem = (
        F.when(F.col("status") != "ok", F.col("status"))
        .when((kind == "Folder") & F.lit(not recursive and folders_by is None), "needs a folder setting")
        .when((kind == "Album") & F.lit(albums_by is None), "needs an album setting")
    )
    stopped = target.withColumn("_problem", problem)
    parts = [p for p in path.split("/") if p]
    names = F.array(*[F.lit(p) for p in parts]).cast("array<string>")
    reached = _is_prefix(names, F.col("parts")) & (F.size("parts") >= len(parts))
    if not recursive:
        reached = reached & (F.size("parts") == len(parts))
    kind = F.col("node_type")
    method = F.when(kind == "Folder", F.lit(wanted["Folder"])).when(kind == "Album", F.lit(wanted["Album"]))
    current = F.col("sort_direction") if "sort_direction" in closure.columns else F.lit(C.DIRECTIONS["asc"])
    fits = (F.col("sort_method") == method) & (current == C.DIRECTIONS[direction])
    items = closure.where(
        reached & method.isNotNull() & stopped.agg(F.count_if(F.col("_problem").isNotNull()) == 0).scalar()
    ).select(
        "path", "node_type", "sort_method",
        F.when(F.coalesce(fits, F.lit(False)), "already").otherwise("changed").alias("status"),
    )
    errors = stopped.where(F.col("_problem").isNotNull()).select(
        F.col("at").alias("path"), F.col("node.node_type").alias("node_type"),
        F.lit(None).cast("string").alias("sort_method"), F.col("_problem").alias("status"),
    )
    return items.unionByName(errors)


def sort_drift_counts(drift: DataFrame) -> DataFrame:
    def count(kind: str, status: str) -> Column:
        return F.count_if((F.col("node_type") == kind) & (F.col("status") == status))

    return drift.agg(
        count("Folder", "changed").alias("folders_changed"),
        count("Folder", "already").alias("folders_already"),
        count("Album", "changed").alias("albums_changed"),
        count("Album", "already").alias("albums_already"),
    )


def plan_structure(files: DataFrame, root: str) -> DataFrame:
    """(path, kind, name, both): folders and albums that mirror the directories.

    A directory holding files is an album and its ancestors are folders; one
    that is both gives both rows.  Files in the root go to an album named
    after the root.
    """
    below = path_parts(relative(dir_name(F.col("path")), root))
    held = files.select(below.alias("_parts")).distinct()
    wanted = held.select(
        F.explode(
            F.transform(
                F.sequence(F.when(F.size("_parts") == 0, 0).otherwise(1), F.size("_parts")),
                lambda i: F.struct(
                    F.slice("_parts", F.lit(1), i).alias("parts"), (i == F.size("_parts")).alias("album")
                ),
            )
        ).alias("_d")
    )
    merged = wanted.groupBy(F.col("_d.parts").alias("parts")).agg(
        F.bool_or("_d.album").alias("_album"), F.bool_or(~F.col("_d.album")).alias("_folder")
    )
    kinds = F.filter(
        F.array(F.when(F.col("_folder"), "Folder"), F.when(F.col("_album"), "Album")), lambda k: k.isNotNull()
    )
    root_name = root.rstrip("/").rsplit("/", 1)[-1] or "Uploads"
    return merged.select(
        F.array_join("parts", "/").alias("path"),
        F.explode(kinds).alias("kind"),
        F.when(F.size("parts") == 0, root_name).otherwise(F.try_element_at("parts", F.lit(-1))).alias("name"),
        (F.col("_album") & F.col("_folder")).alias("both"),
    )


def missing_structure(wanted: DataFrame, closure: DataFrame) -> DataFrame:
    """Rows of a plan_structure result with no node of that path and kind yet."""
    existing = closure.select("path", F.col("node_type").alias("kind")).distinct()
    placed = wanted.withColumn("_at", F.when(F.col("path") == "", F.col("name")).otherwise(F.col("path")))
    return placed.join(existing.withColumnRenamed("path", "_at"), ["_at", "kind"], "left_anti").drop("_at")


def new_directories(dated: DataFrame, closure: DataFrame) -> DataFrame:
    """(path, depth): year and month folders and day albums not there yet."""
    days = dated.select("day").distinct()
    wanted = days.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.lit(3)),
                lambda i: F.struct(
                    F.array_join(F.slice(day_path(F.col("day")), F.lit(1), i), "/").alias("path"), i.alias("depth")
                ),
            )
        ).alias("_d")
    ).select("_d.*").distinct()
    return wanted.join(closure.select("path").distinct(), "path", "left_anti")
