"""Which files of an inventory count: types, hidden names, exclusions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions.media import is_supported
from shelfmark.functions.paths import dir_name
from shelfmark.session import cut
from shelfmark.skew import salted_join


def merge_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """Overlapping sources list a path once."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources).dropDuplicates(["path"])


def sort_dedup_paths(files: DataFrame) -> DataFrame:
    return files.dropDuplicates(["path"]).orderBy("path")


def filter_supported(files: DataFrame) -> DataFrame:
    return files.where(is_supported(F.col("path")))


def count_unsupported(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count_if(is_supported(F.col("path"))).alias("supported"),
        F.count_if(~is_supported(F.col("path"))).alias("unsupported"),
    )


def relative(path: Column, root: str) -> Column:
    """`path` below its source; empty for the source itself."""
    return F.regexp_extract(path, f"(?s)^{_literal(root.rstrip('/') + '/')}(.*)$", 1)


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9@/])", r"\\\1", text)


_HIDDEN_OR_SYSTEM = rf"(^|/)(\.|({'|'.join(_literal(n) for n in C.SYSTEM_DIRECTORIES)})/)"


def is_hidden_or_system(relative_path: Column) -> Column:
    return relative_path.rlike(_HIDDEN_OR_SYSTEM)


def filter_hidden_and_system(files: DataFrame, root: str) -> DataFrame:
    return files.where(~is_hidden_or_system(relative(F.col("path"), root)))


def glob_to_regex(glob: str) -> str:
    """The body of a .gitignore glob as a Java regular expression."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i) and i + 2 == len(glob) and i and glob[i - 1] == "/":
            out.append(".+")
            i += 2
        elif glob[i] == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out.append("[^/]*")
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        elif glob[i] == "[" and "]" in glob[i + 2:]:
            end = glob.index("]", i + 2)
            members = glob[i + 1:end]
            negated = members[:1] in ("!", "^")
            body = re.sub(r"([\\\[\]^&])", r"\\\1", members[1:] if negated else members)
            out.append(f"(?!/)[{'^' if negated else ''}{body}]")
            i = end + 1
        else:
            if glob[i] == "\\" and i + 1 < len(glob):
                i += 1
            out.append(re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", glob[i]))
            i += 1
    return "".join(out)


def parse_ignore_line(line: str, excluding: bool = False) -> tuple[str, bool, bool] | None:
    """(regex over the path relative to the pattern's directory, negated, directories only).

    With `excluding` the line is a pattern given by the caller: it can
    neither be a comment nor re-include.
    """
    text = line.rstrip("\r\n")
    while text.endswith(" ") and not text.endswith("\\ "):
        text = text[:-1]
    if not text or (text.startswith("#") and not excluding):
        return None
    negated = text.startswith("!") and not excluding
    text = text[1:] if negated else text
    only_directories = text.endswith("/")
    text = text.rstrip("/") if only_directories else text
    anchored = "/" in text
    text = text.removeprefix("/")
    if not text:
        return None
    return ("" if anchored else "(?:.*/)?") + glob_to_regex(text), negated, only_directories


def exclude_condition(relative_path: Column, patterns: Sequence[str]) -> Column:
    """Whether a file, or a directory above it, matches one of `patterns`."""
    bodies = []
    for pattern in patterns:
        parsed = parse_ignore_line(pattern, excluding=True)
        if parsed:
            bodies.append(f"{parsed[0]}{'/' if parsed[2] else '(?:/|$)'}")
    return relative_path.rlike(f"(?s)^(?:{'|'.join(bodies)})") if bodies else F.lit(False)


def filter_excludes(files: DataFrame, patterns: Sequence[str], root: str) -> DataFrame:
    return files.where(~exclude_condition(relative(F.col("path"), root), patterns))


def compile_ignore_rules(lines: DataFrame) -> DataFrame:
    """(dir, seq, line) -> (dir, seq, regex, negate, only_directories)."""
    def compiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (d, s, f"(?s)^{parsed[0]}$", parsed[1], parsed[2])
                for d, s, line in zip(batch["dir"], batch["seq"], batch["line"])
                if (parsed := parse_ignore_line(line))
            ]
            yield pd.DataFrame(rows, columns=["dir", "seq", "regex", "negate", "only_directories"])

    return lines.select("dir", F.col("seq").cast("int"), "line").mapInPandas(
        compiled, "dir string, seq int, regex string, negate boolean, only_directories boolean"
    )


def _ancestors(directory: Column) -> Column:
    """Every directory from the top down to `directory` itself."""
    parts = F.split(directory, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )


def rule_nodes(directories: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_dir, node) and (node, chain): of each directory the nearest one at or above it that has rules,
    and of each of these its rules and those of all such above it, from the top down.

    A directory carries no rules, only where they are: as many rows are written as there are
    directories and directories with rules.
    """
    rule = F.struct("seq", "regex", "negate", "only_directories")
    by_dir = cut(rules.groupBy("dir").agg(F.sort_array(F.collect_list(rule)).alias("rules")), "rules")
    above = directories.select("_dir", F.posexplode(_ancestors(F.col("_dir"))).alias("depth", "dir"))
    ruled = salted_join(above, by_dir.select("dir"), ["dir"], "left_semi", spread=["_dir"])
    pointers = cut(ruled.groupBy("_dir").agg(F.max_by("dir", "depth").alias("node")), "rule-nodes")
    lines = by_dir.select(F.col("dir").alias("node"), F.posexplode(_ancestors(F.col("dir"))).alias("depth", "dir"))
    chains = (
        salted_join(lines, by_dir, ["dir"], "inner", spread=["node"])
        .groupBy("node").agg(F.sort_array(F.collect_list(F.struct("depth", "dir", "rules"))).alias("chain"))
    )
    return pointers, cut(chains, "ignore-rules")


def filter_ignore_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Apply per-directory rules (see `compile_ignore_rules`) below their directory.

    The deepest directory with a matching rule decides, by its last match.
    Nothing below an ignored directory comes back, as it is never entered.
    The rules reach a file by equi joins on directories: only directories are
    expanded to their ancestors, never files, and rules are kept once for each
    directory that has any.
    """
    located = files.withColumn("_dir", dir_name(F.col("path")))
    holding = cut(located.select("_dir").distinct(), "directories")
    directories = cut(holding.select(F.explode(_ancestors(F.col("_dir"))).alias("_dir")).distinct(), "directories")
    above = directories.select("_dir", F.explode(_ancestors(F.col("_dir"))).alias("dir"))
    pointers, by_node = rule_nodes(directories, rules)
    # All directories may have their rules from one at the top.
    chains = salted_join(pointers, by_node, ["node"], "inner", spread=["_dir"]).select("_dir", "chain")

    def ignored(path: Column, is_directory: bool) -> Column:
        def deciding(level: Column) -> Column:
            below = path.substr(F.length(level["dir"]) + 2, F.length(path))
            matching = F.filter(
                level["rules"],
                lambda r: F.rlike(below, r["regex"]) & (F.lit(is_directory) | ~r["only_directories"]),
            )
            return F.try_element_at(matching, F.lit(-1))["negate"]

        verdicts = F.filter(F.transform(F.col("chain"), deciding), lambda v: v.isNotNull())
        return ~F.coalesce(F.try_element_at(verdicts, F.lit(-1)), F.lit(True))

    # A directory is judged by the rules above it, so by its parent's chain.
    pruned = (
        directories.select(F.col("_dir").alias("directory"), dir_name(F.col("_dir")).alias("_dir"))
        .where(F.col("directory").contains("/"))
        .transform(lambda d: salted_join(d, chains, ["_dir"], "inner", spread=["directory"]))
        .where(ignored(F.col("directory"), True))
        .select(F.col("directory").alias("dir"))
    )
    closed = (
        salted_join(above.select("_dir", "dir"), pruned, ["dir"], "left_semi", spread=["_dir"])
        .select("_dir").distinct()
    )
    per_dir = (
        holding.join(closed.withColumn("closed", F.lit(True)), "_dir", "left")
        .join(chains, "_dir", "left")
        .where(F.col("closed").isNotNull() | F.col("chain").isNotNull())
    )
    judged = salted_join(located, per_dir, ["_dir"], "left", spread=["path"])
    gone = F.col("closed").isNotNull() | (F.col("chain").isNotNull() & ignored(F.col("path"), False))
    return judged.where(~gone).select(*files.columns)
