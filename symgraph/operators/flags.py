"""Compiler flags over tables of log lines, build files and configurations.

The rules are those of ``compdb``, applied row by row; what is one set over
many rows (options of all commands, the first command of a file, files and
their arguments) is grouped and joined here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph import compdb
from symgraph.operators.ingest import last_writer
from symgraph.storage import stored


def _each(rows: DataFrame, make: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that ``make`` gives for each row's values."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([new for row in batch.itertuples(index=False, name=None) for new in make(*row)], columns=names)

    return rows.mapInPandas(run, schema)


def commands(lines: DataFrame) -> DataFrame:
    """(at, words) of the clang commands in log lines (at, line)."""
    return _each(lines.select("at", "line"), lambda at, line: ((at, words) for words in compdb.compile_commands_in([line])), f"at {lines.schema['at'].dataType.simpleString()}, words array<string>")


def options(found: DataFrame) -> DataFrame:
    """(kind, value) of all commands, each once; include folders within a toolchain are system ones, and its own system folders are left out.

    The toolchain's root is the least of those that the commands name.
    """

    def make(words) -> Iterator[tuple]:
        flags = compdb.classify([list(words)])
        for kind, values in (("target", flags.targets), ("sysroot", flags.sysroots), ("define", flags.defines), ("standard", flags.standards), ("extra", flags.extra), ("root", [flags.ndk_root] if flags.ndk_root else [])):
            yield from ((kind, v) for v in values)
        rest = list(words)[1:]
        yield from (("include" if name == "-I" else "system", value) for name, value in compdb.options(rest, ("-isystem", "-I")))

    rows = stored(_each(found.select("words"), make, "kind string, value string").distinct(), "options")
    root = rows.where("kind = 'root'").agg(F.min("value")).first()[0]
    inside = F.startswith("value", F.lit(root)) if root else F.lit(False)
    kept = rows.where(~((F.col("kind") == "system") & inside) & ((F.col("kind") != "root") | (F.col("value") == root)))
    return kept.select(F.when((F.col("kind") == "include") & inside, "system").otherwise(F.col("kind")).alias("kind"), "value").distinct()


def configuration(of_log: DataFrame) -> DataFrame:
    """One row with the configuration of a log's options: lists sorted, single values the least."""
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value"))))
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("value")))
    row = of_log.agg(
        least("root").alias("ndk_root"), least("target").alias("target"), F.coalesce(least("standard"), F.lit("c++17")).alias("cpp_standard"), listed("include").alias("project_include_paths"),
        listed("system").alias("extra_system_includes"), listed("define").alias("defines"), listed("extra").alias("extra_compile_args"),
    )
    return row.withColumns({"target_arch": target_arch("target"), "api_level": api_level("target")}).drop("target")


def target_arch(triple) -> Column:
    """The architecture that a target triple begins with; aarch64 where none does."""
    triple = F.col(triple) if isinstance(triple, str) else triple
    out = F.lit("aarch64")
    for prefix, arch in reversed(compdb.TRIPLE_PREFIXES.items()):
        out = F.when(F.startswith(triple, F.lit(prefix)), arch).otherwise(out)
    return out


def api_level(triple) -> Column:
    """The number at a target triple's end, or the default."""
    digits = F.regexp_extract(triple, r"(\d+)$", 1)
    return F.when(F.length(digits) > 0, digits.cast("int")).otherwise(F.lit(compdb.DEFAULT_API))


def entries(lines: DataFrame, folder: str) -> DataFrame:
    """(file, directory, arguments) of a compilation database from log lines (at, line): the first command of a file counts."""

    def make(at, line) -> Iterator[tuple]:
        for entry in compdb.database_of_log([line], folder):
            yield at, entry["file"], entry["directory"], entry["arguments"]

    rows = _each(lines.select("at", "line"), make, f"at {lines.schema['at'].dataType.simpleString()}, file string, directory string, arguments array<string>")
    return rows.groupBy("file").agg(F.min_by(F.struct("directory", "arguments"), "at").alias("first")).select("file", "first.directory", "first.arguments")


def database(rows: DataFrame) -> DataFrame:
    """(file, arguments) of compilation database entries (at, directory, file, arguments, command): cleaned, by absolute file; the last entry of a file counts."""

    def make(at, directory, file, arguments, command) -> Iterator[tuple]:
        found = compdb.cleaned_entry(directory or "", file or "", None if arguments is None else list(arguments), command or "")
        if found:
            yield (at, *found)

    cleaned = _each(rows.select("at", "directory", "file", "arguments", "command"), make, f"at {rows.schema['at'].dataType.simpleString()}, file string, arguments array<string>")
    return last_writer(cleaned, ["file"], ["at"]).drop("at")


def matched(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, arguments, matched) of files (path, absolute): those that a database (file, arguments) lacks have no arguments."""
    return files.join(known.select(F.col("file").alias("path"), "arguments"), "path", "left").select("path", "arguments", F.col("arguments").isNotNull().alias("matched"))


def match_counts(found: DataFrame) -> DataFrame:
    """(matched, unmatched) of ``matched``."""
    return found.agg(F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"))


def arguments(configurations: DataFrame, host: str = "linux-x86_64") -> DataFrame:
    """(id, arguments) of configurations (id, ndk_root, target_arch, api_level, cpp_standard, project_include_paths, extra_system_includes, defines, extra_compile_args), for the parser."""
    names = ("ndk_root", "target_arch", "api_level", "cpp_standard", "project_include_paths", "extra_system_includes", "defines", "extra_compile_args")

    def make(key, *values) -> Iterator[tuple]:
        config = {k: list(v) if isinstance(v, np.ndarray) else v for k, v in zip(names, values, strict=True)}
        yield key, compdb.final_arguments(compdb.build_arguments(config, host, exists=lambda path: True), [])

    return _each(configurations.select("id", *names), make, f"id {configurations.schema['id'].dataType.simpleString()}, arguments array<string>")


def make_values(texts: DataFrame, top: str) -> DataFrame:
    """(file, kind, value) of makefiles (file, folder, text): include, unresolved, define."""

    def make(file, folder, text) -> Iterator[tuple]:
        found, bad = compdb.make_includes(text or "", folder, top)
        for kind, values in (("include", found), ("unresolved", bad), ("define", compdb.defines(text or ""))):
            yield from ((file, kind, v) for v in values)

    return _each(texts.select("file", "folder", "text"), make, "file string, kind string, value string")


def blueprint_values(texts: DataFrame, root: str) -> DataFrame:
    """(file, kind, value) of blueprint files (file, folder, text): include, define."""

    def make(file, folder, text) -> Iterator[tuple]:
        for kind, values in (("include", compdb.blueprint_includes(text or "", folder, root)), ("define", compdb.defines(text or "", blueprint=True))):
            yield from ((file, kind, v) for v in values)

    return _each(texts.select("file", "folder", "text"), make, "file string, kind string, value string")


def faults(configurations: DataFrame, exists: Callable[[str], bool]) -> DataFrame:
    """(id, fault) of configurations (id, ndk_root, target_arch, api_level) that are not valid."""

    def make(key, ndk_root, target_arch, api_level) -> Iterator[tuple]:
        level = api_level.item() if hasattr(api_level, "item") else api_level
        yield from ((key, x) for x in compdb.validate({"ndk_root": ndk_root, "target_arch": target_arch, "api_level": level}, exists))

    return _each(configurations.select("id", "ndk_root", "target_arch", "api_level"), make, f"id {configurations.schema['id'].dataType.simpleString()}, fault string")
