"""Dependency names of project manifests, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def names(file: Column, text: Column) -> Column:
    """Sorted names in a package.json, requirements.txt, pyproject.toml, Gemfile or go.mod; empty for other files."""
    base = F.regexp_extract(file, r"([^/\\]+)$", 1)
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    section = lambda key: F.coalesce(F.map_keys(F.from_json(F.get_json_object(text, f"$.{key}"), "map<string,string>")), F.array().cast("array<string>"))
    block = F.regexp_extract(text, r"(?s)(?:^|\n)dependencies\s*=\s*\[(.*?)\n?\]", 1)
    found = (
        F.when(base == "package.json", F.concat(section("dependencies"), section("devDependencies")))
        .when(base.rlike(r"^requirements.*\.txt$"), every(r"(?m)^\s*([A-Za-z0-9][A-Za-z0-9._-]*)"))
        .when(base == "pyproject.toml", F.regexp_extract_all(block, F.lit(r"[\"']([A-Za-z0-9][A-Za-z0-9._-]*)"), F.lit(1)))
        .when(base == "Gemfile", every(r"(?m)^\s*gem\s+[\"']([^\"']+)"))
        .when(base == "go.mod", every(r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+v"))
    )
    return F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>"))


def dependencies(files: DataFrame) -> DataFrame:
    """(file, dependency) of (file, text) rows."""
    return files.select("file", F.explode(names(F.col("file"), F.coalesce("text", F.lit("")))).alias("dependency"))
