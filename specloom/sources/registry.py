"""Known specification versions and the checkout of a source tree."""

from __future__ import annotations

import subprocess
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Version(NamedTuple):
    version: str
    date: str
    commit_hash: str
    tag: str


_DATES = {
    "2.4": "2026-04-01", "2.3": "2025-12-01", "2.2": "2025-09-22", "2.1": "2024-09-26", "2.0": "2024-01-24", "1.4": "2023-11-06", "1.3": "2023-03-30", "1.2": "2022-11-15",
    "1.1": "2022-09-12", "1.0": "2021-12-24", "0.8": "2021-11-11", "0.7": "2021-09-12",
}
#: A version whose tag is missing is checked out by commit.
_COMMITS = {"2.3": "38e492b037ccabd48bff9f2b9bd1169371c2b057"}
VERSIONS = tuple(Version(v, d, _COMMITS.get(v, ""), _COMMITS[v][:8] if v in _COMMITS else v) for v, d in _DATES.items())


def list_versions() -> list[Version]:
    """All versions, newest first."""
    return list(VERSIONS)


def get_version(version: str) -> Version:
    """A version by its exact name; KeyError for any other."""
    for v in VERSIONS:
        if v.version == version:
            return v
    raise KeyError(f"{version!r} is none of the versions {', '.join(v.version for v in VERSIONS)}")


def version_table(spark: SparkSession) -> DataFrame:
    """The registry as a dimension table; ``ord`` 0 is the newest."""
    return spark.createDataFrame([(*v, i) for i, v in enumerate(VERSIONS)], "version string, date string, commit_hash string, tag string, ord int")


def _git(repo: str | Path, *arguments: str) -> str:
    return subprocess.run(["git", "-C", str(repo), *arguments], check=True, capture_output=True, encoding="utf-8").stdout.strip()


def checkout(repo: str | Path, version: str) -> None:
    """Check a source tree out at a version's tag; ValueError for an unknown one."""
    try:
        tag = get_version(version).tag
    except KeyError as e:
        raise ValueError(e.args[0]) from None
    _git(repo, "checkout", tag)


def current_version(repo: str | Path) -> str:
    """Tag that a source tree is at."""
    return _git(repo, *"describe --tags --exact-match".split())
