"""Changed files of a local git tree, as a DataFrame of paths; runs git on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def _git(root: str, *arguments: str) -> list[str]:
    done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, check=True)
    return [line for line in done.stdout.split("\n") if line]


def fork_point(root: str, *branches: str) -> str | None:
    """The newest merge base of HEAD with any of the branches that exist."""
    bases = []
    for branch in branches:
        try:
            bases += _git(root, "merge-base", "HEAD", branch)[:1]
        except subprocess.CalledProcessError:
            continue
    return max(bases, key=lambda c: int(_git(root, "show", "-s", "--format=%ct", c)[0]), default=None)


def changed_files(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """(file) added or modified since a commit (or in the working tree), and untracked."""
    found = set(_git(root, "diff", "--name-only", "--diff-filter=AM", since or "HEAD")) | set(_git(root, "ls-files", "--others", "--exclude-standard"))
    return spark.createDataFrame([(p,) for p in sorted(found)], "file string")
