"""Files of a git revision as the table of files (S16, H14): read by git in tasks, never checked out."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..sources import git


def git_root(folder: str | Path = ".") -> Path:
    return Path(subprocess.run(["git", "-C", str(folder), "rev-parse", "--show-toplevel"], check=True, capture_output=True, text=True).stdout.strip())


def package_root() -> Path:
    """The folder that holds this package."""
    return Path(__file__).resolve().parents[2]


def files_of(spark: SparkSession, ref: str, folder: str | Path, root: str | Path | None = None) -> DataFrame:
    """Files below `folder` as they were at `ref`; EMPTY, or an id of zeros only, is an empty tree. The folder must lie in the repository."""
    root = Path(root) if root is not None else git_root()
    target = Path(folder).resolve()
    if not target.is_relative_to(root.resolve()):
        raise ValueError(f"{folder} is not in the git repository")
    below = target.relative_to(root.resolve()).as_posix()
    git.register(spark)
    options = {"repository": str(root.resolve()), "revision": ref, "folder": "" if below == "." else below}
    return spark.read.format("git_files").options(**options).load()
