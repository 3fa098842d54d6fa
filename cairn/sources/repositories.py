"""Cloning of public repositories by the git program, on the driver."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.paths import repository_address
from cairn.sources.files import walk


class CloneFailed(Exception):
    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind


def clone_failure(message):
    """not_public, not_found or clone_failed, by what git says; a column."""
    said = F.lower(message)
    return (
        F.when(said.rlike("authentication failed|could not read username|permission denied"), "not_public")
        .when(said.rlike("repository not found|not found"), "not_found")
        .otherwise("clone_failed")
    )


def git(*args: str, cwd: str | None = None, timeout: float = 120, hooks: str = "/dev/null") -> str:
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_CONFIG")} | {"GIT_TERMINAL_PROMPT": "0"}
    done = subprocess.run(["git", "-c", f"core.hooksPath={hooks}", *args], cwd=cwd, env=env, capture_output=True, text=True, timeout=timeout)
    if done.returncode:
        raise CloneFailed(done.stderr)
    return done.stdout.strip()


def load_repository(spark: SparkSession, url: str, workspace: str = "workspace", timeout: float = 120) -> DataFrame:
    """One row about a clone of the address: made if missing, reused if its origin is the same address."""
    if timeout <= 0:
        raise ValueError("timeout must be positive")
    address = spark.range(1).select(repository_address(F.lit(url)).alias("a")).first()["a"]
    if not address["accepted"]:
        raise ValueError("only addresses of repository roots are taken")
    root = Path(workspace).resolve()
    root.mkdir(parents=True, exist_ok=True)
    to = root / f"{address['owner']}__{address['repo']}"
    reused = to.exists()
    if reused:
        origin = re.sub(r"\.git$", "", git("remote", "get-url", "origin", cwd=str(to)))
        if origin.casefold() != address["normalized"].casefold():
            raise ValueError("the folder holds another repository")
    else:
        with tempfile.TemporaryDirectory() as hooks:
            try:
                git("clone", "--depth", "1", address["normalized"], str(to), timeout=timeout, hooks=hooks)
            except (CloneFailed, subprocess.TimeoutExpired):
                shutil.rmtree(to, ignore_errors=True)
                raise
    sizes = [size for outcome, _, size, _ in walk(str(to), frozenset({".git"})) if outcome == "file"]
    branch = git("rev-parse", "--abbrev-ref", "HEAD", cwd=str(to))
    row = (True, address["owner"], address["repo"], address["normalized"], str(to), None if branch == "HEAD" else branch, git("rev-parse", "HEAD", cwd=str(to)), len(sizes), sum(sizes), reused)
    return spark.createDataFrame(
        [row],
        "success boolean, owner string, repository_name string, repo_url string, local_path string, branch string, current_commit string, total_files bigint, repository_size_bytes bigint, reused_existing_clone boolean",
    )
