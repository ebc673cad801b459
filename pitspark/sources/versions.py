"""Tables kept as versions: a commit is one manifest, created only if absent.

    <root>/data/<id>/...           Parquet files of one version, never changed
    <root>/manifests/00000007.json {"version": 7, "base": 6, "data": "<id>", ...}

A writer reads a version, writes the next one's data beside it and then claims its number. If another
writer was faster the claim fails, and ``update`` computes the change again on what the other wrote, so no commit
is lost and none is overwritten. Readers keep the manifest they began with.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class NoVersion(FileNotFoundError):
    """The table has no committed version."""


@dataclass(frozen=True)
class Snapshot:
    """A committed version; reading it is not affected by later commits."""

    root: str
    version: int
    data: str
    base: int
    info: dict = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/data/{self.data}")


def local_path(root: str) -> Path:
    """The folder as the driver sees it. Manifests need an atomic create, which a mounted file system has."""
    if "://" in root and not root.startswith("file://"):
        raise ValueError(f"manifests need a mounted folder, not {root}")
    return Path(root.removeprefix("file://").removeprefix("file:"))


def _create_once(path: Path, text: str) -> bool:
    """Create a whole file unless it exists; a link either appears with all its content or fails."""
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_name(f".{uuid.uuid4().hex}")
    draft.write_text(text)
    try:
        os.link(draft, path)
    except FileExistsError:
        return False
    finally:
        draft.unlink()
    return True


def history(root: str) -> list[int]:
    """Numbers of the committed versions that were not expired, ascending."""
    return sorted(int(p.stem) for p in (local_path(root) / "manifests").glob("[0-9]*.json"))


def snapshot(root: str, version: int | None = None) -> Snapshot:
    """The latest version, or the one with this number."""
    if version is None:
        known = history(root)
        if not known:
            raise NoVersion(f"no committed version below {root}")
        version = known[-1]
    path = local_path(root) / "manifests" / f"{version:08d}.json"
    if not path.exists():
        raise NoVersion(f"version {version} of {root} is not there")
    told = json.loads(path.read_text())
    return Snapshot(root, told["version"], told["data"], told["base"], told["info"])


def commit(
    df: DataFrame, root: str, base: int, partition_by: list[str] | None = None, info: dict | None = None,
) -> Snapshot:
    """Write ``df`` as the version after ``base`` (0 for a new table); raise ``Conflict`` if that number is taken."""
    data = uuid.uuid4().hex
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/data/{data}")
    manifest = {"version": base + 1, "base": base, "data": data, "info": info or {}}
    if not _create_once(local_path(root) / "manifests" / f"{base + 1:08d}.json", json.dumps(manifest)):
        shutil.rmtree(local_path(root) / "data" / data, ignore_errors=True)
        raise Conflict(f"version {base + 1} of {root} was committed by another writer")
    return Snapshot(root, base + 1, data, base, info or {})


def update(
    spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame],
    partition_by: list[str] | None = None, info: dict | None = None, attempts: int = 20,
) -> Snapshot:
    """Commit ``change`` of the latest version; after a conflict it is computed again on the new one.

    ``change`` gets None for a table without a version.
    """
    for attempt in range(attempts):
        try:
            base = snapshot(root)
        except NoVersion:
            base = None
        try:
            return commit(change(base.read(spark) if base else None), root, base.version if base else 0, partition_by, info)
        except Conflict:
            time.sleep(min(1.0, 0.01 * 2**attempt))
    raise Conflict(f"{root}: {attempts} attempts met other writers each time")


def expire(root: str, keep: int = 2) -> list[int]:
    """Delete all but the ``keep`` latest versions; return their numbers.

    A reader pinned to a deleted version fails, so ``keep`` must cover the longest read. The manifest of the latest
    version always stays, so its number is never given twice.
    """
    known = history(root)
    gone = known[:-max(1, keep)]
    for version in gone:
        old = snapshot(root, version)
        (local_path(root) / "manifests" / f"{version:08d}.json").unlink()
        shutil.rmtree(local_path(root) / "data" / old.data, ignore_errors=True)
    return gone


def versions_table(spark: SparkSession, root: str) -> DataFrame:
    """(version, base, data, info) of the committed versions."""
    rows = [(s.version, s.base, s.data, json.dumps(s.info)) for s in (snapshot(root, v) for v in history(root))]
    return spark.createDataFrame(rows, "version int, base int, data string, info string").orderBy(F.col("version"))
