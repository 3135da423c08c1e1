"""Small JSON manifests that are replaced by one atomic rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from keyloom.runtime import hadoop_path


class CommitConflict(RuntimeError):
    """Another writer has published the version first."""


def _versions(spark: SparkSession, folder: str) -> list[int]:
    fs, p = hadoop_path(spark, folder)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v") and name.endswith(".json") and name[1:-5].isdigit():
            out.append(int(name[1:-5]))
    return sorted(out)


def read_manifest(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """The newest committed version and its content, or None."""
    versions = _versions(spark, folder)
    if not versions:
        return None
    fs, p = hadoop_path(spark, f"{folder}/v{versions[-1]:012d}.json")
    stream = fs.open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return versions[-1], json.loads(text)


def commit_manifest(spark: SparkSession, folder: str, version: int, content: dict) -> None:
    """Publish ``content`` as ``version``.

    The text is written beside and renamed; a rename onto a name that exists fails, so of two
    writers that both read version N only one can publish N + 1.
    """
    fs, tmp = hadoop_path(spark, f"{folder}/.tmp-{uuid.uuid4().hex}")
    _, final = hadoop_path(spark, f"{folder}/v{version:012d}.json")
    if fs.exists(final):
        raise CommitConflict(f"version {version} is already committed in {folder}")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if not fs.rename(tmp, final):
        fs.delete(tmp, False)
        raise CommitConflict(f"version {version} was committed by another writer in {folder}")
