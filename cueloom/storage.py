"""Folders that the driver and all executors share, and a commit protocol for files that tasks write there.

A task writes into a folder of its own, part-<id>. Nothing is moved when a job ends: the driver writes one
small file, _committed-<id>, with the names of the parts that belong to the result, so a failed,
killed or repeated task leaves nothing that a reader sees. Readers go by these lists; a folder
without any was written by something else, and all its files count but those in parts of tasks.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

#: What opening a file costs, in bytes.
OPEN = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir; a local session that names none gets a folder of its own."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/cueloom-{uuid.uuid4().hex}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URL, and the path in it."""
    if re.match(r"file:/(?!/)", path):  # as Hadoop writes it
        path = path.replace("file:", "file://", 1)
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def new_part(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path and name of a new part of the folder."""
    store, root = opened(path)
    name = f"part-{uuid.uuid4().hex}"
    store.create_dir(f"{root}/{name}")
    return store, f"{root}/{name}", name


def _lists(store: fs.FileSystem, root: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("_committed-"))


def commit(path: str, parts: list[str], overwrite: bool) -> None:
    """Makes these parts visible, all at once; with overwrite, in place of all that was there."""
    store, root = opened(path)
    before = _lists(store, root) if overwrite else []
    store.create_dir(root)
    name = f"{root}/_committed-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{name}.tmp") as f:
        f.write(json.dumps(parts).encode())
    store.move(f"{name}.tmp", name)
    for old in before:
        with store.open_input_stream(old) as f:
            gone = json.loads(f.read())
        store.delete_file(old)
        for part in gone:
            store.delete_dir(f"{root}/{part}")


def discard(path: str, parts: list[str]) -> None:
    store, root = opened(path)
    for part in parts:
        if store.get_file_info(f"{root}/{part}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{part}")


def visible(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The files of a folder that committed jobs wrote, in the order of their paths; of any other folder all files; or one file."""
    store, root = opened(path)
    if store.get_file_info(root).type == fs.FileType.File:
        return store, [store.get_file_info(root)]
    lists = [x for x in _lists(store, root) if not x.endswith(".tmp")]
    folders = [root]
    if lists:
        folders = []
        for name in lists:
            with store.open_input_stream(name) as f:
                folders += [f"{root}/{part}" for part in json.loads(f.read())]
    files = [f for folder in folders for f in store.get_file_info(fs.FileSelector(folder, recursive=True)) if f.type == fs.FileType.File]
    if not lists:  # parts of a first job that hasn't ended, or never did
        files = [f for f in files if not re.search(r"/part-[0-9a-f]{32}/", f.path[len(root.rstrip("/")) :])]
    return store, sorted((f for f in files if not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


def packed(files: list[tuple[str, int]], size: int) -> list[list[tuple[str, int]]]:
    """The files in groups of about `size` bytes; a larger one is alone."""
    out: list[list[tuple[str, int]]] = []
    room = -1
    for name, n in files:
        n += OPEN
        if room < n or not out:
            out.append([])
            room = size
        out[-1].append((name, n - OPEN))
        room -= n
    return out
