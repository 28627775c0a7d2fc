"""Tables that are rewritten as a whole while others read them.

A version is written in full under a folder of its own. It becomes the current
one by a single small file ``versions/<number>`` that names the folder and is
created once: a reader sees the version before or the version after, never a
half-written one, and of two writers that started from the same version the
second one fails instead of losing the first one's changes."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from . import fs


class ConcurrentUpdate(RuntimeError):
    pass


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> tuple[int, str | None]:
        """Number and folder of the current version; (0, None) before the first."""
        done = fs.names(self.spark, f"{self.root}/versions")
        if not done:
            return 0, None
        return int(done[-1]), f"{self.root}/data/{fs.read_text(self.spark, f'{self.root}/versions/{done[-1]}')}"

    def commit(self, base: int, write: Callable[[str], None]) -> str:
        """Write the version after ``base`` with ``write(folder)`` and switch
        to it. What a failed or overtaken writer leaves is never read."""
        name = f"{base + 1:012d}-{uuid.uuid4().hex[:12]}"
        path = f"{self.root}/data/{name}"
        write(path)
        if not fs.create_once(self.spark, f"{self.root}/versions/{base + 1:012d}", name):
            fs.delete(self.spark, path)
            raise ConcurrentUpdate(f"version {base + 1} of {self.root} was written meanwhile")
        return path

    def prune(self, keep: int = 2) -> None:
        """Remove all but the newest ``keep`` versions, and what failed writers
        left up to the current one."""
        done = fs.names(self.spark, f"{self.root}/versions")[-keep:]
        if not done:
            return
        held = {fs.read_text(self.spark, f"{self.root}/versions/{n}") for n in done}
        for name in fs.names(self.spark, f"{self.root}/data"):
            if name not in held and name.split("-")[0] <= done[-1]:
                fs.delete(self.spark, f"{self.root}/data/{name}")
        for n in fs.names(self.spark, f"{self.root}/versions"):
            if n < done[0]:
                fs.delete(self.spark, f"{self.root}/versions/{n}")
