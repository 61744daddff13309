"""A commit ledger in shared storage: which runs are done, and what was fixed for them.

An entry is one small JSON file named by its key. It is written under another
name and then renamed without replacing, which the file system does as one
step, so an entry is there as a whole or not at all, and of two writers of one
key one wins and the other learns what stands. Entries are never changed.
Everything goes through Hadoop's file system interface, so the folder may be on
any storage that Spark reaches; only the driver reads or writes entries, a
few hundred bytes for each run.

Old entries are folded into snapshots (``compact``), so a ledger of many runs
is a few files: readers take the newest snapshot and the entries beside it.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_KEY = re.compile(r"[A-Za-z0-9_.=-]{1,200}")


class Ledger:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._at().getFileSystem(self._conf)

    def _names(self) -> list[str]:
        fs, root = self._fs(), self._at()
        return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []

    def _read(self, name: str) -> dict:
        stream = self._fs().open(self._at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _create(self, name: str, record: dict) -> bool:
        """Publish a file as a whole; False if one of that name stands already."""
        fs, draft = self._fs(), self._at(f"_draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(json.dumps(record, sort_keys=True).encode())
        stream.close()
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self._conf) \
                .rename(fs.makeQualified(draft), fs.makeQualified(self._at(name)), options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            fs.delete(draft, False)
            return False

    def commit(self, key: str, record: dict) -> dict:
        """Enter ``record`` under ``key`` unless there is an entry; what stands is returned."""
        if not _KEY.fullmatch(key):
            raise ValueError(f"not a ledger key: {key!r}")
        standing = self.get(key)
        if standing is not None or not self._create(f"{key}.json", record):
            return standing if standing is not None else self.get(key)
        return record

    def _looked(self, read: Callable[[list[str]], object], tries: int = 5):
        """``read`` of the listed names; listed anew when a compaction took one away meanwhile."""
        for left in range(tries - 1, -1, -1):
            try:
                return read(self._names())
            except Py4JJavaError as e:
                if not left or "FileNotFound" not in e.java_exception.getClass().getName():
                    raise

    def get(self, key: str) -> dict | None:
        return self._looked(lambda names: self._read(f"{key}.json") if f"{key}.json" in names else self._snapshot(names).get(key))

    def entries(self, prefix: str = "") -> dict[str, dict]:
        """All entries whose key starts with ``prefix``, in the order of their keys."""
        def read(names: list[str]) -> dict[str, dict]:
            found = {k: v for k, v in self._snapshot(names).items() if k.startswith(prefix)}
            return found | {n[:-5]: self._read(n) for n in names if n.endswith(".json") and n.startswith(prefix)}

        return dict(sorted(self._looked(read).items()))

    def keys(self, prefix: str = "") -> list[str]:
        """The keys alone: the files beside the snapshot are listed, not opened."""
        def read(names: list[str]) -> set[str]:
            known = {k for k in self._snapshot(names) if k.startswith(prefix)}
            return known | {n[:-5] for n in names if n.endswith(".json") and n.startswith(prefix)}

        return sorted(self._looked(read))

    def _snapshot(self, names: list[str]) -> dict[str, dict]:
        newest = max((n for n in names if n.startswith("_snapshot-")), default=None)
        return self._read(newest) if newest else {}

    def compact(self) -> None:
        """Fold the entries into one snapshot. A reader sees them in the
        snapshot, as files, or both, whenever it looks."""
        names = self._names()
        single = [n for n in names if n.endswith(".json")]
        old = sorted(n for n in names if n.startswith("_snapshot-"))
        if not single:
            return
        last = int(old[-1].split("-")[1]) if old else 0
        if self._create(f"_snapshot-{last + 1:012d}", self.entries()):
            fs = self._fs()
            for n in [*old, *single]:
                fs.delete(self._at(n), False)
