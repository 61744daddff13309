"""Versions of a model in shared storage (K4, S9), and exact updates of it (M3, L2).

A version is two small Parquet tables in a folder of its own: the state
(coefficients, scalers of features and targets, roles, the fitted preparation)
and the merged statistics behind it. It counts once its entry is in the ledger;
that entry is the last thing written, so a reader finds a whole version or the
one before. The entry also says which batch of each stream was taken in last,
so a batch that comes again is known as such, whatever the day.

Two writers that build on the same version collide on the next number; the one
that loses merges its statistics into the winner's version. Statistics merge
exactly in any order, so nothing is lost and nothing counts twice.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators import linear
from .ledger import Ledger

STATE = "part string, target string, name string, value double, spread double, text string"


@dataclass
class ModelState:
    """What scoring needs, and the statistics that further batches merge into."""
    coefs: dict[str, dict[str, float]] = field(default_factory=dict)
    scaler: dict[str, tuple[float, float]] = field(default_factory=dict)
    target_scaler: dict[str, tuple[float, float]] = field(default_factory=dict)
    roles: str | None = None
    preparation: str | None = None
    features: list[str] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    statistics: DataFrame | None = None
    version: int = -1
    applied: dict[str, int] = field(default_factory=dict)

    def rows(self) -> list[tuple]:
        """The state as rows of ``STATE``, without the statistics."""
        out = [("coefficient", t, term, v, None, None) for t, cs in self.coefs.items() for term, v in cs.items()]
        for part, scaler in (("scaler", self.scaler), ("target_scaler", self.target_scaler)):
            out += [(part, None, c, None if m is None else float(m), None if s is None else float(s), None)
                    for c, (m, s) in scaler.items()]
        out += [("feature", None, c, float(i), None, None) for i, c in enumerate(self.features)]
        out += [("target", None, c, float(i), None, None) for i, c in enumerate(self.targets)]
        return out + [(part, None, None, None, None, text) for part, text in
                      (("roles", self.roles), ("preparation", self.preparation)) if text is not None]

    @staticmethod
    def from_rows(rows) -> "ModelState":
        out = ModelState()
        for r in sorted(rows, key=lambda r: (r["part"], r["value"] if r["part"] in ("feature", "target") else 0)):
            if r["part"] == "coefficient":
                out.coefs.setdefault(r["target"], {})[r["name"]] = r["value"]
            elif r["part"] in ("scaler", "target_scaler"):
                getattr(out, r["part"])[r["name"]] = (r["value"], r["spread"])
            elif r["part"] in ("feature", "target"):
                getattr(out, f"{r['part']}s").append(r["name"])
            else:
                setattr(out, r["part"], r["text"])
        return out


class ModelLog:
    """The versions of one model under a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.ledger = Ledger(spark, f"{self.path}/_versions")

    def versions(self) -> list[int]:
        return [int(k) for k in self.ledger.keys()]

    def load(self, version: int | None = None) -> ModelState | None:
        """A version, the newest by default; None if there is none yet."""
        known = self.versions()
        if version is None and known:
            version = known[-1]
        entry = self.ledger.get(f"{version:012d}") if version in known else None
        if entry is None:
            return None
        folder = f"{self.path}/{entry['folder']}"
        state = ModelState.from_rows(self.spark.read.schema(STATE).parquet(f"{folder}/state").collect())  # model size
        state.version, state.applied = version, entry["applied"]
        if entry["statistics"]:
            state.statistics = self.spark.read.schema(linear.STATE).parquet(f"{folder}/statistics")
        return state

    def publish(self, state: ModelState, version: int | None = None) -> int | None:
        """Write ``state`` as the version after its own (or as ``version``);
        None if another writer has published that one."""
        version = state.version + 1 if version is None else version
        folder = f"version-{version}-{uuid.uuid4().hex}"
        self.spark.createDataFrame(state.rows(), STATE).coalesce(1).write.parquet(f"{self.path}/{folder}/state")
        if state.statistics is not None:
            state.statistics.coalesce(1).write.parquet(f"{self.path}/{folder}/statistics")
        entry = {"folder": folder, "applied": state.applied, "statistics": state.statistics is not None}
        return version if self.ledger.commit(f"{version:012d}", entry) == entry else None

    def update(self, batch: DataFrame, features: list[str], targets: list[str], stream: str, batch_id: int,
               ridge: float = 0.0, start: ModelState | None = None) -> ModelState:
        """Take a batch of prepared rows into the newest version and publish the
        result; a batch that was taken in already changes nothing. ``start``
        gives what a first version takes over (roles, scalers, preparation)."""
        from ..session import written

        stats = None
        while True:
            base = self.load() or replace(start or ModelState(), version=-1)
            if base.applied.get(stream, -1) >= batch_id:
                return base
            if stats is None:
                stats = written(self.spark, linear.gram_stats(batch, features, targets), "batch-statistics")
            merged = stats if base.statistics is None else linear.merge_stats(base.statistics, stats)
            merged = written(self.spark, merged, "merged-statistics")
            rows = merged.collect()  # model size
            new = replace(base, features=features, targets=targets, statistics=merged, applied=base.applied | {stream: batch_id},
                          coefs=linear.solve(rows, features, targets, ridge) if rows else base.coefs)
            version = self.publish(new)
            if version is not None:
                return replace(new, version=version)

    def drop_before(self, version: int) -> None:
        """Remove the tables of versions before ``version``; the newest stays."""
        fs = self.ledger._fs()
        for key in [k for k in self.ledger.keys()[:-1] if int(k) < version]:
            fs.delete(self.ledger._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.ledger.get(key)['folder']}"), True)
        self.ledger.compact()


def state_table(spark: SparkSession, state: ModelState) -> DataFrame:
    """The state as a table (``STATE``)."""
    return spark.createDataFrame(state.rows(), STATE)


class TableLog:
    """Versions of one table (a vocabulary, categories) under a folder, published as model versions are."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.ledger = Ledger(spark, f"{self.path}/_versions")

    def publish(self, table: DataFrame) -> DataFrame:
        """Write ``table`` as the next version and read it back."""
        folder = f"{self.path}/version-{uuid.uuid4().hex}"
        table.write.parquet(folder)
        entry = {"folder": folder.rsplit("/", 1)[1], "schema": table.schema.json()}
        number = max(map(int, self.ledger.keys()), default=-1) + 1
        while self.ledger.commit(f"{number:012d}", entry) != entry:
            number += 1
        return self.load(number)

    def load(self, version: int | None = None) -> DataFrame | None:
        known = self.ledger.keys()
        key = f"{version:012d}" if version is not None else known[-1] if known else None
        entry = self.ledger.get(key) if key in known else None
        if entry is None:
            return None
        schema = StructType.fromJson(json.loads(entry["schema"]))
        return self.spark.read.schema(schema).parquet(f"{self.path}/{entry['folder']}")
