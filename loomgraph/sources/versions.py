"""Versions of a set of tables: each is a small list of the folders that hold its tables.

A commit writes new folders and then one list, which appears whole or not at all; tables that didn't change share their
folders with the version before.  A clone is a branch that starts from such a list, so it shares all folders; a wipe takes
a branch away, and with it the folders that no list names any more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Broken(ValueError):
    """Rows that a rule forbids; nothing was committed."""


class Versions:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self._paths(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in self._files.listStatus(place)) if self._files.exists(place) else []

    def branches(self) -> list[str]:
        return self._names("lists")

    def last(self, branch: str = "main") -> int:
        """The number of a branch's last version; 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in self._names(f"lists/{branch}") if n.endswith(".json") and n[0] != "."), default=0)

    def _list(self, branch: str, version: int | None) -> dict:
        version = self.last(branch) if version is None else version
        if version == 0:
            return {"tables": {}, "note": None}
        return json.loads(self.spark.read.text(f"{self.root}/lists/{branch}/{version}.json", wholetext=True).first().value)

    def _put(self, branch: str, version: int, found: dict) -> None:
        """Write a list beside its place and move it there, which fails if another commit was first."""
        folder = f"{self.root}/lists/{branch}"
        self._files.mkdirs(self._paths(folder))
        beside, place = self._paths(f"{folder}/.{uuid.uuid4().hex}"), self._paths(f"{folder}/{version}.json")
        out = self._files.create(beside)
        out.write(bytearray(json.dumps(found).encode()))
        out.close()
        if self._files.exists(place) or not self._files.rename(beside, place):
            self._files.delete(beside, False)
            raise RuntimeError(f"version {version} of {branch} was committed meanwhile")

    def note(self, branch: str = "main", version: int | None = None) -> str | None:
        return self._list(branch, version)["note"]

    def tables(self, branch: str = "main", version: int | None = None) -> list[str]:
        return sorted(self._list(branch, version)["tables"])

    def folders(self, branch: str = "main", version: int | None = None) -> dict[str, str]:
        return {n: t["folder"] for n, t in self._list(branch, version)["tables"].items()}

    def read(self, name: str, branch: str = "main", version: int | None = None) -> DataFrame:
        found = self._list(branch, version)["tables"][name]
        return self.spark.read.schema(StructType.fromJson(found["schema"])).parquet(f"{self.root}/data/{found['folder']}")

    def commit(self, changed: Mapping[str, DataFrame | None], branch: str = "main", note: str | None = None,
               rules: Mapping[str, Mapping[str, Column]] | None = None) -> int:
        """Write the changed tables (None takes one out) as the branch's next version; its number.

        rules holds for each table what must hold for each row (null holds); broken rows are counted while they are
        written, in the same pass, and if there are any nothing is committed.  A note that the last version bears already
        means that the same commit came before: nothing is done.
        """
        base = self.last(branch)
        before = self._list(branch, base)
        if note is not None and before["note"] == note:
            return base
        found, broken = dict(before["tables"]), {}
        for name, df in changed.items():
            if df is None:
                found.pop(name, None)
                continue
            folder, checks = f"{name}-{uuid.uuid4().hex}", (rules or {}).get(name)
            if checks:
                seen = Observation()
                df = df.observe(seen, *[F.count_if(~holds).alias(rule) for rule, holds in checks.items()])
            df.write.parquet(f"{self.root}/data/{folder}")
            if checks:
                broken |= {f"{name}: {rule}": n for rule, n in seen.get.items() if n}
            found[name] = {"folder": folder, "schema": json.loads(df.schema.json())}
        if broken:
            self._sweep()
            raise Broken(", ".join(f"{rule} ({n} rows)" for rule, n in sorted(broken.items())))
        self._put(branch, base + 1, {"tables": found, "note": note})
        return base + 1

    def clone(self, to: str, branch: str = "main", version: int | None = None) -> int:
        """A new branch with the tables of a version, none of them copied."""
        if to in self.branches():
            raise ValueError(f"there is a branch {to}")
        self._put(to, 1, self._list(branch, version) | {"note": None})
        return 1

    def wipe(self, branch: str) -> None:
        """Take a branch away, and the folders that only it named."""
        self._files.delete(self._paths(f"{self.root}/lists/{branch}"), True)
        self._sweep()

    def _sweep(self) -> None:
        """Delete folders that no list names; no commit may be on its way."""
        named = {f for b in self.branches() for n in self._names(f"lists/{b}") if n[0] != "." for f in self.folders(b, int(n.removesuffix(".json"))).values()}
        for folder in set(self._names("data")) - named:
            self._files.delete(self._paths(f"{self.root}/data/{folder}"), True)
