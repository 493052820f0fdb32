"""Manifests that are never half written, and an unseal that one caller gets.

A store is a folder. Each state of the manifest is a version of its own, written aside and renamed into place; the latest
version counts, and none is ever changed. So whatever a crash interrupts, the manifest before it can be read. An unseal
begins by creating the claim, which the file system lets one caller do, with a record of who and when; it ends with the
version that says it is opened. If the evaluation fails the claim is given back. A claim that a crash left keeps others out
until someone who knows that its owner is gone abandons it; that of an opened manifest can't be.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from resight.operators import sealing
from resight.operators.sealing import Manifest, SealedError


class Store:
    """A folder in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _versions(self) -> list[str]:
        if not self._fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        return sorted(n for n in names if n.startswith("v") and n[1:].isdigit())

    def _text(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect())

    def write(self, manifest: Manifest) -> None:
        """The next version. Aside first: what is in place was written whole."""
        aside = f"_{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(asdict(manifest)),)], "value string").coalesce(1).write.text(f"{self.path}/{aside}")
        number = int(self._versions()[-1][1:]) + 1 if self._versions() else 0
        if not self._fs.rename(self._at(aside), self._at(f"v{number:06d}")):
            raise OSError(f"version {number} of {self.path} can't be put in place")

    def read(self) -> Manifest:
        if not (own := self._versions()):
            raise FileNotFoundError(self.path)
        return Manifest(**json.loads(self._text(own[-1])))

    def claim(self, who: str, when: str) -> bool:
        """Whether this caller has the claim now. It is created by one call that fails if it is there already."""
        at = self._at("claim")
        if self._fs.getScheme() == "file":  # Hadoop's local file system looks first and creates then; a folder is made at once
            self._fs.mkdirs(self._at(""))
            got = self.spark._jvm.java.io.File(at.toUri().getPath()).mkdir()
        else:
            try:
                self._fs.create(at, False).close()
                got = True
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise
                got = False
        if got:
            self.spark.createDataFrame([(json.dumps({"who": who, "when": when}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/intent")
        return got

    def claimed(self) -> dict | None:
        """Who has the claim; an empty record if that wasn't written any more."""
        if not self._fs.exists(self._at("claim")):
            return None
        return json.loads(self._text("intent")) if self._fs.exists(self._at("intent/_SUCCESS")) else {}

    def release(self) -> None:
        self._fs.delete(self._at("intent"), True)
        self._fs.delete(self._at("claim"), True)

    def abandon(self) -> None:
        """Give back the claim of a caller that is gone. Refused once the manifest is opened."""
        if self.read().opened:
            raise SealedError("opened: its claim stays")
        self.release()


def unseal(store: Store, splits: DataFrame, registry: DataFrame, evaluate: Callable[[], dict], date: str, who: str = "", prepare: Callable[[], None] = lambda: None) -> tuple[dict, Manifest]:
    """sealing.unseal_once for one caller of all: the others get SealedError, also while the first is at work."""
    if not store.claim(who, date):
        owner = store.claimed() or {}
        raise SealedError(f"opened, or being opened, by {owner.get('who', '')} since {owner.get('when', '')}")
    try:
        result, after = sealing.unseal_once(store.read(), splits, registry, evaluate, date, prepare)
        store.write(after)
    except BaseException:
        if not store.read().opened:
            store.release()
        raise
    return result, after
