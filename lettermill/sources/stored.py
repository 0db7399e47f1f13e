"""Stored message tables whose changes happen all at once.

A table is a folder of generations, `data/gen=.../folder=.../`, and of versions, `_versions/`. A version is
a small file that says in which generations each mail folder lives. A change writes its rows as a
new generation first, and then its version under the next number, by a rename that fails if there is
one: that is the change. Readers take the latest version, so they see all of a change or nothing of
it, also where several folders change and where a writer ends in between; what it left is never read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MESSAGE

#: Uids of one file's range: a folder's files hold neighbours, so uid ranges skip files.
FILE_UIDS = 1_000_000
APPENDED, REWRITTEN = "a-", "r-"  # how names of generations begin
GEN = T.StructField("gen", T.StringType())


class StoreError(RuntimeError):
    """A table that isn't there, is there already, or that others changed too often meanwhile."""


class Version:
    """Generations of all folders that aren't listed, and of the listed ones; a folder without any is
    empty. Folders are keys as JSON, so the null folder is one too."""

    def __init__(self, number: int, common: list[str], folders: dict[str, list[str]]):
        self.number, self.common, self.folders = number, common, folders

    def of(self, folder: str | None) -> list[str]:
        return self.folders.get(json.dumps(folder), self.common)

    def live(self) -> Column:
        """Whether a row of data/ counts: a test of partition columns only, so Spark prunes by it."""
        listed = [json.loads(k) for k in self.folders]
        name = F.col("folder")
        elsewhere = ~F.coalesce(name.isin([x for x in listed if x is not None]), F.lit(False)) & ~(name.isNull() if None in listed else F.lit(False))
        test = F.col("gen").isin(self.common) & elsewhere
        by_generations: dict[tuple[str, ...], list[str | None]] = {}
        for key, generations in self.folders.items():
            by_generations.setdefault(tuple(generations), []).append(json.loads(key))
        for generations, names in by_generations.items():
            here = F.coalesce(name.isin([x for x in names if x is not None]), F.lit(False)) | (name.isNull() if None in names else F.lit(False))
            test = test | F.col("gen").isin(list(generations)) & here
        return test

    def generations(self) -> set[str]:
        return {g for each in (self.common, *self.folders.values()) for g in each}


class Store:
    """The table at a path. Folder names are strings whatever they look like; the empty name is null."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self._fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self) -> bool:
        return bool(self.numbers())

    def numbers(self) -> list[int]:
        """The versions there are."""
        at = self._path("_versions")
        if not self._files.exists(at):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit())

    def version(self, number: int | None = None) -> Version:
        found = self.numbers()
        if not found or number is not None and number not in found:
            raise StoreError(f"no version {'' if number is None else number} at {self.path}")
        number = found[-1] if number is None else number
        told = json.loads(self.spark.read.text(f"{self.path}/_versions/{number:020d}", wholetext=True).first()[0])
        return Version(number, told["common"], told["folders"])

    def read(self, number: int | None = None) -> DataFrame:
        """The latest version, or an earlier one that wasn't cleared away."""
        return self._rows(self.version(number))

    def _rows(self, version: Version) -> DataFrame:
        if not version.generations():
            return self.spark.createDataFrame([], MESSAGE)
        every = self.spark.read.schema(T.StructType([*MESSAGE.fields, GEN])).parquet(f"{self.path}/data")
        return every.where(version.live()).drop("gen")

    def has_folder(self, folder: str | None) -> bool:
        """Also where it is empty, if a change emptied it or `add_folder` made it."""
        now = self.version()
        if json.dumps(folder) in now.folders:
            return True
        return any(folder in self._folders_of(g) for g in now.common)

    def add_folder(self, folder: str, tries: int = 20) -> int:
        """Makes an empty folder, if there is none of this name."""
        for _ in range(tries):
            now = self.version()
            if self.has_folder(folder):
                return now.number
            if self._publish(Version(now.number + 1, now.common, {**now.folders, json.dumps(folder): []})):
                return now.number + 1
        raise StoreError("others changed the table meanwhile, again and again")

    def create(self, messages: DataFrame) -> int:
        if self.exists():
            raise StoreError(f"there is a table at {self.path} already")
        gen = self._stage(messages, APPENDED)
        if not self._publish(Version(1, [gen], {})):
            raise StoreError(f"there is a table at {self.path} already")
        return 1

    def append(self, messages: DataFrame, tries: int = 20) -> int:
        """Adds messages of any folders. Appends and others' changes go together, so the rows are
        written once however often the version must be put on top of a newer one."""
        gen = self._stage(messages, APPENDED)
        for _ in range(tries):
            now = self.version()
            if self._publish(Version(now.number + 1, [*now.common, gen], {k: [*g, gen] for k, g in now.folders.items()})):
                return now.number + 1
        raise StoreError("others changed the table meanwhile, again and again")

    def replace(self, make: Callable[[DataFrame], DataFrame], folders: Iterable[str | None], tries: int = 20) -> int:
        """Rewrites some folders, all at once: make gets their rows and gives new ones, which must be of
        these folders. Where others changed one of them meanwhile, it is called again on what there is then."""
        folders = list(dict.fromkeys(folders))
        now, gen = self.version(), None
        for _ in range(tries):
            if gen is None:
                seen = {f: now.of(f) for f in folders}
                test = F.coalesce(F.col("folder").isin([f for f in folders if f is not None]), F.lit(False)) | (F.col("folder").isNull() if None in folders else F.lit(False))
                gen = self._stage(make(self._rows(now).where(test)), REWRITTEN)
                has = self._folders_of(gen)
                if has - set(folders):
                    self._drop(gen)
                    raise StoreError(f"rows of other folders than {folders}: {sorted(map(str, has - set(folders)))}")
            fresh = {json.dumps(f): [gen] if f in has else [] for f in folders}
            if self._publish(Version(now.number + 1, now.common, {**now.folders, **fresh})):
                return now.number + 1
            now = self.version()
            if any(now.of(f) != seen[f] for f in folders):
                self._drop(gen)
                gen = None
        raise StoreError("others changed the folders meanwhile, again and again")

    def vacuum(self, keep: int = 1, hours: float = 24) -> int:
        """Deletes versions but for the last `keep`, and generations that no kept version has and that
        have been there for some hours (a writer may be about to publish younger ones); how many of these."""
        numbers = self.numbers()
        used = {g for n in numbers[-keep:] for g in self.version(n).generations()}
        before, gone = (time.time() - hours * 3600) * 1000, 0
        for n in numbers[:-keep]:
            self._files.delete(self._path(f"_versions/{n:020d}"), False)
        at = self._path("data")
        for status in self._files.listStatus(at) if self._files.exists(at) else ():
            name = status.getPath().getName().removeprefix("gen=")
            if name not in used and status.getModificationTime() <= before:
                self._drop(name)
                gone += 1
        return gone

    def _stage(self, messages: DataFrame, kind: str) -> str:
        """Writes rows as a generation that no version has yet. Large folders have many files."""
        gen = kind + uuid.uuid4().hex
        fields = {f.name: f.dataType for f in MESSAGE.fields}
        rows = messages.select(*((F.col(c) if c in messages.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields.items()))
        rows = rows.repartition("folder", F.floor(F.col("uid") / FILE_UIDS)).sortWithinPartitions("folder", "uid")
        rows.write.partitionBy("folder").parquet(f"{self.path}/data/gen={gen}")
        return gen

    def _folders_of(self, gen: str) -> set[str | None]:
        at = self._path(f"data/gen={gen}")
        names = [status.getPath().getName() for status in self._files.listStatus(at)] if self._files.exists(at) else []
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        found = {unescape(n.removeprefix("folder=")) for n in names if n.startswith("folder=")}
        return {None if n == "__HIVE_DEFAULT_PARTITION__" else n for n in found}

    def _drop(self, gen: str) -> None:
        self._files.delete(self._path(f"data/gen={gen}"), True)

    def _publish(self, version: Version) -> bool:
        """Makes a version the latest one; False where its number is taken."""
        staged, final = self._path(f"_versions/.{uuid.uuid4().hex}"), self._path(f"_versions/{version.number:020d}")
        out = self._files.create(staged, False)
        out.write(bytearray(json.dumps({"common": version.common, "folders": version.folders}).encode()))
        out.close()
        context = self._fs.FileContext.getFileContext(staged.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(staged, final, self.spark._sc._gateway.new_array(self._fs.Options.Rename, 0))  # fails if there is one
        except Py4JJavaError as error:
            self._files.delete(staged, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True
