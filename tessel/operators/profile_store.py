"""A table of scoring profiles with versions: a change adds a row, the latest row of a name counts, presets never change.

One writer at a time; readers see whole versions, as each is a file of its own.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import profiles

ROW = "name string, version int, document string, is_preset boolean, is_active boolean, at double"


class Profiles:
    def __init__(self, spark: SparkSession, folder: str, now: Callable[[], float] = time.time):
        self.spark, self.folder, self.now = spark, folder, now

    def history(self) -> DataFrame:
        try:
            return self.spark.read.schema(ROW).parquet(self.folder)
        except AnalysisException:  # nothing has been written yet
            return self.spark.createDataFrame([], ROW)

    def latest(self, presets: bool = True) -> DataFrame:
        """The profiles that there are, each in its latest version."""
        rows = self.history().groupBy("name").agg(F.max_by(F.struct("*"), "version").alias("r")).select("r.*").where("is_active")
        return rows if presets else rows.where("not is_preset")

    def _row(self, name: str):
        return self.history().where(F.col("name") == name).orderBy(F.desc("version")).first()

    def _known(self, name: str, change: str):
        row = self._row(name)
        if row is None or not row["is_active"]:
            raise KeyError(f"there is no profile {name}")
        if row["is_preset"] and change:
            raise ValueError(f"{name} is a preset, so it cannot be {change}; duplicate it first")
        return row

    def _add(self, name: str, version: int, document: str, preset: bool = False, active: bool = True) -> int:
        self.spark.createDataFrame([(name, version, document, preset, active, float(self.now()))], ROW).coalesce(1).write.mode("append").parquet(self.folder)
        return version

    def seed(self) -> int:
        """Add the presets that are not there yet; how many."""
        there = {r[0] for r in self.history().where("is_preset").select("name").collect()}
        return sum(bool(self._add(n, 1, profiles.preset(n), preset=True)) for n in profiles.PRESETS if n not in there)

    def create(self, document: str) -> int:
        """A new profile, under the name that its document has; its version."""
        name = profiles.parsed(document)["name"]
        old = self._row(name)
        if old is not None and old["is_active"]:
            raise ValueError(f"there is a profile {name} already")
        return self._add(name, 1 if old is None else old["version"] + 1, document)

    def update(self, document: str) -> int:
        name = profiles.parsed(document)["name"]
        return self._add(name, self._known(name, "changed")["version"] + 1, document)

    def remove(self, name: str) -> int:
        row = self._known(name, "removed")
        return self._add(name, row["version"] + 1, row["document"], active=False)

    def duplicate(self, name: str, new: str) -> int:
        return self.create(json.dumps({**json.loads(self._known(name, "")["document"]), "name": new, "description": f"Copy of {name}"}))

    def score(self, name: str, version: int | None = None) -> Column:
        """The score of a profile's latest or named version, as a column."""
        if version is None:
            return profiles.compiled(self._known(name, "")["document"])
        row = self.history().where((F.col("name") == name) & (F.col("version") == version)).first()
        if row is None:
            raise KeyError(f"there is no version {version} of {name}")
        return profiles.compiled(row["document"])
