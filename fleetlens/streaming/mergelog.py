"""A log-structured sink for micro-batches: few folders, whatever the number of batches.

Every batch is written as a run of level 0; ``fan`` runs of a level are merged
into one of the next, so after n batches there are at most ``fan`` runs on each
of log(n) levels.  A run is written into a slot (folder) that neither the last
manifest nor the one before names, and becomes visible when the next manifest
version is complete, so

* readers see whole batches only, and the version before stays readable;
* a batch that is replayed after a failure is skipped if a version has it, and
  otherwise overwrites what was left of it;
* a merge that was interrupted is simply made again.

Manifest versions take turns in ``KEPT`` folders, each one file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = 4
_MANIFEST = "version long, runs int, level int, path string, last_batch long"


@dataclass(frozen=True)
class Run:
    level: int
    path: str


class MergeLog:
    """Runs below ``base``; ``merge`` must give the same for merged runs as for the runs they were merged from."""

    def __init__(self, spark: SparkSession, base: str, merge: Callable[[DataFrame], DataFrame], fan: int = 8,
                 write: Callable[[DataFrame, str], None] | None = None,
                 read: Callable[[list[str]], DataFrame] | None = None):
        self.spark, self.base, self.merge, self.fan = spark, base, merge, fan
        self._write = write or (lambda df, path: df.write.mode("overwrite").parquet(path))
        self._read = read or (lambda paths: spark.read.parquet(*paths))

    def _versions(self) -> dict[int, tuple[int, list[Run]]]:
        """Complete manifest versions: version -> (last batch, runs)."""
        try:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.base}/manifest").collect()  # a row per run
        except AnalysisException:       # nothing was written yet
            return {}
        found: dict[int, list] = {}
        for r in rows:
            found.setdefault(r.version, []).append(r)
        return {v: (own[0].last_batch, [Run(r.level, r.path) for r in own])
                for v, own in found.items() if len(own) == own[0].runs}

    def state(self) -> tuple[int, int, list[Run]]:
        """(version, last batch, runs) of the newest complete version."""
        found = self._versions()
        if not found:
            return 0, -1, []
        version = max(found)
        return version, *found[version]

    def _slot(self, level: int) -> str:
        """A folder that no readable version of the last two names."""
        found = self._versions()
        used = {r.path for v in sorted(found)[-2:] for r in found[v][1]}
        n = 0
        while (path := f"{self.base}/runs/level={level}/slot={n}") in used:
            n += 1
        return path

    def _commit(self, version: int, last: int, runs: list[Run]) -> None:
        rows = [(version, len(runs), r.level, r.path, last) for r in runs]
        (self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite")
         .parquet(f"{self.base}/manifest/turn={version % KEPT}"))

    def append(self, df: DataFrame, batch_id: int) -> None:
        """Adds a batch; a batch that is not newer than the last one is a replay and changes nothing."""
        version, last, runs = self.state()
        if batch_id > last:
            path = self._slot(0)
            self._write(df, path)
            self._commit(version + 1, batch_id, [*runs, Run(0, path)])
        self.compact()

    def compact(self) -> None:
        """Merges full levels, also those that an interrupted merge has left."""
        while True:
            version, last, runs = self.state()
            full = sorted(lv for lv in {r.level for r in runs} if sum(r.level == lv for r in runs) >= self.fan)
            if not full:
                return
            old = [r for r in runs if r.level == full[0]]
            path = self._slot(full[0] + 1)
            self._write(self.merge(self._read([r.path for r in old])), path)
            self._commit(version + 1, last, [r for r in runs if r not in old] + [Run(full[0] + 1, path)])

    def rows(self) -> DataFrame:
        """The rows of all runs (not merged with one another)."""
        return self._read([r.path for r in self.state()[2]])
