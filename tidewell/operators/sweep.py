"""Sweeps over configurations that go on where they were stopped.

A sweep has stages; a stage depends on some keys of a configuration and on the stages before it. Each result is a table named by a hash of
the stage, of what it depends on, and of a version; a table counts as done once Spark has committed it. Configurations that agree in a
stage's keys share its table, in this run or a later one, and a sweep that was killed finds what is done and computes the
rest.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.io import exists


@dataclass(frozen=True)
class Stage:
    name: str
    keys: tuple[str, ...]  #: of the configuration, beside those of the stages before
    run: Callable[[dict, list[DataFrame]], DataFrame]  #: (configuration, tables of the stages before) -> table
    version: str = "1"  #: a new one makes old tables void


@dataclass
class Sweep:
    spark: SparkSession
    root: str
    stages: list[Stage]
    computed: list[tuple[str, dict]] = field(default_factory=list)  #: stages of this run, in their order

    def path(self, config: dict, depth: int) -> str:
        """Where the result of stage number depth lies for this configuration."""
        on = [[s.name, s.version, {k: config[k] for k in s.keys}] for s in self.stages[: depth + 1]]
        return f"{self.root}/{self.stages[depth].name}/{hashlib.sha256(json.dumps(on, sort_keys=True).encode()).hexdigest()[:24]}"

    def done(self, config: dict, depth: int = -1) -> bool:
        return exists(self.spark, f"{self.path(config, range(len(self.stages))[depth])}/_SUCCESS")

    def pending(self, configs: list[dict]) -> list[dict]:
        return [c for c in configs if not self.done(c)]

    def run(self, configs: list[dict]) -> DataFrame:
        """The last stage's tables of all configurations, with their keys as columns. Those not yet done are computed, one after the other."""
        for config in self.pending(configs):
            tables: list[DataFrame] = []
            for depth, stage in enumerate(self.stages):
                path = self.path(config, depth)
                if not self.done(config, depth):
                    stage.run(config, tables).write.mode("overwrite").parquet(path)
                    self.computed.append((stage.name, config))
                tables.append(self.spark.read.parquet(path))
        return self.results(configs)

    def results(self, configs: list[dict]) -> DataFrame:
        """What is done of these configurations."""
        tables = [self.spark.read.parquet(self.path(c, len(self.stages) - 1)).withColumns({k: F.lit(v) for k, v in c.items()}) for c in configs if self.done(c)]
        if not tables:
            raise ValueError("no configuration is done yet")
        return reduce(DataFrame.unionByName, tables)


def grid(**values: list) -> list[dict]:
    """All combinations, the last key changing fastest."""
    out: list[dict] = [{}]
    for name, options in values.items():
        out = [{**c, name: v} for c in out for v in options]
    return out
