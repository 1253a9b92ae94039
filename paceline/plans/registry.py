"""Metrics as plug-ins: what they need, how they score a run, how they are run together."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rooms import Room

Tables = dict[str, DataFrame]


@dataclass
class Metric:
    name: str
    score: Callable[[Tables, Room], DataFrame]  # run_id, score
    needs: tuple[str, ...] = ()


@dataclass
class Registry:
    """Metrics by name and the derived tables that they share."""

    metrics: dict[str, Metric] = field(default_factory=dict)
    derived: dict[str, tuple[Callable[[Tables, Room], DataFrame], tuple[str, ...]]] = field(default_factory=dict)

    def metric(self, name: str, needs: Iterable[str] = ()):
        def add(f):
            self.metrics[name] = Metric(name, f, tuple(needs))
            return f

        return add

    def table(self, name: str, needs: Iterable[str] = ()):
        def add(f):
            self.derived[name] = (f, tuple(needs))
            return f

        return add

    def needed(self, enabled: Iterable[str]) -> list[str]:
        """Derived tables that the enabled metrics need, each after what it needs itself."""
        out: list[str] = []

        def visit(name: str) -> None:
            if name in self.derived and name not in out:
                for x in self.derived[name][1]:
                    visit(x)
                out.append(name)

        for m in enabled:
            for x in self.metrics[m].needs:
                visit(x)
        return out

    def users(self, name: str, chosen: Iterable[str]) -> int:
        """How many of the enabled metrics and of the derived tables that they need ask for a table."""
        asked = [self.metrics[m].needs for m in chosen] + [self.derived[t][1] for t in self.needed(chosen)]
        return sum(name in needs for needs in asked)

    def run(self, tables: Tables, room: Room, enabled: Iterable[str] | None = None, folder: str | None = None) -> DataFrame:
        """run_id, metric, score of every enabled metric.

        With a `folder` that all executors share, positions and each derived table that
        several ask for are computed once, written there and read back.
        """
        chosen = list(self.metrics if enabled is None else enabled)
        tables = dict(tables)
        for name in self.needed(chosen):
            tables[name] = self.derived[name][0](tables, room)
            if folder and self.users(name, chosen) > 1:
                tables[name] = stored(tables[name], f"{folder}/{name}")
        parts = [self.metrics[m].score(tables, room).select("run_id", F.lit(m).alias("metric"), "score") for m in chosen]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def stored(rows: DataFrame, path: str) -> DataFrame:
    """The rows as they are in Parquet files at `path`."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def unprocessed(runs: DataFrame, done: DataFrame) -> DataFrame:
    """Runs that the sink does not hold yet."""
    return runs.join(done.select("run_id").distinct(), "run_id", "left_anti")


def assessment(metrics: DataFrame, name: str) -> DataFrame:
    """The rows of one metric; `name` without regard to case."""
    return metrics.where(F.lower("metric") == name.lower())
