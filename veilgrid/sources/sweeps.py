"""Sweeps over cells of parameters that continue where a killed run has stopped."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(path: str) -> str:
    """Where a sweep lists its finished cells: a folder in its tree that readers of the tree pass over."""
    return f"{path.rstrip('/')}/_finished"


def open_cells(cells: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """The cells that the tree's manifest doesn't list; nulls in keys are equal."""
    wanted = cells.select(*keys).distinct()
    wanted.limit(0).write.mode("ignore").parquet(manifest(path))
    done = cells.sparkSession.read.schema(wanted.schema).parquet(manifest(path)).select(*[F.col(k).alias(f"_vg_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_vg_{k}")) for k in keys]
    return wanted.join(done, same, "left_anti")


def sweep(cells: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, keys: Sequence[str], waves: int = 1, most: int | None = None) -> int:
    """Compute the open cells and write a folder for each; the number of waves that had work.

    A wave is the open cells of one hash value, so each is one job whatever its number of cells. Its results, rows with
    the keys, replace the cells' own folders only (dynamic overwrite); then its cells go on the manifest. A run that is
    killed in a wave has that wave's cells open still, written or not, and the next run writes them again. Cells
    without results are finished too. most: stop after so many waves with work. With keys alone to decide the results,
    two runs at once do no harm but the work twice.
    """
    worked = 0
    for wave in range(waves):
        todo = open_cells(cells, path, keys).where(F.pmod(F.xxhash64(*keys), F.lit(waves)) == wave)
        if todo.isEmpty():
            continue
        if most is not None and worked == most:
            break
        compute(todo).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
        todo.coalesce(1).write.mode("append").parquet(manifest(path))
        worked += 1
    return worked


def finished(path: str, results: DataFrame) -> DataFrame:
    """The tree's rows, read by the schema of results (a DataFrame of the same columns)."""
    return results.sparkSession.read.schema(results.schema).parquet(path)
