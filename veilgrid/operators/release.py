"""Releases: noised roots and what is derived from them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import draws
from ..functions import mechanisms as N
from ..functions.dialect import DUCK, SPARK, Dialect
from ..plans.catalog import DEFAULT_DOMAIN, Template, templates
from .derive import class_sql, layered_sql, with_derived

SECRET = "veil"
#: In the key of a private release, besides what it is a release of: releases at another budget or by another law are
#: independent draws, as two that share a uniform would give the value away together.
INDEPENDENT = ("eps_root",)


def release_sql(d: Dialect, mechanism: str, keys: tuple[str, ...], draw: str | None = None, paired: bool = True) -> tuple[str, str]:
    """SQL of the noised grid index, and of its value from the column idx, over rows (value, lo, hi, eps_root).

    Without `draw` in the key, the release is cached: it is the same however often it is asked for. paired: one
    uniform serves all budgets and mechanisms of a value, as experiments that compare them want it.
    """
    key = (f"'{SECRET}'", *keys, *([draw] if draw else []), *(() if paired else (f"'{mechanism}'", *INDEPENDENT)))
    t = N.grid_position(d, "value", "lo", "hi")
    return N.noise_index(d, mechanism, t, "eps_root", *key), N.value_of(d, "idx", "lo", "hi")


def release(rows: DataFrame, mechanism: str, keys: tuple[str, ...] = ("template", "root", "patient_id"), draw: str | None = None, paired: bool = False) -> DataFrame:
    """rows (value, lo, hi, eps_root, keys) with the noised grid index `idx` and its value `released`.

    Releases at different budgets or by different mechanisms are independent unless `paired`, which is for experiments
    only: paired releases of one value aren't private together.
    """
    key = (f"'{SECRET}'", *keys, *([draw] if draw else []), *(() if paired else (f"'{mechanism}'", *INDEPENDENT)))
    grid = {"_vg_t": N.grid_position(SPARK, "value", "lo", "hi"), "_vg_u": SPARK.uniform(*key)}
    value, budget, layers, index = N.steps(SPARK, mechanism, "_vg_t", "eps_root", "_vg_u", "_vg")
    out = rows
    for columns in (grid, value | budget, *layers, {"idx": index}, {"released": N.value_of(SPARK, "idx", "lo", "hi")}):
        out = out.withColumns({c: F.expr(x) for c, x in columns.items()})
    return out.drop(*grid, *value, *budget, *(c for columns in layers for c in columns))


def budget_sql(d: Dialect, eps: float | str) -> str:
    return eps if isinstance(eps, str) else d.num(eps)


def released_columns(df: DataFrame, template: Template, eps: dict[str, float | str], mechanism: str, keys: tuple[str, ...], prefix: str = "r_") -> DataFrame:
    """A wide release: one noised column per root of the template and the derived columns from these; no shuffle.

    eps: a number for each root, or the name of the column that has it.
    """
    columns: dict[str, Column] = {}
    for root in template.roots:
        lo, hi = (SPARK.num(x) for x in template.domains[root])
        t = N.grid_position(SPARK, f"`{root}`", lo, hi)
        index = N.noise_index(SPARK, mechanism, t, budget_sql(SPARK, eps[root]), f"'{SECRET}'", f"'{root}'", *keys)
        columns[prefix + root] = F.expr(N.value_of(SPARK, f"({index})", lo, hi))
    return with_derived(df.withColumns(columns), template, {r: f"`{prefix}{r}`" for r in template.roots}, prefix)


def released_columns_sql(base: str, template: Template, eps: dict[str, float | str], mechanism: str, keys: tuple[str, ...], prefix: str = "r_") -> str:
    columns = []
    for root in template.roots:
        lo, hi = (DUCK.num(x) for x in template.domains[root])
        t = N.grid_position(DUCK, f'"{root}"', lo, hi)
        index = N.noise_index(DUCK, mechanism, t, budget_sql(DUCK, eps[root]), f"'{SECRET}'", f"'{root}'", *keys)
        columns.append(f'{N.value_of(DUCK, f"({index})", lo, hi)} AS "{prefix}{root}"')
    return layered_sql(f"(SELECT *, {', '.join(columns)} FROM {base})", template, names={r: f'"{prefix}{r}"' for r in template.roots}, prefix=prefix)


def targets(long: DataFrame, by: tuple[str, ...], value: str = "value", name: str = "target", **more: str) -> DataFrame:
    """(template, by, name, name_class): the target and class of every template, from rows (template, by, root, value).

    more: further names with the columns they come from. Roots become columns in one aggregate, and every template's
    nodes are derived on its rows; those of other templates are null there.
    """
    pairs = {name: value} | more
    roots = sorted({r for t in templates().values() for r in t.roots})
    columns = [F.max(F.when(F.col("root") == r, F.col(v))).alias(f"_{n}_{r}") for n, v in pairs.items() for r in roots]
    out = long.groupBy("template", *by).agg(*columns)
    results = []
    for n in pairs:
        target, kind = F.lit(None).cast("double"), F.lit(None).cast("int")
        for t in templates().values():
            out = with_derived(out, t, {r: f"`_{n}_{r}`" for r in t.roots}, f"_{n}_")
            column = f"`_{n}_{t.target}`"
            target = F.when(F.col("template") == t.name, F.col(column)).otherwise(target)
            kind = F.when(F.col("template") == t.name, F.expr(class_sql(SPARK, t, column))).otherwise(kind)
        results += [target.alias(n), kind.alias(f"{n}_class")]
    return out.select("template", *by, *results)


def targets_sql(long: str, by: tuple[str, ...], value: str = "value", name: str = "target") -> str:
    parts = []
    for t in templates().values():
        columns = ", ".join(f"max(CASE WHEN root = '{r}' THEN {value} END) AS \"{r}\"" for r in t.roots)
        keys = ", ".join(("template", *by))
        w = layered_sql(f"(SELECT {keys}, {columns} FROM {long} WHERE template = '{t.name}' GROUP BY {keys})", t)
        parts.append(f'SELECT {keys}, "{t.target}" AS {name}, {class_sql(DUCK, t, chr(34) + t.target + chr(34))} AS {name}_class FROM ({w})')
    return " UNION ALL ".join(parts)


#: What tells a release from others in a sweep.
SWEPT = ("mechanism", "config", "b_setting", "eps")


def swept(entities: Mapping[str, DataFrame], cells: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """Releases of templates at every cell: (template, SWEPT, patient_id, truth, truth_class, target, target_class).

    entities, by template: patient_id and, for each root r, the columns r (value) and u_r (its uniform). cells, by
    mechanism and template: (config, b_setting, eps, eps_r for each root), of catalog size. Truths and uniforms are
    computed once per entity; the cells go to every task, and nothing is shuffled.
    """
    columns = ("template", *SWEPT, "patient_id", "truth", "truth_class", "target", "target_class")
    parts = [named(swept_one(entities[t], of[t], templates()[t], m), of[t], t, m).select(*columns) for t in entities for m, of in cells.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def numbered(cells: DataFrame) -> list[tuple[int, Row]]:
    """The cells with the number of their budgets, the same wherever they are read.

    Cells with equal budgets, as the config all has under every setting, have one number: their releases are one, as the
    draws are keyed, and are made once.
    """
    roots, numbers = [c for c in cells.columns if c.startswith("eps_")], {}
    ordered = sorted(cells.collect(), key=lambda c: (c.config, c.b_setting, c.eps))
    return [(numbers.setdefault(tuple(c[r] for r in roots), len(numbers)), c) for c in ordered]


def named(rows: DataFrame, cells: DataFrame, template: str, mechanism: str) -> DataFrame:
    """rows (cell, ..) of swept_one, or of an aggregate by cell, with template and SWEPT in place of the number: once for each cell that has it."""
    names = rows.sparkSession.createDataFrame([(k, c.config, c.b_setting, c.eps) for k, c in numbered(cells)], "cell int, config string, b_setting string, eps double")
    return rows.join(F.broadcast(names), "cell").drop("cell").withColumns({"template": F.lit(template), "mechanism": F.lit(mechanism)})


def swept_one(entities: DataFrame, cells: DataFrame, template: Template, mechanism: str) -> DataFrame:
    """The releases of one template by one mechanism: (cell, patient_id, truth, truth_class, target, target_class), cell a number of budgets.

    Roots are drawn in numpy, a cell of a batch of entities at a time; truths, derived nodes and classes are Spark's.
    """
    q, roots = SPARK.quote, template.roots
    truth, target = q(template.target), q("_r_" + template.target)
    grid = [f"{N.grid_position(SPARK, q(r), *map(SPARK.num, template.domains[r]))} AS {q('t_' + r)}" for r in roots]
    known = entities.sparkSession.sql(layered_sql("{e}", template, d=SPARK), e=entities)
    known = known.selectExpr("patient_id", f"{truth} AS truth", f"{class_sql(SPARK, template, truth)} AS truth_class", *grid, *[f"u_{r}" for r in roots])
    budgets = {k: [float(c[f"eps_{r}"]) for r in roots] for k, c in numbered(cells)}
    domains = [template.domains[r] for r in roots]

    def release_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "patient_id", "truth", "truth_class", *(f"_r_{r}" for r in roots)]
        for batch in batches:
            t, u = ([batch.column(f"{k}_{r}").to_numpy(zero_copy_only=False) for r in roots] for k in "tu")
            drawn: dict[tuple[int, float], pa.Array] = {}  # a budget that several cells have is drawn once
            for cell, of in budgets.items():
                for k, eps in enumerate(of):
                    if (k, eps) not in drawn:
                        lo, hi = domains[k]
                        drawn[k, eps] = pa.array(lo + draws.drawn(mechanism, t[k], eps, u[k]) * (hi - lo) / (N.M - 1), from_pandas=True)
                number = pa.array(np.full(len(batch), cell, np.int32))
                yield pa.RecordBatch.from_arrays([number, *batch.columns[:3], *(drawn[k, eps] for k, eps in enumerate(of))], names=names)

    key = entities.schema["patient_id"].dataType.simpleString()
    schema = f"cell int, patient_id {key}, truth double, truth_class int, " + ", ".join(f"`_r_{r}` double" for r in roots)
    known = known.withColumns({"truth": F.col("truth").cast("double"), "truth_class": F.col("truth_class").cast("int")})
    out = entities.sparkSession.sql(layered_sql("{r}", template, names={r: q("_r_" + r) for r in roots}, prefix="_r_", d=SPARK), r=known.mapInArrow(release_cells, schema))
    return out.selectExpr("cell", "patient_id", "truth", "truth_class", f"{target} AS target", f"{class_sql(SPARK, template, target)} AS target_class")


def swept_sql(d: Dialect, entities: str, cells: str, template: Template, mechanism: str) -> str:
    q = d.quote
    noised = []
    for r in template.roots:
        lo, hi = map(d.num, template.domains[r])
        index = N.drawn(d, mechanism, q(f"t_{r}"), f"eps_{r}", f"u_{r}")
        noised.append(f"{N.value_of(d, f'({index})', lo, hi)} AS {q('_r_' + r)}")
    truth, target = q(template.target), q("_r_" + template.target)
    grid = ", ".join(f"{N.grid_position(d, q(r), *map(d.num, template.domains[r]))} AS {q('t_' + r)}, u_{r}" for r in template.roots)
    base = f"SELECT patient_id, {truth} AS truth, {class_sql(d, template, truth)} AS truth_class, {grid} FROM ({layered_sql(entities, template, d=d)})"
    inner = f"SELECT config, b_setting, eps, patient_id, truth, truth_class, {', '.join(noised)} FROM ({base}) CROSS JOIN {cells}"
    inner = layered_sql(f"({inner})", template, names={r: q("_r_" + r) for r in template.roots}, prefix="_r_", d=d)
    return f"SELECT '{template.name}' AS template, '{mechanism}' AS mechanism, {', '.join(SWEPT[1:])}, patient_id, truth, truth_class, {target} AS target, {class_sql(d, template, target)} AS target_class FROM ({inner})"


def with_domains(rows: DataFrame, domains: DataFrame, default: tuple[float, float] = DEFAULT_DOMAIN) -> DataFrame:
    """rows (template, root, ...) with lo and hi from the domain table, or the default."""
    joined = rows.join(F.broadcast(domains.select("template", "root", F.col("lo").alias("_vg_lo"), F.col("hi").alias("_vg_hi"))), ["template", "root"], "left")
    return joined.withColumn("lo", F.coalesce("_vg_lo", F.lit(default[0]))).withColumn("hi", F.coalesce("_vg_hi", F.lit(default[1]))).drop("_vg_lo", "_vg_hi")
