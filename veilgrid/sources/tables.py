"""Reading and writing: entity tables, nested benchmarks, allocations, result trees."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import DUCK, SPARK, Dialect
from ..plans.catalog import DOMAINS, MEANS, STDS, templates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BENCHMARK = T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("turns", T.ArrayType(T.StructType([T.StructField("private_value", T.MapType(T.StringType(), T.DoubleType()))])))])))
ALLOCATION = "template string, mechanism string, b_setting string, config string, eps_in double, root string, eps double"


def flatten_samples(samples: DataFrame) -> DataFrame:
    """(template, patient_id, node, value) of samples (template, id, turns); the later turn wins."""
    turns = samples.select("template", F.col("id").alias("patient_id"), F.posexplode("turns").alias("turn", "t"))
    pairs = turns.select("template", "patient_id", "turn", F.explode("t.private_value").alias("node", "value"))
    return pairs.groupBy("template", "patient_id", "node").agg(F.max_by("value", "turn").alias("value"))


def write_benchmark(samples: DataFrame, path: str, files: int = 8) -> None:
    """Samples (template, id, turns) as JSON objects of template to samples, one per line; an object holds about a sixty-fourth of a template's samples."""
    part = F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")
    objects = samples.groupBy("template", part).agg(F.collect_list(F.struct("id", "turns")).alias("s"))
    objects.select(F.to_json(F.create_map("template", "s")).alias("value")).repartition(files).write.text(path)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """JSON files of one or more objects of template to samples, an object per line, flattened."""
    whole = spark.read.text(path).select(F.from_json("value", BENCHMARK).alias("m"))
    samples = whole.select(F.explode("m").alias("template", "samples")).select("template", F.explode("samples").alias("s"))
    return flatten_samples(samples.select("template", "s.id", "s.turns"))


SAMPLE = "template string, id string, turns array<struct<private_value:map<string,double>>>"


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples (template, id, turns) as JSON, a sample per line: a file of any length can be split, and no task holds more than a sample."""
    samples.select("template", "id", "turns").write.json(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """JSON files of a sample per line, flattened; lines that aren't samples, and samples without template or id, are left out."""
    return flatten_samples(spark.read.schema(SAMPLE).json(path).where("template IS NOT NULL AND id IS NOT NULL"))


def read_allocations(spark: SparkSession, path: str) -> DataFrame:
    """The allocation table from CSV with a header; eps_in may be missing."""
    raw = spark.read.csv(path, header=True)
    missing = {"template", "mechanism", "B_setting", "config", "root", "eps"} - set(raw.columns)
    if missing:
        raise ValueError(f"allocation file without columns {sorted(missing)}")
    eps_in = F.col("eps_in").cast("double") if "eps_in" in raw.columns else F.lit(None).cast("double")
    return raw.select("template", "mechanism", F.col("B_setting").alias("b_setting"), "config", eps_in.alias("eps_in"), "root", F.col("eps").cast("double").alias("eps"))


def allocation_cell(allocations: DataFrame, template: str, mechanism: str, b_setting: str, config: str) -> DataFrame:
    """(root, eps) of one cell; the query fails where the cell is empty."""
    cell = allocations.where((F.col("template") == template) & (F.col("mechanism") == mechanism) & (F.col("b_setting") == b_setting) & (F.col("config") == config)).select("root", "eps")
    check = cell.agg(F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit(f"no allocation for {template}/{mechanism}/{b_setting}/{config}"))).otherwise(F.lit(True)).cast("boolean").alias("_vg_ok"))
    return cell.join(F.broadcast(check), F.col("_vg_ok"), "right").select("root", "eps")


def write_tree(results: DataFrame, path: str, keys: Sequence[str] = ("epsilon", "template")) -> None:
    """A result tree, one folder per cell; cells written again replace only themselves."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_tree(spark: SparkSession, path: str, cells: DataFrame | None = None, keys: Sequence[str] = ("epsilon", "template")) -> DataFrame:
    """A result tree; with `cells`, one row at least for each, null where it is missing."""
    tree = spark.read.parquet(path)
    return tree if cells is None else cells.join(tree, list(keys), "left")


def read_sessions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Session records from a folder of JSON files; a missing eps_in is the number that the file's path has after eps."""
    raw = spark.read.schema(schema).json(path).withColumn("_vg_path", F.col("_metadata.file_path"))
    named = F.regexp_extract("_vg_path", r"eps[_=](\d+(?:\.\d+)?)", 1)
    return raw.withColumn("eps_in", F.coalesce("eps_in", F.when(named != "", named.cast("double")))).drop("_vg_path")


POPULATION = "per_template_means map<string,map<string,double>>, per_template_stds map<string,map<string,double>>, per_template_n_holdout map<string,map<string,bigint>>, per_template_covariances map<string,struct<root_order:array<string>,means:array<double>,covariance:array<array<double>>,n_complete:bigint>>"


def write_population(stats: DataFrame, path: str) -> None:
    """Statistics (template, root, other, n, mean, std, cov) as one JSON object; a few numbers per template."""
    rows = F.array_sort(F.collect_list(F.struct("other", "cov")))
    per_root = stats.groupBy("template", "root").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("std").alias("std"), F.transform(rows, lambda x: x["cov"]).alias("row"))
    ordered = F.array_sort(F.collect_list(F.struct("root", "n", "mean", "std", "row")))
    per_template = per_root.groupBy("template").agg(ordered.alias("r"))
    entries = lambda c: F.map_from_entries(F.transform("r", lambda x: F.struct(x["root"], x[c])))
    column = lambda c: F.transform("r", lambda x: x[c])
    cov = F.struct(column("root").alias("root_order"), column("mean").alias("means"), column("row").alias("covariance"), F.element_at("r", 1)["n"].alias("n_complete"))
    each = per_template.select("template", entries("mean").alias("m"), entries("std").alias("s"), entries("n").alias("n"), cov.alias("c"))
    whole = lambda c: F.map_from_entries(F.collect_list(F.struct("template", c)))
    each.agg(whole("m").alias("per_template_means"), whole("s").alias("per_template_stds"), whole("n").alias("per_template_n_holdout"), whole("c").alias("per_template_covariances")).write.json(path)


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """(template, root, other, n, mean, std, cov) of a JSON file of population statistics; cov is null where a root has no covariance."""
    raw = spark.read.schema(POPULATION).json(path)
    means = raw.select(F.explode("per_template_means").alias("template", "m"), "per_template_stds", "per_template_n_holdout", "per_template_covariances")
    roots = means.select("template", F.explode("m").alias("root", "mean"), F.col("per_template_stds")[F.col("template")].alias("s"), F.col("per_template_n_holdout")[F.col("template")].alias("k"), F.col("per_template_covariances")[F.col("template")].alias("c"))
    at = F.array_position("c.root_order", F.col("root"))
    row = F.when(at > 0, F.get("c.covariance", (at - 1).cast("int")))
    pairs = F.explode_outer(F.arrays_zip(F.col("c.root_order").alias("other"), row.alias("cov")))
    return roots.select("template", "root", F.col("k")[F.col("root")].alias("n"), "mean", F.col("s")[F.col("root")].alias("std"), pairs.alias("p")).select("template", "root", F.coalesce("p.other", "root").alias("other"), "n", "mean", "std", "p.cov")


def inverse_covariances(stats: DataFrame, ridge: float = 1e-6) -> dict[str, tuple[list[str], np.ndarray, np.ndarray]]:
    """Per template (roots, covariance with ridge on its diagonal, its inverse): matrices of a few roots, inverted on the driver."""
    rows = stats.where("cov IS NOT NULL").select("template", "root", "other", "cov").collect()
    out = {}
    for t in sorted({r.template for r in rows}):
        own = {(r.root, r.other): r.cov for r in rows if r.template == t}
        roots = sorted({a for a, _ in own})
        cov = np.array([[own[a, b] for b in roots] for a in roots]) + ridge * np.eye(len(roots))
        out[t] = roots, cov, np.linalg.inv(cov)
    return out


def unfinished(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The work whose result doesn't exist yet."""
    return work.join(done, list(keys), "left_anti")


# The patients relation: one row per customer, template and root, from keyed uniforms.

SECRET = "veil"


def entities(spark: SparkSession, sf_dir: str, distinct: bool = False, counted: bool = False) -> DataFrame:
    """The customers' keys, dealt over all cores: a file of one row group is read by one task, which would do all that each key entails.

    counted: each key once, with the number of `times` that it occurs. Keys are dealt by themselves before they are made
    distinct, so that no task that reads a file holds all of its keys.
    """
    keys, tasks = table(spark, sf_dir, "customer").select("c_custkey"), max(2 * spark.sparkContext.defaultParallelism, 16)
    if not (counted or distinct):
        return keys.repartition(tasks)
    dealt = keys.repartition(tasks, "c_custkey")
    return dealt.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("times")) if counted else dealt.distinct()


def roots_table() -> list[tuple]:
    return [(t.name, r, MEANS[t.name][r], STDS[t.name][r], *DOMAINS[t.name][r]) for t in templates().values() for r in t.roots if t.name in MEANS]


def patient_value(d: Dialect) -> str:
    u = [d.uniform(f"'{SECRET}'", "template", "root", "c_custkey", f"'{k}'") for k in "abc"]
    return f"greatest(least(mean + std * ({u[0]} + {u[1]} + {u[2]} - {d.num(1.5)}) * {d.num(2)}, hi), lo)"


def root_value(d: Dialect, template: str, root: str, key: str) -> str:
    """The same value for one root of one template, by the entity's key."""
    lo, hi = DOMAINS[template][root]
    u = [d.uniform(f"'{SECRET}'", f"'{template}'", f"'{root}'", key, f"'{k}'") for k in "abc"]
    return f"greatest(least({d.num(MEANS[template][root])} + {d.num(STDS[template][root])} * ({u[0]} + {u[1]} + {u[2]} - {d.num(1.5)}) * {d.num(2)}, {d.num(hi)}), {d.num(lo)})"


def patients(spark: SparkSession, sf_dir: str, distinct: bool = False, counted: bool = False) -> DataFrame:
    """(patient_id, template, root, value); distinct: once for each patient, where customers repeat; counted: also how many `times` they do."""
    roots = spark.createDataFrame(roots_table(), "template string, root string, mean double, std double, lo double, hi double")
    more = ["times"] if counted else []
    return entities(spark, sf_dir, distinct, counted).crossJoin(F.broadcast(roots)).select(F.col("c_custkey").alias("patient_id"), *more, "template", "root", F.expr(patient_value(SPARK)).alias("value"))


def roots_sql() -> str:
    rows = ", ".join(f"('{t}', '{r}', {m!r}::DOUBLE, {s!r}::DOUBLE, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for t, r, m, s, lo, hi in roots_table())
    return f"roots(template, root, mean, std, lo, hi) AS (VALUES {rows})"


def patients_sql() -> str:
    return f"{roots_sql()}, patients AS (SELECT c_custkey AS patient_id, template, root, {patient_value(DUCK)} AS value FROM customer CROSS JOIN roots)"


def wide(patients_: DataFrame, template: str, prefix: str = "") -> DataFrame:
    """One row per patient with a column per root of the template."""
    roots = templates()[template].roots
    columns: list[Column] = [F.max(F.when(F.col("root") == r, F.col("value"))).alias(prefix + r) for r in roots]
    return patients_.where(F.col("template") == template).groupBy("patient_id").agg(*columns)


def wide_sql(template: str, name: str = "w") -> str:
    columns = ", ".join(f"max(CASE WHEN root = '{r}' THEN value END) AS \"{r}\"" for r in templates()[template].roots)
    return f"{name} AS (SELECT patient_id, {columns} FROM patients WHERE template = '{template}' GROUP BY patient_id)"
