"""Derived columns, classes and sensitivities of a template."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import DUCK, SPARK, Dialect
from ..plans.catalog import Template, templates


def bind(d: Dialect, expression: str, names: Mapping[str, str]) -> str:
    """A catalog expression with its variables replaced, numbers as doubles, and divisions and logarithms guarded."""
    keywords = {"CASE", "WHEN", "THEN", "ELSE", "END", "OR", "AND"}

    def token(m: re.Match) -> str:
        w = m.group()
        if w[0].isdigit():
            return w if "CASE" in expression else d.num(float(w))
        return w if w in keywords or w in FUNCTIONS else names[w]

    return re.sub(r"[A-Za-z_]\w*|\d+(?:\.\d+)?", token, expression)


FUNCTIONS = {"sqrt", "ln", "log10", "abs", "sign"}


def finite(d: Dialect, expression: str, inner: str) -> str:
    """Null where the expression would divide by zero or leave a function's domain."""
    guards = [f"{b} <> 0" for b in divisors(inner)] + [f"{a} > 0" for a in re.findall(r"(?:ln|log10)\(([^()]*)\)", inner) if not re.fullmatch(r"[\d.D]+|CAST.*", a.strip())] + [f"{a} >= 0" for a in re.findall(r"sqrt\(([^()]*)\)", inner)]
    return f"CASE WHEN {' AND '.join(guards)} THEN {expression} END" if guards else expression


def divisors(expression: str) -> list[str]:
    """What the expression divides by: names and bracketed parts after a slash, numbers left out."""
    out = []
    for m in re.finditer(r"/\s*", expression):
        rest = expression[m.end() :]
        if name := re.match(r"[`\"]?[A-Za-z_][\w.]*[`\"]?(?!\()", rest):
            out.append(name.group())
        elif rest.startswith("("):
            depth = 0
            for k, c in enumerate(rest):
                depth += (c == "(") - (c == ")")
                if depth == 0:
                    out.append(rest[: k + 1])
                    break
    return out


def derived_columns(d: Dialect, template: Template, names: Mapping[str, str] | None = None, prefix: str = "") -> list[tuple[str, str]]:
    """(column, SQL) of every derived node, in an order in which each only needs earlier ones."""
    known = dict(names or {r: d.quote(r) for r in template.roots})
    out = []
    for node, expression, _ in template.nodes:
        sql = bind(d, expression, known)
        safe = re.sub(r"\b(\d+(?:\.\d+)?)\b", r"\1", bind(Plain(), expression, known))
        out.append((prefix + node, finite(d, sql, safe) if "CASE" not in expression else f"CASE WHEN {known[template.target]} IS NULL THEN NULL ELSE {sql} END"))
        known[node] = d.quote(prefix + node)
    return out


class Plain(Dialect):
    """Numbers as they are, to look for divisors in."""

    def __init__(self) -> None:
        super().__init__("duck")

    def num(self, x: float) -> str:
        return repr(x)


def with_derived(df: DataFrame, template: Template, names: Mapping[str, str] | None = None, prefix: str = "", non_finite: str = "null") -> DataFrame:
    """df with the template's derived columns, one layer after the other.

    names: the column of each root, if it isn't called like it. A value that isn't defined (division by zero, logarithm
    of what isn't positive) is null, or fails the query with non_finite="raise".
    """
    for column, sql in derived_columns(SPARK, template, names, prefix):
        value = F.expr(sql)
        if non_finite == "raise":
            value = F.coalesce(value, F.raise_error(F.lit(f"{column} isn't finite")).cast("double"))
        df = df.withColumn(column, value)
    return df


def layered_sql(base: str, template: Template, keep: str = "*", names: Mapping[str, str] | None = None, prefix: str = "", d: Dialect = DUCK) -> str:
    """A query over `base` with the derived columns, each in a subquery of its own."""
    sql = f"SELECT {keep} FROM {base}"
    for column, expression in derived_columns(d, template, names, prefix):
        sql = f"SELECT *, {expression} AS {d.quote(column)} FROM ({sql})"
    return sql


def class_sql(d: Dialect, template: Template, value: str) -> str:
    """How many cuts the value is beyond; 0 for null."""
    parts = [f"CASE WHEN {value} {'>=' if inclusive else '>'} {d.num(cut)} THEN 1 ELSE 0 END" for cut, inclusive in template.cuts]
    return f"({' + '.join(parts)})"


def edges() -> list[tuple[str, str, str]]:
    """(template, parent, node) over the catalog."""
    return [(t.name, p, node) for t in templates().values() for node, _, _ in t.nodes for p in t.parents(node)]


def node_layers(spark: SparkSession, edge_rows: DataFrame) -> DataFrame:
    """(template, node, layer): roots are 0, others one above their highest parent. A cycle exceeds the recursion limit and fails."""
    return spark.sql(
        """
        WITH RECURSIVE up(template, node, layer) AS (
            SELECT DISTINCT e.template, e.parent, 0 FROM {edges} e LEFT ANTI JOIN {edges} f ON e.template = f.template AND e.parent = f.node
            UNION ALL
            SELECT e.template, e.node, up.layer + 1 FROM up JOIN {edges} e ON e.template = up.template AND e.parent = up.node)
        SELECT template, node, max(layer) AS layer FROM up GROUP BY template, node
        """,
        edges=edge_rows,
    )


def sensitivity_columns(d: Dialect, template: Template, names: Mapping[str, str] | None = None, prefix: str = "") -> list[tuple[str, str]]:
    """(root, SQL) of the target's derivative by each root: the chain rule over the derived columns, which must exist."""
    known = dict(names or {r: d.quote(r) for r in template.roots}) | {n: d.quote(prefix + n) for n, _, _ in template.nodes}
    by: dict[str, dict[str, str]] = {r: {r: d.num(1)} for r in template.roots}
    for node, _, partials in template.nodes:
        if partials is None:
            continue
        total: dict[str, list[str]] = {}
        for parent, expression in partials.items():
            own = bind(d, expression, known)
            for root, inner in by[parent].items():
                total.setdefault(root, []).append(f"({own}) * ({inner})")
        by[node] = {r: " + ".join(x) for r, x in total.items()}
    target = by[template.target]
    return [(r, f"({target[r]})" if r in target else d.num(0)) for r in template.roots]
