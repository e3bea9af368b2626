"""SQL text in two dialects: Spark runs the operators, DuckDB checks them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    """How the few expressions are written in which the two engines differ."""

    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def num(self, x: float) -> str:
        return f"{float(x)!r}D" if self.spark else f"CAST({float(x)!r} AS DOUBLE)"

    def double(self, x: str) -> str:
        return f"CAST({x} AS DOUBLE)"

    def long(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def string(self, x: str) -> str:
        return f"CAST({x} AS STRING)" if self.spark else f"CAST({x} AS VARCHAR)"

    def rint(self, x: str) -> str:
        """To the nearest integer, halves to even."""
        return f"rint({x})" if self.spark else f"round_even({x}, 0)"

    def uniform(self, *keys: str) -> str:
        """A number in [0, 1) that depends on the keys (SQL expressions) alone."""
        text = f"concat_ws(':', {', '.join(self.string(k) for k in keys)})"
        if self.spark:
            return f"(CAST(conv(substring(sha2({text}, 256), 1, 13), 16, 10) AS DOUBLE) / 4503599627370496D)"
        return f"(CAST(CAST(('0x' || substring(sha256({text}), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE)"

    def safe_divide(self, a: str, b: str) -> str:
        return f"CASE WHEN {b} = 0 THEN NULL ELSE ({a}) / ({b}) END"

    def quote(self, name: str) -> str:
        return f"`{name}`" if self.spark else f'"{name}"'


SPARK, DUCK = Dialect("spark"), Dialect("duck")


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
