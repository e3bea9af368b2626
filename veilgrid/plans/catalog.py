"""The template catalog: derived metrics as graphs of SQL expressions over private root columns."""

from __future__ import annotations

from dataclasses import dataclass, field

# Domains of the roots and derived nodes of each template.
DOMAINS = {
    "ANEMIA": {"hb": (7.20, 19.90), "hct": (23.00, 58.80), "rbc": (2.32, 7.84), "mcv": (56.67, 113.11), "mch": (16.86, 39.33), "mchc": (29.71, 38.29)},
    "FIB4": {"age": (18.00, 80.00), "ast": (7.00, 272.00), "alt": (3.00, 211.00), "plt": (8.00, 535.00), "fib4_prod": (198.00, 14144.00), "fib4_denom": (25.30, 5533.48), "fib4": (0.12, 37.95)},
    "AIP": {"tc": (76.00, 384.00), "hdl": (11.00, 147.00), "tg": (21.00, 2684.00), "non_hdl": (38.00, 337.00), "ldl": (-199.80, 265.20), "aip": (-0.64, 1.97)},
    "CONICITY": {"wt": (36.80, 191.40), "ht": (1.48, 1.98), "waist": (0.62, 1.64), "bmi": (14.91, 61.93), "wthr": (0.37, 0.94), "conicity": (1.01, 1.60)},
    "VASCULAR": {"sbp": (72.00, 216.00), "dbp": (0.01, 136.00), "pp": (20.00, 168.00), "map": (33.33, 162.67), "mbp": (50.00, 176.00), "ppi": (0.17, 1.00)},
    "TYG": {"tg": (21.00, 2684.00), "glu": (64.00, 451.00), "tyg_prod": (1738.00, 443205.00), "tyg_half": (869.00, 221602.50), "tyg": (6.77, 12.31)},
    "HOMA": {"glu": (64.00, 451.00), "ins": (0.71, 321.64), "homa_prod": (48.99, 62796.70), "homa": (0.12, 155.05)},
    "NLR": {"neu": (0.40, 15.70), "lym": (0.50, 65.90), "nlr_sum": (1.50, 72.10), "nlr_diff": (0.00, 59.70), "nlr": (0.09, 19.00)},
}
DEFAULT_DOMAIN = (0.0, 1000.0)

# Fixed values: (derived node, its SQL expression, its partial derivatives), in the order of evaluation.
NODES = {
    "ANEMIA": [
        ("mcv", "hct / rbc * 10", {"hct": "10 / rbc", "rbc": "-10 * hct / (rbc * rbc)"}),
        ("mch", "hb / rbc * 10", {"hb": "10 / rbc", "rbc": "-10 * hb / (rbc * rbc)"}),
        ("mchc", "hb / hct * 100", {"hb": "100 / hct", "hct": "-100 * hb / (hct * hct)"}),
        ("anemia_class", "CASE WHEN mchc < 32 OR mchc > 36 THEN 1 ELSE 0 END", None),
    ],
    "FIB4": [
        ("fib4_prod", "age * ast", {"age": "ast", "ast": "age"}),
        ("fib4_denom", "plt * sqrt(alt)", {"plt": "sqrt(alt)", "alt": "plt / (2 * sqrt(alt))"}),
        ("fib4", "fib4_prod / fib4_denom", {"fib4_prod": "1 / fib4_denom", "fib4_denom": "-fib4_prod / (fib4_denom * fib4_denom)"}),
        ("fib4_risk", "CASE WHEN fib4 > 2.67 THEN 2 WHEN fib4 > 1.30 THEN 1 ELSE 0 END", None),
    ],
    "AIP": [
        ("non_hdl", "tc - hdl", {"tc": "1", "hdl": "-1"}),
        ("ldl", "tc - hdl - tg / 5", {"tc": "1", "hdl": "-1", "tg": "-0.2"}),
        ("aip", "log10(tg / hdl)", {"tg": "1 / (tg * ln(10))", "hdl": "-1 / (hdl * ln(10))"}),
        ("aip_risk", "CASE WHEN aip > 0.21 THEN 2 WHEN aip > 0.11 THEN 1 ELSE 0 END", None),
    ],
    "CONICITY": [
        ("bmi", "wt / (ht * ht)", {"wt": "1 / (ht * ht)", "ht": "-2 * wt / (ht * ht * ht)"}),
        ("wthr", "waist / ht", {"waist": "1 / ht", "ht": "-waist / (ht * ht)"}),
        ("conicity", "waist / (0.109 * sqrt(wt / ht))", {"waist": "1 / (0.109 * sqrt(wt / ht))", "wt": "-waist / (0.109 * sqrt(wt / ht)) / (2 * wt)", "ht": "waist / (0.109 * sqrt(wt / ht)) / (2 * ht)"}),
        ("ci_risk", "CASE WHEN conicity > 1.25 THEN 1 ELSE 0 END", None),
    ],
    "VASCULAR": [
        ("pp", "sbp - dbp", {"sbp": "1", "dbp": "-1"}),
        ("map", "dbp + pp / 3", {"dbp": "1", "pp": "1 / 3.0"}),
        ("mbp", "(sbp + dbp) / 2", {"sbp": "0.5", "dbp": "0.5"}),
        ("ppi", "pp / sbp", {"pp": "1 / sbp", "sbp": "-pp / (sbp * sbp)"}),
        ("ppi_risk", "CASE WHEN ppi > 0.60 THEN 1 ELSE 0 END", None),
    ],
    "TYG": [
        ("tyg_prod", "tg * glu", {"tg": "glu", "glu": "tg"}),
        ("tyg_half", "tyg_prod / 2", {"tyg_prod": "0.5"}),
        ("tyg", "ln(tyg_half)", {"tyg_half": "1 / tyg_half"}),
        ("tyg_class", "CASE WHEN tyg > 8.5 THEN 1 ELSE 0 END", None),
    ],
    "HOMA": [
        ("homa_prod", "glu * ins", {"glu": "ins", "ins": "glu"}),
        ("homa", "homa_prod / 405", {"homa_prod": "1 / 405.0"}),
        ("homa_class", "CASE WHEN homa > 2.5 THEN 1 ELSE 0 END", None),
    ],
    "NLR": [
        ("nlr_sum", "neu + lym", {"neu": "1", "lym": "1"}),
        ("nlr_diff", "abs(neu - lym)", {"neu": "sign(neu - lym)", "lym": "-sign(neu - lym)"}),
        ("nlr", "neu / lym", {"neu": "1 / lym", "lym": "-neu / (lym * lym)"}),
        ("nlr_class", "CASE WHEN nlr >= 3.0 THEN 1 ELSE 0 END", None),
    ],
}
TARGETS = {"ANEMIA": "mchc", "FIB4": "fib4", "AIP": "aip", "CONICITY": "conicity", "VASCULAR": "ppi", "TYG": "tyg", "HOMA": "homa", "NLR": "nlr"}

# Means and standard deviations of the roots, and the public means that budgets are optimised at.
MEANS = {
    "ANEMIA": {"hb": 14.823448866067606, "hct": 43.91151048352588, "rbc": 4.957021822849807},
    "FIB4": {"age": 50.1719696969697, "ast": 23.607756721022476, "alt": 25.904824561403508, "plt": 226.76850663243474},
    "AIP": {"tc": 183.03748910200522, "hdl": 48.2027027027027, "tg": 121.242},
    "CONICITY": {"wt": 88.15285890580009, "ht": 1.7347872427983537, "waist": 1.0195415239726027},
    "VASCULAR": {"sbp": 127.19545454545455, "dbp": 73.40181818181819},
    "TYG": {"tg": 121.242, "glu": 116.59882583170254},
    "HOMA": {"glu": 115.98336594911937, "ins": 14.148432160804019},
    "NLR": {"neu": 4.189773213521609, "lym": 2.1981600342319214},
}
STDS = {
    "ANEMIA": {"hb": 1.3698219109313934, "hct": 3.782952797059591, "rbc": 0.5110842727809712},
    "FIB4": {"age": 18.953490980891043, "ast": 13.4031449359618, "alt": 17.803660511276895, "plt": 57.76539008666735},
    "AIP": {"tc": 41.42337163361538, "hdl": 13.602155440431158, "tg": 125.69294903056417},
    "CONICITY": {"wt": 22.143329129573143, "ht": 0.07669387870403638, "waist": 0.16596860258158164},
    "VASCULAR": {"sbp": 17.971239074818897, "dbp": 12.961425158861209},
    "TYG": {"tg": 125.69294903056417, "glu": 39.87428285328276},
    "HOMA": {"glu": 37.810174719901084, "ins": 17.72943871474419},
    "NLR": {"neu": 1.6599675695523124, "lym": 1.7770131734553358},
}
PUBLIC_MEANS = {
    "age": 50.2335, "alt": 26.1125, "ast": 23.7857, "dbp": 73.5658, "glu": 116.4223, "hb": 14.8091, "hct": 43.8850, "hdl": 48.2454, "ht": 1.7348, "ins": 14.6411,
    "lym": 2.1867, "neu": 4.1751, "plt": 226.4986, "rbc": 4.9536, "sbp": 127.3083, "tc": 183.0184, "tg": 123.2650, "waist": 1.0204, "wt": 88.2404,
}
# Bounds (m, L) by which a derived node contracts and expands distances.
LIPSCHITZ = {
    "mcv": (3.81, 111.9106), "mch": (1.8505, 37.3144), "mchc": (1.7117, 9.0415), "fib4_prod": (34.6123, 303.2436), "fib4_denom": (8.0504, 75.496), "fib4": (0.0001, 0.4643),
    "non_hdl": (1.4142, 1.4142), "ldl": (1.4283, 1.4283), "aip": (0.0038, 0.0272), "bmi": (10.1571, 137.2895), "wthr": (0.5053, 1.0796), "conicity": (0.8191, 2.0561),
    "pp": (1.4142, 1.4142), "map": (0.7454, 0.7454), "mbp": (0.7071, 0.7071), "ppi": (0.0047, 0.0227), "tyg_prod": (112.2769, 889.0305), "tyg_half": (0.5, 0.5), "tyg": (0.0, 0.0004),
    "homa_prod": (52.0679, 496.2558), "homa": (0.0025, 0.0025), "nlr_sum": (1.4142, 1.4142), "nlr_diff": (1.4142, 1.4142), "nlr": (0.1386, 136.3953),
}
# A target's class is the number of cuts that it is beyond; (cut, whether the cut itself is beyond).
CUTS = {
    "ANEMIA": [(32.0, True), (36.0, False)], "FIB4": [(1.30, True), (2.67, False)], "AIP": [(0.11, True), (0.21, False)], "CONICITY": [(1.25, False)],
    "VASCULAR": [(0.60, False)], "TYG": [(8.5, False)], "HOMA": [(1.0, True), (2.5, True)], "NLR": [(3.0, True)],
}
# As shown to readers, and the names that replies may use for a root.
DISPLAY = {"hb": "Hb", "hct": "Hct", "rbc": "RBC", "ast": "AST", "alt": "ALT", "plt": "PLT", "glu": "Glu", "ins": "Ins"}
SYNONYMS = {
    "glucose": "glu", "fasting_glucose": "glu", "insulin": "ins", "fasting_insulin": "ins", "hemoglobin": "hb", "haemoglobin": "hb", "hematocrit": "hct", "haematocrit": "hct",
    "red_blood_cells": "rbc", "redbloodcells": "rbc", "red_blood_cell_count": "rbc", "rbc_count": "rbc", "aspartate_aminotransferase": "ast", "alanine_aminotransferase": "alt",
    "platelets": "plt", "platelet_count": "plt", "triglycerides": "tg", "triglyceride": "tg", "trigs": "tg", "hdl_cholesterol": "hdl", "waist_circumference": "waist",
    "weight": "wt", "body_weight": "wt", "height": "ht", "systolic": "sbp", "systolic_blood_pressure": "sbp", "diastolic": "dbp", "diastolic_blood_pressure": "dbp",
    "neutrophils": "neu", "neutrophil": "neu", "neutrophil_count": "neu", "absolute_neutrophil_count": "neu", "lymphocytes": "lym", "lymphocyte": "lym", "lymp": "lym", "lymphs": "lym",
    "lymphocyte_count": "lym", "absolute_lymphocyte_count": "lym",
}


@dataclass(frozen=True)
class Template:
    """A derived metric: roots with their domains, derived nodes in order of evaluation, and the target among them."""

    name: str
    roots: list[str]
    domains: dict[str, tuple[float, float]]
    nodes: list[tuple[str, str, dict[str, str] | None]]
    target: str
    cuts: list[tuple[float, bool]] = field(default_factory=list)

    def __post_init__(self) -> None:
        known = set(self.roots)
        for node, _, partials in self.nodes:
            if missing := set(partials or ()) - known:
                raise ValueError(f"{self.name}: {node} depends on {sorted(missing)}, which come later or not at all")
            known.add(node)
        if self.target not in known:
            raise ValueError(f"{self.name}: no node {self.target}")

    @property
    def classes(self) -> int:
        return len(self.cuts) + 1

    def parents(self, node: str) -> list[str]:
        return next(list(p or [self.target]) for n, _, p in self.nodes if n == node)


_registered: dict[str, Template] = {}


def register_template(template: Template) -> None:
    _registered[template.name] = template


def templates() -> dict[str, Template]:
    return dict(_registered)


for _name, _nodes in NODES.items():
    _derived = {n for n, _, _ in _nodes}
    register_template(Template(_name, [n for n in DOMAINS[_name] if n not in _derived], DOMAINS[_name], _nodes, TARGETS[_name], CUTS[_name]))

#: The template on the fact table.
PRICING = Template(
    "PRICING",
    ["l_extendedprice", "l_discount", "l_tax"],
    {"l_extendedprice": (900.0, 105000.0), "l_discount": (0.0, 0.10), "l_tax": (0.0, 0.08)},
    [
        ("disc_price", "l_extendedprice * (1 - l_discount)", {"l_extendedprice": "1 - l_discount", "l_discount": "-l_extendedprice"}),
        ("charge", "disc_price * (1 + l_tax)", {"disc_price": "1 + l_tax", "l_tax": "disc_price"}),
    ],
    "charge",
    [(25000.0, True), (75000.0, True)],
)
