"""Rule sets over measurements: every rule of every element in one projection, no shuffle.

A rule is a dict as in a YAML rule set: id, check or depends_on, severity, applies_to, ... Rules of levels 1, 3, 5, 6
and 7 come first, then level 4, whose rules combine the status of earlier ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compiler import RuleError, compile_rule

ORDER = ("level_1", "level_3", "level_5", "level_6", "level_7", "level_4")
WALL_ROLES = ("wall_stem", "parapet", "unknown")
#: Comparators in the order in which the first that a check holds is taken (fixed values).
COMPARATORS = (">=", "<=", "!=", "==", ">", "<")


def load_ruleset(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def compared(check: str) -> tuple[str, str, str] | None:
    """Left side, comparator and right side of a check's first comparison, by rank of the comparator."""
    for op in COMPARATORS:
        if op in check:
            left, _, right = check.partition(op)
            return left.strip(), op, right.strip().split()[0] if right.strip() else ""
    return None


#: What to do where a value is too low, or too high (fixed values).
FIXES = {
    "crown_width_mm": ("verbreitern", "verschmalen"),
    "foundation_width_mm": ("verbreitern", "verschmalen"),
    "min_wall_thickness_mm": ("verdicken", "verschlanken"),
    "wall_height_m": ("erhöhen", "niedriger machen"),
    "crown_slope_percent": ("steiler neigen", "flacher neigen"),
    "cross_slope_max_pct": ("Quergefälle erhöhen", "Quergefälle reduzieren"),
    "long_slope_max_pct": ("Längsgefälle erhöhen", "Längsgefälle reduzieren"),
    "front_inclination_ratio": ("Anzug erhöhen", "Anzug reduzieren"),
    "min_radius_m": ("Radius vergrößern", "Radius verkleinern"),
    "foundation_embedment_m": ("tiefer einbinden", "höher einbinden"),
    "min_distance_to_nearest_mm": ("Abstand vergrößern", "Abstand verringern"),
}


def fix(name: str, op: str, actual: Column, limit: float) -> Column | None:
    """Towards the limit, by how much; null where the value is on its right side."""
    if name not in FIXES or op not in (">=", ">", "<=", "<"):
        return None
    low = op in (">=", ">")
    wrong = actual < limit if low else actual > limit
    return F.when(wrong, F.format_string(FIXES[name][0 if low else 1] + " (~%.1f Einheiten)", F.abs(actual.cast("double") - F.lit(limit))))


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def message(rule: dict, status: Column, types: dict[str, str], uncertainty: str = "measurement_uncertainty_mm") -> Column:
    """Of a failed rule: actual, required and missing amount, hint, reference; and a note near the threshold."""
    parts: list[Column] = []
    found = compared(rule.get("check", ""))
    if found and types.get(found[0], "boolean") != "boolean":
        name, op, right = found
        actual, limit = F.col(name), _number(right)
        parts.append(F.format_string("actual %.3f", actual.cast("double")))
        parts.append(F.lit(f"required {op} {right}"))
        if limit is not None:
            parts.append(F.format_string("off by %.3f", F.abs(actual - F.lit(limit))))
            if not rule.get("fix_hint") and (todo := fix(name, op, actual, limit)) is not None:
                parts.append(todo)
            if uncertainty in types and name.endswith(("_mm", "_pct")):
                margin = F.col(uncertainty) * (0.01 if name.endswith("_pct") else 1.0)
                parts.append(F.when(F.abs(actual - F.lit(limit)) < margin, F.format_string("within uncertainty %.3f", margin)))
    parts += [F.lit(rule[k]) for k in ("fix_hint", "quote") if rule.get(k)]
    if not rule.get("quote") and rule.get("reference"):
        parts.append(F.lit(rule["reference"]))
    return F.when(status == "FAIL", F.concat_ws(" | ", *parts) if parts else F.lit(""))


def evaluate(elements: DataFrame, ruleset: dict, keys: tuple[str, ...] = ("element_id",), role: str | None = "element_role", wall_like: str | None = "is_wall_like") -> DataFrame:
    """(keys, seq, rule_id, status, severity, actual_value, actual_map, message), a row an element and rule.

    Without a role or wall-likeness column every element counts as wall-like and of unknown role.
    """
    types = {n: t for n, t in elements.dtypes if t in ("boolean", "double", "float", "int", "bigint")}
    role_is = F.coalesce(F.col(role), F.lit("unknown")) if role and role in elements.columns else F.lit("unknown")
    like = F.coalesce(F.col(wall_like), F.lit(True)) if wall_like and wall_like in elements.columns else F.lit(True)
    known: dict[str, Column] = {}
    out: list[Column] = []
    text, numbers = "string", "double"
    for seq, (level, rule) in enumerate((lv, r) for lv in ORDER for r in ruleset.get(lv) or []):
        actual, states = F.lit(None).cast(numbers), F.lit(None).cast("map<string,string>")
        if level == "level_4":
            of = {d: known.get(d, F.lit("SKIP")) for d in rule.get("depends_on") or []}
            skip = reduce(lambda a, b: a | b, [s == "SKIP" for s in of.values()], F.lit(False))
            passed = reduce(lambda a, b: a & b, [s == "PASS" for s in of.values()], F.lit(True))
            status = F.when(skip, "SKIP").when(passed, "PASS").otherwise("FAIL")
            if of:
                states = F.create_map(*(x for d, s in of.items() for x in (F.lit(d), s)))
        else:
            try:
                v = compile_rule(rule.get("check", ""), types)
                status = F.when(v.missing, "SKIP").when(v.truth, "PASS").otherwise("FAIL")
            except RuleError:
                status = F.lit("SKIP")
            if level != "level_1" and rule.get("applies_to"):
                status = F.when(~role_is.isin(list(rule["applies_to"])), "SKIP").otherwise(status)
            elif level == "level_3":
                status = F.when(~like | ~role_is.isin(list(WALL_ROLES)), "SKIP").otherwise(status)
            found = compared(rule.get("check", ""))
            if found and found[0] in types:
                actual = F.col(found[0]).cast("int").cast(numbers) if types[found[0]] == "boolean" else F.col(found[0]).cast(numbers)
        known.setdefault(rule["id"], status)
        out.append(F.struct(F.lit(seq).alias("seq"), F.lit(rule["id"]).alias("rule_id"), status.cast(text).alias("status"), F.lit(rule.get("severity", "INFO")).alias("severity"), actual.alias("actual_value"), states.alias("actual_map"), message(rule, status, types).cast(text).alias("message")))
    return elements.select(*keys, F.inline(F.array(*out)))


def summary(checks: DataFrame, keys: tuple[str, ...] = ("element_id",)) -> DataFrame:
    """Counts by element; errors and warnings are failures of that severity."""
    count = lambda c: F.count_if(F.expr(c))
    return checks.groupBy(*keys).agg(
        F.count("*").alias("total"), count("status = 'PASS'").alias("passed"), count("status = 'FAIL'").alias("failed"), count("status = 'SKIP'").alias("skipped"),
        count("status = 'FAIL' AND severity = 'ERROR'").alias("errors"), count("status = 'FAIL' AND severity = 'WARNING'").alias("warnings"),
    )


#: A small rule set over what L1 to L3 measure.
BASIC = {
    "level_1": [
        {"id": "L1-VOLUME", "check": "volume > 0.1", "severity": "ERROR"},
        {"id": "L1-CLOSED", "check": "mesh_is_watertight == true", "severity": "WARNING"},
        {"id": "L1-HEIGHT", "check": "bbox_height_m >= 2.25 and bbox_height_m <= 4.75", "severity": "INFO"},
    ],
    "level_3": [
        {"id": "L3-CROWN", "check": "crown_width_mm >= 300", "severity": "ERROR", "fix_hint": "widen the crown"},
        {"id": "L3-THICK", "check": "min_wall_thickness_mm >= 300", "severity": "ERROR"},
        {"id": "L3-SLOPE", "check": "2.5 <= crown_slope_percent <= 3.5", "severity": "WARNING"},
        {"id": "L3-FOOT", "check": "foundation_width_mm >= (wall_height_m * 100)", "severity": "WARNING", "applies_to": ["wall_stem"]},
        {"id": "L3-RATIO", "check": "1 / (bbox_dim_min_m - 0.25) > 2", "severity": "INFO"},
    ],
    "level_6": [{"id": "L6-DEPTH", "check": "foundation_embedment_m >= 0.8", "severity": "WARNING"}],
    "level_4": [
        {"id": "L4-BODY", "depends_on": ["L1-VOLUME", "L1-CLOSED"], "severity": "ERROR"},
        {"id": "L4-SHAPE", "depends_on": ["L3-CROWN", "L3-THICK", "L3-SLOPE"], "severity": "ERROR"},
        {"id": "L4-ALL", "depends_on": ["L4-BODY", "L4-SHAPE"], "severity": "ERROR"},
        {"id": "L4-SITE", "depends_on": ["L6-DEPTH"], "severity": "WARNING"},
    ],
}
