"""Anomalies of elements: all detectors' findings in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import classify
from . import text as F
from .mesh import KEY
from .solid import let, median, structs, total
from .text import Sql as Column
from .text import put


def detected(solids: DataFrame, unclassified: float = 0.2, asymmetry: float = 2.0, slender: float = 50.0, narrow: float = 0.5, jump: float = 50.0, key: str = KEY) -> DataFrame:
    """(key, type) of elements as ``measure.enriched`` gives them: a row for each detector that an element meets.

    missing_faces (a stem without a crown, foundation, front or back), high_unclassified (share of the area),
    asymmetric_front_back (ratio of the areas), extreme_aspect_ratio, crown_narrower_than_thickness (share of it), profile_step (crown
    widths along the line jump by more than ``jump`` mm out of their spread) and inconsistent_normals (faces wound either way).
    Values that are missing meet no detector. All are expressions over a row.
    """
    area = " + ".join(f"{c}_area" for c in classify.CATEGORIES)
    met = {
        "missing_faces": "element_role = 'wall_stem' AND least(crown_count, foundation_count, front_count, back_count) = 0",
        "high_unclassified": f"unclassified_area > {unclassified}D * ({area})",
        "asymmetric_front_back": f"front_area > 0 AND back_area > 0 AND greatest(front_area, back_area) > {asymmetry}D * least(front_area, back_area)",
        "extreme_aspect_ratio": f"greatest(size_x, size_y, size_z) > {slender}D * least(size_x, size_y, size_z)",
        "crown_narrower_than_thickness": f"crown_width_mm > 0 AND crown_width_mm < {narrow}D * min_wall_thickness_mm",
    }
    met |= {"profile_step": _steps(F.transform("line", lambda f: f["w"] * 1000), jump), "inconsistent_normals": _turned(F.col("t"))}
    named = F.array(*(F.when(F.expr(str(test)), F.lit(name)) for name, test in met.items()))
    return put(solids, {"type": F.explode(F.filter(named, lambda n: n.isNotNull()))}).select(key, "type")


def _steps(widths: Column, jump: float) -> Column:
    """``stats.profile_steps`` of an array: whether it has any."""
    inner = let(widths, lambda w: let(F.floor(F.size(w) * 0.15).cast("int"), lambda k: F.when(F.size(w) >= 5, F.slice(w, k + 1, F.size(w) - k * 2))))
    steps = let(inner, lambda p: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: F.get(p, i) - F.get(p, i - 1)), lambda x: x.isNotNull()))
    off = lambda d, m: median(F.transform(d, lambda x: F.abs(x - m))) / 0.6745
    far = lambda d, m, s: F.size(F.filter(d, lambda x: (s > 1e-10) & (F.abs(x - m) > s * 3) & (F.abs(x) > jump))) > 0
    return F.coalesce(let(steps, lambda d: let(median(d), lambda m: let(off(d, m), lambda s: far(d, m, s)))), F.lit(False))


def _turned(t: Column) -> Column:
    """``stats.normal_consistency`` of an array of triangles: whether they are wound either way."""
    mid = lambda t: structs(**{c: total(t, lambda x, c=c: (x[f"{c}0"] + x[f"{c}1"] + x[f"{c}2"]) / 3) / F.size(t) for c in "xyz"})

    def volume(x: Column, m: Column) -> Column:
        p = [[x[f"{c}{i}"] - m[c] for c in "xyz"] for i in range(3)]
        (ax, ay, az), (bx, by, bz), (cx, cy, cz) = p
        return ax * (by * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by * cx)

    rare = lambda v: F.least(F.size(F.filter(v, lambda x: x > 0)), F.size(F.filter(v, lambda x: x < 0))) > F.size(v) * 0.3
    return F.coalesce(F.when(F.size(t) >= 4, let(t, lambda t: let(mid(t), lambda m: let(F.transform(t, lambda x: volume(x, m)), rare)))), F.lit(False))
