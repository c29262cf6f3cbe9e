"""What a model file says of its place: coordinate system, alignments, what it holds. Tables over ``spf.entities``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spf import _STRING, _numbers, _refs, decoded

#: Types with their subtypes (fixed values).
SUBTYPES = {
    "IFCWALL": ("IFCWALL", "IFCWALLSTANDARDCASE", "IFCWALLELEMENTEDCASE"),
    "IFCSLAB": ("IFCSLAB", "IFCSLABSTANDARDCASE", "IFCSLABELEMENTEDCASE"),
    "IFCBEAM": ("IFCBEAM", "IFCBEAMSTANDARDCASE"),
    "IFCCOLUMN": ("IFCCOLUMN", "IFCCOLUMNSTANDARDCASE"),
    "IFCMEMBER": ("IFCMEMBER", "IFCMEMBERSTANDARDCASE"),
    "IFCPLATE": ("IFCPLATE", "IFCPLATESTANDARDCASE"),
}


def with_subtypes(types: tuple[str, ...]) -> tuple[str, ...]:
    """In the order of the types, each with its subtypes, none twice."""
    return tuple(dict.fromkeys(s for t in types for s in SUBTYPES.get(t.upper(), (t.upper(),))))


def typed(products: DataFrame, ents: DataFrame) -> DataFrame:
    """Products whose predefined type is missing, USERDEFINED or NOTDEFINED take that of their type object, if it has one."""
    rel = ents.where("type = 'IFCRELDEFINESBYTYPE'").select("model_id", "id", _refs().alias("r")).where("size(r) >= 2")
    rel = rel.select("model_id", "id", F.element_at("r", -1).alias("object"), F.explode(F.expr("slice(r, 1, size(r) - 1)")).alias("element_id"))
    kind = ents.where("type LIKE 'IFC%TYPE'").select("model_id", F.col("id").alias("object"), F.nullif(F.regexp_extract("args", r"\.(\w+)\.\s*$", 1), F.lit("")).alias("_k"))
    first = rel.join(kind, ["model_id", "object"]).where("_k IS NOT NULL AND _k NOT IN ('USERDEFINED', 'NOTDEFINED')").groupBy("model_id", "element_id").agg(F.min_by("_k", "id").alias("_k"))
    out = products.join(first, ["model_id", "element_id"], "left")
    own = F.when(~F.col("predefined_type").isin("USERDEFINED", "NOTDEFINED"), F.col("predefined_type"))
    return out.withColumn("predefined_type", F.coalesce(own, "_k", "predefined_type")).drop("_k")


def coordinate_systems(ents: DataFrame) -> DataFrame:
    """A row a model: name, description, geodetic_datum, vertical_datum, offsets and has_crs, of its first declaration."""
    text = lambda k: F.nullif(decoded(f"_{k}"), F.lit(""))
    fields = rf"^{_STRING},{_STRING},{_STRING},{_STRING}"
    crs = ents.where("type = 'IFCPROJECTEDCRS'").select("model_id", "id", *(F.regexp_extract("args", fields, k + 1).alias(f"_{k}") for k in range(4)))
    crs = crs.select("model_id", "id", *(text(k).alias(n) for k, n in enumerate(("name", "description", "geodetic_datum", "vertical_datum"))))
    crs = crs.groupBy("model_id").agg(F.min_by(F.struct("name", "description", "geodetic_datum", "vertical_datum"), "id").alias("c"))
    moved = ents.where("type = 'IFCMAPCONVERSION'").select("model_id", "id", _numbers(F.regexp_replace("args", r"#\d+", "")).alias("n"))
    moved = moved.groupBy("model_id").agg(F.min_by("n", "id").alias("n"))
    out = ents.select("model_id").distinct().join(crs, "model_id", "left").join(moved, "model_id", "left")
    name = F.coalesce("c.name", F.lit("unspecified"))
    return out.select("model_id", name.alias("name"), F.coalesce("c.description", F.when(F.col("c").isNotNull(), name).otherwise("No IfcProjectedCRS or IfcMapConversion declared")).alias("description"), "c.geodetic_datum", "c.vertical_datum", *(F.get("n", F.lit(i)).alias(c) for i, c in enumerate(("eastings_offset", "northings_offset", "orthogonal_height_offset"))), F.col("c").isNotNull().alias("has_crs"))


def evaluated(segments: DataFrame) -> DataFrame:
    """(keys, seq, k, x, y) of segments (x, y, direction, radius, length, kind) of a horizontal alignment.

    Lines and segments without length give both ends, arcs a point a metre (ten steps at least), others their start.
    """
    line = "array(named_struct('x', x, 'y', y), named_struct('x', x + length * cos(direction), 'y', y + length * sin(direction)))"
    step = "direction + k / greatest(10, CAST(floor(length) AS INT)) * length / radius"
    arc = f"transform(sequence(0, greatest(10, CAST(floor(length) AS INT))), k -> named_struct('x', x + radius * (sin({step}) - sin(direction)), 'y', y - radius * (cos({step}) - cos(direction))))"
    points = F.expr(f"CASE WHEN kind = 'LINE' OR length < 1e-6 THEN {line} WHEN kind = 'CIRCULARARC' AND abs(radius) >= 1e-6 THEN {arc} ELSE array(named_struct('x', x, 'y', y)) END")
    keys = [c for c in segments.columns if c not in ("x", "y", "direction", "radius", "length", "kind")]
    return segments.select(*keys, F.posexplode(points).alias("k", "p")).select(*keys, "k", "p.x", "p.y")


def alignments(ents: DataFrame) -> DataFrame:
    """(model_id, line_id, name, i, lx, ly): points of alignments, by their own polyline, else by their horizontal segments."""
    a = ents.where("type IN ('IFCALIGNMENT', 'IFCALIGNMENTCURVE')").select("model_id", F.col("id").alias("line_id"), F.regexp_extract("args", rf"^'[^']*',[^,]*,{_STRING}", 1).alias("_n"), _refs().alias("r")).withColumn("name", decoded("_n")).drop("_n")
    ref = lambda kinds, own, to: ents.where(F.col("type").isin(list(kinds))).select("model_id", F.col("id").alias(own), F.posexplode(_refs()).alias(f"_{own}", to))
    shape = a.select("model_id", "line_id", F.explode("r").alias("shape")).join(ref(("IFCPRODUCTDEFINITIONSHAPE",), "shape", "rep"), ["model_id", "shape"]).join(ref(("IFCSHAPEREPRESENTATION",), "rep", "item"), ["model_id", "rep"])
    point = ents.where("type = 'IFCCARTESIANPOINT'").select("model_id", F.col("id").alias("point"), _numbers("args").alias("n"))
    drawn = shape.join(ref(("IFCPOLYLINE",), "item", "point"), ["model_id", "item"]).join(point, ["model_id", "point"])
    drawn = drawn.select("model_id", "line_id", F.lit(0).alias("seq"), F.col("_item").alias("k"), F.col("n")[0].alias("x"), F.col("n")[1].alias("y"))
    nest = ents.where("type = 'IFCRELNESTS'").select("model_id", _refs().alias("r")).where("size(r) >= 2").select("model_id", F.col("r")[0].alias("parent"), F.posexplode(F.expr("slice(r, 2, size(r) - 1)")).alias("seq", "child"))
    level = nest.join(ents.where("type = 'IFCALIGNMENTHORIZONTAL'").select("model_id", F.col("id").alias("child")), ["model_id", "child"]).select("model_id", F.col("parent").alias("line_id"), F.col("child").alias("parent"))
    part = ents.where("type = 'IFCALIGNMENTSEGMENT'").select("model_id", F.col("id").alias("child"), F.element_at(_refs(), -1).alias("design"))
    design = ents.where("type = 'IFCALIGNMENTHORIZONTALSEGMENT'").select("model_id", F.col("id").alias("design"), _refs()[0].alias("point"), _numbers(F.regexp_extract("args", r"#\d+,(.*)$", 1)).alias("d"), F.regexp_extract("args", r"\.(\w+)\.\s*$", 1).alias("kind"))
    met = level.join(nest, ["model_id", "parent"]).join(part, ["model_id", "child"]).join(design, ["model_id", "design"]).join(point, ["model_id", "point"])
    met = met.select("model_id", "line_id", "seq", F.col("n")[0].alias("x"), F.col("n")[1].alias("y"), F.get("d", F.lit(0)).alias("direction"), F.get("d", F.lit(1)).alias("radius"), F.get("d", F.lit(3)).alias("length"), "kind")
    every = drawn.union(evaluated(met).select("model_id", "line_id", "seq", "k", "x", "y").join(drawn.select("model_id", "line_id").distinct(), ["model_id", "line_id"], "left_anti"))
    w = Window.partitionBy("model_id", "line_id")
    out = every.withColumns({"i": F.row_number().over(w.orderBy("seq", "k")) - 1, "_n": F.count("*").over(w)}).where("_n >= 2").drop("_n")
    return out.join(a.select("model_id", "line_id", "name"), ["model_id", "line_id"]).select("model_id", "line_id", "name", "i", F.col("x").alias("lx"), F.col("y").alias("ly"))


def configured(products: DataFrame) -> DataFrame:
    """A row a model of products with geometry: which rule set suits it, by types and words in names."""
    has = lambda *words: F.bool_or(F.lower(F.coalesce("name", F.lit(""))).rlike("|".join(words)))
    out = products.where("shape IS NOT NULL").groupBy("model_id").agg(has("tunnel").alias("tunnel"), has("stütz", "stuetz", "retaining").alias("retaining"), F.count_if(F.col("entity_type").isin(*SUBTYPES["IFCWALL"])).alias("walls"), F.count("*").alias("elements"), F.array_sort(F.collect_set("entity_type")).alias("entity_types"))
    return out.withColumn("ruleset", F.when(F.col("tunnel"), "tunnel").when(F.col("retaining") | (F.col("walls") > 0), "retaining_wall").otherwise("complete"))
