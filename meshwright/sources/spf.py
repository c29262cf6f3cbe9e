"""Building models in STEP physical files, as tables.

A file is one text; its instances become rows (model_id, id, type, args) by splitting, and geometry is joins over them:
loops of points, faces of loops, shells of faces, bodies of shells; face sets and swept profiles by array functions. Faces
with corners that point in or with holes are cut as ``faces`` says. Lengths are metres whatever unit the file declares. A file without instances gives a
row of ``load_errors``; Spark passes over files without a byte.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .faces import with_triangles

_NUMBER = r"[-+]?[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?"
_STRING = r"('(?:[^']|'')*'|\$)"
PRODUCT = rf"^'([^']*)',[^,]*,{_STRING},{_STRING},{_STRING},(#\d+|\$),(#\d+|\$)(?:,{_STRING})?(?:,(\.\w+\.|\$))?"
#: Powers of ten by prefix (fixed values).
PREFIXES = {"": 1.0, "KILO": 1e3, "HECTO": 1e2, "DECA": 1e1, "DECI": 1e-1, "CENTI": 1e-2, "MILLI": 1e-3, "MICRO": 1e-6}


def texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(model_id, text): files, folders or patterns; the model's id is the file's name."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("path"))
    return raw.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("model_id"), "text")


def entities(files: DataFrame) -> DataFrame:
    """(model_id, id, type, args)."""
    line = F.explode(F.split(F.regexp_replace("text", r"/\*.*?\*/", ""), r";\s*"))
    return files.select("model_id", line.alias("l")).select(
        "model_id", F.regexp_extract("l", r"^\s*#(\d+)\s*=", 1).alias("id"), F.regexp_extract("l", r"=\s*(\w+)\s*\(", 1).alias("type"), F.regexp_extract("l", r"(?s)=\s*\w+\s*\((.*)\)\s*$", 1).alias("args")
    ).where("id <> '' AND type <> ''").withColumn("id", F.col("id").cast("bigint"))


def load_errors(files: DataFrame) -> DataFrame:
    """Files that hold no instance."""
    found = entities(files).select("model_id").distinct()
    return files.join(found, "model_id", "left_anti").select("model_id", F.lit("no instances").alias("error"))


def decoded(text: str):
    """A STEP string's characters: doubled quotes and \\X2\\ escapes of up to four letters in a row."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(text), "^'|'$", ""), "''", "'"), r"^\$$", "")
    hexes = F.regexp_extract_all(c, F.lit(r"\\X2\\((?:[0-9A-F]{4})+)\\X0\\"), F.lit(1))
    letters = lambda h: F.decode(F.unhex(h), "UTF-16BE")
    return F.aggregate(hexes, c, lambda acc, h: F.replace(acc, F.concat(F.lit("\\X2\\"), h, F.lit("\\X0\\")), letters(h)))


def scale(ents: DataFrame) -> DataFrame:
    """(model_id, unit): metres in the file's length unit."""
    u = ents.where("type = 'IFCSIUNIT' AND args LIKE '%.LENGTHUNIT.%'").select("model_id", "id", F.regexp_extract("args", r"\.LENGTHUNIT\.,\.?(\w*|\$)\.?,", 1).alias("p"))
    table = F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv))
    return u.groupBy("model_id").agg(F.min_by("p", "id").alias("p")).select("model_id", F.coalesce(table[F.col("p")], F.lit(1.0)).alias("unit"))


def products(ents: DataFrame, types: tuple[str, ...] = ("IFCWALL",), predefined: str | None = None) -> DataFrame:
    """(model_id, element_id, global_id, name, entity_type, predefined_type, placement, shape)."""
    part = lambda k: F.regexp_extract("args", PRODUCT, k)
    out = ents.where(F.col("type").isin(list(types))).select("model_id", F.col("id").alias("element_id"), part(1).alias("global_id"), part(2).alias("_n"), F.col("type").alias("entity_type"), F.nullif(F.regexp_replace(part(8), r"[.$]", ""), F.lit("")).alias("predefined_type"), part(5).alias("_p"), part(6).alias("_s"))
    out = out.withColumns({"name": decoded("_n"), "placement": F.expr("try_cast(substr(_p, 2) AS BIGINT)"), "shape": F.expr("try_cast(substr(_s, 2) AS BIGINT)")}).drop("_n", "_p", "_s")
    return out.where(F.upper("predefined_type") == predefined.upper()) if predefined else out


def _refs(col: str = "args"):
    return F.transform(F.regexp_extract_all(col, F.lit(r"#(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))


def _links(ents: DataFrame, types: tuple[str, ...], a: str, b: str) -> DataFrame:
    return ents.where(F.col("type").isin(list(types))).select("model_id", F.col("id").alias(a), F.posexplode(_refs()).alias("_k", b))


def _numbers(col):
    return F.transform(F.regexp_extract_all(col, F.lit(f"({_NUMBER})"), F.lit(1)), lambda x: x.cast("double"))


def _point(x, y, z):
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def triangles(ents: DataFrame, types: tuple[str, ...] = ("IFCWALL",)) -> DataFrame:
    """(model_id, element_id, fid, x0..z2) of the products' bodies, in metres and in place."""
    p = ents.where("type = 'IFCCARTESIANPOINT'").select("model_id", F.col("id").alias("point"), _numbers("args").alias("n"))
    points = p.select("model_id", "point", _point(F.col("n")[0], F.coalesce(F.get("n", F.lit(1)), F.lit(0.0)), F.coalesce(F.get("n", F.lit(2)), F.lit(0.0))).alias("p"))

    def ordered(kinds: tuple[str, ...], name: str) -> DataFrame:
        met = _links(ents, kinds, name, "point").join(points, ["model_id", "point"])
        return met.groupBy("model_id", name).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "p"))), lambda s: s["p"]).alias("loop"))

    loops = ordered(("IFCPOLYLOOP",), "loop_id").where(F.size("loop") >= 3)
    bound = _links(ents, ("IFCFACEOUTERBOUND", "IFCFACEBOUND"), "bound", "loop_id").drop("_k")
    face = _links(ents, ("IFCFACE",), "face", "bound").drop("_k")
    shell = _links(ents, ("IFCCLOSEDSHELL", "IFCOPENSHELL"), "shell", "face").drop("_k")
    body = _links(ents, ("IFCFACETEDBREP", "IFCSHELLBASEDSURFACEMODEL"), "item", "shell").drop("_k")
    flat = face.join(bound, ["model_id", "bound"]).join(loops, ["model_id", "loop_id"]).groupBy("model_id", "face").agg(F.transform(F.array_sort(F.collect_list(F.struct("bound", "loop"))), lambda s: s["loop"]).alias("loops"))
    brep = body.join(shell, ["model_id", "shell"]).join(with_triangles(flat), ["model_id", "face"])
    brep = brep.select("model_id", "item", F.col("face").alias("part"), F.posexplode("cut").alias("k", "t"))

    lists = ents.where("type = 'IFCCARTESIANPOINTLIST3D'").select("model_id", F.col("id").alias("points"), _numbers(F.regexp_extract("args", r"^(\(\(.*?\)\))", 1)).alias("n"))
    sets = ents.where("type = 'IFCTRIANGULATEDFACESET'").select("model_id", F.col("id").alias("item"), _refs()[0].alias("points"), F.regexp_extract_all("args", F.lit(r"\((\d+,\d+,\d+)\)"), F.lit(1)).alias("f"))
    at = lambda n, i: _point(F.get(n, 3 * i - 3), F.get(n, 3 * i - 2), F.get(n, 3 * i - 1))
    mesh = sets.join(lists, ["model_id", "points"]).select("model_id", "item", F.lit(0).cast("bigint").alias("part"), F.col("n"), F.posexplode("f").alias("k", "abc"))
    mesh = mesh.select("model_id", "item", "part", "k", F.transform(F.split("abc", ","), lambda i: at(F.col("n"), i.cast("int"))).alias("t"))

    line = ordered(("IFCPOLYLINE",), "line")
    rect = ents.where("type = 'IFCRECTANGLEPROFILEDEF'").select("model_id", F.col("id").alias("profile"), F.slice(F.reverse(_numbers(F.regexp_replace("args", r"#\d+", ""))), 1, 2).alias("d"))
    corner = lambda sx, sy: _point(F.lit(sx / 2) * F.col("d")[1], F.lit(sy / 2) * F.col("d")[0], F.lit(0.0))
    rect = rect.select("model_id", "profile", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("loop")).select("model_id", "profile", F.array("loop").alias("loops"))
    drawn = _links(ents, ("IFCARBITRARYCLOSEDPROFILEDEF", "IFCARBITRARYPROFILEDEFWITHVOIDS"), "profile", "line").join(line, ["model_id", "line"])  # the outline, then its holes
    drawn = drawn.withColumn("loop", F.when(F.col("loop")[0] == F.element_at("loop", -1), F.slice("loop", 1, F.size("loop") - 1)).otherwise(F.col("loop"))).where(F.size("loop") >= 3)
    turned = lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0.0), lambda s, i: s + p[i]["x"] * p[(i + 1) % F.size(p)]["y"] - p[(i + 1) % F.size(p)]["x"] * p[i]["y"])
    # holes run against the outline, so that the walls of both face outwards
    drawn = drawn.withColumn("_area", turned(F.col("loop"))).groupBy("model_id", "profile").agg(F.array_sort(F.collect_list(F.struct("_k", "_area", "loop"))).alias("_s"))
    free = drawn.select("model_id", "profile", F.transform("_s", lambda s, i: F.when((i > 0) & (F.signum(s["_area"]) == F.signum(F.col("_s")[0]["_area"])), F.reverse(s["loop"])).otherwise(s["loop"])).alias("loops"))
    direction = ents.where("type = 'IFCDIRECTION'").select("model_id", F.col("id").alias("dir"), _numbers("args").alias("v"))
    solid = ents.where("type = 'IFCEXTRUDEDAREASOLID'").select("model_id", F.col("id").alias("item"), F.regexp_extract("args", r"^#(\d+),", 1).cast("bigint").alias("profile"), F.expr(r"try_cast(regexp_extract(args, '^#[0-9]+,#([0-9]+),', 1) AS BIGINT)").alias("frame"), F.regexp_extract("args", rf"#(\d+),{_NUMBER}$", 1).cast("bigint").alias("dir"), F.regexp_extract("args", rf",({_NUMBER})$", 1).cast("double").alias("depth"))
    swept = solid.join(with_triangles(rect.union(free)), ["model_id", "profile"]).join(direction, ["model_id", "dir"])
    up = lambda q: _point(*(q[c] + F.col("v")[i] * F.col("depth") for i, c in enumerate("xyz")))
    ahead = lambda p, i: p[(i + 1) % F.size(p)]
    around = lambda p: F.flatten(F.transform(p, lambda q, i: F.array(F.array(q, ahead(p, i), up(ahead(p, i))), F.array(q, up(ahead(p, i)), up(q)))))
    sides = F.flatten(F.transform("loops", around))
    swept = swept.select("model_id", "item", "frame", F.posexplode(F.concat(F.transform("cut", lambda t: F.reverse(t)), F.transform("cut", lambda t: F.transform(t, up)), sides)).alias("k", "t"))
    frames = _frames(ents, points, direction)
    swept = _placed(swept, frames, "frame").withColumn("part", F.lit(0).cast("bigint")).select("model_id", "item", "part", "k", "t")

    wall = products(ents, types).where("shape IS NOT NULL")
    shape = _links(ents, ("IFCPRODUCTDEFINITIONSHAPE",), "shape", "rep").drop("_k")
    rep = _links(ents, ("IFCSHAPEREPRESENTATION",), "rep", "item").drop("_k")
    local = ents.where("type = 'IFCLOCALPLACEMENT'").select("model_id", F.col("id").alias("placement"), F.element_at(_refs(), -1).alias("frame"))
    placed = wall.join(shape, ["model_id", "shape"]).join(rep, ["model_id", "rep"]).join(brep.unionByName(mesh).unionByName(swept), ["model_id", "item"]).join(local, ["model_id", "placement"], "left")
    placed = _placed(placed, frames, "frame").join(scale(ents), "model_id", "left")
    fid = F.row_number().over(Window.partitionBy("model_id", "element_id").orderBy("item", "part", "k")) - 1
    return placed.withColumn("fid", fid).select("model_id", "element_id", "fid", *((F.col("t")[i][c] * F.coalesce("unit", F.lit(1.0))).alias(f"{c}{i}") for i in range(3) for c in "xyz"))


def _frames(ents: DataFrame, points: DataFrame, direction: DataFrame) -> DataFrame:
    """(model_id, frame, o, xx, zz): origin and the directions of x and z, null where the file leaves them out."""
    part = lambda k: F.expr(rf"try_cast(regexp_extract(args, '^#([0-9]+)(?:,(?:#([0-9]+)|\\$))?(?:,(?:#([0-9]+)|\\$))?', {k}) AS BIGINT)")
    f = ents.where("type = 'IFCAXIS2PLACEMENT3D'").select("model_id", F.col("id").alias("frame"), part(1).alias("point"), part(2).alias("_z"), part(3).alias("_x"))
    z, x = (direction.select("model_id", F.col("dir").alias(a), F.col("v").alias(b)) for a, b in (("_z", "zz"), ("_x", "xx")))
    return f.join(points.withColumnRenamed("p", "o"), ["model_id", "point"]).join(z, ["model_id", "_z"], "left").join(x, ["model_id", "_x"], "left").select("model_id", "frame", "o", "xx", "zz")


def _placed(rows: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """Triangles ``t`` moved into a frame; rows without one stay."""
    r = rows.join(frames.withColumnRenamed("frame", key), ["model_id", key], "left")
    z = F.coalesce("zz", F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    x = F.coalesce("xx", F.when(F.abs(z[0]) > 0.9999999, F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))))
    r = r.withColumns({"_zz": z, "_xx": x}).withColumn("_d", F.expr("(_zz[0] * _xx[0] + _zz[1] * _xx[1] + _zz[2] * _xx[2]) / (_zz[0] * _zz[0] + _zz[1] * _zz[1] + _zz[2] * _zz[2])"))
    r = r.withColumn("_xx", F.expr("transform(_xx, (v, i) -> v - _d * _zz[i])"))
    for c in ("_xx", "_zz"):
        r = r.withColumn(c, F.expr(f"transform({c}, v -> v / sqrt({c}[0] * {c}[0] + {c}[1] * {c}[1] + {c}[2] * {c}[2]))"))
    r = r.withColumn("_yy", F.expr("array(_zz[1] * _xx[2] - _zz[2] * _xx[1], _zz[2] * _xx[0] - _zz[0] * _xx[2], _zz[0] * _xx[1] - _zz[1] * _xx[0])"))
    moved = F.transform("t", lambda q: _point(*(F.col("o")[c] + q["x"] * F.col("_xx")[i] + q["y"] * F.col("_yy")[i] + q["z"] * F.col("_zz")[i] for i, c in enumerate("xyz"))))
    return r.withColumn("t", F.when(F.col("o").isNotNull(), moved).otherwise(F.col("t"))).drop("o", "xx", "zz", "_xx", "_yy", "_zz", "_d")
