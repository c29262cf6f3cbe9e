"""The engine over model files: every level a lazy table, all models at once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import classify, context, measure, mesh, pairs, solid, spread, terrain
from .rules.evaluate import evaluate, summary
from .rules.rulesets import ruleset as shipped
from .sources import site, spf
from .sources.cut import cut


class Models:
    """Models read from files; elements are keyed by model and instance, packed into one column ``element_id``."""

    def __init__(self, spark: SparkSession, paths: str | list[str], types: tuple[str, ...] = ("IFCWALL",)):
        self.files = spf.texts(spark, paths)
        self.entities = cut(spf.entities(self.files))
        self.types = site.with_subtypes(types)
        self._key = F.concat_ws("#", "model_id", "element_id").alias("element_id")

    @cached_property
    def elements(self) -> DataFrame:
        return site.typed(spf.products(self.entities, self.types), self.entities).select(self._key, "model_id", "global_id", "name", "entity_type", "predefined_type")

    @cached_property
    def coordinate_systems(self) -> DataFrame:
        return site.coordinate_systems(self.entities)

    @cached_property
    def alignments(self) -> DataFrame:
        return site.alignments(self.entities)

    @cached_property
    def errors(self) -> DataFrame:
        return spf.load_errors(self.files)

    @cached_property
    def triangles(self) -> DataFrame:
        """Corners that coincide are one vertex; degenerate triangles go."""
        t = cut(spf.triangles(self.entities, self.types).select(self._key, "fid", *(f"{c}{i}" for i in range(3) for c in "xyz")))  # steps below read it several times
        corner = t.select("element_id", "fid", F.posexplode(F.array(*(F.struct(*(F.col(f"{c}{i}").alias(c) for c in "xyz")) for i in range(3)))).alias("i", "p"))
        place = [F.round(F.col(f"p.{c}"), 8) for c in "xyz"]
        ids = corner.withColumn("v", F.dense_rank().over(Window.partitionBy("element_id").orderBy(*place)))
        abc = ids.groupBy("element_id", "fid").agg(*(F.max(F.when(F.col("i") == i, F.col("v"))).alias(n) for i, n in enumerate("abc")))
        welded = t.join(abc, ["element_id", "fid"])
        welded = cut(mesh.drop_degenerate(welded).select(welded.columns))
        return welded

    @cached_property
    def vertices(self) -> DataFrame:
        return self.solids.select("element_id", F.inline("v"))

    @cached_property
    def solids(self) -> DataFrame:
        """A row an element, with levels 2 and 3."""
        return cut(measure.enriched(classify.classified(solid.rows(spread.dealt(self.triangles, "element_id", 1)))))

    @cached_property
    def measurements(self) -> DataFrame:
        """The rules' context, with contact, neighbours, alignments and, where a model has a site, its terrain: all models in one plan."""
        ground = cut(spf.triangles(self.entities, ("IFCSITE",)).select("model_id", "fid", *(f"{c}{i}" for i in range(3) for c in "xyz")))
        distances = pairs.vertex_distances(pairs.box_pairs(self._boxes, 10.0, group="model_id"), self.vertices)
        own = measure.flat(self.solids).join(self.alignment_context.drop("line_id", "i"), "element_id", "left")
        if ground.isEmpty():
            return cut(context.joined(own, self.pairs(), distances))
        return cut(context.joined(own, self.pairs(), distances, self._keyed(self.solids), ground, "model_id"))

    @cached_property
    def alignment_context(self) -> DataFrame:
        """Elements with their model's nearest alignment vertex, its distance, the bend there and their own radius over it."""
        walls = self._keyed(self.solids).selectExpr("model_id", "element_id", "(min_x + max_x) / 2 AS x", "(min_y + max_y) / 2 AS y", "min_radius_m")
        near = terrain.alignment_context(walls, self.alignments.drop("name"), group="model_id")
        return near.withColumnsRenamed({"distance_m": "min_alignment_distance_m", "radius": "alignment_radius_m", "radius_ratio": "alignment_radius_ratio"})

    @staticmethod
    def _keyed(elements: DataFrame) -> DataFrame:
        return elements.withColumn("model_id", F.substring_index("element_id", "#", 1))

    @property
    def _boxes(self) -> DataFrame:
        return self._keyed(self.solids.select("element_id", *(f"{n}_{c}" for c in "xyz" for n in ("min", "max", "size"))))

    def pairs(self, reach: float = 1.0) -> DataFrame:
        faces = self.solids.select("element_id", F.inline("t"))
        return pairs.contact(pairs.box_pairs(self._boxes, reach, group="model_id"), faces)

    def checks(self, rules: dict | str = "retaining_wall") -> DataFrame:
        return evaluate(self.measurements, shipped(rules) if isinstance(rules, str) else rules)

    def verdicts(self, rules: dict | str = "retaining_wall") -> DataFrame:
        return summary(self.checks(rules))
