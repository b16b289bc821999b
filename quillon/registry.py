"""Search parameters by resource type and name, and compartments."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("string", "token", "date", "number", "quantity", "uri", "reference", "composite", "special")


@dataclass(frozen=True)
class SearchParam:
    """``components`` of a composite: (parameter or path, kind) pairs."""

    resource_type: str
    name: str
    kind: str
    expression: str = ""
    targets: tuple[str, ...] = ()
    components: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}")


#: Parameters that every resource type has.
UNIVERSAL = {
    "_tag": SearchParam("Resource", "_tag", "token", "meta.tag"),
    "_security": SearchParam("Resource", "_security", "token", "meta.security"),
    "_language": SearchParam("Resource", "_language", "token", "language"),
    "_profile": SearchParam("Resource", "_profile", "uri", "meta.profile"),
    "_source": SearchParam("Resource", "_source", "uri", "meta.source"),
}


@dataclass
class Registry:
    params: dict[tuple[str, str], SearchParam] = field(default_factory=dict)
    #: (owner type, target type) -> reference parameters that put a target row in the owner's compartment.
    compartments: dict[tuple[str, str], tuple[str, ...]] = field(default_factory=dict)

    def register(self, *params: SearchParam, replace: bool = True) -> None:
        """``replace=False``: what is known stays (base definitions win over packages)."""
        for p in params:
            if replace or (p.resource_type, p.name) not in self.params:
                self.params[p.resource_type, p.name] = p

    def remove(self, resource_type: str, name: str) -> None:
        self.params.pop((resource_type, name), None)

    def get(self, resource_type: str, name: str) -> SearchParam | None:
        return UNIVERSAL.get(name) or self.params.get((resource_type, name))

    def of_type(self, resource_type: str) -> list[SearchParam]:
        return [p for (t, _), p in sorted(self.params.items()) if t == resource_type]

    def types(self) -> list[str]:
        return sorted({t for t, _ in self.params})

    def references(self, resource_type: str) -> list[SearchParam]:
        return [p for p in self.of_type(resource_type) if p.kind == "reference"]

    def reverse_includes(self) -> dict[str, list[str]]:
        """Target type -> "Source:param" of the references that can point at it."""
        found = defaultdict(list)
        for (t, name), p in sorted(self.params.items()):
            for target in p.targets if p.kind == "reference" else ():
                found[target].append(f"{t}:{name}")
        return dict(found)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p.resource_type, p.name, p.kind, p.expression, list(p.targets)) for _, p in sorted(self.params.items())]
        return spark.createDataFrame(rows, "resource_type string, name string, kind string, expression string, targets array<string>")

    def capability(self, spark: SparkSession) -> DataFrame:
        """For each type its parameters, and what it can include and be included by."""
        params = self.frame(spark)
        own = params.groupBy("resource_type").agg(
            F.sort_array(F.collect_list(F.struct("name", "kind"))).alias("search_params"),
            F.sort_array(F.collect_list(F.when(F.col("kind") == "reference", F.concat_ws(":", "resource_type", "name")))).alias("includes"),
        )
        back = params.where("kind = 'reference'").select(F.explode("targets").alias("target"), F.concat_ws(":", "resource_type", "name").alias("source"))
        back = back.groupBy("target").agg(F.sort_array(F.collect_list("source")).alias("rev_includes"))
        return own.join(back, own.resource_type == back.target, "left").select("resource_type", "search_params", "includes", F.coalesce("rev_includes", F.array().cast("array<string>")).alias("rev_includes"))
