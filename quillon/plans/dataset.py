"""What a search runs over: resources by type and index rows by parameter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..registry import Registry, SearchParam


@dataclass
class Dataset:
    """``resources(type)`` gives fhir_id, last_updated and whatever belongs to a row's body;
    ``index(param)`` gives resource_id and the value columns of the parameter's kind, or None where nothing is indexed.
    """

    spark: SparkSession
    registry: Registry
    resources: Callable[[str], DataFrame]
    index: Callable[[str, SearchParam], DataFrame | None]
    #: url -> (system, code) rows
    value_sets: Callable[[str], DataFrame | None] = lambda url: None
    #: (system, code, parent) rows of is-a hierarchies
    concepts: DataFrame | None = None
    #: list_id, target_type, target_id
    lists: DataFrame | None = None
    #: fhir_id, text of a type, for _text and _content
    texts: Callable[[str], DataFrame | None] = lambda resource_type: None
    extra: dict = field(default_factory=dict)
