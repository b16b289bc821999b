"""Row types of the version log and of the index tables."""

from __future__ import annotations

#: Kinds of search parameters and the value columns of their index tables, after (resource_id).
INDEX_COLUMNS = {
    "string": "value_exact string, value_lower string",
    "token": "system string, code string, display string",
    "date": "value_low timestamp_ntz, value_high timestamp_ntz",
    "number": "value decimal(20,6), value_low decimal(20,6), value_high decimal(20,6)",
    "quantity": "value decimal(20,6), value_low decimal(20,6), value_high decimal(20,6), system string, code string",
    "uri": "value string",
    "reference": "target_type string, target_id string, identifier_system string, identifier_value string",
    "composite": "system string, code string, value decimal(20,6), value_low decimal(20,6), value_high decimal(20,6), qty_system string, qty_code string",
}
INDEX_KEY = "tenant_id string, resource_id string, version_id int, resource_type string, param_name string, last_updated timestamp_ntz"
LOG = "tenant_id string, resource_type string, fhir_id string, version_id int, last_updated timestamp_ntz, operation string, is_deleted boolean, resource string"


def index_schema(kind: str) -> str:
    return f"{INDEX_KEY}, {INDEX_COLUMNS[kind]}"


def value_columns(kind: str) -> list[str]:
    return [c.split()[0] for c in INDEX_COLUMNS[kind].split(", ")]
