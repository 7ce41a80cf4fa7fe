"""Field specifications and the catalog that filters and aggregates are bound to."""

from __future__ import annotations

from dataclasses import dataclass, field

TYPES = ("list", "enum", "boolean", "string")
# Names a schema may not use.
RESERVED_FIELD_NAMES = ("account_name", "call_date", "call_event_date", "call_id", "call_type", "calllog_id", "customer_id", "date", "source_index", "source_record_id")
NOT_MENTIONED = "not_mentioned"


@dataclass(frozen=True)
class FieldSpec:
    """A silver field. ``type`` is one of TYPES; string fields may hold numbers."""

    name: str
    type: str
    description: str = ""
    allowed_values: tuple[str, ...] = ()
    downstream_use_cases: tuple[str, ...] = ()
    filterable: bool = True
    facetable: bool = True
    aggregatable: bool = True


@dataclass(frozen=True)
class Catalog:
    """Fields by name, in order."""

    fields: dict[str, FieldSpec] = field(default_factory=dict)

    @classmethod
    def of(cls, *specs: FieldSpec) -> Catalog:
        return cls({s.name: s for s in specs})

    def __getitem__(self, name: str) -> FieldSpec:
        if name not in self.fields:
            raise ValueError(f"unknown field: {name}")
        return self.fields[name]


def validate_specs(payload: list[dict], most: int = 24) -> list[FieldSpec]:
    """Specs from a schema payload: names normalised, reserved and repeated ones refused, enums
    led by ``not_mentioned`` where it is missing."""
    import re

    out: dict[str, FieldSpec] = {}
    for item in payload:
        name = re.sub(r"[^a-z0-9]+", "_", str(item.get("name", "")).strip().lower()).strip("_")
        kind = item.get("type")
        if not name or name in RESERVED_FIELD_NAMES:
            raise ValueError(f"field name not allowed: {name!r}")
        if name in out:
            raise ValueError(f"field given twice: {name}")
        if kind not in TYPES:
            raise ValueError(f"field type not allowed: {kind!r}")
        values = list(dict.fromkeys(v for v in (re.sub(r"[^a-z0-9]+", "_", str(v).strip().lower()).strip("_") for v in item.get("allowed_values") or []) if v))
        if kind in ("list", "enum") and not values:
            raise ValueError(f"{name}: allowed_values are missing")
        if kind == "enum" and NOT_MENTIONED not in values:
            values.insert(0, NOT_MENTIONED)
        flags = {k: bool(item.get(k, True)) for k in ("filterable", "facetable", "aggregatable")}
        out[name] = FieldSpec(name, kind, str(item.get("description", "")), tuple(values), tuple(item.get("downstream_use_cases") or ()), **flags)
        if len(out) > most:
            raise ValueError(f"more than {most} fields")
    if not out:
        raise ValueError("a schema needs a field")
    return list(out.values())
