"""Text templates and JSON payloads built from configuration, as column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def render_template(template: str, values: Mapping[str, Column]) -> Column:
    """``{name}`` replaced by the named column, whatever the case; NULL gives nothing, unknown names stay."""
    known = {name.lower(): c for name, c in values.items()}
    pieces = []
    for piece in re.split(r"(\{\w+\})", template):
        value = known.get(piece[1:-1].lower()) if piece.startswith("{") else None
        if value is not None:
            pieces.append(F.coalesce(value.cast("string"), F.lit("")))
        elif piece:
            pieces.append(F.lit(piece))
    return F.concat(*pieces) if pieces else F.lit("")


def constant(value: Any) -> Column:
    return F.parse_json(F.lit(json.dumps(value)))


def build_payload(parts: Mapping[str, Column], mappings: Sequence[Mapping[str, Any]]) -> tuple[Column, Column]:
    """(payload JSON text, missing targets) of a list of mappings.

    A mapping has a ``target`` JSON pointer and either a ``constant`` or a
    ``source`` selector on ``sourcePart``, whose record is a VARIANT in ``parts``.
    Missing optional values are left out; missing required ones are listed.
    """
    tree: dict[str, Any] = {}
    missing = []
    for mapping in mappings:
        target = mapping["target"]
        if "constant" in mapping:
            value = constant(mapping["constant"])
        else:
            record = parts.get(mapping.get("sourcePart"), F.lit(None).cast("variant"))
            value = F.try_variant_get(record, mapping.get("source", "$"), "variant")
        if mapping.get("required"):
            missing.append(F.when(value.isNull(), F.lit(target)))
        node = tree
        steps = [s.replace("~1", "/").replace("~0", "~") for s in target.lstrip("/").split("/")]
        for step in steps[:-1]:
            node = node.setdefault(step, {})
        node[steps[-1]] = value

    def build(node: dict[str, Any]) -> Column:
        fields = [build(n).alias(k) if isinstance(n, dict) else n.alias(k) for k, n in node.items()]
        return F.struct(*fields)

    absent = F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>")
    return F.to_json(build(tree)), absent
