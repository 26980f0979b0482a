"""Fields of message payloads and written documents, read from VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtel.functions import variants as v

UNMAPPED = "(unmapped)"


def message_label(record: Column) -> Column:
    """``action/actionModifier``, else the action, else the event type, else a placeholder."""
    action = F.nullif(v.text(record, "$.payload.action"), F.lit(""))
    modifier = F.nullif(v.text(record, "$.payload.actionModifier"), F.lit(""))
    kind = F.nullif(v.text(record, "$.eventType"), F.lit(""))
    return F.coalesce(F.concat(action, F.lit("/"), modifier), action, kind, F.lit(UNMAPPED))


def view_ref(payload: Column) -> Column:
    """Struct (id, instance_id) from the payload's ``context``, which is JSON held as text."""
    context = F.try_parse_json(F.nullif(v.text(payload, "$.context"), F.lit("")))
    return F.struct(
        v.text(context, "$.Blade.id").alias("id"), v.text(context, "$.Blade.instanceId").alias("instance_id")
    )


def doc_fields(document: Column) -> Column:
    """Typed fields of a document: text only where it is text, numbers only where they are numbers."""
    return F.struct(
        v.text(document, "$.id").alias("doc_id"),
        v.text(document, "$.type").alias("doc_type"),
        v.text(document, "$.bladeName").alias("blade_name"),
        v.number(document, "$.dwellMs").alias("dwell_ms"),
        v.text(document, "$.dwellSource").alias("dwell_source"),
        v.text(document, "$.sealedReason").alias("sealed_reason"),
        F.when(v.is_object(document, "$.perf"), F.try_variant_get(document, "$.perf", "map<string,double>")).alias("perf"),
    )
