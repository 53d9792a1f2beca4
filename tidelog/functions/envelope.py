"""Message envelopes: identity attributes as transport headers and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attribute to header name, mandatory ones first.
MANDATORY = {"id": "ce_id", "source": "ce_source", "type": "ce_type"}
OPTIONAL = {"subject": "ce_subject", "correlation_id": "ce_correlationid", "causation_id": "ce_causationid", "traceparent": "traceparent"}
SPEC_VERSION = "1.0"
CONTENT_TYPE = "application/protobuf"


def render(**attributes: Column) -> Column:
    """The headers of an envelope. Mandatory ones are always there, optional ones only if not empty."""
    fixed = F.create_map(F.lit("ce_specversion"), F.lit(SPEC_VERSION), F.lit("content-type"), F.lit(CONTENT_TYPE), *[x for a, h in MANDATORY.items() for x in (F.lit(h), F.coalesce(attributes[a], F.lit("")))])
    pairs = [x for a, h in OPTIONAL.items() if a in attributes for x in (F.lit(h), F.coalesce(attributes[a], F.lit("")))]
    return F.map_concat(fixed, F.map_filter(F.create_map(*pairs), lambda _, v: v != "")) if pairs else fixed


def parse(headers: Column) -> Column:
    """The attributes and the first error, in the order: version missing, version other, id, source, type missing."""
    get = lambda h: F.coalesce(F.try_element_at(headers, F.lit(h)), F.lit(""))
    version = get("ce_specversion")
    error = F.when(version == "", "missing attribute ce_specversion").when(version != SPEC_VERSION, F.concat(F.lit("unsupported ce_specversion "), version))
    for h in ("ce_id", "ce_source", "ce_type"):
        error = error.when(get(h) == "", f"missing attribute {h}")
    return F.struct(*[get(h).alias(a) for a, h in (MANDATORY | OPTIONAL).items()], error.alias("error"))


def validate_message(topic: Column, key: Column, payload: Column) -> Column:
    """Why a message cannot be published, in the order topic, key, payload; null if it can."""
    empty = lambda c: F.coalesce(c == F.lit("").cast("string"), F.lit(True))
    return F.when(empty(topic), "no topic").when(empty(key), "no key").when(F.coalesce(F.length(payload) == 0, F.lit(True)), "no payload")


def validate_event(kind: Column, data: Column) -> Column:
    """Why an event cannot be appended; null if it can."""
    return F.when(F.coalesce(kind == "", F.lit(True)), "no type").when(F.coalesce(F.length(data) == 0, F.lit(True)), "no data")


def validate_inbox_key(consumer: Column, source: Column, event_id: Column) -> Column:
    out = None
    for name, column in (("consumer", consumer), ("source", source), ("event_id", event_id)):
        bad = F.coalesce(column == "", F.lit(True))
        out = F.when(bad, f"no {name}") if out is None else out.when(bad, f"no {name}")
    return out


def header_text(headers: Column) -> Column:
    """Headers as one text, sorted by name, to compare or to print."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def to_record_headers(headers: Column) -> Column:
    """A header map as the list of name and bytes that a transport carries."""
    return F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(e["key"].alias("key"), F.encode(e["value"], "UTF-8").alias("value")))


def from_record_headers(headers: Column) -> Column:
    """The inverse; of repeated names the last counts."""
    named = F.transform(headers, lambda h: F.struct(h["key"].alias("key"), F.decode(h["value"], "UTF-8").alias("value")))
    size = F.size(named)
    last = F.filter(named, lambda h, i: ~F.exists(F.slice(named, i + 2, F.greatest(size - i - 1, F.lit(0))), lambda later: later["key"] == h["key"]))
    return F.map_from_entries(last)
