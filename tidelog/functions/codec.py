"""Message payloads and metadata to JSON text and back.

Unset strings are empty and are left out of the text. Decoding is strict: a type
outside the registry, broken JSON and a field that the type does not have are
three different errors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MESSAGES, NAMESPACE, type_name


def rfc3339(time: Column) -> Column:
    """UTC text of a timestamp, with as many digits of a second as it has, as the JSON form of a message writes it."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(time, "SSSSSS")
    digits = F.when(micros == "000000", "").when(F.endswith(micros, F.lit("000")), F.concat(F.lit("."), F.substring(micros, 1, 3))).otherwise(F.concat(F.lit("."), micros))
    return F.concat(whole, digits, F.lit("Z"))


def _set(value: Column) -> Column:
    return F.when(value != "", value)


def encode(message: str, **fields: Column) -> Column:
    """JSON text of a message; null and empty fields are left out."""
    values = [(rfc3339(fields[f]) if f == "expires_at" else _set(fields[f])).alias(f) for f in MESSAGES[message] if f in fields]
    return F.to_json(F.struct(*values))


def encode_by_type(kind: Column, fields: dict[str, Column]) -> Column:
    """JSON text of whichever message kind (a short name) says; null for an unknown kind."""
    out = F.lit(None).cast("string")
    for message, names in MESSAGES.items():
        out = F.when(kind == message, encode(message, **{n: fields[n] for n in names if n in fields})).otherwise(out)
    return out


def encode_meta(correlation_id: Column, causation_id: Column, trace_id: Column | None = None) -> Column:
    trace = [_set(trace_id).alias("trace_id")] if trace_id is not None else []
    return F.to_json(F.struct(*trace, _set(correlation_id).alias("correlation_id"), _set(causation_id).alias("causation_id")))


def decode(kind: Column, data: Column, namespace: str = NAMESPACE) -> Column:
    """message, hold_id, booking_id, seat_id, reason, expires_at and error of a stored payload."""
    parsed = F.from_json(data, "hold_id string, booking_id string, seat_id string, reason string, expires_at string", {"mode": "PERMISSIVE"})
    keys = F.json_object_keys(data)
    message = F.lit(None).cast("string")
    allowed = F.lit(None).cast("array<string>")
    for name, fields in MESSAGES.items():
        is_it = kind == type_name(name, namespace)
        message = F.when(is_it, name).otherwise(message)
        allowed = F.when(is_it, F.array(*map(F.lit, fields))).otherwise(allowed)
    extra = F.array_sort(F.array_except(keys, allowed))
    error = F.when(message.isNull(), "unknown type").when(keys.isNull(), "malformed").when(F.size(extra) > 0, F.concat(F.lit("unknown field "), F.element_at(extra, 1)))
    text = lambda f: F.coalesce(parsed[f], F.lit("")).alias(f)
    return F.struct(message.alias("message"), text("hold_id"), text("booking_id"), text("seat_id"), text("reason"), F.to_timestamp(parsed["expires_at"]).alias("expires_at"), error.alias("error"))
