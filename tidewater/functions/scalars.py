"""Scalar helpers: names, identities, set negotiation, payload views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: names that a deployment may give a topic.
TOPIC_NAME = "^[a-z0-9][a-z0-9._-]{0,127}$"


def valid_topic_name(name: Column) -> Column:
    return F.coalesce(name.rlike(TOPIC_NAME), F.lit(False))


def nonzero(x: Column) -> Column:
    """Zero stands for none."""
    return F.when(x != 0, x)


def producer_identity(topic_id: Column, producer_id: Column) -> Column:
    """32 bytes: those of both identities."""
    plain = lambda c: F.unhex(F.translate(c, "-", ""))
    return F.concat(plain(topic_id), plain(producer_id))


def uuid7(ms: Column, random: Column) -> Column:
    """Identity that sorts by time: 48 bits of milliseconds, then bits of a random 32-digit
    hexadecimal string, with version and variant in their places."""
    stamp = F.lpad(F.lower(F.hex(ms)), 12, "0")
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(random, 16, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(stamp, 1, 8), F.substring(stamp, 9, 4), F.concat(F.lit("7"), F.substring(random, 13, 3)), F.concat(variant, F.substring(random, 17, 3)), F.substring(random, 21, 12))


def negotiated(offered: Column, supported: Column, required: Column) -> Column:
    """Capabilities in common; null where a required one is missing."""
    return F.when(F.size(F.array_except(required, F.array_intersect(offered, supported))) == 0, F.array_intersect(offered, supported))


def total_bytes(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p))


def group_label(topic: Column, name: Column) -> Column:
    """A group's label: its topic, a question mark where that isn't known, and its name."""
    return F.concat_ws("/", F.coalesce(topic, F.lit("?")), name)


def rate_text(value: Column) -> Column:
    """A rate in three digits and decimal units: 950, 1.23k, 45.6M."""
    scale = F.least(F.greatest(F.floor(F.log10(F.when(value > 0, value).otherwise(F.lit(1.0))) / 3), F.lit(0)), F.lit(4)).cast("int")
    scaled = value / F.pow(F.lit(1000.0), scale)
    digits = F.when((scaled >= 100) | (value == 0), F.format_string("%.0f", scaled)).when(scaled >= 10, F.format_string("%.1f", scaled)).otherwise(F.format_string("%.2f", scaled))
    return F.concat(digits, F.element_at(F.array(*map(F.lit, ("", "k", "M", "G", "T"))), scale + 1))


def uptime_text(ms: Column) -> Column:
    """Hours, minutes and seconds, and days before them if there are any."""
    seconds = F.floor(ms / 1000).cast("long")
    clock = F.format_string("%02d:%02d:%02d", F.floor(seconds % 86_400 / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int"), (seconds % 60).cast("int"))
    return F.when(seconds < 86_400, clock).otherwise(F.concat(F.floor(seconds / 86_400).cast("string"), F.lit("d "), clock))


#: The kinds of event in benchmark payloads and their fields.
EVENT_SCHEMAS = {
    "request": "ts string, level string, service string, trace_id string, method string, path string, status int, latency_ms int",
    "session": "event string, user_id string, session string, ts string, ip string, region string, user_agent string, success boolean",
    "transaction": "type string, id string, user_id string, amount double, currency string, ts string, items array<struct<sku:string,qty:int,price:double>>",
    "metric": "type string, service string, host string, region string, ts string, cpu double, mem_mb bigint, gc_ms bigint, conns bigint",
    "error": "type string, code string, service string, region string, trace_id string, ts string, stack array<string>",
}


def event_view(payload: Column, kind: str) -> Column:
    """A payload's JSON as a struct of one kind; null where it isn't JSON."""
    return F.from_json(payload.cast("string"), EVENT_SCHEMAS[kind])
