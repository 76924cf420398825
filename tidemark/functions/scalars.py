"""Scalar functions of the message model, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def _bound(x: Column, f) -> Column:
    """f(x), with x computed once: a column that is mentioned twice is written out twice, and steps upon steps double each time."""
    return F.transform(F.array(x), f)[0]


def _times(x: Column, factor: int) -> Column:
    """x * factor mod 2**32 for 0 <= x < 2**32, in two halves so that nothing overflows."""
    return _bound(x, lambda v: (F.shiftleft((F.shiftright(v, 16) * factor).bitwiseAND(0xFFFF), 16) + v.bitwiseAND(0xFFFF) * factor).bitwiseAND(MASK))


def _rotated(x: Column, bits: int) -> Column:
    return _bound(x, lambda v: F.shiftleft(v, bits).bitwiseAND(MASK).bitwiseOR(F.shiftrightunsigned(v, 32 - bits)))


def _folded(x: Column, bits: int) -> Column:
    return _bound(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, bits)))


def murmur3_32(data: Column) -> Column:
    """MurmurHash3 x86 32-bit, seed 0, of bytes, as an unsigned number. The constants are the algorithm's own."""
    digits, n = F.hex(data), F.octet_length(data)
    octet = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    mixed = lambda k: _times(_rotated(_times(k, 0xCC9E2D51), 15), 0x1B873593)

    def block(h: Column, i: Column) -> Column:
        at = i * 4
        k = octet(at) + F.shiftleft(octet(at + 1), 8) + F.shiftleft(octet(at + 2), 16) + F.shiftleft(octet(at + 3), 24)
        return (_rotated(h.bitwiseXOR(mixed(k)), 13) * 5 + F.lit(0xE6546B64).cast("long")).bitwiseAND(MASK)

    blocks, rest = F.floor(n / 4).cast("int"), (n % 4).cast("int")
    none = F.lit(0).cast("long")
    h = F.aggregate(F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>")), none, block)
    tail = sum((F.when(rest > k, F.shiftleft(octet(blocks * 4 + k), 8 * k)).otherwise(none) for k in range(3)), none)
    h = h.bitwiseXOR(F.when(rest > 0, mixed(tail)).otherwise(none)).bitwiseXOR(n.cast("long"))
    return _folded(_times(_folded(_times(_folded(h, 16), 0x85EBCA6B), 13), 0xC2B2AE35), 16)


def hash_partition(key: Column, partitions: Column | int) -> Column:
    n = partitions if isinstance(partitions, Column) else F.lit(partitions)
    return (murmur3_32(key.cast("binary")) % n).cast("int")


def manual_partition(p: Column, partitions: Column) -> Column:
    return F.when(p < 0, 0).otherwise(p % partitions).cast("int")


def priority_name(p: Column) -> Column:
    return F.coalesce(F.element_at(F.array(*[F.lit(x) for x in ("critical", "high", "normal", "low", "background")]), F.when(p.between(0, 4), p + 1).cast("int")), F.lit("normal"))


def parse_priority(name: Column) -> Column:
    """Lower, title or upper case; empty and unknown names are normal."""
    out = F.lit(2)
    for i, p in reversed(list(enumerate(("critical", "high", "normal", "low", "background")))):
        out = F.when(name.isin(p, p.title(), p.upper()), i).otherwise(out)
    return out.cast("int")


def message_size(key: Column, value: Column, headers: Column | None = None) -> Column:
    """34 bytes, the key, the value, and for headers 2 and for each 4 and its two strings."""
    size = F.lit(34) + F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0))
    if headers is not None:
        each = F.aggregate(F.map_entries(headers), F.lit(0), lambda a, e: a + 4 + F.octet_length(e["key"]) + F.octet_length(e["value"]))
        size = size + F.when(F.cardinality(headers) > 0, 2 + each).otherwise(0)
    return size.cast("long")


def message_id(topic: Column, partition: Column, offset: Column) -> Column:
    return F.concat_ws(":", topic, partition.cast("string"), offset.cast("string"))


def receipt(topic: Column, partition: Column, offset: Column, deliveries: Column, nonce: Column) -> Column:
    return F.concat_ws(":", topic, partition.cast("string"), offset.cast("string"), deliveries.cast("string"), nonce)


def parse_receipt(handle: Column) -> Column:
    """(topic, partition, offset, deliveries, nonce), null unless there are five parts with numbers in the middle."""
    p = F.split(handle, ":")
    ok = (F.size(p) == 5) & F.forall(F.slice(p, 2, 3), lambda x: x.rlike(r"^-?[0-9]+$"))
    return F.when(ok, F.struct(p[0].alias("topic"), p[1].cast("int").alias("partition"), p[2].cast("long").alias("offset"), p[3].cast("int").alias("deliveries"), p[4].alias("nonce")))


def backoff_ms(attempt: Column, base: int = 1_000, times: float = 2.0, most: int = 60_000) -> Column:
    return F.when(attempt <= 1, base).otherwise(F.least(F.lit(float(most)), base * F.pow(F.lit(times), F.least(attempt, F.lit(64)) - 1))).cast("long")


def traceparent(trace_id: Column, span_id: Column, flags: Column) -> Column:
    return F.concat_ws("-", F.lit("00"), trace_id, span_id, flags)


def parse_traceparent(header: Column) -> Column:
    pattern = r"^00-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"
    got = [F.regexp_extract(header, pattern, i) for i in (1, 2, 3)]
    return F.when(got[0] != "", F.struct(got[0].alias("trace_id"), got[1].alias("span_id"), got[2].alias("flags")))


#: Levels of the timer wheel: tick in milliseconds and number of buckets; fixed values of the data model.
WHEEL = ((10, 256), (2_560, 64), (163_840, 64), (10_485_760, 64))


def wheel_level(delay_ms: Column) -> Column:
    """The level whose span covers the delay; null beyond the last."""
    out = F.lit(None).cast("int")
    for level, (tick, buckets) in reversed(list(enumerate(WHEEL))):
        out = F.when(delay_ms < tick * buckets, level).otherwise(out)
    return out


def fire_time_ms(delay_ms: Column) -> Column:
    """The delay rounded up to a tick, one at least."""
    return (F.greatest(F.ceil(delay_ms / 10), F.lit(1)) * 10).cast("long")


def duration_ms(text: Column) -> Column:
    """Durations like 1h30m, 250ms or 1.5s; null where the text is none."""
    units = {"h": 3_600_000.0, "m": 60_000.0, "s": 1_000.0, "ms": 1.0, "us": 0.001, "ns": 0.000001}
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)(ms|us|ns|h|m|s)"), 0)
    value = lambda x: F.regexp_extract(x, r"^[0-9.]+", 0).cast("double")
    unit = F.create_map(*[F.lit(v) for kv in units.items() for v in kv])
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + value(x) * unit[F.regexp_extract(x, r"[a-z]+$", 0)])
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    return F.when(text.rlike(r"^[-+]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)(ms|us|ns|h|m|s))+$"), F.round(sign * total, 6)).when(text.rlike(r"^[-+]?0$"), 0.0)


def qualified(tenant: Column, topic: Column) -> Column:
    return F.concat_ws(".", tenant, topic)


def parse_qualified(name: Column) -> Column:
    """(tenant, topic); names that begin with two underscores are the system's, names without a dot have no tenant."""
    p = F.split(name, r"\.", 2)
    system = name.startswith("__") | (F.size(p) < 2)
    return F.struct(F.when(system, "").otherwise(p[0]).alias("tenant"), F.when(system, name).otherwise(p[1]).alias("topic"))


def valid_tenant(name: Column) -> Column:
    return name.rlike(r"^[a-z][a-z0-9-]{2,63}$") & ~name.contains("__")


def valid_topic(name: Column) -> Column:
    return name.rlike(r"^[a-zA-Z0-9_-]+$") & (F.length(name) <= 255)


def dlq_topic(topic: Column) -> Column:
    return F.concat(topic, F.lit(".dlq"))


def is_dlq(topic: Column) -> Column:
    return topic.endswith(".dlq")


def original_topic(topic: Column) -> Column:
    return F.regexp_replace(topic, r"\.dlq$", "")


def segment_name(base: Column, suffix: str = ".log") -> Column:
    return F.concat(F.lpad(base.cast("string"), 20, "0"), F.lit(suffix))


def json_type(text: Column) -> Column:
    """The JSON type of a JSON text: null, boolean, integer, number, string, array or object."""
    t = F.trim(text)
    return (
        F.when(t == "null", "null").when(t.isin("true", "false"), "boolean").when(t.rlike(r"^-?[0-9]+$"), "integer").when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), "number")
        .when(t.startswith('"'), "string").when(t.startswith("["), "array").when(t.startswith("{"), "object")
    )
