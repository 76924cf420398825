"""Access rules, tenants, quotas and rate limits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What each role may do without any rule; fixed values of the data model.
ROLES = {"admin": ("read", "write", "manage"), "producer": ("write",), "consumer": ("read",), "readonly": ("read",)}


def matches(pattern: Column, name: Column) -> Column:
    """A pattern is a name, a prefix with a star behind it, or a star."""
    return (pattern == "*") | (pattern == name) | (pattern.endswith("*") & name.startswith(F.substring(pattern, 1, F.length(pattern) - 1)))


def decide(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """requests (request_id, principal, role, resource, action) with ``allowed``.

    Admins may all; else a matching deny forbids, a matching allow permits; without any rule at all the role decides; else
    no. Rules (principal, resource, action, effect) are met by principal, or as a star: an equi-join on the principal for the
    former, and a few rules for everyone for the latter, so that requests are not held against all rules.
    """
    r = rules.select(F.col("principal").alias("_p"), F.col("resource").alias("_r"), F.col("action").alias("_a"), "effect")
    fits = matches(F.col("_r"), F.col("resource")) & F.col("_a").isin("*") | (matches(F.col("_r"), F.col("resource")) & (F.col("_a") == F.col("action")))
    own = requests.join(r.where("_p <> '*'"), F.col("principal") == F.col("_p")).where(fits).select("request_id", "effect")
    everyone = requests.join(F.broadcast(r.where("_p = '*'")), fits).select("request_id", "effect")
    met = own.unionByName(everyone).groupBy("request_id").agg(F.count_if(F.col("effect") == "deny").alias("denies"), F.count_if(F.col("effect") == "allow").alias("allows"))
    any_rule = rules.limit(1).agg(F.count(F.lit(1)).alias("n_rules"))
    by_role = F.lit(False)
    for role, actions in ROLES.items():
        by_role = by_role | ((F.col("role") == role) & F.col("action").isin(*actions))
    allowed = F.when(F.col("role") == "admin", True).when(F.coalesce("denies", F.lit(0)) > 0, False).when(F.coalesce("allows", F.lit(0)) > 0, True).when(F.col("n_rules") == 0, by_role).otherwise(False)
    return requests.join(met, "request_id", "left").join(F.broadcast(any_rule)).select(*requests.columns, allowed.alias("allowed"))


#: Kinds of quota; fixed values of the data model.
QUOTAS = (
    "publish_rate", "consume_rate", "publish_bytes_rate", "consume_bytes_rate", "storage", "topics", "partitions",
    "message_size", "retention", "delay", "connections", "consumer_groups", "consumers_per_group",
)


def first_failure(checks: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """For each tenant the first check of a composite that fails, by ``order``; null where all hold."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("quota"))
    return checks.where(F.col("quota").isin(*order)).groupBy("tenant").agg(F.min(F.when(~F.col("ok"), F.struct(rank.alias("k"), "quota"))).alias("m")).select("tenant", F.col("m.quota").alias("failed"))


def publish_gate(requests: DataFrame, most: int, rate: float, burst: float, byte_rate: float, byte_burst: float) -> DataFrame:
    """requests (tenant, seq, at_s, bytes) with ``refused``: null, or the first check that fails of size, messages and bytes.

    What a check has taken stays taken when a later one fails. A tenant is two numbers of state, over sorted batches.
    """

    def gate(batches):
        who, tokens, left, last = None, 0.0, 0.0, 0.0
        for pdf in batches:
            out = []
            for tenant, at, n in zip(pdf["tenant"], pdf["at_s"], pdf["bytes"]):
                if tenant != who:
                    who, tokens, left, last = tenant, burst, byte_burst, at
                tokens, left, last = min(burst, tokens + (at - last) * rate), min(byte_burst, left + (at - last) * byte_rate), at
                why = None
                if n > most:
                    why = "message_size"
                elif tokens < 1:
                    why = "publish_rate"
                else:
                    tokens -= 1
                    if left < n:
                        why = "publish_bytes_rate"
                    else:
                        left -= n
                out.append(why)
            yield pdf.assign(refused=pd.Series(out, index=pdf.index, dtype=object))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema)
    return requests.repartition("tenant").sortWithinPartitions("tenant", "seq").mapInPandas(gate, f"{fields}, refused string")


def quota_checks(usage: DataFrame, limits: dict[str, tuple[str, str]]) -> DataFrame:
    """A row for each tenant and quota type: used, limit, and whether it holds; a limit of 0 is none.

    ``limits`` names for each type the column of what is used and of its limit. All types in one pass.
    """
    each = [F.struct(F.lit(kind).alias("quota"), F.col(used).cast("double").alias("used"), F.col(limit).cast("double").alias("most")) for kind, (used, limit) in limits.items()]
    rows = usage.select("tenant", F.explode(F.array(*each)).alias("q")).select("tenant", "q.*")
    return rows.withColumn("ok", F.coalesce((F.col("most") == 0) | (F.col("used") <= F.col("most")), F.lit(True)))


def violations(checks: DataFrame) -> DataFrame:
    return checks.where("not ok").groupBy("tenant", "quota").agg(F.count(F.lit(1)).alias("n"))


def active_only(rows: DataFrame, tenants: DataFrame) -> DataFrame:
    return rows.join(tenants.where("status = 'active'").select("tenant"), "tenant", "left_semi")


def token_bucket(requests: DataFrame, rate: float, capacity: float, keys: tuple[str, ...] = ("tenant",)) -> DataFrame:
    """requests (keys, seq, at_s, cost) with allowed, tokens left and seconds to wait, for each key in order.

    A bucket starts full and fills at ``rate`` up to ``capacity``; the clamp makes it a fold, run per key over
    sorted batches that stream through Python, so no key's requests are held at once.
    """
    keys = list(keys)

    def limit(batches):
        who, tokens, last = None, 0.0, 0.0
        for pdf in batches:
            out = []
            for row in pdf[[*keys, "at_s", "cost"]].itertuples(index=False):
                if row[:-2] != who:
                    who, tokens, last = row[:-2], capacity, row.at_s
                tokens = min(capacity, tokens + (row.at_s - last) * rate)
                last = row.at_s
                ok = tokens >= row.cost
                wait = 0.0 if ok else (row.cost - tokens) / rate
                tokens -= row.cost if ok else 0.0
                out.append((ok, round(tokens, 6), round(wait, 6)))
            yield pdf.assign(**{n: [o[i] for o in out] for i, n in enumerate(("allowed", "tokens", "wait_s"))})

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema)
    return requests.repartition(*keys).sortWithinPartitions(*keys, "at_s", "seq").mapInPandas(limit, f"{fields}, allowed boolean, tokens double, wait_s double")


def drain(log: DataFrame, weights: tuple[int, ...] = (50, 25, 15, 7, 3), keys: tuple[str, ...] = ("topic", "partition")) -> DataFrame:
    """Service order of a whole drain by deficit round-robin; ``turn`` numbers it within each partition.

    A visit adds a lane's weight to its deficit, serves one message if the deficit is positive, and goes on to the next
    lane. As weights are 1 at least, each visit of a lane that has messages serves one, whatever the weights: the order is that of
    place within the lane, then of lane, which two windows give.
    """
    if min(weights) < 1:
        raise ValueError("a lane of weight below 1 is never served")
    lane = W.partitionBy(*keys, "priority").orderBy("offset")
    rows = log.select(*keys, "offset", "priority").withColumn("_n", F.row_number().over(lane))
    return rows.withColumn("turn", F.row_number().over(W.partitionBy(*keys).orderBy("_n", "priority")).cast("long")).drop("_n")


def starving_drain(log: DataFrame, now: Column, starving_ms: int, step_ms: int = 1, lanes: int = 5, keys: tuple[str, ...] = ("topic", "partition")) -> DataFrame:
    """Service order of a drain that begins at ``now`` and takes ``step_ms`` a message.

    ``ts`` is when a message was enqueued. A lane whose head has waited more than ``starving_ms`` is served first, from the
    least urgent lane up; that does not move the round-robin on. Order depends on what came before, so each partition is one call.
    """
    keys = list(keys)

    def serve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset", ignore_index=True)
        queues = [pdf.index[pdf.priority == p].tolist() for p in range(lanes)]
        clock, enqueued = pdf["_now"].tolist(), pdf["_at"].tolist()
        heads, order, lane = [0] * lanes, [], 0
        for turn in range(len(pdf)):
            pick = None
            for p in reversed(range(lanes)):
                if heads[p] < len(queues[p]):
                    i = queues[p][heads[p]]
                    if clock[i] + turn * step_ms - enqueued[i] > starving_ms:
                        pick = p
                        break
            if pick is None:
                while heads[lane] == len(queues[lane]):
                    lane = (lane + 1) % lanes
                pick, lane = lane, (lane + 1) % lanes
            order.append(queues[pick][heads[pick]])
            heads[pick] += 1
        return pdf.loc[order, [*keys, "offset", "priority"]].assign(turn=range(1, len(order) + 1))

    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    rows = log.select(*keys, "offset", "priority", ms(F.col("ts")).alias("_at"), ms(now).alias("_now"))
    return rows.groupBy(*keys).applyInPandas(serve, "topic string, partition int, offset long, priority int, turn long")
