"""Q1-Q9: counters, quotas, tiers, throttling and tokens.

Times are read in the session time zone, which is UTC.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.operators.components import connected_components
from larder.session import staged

# What each action uses, and how much of it a period allows.
BUCKETS_OF = {"capture": ("captures",), "album": ("captures",), "ask": ("questions",), "ask_verify": ("questions", "verifications"), "brief": ("questions", "verifications")}
LIMITS = {"captures": 20, "questions": 50, "verifications": 10}
PRO_FACTOR = 10


def period(bucket: Column, ts: Column) -> Column:
    return F.when(bucket == "captures", F.date_format(ts, "yyyy-MM")).otherwise(F.date_format(ts, "yyyy-MM-dd"))


def resets_at(bucket: Column, ts: Column) -> Column:
    """The first day after the period, as a date."""
    return F.when(bucket == "captures", F.add_months(F.trunc(ts, "month"), 1)).otherwise(F.date_add(F.to_date(ts), 1))


def exploded(events: DataFrame) -> DataFrame:
    """Events (user_id, action, ts) as a row per bucket used."""
    used = F.create_map(*[x for a, b in BUCKETS_OF.items() for x in (F.lit(a), F.array(*map(F.lit, b)))])
    return events.withColumn("bucket", F.explode(F.try_element_at(used, F.col("action"))))


def usage_counters(events: DataFrame) -> DataFrame:
    """Q1: (user_id, bucket, period, n)."""
    own = exploded(events).withColumn("period", period(F.col("bucket"), F.col("ts")))
    return own.groupBy("user_id", "bucket", "period").agg(F.count("*").alias("n"))


def limits(spark: SparkSession, values: dict[str, int] | None = None) -> DataFrame:
    """Q4: (tier, bucket, quota)."""
    rows = [(t, b, q * (PRO_FACTOR if t == "pro" else 1)) for t in ("free", "pro") for b, q in (values or LIMITS).items()]
    return spark.createDataFrame(rows, "tier string, bucket string, quota int")


def admit(events: DataFrame, quotas: DataFrame) -> DataFrame:
    """Q2: (event_id, bucket, period, used, admitted): events carry tier; what was denied uses nothing, so the
    first `quota` events of a period are those admitted. Buckets decide on their own."""
    own = exploded(events).withColumn("period", period(F.col("bucket"), F.col("ts"))).join(F.broadcast(quotas), ["tier", "bucket"])
    n = F.row_number().over(Window.partitionBy("user_id", "bucket", "period").orderBy("ts", "event_id"))
    return own.withColumn("n", n).select("event_id", "bucket", "period", F.least("n", "quota").alias("used"), (F.col("n") <= F.col("quota")).alias("admitted"))


def effective_tier(events: DataFrame, grants: DataFrame) -> DataFrame:
    """Q3: events with `tier`: pro when the user's last grant so far says pro and has not expired (null: never). Grants
    and events of a user share one pass in time order; at equal times the grant comes first."""
    g = grants.select("user_id", "ts", F.struct(F.col("tier").alias("t"), F.col("expires_at").alias("until")).alias("grant"))
    both = events.withColumns({"grant": F.lit(None).cast(g.schema["grant"].dataType), "__late": F.lit(1)}).unionByName(g.withColumn("__late", F.lit(0)), allowMissingColumns=True)
    last = F.last("grant", ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts", "__late").rowsBetween(Window.unboundedPreceding, 0))
    known = both.withColumn("grant", last).where("__late = 1")
    pro = (F.col("grant.t") == "pro") & (F.col("grant.until").isNull() | (F.col("grant.until") > F.col("ts")))
    return known.withColumn("tier", F.when(F.coalesce(pro, F.lit(False)), "pro").otherwise("free")).drop("grant", "__late")


def usage_summary(users: DataFrame, counters: DataFrame, quotas: DataFrame, now: Column) -> DataFrame:
    """Q5: (user_id, bucket, used, quota, resets_at) of every bucket, zero where nothing was used; users carry tier."""
    all_ = users.select("user_id", "tier").join(F.broadcast(quotas), "tier").withColumn("period", period(F.col("bucket"), now))
    met = all_.join(counters, ["user_id", "bucket", "period"], "left")
    return met.select("user_id", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("used"), "quota", resets_at(F.col("bucket"), now).alias("resets_at"))


def fold_subscriptions(checks: DataFrame) -> DataFrame:
    """Q6: checks (user_id, ts, event_id, payment_state, expires_at) with `tier` and `pro_expires_at` after each: a paid,
    unexpired purchase grants pro and only ever extends; an invalid check drops to free once the stored end passed."""
    paid = F.col("payment_state").isNull() | F.col("payment_state").isin(1, 2)
    valid = F.coalesce(paid & (F.col("expires_at") > F.col("ts")), F.lit(False))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    own = checks.withColumn("valid", valid).withColumn("pro_expires_at", F.max(F.when(F.col("valid"), F.col("expires_at"))).over(w))
    # between checks the tier stays as it was left, so the check's own time decides
    return own.withColumn("tier", F.when(F.col("valid") | F.coalesce(F.col("pro_expires_at") > F.col("ts"), F.lit(False)), "pro").otherwise("free")).drop("valid")


def failure_rate(attempts: DataFrame, key: str, window_s: int = 600) -> DataFrame:
    """Q7, the report: attempts with `recent`, the failures of the key in the window_s seconds up to each."""
    at = F.unix_micros(F.to_timestamp("ts"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-window_s * 1_000_000 + 1, 0)
    return attempts.withColumn("recent", F.count_if(~F.col("success")).over(w))


class _Recorded:
    """Failures of the last window by key, in order of time; what has expired is forgotten."""

    def __init__(self):
        self.by_key: dict = {}
        self.order: deque = deque()

    def add(self, key: str, at: float) -> None:
        self.by_key.setdefault(key, deque()).append(at)
        self.order.append((at, key))

    def forget(self, key: str) -> None:
        self.by_key.pop(key, None)

    def until(self, limit: float) -> None:
        while self.order and self.order[0][0] <= limit:
            at, key = self.order.popleft()
            held = self.by_key.get(key)
            if held and held[0] == at:  # else it was forgotten, and the key's records are newer
                held.popleft()
                if not held:
                    del self.by_key[key]

    def times(self, key: str) -> deque:
        return self.by_key.get(key, ())


_ROW = "kind int, event_id long, ip string, account string, success boolean, at double"
_FED = "kind int, event_id long, ip string, account string, success boolean, at double, allowed boolean, retry_after long"


def attempt_rows(attempts: DataFrame) -> DataFrame:
    """Attempts as rows of kind 2; recorded failures are rows of kind 0 (of an IP) and 1 (of an account)."""
    return attempts.select(F.lit(2).alias("kind"), F.col("event_id").cast("long").alias("event_id"), F.col("ip").cast("string").alias("ip"), F.col("account").cast("string").alias("account"), "success", (F.unix_micros(F.to_timestamp("ts")) / 1e6).alias("at"))


def _fed(per_ip: int, per_account: int, window_s: float):
    """Over rows sorted by (part, kind, at, event_id) for recorded failures, then attempts: decisions, and behind each part
    the failures that are still recorded. Holds one window's failures of one part."""

    def run(batches):
        part, ips, accounts, now = None, _Recorded(), _Recorded(), 0.0

        def left() -> list:
            return [(kind, None, k if kind == 0 else None, k if kind == 1 else None, False, t, None, None) for kind, held in ((0, ips), (1, accounts)) for k, times in held.by_key.items() for t in times]

        def table(rows: list) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.bool_(), pa.int64())
            columns = list(zip(*rows)) or [[]] * 8
            names = ["kind", "event_id", "ip", "account", "success", "at", "allowed", "retry_after"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            out = []
            for own, kind, event, ip, account, success, at in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "event_id", "ip", "account", "success", "at"))):
                if own != part:
                    out += left()
                    part, ips, accounts = own, _Recorded(), _Recorded()
                if kind < 2:
                    (ips if kind == 0 else accounts).add(ip if kind == 0 else account, at)
                    continue
                ips.until(at - window_s)
                accounts.until(at - window_s)
                blocked = None
                for held, key, most in ((ips, ip, per_ip), (accounts, account, per_account)):
                    times = held.times(key)
                    if blocked is None and len(times) >= most:
                        blocked = max(1, int(times[0] + window_s - at) + 1)
                if blocked is None:
                    if success:
                        accounts.forget(account)
                    else:
                        ips.add(ip, at)
                        accounts.add(account, at)
                out.append((2, event, ip, account, success, at, blocked is None, blocked))
            yield table(out)
        yield table(left())

    return run


def decide(attempts: DataFrame, records: DataFrame, per_ip: int, per_account: int, window_s: float) -> tuple[DataFrame, DataFrame]:
    """(event_id, allowed, retry_after) of attempt_rows, and the failures recorded afterwards, those of keys that nobody used included.

    Accounts and IPs that attempts connect are one part (connected components). Parts are spread over partitions, sorted by time
    within them, and fed through in Arrow batches: no part is gathered, however large."""
    name = lambda c, k: F.concat(F.lit(c), F.coalesce(F.col(k), F.lit("")))
    parts = staged(connected_components(attempts.select(name("i", "ip").alias("a"), name("a", "account").alias("b")), "a", "b"), "throttle-parts")
    of = parts.withColumnRenamed("component", "part")
    fed = attempts.withColumn("node", name("i", "ip")).join(of, "node")
    known = records.withColumn("node", F.when(F.col("kind") == 0, name("i", "ip")).otherwise(name("a", "account"))).join(of, "node", "left")
    both = fed.unionByName(known.where("part IS NOT NULL")).drop("node")
    columns = ["part", "kind", "event_id", "ip", "account", "success", "at"]
    ordered = both.select(*columns).repartition("part").sortWithinPartitions("part", F.col("kind") == 2, "at", "event_id")
    out = staged(ordered.mapInArrow(_fed(per_ip, per_account, window_s), _FED), "throttle-decided")
    decided = out.where("kind = 2").select("event_id", "allowed", "retry_after")
    newest = attempts.agg(F.max("at")).first()[0]
    row = [c.split()[0] for c in _ROW.split(", ")]
    left = out.where("kind < 2").unionByName(known.where("part IS NULL").select(*row).withColumns({"allowed": F.lit(None).cast("boolean"), "retry_after": F.lit(None).cast("long")})).select(*row)
    return decided, left if newest is None else left.where(F.col("at") > newest - window_s)


def login_throttle(attempts: DataFrame, per_ip: int = 20, per_account: int = 8, window_s: int = 600) -> DataFrame:
    """Q7, exact: (event_id, allowed, retry_after). A blocked attempt is not recorded, a success clears the account
    alone, and the IP is asked before the account, so decisions depend on the order over linked keys (`decide`). Null keys are
    one key."""
    rows = staged(attempt_rows(attempts), "throttle-attempts")
    none = attempts.sparkSession.createDataFrame([], _ROW)
    return decide(rows, none, per_ip, per_account, window_s)[0]


def intent_history(events: DataFrame, keep: int = 20, context: int = 5) -> DataFrame:
    """Q8: (user_id, history, recent): each user's newest `keep` intents, newest last, and the last `context` of
    them; rows without a domain are left out."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    own = events.where("domain is not null").withColumn("n", n).where(F.col("n") <= keep)
    g = own.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("x"), F.struct("domain", "intent").alias("i")))), lambda r: r["i"]).alias("history"))
    return g.select("user_id", "history", F.when(F.size("history") > context, F.slice("history", -context, context)).otherwise(F.col("history")).alias("recent"))


def token_audit(presented: DataFrame, tokens: DataFrame) -> DataFrame:
    """Q9: (event_id, verdict): unknown, revoked (presented after it was), expired, jti_mismatch, ok."""
    met = presented.join(tokens.select("token_hash", F.col("jti").alias("known_jti"), "expires_at", "revoked_at"), "token_hash", "left")
    verdict = F.when(F.col("known_jti").isNull(), "unknown").when(F.col("revoked_at") < F.col("ts"), "revoked").when(F.col("expires_at") <= F.col("ts"), "expired").when(F.col("known_jti") != F.col("jti"), "jti_mismatch").otherwise("ok")
    return met.select("event_id", verdict.alias("verdict"))
