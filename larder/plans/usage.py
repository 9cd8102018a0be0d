"""Q1-Q9 over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import usage
from larder.plans.base import Plans, view

plan = Plans()

SMALL = {"captures": 6, "questions": 1, "verifications": 1}
_USED = "u AS (SELECT *, CASE WHEN bucket = 'captures' THEN strftime(ts, '%Y-%m') ELSE strftime(ts, '%Y-%m-%d') END AS period FROM (SELECT *, unnest(CASE action WHEN 'capture' THEN ['captures'] WHEN 'ask' THEN ['questions'] ELSE ['questions', 'verifications'] END) AS bucket FROM usage_v))"
_QUOTAS = "l AS (SELECT * FROM (VALUES ('free', 'captures', 6), ('free', 'questions', 1), ('free', 'verifications', 1), ('pro', 'captures', 60), ('pro', 'questions', 10), ('pro', 'verifications', 10)) v(tier, bucket, quota))"
# every signup grants pro for 5 days, without an end for some users; every error takes it away
_GRANTS = "SELECT event_id, user_id, ts, CASE WHEN event_type = 'signup' THEN 'pro' ELSE 'free' END AS tier, CASE WHEN user_id % 11 <> 0 THEN ts + INTERVAL '5' DAY END AS expires_at FROM events WHERE event_type IN ('signup', 'error')"
_TIERS = f"g AS ({_GRANTS}), e AS (SELECT u.*, (SELECT arg_max((g.tier = 'pro' AND (g.expires_at IS NULL OR g.expires_at > u.ts)), (g.ts, g.event_id)) FROM g WHERE g.user_id = u.user_id AND g.ts <= u.ts) AS pro FROM usage_v u), t AS (SELECT event_id, user_id, ts, action, CASE WHEN pro THEN 'pro' ELSE 'free' END AS tier FROM e)"


def _grants(spark, sf_dir):
    view(spark, sf_dir, "captures_v")
    return spark.sql(_GRANTS)


@plan(f"WITH {_USED} SELECT user_id, bucket, period, count(*) AS n FROM u GROUP BY ALL")
def q1_usage_counters(spark, sf_dir):
    return usage.usage_counters(view(spark, sf_dir, "usage_v"))


@plan(f"""WITH {_TIERS}, {_USED.replace('usage_v', 't')}, {_QUOTAS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, bucket, period ORDER BY ts, event_id) AS n FROM u JOIN l USING (tier, bucket) WHERE tier = 'free')
    SELECT event_id, bucket, period, least(n, quota) AS used, n <= quota AS admitted FROM n""")
def q2_admit(spark, sf_dir):
    tiered = usage.effective_tier(view(spark, sf_dir, "usage_v"), _grants(spark, sf_dir)).where("tier = 'free'")
    return usage.admit(tiered.select("event_id", "user_id", "ts", "action", "tier"), usage.limits(spark, SMALL))


@plan(f"WITH {_TIERS} SELECT event_id, tier FROM t")
def q3_effective_tier(spark, sf_dir):
    return usage.effective_tier(view(spark, sf_dir, "usage_v"), _grants(spark, sf_dir)).select("event_id", "tier")


@plan("SELECT t.user_id, l.bucket, l.quota FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'pro' ELSE 'free' END AS tier FROM events) t JOIN (VALUES ('free', 'captures', 20), ('free', 'questions', 50), ('free', 'verifications', 10), ('pro', 'captures', 200), ('pro', 'questions', 500), ('pro', 'verifications', 100)) l(tier, bucket, quota) USING (tier)")
def q4_limits(spark, sf_dir):
    users = view(spark, sf_dir, "events").select("user_id", F.expr("CASE WHEN user_id % 2 = 0 THEN 'pro' ELSE 'free' END").alias("tier")).distinct()
    return users.join(F.broadcast(usage.limits(spark)), "tier").select("user_id", "bucket", "quota")


@plan(f"""WITH {_USED}, l AS (SELECT * FROM (VALUES ('captures', 20), ('questions', 50), ('verifications', 10)) v(bucket, quota)), c AS (SELECT user_id, bucket, count(*) AS n FROM u WHERE period IN ('2024-01', '2024-01-16') GROUP BY ALL)
    SELECT t.user_id, l.bucket, coalesce(c.n, 0) AS used, l.quota, CASE WHEN l.bucket = 'captures' THEN DATE '2024-02-01' ELSE DATE '2024-01-17' END AS resets_at FROM (SELECT DISTINCT user_id FROM events) t CROSS JOIN l LEFT JOIN c ON c.user_id = t.user_id AND c.bucket = l.bucket""")
def q5_usage_summary(spark, sf_dir):
    users = view(spark, sf_dir, "events").select("user_id", F.lit("free").alias("tier")).distinct()
    return usage.usage_summary(users, usage.usage_counters(view(spark, sf_dir, "usage_v")), usage.limits(spark), F.expr("TIMESTAMP_NTZ '2024-01-16 10:00:00'"))


_CHECKS = "SELECT event_id, user_id, ts, CASE WHEN event_id % 5 < 4 THEN cast(event_id % 5 AS int) END AS payment_state, ts + INTERVAL '1' DAY * cast(event_id % 9 - 2 AS int) AS expires_at FROM events"


@plan(f"""WITH c AS (SELECT *, (payment_state IS NULL OR payment_state IN (1, 2)) AND expires_at > ts AS valid FROM ({_CHECKS})),
    w AS (SELECT *, max(CASE WHEN valid THEN expires_at END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS pro_expires_at FROM c)
    SELECT event_id, pro_expires_at, CASE WHEN valid OR coalesce(pro_expires_at > ts, false) THEN 'pro' ELSE 'free' END AS tier FROM w""")
def q6_fold_subscriptions(spark, sf_dir):
    view(spark, sf_dir, "captures_v")
    return usage.fold_subscriptions(spark.sql(_CHECKS)).select("event_id", "pro_expires_at", "tier")


@plan("SELECT event_id, (SELECT count(*) FROM attempts_v b WHERE b.ip = a.ip AND NOT b.success AND epoch_us(b.ts) <= epoch_us(a.ts) AND epoch_us(b.ts) > epoch_us(a.ts) - CAST(36000 AS BIGINT) * 1000000) AS recent FROM attempts_v a")
def q7_failure_rate(spark, sf_dir):
    return usage.failure_rate(view(spark, sf_dir, "attempts_v"), "ip", 36_000).select("event_id", "recent")


@plan()
def q7_login_throttle(spark, sf_dir):
    return usage.login_throttle(view(spark, sf_dir, "attempts_v"), 20, 8, 36_000)


_INTENTS = "SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN event_type END AS domain, props AS intent FROM events"


@plan(f"""WITH i AS ({_INTENTS}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM i WHERE domain IS NOT NULL)
    SELECT user_id, string_agg(domain || intent, ';' ORDER BY n DESC) AS history, string_agg(domain || intent, ';' ORDER BY n DESC) FILTER (WHERE n <= 5) AS recent FROM r WHERE n <= 20 GROUP BY user_id""")
def q8_intent_history(spark, sf_dir):
    view(spark, sf_dir, "captures_v")
    h = usage.intent_history(spark.sql(_INTENTS))
    join = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["domain"], x["intent"])), ";").alias(c)
    return h.select("user_id", join("history"), join("recent"))


_TOKENS = "SELECT user_id, 't' || cast(user_id AS string) AS token_hash, 'j' || cast(user_id AS string) AS jti, max(ts) - INTERVAL '1' DAY * cast(user_id % 20 AS int) AS expires_at, CASE WHEN user_id % 3 = 0 THEN min(ts) + INTERVAL '6' DAY END AS revoked_at FROM events WHERE user_id % 10 <> 7 GROUP BY user_id"
_SHOWN = "SELECT event_id, ts, 't' || cast(user_id AS string) AS token_hash, 'j' || cast(CASE WHEN event_type = 'view' THEN user_id ELSE user_id + event_id % 2 END AS string) AS jti FROM events"


@plan(f"SELECT event_id, CASE WHEN t.jti IS NULL THEN 'unknown' WHEN t.revoked_at < s.ts THEN 'revoked' WHEN t.expires_at <= s.ts THEN 'expired' WHEN t.jti <> s.jti THEN 'jti_mismatch' ELSE 'ok' END AS verdict FROM ({_SHOWN}) s LEFT JOIN ({_TOKENS}) t USING (token_hash)")
def q9_token_audit(spark, sf_dir):
    view(spark, sf_dir, "captures_v")
    return usage.token_audit(spark.sql(_SHOWN), spark.sql(_TOKENS))
