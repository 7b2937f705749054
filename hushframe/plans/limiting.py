"""Queries over request admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admission
from . import fixtures as fx
from .registry import big, query

# Limits low enough to bite on the events table.
LIMITS = {"key_limit": 3, "day_limit": 120, "min_gap": 7200.0}


@query(
    "daily_usage",
    "select cast(cast(ts as date) as varchar) as day, user_id as key, count(*) as requests from events group by 1, 2",
)
def daily_usage(spark, sf_dir):
    used = admission.daily_usage(fx.table(spark, sf_dir, "events"), "user_id", "ts")
    return used.withColumn("day", F.col("day").cast("string"))


# A direct run of the rule: one day at a time, request by request, with the list of admitted ones.
RATE_SQL = f"""with recursive ev as (
  select event_id, user_id, epoch_us(ts) as us, cast(ts as date) as day,
         row_number() over (partition by cast(ts as date) order by ts, event_id) as rn from events
),
walk as (
  select day, cast(0 as bigint) as rn, cast(-1 as bigint) as event_id, cast([] as struct(u bigint, t bigint)[]) as adm, cast('' as varchar) as reason
  from (select distinct day from ev)
  union all
  select day, rn, event_id, case when reason = '' then list_append(adm, cast(row(user_id, us) as struct(u bigint, t bigint))) else adm end, reason
  from (
    select w.day, e.rn, e.event_id, e.user_id, e.us, w.adm,
      case when list_max(list_transform(list_filter(w.adm, lambda x: x.u = e.user_id), lambda x: x.t)) is not null
             and e.us - list_max(list_transform(list_filter(w.adm, lambda x: x.u = e.user_id), lambda x: x.t)) < {int(LIMITS['min_gap'] * 1_000_000)} then 'delay'
           when len(w.adm) >= {LIMITS['day_limit']} then 'global'
           when len(list_filter(w.adm, lambda x: x.u = e.user_id)) >= {LIMITS['key_limit']} then 'key'
           else '' end as reason
    from walk w join ev e on e.day = w.day and e.rn = w.rn + 1)
)
select event_id, reason = '' as allowed, reason from walk where rn > 0"""


@query("rate_limit", RATE_SQL)
def rate_limit(spark, sf_dir):
    done = admission.rate_limit(fx.table(spark, sf_dir, "events"), "user_id", "ts", "event_id", **LIMITS)
    return done.select(big("id").alias("event_id"), "allowed", "reason")
