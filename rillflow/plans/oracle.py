"""SQL that gives the registered queries' results straight from the tables."""

from __future__ import annotations

WORD_COUNT = """
select word as value, count(*) as count
from (select unnest(string_split(text, ' ')) as word from documents)
group by word
"""

# Lines first, then the parts between single spaces.
WORD_COUNT_LINES = """
select word as value, count(*) as count
from (
  select unnest(string_split(line, ' ')) as word
  from (select unnest(string_split(text, chr(10))) as line from documents)
)
group by word
"""

JSON_DECODE = """
select event_id, cast(props->>'$.k' as integer) as k from events
"""

DECODE_MALFORMED = """
select 'events' as source, count(*) as row_count,
       count(*) filter (where cast(props->>'$.k' as integer) is null) as blank_count
from events
union all
select 'documents' as source, count(*) as row_count, count(*) as blank_count from documents
"""

DECODE_QUARANTINE = """
select 'events' as topic, 0 as partition, event_id as "offset", props as raw
from events where cast(props->>'$.k' as integer) is null
union all
select 'documents' as topic, 1 as partition, doc_id as "offset", text as raw from documents
"""

TRADE_TOTALS = """
with trades as (
  select time_bucket(interval '15 minutes', ts) as start, event_type,
         cast(round(value * 100) as integer) as amount
  from events
)
select start, start + interval '15 minutes' as "end",
       cast(sum(case when event_type = 'purchase' then amount else 0 end) as bigint) as TotalBuy,
       cast(sum(case when event_type = 'error' then amount else 0 end) as bigint) as TotalSell
from trades
group by start
"""

# Times on the wire are whole seconds.
TRADE_TOTALS_APPEND = f"""
select * from ({TRADE_TOTALS})
where "end" <= (select date_trunc('second', max(ts)) - interval '1 hour' from events)
"""

# A 15-minute window starts every 5 minutes: each event lies in the three that began last.
SENSOR_MAX = """
with windows as (
  select event_type as SensorID,
         time_bucket(interval '5 minutes', ts) - r.i * interval '5 minutes' as start, value
  from events, range(3) r(i)
)
select SensorID, start, start + interval '15 minutes' as "end", max(value) as MaxReading
from windows
group by SensorID, start
"""

SENSOR_MAX_UNDATED = f"""
select * from ({SENSOR_MAX}) where SensorID is distinct from 'signup'
"""

SENSOR_MAX_APPEND = f"""
select * from ({SENSOR_MAX})
where "end" <= (select date_trunc('second', max(ts)) - interval '30 minutes' from events)
"""

# When each event arrives, and up to when windows are closed by then.
_ARRIVALS = """
with span as (
  select epoch_us(min(ts)) as first,
         greatest(1, (epoch_us(max(ts)) - epoch_us(min(ts))) // 4) as width
  from events
),
arrivals as (
  select event_type, ts, value,
         least(3, least(3, (epoch_us(ts) - first) // width)
                  + case when cast(props->>'$.k' as integer) >= 90 then 1 else 0 end) as slot
  from events, span
),
latest as (
  select slot, date_trunc('second', max(ts)) as latest from arrivals group by slot
),
closed as (
  select s.slot, max(l.latest) - interval '30 minutes' as upto
  from (select distinct slot from arrivals) s left join latest l on l.slot < s.slot
  group by s.slot
)
"""

SENSOR_LATE_DATA = f"""{_ARRIVALS},
windows as (
  select a.event_type as SensorID, a.value, c.upto,
         time_bucket(interval '5 minutes', a.ts) - r.i * interval '5 minutes' as start
  from arrivals a join closed c on a.slot = c.slot, range(3) r(i)
)
select SensorID, start, start + interval '15 minutes' as "end", max(value) as MaxReading
from windows
where upto is null or start + interval '15 minutes' > upto
group by SensorID, start
"""

LATE_ROWS_DROPPED = f"""{_ARRIVALS},
late as (
  select distinct a.slot, a.event_type,
         time_bucket(interval '5 minutes', a.ts) - r.i * interval '5 minutes' as start
  from arrivals a join closed c on a.slot = c.slot, range(3) r(i)
  where time_bucket(interval '5 minutes', a.ts) - r.i * interval '5 minutes'
        + interval '15 minutes' <= c.upto
),
dropped as (select slot, count(*) as dropped from late group by slot)
select cast(a.slot as bigint) as arrival, a.rows_in, coalesce(d.dropped, 0) as dropped
from (select slot, count(*) as rows_in from arrivals group by slot) a left join dropped d on d.slot = a.slot
"""

SENSOR_STATE_LEFT = f"""
select * from ({SENSOR_MAX})
where "end" > (select date_trunc('second', max(ts)) - interval '30 minutes' from events)
"""

_ITEMS = """
from lineitem
join orders on l_orderkey = o_orderkey
left join customer on o_custkey = c_custkey
left join nation on c_nationkey = n_nationkey
left join region on n_regionkey = r_regionkey
left join part on l_partkey = p_partkey
"""

_HEADER = """
cast(o_orderkey as varchar) as InvoiceNumber, epoch_ms(o_orderdate) as CreatedTime,
'STR' || cast(c_nationkey as varchar) as StoreID, 'POS' || o_orderstatus as PosID,
c_mktsegment as CustomerType,
case when o_orderstatus = 'O' then 'HOME-DELIVERY' else 'TAKEAWAY' end as DeliveryType,
n_name as City, r_name as State, cast(c_nationkey as varchar) as PinCode
"""

_ITEM = """
cast(l_partkey as varchar) as ItemCode, p_name as ItemDescription,
l_extendedprice as ItemPrice, cast(trunc(l_quantity) as integer) as ItemQty,
l_extendedprice * (1 - l_discount) as TotalValue
"""

INVOICE_FLATTEN = f"select {_HEADER}, o_orderpriority as PaymentMethod, {_ITEM} {_ITEMS}"

PUBLISHED_ITEMS = f"""
select {_HEADER}, cast(o_custkey as varchar) as CustomerCardNo, {_ITEM} {_ITEMS}
"""

LOYALTY_NOTIFICATIONS = """
select cast(o_orderkey as varchar) as InvoiceNumber, cast(o_custkey as varchar) as CustomerCardNo,
       o_totalprice as TotalAmount, o_totalprice * cast(0.2 as double) as LoyaltyPoint
from orders
"""

PRIME_REWARDS = """
with items as (
  select cast(c_custkey as varchar) as CustomerCardNo,
         l_extendedprice * (1 - l_discount) as TotalValue
  from lineitem
  join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey
  where c_mktsegment = 'BUILDING'
)
select CustomerCardNo,
       cast(sum(cast(TotalValue as decimal(18,4))) as double) as TotalPurchase,
       cast(sum(cast(trunc(TotalValue * 2) as bigint)) as bigint) as AggregatedRewards
from items
group by CustomerCardNo
"""

REWARDS_ENCODED = f"select CustomerCardNo as key, * from ({PRIME_REWARDS})"

FAN_OUT_COUNTS = """
select 'invoice' as sink, count(*) as row_count from lineitem join orders on l_orderkey = o_orderkey
union all
select 'notification' as sink, count(*) as row_count from orders
"""

ORACLES: dict[str, str] = {
    "word_count": WORD_COUNT,
    "json_decode": JSON_DECODE,
    "decode_malformed": DECODE_MALFORMED,
    "decode_quarantine": DECODE_QUARANTINE,
    "trade_totals": TRADE_TOTALS,
    "sensor_max": SENSOR_MAX,
    "sensor_max_undated": SENSOR_MAX_UNDATED,
    "invoice_flatten": INVOICE_FLATTEN,
    "published_items": PUBLISHED_ITEMS,
    "loyalty_notifications": LOYALTY_NOTIFICATIONS,
    "prime_rewards": PRIME_REWARDS,
    "rewards_encoded": REWARDS_ENCODED,
    "sensor_max_update": SENSOR_MAX,
    "sensor_max_append": SENSOR_MAX_APPEND,
    "trade_totals_update": TRADE_TOTALS,
    "trade_totals_append": TRADE_TOTALS_APPEND,
    "word_count_complete": WORD_COUNT,
    "word_count_lines": WORD_COUNT_LINES,
    "file_flatten": INVOICE_FLATTEN,
    "file_flatten_inferred": INVOICE_FLATTEN,
    "record_flatten": INVOICE_FLATTEN,
    "loyalty_stream": LOYALTY_NOTIFICATIONS,
    "publish_and_reward": PRIME_REWARDS,
    "rewards_delivered_once": PRIME_REWARDS,
    "fan_out_counts": FAN_OUT_COUNTS,
    "fan_out_single_read": FAN_OUT_COUNTS,
    "fan_out_items": INVOICE_FLATTEN,
    "fan_out_notifications": LOYALTY_NOTIFICATIONS,
    "fan_out_single_read_items": INVOICE_FLATTEN,
    "fan_out_single_read_notifications": LOYALTY_NOTIFICATIONS,
    "sensor_late_data": SENSOR_LATE_DATA,
    "late_rows_dropped": LATE_ROWS_DROPPED,
    "sensor_state_left": SENSOR_STATE_LEFT,
    "word_state_left": WORD_COUNT,
    "trade_log_compacted": TRADE_TOTALS,
    "trade_totals_interval": TRADE_TOTALS,
    "trade_totals_at_once": TRADE_TOTALS,
}
