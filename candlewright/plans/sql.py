"""Common table expressions of the oracle: the same tables the queries start from."""

TICKS = """
e as (select event_id as seq, event_type as symbol, cast(value as decimal(18,6)) as price,
             cast(cast(cast(props::json->>'k' as bigint) as decimal(18,8)) * 0.01 as decimal(18,8)) as quantity,
             (epoch_us(ts)//1000 - 1704067200000)//60 + 1704067200000 as arrival_ms, user_id, event_type, ts, value
      from events),
ticks as (select *, arrival_ms - case when seq % 7 = 3 then (seq % 5) * 45000 else 0 end as event_ms from e),
v as (select *, cast(quantity * 100000000 as bigint) as units from ticks
      where regexp_matches(symbol, '[^ \\t\\n]') and price > 0 and quantity >= 0 and event_ms > 0)"""

CANDLES = (
    TICKS
    + """,
iv as (select * from (values ('1m', 60), ('5m', 300), ('30m', 1800)) as x(interval, d)),
b as (select v.*, iv.interval, iv.d, cast(event_ms // 1000 // d * d as bigint) as start_s from v cross join iv),
c as (select symbol, interval, start_s, cast(start_s + any_value(d) - 1 as bigint) as close_s, arg_min(price, seq) as open, max(price) as high,
             min(price) as low, arg_max(price, seq) as close, cast(sum(units) as bigint) as volume, count(*) as trades
      from b group by symbol, interval, start_s)"""
)

LATE = (
    CANDLES
    + """,
m as (select *, max(start_s) over (partition by symbol, interval order by seq rows between unbounded preceding and current row) as high_s from b),
o as (select symbol, interval, start_s, min(seq) as open_seq, arg_min(arrival_ms, seq) as open_ms from m where start_s = high_s group by all),
dir as (select *, row_number() over w as place, lead(open_seq) over w as closed_seq, lead(open_ms) over w as closed_ms
        from o window w as (partition by symbol, interval order by start_s)),
f as (select m.*, case when m.start_s = high_s then 'on_time'
                       when own.place is not null and now.place - own.place <= 3 and m.arrival_ms - own.closed_ms <= 120000 then 'late_applied'
                       else 'late_dropped' end as fate
      from m left join dir own using (symbol, interval, start_s)
             left join dir now on now.symbol = m.symbol and now.interval = m.interval and now.start_s = m.high_s),
k as (select * from f where fate <> 'late_dropped'),
lc as (select symbol, interval, start_s, cast(start_s + any_value(d) - 1 as bigint) as close_s, arg_min(price, seq) as open, max(price) as high,
              min(price) as low, arg_max(price, seq) as close, cast(sum(units) as bigint) as volume, count(*) as trades
       from k group by symbol, interval, start_s),
run as (select symbol, interval, start_s, d, seq, case fate when 'on_time' then 'live' else 'late' end as kind, first_value(price) over w as open,
               max(price) over w as high, min(price) over w as low, price as close, cast(sum(units) over w as bigint) as volume, count(*) over w as trades
        from k window w as (partition by symbol, interval, start_s order by seq rows between unbounded preceding and current row)),
oc as (select symbol, interval, start_s, any_value(d) as d, arg_min(price, seq) as open, max(price) as high, min(price) as low, arg_max(price, seq) as close,
              cast(sum(units) as bigint) as volume, count(*) as trades from k where fate = 'on_time' group by all),
rev as (select symbol, interval, start_s, d, seq, kind, open, high, low, close, volume, trades from run
        union all
        select oc.symbol, oc.interval, oc.start_s, oc.d, dir.closed_seq, 'closed', open, high, low, close, volume, trades
        from oc join dir using (symbol, interval, start_s) where dir.closed_seq is not null),
stored as (select symbol, interval, start_s, close_s, open, high, low, case when start_s // 60 % 7 = 0 then cast(close + 0.01 as decimal(18,6)) else close end as close, volume, trades
           from lc where not (interval = '1m' and start_s // 60 % 11 = 0)),
lim as (select max(start_s) as last_s from lc where interval = '1m')"""
)

ROW = "symbol, interval, start_s, close_s, open, high, low, close, volume, trades"
UNITS = "cast(cast({0} as decimal(28,8)) * 0.00000001 as decimal(28,8))"


def with_ticks(body: str) -> str:
    return f"with {TICKS}\n{body}"


def with_candles(body: str) -> str:
    return f"with {CANDLES}\n{body}"


def with_late(body: str) -> str:
    return f"with {LATE}\n{body}"
