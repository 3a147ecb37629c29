"""Queries of the record operators (problems 2 to 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, fill, history, regrid, spikes, trailing
from tidemark.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = fill.fill_filings(table(spark, sf_dir, "fundamentals"), table(spark, sf_dir, "sectors"))
    return filled.where(F.col("level").isin(*fill.TICKER_LEVELS) & F.col("filled").isNotNull()).select("filing_id", "field")


def p2_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled values: numbers as value, dates and sectors as text."""
    filled = fill.fill_filings(table(spark, sf_dir, "fundamentals"), table(spark, sf_dir, "sectors"))
    number = F.col("field").isin("pe", "market_cap")
    value = F.round(F.when(number, F.col("filled").try_cast("double")), 4)
    return filled.select("filing_id", "field", value.alias("value"), F.when(~number, F.col("filled")).alias("text"), "level", "support")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = asof.rebalances_with_pb(table(spark, sf_dir, "fundamentals"), table(spark, sf_dir, "rebalances"))
    return known.select("rebal_id", F.col("known_filing_id").alias("filing_id"))


def p3_pb(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = asof.rebalances_with_pb(table(spark, sf_dir, "fundamentals"), table(spark, sf_dir, "rebalances"))
    return known.select("rebal_id", "ticker", "version", F.col("known_pb").alias("pb"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.roe_history(table(spark, sf_dir, "fundamentals")).select("ticker", "valid_from", "valid_to")


def p4_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.roe_history(table(spark, sf_dir, "fundamentals"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible_prices(table(spark, sf_dir, "etf_data")).select("asset", "bar", "field").distinct()


def p5_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible_prices(table(spark, sf_dir, "etf_data"))


def p5_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags without their innovations, which SQL can state."""
    return spikes.implausible_prices(table(spark, sf_dir, "etf_data")).select("asset", "bar", "field", "kind")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = regrid.regular_closes(table(spark, sf_dir, "crypto_data"), table(spark, sf_dir, "etf_data"))
    return grid.where("status in ('interpolated', 'missing')").select("feed", "asset", "slot")


def p6_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regrid.regular_closes(table(spark, sf_dir, "crypto_data"), table(spark, sf_dir, "etf_data")).withColumn("close", F.round("close", 9))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trailing.trailing_closes(table(spark, sf_dir, "etf_data"))
    avg = lambda n: F.try_divide(F.col(f"total_{n}") / 100, F.col(f"count_{n}")).alias(f"avg_{n}")
    return t.select(F.col("source").alias("asset"), regrid.day_text(F.col("day")).alias("day"), "total_7", "count_7", "total_30", "count_30", F.round(avg(7), 6).alias("avg_7"), F.round(avg(30), 6).alias("avg_30"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trailing.trailing_closes(table(spark, sf_dir, "etf_data"))
    low = 10 * F.col("total_7") * F.col("count_30") < 9 * F.col("total_30") * F.col("count_7")  # averages, without division
    return t.where((F.col("age") >= 30) & ((F.col("count_7") == 0) | low)).select(F.col("source").alias("asset"), regrid.day_text(F.col("day")).alias("day"))


QUERIES = {f.__name__: f for f in (p2_found, p2_filled, p3_found, p3_pb, p4_found, p4_history, p5_found, p5_flags, p5_kinds, p6_found, p6_grid, p7_found, p7_totals)}

FILINGS = """filings as (select filing_id, upper(trim(min(ticker))) ticker, min(loaded_at) loaded_at, min(date_filed) date_filed, min(sector) sector,
 min(fiscal_period) fiscal_period, min(pe) pe, min(pb) pb, min(roe) roe, min(market_cap) market_cap from fundamentals where filing_id is not null and ticker is not null group by filing_id)"""
BARS = "bars as (select asset, bar, arg_max(bar_ts, loaded_at) bar_ts, arg_max({open: open}, loaded_at).open as open, arg_max({close: close}, loaded_at).close as close from etf_data group by asset, bar)"

IMPLAUSIBLE = f"""with {BARS}, v as (select asset, bar, unnest(['close', 'open']) field, unnest([close, open]) v from bars),
r as (select *, v = lag(v) over w as same, v is distinct from lag(v) over w as brk from v where v is not null and not isnan(v) window w as (partition by asset, field order by bar)),
r2 as (select *, sum(cast(brk as int)) over (partition by asset, field order by bar) run from r),
runs as (select asset, field, run from r2 group by 1, 2, 3 having count(*) >= 8),
rate as (select asset, field from r2 group by 1, 2 having sum(case when same then 1 else 0 end) < 0.2 * count(*)),
p as (select asset, field, bar, ln(v) x, {', '.join(f'lag(ln(v), {i}) over w b{i}, lead(ln(v), {i}) over w a{i}' for i in (1, 2, 3))} from r where v > 0 window w as (partition by asset, field order by bar)),
m as (select asset, field, 10 * median(abs(x - b1)) far from p group by 1, 2),
c as (select p.*, m.far from p join m using (asset, field)),
s as (select *, abs(x - b1) >= far and abs(x - a1) >= far as g1,
 abs(x - b1) >= far and abs(x - a2) >= far and abs(a1 - b1) >= far and abs(a1 - a2) >= far as g2,
 abs(x - b1) >= far and abs(x - a3) >= far and abs(a1 - b1) >= far and abs(a1 - a3) >= far and abs(a2 - b1) >= far and abs(a2 - a3) >= far as g3 from c),
x as (select asset, bar, field from s window w as (partition by asset, field order by bar) qualify coalesce(g1, false) or coalesce(g2, false) or coalesce(g3, false) or coalesce(lag(g2) over w, false) or coalesce(lag(g3) over w, false) or coalesce(lag(g3, 2) over w, false)),
found as (select asset, bar, field, 'impossible' kind from r where v <= 0 union all select distinct asset, bar, field, 'spike' from x union all select r2.asset, r2.bar, r2.field, 'stuck' from r2 join runs using (asset, field, run) join rate using (asset, field))"""
P3 = f"""{FILINGS}, f as (select *, greatest(loaded_at, cast(date_filed as timestamp)) known, row_number() over (partition by ticker order by date_filed, loaded_at, filing_id) rk from filings
  where not isnan(pb) and date_filed between date '2005-01-01' and date '2026-12-31' and loaded_at is not null),
e as (select rebal_id, min(rebal_ts) rebal_ts, min(upper(trim(ticker))) ticker from rebalances where rebal_id is not null and rebal_ts is not null and ticker is not null group by rebal_id)"""
HISTORY = f"""{FILINGS}, d as (select ticker, date_filed, arg_max(coalesce(case when not isnan(roe) then cast(round(roe * 10000) as bigint) end, -999999999), (loaded_at, filing_id)) roe
  from filings where date_filed between date '2005-01-01' and date '2026-12-31' group by ticker, date_filed),
c as (select *, roe is distinct from lag(roe) over (partition by ticker order by date_filed) as brk from d),
s as (select ticker, date_filed, roe, lead(date_filed) over (partition by ticker order by date_filed) nxt from c where brk)"""
SUMS = f"""{BARS}, u as (select asset, cast(bar_ts as date) d, cast(round(close * 100) as bigint) c from bars where close > 0 and not isnan(close)),
g as (select asset, min(d) f, cast(unnest(generate_series(cast(min(d) as timestamp), cast(max(d) as timestamp), interval 1 day)) as date) d from u group by asset),
t as (select g.asset, g.d, g.f, sum(case when u.d > g.d - 7 then u.c end) s7, count(case when u.d > g.d - 7 then 1 end) n7, sum(u.c) s30, count(u.c) n30
 from g left join u on u.asset = g.asset and u.d <= g.d and u.d > g.d - 30 group by 1, 2, 3)"""
#: Of a grid (asset, i, c) with c where observed and w the ordinal that measures gaps: the status and the value filled in.
FILL = """(select *, last_value(c ignore nulls) over up c0, last_value(i_c ignore nulls) over up i0, last_value(w_c ignore nulls) over up w0, first_value(c ignore nulls) over dn c1, first_value(i_c ignore nulls) over dn i1, first_value(w_c ignore nulls) over dn w1
 from {grid} window up as (partition by asset order by i rows between unbounded preceding and current row), dn as (partition by asset order by i rows between current row and unbounded following))"""
STATUS = "case when c is not null then 'observed' when w1 - w0 - 1 <= 3 then 'interpolated' else 'missing' end"
#: Weekdays between the observed days, where the right one may lie on a weekend, which counts like the Monday after it.
GAP = "(case when isodow(date '1970-01-01' + cast(i1 as int)) > 5 then w1 + 1 else w1 end) - w0"
VALUE = "round(case when c is not null then c when w1 - w0 - 1 <= 3 then c0 + (c1 - c0) * ((i - i0) / (i1 - i0)) end, 9)"

SQL = {
    "p2_found": f"""with {FILINGS}, g as (select f.filing_id, f.ticker,
  case when not isnan(pe) and pe <> 0 and abs(pe) < 500 then cast(pe as varchar) end pe,
  case when not isnan(market_cap) and not isinf(market_cap) and market_cap > 0 then cast(market_cap as varchar) end market_cap,
  case when date_filed between date '2005-01-01' and date '2026-12-31' then cast(date_filed as varchar) end date_filed, s.sector_name sector
  from filings f left join sectors s on upper(trim(f.sector)) = upper(trim(s.sector_name))),
v as (select filing_id, ticker, unnest(['pe', 'market_cap', 'date_filed', 'sector']) field, unnest([pe, market_cap, date_filed, sector]) val from g),
t as (select ticker, field from v where val is not null group by ticker, field)
select v.filing_id, v.field from v join t on v.ticker = t.ticker and v.field = t.field where v.val is null""",
    "p2_filled": f"""with {FILINGS}, g as (select f.filing_id, f.ticker, fiscal_period per, substr(fiscal_period, 1, 4) yr, s.sector_name sector,
  case when not isnan(pe) and pe <> 0 and abs(pe) < 500 then pe end pe, case when not isnan(market_cap) and not isinf(market_cap) and market_cap > 0 then market_cap end market_cap,
  case when date_filed between date '2005-01-01' and date '2026-12-31' then cast(date_filed - date '1970-01-01' as double) end date_filed from filings f left join sectors s on upper(trim(f.sector)) = upper(trim(s.sector_name))),
k as (select *, case lvl when 0 then '0|' || ticker || '|' || per when 1 then '1|' || ticker || '|' || yr when 2 then '2|' || ticker when 3 then '3|' || sector || '|' || per when 4 then '4|' || per else '5|' end "key" from (select *, unnest(range(6)) lvl from g)),
u as (select filing_id, lvl, "key", unnest(['pe', 'market_cap', 'date_filed']) field, unnest([pe, market_cap, date_filed]) x from k where "key" is not null),
num as (select "key", field, median(x) x, cast(null as varchar) t, count(x) n from u group by 1, 2), mc as (select "key", sector, count(*) c from k where "key" is not null and sector is not null group by 1, 2),
st as (select * from num union all select "key", 'sector', null, arg_min(sector, (-c, sector)), sum(c) from mc group by 1),
cells as (select filing_id, lvl, "key", field from u where x is null union all select filing_id, lvl, "key", 'sector' from k where sector is null and "key" is not null),
best as (select filing_id, c.field, min(case when n >= [3, 3, 1, 5, 1, 1][lvl + 1] then lvl end) lvl from cells c left join st on st."key" = c."key" and st.field = c.field group by 1, 2)
select b.filing_id, b.field, case when b.field in ('pe', 'market_cap') then round(x, 4) end as value, case when b.field = 'date_filed' then cast(date '1970-01-01' + cast(round(x) as int) as varchar) when b.field = 'sector' then t end as text,
 ['ticker_period', 'ticker_year', 'ticker', 'sector_period', 'period', 'all'][b.lvl + 1] as level, cast(n as bigint) support
from best b left join cells c on c.filing_id = b.filing_id and c.field = b.field and c.lvl = b.lvl left join st on st."key" = c."key" and st.field = c.field""",
    "p3_found": f"""with {FILINGS}, f as (select * from filings where not isnan(pb) and date_filed between date '2005-01-01' and date '2026-12-31'),
e as (select rebal_id, min(rebal_ts) rebal_ts, min(upper(trim(ticker))) ticker from rebalances where rebal_id is not null and rebal_ts is not null and ticker is not null group by rebal_id)
select e.rebal_id, arg_max(f.filing_id, (f.date_filed, f.loaded_at, f.filing_id)) filing_id from e join f on e.ticker = f.ticker
where f.date_filed <= cast(e.rebal_ts as date) and f.loaded_at <= e.rebal_ts group by e.rebal_id""",
    "p3_pb": f"""with {P3}, m as (select *, rk = max(rk) over (partition by ticker order by known, rk rows between unbounded preceding and current row) best from f),
v as (select ticker, known, pb, row_number() over (partition by ticker order by known, rk) no from m where best)
select rebal_id, any_value(e.ticker) ticker, cast(max(no) as bigint) as version, arg_max(pb, no) pb from e join v on v.ticker = e.ticker and v.known <= e.rebal_ts group by rebal_id""",
    "p4_found": f"""with {HISTORY} select ticker, cast(date_filed as varchar) valid_from, coalesce(cast(nxt as varchar), '9999-12-31') valid_to from s where roe <> -999999999""",
    "p4_history": f"""with {HISTORY} select ticker, cast(date_filed as varchar) valid_from, coalesce(cast(nxt as varchar), '9999-12-31') valid_to, roe / 10000.0 roe from s where roe <> -999999999""",
    "p5_found": f"{IMPLAUSIBLE} select distinct asset, bar, field from found",
    "p5_kinds": f"{IMPLAUSIBLE} select * from found",
    "p6_found": f"""with {BARS}, c as (select distinct asset, date_trunc('hour', bar_ts) h from crypto_data where close > 0 and not isnan(close)),
cg as (select asset, unnest(generate_series(min(h), max(h), interval 1 hour)) h from c group by asset),
d as (select distinct asset, cast(bar_ts as date) d from bars where close > 0 and not isnan(close)),
dg as (select asset, cast(unnest(generate_series(cast(min(d) as timestamp), cast(max(d) as timestamp), interval 1 day)) as date) d from d group by asset)
select 'crypto_data' feed, asset, strftime(h, '%Y-%m-%d %H') slot from (select * from cg except select * from c)
union all select 'etf_data', asset, strftime(d, '%Y-%m-%d') || ' 00' from (select * from dg where isodow(d) < 6 except select * from d)""",
    "p6_grid": f"""with {BARS}, ch as (select asset, date_trunc('hour', bar_ts) h, arg_max(close, (bar_ts, reading_id, close)) c from crypto_data where close > 0 and not isnan(close) and asset is not null and bar_ts is not null group by 1, 2),
cg as (select asset, unnest(generate_series(min(h), max(h), interval 1 hour)) h from ch group by asset), ci as (select cg.asset, cg.h, c, epoch(cg.h) / 3600 i, epoch(cg.h) / 3600 w, case when c is not null then epoch(cg.h) / 3600 end i_c, case when c is not null then epoch(cg.h) / 3600 end w_c from cg left join ch using (asset, h)),
dc as (select asset, cast(bar_ts as date) d, arg_max(close, (bar, close)) c from bars where close > 0 and not isnan(close) group by 1, 2),
dg as (select asset, cast(unnest(generate_series(cast(min(d) as timestamp), cast(max(d) as timestamp), interval 1 day)) as date) d from dc group by asset),
di as (select dg.asset, dg.d, c, (dg.d - date '1970-01-01') i, case when c is not null then dg.d - date '1970-01-01' end i_c, count(*) filter (isodow(dg.d) < 6) over (partition by dg.asset order by dg.d) w_end from dg left join dc using (asset, d)),
dj as (select *, w_end w, case when c is not null then w_end end w_c from di)
select 'crypto_data' feed, asset, strftime(h, '%Y-%m-%d %H') slot, {VALUE} as close, {STATUS} status from {FILL.format(grid="ci")}
union all select 'etf_data', asset, strftime(d, '%Y-%m-%d') || ' 00', {VALUE.replace("w1 - w0", GAP)}, {STATUS.replace("w1 - w0", GAP)} from {FILL.format(grid="dj")} where isodow(d) < 6""",
    "p7_found": f"with {SUMS} select asset, strftime(d, '%Y-%m-%d') as day from t where d - f >= 29 and (n7 = 0 or 10 * s7 * n30 < 9 * s30 * n7)",
    "p7_totals": f"""with {SUMS} select asset, strftime(d, '%Y-%m-%d') as day, cast(coalesce(s7, 0) as bigint) total_7, n7 count_7, cast(coalesce(s30, 0) as bigint) total_30, n30 count_30, round(s7 / 100.0 / n7, 6) avg_7, round(s30 / 100.0 / n30, 6) avg_30 from t""",
}
