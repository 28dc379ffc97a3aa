"""Panels and features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.functions import bin_of, month_of, signed_percent
from terrane.operators import features, panel
from terrane.operators.shared import written
from terrane.plans.common import CELLS, cells, complete, query, wrapped
from terrane.sources import table

WEIGHTS = {"level": 1.0, "profile": 1.0, "season": 0.7}
HIGH = [4, 7]  # months in which quarters start that count as high season
QUERIES, SQL = {}, {}


def add(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = query(make)
    if sql:
        SQL[name] = sql


add("panel_complete", lambda s, d: complete(s, d), wrapped("select * from whole", "entity, period, category", "value", CELLS))
add(
    "panel_dropped",
    lambda s, d: panel.dropped_entities(cells(s, d)),
    wrapped("select entity, cast(wanted - present as bigint) as missing, 'incomplete series' as reason from cover, size where present < wanted", "entity, missing, reason", prefix=CELLS),
)
UNITS = f"""{CELLS}, mean as (select entity, category, avg(value) as mean_value from whole group by 1, 2),
units as (select *, sum(mean_value) over (partition by entity) as total_mean, mean_value / sum(mean_value) over (partition by entity) as share from mean)"""
add("unit_table", lambda s, d: panel.unit_table(complete(s, d)), wrapped("select * from units", "entity, category", "mean_value, total_mean, share", UNITS))


def _by_region(s, d):
    region = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return region.select(F.col("s_suppkey").alias("entity"), F.col("n_regionkey").alias("cluster"), "n_name")


add(
    "mirkin_deviation",
    lambda s, d: features.deviations(
        panel.unit_table(complete(s, d)).join(_by_region(s, d), "entity").select("entity", "cluster", F.col("category").alias("feature"), F.col("share").alias("value"))
    ),
    wrapped(
        """select cluster, feature, (own - grand) / grand as deviation
        from (select n_regionkey as cluster, category as feature, avg(share) as own from units join supplier on s_suppkey = entity join nation on n_nationkey = s_nationkey group by 1, 2)
        join (select category as feature, avg(share) as grand from units join supplier on s_suppkey = entity group by 1) using (feature)""",
        "cluster, feature", "deviation", UNITS,
    ),
)
add("feat_level", lambda s, d: features.level(complete(s, d)), wrapped("select entity, avg(x) as level from total group by 1", "entity", "level", CELLS))
CLR = f"""{CELLS}, logs as (select entity, period, category, ln(value) as x from whole),
clr as (select entity, period, category, x - avg(x) over (partition by entity, period) as x from logs),
rel as (select entity, period, category, x - median(x) over (partition by period, category) as x from clr)"""
add("feat_clr", lambda s, d: features.profile(complete(s, d)), wrapped("select entity, category, avg(x) as profile from rel group by 1, 2", "entity, category", "profile", CLR))
SEASON = f"""{CLR}, e as (select entity, period, x - avg(x) over (partition by entity) as x from total),
one0 as (select entity, period, x - median(x) over (partition by period) as x from logs where category = 'R'),
one as (select entity, period, x - avg(x) over (partition by entity) as x from one0),
season as (select entity, stddev_pop(x) as season_amp, avg(x) filter (where month(period) in (4, 7)) as high_all from e group by 1),
high as (select entity, avg(x) filter (where month(period) in (4, 7)) as high_category from one group by 1),
seasons as (select * from season left join high using (entity))"""
add("feat_season", lambda s, d: features.season(complete(s, d), HIGH, "R"), wrapped("select * from seasons", "entity", "season_amp, high_all, high_category", SEASON))
SERIES = f"""{CLR}, s0 as (select entity, period, category as channel, x - median(x) over (partition by period, category) as x from logs union all select entity, period, 'total', x from total),
series as (select entity, period, channel, x - avg(x) over (partition by entity, channel) as x from s0)"""
add("feat_series", lambda s, d: features.series(complete(s, d)), wrapped("select * from series", "entity, period, channel", "x", SERIES))
add(
    "feat_window",
    lambda s, d: features.window_level(complete(s, d), 12, 1),
    wrapped(
        'select s as "window", entity, avg(x) as level, stddev_pop(x) as season_amp from total join numbered using (period) join starts on t between s and s + 11 group by 1, 2',
        '"window", entity', "level, season_amp",
        f"""{CELLS}, numbered as (select period, row_number() over (order by period) - 1 as t from (select distinct period from whole)),
        starts as (select unnest(range(0, (select max(t) - 11 + 1 from numbered), 1)) as s)""",
    ),
)


add(
    "window_features",
    lambda s, d: features.window_features(written(complete(s, d)), 12, 1, HIGH, "R"),
    wrapped(
        """select "window", entity, case feature when 'level' then 'level' else 'season' end as block, feature, value from (
          select "window", entity, unnest(['level', 'season_amp', 'high_all', 'high_category']) as feature, unnest([level, season_amp, high_all, high_category]) as value from wt left join wo using ("window", entity))
        union all select s, entity, 'profile', category, avg(x) from rel join numbered using (period) join starts on t between s and s + 11 group by 1, 2, 4""",
        '"window", entity, block, feature', "value",
        f"""{CLR}, numbered as (select period, row_number() over (order by period) - 1 as t from (select distinct period from whole)),
        starts as (select unnest(range(0, (select max(t) - 11 + 1 from numbered), 1)) as s),
        one0 as (select entity, period, x - median(x) over (partition by period) as x from logs where category = 'R'),
        wt as (select s as "window", entity, avg(x) as level, stddev_pop(x) as season_amp, avg(x) filter (where month(period) in (4, 7)) - avg(x) as high_all from total join numbered using (period) join starts on t between s and s + 11 group by 1, 2),
        wo as (select s as "window", entity, avg(x) filter (where month(period) in (4, 7)) - avg(x) as high_category from one0 join numbered using (period) join starts on t between s and s + 11 group by 1, 2)""",
    ),
)


def long_features(s, d):
    """entity, block, feature, value; the panel is written first, as five scans of the facts cost more."""
    full = written(complete(s, d))
    level = features.level(full).select("entity", F.lit("level").alias("block"), F.lit("level").alias("feature"), F.col("level").alias("value"))
    profile = features.profile(full).select("entity", F.lit("profile"), F.col("category"), F.col("profile"))
    season = features.season(full, HIGH, "R").unpivot("entity", ["season_amp", "high_all", "high_category"], "feature", "value")
    return level.union(profile).union(season.select("entity", F.lit("season"), "feature", "value"))


LONG = f"""{SEASON}, feats as (select entity, 'level' as block, 'level' as feature, avg(x) as value from total group by 1
union all select entity, 'profile', category, avg(x) from rel group by 1, 3
union all select entity, 'season', unnest(['season_amp', 'high_all', 'high_category']), unnest([season_amp, high_all, high_category]) from seasons),
scaler0 as (select block, feature, median(value) as center, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr, stddev_samp(value) as sd from feats group by 1, 2),
scaler as (select block, feature, center, case when iqr > 1e-12 then iqr else sd + 1e-12 end as scale,
  case block when 'season' then 0.7 else 1.0 end / sqrt(count(*) over (partition by block)) as weight from scaler0)"""
add("robust_scaler", lambda s, d: features.fit_scaler(long_features(s, d), WEIGHTS), wrapped("select * from scaler", "block, feature", "center, scale, weight", LONG))


def _scaled(s, d):
    long = written(long_features(s, d))
    return features.transform(long, features.fit_scaler(long, WEIGHTS)).select("entity", "block", "feature", "value")


add(
    "robust_scale",
    _scaled,
    wrapped("select entity, block, feature, (value - center) / scale * weight as value from feats join scaler using (block, feature)", "entity, block, feature", "value", LONG),
)
add(
    "pivot_wide",
    lambda s, d: panel.spread_categories(complete(s, d), ["A", "N", "R"]),
    wrapped(
        "select entity, period, min(value) filter (where category = 'A') as \"A\", min(value) filter (where category = 'N') as \"N\", min(value) filter (where category = 'R') as \"R\" from whole group by 1, 2",
        "entity, period", '"A", "N", "R"', CELLS,
    ),
)


def _kinds(s, d):
    own = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = own.groupBy("c_mktsegment", "n_regionkey").agg(F.count("*").alias("n"))
    return counts.select("c_mktsegment", "n_regionkey", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("c_mktsegment"))).alias("share"))


add(
    "kind_shares",
    _kinds,
    wrapped(
        "select c_mktsegment, n_regionkey, count(*) as n, count(*) / sum(count(*)) over (partition by c_mktsegment) as share from customer join nation on n_nationkey = c_nationkey group by 1, 2",
        "c_mktsegment, n_regionkey, n", "share",
    ),
)


def _top(s, d):
    counts = table(s, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("n"), "c_nationkey"))
    top = counts.withColumn("place", place).where("place <= 4")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "c_nationkey"))), lambda x: x["c_nationkey"].cast("string")), "; ")
    return top.groupBy("c_mktsegment").agg(listed.alias("nations"), F.max(F.when(F.col("place") == 1, F.col("c_nationkey"))).alias("mode"))


add(
    "top_values",
    _top,
    """with counts as (select c_mktsegment, c_nationkey, count(*) as n from customer group by 1, 2),
    top as (select *, row_number() over (partition by c_mktsegment order by n desc, c_nationkey) as place from counts)
    select c_mktsegment, string_agg(c_nationkey, '; ' order by place) as nations, max(case when place = 1 then c_nationkey end) as mode from top where place <= 4 group by 1""",
)
add(
    "group_quantiles",
    lambda s, d: table(s, d, "customer").groupBy("c_mktsegment").agg(
        *(F.percentile("c_acctbal", F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)), F.median("c_acctbal").alias("median"), F.avg("c_acctbal").alias("mean"), F.count("*").alias("size")
    ),
    wrapped(
        "select c_mktsegment, count(*) as size, quantile_cont(c_acctbal, 0.25) as q25, quantile_cont(c_acctbal, 0.5) as q50, quantile_cont(c_acctbal, 0.75) as q75, median(c_acctbal) as median, avg(c_acctbal) as mean from customer group by 1",
        "c_mktsegment, size", "q25, q50, q75, median, mean",
    ),
)


def _growth(s, d):
    total = panel.totals(complete(s, d)).withColumn("year", F.year("period"))
    year = total.where(F.col("year").isin(1999, 2000)).groupBy("entity").pivot("year", [1999, 2000]).agg(F.avg("total"))
    ratio = year.select("entity", (F.col("2000") / F.col("1999")).alias("ratio"))
    return ratio.crossJoin(F.broadcast(ratio.agg(F.median("ratio").alias("middle")))).select("entity", (F.col("ratio") / F.col("middle") - 1).alias("growth"))  # one row


GROWTH = f"""{CELLS}, years as (select entity, period, sum(value) as total from whole group by 1, 2),
ratios as (select entity, avg(total) filter (where year(period) = 2000) / avg(total) filter (where year(period) = 1999) as ratio from years group by 1),
growth as (select entity, ratio / (select median(ratio) from ratios) - 1 as growth from ratios)"""


def _growth_text(s, d):
    """Growth is taken to 12 digits, below the noise of the sums, so that copies of the middle entity are all at +0%; what is
    truly under zero keeps its sign when 6 digits of it are 0."""
    growth = F.round("growth", 12)
    short = F.round(growth, 6)
    return _growth(s, d).select("entity", signed_percent(F.when(growth < 0, -F.abs(short)).otherwise(short), 0).alias("text"), bin_of(growth, [-0.1, 0.0, 0.25]).alias("bin"))


add("growth_vs_middle", _growth, wrapped("select * from growth", "entity", "growth", GROWTH))
add(
    "growth_text",
    _growth_text,
    f"""with {GROWTH} select entity, replace(printf('%+.0f%%', round(growth, 6) * 100), '-', '−') as text, cast(growth >= -0.1 as integer) + cast(growth >= 0 as integer) + cast(growth >= 0.25 as integer) as bin from growth""",
)


def _volatility(s, d):
    moved = features.change(panel.totals(complete(s, d)), "entity", "period", "total")
    return moved.groupBy("entity").agg(
        F.stddev_samp("change").alias("volatility"), F.min(F.when(F.year("period") == 1997, F.col("total"))).alias("trough"), F.max(F.when(F.year("period") == 1998, F.col("total"))).alias("peak")
    )


add(
    "change_features",
    _volatility,
    wrapped(
        """select entity, stddev_samp(change) as volatility, min(total) filter (where year(period) = 1997) as trough, max(total) filter (where year(period) = 1998) as peak
        from (select *, total - lag(total) over (partition by entity order by period) as change from (select entity, period, sum(value) as total from whole group by 1, 2)) group by 1""",
        "entity", "volatility, trough, peak", CELLS,
    ),
)


def _excess(s, d):
    x = features.log_total(complete(s, d)).withColumn("year", F.year("period"))
    high = F.avg(F.when(F.month("period").isin(HIGH), F.col("x")))
    return x.groupBy("entity", "year").agg(F.expm1(high - F.avg("x")).alias("excess"))


add(
    "season_excess",
    _excess,
    wrapped("select entity, year(period) as year, exp(avg(x) filter (where month(period) in (4, 7)) - avg(x)) - 1 as excess from total group by 1, 2", "entity, year", "excess", CELLS),
)
add(
    "monthly_totals",
    lambda s, d: table(s, d, "orders").groupBy(month_of(F.col("o_orderdate")).alias("month")).agg(F.sum("o_totalprice").alias("total"), F.countDistinct("o_custkey").alias("customers")),
    wrapped("select substr(cast(o_orderdate as varchar), 1, 7) as month, sum(o_totalprice) as total, count(distinct o_custkey) as customers from orders group by 1", "month, customers", "total"),
)
