"""Votes, moves between windows, matching of outside tables, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.functions import decimal_comma, digits_key, name_key, padded
from terrane.operators import dynamics, panel, validate, voting
from terrane.operators.quality import eta_squared
from terrane.operators.shared import written
from terrane.plans.common import WINDOWS, coin_sql, query, window_labels, wrapped
from terrane.sources import table
from terrane.streaming import drained, event_stream, sessions, windowed

QUERIES, SQL = {}, {}


def add(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = query(make)
    if sql:
        SQL[name] = sql


# --- Votes: brands as candidates, measures of their parts as voters --------------------------------

DIRECTIONS = {"price": -1, "size": 1, "parts": 1, "dear": 1, "spread": -1}


def _brands(s, d):
    part = table(s, d, "part", ["p_brand", "p_retailprice", "p_size"])
    return part.groupBy("p_brand").agg(
        F.round(F.avg("p_retailprice"), 6).alias("price"), F.round(F.avg("p_size"), 6).alias("size"), F.count("*").cast("double").alias("parts"),
        F.max("p_retailprice").alias("dear"), F.round(F.stddev_pop("p_retailprice"), 6).alias("spread"), F.lit(None).cast("double").alias("empty"),
    )


def votes(s, d):
    return voting.ballots(_brands(s, d), "p_brand", DIRECTIONS | {"empty": 1})


VOTES = """brands as (select p_brand, round(avg(p_retailprice), 6) as price, round(avg(p_size), 6) as size, cast(count(*) as double) as parts, max(p_retailprice) as dear, round(stddev_pop(p_retailprice), 6) as spread from part group by 1),
votes as (select p_brand as candidate, unnest(['price', 'size', 'parts', 'dear', 'spread']) as voter, unnest([-price, size, parts, dear, -spread]) as score from brands),
duels as (select x.candidate as a, y.candidate as b, count(*) filter (where x.score > y.score) as prefer, count(*) filter (where x.score < y.score) as against from votes x join votes y using (voter) where x.candidate <> y.candidate group by 1, 2),
copeland as (select a as candidate, cast(sum(sign(prefer - against)) as double) as score from duels group by 1),
borda as (select candidate, sum(below + level / 2) as score from (select *, rank() over (partition by voter order by score) - 1 as below, count(*) over (partition by voter, score) - 1 as level from votes) group by 1),
strength as (select a, b, case when prefer > against then prefer else 0 end as p from duels)"""


def _threshold_sql(grades: int) -> str:
    counts = ", ".join(f"count(*) filter (where grade = {g}) as g{g}" for g in range(grades - 1))
    order = ", ".join(f"g{g}" for g in range(grades - 1))
    return f"""t{grades} as (select candidate, cast(count(*) over () - rank() over (order by {order}) + 1 as double) as score from (
      select candidate, {counts} from (select *, least({grades - 1}, floor((row_number() over (partition by voter order by score, candidate) - 1) * {grades} / count(*) over (partition by voter))) as grade from votes) group by 1))"""


def _widest() -> str:
    """Paths of up to 32 steps by five doublings; there are 25 brands."""
    out, last = [], "strength"
    for i in range(5):
        out.append(f"p{i} as (select a, b, max(p) as p from (select * from {last} union all select x.a, y.b, least(x.p, y.p) from {last} x join {last} y on x.b = y.a where x.a <> y.b) group by 1, 2)")
        last = f"p{i}"
    return ", ".join(out) + f", schulze as (select x.a as candidate, cast(count(*) filter (where x.p > y.p) as double) as score from {last} x join {last} y on y.a = x.b and y.b = x.a group by 1)"


ALL_RULES = f"{VOTES}, {_threshold_sql(3)}, {_threshold_sql(5)}, {_widest()}"
for _name, _rule, _cte in (("copeland", voting.copeland, "copeland"), ("borda", voting.borda, "borda"), ("threshold", voting.threshold, "t3"), ("schulze", voting.schulze, "schulze")):
    add(f"vote_{_name}", lambda s, d, rule=_rule: rule(votes(s, d)), wrapped(f"select * from {_cte}", "candidate", "score", ALL_RULES))
add("vote_duels", lambda s, d: voting.duels(votes(s, d)), f"with {VOTES} select * from duels")
add(
    "vote_table",
    lambda s, d: voting.rule_table(votes(s, d), "Brand#11"),
    f"""with {ALL_RULES}, scored as (select 'copeland' as rule, * from copeland union all select 'borda', * from borda union all select 'schulze', * from schulze union all select 'threshold_3', * from t3 union all select 'threshold_5', * from t5),
    placed as (select *, rank() over (partition by rule order by score desc) as place from scored)
    select rule, string_agg(candidate, '; ' order by candidate) filter (where place = 1) as winners, cast(count(*) filter (where place = 1) as integer) as ties, cast(max(case when candidate = 'Brand#11' then place end) as integer) as chosen_rank,
      max(case when candidate = 'Brand#11' then place end) = 1 as chosen_wins, max(case when candidate = 'Brand#11' then place end) = 1 and count(*) filter (where place = 1) = 1 as chosen_alone from placed group by 1""",
)


def _configurations(s, d):
    part = table(s, d, "part", ["p_type", "p_size", "p_retailprice"])
    return part.groupBy(F.col("p_type").alias("method"), (F.col("p_size") % 9 + 4).cast("int").alias("k")).agg(F.round(F.avg("p_retailprice") / 1500, 6).alias("stability"))


CONFIGURATIONS = "conf as (select p_type as method, cast(p_size % 9 + 4 as integer) as k, round(avg(p_retailprice) / 1500, 6) as stability from part group by 1, 2)"
add("detailed_choice", lambda s, d: voting.detailed_choice(_configurations(s, d), 6, 0.5), f"with {CONFIGURATIONS} select method, min(k) as k from conf where k >= 6 and stability >= 0.5 group by 1")
add(
    "share_sweep",
    lambda s, d: voting.largest_share(_configurations(s, d).groupBy((F.col("k") / 20).alias("share")).agg(F.avg("stability").alias("sw")), 0.01),
    wrapped(
        "select max(share) as share from (select *, first_value(sw) over (order by share) as base from (select k / 20 as share, avg(stability) as sw from conf group by 1)) where sw >= base - 0.01", "", "share", CONFIGURATIONS
    ),
)

# --- Moves ------------------------------------------------------------------------------------------

add("window_labels", window_labels, wrapped('select * from wl', 'id, "window", label', "confidence", WINDOWS))
MATRIX = f"""{WINDOWS}, names as (select distinct label from wl),
moves as (select x.label as a, y.label as b, count(*) as n from wl x join wl y using (id) where x."window" = 0 and y."window" = 3 group by 1, 2),
matrix as (select p.label as a, q.label as b, coalesce(n, 0) as n from names p cross join names q left join moves on moves.a = p.label and moves.b = q.label)"""
add("transition_matrix", lambda s, d: dynamics.row_shares(dynamics.transition_matrix(window_labels(s, d), 0, 3)), wrapped("select *, coalesce(n / nullif(sum(n) over (partition by a), 0), 0) as share from matrix", "a, b, n", "share", MATRIX))
add(
    "confident_moves",
    lambda s, d: dynamics.confident_moves(window_labels(s, d), 0, 3, 0.05),
    f'with {WINDOWS} select id, x.label as a, y.label as b from wl x join wl y using (id) where x."window" = 0 and y."window" = 3 and x.label <> y.label and x.confidence >= 0.05 and y.confidence >= 0.05',
)
add(
    "move_counts",
    lambda s, d: dynamics.move_counts(window_labels(s, d), 0, 3, [0.0, 0.05, 0.1, 0.3]),
    f"""with {WINDOWS} select least, (select count(*) from wl x join wl y using (id) where x."window" = 0 and y."window" = 3 and x.label <> y.label and x.confidence >= least and y.confidence >= least) as moves
    from (select unnest([0.0::double, 0.05, 0.1, 0.3]) as least)""",
)
add(
    "persistent_moves",
    lambda s, d: dynamics.persistent_moves(window_labels(s, d), 2),
    f"""with {WINDOWS} select id, min(label) filter (where "window" < 2) as a, min(label) filter (where "window" >= 2) as b from wl group by 1
    having min(label) filter (where "window" < 2) = max(label) filter (where "window" < 2) and min(label) filter (where "window" >= 2) = max(label) filter (where "window" >= 2)
    and min(label) filter (where "window" < 2) <> min(label) filter (where "window" >= 2)""",
)
add(
    "flow_asymmetry",
    lambda s, d: dynamics.flow_asymmetry(dynamics.confident_moves(window_labels(s, d), 0, 3, 0.0), 2),
    wrapped(
        f"""select *, {coin_sql('forward', 'forward + backward')} as p from (select least(x.label, y.label) as a, greatest(x.label, y.label) as b, count(*) filter (where x.label < y.label) as forward, count(*) filter (where x.label > y.label) as backward
        from wl x join wl y using (id) where x."window" = 0 and y."window" = 3 and x.label <> y.label group by 1, 2 having count(*) >= 2)""",
        "a, b, forward, backward", "p", WINDOWS,
    ),
)
add(
    "consecutive_ari",
    lambda s, d: dynamics.consecutive_ari(window_labels(s, d)),
    wrapped(
        """select "window", (x - pa * pb / tt) / ((pa + pb) / 2 - pa * pb / tt) as ari from (select "window", sum(n * (n - 1) / 2) as x, sum(n) * (sum(n) - 1) / 2 as tt from counts group by 1)
        join (select "window", sum(n * (n - 1) / 2) as pa from (select "window", a, sum(n) as n from counts group by 1, 2) group by 1) using ("window")
        join (select "window", sum(n * (n - 1) / 2) as pb from (select "window", b, sum(n) as n from counts group by 1, 2) group by 1) using ("window")""",
        '"window"', "ari",
        f"""{WINDOWS}, counts as (select y."window", x.label as a, y.label as b, count(*) as n from wl x join wl y on y.id = x.id and y."window" = x."window" + 1 group by 1, 2, 3)""",
    ),
)
MONIC = f"""{WINDOWS}, counts as (select y."window", x.label as a, y.label as b, count(*) as n from wl x join wl y on y.id = x.id and y."window" = x."window" + 1 group by 1, 2, 3),
over_ as (select *, n / sum(n) over (partition by "window", a) as overlap, sum(n) over (partition by "window", a) as size_from, sum(n) over (partition by "window", b) as size_to from counts),
strong as (select *, row_number() over (partition by "window", a order by overlap desc, b) as place, count(*) over (partition by "window", b) as takers from over_ where overlap >= 0.5),
kept as (select * from strong where place = 1),
weak as (select "window", a, sum(overlap) filter (where overlap >= 0.25) as parts, count(*) filter (where overlap >= 0.25) as np, max(overlap) as most, max(size_from) as size_from
  from over_ o where not exists (select 1 from strong s where s."window" = o."window" and s.a = o.a) group by 1, 2),
targets as (select "window", b from kept union select o."window", o.b from over_ o join weak w on w."window" = o."window" and w.a = o.a where o.overlap >= 0.25 and np >= 2 and parts >= 0.5),
events_ as (select "window", case when takers > 1 then 'absorb' else 'survive' end as event, a as label, overlap, size_from, size_to,
    case when size_to > size_from * 1.05 then 'grow' when size_to < size_from * 0.95 then 'shrink' else '' end as internal from kept
  union all select "window", case when np >= 2 and coalesce(parts, 0) >= 0.5 then 'split' else 'disappear' end, a, case when np >= 2 and coalesce(parts, 0) >= 0.5 then parts else most end, size_from, null, '' from weak
  union all select "window", 'emerge', b, max(overlap), null, max(size_to), '' from over_ o where not exists (select 1 from targets t where t."window" = o."window" and t.b = o.b) group by "window", b)"""
add(
    "monic_events",
    lambda s, d: dynamics.monic(window_labels(s, d)).select("window", "event", "label", "overlap", "size_from", "size_to", "internal"),
    wrapped('select "window", event, label, overlap, cast(size_from as bigint) as size_from, cast(size_to as bigint) as size_to, internal from events_', '"window", event, label, size_from, size_to, internal', "overlap", MONIC),
)
add(
    "label_overlaps",
    lambda s, d: dynamics.label_overlaps(*(window_labels(s, d).where(F.col("window") == w).select("id", "label") for w in (0, 3))),
    wrapped(
        "select x.label as a, y.label as b, coalesce(m.n, 0) / (x.n + y.n - coalesce(m.n, 0)) as jaccard from nx x cross join ny y left join moves m on m.a = x.label and m.b = y.label", "a, b", "jaccard",
        f'{MATRIX}, nx as (select label, count(*) as n from wl where "window" = 0 group by 1), ny as (select label, count(*) as n from wl where "window" = 3 group by 1)',
    ),
)
add("matched_labels", lambda s, d: dynamics.match_labels(*(window_labels(s, d).where(F.col("window") == w).select("id", "label") for w in (0, 3))))

# --- Matching and outside checks ---------------------------------------------------------------------


def _versions(s, d):
    return table(s, d, "orders", ["o_custkey", "o_orderdate", "o_orderpriority"]).groupBy("o_custkey", F.year("o_orderdate").alias("year_from")).agg(
        (F.max(F.year("o_orderdate")) + 1 + F.max(F.col("o_custkey") % 2)).cast("int").alias("year_to"), F.min("o_orderpriority").alias("priority")
    )


add(
    "scd_lookup",
    lambda s, d: panel.valid_version(_versions(s, d), "o_custkey", 1997).select("o_custkey", "year_from", "year_to", "priority", "exact"),
    """with versions as (select o_custkey, cast(year(o_orderdate) as integer) as year_from, cast(max(year(o_orderdate)) + 1 + max(o_custkey % 2) as integer) as year_to, min(o_orderpriority) as priority from orders group by 1, 2)
    select o_custkey, year_from, year_to, priority, exact from (select *, year_from <= 1997 and 1997 < year_to as exact, row_number() over (partition by o_custkey order by (year_from <= 1997 and 1997 < year_to) desc, year_to desc, year_from desc) as place from versions) where place = 1""",
)


def _fallback(s, d):
    code = digits_key(F.concat_ws("-", F.substring("c_name", 1, 8), F.col("c_custkey")), 8)
    own = table(s, d, "customer").select("c_custkey", code.cast("long").alias("key"))
    orders = table(s, d, "orders", ["o_custkey", "o_orderstatus", "o_totalprice"])
    by = lambda status: orders.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("most"), F.count("*").alias("n"))
    return validate.fallback_match(own, "key", by("F"), by("O"), ["most", "n"], ["most", "n"])


add(
    "fallback_match",
    _fallback,
    wrapped(
        """select c_custkey, c_custkey as key, x.n is null as fallback, case when x.n is null then y.most else x.most end as most, case when x.n is null then y.n else x.n end as n from customer
        left join (select o_custkey, max(o_totalprice) as most, count(*) as n from orders where o_orderstatus = 'F' group by 1) x on x.o_custkey = c_custkey
        left join (select o_custkey, max(o_totalprice) as most, count(*) as n from orders where o_orderstatus = 'O' group by 1) y on y.o_custkey = c_custkey""",
        "c_custkey, key, fallback, n", "most",
    ),
)


def _named(s, d):
    """Suppliers by a shortened nation name; names that several nations share match nothing."""
    nation = table(s, d, "nation").select(name_key(F.concat(F.lit("  "), F.substring("n_name", 1, 8))).alias("key"), "n_name")
    rows = table(s, d, "supplier").select("s_suppkey", name_key(F.concat(F.lit("Nation_"), F.pmod("s_nationkey", F.lit(10)), F.lit(" "))).alias("key"))
    return validate.unique_name_join(rows, nation, "key")


add(
    "unique_name_join",
    _named,
    """select s_suppkey, key, n_name from (select s_suppkey, 'nation_' || (s_nationkey % 10) as key from supplier)
    left join (select lower(substr(n_name, 1, 8)) as key, max(n_name) as n_name from nation group by 1 having count(*) = 1) using (key)""",
)
add(
    "weighted_mean",
    lambda s, d: validate.weighted_mean(
        table(s, d, "lineitem").select("l_suppkey", F.when(F.col("l_linenumber") < 7, F.col("l_discount")).alias("value"), F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).alias("weight"), F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("part")),
        "l_suppkey", "value", "weight", ["part"],
    ),
    wrapped(
        """select l_suppkey, case when count(*) filter (where v is null) > 0 or sum(coalesce(w, 0)) <= 0 then avg(v) else sum(v * coalesce(w, 0)) / nullif(sum(coalesce(w, 0)), 0) end as value, sum(p) as part
        from (select l_suppkey, case when l_linenumber < 7 then l_discount end as v, case when l_returnflag <> 'A' then l_quantity end as w, case when l_returnflag = 'R' then l_tax end as p from lineitem) group by 1""",
        "l_suppkey", "value, part",
    ),
)


def _overlay(s, d):
    orders = table(s, d, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    year = lambda y: orders.where(F.year("o_orderdate") == y).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return validate.year_overlay(year(1996), year(1997), "o_custkey", ["total"], 1996, 1997)


add(
    "year_overlay",
    _overlay,
    wrapped(
        """select o_custkey, case when y.t is not null then y.t else x.t end as total, case when y.t is not null then 1997 else 1996 end as year
        from (select o_custkey, sum(o_totalprice) as t from orders where year(o_orderdate) = 1996 group by 1) x left join (select o_custkey, sum(o_totalprice) as t from orders where year(o_orderdate) = 1997 group by 1) y using (o_custkey)""",
        "o_custkey, year", "total",
    ),
)
RANKED = """ranked as (select c_custkey, c_mktsegment, (rank() over g + (count(*) over (partition by c_mktsegment, c_nationkey) - 1) / 2) / count(*) over (partition by c_mktsegment) as pct_rank, percent_rank() over g as peers_below
  from customer window g as (partition by c_mktsegment order by c_nationkey))"""
add(
    "pct_rank_in_group",
    lambda s, d: validate.rank_in_group(table(s, d, "customer"), "c_mktsegment", "c_nationkey").select("c_custkey", "c_mktsegment", "pct_rank", "peers_below"),
    wrapped("select * from ranked", "c_custkey, c_mktsegment", "pct_rank, peers_below", RANKED),
)
RHO = """r as (select rank() over (order by c_nationkey) + (count(*) over (partition by c_nationkey) - 1) / 2 as rx, rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2 as ry from customer)"""
add("spearman", lambda s, d: validate.spearman(table(s, d, "customer"), "c_nationkey", "c_acctbal"), wrapped("select count(*) as n, corr(rx, ry) as rho from r", "n", "rho", RHO))
add(
    "ols_residual",
    lambda s, d: validate.ols_residual(table(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("x"), F.col("c_acctbal").alias("y")), "x", "y").select("c_custkey", "residual"),
    wrapped("select c_custkey, c_acctbal - (slope * c_nationkey + icept) as residual from customer, (select regr_slope(c_acctbal, c_nationkey) as slope, regr_intercept(c_acctbal, c_nationkey) as icept from customer)", "c_custkey", "residual"),
)


def _flags(s, d):
    own = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 5000, 1).alias("rich"), F.when(F.col("c_nationkey") < 5, 1).alias("near"), F.col("c_acctbal").alias("pop"))
    return validate.label_flags(own, ["rich", "near"], "pop")


add(
    "label_flags",
    _flags,
    wrapped("select c_custkey as id, c_acctbal as pop, cast(c_acctbal > 5000 as integer) as rich, cast(c_nationkey < 5 as integer) as near, case when c_acctbal > 0 then ln(c_acctbal) end as log_pop from customer", "id, rich, near", "pop, log_pop"),
)


def _segments(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))


add(
    "label_profile",
    lambda s, d: validate.label_profile(_segments(s, d), _flags(s, d), ["rich", "near"], ["pop"]),
    wrapped("select c_mktsegment as label, avg(cast(c_acctbal > 5000 as integer)) as mean_rich, avg(cast(c_nationkey < 5 as integer)) as mean_near, median(c_acctbal) as median_pop from customer group by 1", "label", "mean_rich, mean_near, median_pop"),
)
add(
    "official_validity",
    lambda s, d: validate.official_validity(_segments(s, d), _flags(s, d), ["rich", "near"]),
    wrapped(
        """select flag, sqrt(sum(pow(n - e, 2) / e) / max(total) / 1) as v from (select *, na * nb / total as e from (
          select f.flag, x.a, y.b, coalesce(t.n, 0) as n, sum(coalesce(t.n, 0)) over (partition by f.flag, x.a) as na, sum(coalesce(t.n, 0)) over (partition by f.flag, y.b) as nb, sum(coalesce(t.n, 0)) over (partition by f.flag) as total
          from (select unnest(['rich', 'near']) as flag) f cross join (select distinct a from t) x cross join (select unnest([0, 1]) as b) y left join t on t.flag = f.flag and t.a = x.a and t.b = y.b)) group by 1""",
        "flag", "v",
        """t as (select flag, c_mktsegment as a, b, count(*) as n from (select c_mktsegment, unnest(['rich', 'near']) as flag, unnest([cast(c_acctbal > 5000 as integer), cast(c_nationkey < 5 as integer)]) as b from customer) group by 1, 2, 3)""",
    ),
)
add(
    "text_keys",
    lambda s, d: table(s, d, "customer").select("c_custkey", digits_key(F.col("c_name"), 4).alias("digits"), padded(F.col("c_nationkey"), 3).alias("code"), decimal_comma(F.concat(F.col("c_nationkey").cast("string"), F.lit(" 000,5"))).alias("number"), name_key(F.concat(F.lit(" "), "c_mktsegment", F.lit("\t x"))).alias("name")),
    wrapped("select c_custkey, substr(regexp_replace(c_name, '\\D', '', 'g'), 1, 4) as digits, lpad(cast(c_nationkey as varchar), 3, '0') as code, c_nationkey * 1000 + 0.5::double as number, lower(c_mktsegment) || ' x' as name from customer", "c_custkey, digits, code, name", "number"),
)
add(
    "explained_by_period",
    lambda s, d: _explained(s, d),
    wrapped(
        """select period, sum(n * (m - g) * (m - g)) / (sum(n * (m - g) * (m - g)) + sum(n * v)) as eta2 from (select year(o_orderdate) as period, o_orderpriority, avg(ln(o_totalprice)) as m, count(*) as n, var_pop(ln(o_totalprice)) as v from orders where o_totalprice > 0 group by 1, 2)
        join (select year(o_orderdate) as period, avg(ln(o_totalprice)) as g from orders where o_totalprice > 0 group by 1) using (period) where period in (1996, 1997) group by 1""",
        "period", "eta2",
    ),
)


def _explained(s, d):
    rows = table(s, d, "orders", ["o_orderdate", "o_orderpriority", "o_totalprice"]).where("o_totalprice > 0")
    out = None
    for year in (1996, 1997):
        one = rows.where(F.year("o_orderdate") == year).select(F.col("o_orderpriority").alias("label"), F.ln("o_totalprice").alias("value"))
        one = eta_squared(one).select(F.lit(year).alias("period"), "eta2")
        out = one if out is None else out.union(one)
    return out


# --- Streams -----------------------------------------------------------------------------------------


def _shared(spark) -> str:
    written(spark.range(0))  # makes sure that the folder is named
    return spark.conf.get("spark.checkpoint.dir")


add(
    "stream_windows",
    lambda s, d: drained(windowed(event_stream(s, d)), _shared(s)),
    wrapped(
        """select date_trunc('day', ts)::timestamp as window_start, event_type, count(*) as events, sum(value) as total from events group by 1, 2
        having date_trunc('day', ts)::timestamp + interval 1 day <= (select max(ts) - interval 1 hour from events)""",
        "window_start, event_type, events", "total",
    ),
)
add(
    "stream_sessions",
    lambda s, d: drained(sessions(event_stream(s, d)), _shared(s)).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("most")),
    """select user_id, count(*) as sessions, max(n) as most from (select user_id, s, count(*) as n, max(ts) as last_ts from (
      select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from (
      select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events)) group by 1, 2)
      where last_ts + interval 30 minutes <= (select max(ts) - interval 1 hour from events) group by 1""",
)
add(
    "event_ranks",
    lambda s, d: table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("place", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("n")))),
    "select user_id, event_type, count(*) as n, rank() over (partition by user_id order by count(*) desc) as place from events group by 1, 2",
)
