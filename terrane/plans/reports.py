"""Reports: profiles of groups, cards of entities, and the questions of an interactive view."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.functions import bin_of
from terrane.operators import features, graphs, panel, quality
from terrane.operators.shared import squared_distance, written
from terrane.plans.common import CELLS, POINTS, WINDOWS, complete, graph, knn, points, query, window_labels, wrapped
from terrane.plans.networks import CENTRES, ENDS
from terrane.plans.panels import UNITS
from terrane.sources import table

QUERIES, SQL = {}, {}


def add(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = query(make)
    if sql:
        SQL[name] = sql


def medoids(df, centre, k: int):
    """label, members: the k points nearest to a cluster's centre, ties by id."""
    near = df.join(F.broadcast(centre.select("label", "centre")), "label").withColumn("d", squared_distance("vec", "centre"))  # a row for each cluster
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.round("d", 9), "id"))).where(F.col("place") <= k)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"].cast("string"))
    return near.groupBy("label").agg(F.array_join(listed, " ").alias("members"))


add(
    "medoids",
    lambda s, d: medoids(points(s, d), quality.centres(points(s, d)), 5),
    f"""with {CENTRES}, near as (select p.id, p.label, row_number() over (partition by p.label order by round(pow(list_distance(p.vec, c.centre), 2), 9), p.id) as place from points p join centres c using (label))
    select label, string_agg(id, ' ' order by place) as members from near where place <= 5 group by 1""",
)


def _top_deviations(s, d):
    units = panel.unit_table(complete(s, d)).join(_segments(s, d), "entity").select("entity", F.col("region").alias("cluster"), F.col("category").alias("feature"), F.col("share").alias("value"))
    dev = features.deviations(units).withColumn("deviation", F.round("deviation", 9))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.abs("deviation")), "feature"))
    return dev.withColumn("place", place).where("place <= 2")


def _segments(s, d):
    own = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return own.select(F.col("s_suppkey").alias("entity"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("nation"), F.col("s_acctbal").alias("balance"))


DEVIATIONS = f"""{UNITS}, own as (select n_regionkey as cluster, category as feature, avg(share) as own from units join supplier on s_suppkey = entity join nation on n_nationkey = s_nationkey group by 1, 2),
grand as (select category as feature, avg(share) as grand from units join supplier on s_suppkey = entity group by 1),
dev as (select cluster, feature, round((own - grand) / grand, 9) as deviation from own join grand using (feature))"""
add(
    "top_deviations",
    _top_deviations,
    wrapped("select * from (select *, row_number() over (partition by cluster order by abs(deviation) desc, feature) as place from dev) where place <= 2", "cluster, feature, place", "deviation", DEVIATIONS),
)


def _profiles(s, d):
    total = panel.totals(complete(s, d)).groupBy("entity").agg(F.avg("total").alias("spend"))
    whole = total.join(_segments(s, d), "entity")
    return whole.groupBy("region").agg(F.count("*").alias("size"), F.median("spend").alias("spend"), F.median("balance").alias("balance"), F.countDistinct("nation").alias("nations"))


SPEND = f"{CELLS}, spend as (select entity, avg(total) as spend from (select entity, period, sum(value) as total from whole group by 1, 2) group by 1), own as (select * from spend join supplier on s_suppkey = entity join nation on n_nationkey = s_nationkey)"
add(
    "cluster_profiles",
    _profiles,
    wrapped("select n_regionkey as region, count(*) as size, median(spend) as spend, median(s_acctbal) as balance, count(distinct n_name) as nations from own group by 1", "region, size, nations", "spend, balance", SPEND),
)


def _cards(s, d):
    """An entity as one row: its shares as an array, its status against all that were asked for."""
    units = panel.unit_table(complete(s, d)).groupBy("entity").agg(F.max("total_mean").alias("spend"), F.array_sort(F.collect_list(F.struct("category", F.round("share", 3).alias("share")))).alias("shares"))
    seen = table(s, d, "lineitem", ["l_suppkey"]).distinct().select(F.col("l_suppkey").alias("entity"), F.lit(True).alias("seen"))
    status = F.when(F.col("spend").isNotNull(), "ok").when(F.col("seen"), "incomplete").otherwise("absent")
    cards = _segments(s, d).join(units, "entity", "left").join(seen, "entity", "left")
    text = F.array_join(F.transform("shares", lambda x: F.concat(x["category"], F.lit(":"), F.format_number(x["share"], 3))), " ")
    return cards.select("entity", "nation", status.alias("status"), "spend", text.alias("shares"))


add(
    "entity_cards",
    _cards,
    wrapped(
        """select s_suppkey as entity, n_name as nation, case when spend is not null then 'ok' when s_suppkey in (select l_suppkey from lineitem) then 'incomplete' else 'absent' end as status, spend, shares
        from supplier join nation on n_nationkey = s_nationkey left join (select entity, max(total_mean) as spend, string_agg(category || ':' || printf('%.3f', round(share, 3)), ' ' order by category) as shares from units group by 1) on entity = s_suppkey""",
        "entity, nation, status, shares", "spend", UNITS,
    ),
)
add(
    "status_counts",
    lambda s, d: _cards(s, d).groupBy("status").agg(F.count("*").alias("n")),
    f"with {CELLS} select case when s_suppkey in (select entity from whole) then 'ok' when s_suppkey in (select l_suppkey from lineitem) then 'incomplete' else 'absent' end as status, count(*) as n from supplier group by 1",
)


def _nested(s, d):
    both = window_labels(s, d)
    counts = both.where("window = 0").select("id", F.col("label").alias("a")).join(both.where("window = 1").select("id", F.col("label").alias("b")), "id").groupBy("a", "b").agg(F.count("*").alias("n"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    return most.agg((F.sum("most") / F.sum("n")).alias("nestedness"))


add(
    "nestedness",
    _nested,
    wrapped('select sum(most) / sum(n) as nestedness from (select a, max(n) as most, sum(n) as n from (select x.label as a, y.label as b, count(*) as n from wl x join wl y using (id) where x."window" = 0 and y."window" = 1 group by 1, 2) group by 1)', "", "nestedness", WINDOWS),
)
add(
    "certainty_bins",
    lambda s, d: window_labels(s, d).groupBy("window", bin_of(F.col("confidence"), [0.1, 0.25]).alias("bin")).agg(F.count("*").alias("n")),
    f'with {WINDOWS} select "window", cast(confidence >= 0.1 as integer) + cast(confidence >= 0.25 as integer) as bin, count(*) as n from wl group by 1, 2',
)


def _flows(s, d):
    both = window_labels(s, d)
    later = both.select("id", F.col("window"), F.col("label").alias("b"))
    moved = both.select("id", (F.col("window") + 1).alias("window"), F.col("label").alias("a")).join(later, ["id", "window"]).where("a <> b")
    return moved.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(12)


add(
    "top_flows",
    _flows,
    f'with {WINDOWS} select x.label as a, y.label as b, count(*) as n from wl x join wl y on y.id = x.id and y."window" = x."window" + 1 where x.label <> y.label group by 1, 2 order by n desc, a, b limit 12',
)


def _breaks(s, d):
    """Class limits of a measure: quantiles, and equal steps up to the 95 % absolute quantile for one that has two signs."""
    level = features.level(complete(s, d))
    cuts = [0.2, 0.4, 0.6, 0.8]
    return level.agg(*(F.percentile("level", F.lit(q)).alias(f"q{int(q * 10)}") for q in cuts), (F.percentile(F.abs("level"), F.lit(0.95)) / 3).alias("step"))


add(
    "class_breaks",
    _breaks,
    wrapped(
        "select quantile_cont(level, 0.2) as q2, quantile_cont(level, 0.4) as q4, quantile_cont(level, 0.6) as q6, quantile_cont(level, 0.8) as q8, quantile_cont(abs(level), 0.95) / 3 as step from (select entity, avg(x) as level from total group by 1)",
        "", "q2, q4, q6, q8, step", CELLS,
    ),
)


def _search(s, d):
    """Names that are the text, else those that hold it in any case."""
    names = table(s, d, "nation").select("n_nationkey", "n_name")
    text = F.lit("NATION_1")
    exact = names.where(F.col("n_name") == text).withColumn("rank", F.lit(1))
    loose = names.where(F.lower("n_name").contains(F.lower(text))).withColumn("rank", F.lit(2)).join(exact, "n_nationkey", "left_anti")
    return exact.union(loose)


add("search_names", _search, "select n_nationkey, n_name, case when n_name = 'NATION_1' then 1 else 2 end as rank from nation where contains(lower(n_name), 'nation_1')")


def _peers(s, d):
    """For each entity the entities of its region within 5 % of its spend."""
    spend = panel.totals(complete(s, d)).groupBy("entity").agg(F.avg("total").alias("spend")).join(_segments(s, d), "entity")
    # Steps of a tenth in logarithm: whoever is within 5 % is in the same step or one next to it.
    spend = spend.withColumn("step", F.floor(F.ln("spend") * 10))
    other = spend.select("region", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"), F.col("entity").alias("peer"), F.col("spend").alias("peer_spend"))
    near = spend.join(other, ["region", "step"]).where("entity <> peer and peer_spend between spend * 0.95 and spend * 1.05")
    return near.groupBy("entity").agg(F.count("*").alias("peers"), F.min("peer").alias("first_peer"))


add(
    "peers_within",
    _peers,
    f"with {SPEND} select x.entity, count(*) as peers, min(y.entity) as first_peer from own x join own y on x.n_regionkey = y.n_regionkey and x.entity <> y.entity and y.spend between x.spend * 0.95 and x.spend * 1.05 group by 1",
)


def _year_medians(s, d):
    total = panel.totals(complete(s, d)).withColumn("year", F.year("period"))
    own = total.groupBy("entity", "year").agg(F.avg("total").alias("spend"))
    return own.join(_segments(s, d), "entity").groupBy("year", "region").agg(F.percentile("spend", F.lit(0.25)).alias("q25"), F.median("spend").alias("q50"), F.percentile("spend", F.lit(0.75)).alias("q75"))


add(
    "year_quantiles",
    _year_medians,
    wrapped(
        """select year, n_regionkey as region, quantile_cont(spend, 0.25) as q25, median(spend) as q50, quantile_cont(spend, 0.75) as q75
        from (select entity, year(period) as year, avg(total) as spend from (select entity, period, sum(value) as total from whole group by 1, 2) group by 1, 2) join supplier on s_suppkey = entity join nation on n_nationkey = s_nationkey group by 1, 2""",
        "year, region", "q25, q50, q75", CELLS,
    ),
)


def _edge_lengths(s, d):
    """Known distances looked up on edges: median over those that have one, and the share of edges that have."""
    ends = graphs.upper(graph(s, d)).select("src", "dst")
    for e in ("src", "dst"):
        ends = ends.join(points(s, d).select(F.col("id").alias(e), F.col("label").alias(f"label_{e}")), e)
    ends = ends.withColumn("km", F.when(F.col("label_src") == F.col("label_dst"), (F.col("dst") - F.col("src")).cast("double")))
    return ends.agg(F.median("km").alias("median_km"), F.avg(F.col("km").isNotNull().cast("double")).alias("known"))


add("edge_lengths", _edge_lengths, wrapped("select median(dst - src) filter (where la = lb) as median_km, avg(case when la = lb then 1.0 else 0.0 end) as known from ends where src < dst", "", "median_km, known", ENDS))


def _sweep(s, d):
    """Neighbours tried: edges and the overlap with the main graph."""
    top = written(graphs.nearest(points(s, d), 20))  # those of fewer neighbours are in it
    some = lambda k: graphs.knn_from_similarity(top.where(F.col("place") <= k))
    main, out = written(some(15)), None
    for k in (5, 10, 20):
        one = graphs.jaccard(some(k), main).select(F.lit(k).alias("k"), "shared", "jaccard")
        out = one if out is None else out.union(one)
    return out


add(
    "knn_sensitivity",
    _sweep,
    wrapped(
        " union all ".join(f"select {k} as k, count(*) filter (where x = 1 and y = 1) as shared, count(*) filter (where x = 1 and y = 1) / count(*) as jaccard from (select src, dst, 1 as x from g{k} where src < dst) full join (select src, dst, 1 as y from g where src < dst) using (src, dst)" for k in (5, 10, 20)),
        "k, shared", "jaccard", f"{POINTS}, {knn()}, {knn(5, 'g5')}, {knn(10, 'g10')}, {knn(20, 'g20')}",
    ),
)
add(
    "two_level_summary",
    lambda s, d: table(s, d, "part").groupBy("p_type", "p_size").agg(F.avg("p_retailprice").alias("price")).groupBy("p_type").agg(F.avg("price").alias("mean"), F.max("price").alias("most"), F.max_by("p_size", F.struct("price", -F.col("p_size"))).alias("best_size")),
    wrapped(
        "select p_type, avg(price) as mean, max(price) as most, arg_max(p_size, price) as best_size from (select p_type, p_size, avg(p_retailprice) as price from part group by 1, 2) group by 1", "p_type, best_size", "mean, most"
    ),
)
add(
    "missing_names",
    lambda s, d: table(s, d, "nation").select("n_nationkey").exceptAll(table(s, d, "supplier").where("s_acctbal > 5000").select("s_nationkey").distinct()).orderBy("n_nationkey"),
    "select n_nationkey from nation except select s_nationkey from supplier where s_acctbal > 5000",
)
add(
    "cross_counts",
    lambda s, d: table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0),
    'select o_orderpriority, count(*) filter (where o_orderstatus = \'F\') as "F", count(*) filter (where o_orderstatus = \'O\') as "O", count(*) filter (where o_orderstatus = \'P\') as "P" from orders group by 1',
)
