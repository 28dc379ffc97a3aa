"""The analysis tables made from the given ones, as DataFrames and as SQL.

Panel: suppliers by quarter and return flag over 1996 to 2000. Points: embeddings with their labels. Graph: the union of the
15 nearest by cosine. Window labels: quarters in windows of 8, a step of 4; entities in four equal parts by level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import features, graphs, panel
from terrane.operators.shared import rounded, written
from terrane.sources import table

K_NN = 15


def cells(spark, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem", ["l_suppkey", "l_returnflag", "l_extendedprice", "l_shipdate"], (F.col("l_shipdate") >= "1996-01-01") & (F.col("l_shipdate") < "2001-01-01"))
    return panel.panel(rows, F.col("l_suppkey"), F.trunc("l_shipdate", "quarter"), F.col("l_returnflag"), F.col("l_extendedprice"))


def complete(spark, sf: str) -> DataFrame:
    return panel.complete_panel(cells(spark, sf))


def points(spark, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("int").alias("label"))


def labels(spark, sf: str) -> DataFrame:
    return points(spark, sf).select("id", "label")


def graph(spark, sf: str, k: int = K_NN) -> DataFrame:
    return graphs.build_graph("cosine", k, points(spark, sf))


def window_labels(spark, sf: str) -> DataFrame:
    """id, window, label, confidence; written, as moves between windows read it several times."""
    level = features.window_level(complete(spark, sf), 8, 4).select(F.col("entity").alias("id"), (F.col("window") / 4).cast("int").alias("window"), F.round("level", 9).alias("level"))
    by = Window.partitionBy("window")
    place = F.row_number().over(by.orderBy("level", "id")) - 1
    return written(level.select("id", "window", F.floor(place * 4 / F.count("*").over(by)).cast("int").alias("label"), F.abs("level").alias("confidence")))


CELLS = """cells as (
  select l_suppkey as entity, cast(date_trunc('quarter', l_shipdate) as date) as period, l_returnflag as category, sum(l_extendedprice) as value
  from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '2001-01-01' group by 1, 2, 3),
size as (select count(distinct period) * count(distinct category) as wanted from cells),
cover as (select entity, count(*) filter (where value > 0) as present from cells group by 1),
whole as (select cells.* from cells join cover using (entity), size where present = wanted),
total0 as (select entity, period, ln(sum(value)) as x from whole group by 1, 2),
total as (select entity, period, x - median(x) over (partition by period) as x from total0)"""

POINTS = "points as (select vec_id as id, cast(embedding as double[]) as vec, cast(label as integer) as label from embeddings)"


def knn(k: int = K_NN, name: str = "g") -> str:
    return f"""{name}_sim as (
  select a.id as src, b.id as dst, round(list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec)), 9) as w
  from points a join points b on a.id <> b.id),
{name}_top as (select * from (select *, row_number() over (partition by src order by w desc, dst) as place from {name}_sim) where place <= {k}),
{name} as (select src, dst, max(w) as w from (select src, dst, w from {name}_top where w > 0 union all select dst, src, w from {name}_top where w > 0) group by 1, 2)"""


WINDOWS = f"""{CELLS},
numbered as (select period, row_number() over (order by period) - 1 as t from (select distinct period from whole)),
starts as (select unnest(range(0, (select max(t) - 7 + 1 from numbered), 4)) as s),
levels as (select s // 4 as "window", entity as id, round(avg(x), 9) as level from total join numbered using (period) join starts on t between s and s + 7 group by 1, 2),
wl as (select id, cast("window" as integer) as "window", abs(level) as confidence,
  cast(floor((row_number() over (partition by "window" order by level, id) - 1) * 4 / count(*) over (partition by "window")) as integer) as label from levels)"""


def wrapped(body: str, select: str, doubles: str = "", prefix: str = "") -> str:
    """SQL whose columns named in doubles are rounded like ``rounded``; prefix: common table expressions."""
    out = ", ".join([*(x.strip() for x in select.split(",") if x.strip()), *(f"round({x.strip()}, 6) + 0.0 as {x.strip()}" for x in doubles.split(",") if x.strip())])
    return f"{'with ' + prefix if prefix else ''} select {out} from ({body}) as result"


def coin_sql(k: str, n: str) -> str:
    """The two-sided binomial test at one half; the terms' logarithms by lgamma."""
    return f"""case when 2 * least({k}, {n} - ({k})) >= {n} then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least({k}, {n} - ({k})) + 1),
      lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - ({n}) * ln(2))))) end"""


def query(make):
    """Doubles rounded, so that the order of sums doesn't show."""

    def run(spark, sf: str) -> DataFrame:
        return rounded(make(spark, sf))

    run.__doc__ = make.__doc__
    return run
