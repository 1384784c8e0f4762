"""The registered queries over boxes, and their DuckDB equivalents.

The boxes, windows and points are derived from the standard tables; the SQL of
the fixtures is the same in Spark and DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright import cli
from boxwright.functions import geometry as g
from boxwright.functions.sql import register_sql
from boxwright.operators import aggregates, join, knn, range_query
from boxwright.plans import layout
from boxwright.sources import text
from boxwright.sources.sinks import scratch_dir

BOX = "id, x AS min_x, y AS min_y, x + w AS max_x, y + h AS max_y"
FIXTURES = {
    "parcels": ("part", f"SELECT {BOX} FROM (SELECT p_partkey AS id, CAST((p_partkey * 7919) % 1009 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 1013 AS DOUBLE) AS y, CAST(p_size % 10 AS DOUBLE) AS w, CAST(p_partkey % 7 AS DOUBLE) AS h FROM part) t"),
    "zones": ("orders", f"SELECT {BOX} FROM (SELECT o_orderkey AS id, CAST((o_orderkey * 6007) % 1009 AS DOUBLE) AS x, CAST((o_orderkey * 3571) % 1013 AS DOUBLE) AS y, CAST(o_orderkey % 5 AS DOUBLE) AS w, CAST(o_custkey % 4 AS DOUBLE) AS h FROM orders) t"),
    "windows": ("supplier", f"SELECT {BOX.replace('id,', 'id AS qid,')} FROM (SELECT s_suppkey AS id, CAST((s_suppkey * 389) % 1109 AS DOUBLE) AS x, CAST((s_suppkey * 577) % 1109 AS DOUBLE) AS y, CAST((s_suppkey * 17) % 60 AS DOUBLE) AS w, CAST((s_suppkey * 29) % 40 AS DOUBLE) AS h FROM supplier) t"),
    "probes": ("customer", "SELECT c_custkey AS qid, CAST((c_custkey * 911) % 1109 AS DOUBLE) AS x, CAST((c_custkey * 613) % 1109 AS DOUBLE) AS y FROM customer"),
    "stops": ("events", "SELECT event_id AS id, value AS min_x, CAST(user_id AS DOUBLE) AS min_y, value AS max_x, CAST(user_id AS DOUBLE) AS max_y FROM events"),
    "regions": ("region", "SELECT r_regionkey AS id, CAST(r_regionkey * 100 AS DOUBLE) AS min_x, CAST((r_regionkey * 37) % 101 AS DOUBLE) AS min_y, CAST(r_regionkey * 100 + 10 AS DOUBLE) AS max_x, CAST((r_regionkey * 37) % 101 + 5 AS DOUBLE) AS max_y FROM region"),
    "nations": ("nation", "SELECT n_nationkey AS qid, CAST((n_nationkey * 31) % 500 AS DOUBLE) AS x, CAST((n_nationkey * 17) % 110 AS DOUBLE) AS y FROM nation"),
    "vec2d": ("embeddings", "SELECT vec_id AS id, element_at(embedding, 1) AS x, element_at(embedding, 2) AS y FROM embeddings"),
}
DUCK = FIXTURES | {"vec2d": ("embeddings", "SELECT vec_id AS id, embedding[1] AS x, embedding[2] AS y FROM embeddings")}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = FIXTURES[name]
    return spark.sql(sql.replace(f"FROM {table}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def query(sql: str, *names: str):
    """Register a function of the fixtures ``names`` under its own name, and
    ``sql`` over views of the same names as its equivalent."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        name = f.__name__.removesuffix("_")
        QUERIES[name] = lambda spark, sf_dir: f(*(fixture(spark, sf_dir, n) for n in names))
        ORACLES[name] = "WITH " + ", ".join(f"{n} AS ({DUCK[n][1]})" for n in names) + " " + sql
        return f

    return register


MEET = "a.max_x >= b.min_x AND a.min_x <= b.max_x AND a.max_y >= b.min_y AND a.min_y <= b.max_y"
D2 = "greatest(a.min_x - q.x, q.x - a.max_x, 0) * greatest(a.min_x - q.x, q.x - a.max_x, 0) + greatest(a.min_y - q.y, q.y - a.max_y, 0) * greatest(a.min_y - q.y, q.y - a.max_y, 0)"
NEAREST = "SELECT qid, id, distance_sq, rank FROM (SELECT qid, id, d AS distance_sq, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM (SELECT q.qid, a.id, {d} AS d FROM {boxes} a, {points} q)) WHERE rank <= {k}"
PAIRS = f"SELECT b.qid, a.id FROM parcels a JOIN windows b ON {MEET}"
JOINED = f"SELECT a.id AS id_a, b.id AS id_b FROM parcels a JOIN zones b ON {MEET}"


@query(PAIRS, "parcels", "windows")
def range_pairs(parcels, windows):
    return range_query.range_pairs(parcels, windows)


@query(f"SELECT b.qid, count(a.id) AS hits FROM windows b LEFT JOIN parcels a ON {MEET} GROUP BY b.qid", "parcels", "windows")
def range_counts(parcels, windows):
    return range_query.range_counts(parcels, windows)


@query(f"SELECT qid FROM windows b WHERE NOT EXISTS (SELECT 1 FROM parcels a WHERE {MEET})", "parcels", "windows")
def range_empty(parcels, windows):
    return range_query.windows_with_hits(parcels, windows, anti=True).select("qid")


@query(f"SELECT qid FROM windows b WHERE EXISTS (SELECT 1 FROM parcels a WHERE {MEET})", "parcels", "windows")
def range_hit_queries(parcels, windows):
    return range_query.windows_with_hits(parcels, windows).select("qid")


@query("SELECT b.qid, a.id FROM parcels a JOIN windows b ON b.min_x <= a.min_x AND b.max_x >= a.max_x AND b.min_y <= a.min_y AND b.max_y >= a.max_y", "parcels", "windows")
def range_contained(parcels, windows):
    return range_query.range_contained(parcels, windows)


@query(f"SELECT b.qid, a.id FROM stops a JOIN windows b ON {MEET}", "stops", "windows")
def range_points(stops, windows):
    return range_query.range_pairs(stops, windows)


@query("SELECT id, min_x, min_y, max_x, max_y FROM parcels WHERE max_x >= 100 AND min_x <= 300 AND max_y >= 100 AND min_y <= 300", "parcels")
def range_single(parcels):
    return range_query.range_single(parcels, (100, 100, 300, 300))


@query(f"SELECT b.qid, string_agg(a.id, ' ' ORDER BY a.id) AS ids FROM parcels a JOIN windows b ON {MEET} GROUP BY b.qid", "parcels", "windows")
def range_lists(parcels, windows):
    return range_query.range_lists(parcels, windows).select("qid", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(NEAREST.format(d=D2, boxes="parcels", points="probes", k=5), "parcels", "probes")
def knn_batch(parcels, probes):
    return knn.knn(parcels, probes, 5)


@query(NEAREST.format(d=D2, boxes="parcels", points="probes", k=5), "parcels", "probes")
def knn_indexed(parcels, probes):
    return knn.knn(parcels, probes, 5, strategy="indexed")


@query(NEAREST.format(d=D2, boxes="parcels", points="probes", k=1), "parcels", "probes")
def knn_k1(parcels, probes):
    return knn.knn(parcels, probes, 1)


@query(NEAREST.format(d=D2, boxes="regions", points="nations", k=10), "regions", "nations")
def knn_k_exceeds_n(regions, nations):
    return knn.knn(regions, nations, 10)


@query("SELECT id, d AS distance_sq, row_number() OVER (ORDER BY d, id) AS rank FROM (SELECT id, " + D2.replace("q.x", "500").replace("q.y", "400") + " AS d FROM parcels a) ORDER BY d, id LIMIT 5", "parcels")
def knn_single(parcels):
    return knn.knn_single(parcels, 500, 400, 5)


@query(NEAREST.format(d=D2.replace(", 0)", ", CAST(0 AS FLOAT))"), boxes="(SELECT id, x AS min_x, y AS min_y, x AS max_x, y AS max_y FROM vec2d)", points="(SELECT id AS qid, x, y FROM vec2d)", k=5), "vec2d")
def knn_float32(vec2d):
    points = vec2d.select("id", F.col("x").alias("min_x"), F.col("y").alias("min_y"), F.col("x").alias("max_x"), F.col("y").alias("max_y"))
    return knn.knn(points, vec2d.select(F.col("id").alias("qid"), "x", "y"), 5)


@query(JOINED, "parcels", "zones")
def join_pairs(parcels, zones):
    return join.join_pairs(parcels, zones)


@query(JOINED, "parcels", "zones")
def join_grid(parcels, zones):
    return join.join_pairs(parcels, zones, strategy="grid")


@query(f"SELECT a.id AS id_a, b.id AS id_b FROM zones a JOIN zones b ON {MEET}", "zones")
def join_self(zones):
    return join.self_join(zones)


@query(f"SELECT a.id AS id_a, b.id AS id_b FROM zones a JOIN zones b ON {MEET} AND a.id < b.id", "zones")
def join_self_distinct(zones):
    return join.self_join(zones, distinct_pairs=True)


@query(f"SELECT a.id AS id_a, count(*) AS n, string_agg(b.id, ' ' ORDER BY b.id) AS ids_b FROM parcels a JOIN zones b ON {MEET} GROUP BY a.id", "parcels", "zones")
def join_grouped(parcels, zones):
    return join.grouped(join.join_pairs(parcels, zones)).withColumn("ids_b", F.array_join(F.col("ids_b").cast("array<string>"), " "))


@query(f"SELECT id FROM parcels a WHERE EXISTS (SELECT 1 FROM zones b WHERE {MEET})", "parcels", "zones")
def join_semi(parcels, zones):
    return join.semi_join(parcels, zones).select("id")


@query(f"SELECT id FROM parcels a WHERE NOT EXISTS (SELECT 1 FROM zones b WHERE {MEET})", "parcels", "zones")
def join_anti(parcels, zones):
    return join.semi_join(parcels, zones, anti=True).select("id")


@query(JOINED + " AND (a.min_x = b.min_x OR a.max_x = b.max_x OR a.min_y = b.min_y OR a.max_y = b.max_y)", "parcels", "zones")
def join_edge_shared(parcels, zones):
    met = join.box_join(parcels, zones).where(g.edge_overlaps(g.box("a_"), g.box("b_")))
    return met.select(F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b"))


@query("SELECT a.id AS id_a, b.id AS id_b FROM parcels a JOIN (SELECT id + 1000000 AS id, min_x, min_y, max_x, max_y FROM parcels) b USING (min_x, min_y, max_x, max_y)", "parcels")
def join_equal_boxes(parcels):
    return join.equal_join(parcels, parcels.withColumn("id", F.col("id") + 1000000))


@query("SELECT b.qid, a.id, a.min_x AS x, a.min_y AS y FROM stops a JOIN windows b ON a.min_x > b.min_x AND a.min_x < b.max_x AND a.min_y > b.min_y AND a.min_y < b.max_y", "stops", "windows")
def points_strictly_inside(stops, windows):
    return range_query.points_inside(stops.select("id", F.col("min_x").alias("x"), F.col("min_y").alias("y")), windows)


@query("SELECT b.qid, count(*) AS n, min(a.min_x) AS first_x FROM stops a JOIN windows b ON a.min_x > b.min_x AND a.min_x < b.max_x AND a.min_y > b.min_y AND a.min_y < b.max_y GROUP BY b.qid", "stops", "windows")
def points_collected(stops, windows):
    lists = range_query.point_lists(stops.select("id", F.col("min_x").alias("x"), F.col("min_y").alias("y")), windows)
    return lists.select("qid", F.size("points").cast("bigint").alias("n"), F.col("points")[0]["x"].alias("first_x"))


@query("SELECT id, max_x - min_x AS width, max_y - min_y AS height, (max_x - min_x) * (max_y - min_y) AS area, CASE WHEN max_y <> min_y THEN (max_x - min_x) / (max_y - min_y) WHEN max_x > min_x THEN 'Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END AS aspect_ratio, (min_x + max_x) / 2 AS center_x, (min_y + max_y) / 2 AS center_y FROM parcels", "parcels")
def box_measures(parcels):
    b = g.box()
    return parcels.select("id", g.width(b).alias("width"), g.height(b).alias("height"), g.area(b).alias("area"), g.aspect_ratio(b).alias("aspect_ratio"), g.center(b).x.alias("center_x"), g.center(b).y.alias("center_y"))


@query("SELECT id, printf('(%.6f, %.6f, %.6f, %.6f)', min_x, min_y, max_x, max_y) AS text FROM parcels", "parcels")
def box_text(parcels):
    return parcels.select("id", g.box_text(g.box()).alias("text"))


@query("SELECT qid, printf('(%.6f,%.6f)', x, y) AS text FROM probes", "probes")
def point_text(probes):
    return probes.select("qid", g.point_text(g.point()).alias("text"))


@query(f"SELECT q.qid, a.id, {D2} AS distance_sq, sqrt({D2}) AS distance FROM parcels a JOIN probes q ON a.id = q.qid", "parcels", "probes")
def distance_sq(parcels, probes):
    met = parcels.join(probes, F.col("id") == F.col("qid"))
    return met.select("qid", "id", g.distance_sq(g.box(), g.point()).alias("distance_sq"), g.distance(g.box(), g.point()).alias("distance"))


@query("SELECT min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y, count(*) AS n FROM parcels", "parcels")
def extent(parcels):
    return aggregates.extent(parcels)


@query("SELECT id % 16 AS grp, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y, count(*) AS n FROM parcels GROUP BY ALL", "parcels")
def mbr_by_group(parcels):
    return aggregates.mbr(parcels, (F.col("id") % 16).alias("grp"))


@query(PAIRS, "parcels", "windows")
def index_range(parcels, windows):
    return layout.index_range(layout.build_index(parcels, 128), windows)


@query(NEAREST.format(d=D2, boxes="parcels", points="probes", k=5), "parcels", "probes")
def index_knn(parcels, probes):
    return knn.index_knn(layout.build_index(parcels, 128), probes, 5)


@query(JOINED, "parcels", "zones")
def index_join(parcels, zones):
    return layout.index_join(layout.build_index(parcels, 128), layout.build_index(zones, 512))


@query("SELECT count(*) AS rows FROM parcels", "parcels")
def index_row_conservation(parcels):
    return layout.build_index(parcels, 128).stats().select("rows")


@query(f"SELECT b.qid, a.id FROM parcels a JOIN windows b ON {MEET} WHERE a.id % 3 <> 0", "parcels", "windows")
def delete_by_id(parcels, windows):
    return range_query.range_pairs(aggregates.delete_by_id(parcels, parcels.where("id % 3 = 0")), windows)


@query(PAIRS, "parcels", "windows")
def sql_range(parcels, windows):
    register_sql(parcels.sparkSession)
    rows, asked = parcels.count(), windows.count()
    if not join.few(rows, asked):
        text = "SELECT b_qid AS qid, a_id AS id FROM {pairs} WHERE box_intersects(a_min_x, a_min_y, a_max_x, a_max_y, b_min_x, b_min_y, b_max_x, b_max_y)"
        return parcels.sparkSession.sql(text, pairs=join.cell_pairs(parcels, windows, most=float(rows) * asked))
    text = "SELECT /*+ BROADCAST(b) */ b.qid, a.id FROM {a} a JOIN {b} b ON box_intersects(a.min_x, a.min_y, a.max_x, a.max_y, b.min_x, b.min_y, b.max_x, b.max_y)"
    return parcels.sparkSession.sql(text, a=parcels, b=windows)


@query(f"SELECT q.qid, {D2} AS distance_sq FROM parcels a JOIN probes q ON a.id = q.qid", "parcels", "probes")
def sql_knn_distance(parcels, probes):
    register_sql(parcels.sparkSession)
    text = "SELECT q.qid, box_distance_sq(a.min_x, a.min_y, a.max_x, a.max_y, q.x, q.y) AS distance_sq FROM {a} a JOIN {q} q ON a.id = q.qid"
    return parcels.sparkSession.sql(text, a=parcels, q=probes)


FIXED = "min_x, min_y, max_x, max_y, 100D, 100D, 300D, 300D"
FIXED_SQL = {
    "meets": "max_x >= 100 AND min_x <= 300 AND max_y >= 100 AND min_y <= 300", "holds": "min_x <= 100 AND max_x >= 300 AND min_y <= 100 AND max_y >= 300",
    "same": "min_x = 100 AND max_x = 300 AND min_y = 100 AND max_y = 300", "edge": "min_x = 100 OR max_x = 300 OR min_y = 100 OR max_y = 300",
    "inside": "500 > min_x AND 500 < max_x AND 400 > min_y AND 400 < max_y", "away": "sqrt(" + D2.replace("a.", "").replace("q.x", "500").replace("q.y", "400") + ")",
    "wide": "max_x - min_x", "high": "max_y - min_y", "area": "(max_x - min_x) * (max_y - min_y)", "middle_x": "(min_x + max_x) / 2", "middle_y": "(min_y + max_y) / 2",
    "ratio": "CASE WHEN max_y <> min_y THEN (max_x - min_x) / (max_y - min_y) WHEN max_x > min_x THEN 'Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END",
    "text": "printf('(%.6f, %.6f, %.6f, %.6f)', min_x, min_y, max_x, max_y)", "corner": "printf('(%.6f,%.6f)', min_x, min_y)",
}


@query("SELECT id, " + ", ".join(f"{v} AS {k}" for k, v in FIXED_SQL.items()) + " FROM parcels", "parcels")
def sql_functions(parcels):
    register_sql(parcels.sparkSession)
    one, to = "min_x, min_y, max_x, max_y", "min_x, min_y, max_x, max_y, 500D, 400D"
    text = f"""SELECT id, box_intersects({FIXED}) AS meets, box_contains({FIXED}) AS holds, box_equals({FIXED}) AS same, box_edge_overlaps({FIXED}) AS edge,
        box_has_inside({to}) AS inside, box_distance({to}) AS away, box_width({one}) AS wide, box_height({one}) AS high, box_area({one}) AS area,
        box_center_x({one}) AS middle_x, box_center_y({one}) AS middle_y, box_aspect_ratio({one}) AS ratio, box_text({one}) AS text, point_text(min_x, min_y) AS corner FROM {{a}}"""
    return parcels.sparkSession.sql(text, a=parcels)


def as_file(rows: DataFrame, order: str) -> str:
    """The path of a text file with a line for each box, in the given order."""
    path = scratch_dir(rows.sparkSession)
    rows.orderBy(order).select(F.format_string("%s %s,%s %s", "min_x", "min_y", "max_x", "max_y")).write.text(path)
    return path


# Readers number the lines from 1.
LINES = "lines AS (SELECT row_number() OVER (ORDER BY id) AS id, min_x, min_y, max_x, max_y FROM parcels)"
ASKED = "asked AS (SELECT row_number() OVER (ORDER BY qid) AS qid, min_x, min_y, max_x, max_y FROM windows)"


@query("SELECT row_number() OVER (ORDER BY id) AS id, min_x, min_y, max_x, max_y FROM parcels", "parcels")
def read_boxes_file(parcels):
    return text.read_boxes(parcels.sparkSession, as_file(parcels, "id"))


@query("SELECT row_number() OVER (ORDER BY qid) AS qid, min_x, min_y, max_x, max_y FROM windows", "windows")
def read_windows_file(windows):
    return text.read_range_queries(windows.sparkSession, as_file(windows, "qid"))


@query("SELECT row_number() OVER (ORDER BY qid) AS qid, (min_x + max_x) / 2 AS x, (min_y + max_y) / 2 AS y FROM windows", "windows")
def read_points_file(windows):
    return text.read_knn_queries(windows.sparkSession, as_file(windows, "qid"))


def run_cli(spark: SparkSession, *args: str) -> DataFrame:
    out = scratch_dir(spark)
    cli.main(["--output", out, *args])
    return spark.read.parquet(out)


@query(f"SELECT b.qid, a.id FROM (WITH {LINES} SELECT * FROM lines) a JOIN (WITH {ASKED} SELECT * FROM asked) b ON {MEET}", "parcels", "windows")
def cli_range(parcels, windows):
    return run_cli(parcels.sparkSession, "range", as_file(parcels, "id"), as_file(windows, "qid"))


@query(NEAREST.format(d=D2, boxes=f"(WITH {LINES} SELECT * FROM lines)", points=f"(WITH {ASKED} SELECT qid, (min_x + max_x) / 2 AS x, (min_y + max_y) / 2 AS y FROM asked)", k=3), "parcels", "windows")
def cli_knn(parcels, windows):
    return run_cli(parcels.sparkSession, "knn", "-k", "3", as_file(parcels, "id"), as_file(windows, "qid"))


@query(f"SELECT a.id AS id_a, b.qid AS id_b FROM (WITH {LINES} SELECT * FROM lines) a JOIN (WITH {ASKED} SELECT * FROM asked) b ON {MEET}", "parcels", "windows")
def cli_join(parcels, windows):
    return run_cli(parcels.sparkSession, "join", as_file(parcels, "id"), as_file(windows, "qid"))
