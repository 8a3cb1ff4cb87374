"""Speaker vectors, thresholds, quality and affinity graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.operators import clusters, spectral
from palaver.queries import tables
from palaver.queries.registry import query

SQL = tables.SQL
SQL["t_unit"] = """
SELECT meeting_id, sub_idx, label, list_transform(embedding, lambda x: x / n) AS v FROM (
  SELECT *, sqrt(list_dot_product(embedding, embedding)) AS n FROM t_sub)"""


def sql_means(source: str, by: str, vec: str = "v") -> str:
    return f"""SELECT {by}, list(x ORDER BY d) AS mean, any_value(n) AS n FROM (
      SELECT {by}, d, avg({vec}[d]) AS x, count(*) AS n FROM (SELECT *, unnest(range(1, len({vec}) + 1)) AS d FROM {source}) GROUP BY {by}, d) GROUP BY {by}"""


SQL["t_means"] = sql_means("t_unit", "meeting_id, label")
SQL["t_cents"] = """
SELECT meeting_id, label, n, list_transform(mean, lambda x: x / (s + 1e-9)) AS centroid FROM (
  SELECT *, sqrt(list_dot_product(mean, mean)) AS s FROM t_means)"""
SQL["t_pairs"] = """
SELECT a.meeting_id, a.sub_idx AS i, b.sub_idx AS j, list_dot_product(a.v, b.v) AS sim, a.label = b.label AS same
FROM t_unit a JOIN t_unit b ON a.meeting_id = b.meeting_id AND a.sub_idx < b.sub_idx"""
SQL["t_aff"] = """
SELECT meeting_id, i, j, greatest((sim + 1) / 2, 0) AS v FROM t_pairs
UNION ALL SELECT meeting_id, j, i, greatest((sim + 1) / 2, 0) FROM t_pairs
UNION ALL SELECT meeting_id, sub_idx, sub_idx, 1.0e0 FROM t_unit"""


def sub(spark, sf):
    return tables.subsegments(spark, sf)


def edges(spark, sf):
    return clusters.affinity_edges(sub(spark, sf))


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("embedding_stats", "SELECT meeting_id, count(embedding) AS n_vectors, max(len(embedding)) AS dim FROM t_sub GROUP BY 1")
def embedding_stats(spark, sf):
    return clusters.embedding_stats(sub(spark, sf))


@query("speaker_count", "SELECT meeting_id, count(DISTINCT label) AS n_speakers FROM t_sub GROUP BY 1")
def speaker_count(spark, sf):
    return clusters.speaker_count(sub(spark, sf))


@query(
    "centroids",
    "SELECT meeting_id, label, n, pos - 1 AS dim, round(centroid[pos], 6) AS x FROM (SELECT *, unnest(range(1, len(centroid) + 1)) AS pos FROM t_cents)",
)
def centroids(spark, sf):
    c = clusters.centroids(sub(spark, sf))
    return rounded(c.select("meeting_id", "label", "n", F.posexplode("centroid").alias("dim", "x")), "x")


SQL["t_near"] = """
SELECT meeting_id, sub_idx, label, sim FROM (
  SELECT u.meeting_id, u.sub_idx, c.label, list_dot_product(u.embedding, c.centroid) AS sim,
    row_number() OVER (PARTITION BY u.meeting_id, u.sub_idx ORDER BY list_dot_product(u.embedding, c.centroid) DESC, c.label) AS rn
  FROM t_sub u JOIN t_cents c ON c.meeting_id = u.meeting_id) WHERE rn = 1"""


@query("nearest_centroid", "SELECT meeting_id, sub_idx, label, round(sim, 6) AS sim FROM t_near")
def nearest_centroid(spark, sf):
    out = clusters.nearest_centroid(sub(spark, sf), clusters.centroids(sub(spark, sf)))
    return rounded(out.select("meeting_id", "sub_idx", "label", "sim"), "sim")


@query(
    "relabel_contiguous",
    "SELECT meeting_id, sub_idx, dense_rank() OVER (PARTITION BY meeting_id ORDER BY label * 3) - 1 AS label FROM t_sub",
)
def relabel_contiguous(spark, sf):
    s = sub(spark, sf).withColumn("label", F.col("label") * 3).select("meeting_id", "sub_idx", "label")
    return clusters.relabel_contiguous(s)


@query(
    "merge_small_clusters",
    f"""WITH m AS ({sql_means('t_sub', 'meeting_id, label', 'embedding')}),
      c AS (SELECT meeting_id, label, n, list_transform(mean, lambda x: x / (sqrt(list_dot_product(mean, mean)) + 1e-10)) AS centroid FROM m WHERE n >= 5),
      s AS (SELECT t.*, m.n FROM t_sub t JOIN m ON m.meeting_id = t.meeting_id AND m.label = t.label),
      g AS (SELECT s.meeting_id, s.sub_idx, c.label, row_number() OVER (PARTITION BY s.meeting_id, s.sub_idx ORDER BY list_dot_product(s.embedding, c.centroid) DESC, c.label) AS rn
            FROM s JOIN c ON c.meeting_id = s.meeting_id WHERE s.n < 5),
      u AS (SELECT meeting_id, sub_idx, label FROM g WHERE rn = 1
            UNION ALL SELECT meeting_id, sub_idx, label FROM s WHERE n >= 5 OR meeting_id NOT IN (SELECT meeting_id FROM c))
      SELECT meeting_id, sub_idx, dense_rank() OVER (PARTITION BY meeting_id ORDER BY label) - 1 AS label FROM u""",
)
def merge_small_clusters(spark, sf):
    return clusters.merge_small_clusters(sub(spark, sf), 5)


@query("merge_close_centroids")
def merge_close_centroids(spark, sf):
    return clusters.merge_close_centroids(sub(spark, sf), 0.8).select("meeting_id", "sub_idx", "label")


@query("pairwise_similarity", "SELECT meeting_id, i, j, round(sim, 6) AS sim, same FROM t_pairs")
def pairwise_similarity(spark, sf):
    return rounded(clusters.pairwise(sub(spark, sf)), "sim")


@query(
    "pair_percentile_threshold",
    "SELECT meeting_id, count(*) AS n, round(quantile_cont(1 - sim, 0.3), 6) AS pct FROM t_pairs GROUP BY 1",
)
def pair_percentile_threshold(spark, sf):
    return rounded(clusters.pair_percentile(sub(spark, sf), 0.3), "pct")


@query(
    "calibrate_threshold",
    """SELECT n.meeting_id, round(CASE WHEN n >= 4 AND lo IS NOT NULL AND hi IS NOT NULL THEN greatest(0.3e0, least(0.85e0, (lo + hi) / 2)) ELSE 0.6e0 END, 6) AS threshold
       FROM (SELECT meeting_id, count(*) AS n FROM t_sub GROUP BY 1) n LEFT JOIN (
         SELECT meeting_id, quantile_cont(sim, 0.1) FILTER (WHERE same) AS lo, quantile_cont(sim, 0.9) FILTER (WHERE NOT same) AS hi FROM t_pairs GROUP BY 1) q
       ON q.meeting_id = n.meeting_id""",
)
def calibrate_threshold(spark, sf):
    return rounded(clusters.calibrate_threshold(sub(spark, sf)), "threshold")


@query(
    "single_speaker_test",
    "SELECT meeting_id, round(median(sim), 6) AS median_sim, median(sim) >= 0.75 AS single FROM t_pairs GROUP BY 1",
)
def single_speaker_test(spark, sf):
    return rounded(clusters.single_speaker(sub(spark, sf)), "median_sim")


@query(
    "silhouette",
    """WITH d AS (SELECT meeting_id, i, j, (1 - sim) / 2 AS d FROM t_pairs UNION ALL SELECT meeting_id, j, i, (1 - sim) / 2 FROM t_pairs),
       l AS (SELECT d.meeting_id, d.i, a.label AS li, b.label AS lj, d FROM d JOIN t_sub a ON a.meeting_id = d.meeting_id AND a.sub_idx = d.i
             JOIN t_sub b ON b.meeting_id = d.meeting_id AND b.sub_idx = d.j),
       m AS (SELECT meeting_id, i, li, lj, avg(d) AS d FROM l GROUP BY 1, 2, 3, 4),
       s AS (SELECT meeting_id, i, min(d) FILTER (WHERE li = lj) AS a, min(d) FILTER (WHERE li <> lj) AS b FROM m GROUP BY 1, 2)
       SELECT meeting_id, round(avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6) AS silhouette FROM s GROUP BY 1""",
)
def silhouette(spark, sf):
    return rounded(clusters.silhouette(sub(spark, sf)), "silhouette")


@query("silhouette_refine")
def silhouette_refine(spark, sf):
    return clusters.silhouette_refine(sub(spark, sf))


SQL["t_knn"] = """
SELECT meeting_id, j AS i, i AS j, 1.0e0 AS v FROM (SELECT *, rank() OVER (PARTITION BY meeting_id, i ORDER BY v DESC) AS r FROM t_aff) WHERE r <= 6"""
SQL["t_sym"] = """
SELECT meeting_id, i, j, sum(v) / 2 AS v FROM (SELECT * FROM t_knn UNION ALL SELECT meeting_id, j, i, v FROM t_knn) GROUP BY 1, 2, 3"""


def knn(spark, sf):
    return clusters.knn_graph(sub(spark, sf), 6)


@query("knn_graph", "SELECT * FROM t_knn")
def knn_graph(spark, sf):
    return knn(spark, sf)


@query("symmetrize_mean", "SELECT * FROM t_sym")
def symmetrize_mean(spark, sf):
    return clusters.symmetrize_mean(knn(spark, sf))


@query("graph_degree", "SELECT meeting_id, i, sum(abs(v)) AS degree FROM t_sym WHERE i <> j GROUP BY 1, 2")
def graph_degree(spark, sf):
    return clusters.degree(clusters.symmetrize_mean(knn(spark, sf)))


@query(
    "affinity_degree",
    """SELECT meeting_id, i AS sub_idx, round(sum(sim), 6) AS degree FROM (
         SELECT meeting_id, i, sim FROM t_pairs UNION ALL SELECT meeting_id, j, sim FROM t_pairs) GROUP BY 1, 2""",
)
def affinity_degree(spark, sf):
    return rounded(clusters.affinity_degree(sub(spark, sf)), "degree")


@query(
    "graph_connected",
    """WITH RECURSIVE r AS (SELECT meeting_id, min(i) AS node FROM t_aff GROUP BY 1
         UNION SELECT r.meeting_id, e.j FROM r JOIN (SELECT * FROM t_sym WHERE v > 0) e ON e.meeting_id = r.meeting_id AND e.i = r.node)
       SELECT r.meeting_id, count(*) = any_value(n) AS connected FROM r JOIN (SELECT meeting_id, count(*) AS n FROM t_unit GROUP BY 1) t ON t.meeting_id = r.meeting_id GROUP BY 1""",
)
def graph_connected(spark, sf):
    return clusters.connected(clusters.symmetrize_mean(knn(spark, sf)))


@query(
    "aff_diag_fill",
    """SELECT meeting_id, i, j, round(CASE WHEN i = j THEN greatest(max(v) FILTER (WHERE i <> j) OVER (PARTITION BY meeting_id, i), 0) ELSE v END, 6) AS v FROM t_aff""",
)
def aff_diag_fill(spark, sf):
    return rounded(clusters.diag_fill(edges(spark, sf)), "v")


W1 = "exp(-0.5e0 * k * k)"
SQL["t_blur"] = f"""
WITH o AS (SELECT unnest(range(-4, 5)) AS k), n AS (SELECT meeting_id, count(*) AS n FROM t_unit GROUP BY 1),
h AS (SELECT a.meeting_id, a.i, t.j, sum(t.w * a.v) AS v FROM t_aff a JOIN (
   SELECT meeting_id, sub_idx AS j, least(x, 2 * n - 1 - x) AS src, w FROM (
     SELECT u.meeting_id, u.sub_idx, n.n, ((u.sub_idx + k) % (2 * n.n) + 2 * n.n) % (2 * n.n) AS x, {W1} / (SELECT sum({W1}) FROM o) AS w
     FROM t_unit u JOIN n ON n.meeting_id = u.meeting_id, o)) t ON t.meeting_id = a.meeting_id AND t.src = a.j GROUP BY 1, 2, 3)
SELECT h.meeting_id, t.i, h.j, sum(t.w * h.v) AS v FROM h JOIN (
   SELECT meeting_id, sub_idx AS i, least(x, 2 * n - 1 - x) AS src, w FROM (
     SELECT u.meeting_id, u.sub_idx, n.n, ((u.sub_idx + k) % (2 * n.n) + 2 * n.n) % (2 * n.n) AS x, {W1} / (SELECT sum({W1}) FROM o) AS w
     FROM t_unit u JOIN n ON n.meeting_id = u.meeting_id, o)) t ON t.meeting_id = h.meeting_id AND t.src = h.i GROUP BY 1, 2, 3"""


@query("aff_blur", "SELECT meeting_id, i, j, round(v, 6) AS v FROM t_blur")
def aff_blur(spark, sf):
    return rounded(clusters.blur(edges(spark, sf)), "v")


SQL["t_rowthr"] = """
SELECT meeting_id, i, j, CASE WHEN v < p THEN v * 0.01e0 ELSE v END AS v FROM (
  SELECT *, quantile_cont(v, 0.95) OVER (PARTITION BY meeting_id, i) AS p FROM t_aff)"""


@query("aff_row_threshold", "SELECT meeting_id, i, j, round(v, 6) AS v FROM t_rowthr")
def aff_row_threshold(spark, sf):
    return rounded(clusters.row_threshold(edges(spark, sf)), "v")


@query(
    "aff_symmetrize_max",
    "SELECT meeting_id, i, j, round(max(v), 6) AS v FROM (SELECT * FROM t_rowthr UNION ALL SELECT meeting_id, j, i, v FROM t_rowthr) GROUP BY 1, 2, 3",
)
def aff_symmetrize_max(spark, sf):
    return rounded(clusters.symmetrize_max(clusters.row_threshold(edges(spark, sf))), "v")


@query(
    "aff_diffuse",
    "SELECT a.meeting_id, a.i, b.i AS j, round(sum(a.v * b.v), 6) AS v FROM t_rowthr a JOIN t_rowthr b ON a.meeting_id = b.meeting_id AND a.j = b.j GROUP BY 1, 2, 3",
)
def aff_diffuse(spark, sf):
    return rounded(clusters.diffuse(clusters.row_threshold(edges(spark, sf))), "v")


@query(
    "aff_row_max_norm",
    """SELECT meeting_id, i, j, round(v / CASE WHEN m = 0 THEN 1 ELSE m END, 6) AS v FROM (
         SELECT meeting_id, i, j, v - 0.5e0 AS v, max(v - 0.5e0) OVER (PARTITION BY meeting_id, i) AS m FROM t_aff)""",
)
def aff_row_max_norm(spark, sf):
    return rounded(clusters.row_max_norm(edges(spark, sf).withColumn("v", F.col("v") - 0.5)), "v")


@query("aff_enhance")
def aff_enhance(spark, sf):
    return clusters.enhance(edges(spark, sf))


@query(
    "bootstrap_assign",
    f"""WITH b AS (SELECT * FROM t_unit WHERE sub_idx < 20), m AS ({sql_means('b', 'meeting_id, label')}),
       c AS (SELECT meeting_id, label, list_transform(mean, lambda x: x / (sqrt(list_dot_product(mean, mean)) + 1e-9)) AS centroid FROM m),
       g AS (SELECT u.meeting_id, u.sub_idx, c.label, row_number() OVER (PARTITION BY u.meeting_id, u.sub_idx ORDER BY list_dot_product(u.v, c.centroid) DESC, c.label) AS rn
             FROM t_unit u JOIN c ON c.meeting_id = u.meeting_id WHERE u.sub_idx >= 20)
       SELECT meeting_id, sub_idx, label FROM b UNION ALL SELECT meeting_id, sub_idx, label FROM g WHERE rn = 1""",
)
def bootstrap_assign(spark, sf):
    return clusters.bootstrap_assign(sub(spark, sf), 20)


@query("cosine_greedy")
def cosine_greedy(spark, sf):
    return clusters.cosine_greedy(sub(spark, sf), 0.3)


@query("bootstrap_online")
def bootstrap_online(spark, sf):
    return clusters.bootstrap_online(sub(spark, sf), 20)


@query("cluster_count_bic")
def cluster_count_bic(spark, sf):
    s = sub(spark, sf)
    return spectral.cluster_count_bic(s, clusters.single_speaker(s))


@query("cluster_affinity")
def cluster_affinity(spark, sf):
    return spectral.cluster_affinity(sub(spark, sf), 4)
