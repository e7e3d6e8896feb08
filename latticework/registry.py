"""The registered queries: each operator on the sample tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.similarity import pair_similarity
from latticework.matrix import SparseMatrix
from latticework.operators import preprocess, stats
from latticework.plans import pca
from latticework.plans.tsne import tsne
from latticework.sources.tables import doc_term, embedding_matrix, event_stream, order_part, part_supp, read, user_event, vectors
from latticework.streaming.chunks import ChunkStats, run_stream, stream_stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# --- SQL of the matrix ----------------------------------------------------------------------------

COO = "coo AS (SELECT l_partkey AS row_id, l_suppkey AS col_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"
ROWS = "r AS (SELECT p_partkey AS row_id FROM part)"
COLS = "c AS (SELECT s_suppkey AS col_id FROM supplier)"
ROW_KEEP = "SELECT p_partkey FROM part WHERE p_size > 25"
COL_KEEP = "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0"
KSQ = "count(*) AS k, sum(value) AS s, sum(value * value) AS q, min(value) AS mn, max(value) AS mx"


def axis_sql(key: str, select: str, where: str = "") -> str:
    """``select`` over the moments k, s, q, mn, mx of each member of an axis, empty ones included."""
    dim = "r" if key == "row_id" else "c"
    return f"""WITH {COO}, {ROWS}, {COLS},
a AS (SELECT {key}, {KSQ} FROM coo {where} GROUP BY {key}),
d AS (SELECT {dim}.{key}, coalesce(k, 0) AS k, coalesce(s, 0) AS s, coalesce(q, 0) AS q, mn, mx FROM {dim} LEFT JOIN a ON {dim}.{key} = a.{key})
SELECT {key}, {select} FROM d"""


K, S, Q = "CAST(k AS BIGINT) AS nonzero", "s AS sum", "q AS sum_squared"
V1_COL = "round(greatest((q - s * s / (SELECT count(*) FROM r)) / ((SELECT count(*) FROM r) - 1), 0), 6) AS variance"
V1_ROW = V1_COL.replace("FROM r", "FROM c")
V2 = "round(CASE WHEN k > 0 THEN greatest((q - s * s / k) / k, 0) ELSE 0 END, 6) AS variance"
V3 = "round(CASE WHEN k > 1 THEN greatest((q - s * s / k) / (k - 1), 0) ELSE 0 END, 6) AS variance"
MM = "mn AS min_value, mx AS max_value"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def row_mask(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("axis_id"), (F.col("p_size") > 25).alias("keep"))


def col_mask(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("axis_id"), (F.col("s_suppkey") % 3 != 0).alias("keep"))


def row_labels(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("axis_id"), F.col("p_brand").alias("batch"))


def col_labels(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("axis_id"), F.col("s_nationkey").alias("batch"))


def chunked(spark: SparkSession, d: str, axis: str) -> ChunkStats:
    """The matrix in three chunks of rows."""
    m = part_supp(spark, d)
    return ChunkStats(m, axis, [m.entries.filter(F.pmod("row_id", F.lit(3)) == i) for i in range(3)])


# --- counts, sums, variances, extremes ------------------------------------------------------------

for _axis, _short, _key, _keep, _v1 in (("column", "col", "col_id", f"WHERE row_id IN ({ROW_KEEP})", V1_COL), ("row", "row", "row_id", f"WHERE col_id IN ({COL_KEEP})", V1_ROW)):
    _mask = row_mask if _axis == "column" else col_mask
    query(f"nonzero_{_short}", axis_sql(_key, K))(lambda s, d, a=_axis: stats.nonzero(part_supp(s, d), a))
    query(f"nonzero_{_short}_masked", axis_sql(_key, K, _keep))(lambda s, d, a=_axis, k=_mask: stats.nonzero(part_supp(s, d), a, k(s, d)))
    query(f"nonzero_{_short}_chunk", axis_sql(_key, K))(lambda s, d, a=_axis: chunked(s, d, a).nonzero())
    query(f"sum_{_short}", axis_sql(_key, S))(lambda s, d, a=_axis: stats.total(part_supp(s, d), a))
    query(f"sum_{_short}_masked", axis_sql(_key, S, _keep))(lambda s, d, a=_axis, k=_mask: stats.total(part_supp(s, d), a, k(s, d)))
    query(f"sum_{_short}_chunk", axis_sql(_key, S))(lambda s, d, a=_axis: chunked(s, d, a).total())
    query(f"sum_{_short}_squared", axis_sql(_key, Q))(lambda s, d, a=_axis: stats.total_squared(part_supp(s, d), a))
    query(f"var_{_short}", axis_sql(_key, _v1))(lambda s, d, a=_axis: rounded(stats.variance(part_supp(s, d), a), "variance"))
    query(f"var_{_short}_masked", axis_sql(_key, V2, _keep))(lambda s, d, a=_axis, k=_mask: rounded(stats.variance_masked(part_supp(s, d), a, k(s, d)), "variance"))
    query(f"var_{_short}_chunk", axis_sql(_key, V2))(lambda s, d, a=_axis: rounded(chunked(s, d, a).variance(), "variance"))
    query(f"min_max_{_short}", axis_sql(_key, MM))(lambda s, d, a=_axis: stats.min_max(part_supp(s, d), a))
    query(f"min_max_{_short}_chunk", axis_sql(_key, MM))(lambda s, d, a=_axis: chunked(s, d, a).min_max())


@query("nonzero_row_empty", """
WITH coo AS (SELECT DISTINCT l_orderkey AS row_id, l_partkey AS col_id FROM lineitem), a AS (SELECT row_id, count(*) AS k FROM coo GROUP BY row_id)
SELECT o_orderkey AS row_id, CAST(coalesce(k, 0) AS BIGINT) AS nonzero FROM orders LEFT JOIN a ON o_orderkey = row_id""")
def nonzero_row_empty(spark: SparkSession, d: str) -> DataFrame:
    """Orders by part: a matrix with empty rows."""
    return stats.nonzero(order_part(spark, d), "row")


# --- batches and largest entries ------------------------------------------------------------------

_ROW_BATCH = f"""WITH {COO}, {ROWS}, {COLS}, l AS (SELECT p_partkey AS row_id, p_brand AS batch FROM part),
b AS (SELECT batch, count(*) AS members FROM l GROUP BY batch),
a AS (SELECT batch, col_id, {KSQ} FROM coo JOIN l USING (row_id) GROUP BY batch, col_id),
d AS (SELECT b.batch, members, c.col_id, coalesce(k, 0) AS k, coalesce(s, 0) AS s, coalesce(q, 0) AS q FROM b CROSS JOIN c LEFT JOIN a ON a.batch = b.batch AND a.col_id = c.col_id)
SELECT batch, col_id, """
_COL_BATCH = f"""WITH {COO}, {ROWS}, {COLS}, l AS (SELECT s_suppkey AS col_id, s_nationkey AS batch FROM supplier),
b AS (SELECT batch, count(*) AS members FROM l GROUP BY batch),
a AS (SELECT batch, row_id, {KSQ} FROM coo JOIN l USING (col_id) GROUP BY batch, row_id),
d AS (SELECT b.batch, members, r.row_id, coalesce(k, 0) AS k, coalesce(s, 0) AS s, coalesce(q, 0) AS q FROM b CROSS JOIN r LEFT JOIN a ON a.batch = b.batch AND a.row_id = r.row_id)
SELECT batch, row_id, """
_MEAN_ALL = "round(s / members, 6) AS mean FROM d"
_MEAN_STORED = "round(CASE WHEN k > 0 THEN s / k ELSE 0 END, 6) AS mean FROM d"


@query("var_batch_row", f"{_ROW_BATCH}{V3} FROM d")
def var_batch_row(spark, d):
    return rounded(stats.var_batch_row(part_supp(spark, d), row_labels(spark, d)), "variance")


@query("var_batch_col", f"{_COL_BATCH}{V3} FROM d")
def var_batch_col(spark, d):
    return rounded(stats.var_batch_col(part_supp(spark, d), col_labels(spark, d)), "variance")


@query("mean_batch_row", _COL_BATCH + _MEAN_ALL)
def mean_batch_row(spark, d):
    return rounded(stats.mean_batch_row(part_supp(spark, d), col_labels(spark, d)), "mean")


@query("mean_batch_col", _ROW_BATCH + _MEAN_ALL)
def mean_batch_col(spark, d):
    return rounded(stats.mean_batch_col(part_supp(spark, d), row_labels(spark, d)), "mean")


@query("mean_batch_row_stored", _COL_BATCH + _MEAN_STORED)
def mean_batch_row_stored(spark, d):
    return rounded(stats.mean_batch_row(part_supp(spark, d), col_labels(spark, d), denominator="stored"), "mean")


@query("mean_batch_col_stored", _ROW_BATCH + _MEAN_STORED)
def mean_batch_col_stored(spark, d):
    return rounded(stats.mean_batch_col(part_supp(spark, d), row_labels(spark, d), denominator="stored"), "mean")


@query("sum_row_n_top", f"""WITH {COO}, {ROWS}, t AS (SELECT row_id, value, row_number() OVER (PARTITION BY row_id ORDER BY value DESC) AS n FROM coo),
a AS (SELECT row_id, sum(value) AS s FROM t WHERE n <= 3 GROUP BY row_id)
SELECT r.row_id, coalesce(s, 0) AS top_sum FROM r LEFT JOIN a ON r.row_id = a.row_id""")
def sum_row_n_top(spark, d):
    return stats.sum_row_n_top(part_supp(spark, d), 3)


# --- preprocessing --------------------------------------------------------------------------------

def _normalized(key: str) -> str:
    return f"n AS (SELECT row_id, col_id, CASE WHEN t > 0 THEN value * (10000.0 / t) ELSE value END AS value FROM (SELECT *, sum(value) OVER (PARTITION BY {key}) AS t FROM coo))"


@query("normalize_row", f"WITH {COO}, {_normalized('row_id')} SELECT row_id, col_id, round(value, 6) AS value FROM n")
def normalize_row(spark, d):
    return rounded(preprocess.normalize(part_supp(spark, d), None, 1e4, "row").entries, "value")


@query("normalize_col", f"WITH {COO}, {_normalized('col_id')} SELECT row_id, col_id, round(value, 6) AS value FROM n")
def normalize_col(spark, d):
    return rounded(preprocess.normalize(part_supp(spark, d), None, 1e4, "column").entries, "value")


@query("log1p_normalize", f"WITH {COO} SELECT row_id, col_id, round(ln(1 + value), 6) AS value FROM coo")
def log1p_normalize(spark, d):
    return rounded(preprocess.log1p_normalize(part_supp(spark, d)).entries, "value")


@query("preprocess_pipeline", f"WITH {COO}, {_normalized('row_id')} SELECT row_id, col_id, round(ln(1 + value), 6) AS value FROM n")
def preprocess_pipeline(spark, d):
    m = preprocess.normalize(part_supp(spark, d), None, 1e4, "row")
    return rounded(preprocess.log1p_normalize(m).entries, "value")


_CELLS = "v AS (SELECT vec_id AS id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings)"


def _dense(df: DataFrame) -> DataFrame:
    return df.select("id", F.posexplode("features").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 4).alias("value"))


def _positive(spark, d):
    """Embeddings moved above zero, so that sums are far from it."""
    return vectors(spark, d).select("id", F.transform("features", lambda x: x + 1.0).alias("features"))


@query("normalize_dense_row", f"WITH {_CELLS} SELECT id, pos, round((x + 1) * (100.0 / sum(x + 1) OVER (PARTITION BY id)), 4) AS value FROM v")
def normalize_dense_row(spark, d):
    return _dense(preprocess.normalize_dense(_positive(spark, d), None, 100.0, "row", id_col="id"))


@query("normalize_dense_col", f"WITH {_CELLS} SELECT id, pos, round((x + 1) * (100.0 / sum(x + 1) OVER (PARTITION BY pos)), 4) AS value FROM v")
def normalize_dense_col(spark, d):
    return _dense(preprocess.normalize_dense(_positive(spark, d), None, 100.0, "column", id_col="id"))


# --- similarity -----------------------------------------------------------------------------------

_SUMS = f"""WITH {_CELLS}, p AS (SELECT a.id AS id_a, b.id AS id_b, a.x AS x, b.x AS y FROM v a JOIN v b ON b.id = a.id + 1 AND b.pos = a.pos),
g AS (SELECT id_a, id_b, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy, sum((x - y) * (x - y)) AS d2, sum(abs(x - y)) AS d1,
  sum(CASE WHEN abs(x - y) < 0.05 THEN 1 ELSE 0 END) AS i, sum(CASE WHEN x > 0 OR y > 0 THEN 1 ELSE 0 END) AS u FROM p GROUP BY id_a, id_b)
SELECT id_a, id_b, round({{}}, 6) AS similarity FROM g"""


def _similar(measure: str, **params: float) -> Query:
    """Each vector against the next one by id."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        v = vectors(spark, d)
        pairs = v.select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"))
        return rounded(pair_similarity(v, pairs, measure, **params), "similarity")

    return run


query("sim_cosine", _SUMS.format("CASE WHEN sqrt(xx * yy) > 2.220446049250313e-16 THEN xy / sqrt(xx * yy) ELSE 0 END"))(_similar("cosine"))
query("sim_euclidean", _SUMS.format("exp(-sqrt(d2))"))(_similar("euclidean"))
query("sim_manhattan", _SUMS.format("exp(-d1)"))(_similar("manhattan"))
query("sim_pearson", _SUMS.format("(xy - sx * sy / n) / sqrt((xx - sx * sx / n) * (yy - sy * sy / n))"))(_similar("pearson"))
query("sim_jaccard", _SUMS.format("CASE WHEN u > 0 THEN i / u ELSE 0 END"))(_similar("jaccard", threshold=0.05))


# --- principal components -------------------------------------------------------------------------

_GRAM = f"WITH {COO}, {ROWS}, {COLS}, g AS (SELECT a.col_id AS i, b.col_id AS j, sum(a.value * b.value) AS value FROM coo a JOIN coo b ON a.row_id = b.row_id AND a.col_id <= b.col_id GROUP BY ALL)"
_N = "(SELECT count(*) FROM r)"


@query("pca_mean", axis_sql("col_id", f"round(s / {_N}, 6) AS mean"))
def pca_mean(spark, d):
    m = part_supp(spark, d)
    return stats.axis_stats(m, "column").select("col_id", F.round(F.col("s") / float(m.nrows), 6).alias("mean"))


@query("pca_total_variance", axis_sql("col_id", "").split("SELECT col_id,  FROM d")[0] + f"SELECT round(sum((q - s * s / {_N}) / ({_N} - 1)), 4) AS total_variance FROM d")
def pca_total_variance(spark, d):
    return stats.variance(part_supp(spark, d), "column").agg(F.round(F.sum("variance"), 4).alias("total_variance"))


@query("pca_gram", f"{_GRAM} SELECT i, j, value FROM g")
def pca_gram(spark, d):
    return pca.gram_entries(part_supp(spark, d))


@query("pca_covariance", f"""{_GRAM}, s AS (SELECT c.col_id, coalesce(sum(value), 0) AS s FROM c LEFT JOIN coo ON c.col_id = coo.col_id GROUP BY c.col_id)
SELECT a.col_id AS i, b.col_id AS j, round((coalesce(g.value, 0) - a.s * b.s / {_N}) / ({_N} - 1), 6) AS value
FROM s a JOIN s b ON a.col_id <= b.col_id LEFT JOIN g ON g.i = a.col_id AND g.j = b.col_id""")
def pca_covariance(spark, d):
    return rounded(pca.covariance(part_supp(spark, d)), "value")


@query("pca_transform_fixed", f"""WITH {COO}, {ROWS}, {COLS}, k AS (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS component),
l AS (SELECT component, col_id, sin(CAST(col_id * component AS DOUBLE)) AS loading FROM k CROSS JOIN c),
o AS (SELECT component, sum(s * loading) / {_N} AS o FROM l JOIN (SELECT col_id, sum(value) AS s FROM coo GROUP BY col_id) USING (col_id) GROUP BY component),
x AS (SELECT row_id, component, sum(value * loading) AS raw FROM coo JOIN l USING (col_id) GROUP BY ALL)
SELECT r.row_id, k.component, round(coalesce(raw, 0) - o, 6) AS score FROM r CROSS JOIN k JOIN o ON o.component = k.component LEFT JOIN x ON x.row_id = r.row_id AND x.component = k.component""")
def pca_transform_fixed(spark, d):
    """Centred projection on loadings that are known beforehand."""
    m = part_supp(spark, d)
    names = spark.range(1, 4).select(F.col("id").cast("int").alias("component"))
    loadings = m.cols.crossJoin(F.broadcast(names)).select("component", "col_id", F.sin((F.col("col_id") * F.col("component")).cast("double")).alias("loading"))
    means = stats.axis_stats(m, "column").select("col_id", (F.col("s") / float(m.nrows)).alias("mean"))
    offsets = loadings.join(means, "col_id").groupBy("component").agg(F.sum(F.col("mean") * F.col("loading")).alias("offset"))
    return rounded(pca.project(m, loadings, offsets), "score")


_WIDE = 16
_REBUILT = f"""WITH {_CELLS} SELECT a.pos AS i, b.pos AS j, round(covar_samp(a.x, b.x), 6) + 0.0 AS value
FROM v a JOIN v b ON a.id = b.id AND a.pos <= b.pos WHERE b.pos < {_WIDE} GROUP BY a.pos, b.pos"""


def _first_columns(m: SparseMatrix, n: int) -> DataFrame:
    return m.cols.select(F.col("col_id").alias("axis_id"), (F.col("col_id") < n).alias("keep"))


def _rebuilt(spark: SparkSession, d: str, method) -> DataFrame:
    """All components of the first columns put together again, each by its variance: the covariance, if every
    loading and every variance is right."""
    m = embedding_matrix(spark, d)
    model = pca.MaskedSparsePCA(_first_columns(m, _WIDE), n_components=_WIDE, svd_method=method).fit(m)
    loadings = model.components.join(model.explained_variance(), "component")
    left = loadings.select("component", F.col("col_id").alias("i"), (F.col("loading") * F.col("explained_variance")).alias("x"))
    right = loadings.select("component", F.col("col_id").alias("j"), F.col("loading").alias("y"))
    pairs = left.join(right, "component").filter("i <= j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))
    return pairs.select("i", "j", (F.round("value", 6) + 0.0).alias("value"))


@query("pca_lanczos_components", _REBUILT)
def pca_lanczos_components(spark, d):
    return _rebuilt(spark, d, "lanczos")


@query("pca_random_components", _REBUILT)
def pca_random_components(spark, d):
    return _rebuilt(spark, d, pca.RandomSVD())


# two columns have a closed form, which SQL can state
_PLANE = """WITH x AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1 FROM embeddings),
c AS (SELECT var_samp(x0) AS a, covar_samp(x0, x1) AS b, var_samp(x1) AS c, avg(x0) AS m0, avg(x1) AS m1 FROM x),
e AS (SELECT CAST(component AS INTEGER) AS component, m0, m1, a, b, (a + c) / 2 + side * sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l FROM c, (VALUES (0, 1), (1, -1)) AS t(component, side)),
u AS (SELECT component, m0, m1, l, b / sqrt(b * b + (l - a) * (l - a)) AS u0, (l - a) / sqrt(b * b + (l - a) * (l - a)) AS u1 FROM e),
w AS (SELECT component, m0, m1, l, u0 * s AS u0, u1 * s AS u1 FROM (SELECT *, CASE WHEN abs(u0) >= abs(u1) THEN sign(u0) ELSE sign(u1) END AS s FROM u))
"""


def _plane(spark: SparkSession, d: str) -> tuple[SparseMatrix, pca.PCAModel]:
    m = embedding_matrix(spark, d)
    return m, pca.MaskedSparsePCA(_first_columns(m, 2), n_components=2, svd_method="lanczos").fit(m)


@query("pca_explained_variance_ratio", _PLANE + "SELECT component, round(l / sum(l) OVER (), 6) AS ratio FROM w")
def pca_explained_variance_ratio(spark, d):
    return rounded(_plane(spark, d)[1].explained_variance_ratio(), "ratio")


@query("pca_cumulative", _PLANE + "SELECT component, round(sum(l) OVER (ORDER BY component) / sum(l) OVER (), 6) AS cumulative FROM w")
def pca_cumulative(spark, d):
    return rounded(_plane(spark, d)[1].cumulative_explained_variance_ratio(), "cumulative")


@query("pca_feature_importances", _PLANE + "SELECT component, CAST(col_id AS BIGINT) AS col_id, round(CASE WHEN col_id = 0 THEN u0 * u0 ELSE u1 * u1 END, 6) AS importance FROM w, (VALUES (0), (1)) AS t(col_id)")
def pca_feature_importances(spark, d):
    return rounded(_plane(spark, d)[1].feature_importances(), "importance")


@query("pca_masked_transform", _PLANE + "SELECT id AS row_id, component, round((x0 - m0) * u0 + (x1 - m1) * u1, 6) + 0.0 AS score FROM x, w")
def pca_masked_transform(spark, d):
    m, model = _plane(spark, d)
    return model.transform(m).select("row_id", "component", (F.round("score", 6) + 0.0).alias("score"))


@query("tsne")
def tsne_query(spark, d):
    """All vectors, with the operator's defaults."""
    return tsne(vectors(spark, d))


# --- streams and wide matrices --------------------------------------------------------------------


@query("stream_row_stats", """SELECT user_id AS row_id, CAST(count(*) AS BIGINT) AS nonzero, round(sum(value), 4) AS sum, round(var_pop(value), 4) AS variance,
min(value) AS min_value, max(value) AS max_value FROM events GROUP BY user_id""")
def stream_row_stats(spark, d):
    """Events as they arrive: the running statistics of each user, after the last batch."""
    found = run_stream(stream_stats(event_stream(spark, d), "row"))
    return found.select("row_id", F.col("k").alias("nonzero"), F.round("s", 4).alias("sum"), F.round("variance", 4).alias("variance"), F.col("mn").alias("min_value"), F.col("mx").alias("max_value"))


query("user_event_sum_col", """WITH t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS col_id FROM (SELECT DISTINCT event_type FROM events))
SELECT CAST(col_id AS BIGINT) AS col_id, round(sum(value), 4) AS sum FROM events JOIN t USING (event_type) GROUP BY col_id""")(lambda s, d: rounded(stats.total(user_event(s, d), "column"), "sum", digits=4))

_TERMS = """WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS term FROM documents),
coo AS (SELECT doc_id AS row_id, CAST('0x' || substr(md5(term), 1, 15) AS BIGINT) AS col_id, CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY ALL)
"""
query("doc_term_nonzero_col", _TERMS + "SELECT col_id, count(*) AS nonzero FROM coo GROUP BY col_id")(lambda s, d: stats.nonzero(doc_term(s, d), "column"))
query("doc_term_sum_row", _TERMS + "SELECT d.doc_id AS row_id, coalesce(sum(value), 0) AS sum FROM documents d LEFT JOIN coo ON d.doc_id = row_id GROUP BY d.doc_id")(lambda s, d: stats.total(doc_term(s, d), "row"))


def matrix(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    return part_supp(spark, sf_dir)
