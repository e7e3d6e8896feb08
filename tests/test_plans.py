"""Similarity, principal components, chunks, streams and t-SNE."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions.similarity import MEASURES, pair_similarity
from latticework.operators import stats
from latticework.plans import pca, tsne
from latticework.streaming.chunks import ChunkStats, chunk_state, merge_states, stream_stats
from tests.test_matrix import F1, column, dense, make


@pytest.mark.parametrize("measure,want", [("cosine", 0.2683281573), ("euclidean", 0.0074541863), ("pearson", -0.9607689228), ("manhattan", 0.0003354626), ("jaccard", 0.0)])
def test_similarity(spark, measure, want):
    v = spark.createDataFrame([(1, [1.0, 0.0, 2.0]), (2, [3.0, 4.0, 0.0])], "id long, features array<double>")
    pairs = spark.createDataFrame([(1, 2)], "id_a long, id_b long")
    assert pair_similarity(v, pairs, measure).first()[2] == pytest.approx(want)


def test_similarity_edges(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0], [5.0, 5.0], [1.0])], "z array<double>, a array<double>, c array<double>, s array<double>")
    one = lambda m, x, y, **k: df.select(MEASURES[m](F.col(x), F.col(y), **k)).first()[0]
    assert one("cosine", "z", "a") == 0 and one("pearson", "c", "a") == 0 and one("jaccard", "z", "z") == 0
    assert one("jaccard", "a", "a") == 1 and one("euclidean", "a", "a") == 1 and one("manhattan", "a", "a") == 1
    with pytest.raises(Exception, match="length"):
        one("cosine", "a", "s")
    with pytest.raises(ValueError):
        pair_similarity(df, df, "sine")


def planted():
    rng = np.random.default_rng(10)
    u, v = np.linalg.qr(rng.normal(size=(500, 3)))[0], np.linalg.qr(rng.normal(size=(40, 3)))[0]
    x = u @ np.diag([100.0, 50.0, 25.0]) @ v.T + 0.01 * rng.normal(size=(500, 40))
    return x


def matrix_of(spark, x):
    return make(spark, (*x.shape, [(i, j, float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if x[i, j]]), unique=True)


@pytest.mark.parametrize("method", ["gram", "lanczos", pca.RandomSVD()])
@pytest.mark.parametrize("center", [True, False])
def test_pca_planted(spark, method, center):
    x = planted()
    model = pca.SparsePCA(n_components=3, svd_method=method, center=center).fit(matrix_of(spark, x))
    y = x - x.mean(axis=0) if center else x
    _, s, vt = np.linalg.svd(y, full_matrices=False)
    assert model.variances == pytest.approx(s[:3] ** 2 / 499, rel=1e-6)
    assert np.abs((model.loadings * vt[:3]).sum(axis=1)) == pytest.approx([1, 1, 1], abs=1e-6)
    assert model.loadings @ model.loadings.T == pytest.approx(np.eye(3), abs=1e-8)
    strongest = np.abs(model.loadings).argmax(axis=1)
    assert (model.loadings[range(3), strongest] > 0).all()


def test_pca_model(spark):
    x = planted()[:60]
    x[np.abs(x) < 1.5] = 0
    x[7] = 0
    m = matrix_of(spark, x)
    model = pca.SparsePCA(n_components=4, svd_method="gram").fit(m)
    scores = np.zeros((60, 4))
    for r in model.transform(m).collect():
        scores[r[0], r[1]] = r[2]
    assert scores == pytest.approx((x - x.mean(axis=0)) @ model.loadings.T)
    assert scores.var(axis=0, ddof=1) == pytest.approx(model.variances)
    literal = {(r[0], r[1]): r[2] for r in model.transform(m, center_implicit=False).collect()}
    assert literal[7, 0] == 0
    assert sum(column(model.explained_variance_ratio())) == pytest.approx(1)
    assert column(model.cumulative_explained_variance_ratio())[-1] == pytest.approx(1)
    assert sum(column(model.explained_variance_ratio_total())) < 1
    assert model.total_variance == pytest.approx(x.var(axis=0, ddof=1).sum()) and model.noise_variance() > 0
    assert model.feature_importances().agg(F.sum("importance")).first()[0] == pytest.approx(4)
    assert column(model.mean) == pytest.approx(list(x.mean(axis=0)))


def test_pca_mask(spark):
    x = planted()[:50]
    m = matrix_of(spark, x)
    keep = [j % 2 == 0 for j in range(40)]
    model = pca.MaskedSparsePCA(keep, n_components=2, svd_method="gram").fit(m)
    y = x[:, ::2] - x[:, ::2].mean(axis=0)
    assert model.variances == pytest.approx(np.linalg.svd(y, compute_uv=False)[:2] ** 2 / 49)
    assert list(model.column_ids) == list(range(0, 40, 2))
    got = {(r[0], r[1]): r[2] for r in model.transform(m).collect()}
    assert [got[i, 0] for i in range(50)] == pytest.approx(list(y @ model.loadings[0]))
    with pytest.raises(ValueError):
        pca.MaskedSparsePCA([True], n_components=2).fit(m)


def test_pca_errors_and_rank(spark):
    m = make(spark, F1)
    model = pca.SparsePCA(n_components=50, svd_method="gram").fit(m)
    assert model.variances == pytest.approx([11.57433766, 4.86259621, 0.4797328])
    with pytest.raises(ValueError):
        pca.SparsePCA().fit(make(spark, (1, 2, [(0, 0, 1.0)])))
    with pytest.raises(ValueError):
        pca.SparsePCA(svd_method="jacobi")


def test_lanczos_goes_on_until_the_residuals_are_small(spark):
    """A slowly falling spectrum needs more steps than components; a repeated value needs a new direction."""
    rng = np.random.default_rng(3)
    u, v = np.linalg.qr(rng.normal(size=(90, 60)))[0], np.linalg.qr(rng.normal(size=(60, 60)))[0]
    x = u @ np.diag(10 * 0.97 ** np.arange(60)) @ v.T
    m = matrix_of(spark, x)
    model = pca.SparsePCA(n_components=4, center=False, tolerance=1e-9).fit(m)
    c = x.T @ x / 89
    assert np.abs(c @ model.loadings.T - model.loadings.T * model.variances).max() < 1e-6
    assert model.variances == pytest.approx(np.linalg.eigvalsh(c)[::-1][:4], rel=1e-8)
    rough = pca.SparsePCA(n_components=4, center=False, max_iter=6).fit(m)
    assert np.abs(c @ rough.loadings.T - rough.loadings.T * rough.variances).max() > 1e-3
    twice = pca.SparsePCA(n_components=3, center=False).fit(matrix_of(spark, np.vstack([5 * np.eye(4), np.zeros((1, 4))])))
    assert twice.variances == pytest.approx([25 / 4] * 3) and twice.loadings @ twice.loadings.T == pytest.approx(np.eye(3), abs=1e-8)


def test_sums_are_merged_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(pca, "FAN_IN", 2)
    x = planted()[:64]
    m = matrix_of(spark, x)
    many = m.with_entries(m.entries.repartition(13, "row_id"))
    got = pca.gram_matrix(pca._cells(many), np.arange(40))
    assert got == pytest.approx(x.T @ x)


def test_centring_of_the_decomposition_alone(spark):
    x = planted()[:60] + 3
    model = pca.SparsePCA(n_components=2, svd_method="gram", center_svd=False).fit(matrix_of(spark, x))
    assert model.variances == pytest.approx(np.linalg.svd(x, compute_uv=False)[:2] ** 2 / 59)
    got = {(r[0], r[1]): r[2] for r in model.transform(matrix_of(spark, x)).collect()}
    assert [got[i, 0] for i in range(60)] == pytest.approx(list((x - x.mean(axis=0)) @ model.loadings[0]))
    with pytest.raises(ValueError):
        pca.RandomSVD(normalizer="no such")


def test_covariance(spark, monkeypatch):
    x = np.where(np.random.default_rng(1).random((30, 8)) < 0.3, 1.5, 0)
    want = {(i, j): (x.T @ x)[i, j] for i in range(8) for j in range(i, 8) if (x.T @ x)[i, j]}
    assert {(r[0], r[1]): r[2] for r in pca.gram_entries(matrix_of(spark, x)).collect()} == pytest.approx(want)
    with monkeypatch.context() as patch:  # wide matrices
        patch.setattr(pca, "GRAM_COLUMNS", 4)
        assert {(r[0], r[1]): r[2] for r in pca.gram_entries(matrix_of(spark, x)).collect()} == pytest.approx(want)
    zeros = make(spark, (3, 2, [(0, 0, 0.0), (0, 1, 2.0)]))  # a stored zero shares a row
    assert sorted(map(tuple, pca.gram_entries(zeros).collect())) == [(0, 0, 0.0), (0, 1, 0.0), (1, 1, 4.0)]
    want = np.cov(dense(F1).T)
    got = {(r[0], r[1]): r[2] for r in pca.covariance(make(spark, F1)).collect()}
    assert got == pytest.approx({(i, j): want[i, j] for i in range(3) for j in range(i, 3)})


@pytest.mark.parametrize("density", [0.08, 0.9])
def test_covariance_of_any_number_of_columns(spark, monkeypatch, density):
    """Past GRAM_COLUMNS and over several tiles: sparse and dense blocks, empty columns and rows, tiles without a product."""
    for name, value in {"GRAM_COLUMNS": 16, "TILE": 7, "STRIP": 3, "TILE_BLOCKS": 1}.items():
        monkeypatch.setattr(pca, name, value)
    rng = np.random.default_rng(3)
    x = np.where(rng.random((700, 30)) < density, rng.integers(-3, 9, (700, 30)), 0).astype(float)
    x[:, 14:21] = x[::3] = 0
    x[:350, 21:] = x[350:, :14] = 0
    m = matrix_of(spark, x)
    got = {(r[0], r[1]): r[2] for r in pca.covariance(m).collect()}
    want = np.cov(x.T)
    assert got == pytest.approx({(i, j): want[i, j] for i in range(30) for j in range(i, 30)})
    monkeypatch.setattr(pca, "GRAM_COLUMNS", 64)  # not centred: the pairs that have a common row, were their sum zero
    rows = {(r[0], r[1]): r[2] for r in pca.gram_entries(m).collect()}
    stored = (x != 0).astype(int)
    assert rows == pytest.approx({(i, j): (x.T @ x)[i, j] for i in range(30) for j in range(i, 30) if (stored.T @ stored)[i, j]})


def test_chunks(spark):
    m = make(spark, F1)
    parts = [m.entries.filter(F.col("row_id") == i) for i in range(4)]
    rows, cols = ChunkStats(m, "row", parts), ChunkStats(m, "column", parts)
    assert column(cols.nonzero()) == [2, 2, 2] and column(rows.nonzero()) == [2, 0, 2, 2]
    assert column(rows.total()) == [3, 0, 7, 11]
    assert column(cols.variance()) == pytest.approx([1, 0.25, 4]) and column(rows.variance()) == pytest.approx([0.25, 0, 0.25, 0.25])
    assert column(cols.min_max()) == [(1, 3), (4, 5), (2, 6)]
    small = ChunkStats(make(spark, (3, 2, F1[2])), "row", parts)
    assert column(small.nonzero()) == [2, 0, 2]
    nested = merge_states([merge_states([chunk_state(p, "row") for p in parts[:2]], "row"), *[chunk_state(p, "row") for p in parts[2:]]], "row")
    assert sorted(map(tuple, nested.collect())) == sorted(map(tuple, chunk_state(m.entries, "row").collect()))
    with pytest.raises(ValueError):
        merge_states([], "row")


def test_stream(spark, tmp_path):
    m = make(spark, F1)
    path = str(tmp_path / "in")
    for i in range(3):
        m.entries.filter(F.pmod("row_id", F.lit(3)) == i).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("row_id long, col_id long, value double").option("maxFilesPerTrigger", 1).parquet(path)
    q = stream_stats(stream, "column").writeStream.outputMode("complete").format("memory").queryName("chunks").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {r["col_id"]: (r["k"], r["s"], r["variance"]) for r in spark.table("chunks").collect()}
    assert got == {0: (2, 4, 1), 1: (2, 9, 0.25), 2: (2, 8, 4)}


def clouds():
    rng = np.random.default_rng(0)
    return np.concatenate([rng.normal(size=(40, 8)) * 0.1 + 5 * np.eye(8)[k] for k in range(3)])


def vectors_of(spark, x):
    return spark.createDataFrame([(10 * i + 3, [float(a) for a in r]) for i, r in enumerate(x)], "id long, features array<double>")


def test_tsne(spark):
    y = np.array([r[1] for r in tsne.tsne(vectors_of(spark, clouds()), perplexity=10, epochs=200).orderBy("id").collect()])
    assert y.shape == (120, 2) and np.isfinite(y).all()
    d = ((y[:, None] - y[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert (d.argmin(axis=1) // 40 == np.arange(120) // 40).mean() > 0.95
    with pytest.raises(ValueError):
        tsne.tsne(vectors_of(spark, clouds()), perplexity=60)
    with pytest.raises(ValueError):
        tsne.tsne(vectors_of(spark, clouds()).limit(0))
    config = tsne.TSNEConfig(output_dim=3, perplexity=5, epochs=5)
    assert dict(config.run_f32(vectors_of(spark, clouds())).dtypes)["embedding"] == "array<float>"
    assert len(config.run_f64(vectors_of(spark, clouds())).first()["embedding"]) == 3


@pytest.mark.parametrize("dim", [2, 3])
def test_tree_stands_for_far_points(dim):
    rng = np.random.default_rng(1)
    y = np.concatenate([rng.normal(size=(150, dim)), 30 + rng.normal(size=(100, dim)), np.zeros((3, dim))])  # three in one place
    away = y[:, None] - y[None]
    w = 1 / (1 + (away**2).sum(axis=2))
    np.fill_diagonal(w, 0)
    tree, every = tsne.Tree(y), np.arange(len(y))
    force, weight = tree.repulsion(y, every, 0.0)
    assert force == pytest.approx((w[:, :, None] ** 2 * away).sum(axis=1), abs=1e-9) and weight == pytest.approx(w.sum(axis=1))
    near, about = tree.repulsion(y, every, 0.5)
    assert 0 < np.abs(about - weight).max() < 0.02 * weight.max() and np.abs(near - force).max() < 0.05 * np.abs(force).max()


def test_tsne_in_tasks_and_blocks_is_the_same(spark, monkeypatch):
    v = vectors_of(spark, clouds())
    want = {r[0]: r[1] for r in tsne.tsne(v, perplexity=8, epochs=12).collect()}
    monkeypatch.setattr(tsne, "LOCAL_ROWS", 10)
    monkeypatch.setattr(tsne, "BLOCK_BYTES", 64 * 50)
    got = {r[0]: r[1] for r in tsne.tsne(v, perplexity=8, epochs=12).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-6, abs=1e-12) for i in want)


def test_neighbours(spark):
    x = clouds()
    table = tsne.neighbours(vectors_of(spark, x), np.arange(120) * 10 + 3, 6.0).collect()
    p = np.zeros((120, 120))
    for r in table:
        p[r["i"], r["js"]] = r["ps"]
    assert p == pytest.approx(p.T) and p.sum() == pytest.approx(1)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :18]
    want = np.zeros((120, 120))
    want[np.arange(120)[:, None], near] = tsne.row_probabilities(np.take_along_axis(d, near, 1), 6.0)
    assert p == pytest.approx((want + want.T) / 240, abs=1e-7)


def test_registry_matches_sql(spark):
    """Column names agree between queries and SQL, on the smallest tables."""
    import duckdb

    from latticework import registry

    con = duckdb.connect()
    d = "/root/testdata/sf0.001"
    for t in ("part", "supplier", "lineitem", "orders", "embeddings", "events", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    names = [n for n in registry.ORACLE_SQL if n.startswith(("pca_", "stream_", "user_event", "doc_term"))]
    for name in ("sum_col", "var_row", "var_col_chunk", "var_batch_row", "normalize_row", "sim_pearson", *names):
        want = con.sql(registry.ORACLE_SQL[name])
        got = registry.QUERIES[name](spark, d)
        cols = sorted(got.columns)
        assert sorted(want.columns) == cols
        rows = want.project(", ".join(f'"{c}"' for c in cols)).fetchall()
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())
    assert stats.nonzero(registry.matrix(spark, d), "row").count() == 200
