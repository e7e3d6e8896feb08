import numpy as np
import pytest
import xxhash

from latticework.llm import common, queries
from latticework.llm import components as comp
from latticework.llm import simhash as sh

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string"


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_groups(fps, radius=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    rng = np.random.default_rng(1)
    texts = [b"", None, b"A b", b"a B c", b"x " * 700, " ".join(f"wörd{i}" for i in rng.integers(0, 90, 900)).encode(), "É é z".encode(), b" \x0b\x0c"]
    assert [int(x) for x in sh.fingerprints(texts)] == [brute_fingerprint((t or b"").decode()) for t in texts]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**63, 130, dtype=np.uint64)
    for i in range(65, 130):
        fps[i] = fps[i - 65]
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            fps[i] ^= np.uint64(1) << np.uint64(b)
    want = np.array([[(int(a) ^ int(b)).bit_count() <= radius for b in fps] for a in fps])
    planes, taken = sh.bit_planes(fps, np.arange(130), 3)
    pairs = np.arange(130 * 3)
    q, w, near = sh.near_words(planes, taken, fps, pairs // 3, pairs % 3, radius)
    got = np.zeros((130, 3), np.uint64)
    got[q, w] = near
    assert (np.unpackbits(got.view(np.uint8), axis=1, bitorder="little")[:, :130].astype(bool) == want).all()
    # buckets of several sizes, one of them across: links only inside a bucket, and a forest of all
    starts, side = np.array([0, 2, 70, 71, 130]), np.zeros(130, np.int64)
    side[100:] = 1
    links = sh.bucket_links(fps, starts, side, radius)
    bucket = np.searchsorted(starts, np.arange(130), "right")
    assert len(links) < 130 and all(want[i, j] and bucket[i] == bucket[j] for i, j in links)
    for a, b in zip(starts[:3], starts[1:4]):
        own = [(i - a, j - a) for i, j in links if a <= i < b]
        assert joined(b - a, own) == joined(b - a, [(i, j) for i in range(b - a) for j in range(i) if want[a + i, a + j]])
    across = [(i, j) for i in range(71, 100) for j in range(100, 130) if want[i, j]]
    assert joined(130, [x for x in links if x[0] >= 71]) == joined(130, across)


def joined(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("chunk,per_bucket,k", [(2048, 64, 1), (16, 64, 1), (8, 1e-3, 2), (2048, 1e-6, 3), (16, 1e-8, 4)])
def test_links_span_what_the_radius_connects(spark, monkeypatch, chunk, per_bucket, k):
    """Crowded buckets, cut into chunks, and keys of several blocks lose no link."""
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 2**63, 60)] + [(1 << 63) + 5]
    near = [f ^ (1 << int(b)) ^ (1 << int(c)) ^ (1 << int(d)) for f in [*fps[:20], fps[-1]] for b, c, d in rng.integers(0, 64, (4, 3))]
    fps = sorted({*fps, *near})
    assert sh.blocks_to_agree(len(fps), 3, per_bucket) == k
    monkeypatch.setattr(sh, "CHUNK", chunk)
    signed = {int(np.uint64(f).astype(np.int64)): i for i, f in enumerate(fps)}
    rows = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = [(signed[a], signed[b]) for a, b in sh.fingerprint_links(rows, per_bucket=per_bucket).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in links)
    assert joined(len(fps), links) == brute_groups(fps)


def test_groups_match_brute_force(spark):
    base = [" ".join(f"w{(i * 7 + k) % 53}x{i}" for k in range(120)) for i in range(12)]
    texts = base + [b + " more" for b in base[:6]] + [base[0]] * 5 + ["", None, " ", "A b C", "a B c"]
    ids = [(i * 37) % 101 for i in range(len(texts))]
    got = {r["id"]: r["component_id"] for r in sh.simhash_groups(spark.createDataFrame(list(zip(ids, texts)), DOCS)).collect()}
    groups = brute_groups([brute_fingerprint(t) for t in texts])
    least = {}
    for i, g in zip(ids, groups):
        least[g] = min(i, least.get(g, i))
    assert got == {i: least[g] for i, g in zip(ids, groups)}


def test_query_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in docs]
    groups, least = brute_groups(fps), {}
    for r, g in zip(docs, groups):
        least[g] = min(r["doc_id"], least.get(g, r["doc_id"]))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op2_simhash(spark, SF).collect()}
    assert got == {r["doc_id"]: (f"{f:016x}", least[g]) for r, f, g in zip(docs, fps, groups)}


def test_dedup_and_edges(spark):
    assert sh.simhash_groups(spark.createDataFrame([], DOCS)).count() == 0
    assert sh.simhash_dedup(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(5, "a b c d", 1), (3, "a b c d", 2), (3, "a b c d", 2), (9, "quite another text here", 3), (None, "a b c d", 4), (None, "a text of its own", 4)]
    docs = spark.createDataFrame(rows, DOCS + ", _row int")
    kept = sh.simhash_dedup(docs.withColumnRenamed("_row", "fp"))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(map(str, kept.collect())) == sorted(map(str, [r for r in spark.createDataFrame([rows[1], rows[3], rows[5]], DOCS + ", fp int").collect()]))
    assert sorted(r["component_id"] or 0 for r in sh.simhash_groups(docs).collect()) == [0, 3, 3, 3, 3, 9]


@pytest.mark.parametrize("order", [1, -1])
def test_dedup_loses_no_text(spark, order):
    """Ids that several texts share: a group keeps a row whatever the ids of its rows are."""
    a, b = "one text of a few words", "quite another text with other words"
    rows = [(3, b), (5, a), (5, b), (9, a)][::order]
    kept = sh.simhash_dedup(spark.createDataFrame(rows, DOCS))
    assert sorted(map(tuple, kept.collect())) == [(3, b), (5, a)]
    kept = sh.simhash_dedup(spark.createDataFrame([(1, a), (1, b)], DOCS))
    assert sorted(map(tuple, kept.collect())) == [(1, a), (1, b)]


def test_components_of_a_large_star(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    edges = [(900, i) for i in range(100)] + [(900, 901), (901, 902), (2000, 2001), (903, 902)]
    got = dict(comp.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {i: 0 for i in [*range(100), 900, 901, 902, 903]} | {2000: 2000, 2001: 2000}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 501), (7, 7), (600, None)], "a long, b long")
    got = dict(comp.components(edges, "a", "b").collect())
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
