"""Quality rules and source mixing: brute force, edges, and no Python on the executors."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from latticework.llm import queries
from latticework.llm.mixing import poisson_mix
from latticework.llm.quality import adaptive_bounds, quality_filter, quality_verdicts, text_counts, _ratios

DOCS = "doc_id long, text string, lang string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if c[x] > 1:
            covered |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


ODD = ["", None, " \n\t ", "a", "a b", "a b c a b c", "x x x x x x", "é ü z # $$", "l\nl\nl\n\n \n \n", "a\x0bb\x0cc\rd", "w " * 3000 + "end", " wide space", "a b c d a b c e a b c"]


def test_counts_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(ODD)], DOCS)
    got = {r["doc_id"]: tuple(r)[1:7] for r in quality_verdicts(docs).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(ODD)}


def test_query_on_whole_table(spark):
    rows = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["op1_quality"](spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in got} == {i: brute_counts(t) for i, t in rows.items()}
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert sum(r["kept"] for r in got) > len(got) / 2


def test_bounds_follow_the_source(spark):
    plain, marked = " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}" + "#" * (i % 2) for i in range(80))
    rows = [(i, plain, "en", "plain") for i in range(150)] + [(200 + i, marked, "en", "marked") for i in range(150)] + [(500, marked + " ###" * 90, "en", "plain"), (501, marked, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = {r["doc_id"]: r["kept"] for r in quality_verdicts(docs).collect()}
    assert all(kept[i] for i in range(150)) and all(kept[200 + i] for i in range(150))
    assert not kept[500] and 501 in kept
    assert sorted(r[0] for r in quality_filter(docs).select("doc_id").collect()) == sorted(i for i in kept if kept[i])


def test_sketch_is_near_exact_quantiles(spark):
    base = spark.range(20000).select(F.lit("en").alias("lang"), F.lit("s").alias("source"), (F.col("id") % 1000 / 1000.0).alias("symbol_rate"))
    ratios = base.withColumns({m: F.lit(1.0) for m in ("mean_word_len", "dup_line_rate", "repeat_rate")}).withColumn("base_failed", F.lit(False))
    hi = adaptive_bounds(ratios).first()["symbol_rate_hi"]
    assert hi == pytest.approx(0.75 + 4 * 0.5, abs=0.03)


def test_quality_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert quality_verdicts(empty).count() == 0 and quality_filter(empty).count() == 0
    clash = spark.createDataFrame([(1, "a b", "en", "s", 5, 6, True), (1, "a b", "en", "s", 5, 6, True), (None, "c", None, None, 1, 1, None)], DOCS + ", n_words int, _row int, kept boolean")
    got = quality_verdicts(clash).collect()
    assert len(got) == 3 and sorted(r["n_words"] for r in got) == [1, 2, 2]
    assert quality_filter(clash).columns == clash.columns


def has_python(df):
    return bool(re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString()))


def test_native(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s")], DOCS)
    assert not has_python(_ratios(text_counts(docs))) and not has_python(quality_verdicts(docs)) and not has_python(poisson_mix(docs))


@pytest.mark.parametrize("name", ["op1_quality", "op9_mixing"])
@pytest.mark.parametrize("repeated", [False, True])
def test_query_matches_sql(spark, tmp_path, name, repeated):
    import duckdb

    folder = SF
    if repeated:  # repeated rows, nulls and odd texts
        folder = str(tmp_path)
        docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
        odd = spark.createDataFrame([(9000 + i, t, None, None) for i, t in enumerate(ODD)], DOCS)
        docs.unionByName(docs.limit(30)).unionByName(odd).unionByName(odd).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet{'/*.parquet' if repeated else ''}'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, folder)
    cols = sorted(got.columns)
    rows = want.project(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())


def test_first_broken_bound_is_the_reason(spark):
    plain = " ".join(f"w{i}" for i in range(80))
    odd = " ".join(f"#########{i}" for i in range(80))
    got = {r["doc_id"]: r["reason"] for r in quality_verdicts(spark.createDataFrame([(i, plain, "en", "s") for i in range(150)] + [(500, odd, "en", "s"), (501, plain.replace("w", "wwwwwwwwww"), "en", "s")], DOCS)).collect()}
    assert got[500] == "symbol_rate" and got[501] == "mean_word_len" and got[0] is None


def test_mixing_rates(spark):
    text = "word " * 20
    docs = spark.createDataFrame([(i, text, "en", "a" if i % 3 else "b") for i in range(6000)], DOCS)
    mixed = poisson_mix(docs, weights={"a": 1, "b": 1}).groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()
    sizes = {r[0]: r[1] for r in mixed}
    assert sizes["a"] / sum(sizes.values()) == pytest.approx(0.5, abs=0.03)
    assert sum(sizes.values()) / (6000 * len(text)) == pytest.approx(1, abs=0.05)
    many = poisson_mix(docs.filter("doc_id < 300"), weights={"b": 1}, epochs=30)
    counts = [r[1] for r in many.groupBy("doc_id").count().collect()]
    assert sum(counts) / 100 == pytest.approx(90, rel=0.1)  # a mean over 16 is drawn in parts
    assert {r["source"] for r in many.select("source").distinct().collect()} == {"b"}


def test_mixing_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert poisson_mix(empty).count() == 0
    rows = [(1, None, None, None), (None, "a b", "en", "s"), (2, "", "en", "t"), (3, "x", "en", "s"), (3, "x", "en", "s")]
    odd = spark.createDataFrame(rows, DOCS).withColumns({"_rate": F.lit(9), "size": F.lit(1)})
    mixed = poisson_mix(odd)
    assert set(odd.columns) - {"_rate"} <= set(mixed.columns)
    counts = {}
    for r in mixed.filter("doc_id = 3").collect():
        counts[r["_copy"]] = counts.get(r["_copy"], 0) + 1
    assert all(v == 2 for v in counts.values())  # repeated rows draw alike
    assert poisson_mix(odd, details=False).columns == [c for c in odd.columns if c != "_rate"]
    again = poisson_mix(odd)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, mixed.collect()))
