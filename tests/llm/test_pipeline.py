import corpus_pipeline
from latticework.llm.common import write_shared
from tests.llm.test_formats import check_layout
from tests.llm.test_simhash import brute_fingerprint, brute_groups
from tests.llm.test_text_models import brute_base

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "simhash_dedup", "pii", "mixing", "packing"]
    one = write_shared(stages["language_id"](spark, docs, SF), "t")
    assert one.columns == docs.columns and one.count() >= 0.98 * docs.count()
    two = write_shared(stages["simhash_dedup"](spark, one, SF), "t")
    before = sorted((r["doc_id"], r["text"]) for r in one.collect())
    groups = brute_groups([brute_fingerprint(t) for _, t in before])
    assert sorted(r[0] for r in two.select("doc_id").collect()) == sorted({before[g][0] for g in groups})
    three = write_shared(stages["pii"](spark, two, SF), "t")
    assert three.columns == docs.columns and three.count() == two.count()
    for r in three.collect():
        assert not brute_base(r["text"]) and r["n_chars"] == len(r["text"])
    four = write_shared(stages["mixing"](spark, three, SF), "t")
    assert four.columns == docs.columns
    assert {r[0] for r in four.select("doc_id").collect()} <= {r[0] for r in three.select("doc_id").collect()}
    five = stages["packing"](spark, four, SF).collect()
    assert sum(r["piece"] == 0 for r in five) == four.count()
    check_layout(five)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "the dog", "en", "s", 7), (2, "", "en", "s", 0), (3, "the cat and the dog", None, None, 1), (3, "the cat and the dog", None, None, 1), (4, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.selectExpr("*", "1 AS _row", "2 AS fp", "'x' AS masked", "3 AS _copies")
    for data in (docs, docs.limit(0), clash):
        out = data
        for name, stage in corpus_pipeline.STAGES:
            out = write_shared(stage(spark, out, SF), name)
        assert set(out.columns) >= {"doc_id", "sequence_id", "offset"}
    assert corpus_pipeline.ORACLE_SQL is None


def test_texts_of_several_languages_stay(spark):
    words = {"en": "the dog and the fox then the other things that were there", "de": "der hund und der fuchs dann noch mehr dinge die dort waren", "fr": "le chien et le renard puis les autres choses qui étaient là"}
    rows = [(i, t, lang, "s", len(t)) for i, (lang, t) in enumerate(list(words.items()) * 6)]
    mixed = " ".join(words.values())
    rows += [(100, mixed, None, "s", len(mixed)), (101, "\u0301\u0301", "en", "s", 2), (102, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["lang"] for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs, SF).collect()}
    assert set(kept) == {*range(18), 100} and kept[100] in words
