"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's repetition rate is the text it should give over the text it has. Each document draws its
number of copies from the Poisson distribution with that mean: a uniform number hashed from the seed
and the document's id is put through the inverse of the distribution. Copies are exploded and dealt
to random partitions in random order. Sizes are summed per source before anything is shuffled, and
the join brings one small row per source; no source meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, write_shared

SEED = 42
#: target weight of a source is its size to this power, where none are given
POWER = 0.7
#: a mean over this is drawn as the sum of several draws with means of at most this
MAX_MEAN = 16.0
#: values of the distribution; beyond them less than 2**-52 is left for means up to MAX_MEAN
TERMS = 80
_UNIT = float(1 << 52)


def _hashed(*parts: Column | str) -> Column:
    """13 hexadecimal digits of an MD5 as a long."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def _cumulative(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add, lambda acc: acc["all"])


def repetition_rates(sizes: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, power: float = POWER) -> DataFrame:
    """(source, rate) from (source, size). Weights need not sum to one; a source that ``weights``
    leaves out gets none. A source without any text has nothing to weigh and repeats at ``epochs``."""
    if weights is None:
        weight = F.pow(F.col("size"), F.lit(power))
    elif weights:
        named = F.create_map(*(F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))))
        weight = F.coalesce(F.try_element_at(named, F.col("source")), F.lit(0.0))
    else:
        weight = F.lit(0.0)
    weighed = sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(F.lit(0.0)))
    total = weighed.agg(F.sum("weight"), F.sum("size")).first()
    weights_sum, size_sum = (F.lit(float(x or 0)) for x in total)
    rate = F.when((F.col("size") > 0) & (weights_sum > 0), F.try_divide(F.col("weight"), weights_sum) * size_sum * epochs / F.nullif(F.col("size"), F.lit(0.0)))
    rate = rate.when(F.col("size") > 0, F.lit(0.0)).otherwise(F.lit(epochs))
    return weighed.select("source", F.round(rate, 6).alias("rate"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", power: float = POWER, details: bool = True) -> DataFrame:
    """Every row of ``docs`` as often as it is drawn, shuffled; with ``details`` the columns
    ``_rate``, ``_copies``, ``_copy`` (from 0) and ``_order`` follow.

    A null source is a label of its own (the empty one), a null or empty text has size 0, rows with
    equal ids draw equal counts, and a null id draws as the empty id. An empty table gives an empty
    table. Columns of ``docs`` stay as they are; those with the names above are replaced.
    """
    key = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    own = [c for c in docs.columns if c not in ("_rate", "_copies", "_copy", "_order")]
    docs = docs.select(*[F.col(f"`{c}`") for c in own])
    length = F.coalesce(F.char_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    sizes = docs.groupBy(key.alias("source")).agg(F.sum(length).cast("double").alias("size"))
    rates = repetition_rates(write_shared(sizes, "sizes"), weights, epochs, power)
    draws = F.greatest(F.ceil(F.col("_rate") / MAX_MEAN), F.lit(1)).cast("int")
    table = rates.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    table = table.withColumn("_draws", draws).withColumn("_cdf", _cumulative(F.col("_rate") / F.col("_draws")))
    joined = join_small(docs.withColumn("_source", key), write_shared(table, "rates"), ["_source"], by=id_col)

    def drawn(j: Column) -> Column:
        u = _hashed(str(seed), F.col(id_col), j) / F.lit(_UNIT)
        return F.size(F.filter("_cdf", lambda c: c <= u))

    counts = F.transform(F.sequence(F.lit(1), F.col("_draws")), drawn)
    copies = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    mixed = joined.withColumn("_copies", F.when(F.col("_rate") > 0, copies).otherwise(F.lit(0))).filter("_copies > 0")
    mixed = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    mixed = mixed.withColumn("_order", _hashed(str(seed), "order", F.col(id_col), F.col("_copy")))
    # a random partition and a random place in it: a shuffle of the whole without sorting the whole
    mixed = mixed.repartition("_order").sortWithinPartitions("_order")
    kept = [F.col(f"`{c}`") for c in own]
    return mixed.select(*kept, *(["_rate", "_copies", "_copy", "_order"] if details else []))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, source, coalesce(source, '') AS s, text, coalesce(length(text), 0) AS n FROM documents),
sizes AS (SELECT s, CAST(sum(n) AS DOUBLE) AS size FROM d GROUP BY s),
weighed AS (SELECT s, size, CASE WHEN size > 0 THEN pow(size, {POWER}) ELSE 0 END AS w FROM sizes),
rates AS (
  SELECT s, round(CASE WHEN size > 0 THEN w / (SELECT sum(w) FROM weighed) * (SELECT sum(size) FROM weighed) / size ELSE 1.0 END, 6) AS rate FROM weighed
),
means AS (SELECT s, rate, CAST(greatest(ceil(rate / {MAX_MEAN}), 1) AS INTEGER) AS draws FROM rates),
cdf AS (
  SELECT s, rate, draws, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c
  FROM (SELECT s, rate, draws, k, exp(-rate / draws + k * ln(rate / draws) - lgamma(k + 1)) AS p FROM means, range(0, {TERMS + 1}) AS r(k) WHERE rate > 0)
),
lists AS (SELECT s, rate, draws, list(c) AS cs FROM cdf GROUP BY s, rate, draws),
drawn AS (SELECT d.row_no, d.doc_id, d.source, d.text, l.rate, l.cs, unnest(range(1, l.draws + 1)) AS j FROM d JOIN lists l ON d.s = l.s),
u AS (SELECT *, CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || j), 1, 13) AS BIGINT) / {_UNIT} AS u FROM drawn),
counts AS (
  SELECT row_no, any_value(doc_id) AS doc_id, any_value(source) AS source, any_value(text) AS text, any_value(rate) AS rate,
    CAST(sum(len(list_filter(cs, lambda x: x <= u))) AS INTEGER) AS copies
  FROM u GROUP BY row_no
),
copied AS (SELECT *, CAST(unnest(range(0, copies)) AS INTEGER) AS copy FROM counts WHERE copies > 0)
SELECT doc_id, source, rate, copies, copy, md5(text) AS text_md5,
  CAST('0x' || substr(md5('{SEED}|order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy), 1, 13) AS BIGINT) AS shuffle_key
FROM copied
"""
