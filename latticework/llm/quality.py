"""Quality rules with thresholds that follow the data, in DataFrame functions only.

Each text gets a few counts in one pass, without leaving its row. KLL quantile sketches of the
derived ratios are built per (language, source), per language and over everything; sketches merge,
so each task sends one small sketch per group and no group meets in one task. A group's bounds are
its quartiles widened by ``WIDTH`` spreads. They replace fixed cutoffs: what is normal for a source
passes there. The bounds are then joined to the counts, and rows outside any bound are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, join_small, with_row_key, write_shared

WINDOW = 3
SKETCH_K = 2048
#: spreads (interquartile ranges) beyond the quartiles; the usual far-out fence is 3
WIDTH = 4.0
#: groups with fewer rows take their language's bounds, then those of all rows
LEAST_ROWS = 100
#: (metric, least spread): ratios that hardly vary inside a group still get this much room
METRICS = {"symbol_rate": 0.10, "mean_word_len": 0.75, "dup_line_rate": 0.10, "repeat_rate": 0.10}
#: metrics that are also bounded from below
TWO_SIDED = {"mean_word_len"}
#: base rules, fixed by contract
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of three words that the text has twice or more. Windows are known
    by 64-bit hashes: a false match needs two of one text's windows to collide."""

    def covered(hashes: Column) -> Column:
        marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            n = F.size(s)
            pairs = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            return F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))

        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total"))
        count = lambda p: F.aggregate(p, start, step, lambda acc: acc["total"])
        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(some, count(_let(marked, positions))).otherwise(F.lit(0))

    def windows(w: Column) -> Column:
        n = F.size(w) - (WINDOW - 1)
        two = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(two, F.slice(w, 3, n), lambda h, c: F.xxhash64(h, c))

    return F.when(F.size(words) > WINDOW, _let(windows(words), covered)).otherwise(F.lit(0))


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of the base rules, all long. A null text counts as empty. Columns of
    ``docs`` that have a count's name are replaced."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.split(F.trim(text, F.lit(" \t\n\x0b\f\r")), _SPACE)
    words = F.when(text.rlike(r"[^\x20\x09-\x0D]"), words).otherwise(F.array().cast("array<string>"))

    def counts(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    out = docs.withColumn("_c", _let(words, counts))
    return out.withColumns({
        "n_words": F.col("_c.n_words"), "word_chars": F.col("_c.word_chars"), "n_symbols": F.col("_c.n_symbols"),
        "n_dup_lines": F.col("_c.lines.dup"), "n_lines": F.col("_c.lines.n"), "n_repeat_words": F.col("_c.n_repeat_words"),
    }).drop("_c")


def _ratios(counts: DataFrame) -> DataFrame:
    per_word = lambda c: F.col(c).cast("double") / F.greatest(F.col("n_words"), F.lit(1))
    return counts.withColumns({
        "symbol_rate": per_word("n_symbols"), "mean_word_len": per_word("word_chars"), "repeat_rate": per_word("n_repeat_words"),
        "dup_line_rate": F.col("n_dup_lines").cast("double") / F.greatest(F.col("n_lines"), F.lit(1)),
    })


def adaptive_bounds(ratios: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, <metric>_lo, <metric>_hi) for every group of ``ratios``, from KLL sketches of
    rows that pass the base rules. Groups under LEAST_ROWS rows fall back to coarser sketches."""
    sketches = [F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in METRICS]
    good = ratios.filter("NOT base_failed")
    levels = {
        "fine": good.groupBy(lang, source).agg(F.count("*").alias("n"), *sketches),
        "mid": good.groupBy(lang).agg(F.count("*").alias("n"), *sketches),
        "all": good.agg(F.count("*").alias("n"), *sketches),
    }

    def bounds(df: DataFrame, level: str) -> DataFrame:
        cols = []
        for m, least in METRICS.items():
            q1, q3 = (F.kll_sketch_get_quantile_double(m, F.lit(q)) for q in (0.25, 0.75))
            room = F.greatest(q3 - q1, F.lit(least)) * WIDTH
            cols.append(F.struct((q1 - room).alias("lo"), (q3 + room).alias("hi")).alias(m))
        keys = [c for c in (lang, source) if c in df.columns]
        return df.filter(F.col("n") > 0).select(*keys, F.struct("n", *cols).alias(level))

    fine, mid, every = (bounds(df, k) for k, df in levels.items())
    groups = ratios.select(lang, source).distinct()
    joined = groups.join(fine, [lang, source], "left").join(mid, lang, "left").join(F.broadcast(every), how="left")  # one row
    pick = F.when(F.col("fine.n") >= LEAST_ROWS, F.col("fine")).when(F.col("mid.n") >= LEAST_ROWS, F.col("mid")).otherwise(F.col("all"))
    return joined.select(lang, source, pick.alias("b")).select(
        lang, source, *(F.col(f"b.{m}.{e}").alias(f"{m}_{e}") for m in METRICS for e in ("lo", "hi"))
    )


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, the counts, base_failed, kept and the first broken bound.

    Null texts count as empty and fail the base rules; a null language or source is a label of its
    own (the empty one); repeated rows come out repeated; other columns are ignored; an empty table
    gives an empty table. Ties at a bound are kept. Sketches of over SKETCH_K rows are approximate,
    so a row within a sketch's error of a bound may change sides from run to run.
    """
    named = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = write_shared(text_counts(named).drop("text").withColumn("base_failed", failed), "counts")
    ratios = _ratios(rows)
    bounds = write_shared(adaptive_bounds(ratios), "bounds")
    joined = join_small(ratios, bounds, ["lang", "source"], by="doc_id")
    broken = F.lit(None).cast("string")
    for m in reversed(METRICS):  # the first broken bound is said
        out = F.col(m) > F.col(f"{m}_hi")
        if m in TWO_SIDED:
            out = out | (F.col(m) < F.col(f"{m}_lo"))
        broken = F.when(F.coalesce(out, F.lit(False)), F.lit(m)).otherwise(broken)
    reason = F.when(F.col("base_failed"), F.lit("base")).otherwise(broken)
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        reason.isNull().alias("kept"), reason.alias("reason"),
    )


def quality_filter(docs: DataFrame, **cols: str) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they were. Rows with a null id
    are judged by content too: the join is on a row key."""
    id_col = cols.pop("id_col", "doc_id")
    own, key = docs.columns, free_name(docs, "_row")
    keyed = write_shared(with_row_key(docs, key), "rows")
    kept = quality_verdicts(keyed.drop(id_col), id_col=key, **cols).filter("kept").select(F.col("doc_id").alias(key))
    return keyed.join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in own])


def _sql_bounds(level: str, keys: str) -> str:
    parts = []
    for m, least in METRICS.items():
        at = lambda q, m=m: f"list_sort(list({m}))[CAST(greatest(1, ceil({q} * count(*))) AS BIGINT)]"
        room = f"greatest({at(0.75)} - {at(0.25)}, {least}) * {WIDTH}"
        parts += [f"{at(0.25)} - {room} AS {m}_lo", f"{at(0.75)} + {room} AS {m}_hi"]
    group = f"GROUP BY {keys}" if keys else "HAVING count(*) > 0"
    return f"{level} AS (SELECT {keys + ', ' if keys else ''}count(*) AS n, {', '.join(parts)} FROM r WHERE NOT base_failed {group})"


def _sql_verdict() -> str:
    cases = []
    for m in METRICS:
        pick = lambda e, m=m: f"CASE WHEN fine.n >= {LEAST_ROWS} THEN fine.{m}_{e} WHEN mid.n >= {LEAST_ROWS} THEN mid.{m}_{e} ELSE every.{m}_{e} END"
        cases.append(f"WHEN {m} > {pick('hi')}" + (f" OR {m} < {pick('lo')}" if m in TWO_SIDED else "") + f" THEN '{m}'")
    return "CASE WHEN base_failed THEN 'base' " + " ".join(cases) + " END"


#: Exact quantiles, which the sketches are for up to SKETCH_K rows of a group; beyond that, within their error.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (
  SELECT k, doc_id, lang, source, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
),
windows AS (
  SELECT k, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda j: words[j] || ' ' || words[j + 1] || ' ' || words[j + 2])) AS s
  FROM w WHERE len(words) >= {WINDOW}
),
often AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM windows) WHERE c >= 2),
repeated AS (
  SELECT k, CAST(sum(least({WINDOW}, coalesce(i - before, {WINDOW}))) AS BIGINT) AS n
  FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM often) GROUP BY k
),
c AS (
  SELECT k, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN repeated USING (k)
),
r AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    CAST(n_symbols AS DOUBLE) / greatest(n_words, 1) AS symbol_rate, CAST(word_chars AS DOUBLE) / greatest(n_words, 1) AS mean_word_len,
    CAST(n_repeat_words AS DOUBLE) / greatest(n_words, 1) AS repeat_rate, CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1) AS dup_line_rate
  FROM c
),
{_sql_bounds("fine", "lang, source")}, {_sql_bounds("mid", "lang")}, {_sql_bounds("every", "")},
v AS (
  SELECT r.*, {_sql_verdict()} AS reason
  FROM r LEFT JOIN fine ON fine.lang = r.lang AND fine.source = r.source LEFT JOIN mid ON mid.lang = r.lang LEFT JOIN every ON true
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reason IS NULL AS kept, reason FROM v
"""
