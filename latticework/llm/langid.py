"""Language identification of mixed text: script ranges, word scores, Viterbi spans.

Words end at white space and where the script changes; a word's letters name its script, and languages
seen in that script stay candidates. Candidates are scored by a naive Bayes model over the word's character n-grams. A Viterbi pass over the words of a
text, in which a change of language costs ``SWITCH``, labels spans; the language that holds most
letters is the text's. The model is fitted on a bounded sample of labelled rows (see ``fit``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows of each language that the classifier is fitted on at most (the ones with the smallest hash)
SAMPLE_PER_LANG = 2000
#: cost of a change of language, in nats
SWITCH = 8.0
N_GRAMS = (1, 2, 3, 4)
#: n-grams are hashed to so many counters
BUCKETS = 1 << 16
#: a language uses a script if this share of its letters is in it
SCRIPT_SHARE = 0.02
#: log-odds of a word against the best language are cut here, so that one odd word can't decide
WORD_CAP = 12.0
#: bytes of text counted at once, a longer text alone
BLOCK = 1 << 20
#: bytes of text times languages labelled at once
LABEL_BLOCK = 1 << 24
#: words times languages scored at once
SCORE_BLOCK = 1 << 17
#: scores that a task remembers: words times languages
HELD_SCORES = 1_000_000

#: First and last code point of Unicode ranges, by script.
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0250, 0x02AF, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0700, 0x074F, "syriac"),
    (0x0750, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0A00, 0x0A7F, "gurmukhi"),
    (0x0A80, 0x0AFF, "gujarati"), (0x0B00, 0x0B7F, "oriya"), (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"),
    (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"), (0x0D80, 0x0DFF, "sinhala"), (0x0E00, 0x0E7F, "thai"),
    (0x0E80, 0x0EFF, "lao"), (0x0F00, 0x0FFF, "tibetan"), (0x1000, 0x109F, "myanmar"), (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"), (0x1200, 0x137F, "ethiopic"), (0x1780, 0x17FF, "khmer"), (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"), (0x3040, 0x309F, "kana"), (0x30A0, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"),
    (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0x20000, 0x2FFFF, "han"),
]
SCRIPT_NAMES = sorted({s[2] for s in SCRIPTS}) + ["other"]
_LOWS = np.array([s[0] for s in SCRIPTS])
_HIGHS = np.array([s[1] for s in SCRIPTS])
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(s[2]) for s in SCRIPTS])
_ORDER = np.argsort(_LOWS)
#: what is not a letter, and what is neither a letter nor a mark on one; letters are Unicode's
_NOT_LETTERS, _NOT_TEXT = r"[^\p{L}]+", r"[^\p{L}\p{M}]+"
#: what isn't ASCII or Latin
_BEYOND_LATIN = r"[^\x00-\x{024F}]"
#: runs of one script other than Latin, with the marks on them; kana are one script, as above
_RUNS = "((?:(?:" + ")+|(?:".join(
    [rf"\p{{{n.title()}}}\p{{M}}*" for n in SCRIPT_NAMES if n not in ("latin", "kana", "other")] + [r"[\p{Hiragana}\p{Katakana}\x{30FC}]\p{M}*"]
) + ")+))"


def letters_only(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words in lower case without what isn't a letter or a mark on one, and the number of letters of each.
    What has no letter is empty."""
    n = pc.utf8_length(pc.replace_substring_regex(words, _NOT_LETTERS, "")).to_numpy(zero_copy_only=False).astype(np.int64)
    plain = pc.replace_substring_regex(pc.utf8_lower(words), _NOT_TEXT, "")
    return pc.if_else(pa.array(n > 0), plain, ""), n


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' code points in a row, and the words' lengths."""
    text = "".join(words)
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Number of each code point's script in SCRIPT_NAMES."""
    at = np.searchsorted(_LOWS[_ORDER], points, side="right") - 1
    at = np.clip(at, 0, None)
    where = _ORDER[at]
    inside = (points >= _LOWS[where]) & (points <= _HIGHS[where])
    return np.where(inside, _SCRIPT_OF[where], len(SCRIPT_NAMES) - 1)


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, n-gram bucket) of every character n-gram of the words, set in blanks."""
    padded = [f" {w} " for w in words]
    points, lengths = _code_points(padded)
    owner = np.repeat(np.arange(len(words)), lengths)
    rows, grams = [], []
    value = np.zeros(len(points), np.uint64)
    for n in range(1, max(N_GRAMS) + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        value = value[:m] * np.uint64(0x100000001B3) + points[n - 1 :].astype(np.uint64) + np.uint64(n)
        if n in N_GRAMS:
            whole = owner[:m] == owner[n - 1 :]
            mixed = value * np.uint64(0x9E3779B97F4A7C15)
            rows.append(owner[:m][whole])
            grams.append((mixed >> np.uint64(40)).astype(np.int64)[whole] % BUCKETS)
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(grams) if grams else np.zeros(0, np.int64)


@dataclass
class LanguageModel:
    langs: list[str]
    #: (BUCKETS, languages) log-probabilities of n-grams
    grams: np.ndarray
    #: (scripts, languages): whether a language uses a script
    uses: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages) log-scores, the best language of each word at zero. Words without a
        letter score zero for all."""
        k = len(self.langs)
        if not words or not k:
            return np.zeros((len(words), k), np.float32)
        owner, grams = word_grams(words)
        sizes = np.bincount(owner, minlength=len(words))
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(owner, kind="stable")
        scores = np.add.reduceat(self.grams[grams[order]], starts, axis=0)
        points, lengths = _code_points(words)
        script = np.full(len(words), len(SCRIPT_NAMES) - 1)
        some = lengths > 0
        script[some] = scripts_of(points)[(np.cumsum(lengths) - lengths)[some]]
        allowed = self.uses[script]
        allowed |= ~allowed.any(axis=1, keepdims=True)
        scores = np.where(allowed, scores, -np.inf)
        scores -= scores.max(axis=1, keepdims=True)
        scores = np.maximum(scores, -WORD_CAP)
        scores[~some] = 0
        return scores.astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word. ``scores`` holds the words of all texts in a row; texts are
    walked together, the longest first, so that each step is one array operation."""
    total, k = scores.shape
    path = np.zeros(total, np.int32)
    if not total or k < 2:
        return path
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    sizes, starts = lengths[order], starts[order]
    steps = int(sizes[0])
    live = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")
    stay = np.zeros((total, k), bool)
    came = np.zeros(total, np.int32)
    best = np.zeros((len(sizes), k), np.float32)
    for t in range(steps):
        n = live[t]
        at = starts[:n] + t
        b = best[:n]
        if t:
            top = b.argmax(axis=1)
            jump = b[np.arange(n), top] - switch
            keep = b >= jump[:, None]
            stay[at] = keep
            came[at] = top
            b = np.where(keep, b, jump[:, None])
            b -= b.max(axis=1, keepdims=True)
        best[:n] = b + scores[at]
    now = best.argmax(axis=1).astype(np.int32)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        at = starts[:n] + t
        path[at] = now[:n]
        if t:
            now[:n] = np.where(stay[at, now[:n]], now[:n], came[at])
    return path


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in a row and the number of words of each text. Runs of one script are words of
    their own, so that text without blanks isn't one word."""
    texts = pc.fill_null(texts, "")
    other = pc.match_substring_regex(texts, _BEYOND_LATIN)
    if pc.any(other).as_py():
        texts = pc.if_else(other, pc.replace_substring_regex(pc.if_else(other, texts, ""), _RUNS, r" \1 "), texts)
    lists = pc.split_pattern_regex(texts, r"[\s\x{3000}\x{00A0}]+")
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(lists), lengths


def blocks(batch: pa.RecordBatch, column: int, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes in a text column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    number = np.cumsum(sizes, dtype=np.int64) // size
    cuts = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(sizes)) if len(sizes) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(lo, hi - lo)


class WordScores:
    """Scores of words as they stand in texts, remembered up to a number of them: the first that a task
    sees, so the frequent ones are among them."""

    def __init__(self, model: LanguageModel, held: int = HELD_SCORES):
        self.model = model
        k = max(1, len(model.langs))
        self._room = max(1, held // k)
        self._at: dict[str, int] = {}
        self._scores = np.zeros((self._room, len(model.langs)), np.float32)
        self._letters = np.zeros(self._room, np.int64)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words, languages) scores and the number of letters of each word; words are distinct."""
        given = words.to_pylist()
        get = self._at.get
        at = np.array([get(w, -1) for w in given], np.int64)
        scores, letters = self._scores[at], self._letters[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            plain, counted = letters_only(words.take(pa.array(new)))
            plain = plain.to_pylist()
            step = max(1, SCORE_BLOCK // max(1, len(self.model.langs)))
            for lo in range(0, len(new), step):
                scores[new[lo : lo + step]] = self.model.word_scores(plain[lo : lo + step])
            letters[new] = counted
            kept = new[: self._room - len(self._at)]
            slots = np.arange(len(self._at), len(self._at) + len(kept))
            self._scores[slots], self._letters[slots] = scores[kept], letters[kept]
            self._at.update(zip([given[i] for i in kept.tolist()], slots.tolist()))
        return scores, letters


def label_block(found: WordScores, texts: pa.Array) -> tuple[list[str], np.ndarray, list[list[tuple[str, int]]]]:
    """Language, score and spans (language, words) of each text."""
    model = found.model
    words, lengths = split_words(texts)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    table, chars = found.look_up(coded.dictionary)
    scores = table[codes] if len(codes) else np.zeros((0, len(model.langs)), np.float32)
    path = viterbi(scores, lengths)
    weight = chars[codes].astype(np.float64) if len(codes) else np.zeros(0)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    k = max(1, len(model.langs))
    held = np.bincount(owner * k + path, weights=weight, minlength=len(lengths) * k).reshape(len(lengths), k)
    total = held.sum(axis=1)
    best = held.argmax(axis=1)
    known = (total > 0) & bool(model.langs)
    share = np.where(known, held[np.arange(len(lengths)), best] / np.maximum(total, 1), 0.0)
    langs = [model.langs[b] if ok else "und" for b, ok in zip(best, known)]
    change = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (owner[1:] != owner[:-1]))) if len(path) else np.zeros(0, np.int64)
    spans: list[list[tuple[str, int]]] = [[] for _ in lengths]
    if model.langs:
        for i, n in zip(change, np.diff(np.append(change, len(path)))):
            spans[owner[i]].append((model.langs[path[i]], int(n)))
    return langs, share, spans


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """Fit on at most ``per_lang`` rows of each language (whole texts), those whose hashed key is
    smallest. Every language with a labelled row is known; the model grows with them, by a quarter of a
    megabyte each. Rows without text or language teach nothing; with no
    row at all the model knows no language and labels everything ``und``."""
    from pyspark.sql import Window

    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(lang_col).count().collect()  # a row for each language
    if not counts:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    langs = sorted(r[0] for r in counts)
    # a hash bound leaves a few times per_lang rows of each language before they are ranked
    bound = {r[0]: min(1.0, 3 * per_lang / r[1]) for r in counts}
    share = F.create_map(*(F.lit(x) for pair in bound.items() for x in pair))[F.col(lang_col)]
    mixed = F.xxhash64(key if key is not None else F.col(text_col), F.lit(5))
    spread = F.pmod(mixed, F.lit(1 << 30)) / float(1 << 30)
    few = rows.withColumn("_h", mixed).filter(spread < share)
    rank = F.row_number().over(Window.partitionBy(lang_col).orderBy("_h"))
    sample = few.withColumn("_r", rank).filter(F.col("_r") <= per_lang).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    names = list(langs)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(names), BUCKETS), np.int64)
        scripts = np.zeros((len(names), len(SCRIPT_NAMES)), np.int64)
        at = {x: i for i, x in enumerate(names)}
        for part in (x for batch in batches for x in blocks(batch, 1)):
            of = np.array([at[x] for x in part.column(0).to_pylist()], np.int64)
            flat, lengths = split_words(part.column(1))
            coded = flat.dictionary_encode()
            words = letters_only(coded.dictionary)[0].to_pylist()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(of, lengths)
            row, gram = word_grams(words)
            full = np.fromiter((bool(w) for w in words), bool, len(words))
            points, sizes = _code_points(words)
            script, word = scripts_of(points), np.repeat(np.arange(len(words)), sizes)
            for lang in np.unique(of):
                times = np.bincount(codes[owner == lang], minlength=len(words)) * full
                grams[lang] += np.bincount(gram, weights=times[row], minlength=BUCKETS).astype(np.int64)
                scripts[lang] += np.bincount(script, weights=times[word], minlength=scripts.shape[1]).astype(np.int64)
        for kind, counts in ((0, grams), (1, scripts)):
            i, j = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), kind)), pa.array(i), pa.array(j), pa.array(counts[i, j])], names=["kind", "i", "j", "n"])

    found = sample.mapInArrow(counted, "kind long, i long, j long, n long").groupBy("kind", "i", "j").agg(F.sum("n").alias("n")).toPandas()
    grams = np.zeros((len(langs), BUCKETS))
    scripts = np.zeros((len(langs), len(SCRIPT_NAMES)))
    for kind, to in ((0, grams), (1, scripts)):
        f = found[found["kind"] == kind]
        to[f["i"].to_numpy(), f["j"].to_numpy()] = f["n"].to_numpy()
    smooth = 0.5
    logs = np.log((grams + smooth) / (grams.sum(axis=1, keepdims=True) + smooth * BUCKETS)).T
    uses = (scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1) >= SCRIPT_SHARE).T
    return LanguageModel(langs, np.ascontiguousarray(logs, np.float32), uses)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, then lang_pred, score (the share of letters in
    the language's spans) and spans as an array of (lang, words).

    A text that is null, empty or without a letter (marks alone are none) is ``und`` with score 0; ties go to
    the language first in order. Repeated rows come out repeated, an empty table gives an empty one,
    and other columns take no part.
    """
    spark = docs.sparkSession
    keep = keep if keep is not None else [c for c in docs.columns if c != text_col]
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers for each language
    own = [f"_{i}" for i in range(len(keep))]
    columns = [F.col(c).alias(x) for c, x in zip(keep, own)]
    # a text that is kept goes to the workers once
    at = keep.index(text_col) if text_col in keep and dict(docs.dtypes)[text_col] == "string" else len(keep)
    kept = docs.select(*columns, *([F.col(text_col).cast("string").alias("_text")] if at == len(keep) else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = WordScores(shared.value)
        size = max(1, LABEL_BLOCK // max(1, len(shared.value.langs)))
        for batch in batches:
            for part in blocks(batch, at, size):
                langs, share, spans = label_block(found, part.column(at))
                typed = pa.array([[{"lang": a, "words": n} for a, n in s] for s in spans], pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], pa.array(langs, pa.string()), pa.array(share, pa.float64()), typed], names=[*own, "lang_pred", "score", "spans"])

    types = "".join(f"{c} {t}, " for c, t in kept.dtypes[: len(own)])
    found = kept.mapInArrow(run, f"{types}lang_pred string, score double, spans array<struct<lang: string, words: bigint>>")
    return found.withColumnsRenamed(dict(zip(own, keep)))
