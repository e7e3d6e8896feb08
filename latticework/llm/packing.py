"""Packing documents into token sequences with a grouping genetic algorithm on islands.

A document's ids (and an end id) are one piece, or pieces of ``CAPACITY`` tokens of which the first
may be shorter. Full pieces are sequences of their own. The others are dealt to shards of bounded
size; for each shard several islands evolve packings whose genes are whole bins: crossover injects
well-filled bins of one parent into the other, drops the bins that then hold an item twice, exchanges
displaced items for smaller ones where that fills a bin to the brim, and best-fits the rest. Between epochs each island's elite migrates to the next island of its
shard. Bins that stay poorly filled are packed once more together, across shards.
"""

from __future__ import annotations

import functools
import json
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import with_row_key, write_shared

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: items of a shard on average; a shard's packing is one task
SHARD_ITEMS = 20_000
ISLANDS = 2
EPOCHS = 2
POPULATION = 5
GENERATIONS = 6
#: bins filled below this share are packed again across shards
POOR = 0.97
#: pieces of text whose ids a worker remembers: the first it sees, so the frequent ones are among them
CACHE = 600_000


# --- tokens ---------------------------------------------------------------------------------------


def byte_characters() -> dict[str, int]:
    """Byte of each character that stands for one in a byte-level vocabulary: printable bytes stand for
    themselves, the others follow from code point 256 in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class PieceTokenizer:
    """Ids of whole texts under a byte-level BPE tokenizer file, remembered by piece.

    A token never crosses a blank that stands before a character that isn't white space: the
    pre-tokenizer begins a new word there. A text is cut at such blanks, each piece with its leading
    blank is encoded once, and a text's ids are its pieces' ids in a row. Texts in which other white
    space follows a blank are encoded whole. The file's merges have to be in the order of their ids,
    which is checked; then its vocabulary is a table of ranks, and ``tiktoken`` gives the same ids in
    a fifth of the time. Where a text holds the name of an added token, it is that token, as the
    tokenizer has it by default; what lies before and after is encoded apart.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec["added_tokens"]
        if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")) or spec.get("normalizer"):
            raise ValueError(f"{path} has added tokens that take what is around them, or a normalizer")
        vocab, special = spec["model"]["vocab"], {x["content"] for x in added}
        self._added = {x["content"]: struct.pack("<I", x["id"]) for x in added}
        self._at_added = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or merged != sorted(merged):
            raise ValueError(f"{path} isn't a byte-level BPE whose merges are in the order of ids")
        of = byte_characters()
        ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in special}
        self._encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._cache: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        ids = self._encode(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        ids = self._cache.get(piece)
        if ids is None:
            ids = self._ids(" " + piece)
            if len(self._cache) < CACHE and len(piece) <= 64:
                self._cache[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as unsigned little-endian 32-bit numbers."""
        if any(name in text for name in self._added):
            parts = self._at_added.split(text)
            return b"".join(self._added[x] if i % 2 else self._plain(x) for i, x in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        pieces = text.split(" ")
        rest = pieces[1:]
        if not all(rest) or any(x[0].isspace() for x in rest):
            return self._ids(text)
        first = self._ids(pieces[0])
        try:
            return first + b"".join(map(self._cache.__getitem__, rest))
        except KeyError:
            return first + b"".join(map(self._piece, rest))


@functools.lru_cache(maxsize=1)
def piece_tokenizer(path: str) -> PieceTokenizer:
    """One for each Python worker, so that its pieces serve all of the worker's tasks."""
    return PieceTokenizer(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; only the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(_row, doc_id, piece, start, length, ids_crc32[, ids]) of every row; a null text is empty and
    has the end id alone."""
    path = tokenizer or tokenizer_path()
    rows = with_row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = piece_tokenizer(path).encode
        end = struct.pack("<I", END_ID)
        for batch in batches:
            cols: list[list] = [[] for _ in range(6 + with_ids)]
            for row, doc_id, text in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    values = [row, doc_id, k, start, length, zlib.crc32(own)]
                    if with_ids:
                        values.append(np.frombuffer(own, "<u4").astype(np.int32))
                    for c, v in zip(cols, values):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            names = ["_row", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    schema = "_row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)


# --- one island -----------------------------------------------------------------------------------


class _Bins:
    """Open bins by free space; ``mask`` has bit r set if a bin has r tokens free."""

    def __init__(self, capacity: int, free: np.ndarray):
        self.capacity, self.count, self.mask = capacity, len(free), 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        for b, r in enumerate(free.tolist()):
            if r > 0:
                self.by_free[r].append(b)
                self.mask |= 1 << r

    def best_fit(self, length: int) -> int:
        fitting = self.mask >> length
        if fitting:
            r = length + (fitting & -fitting).bit_length() - 1
            b = self.by_free[r].pop()
            if not self.by_free[r]:
                self.mask ^= 1 << r
        else:
            b, r = self.count, self.capacity
            self.count += 1
        r -= length
        if r > 0:
            self.by_free[r].append(b)
            self.mask |= 1 << r
        return b


def _renumber(assign: np.ndarray) -> np.ndarray:
    placed = assign >= 0
    out = np.full(len(assign), -1, np.int64)
    out[placed] = np.unique(assign[placed], return_inverse=True)[1]
    return out


def refill(assign: np.ndarray, lengths: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """Fill open bins to the brim from the loose items, one for nothing, one for one or two for one; returns the items
    that are loose then, which are smaller: an exchange never leaves a bin emptier."""
    pool: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, n in zip(loose.tolist(), lengths[loose].tolist()):
        pool[n].append(i)
    there = np.array([len(x) for x in pool]) > 0
    order = np.argsort(assign, kind="stable")[len(loose) :]
    if not len(order):
        return loose
    starts = np.flatnonzero(np.append(True, assign[order][1:] != assign[order][:-1]))
    ends = np.append(starts[1:], len(order))
    free = capacity - np.add.reduceat(lengths[order], starts)

    def take(n: int, bin_of: int) -> None:
        assign[pool[n].pop()] = bin_of
        there[n] = bool(pool[n])

    def give(item: int) -> None:
        assign[item] = -1
        n = int(lengths[item])
        pool[n].append(item)
        there[n] = True

    def two(total: int) -> int:
        """A length of the pool that with another of it makes the total; 0 if there is none."""
        both = np.flatnonzero(there[1:total] & there[total - 1 : 0 : -1]) + 1
        for n in both[:2].tolist():
            if 2 * n != total or len(pool[n]) > 1:
                return n
        return 0

    for b in np.flatnonzero(free > 0).tolist():
        room, items = int(free[b]), order[starts[b] : ends[b]].tolist()
        if there[room]:
            take(room, assign[items[0]])
            continue
        for item in items:
            n = int(lengths[item]) + room
            if there[n]:
                own = assign[item]
                take(n, own)
                give(item)
                break
        else:
            for item in items:
                n = int(lengths[item]) + room
                first = two(n)
                if first:
                    own = assign[item]
                    take(first, own)
                    take(n - first, own)
                    give(item)
                    break
    return np.flatnonzero(assign < 0)


def place(assign: np.ndarray, lengths: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """``assign`` with the items of ``order`` best-fitted, in that order, beside the placed ones."""
    assign = _renumber(assign)
    placed = assign >= 0
    fill = np.bincount(assign[placed], weights=lengths[placed]).astype(np.int64) if placed.any() else np.zeros(0, np.int64)
    bins = _Bins(capacity, capacity - fill)
    assign[order] = [bins.best_fit(n) for n in lengths[order].tolist()]
    return assign


def fitness(assign: np.ndarray, lengths: np.ndarray) -> tuple[int, float]:
    """Smaller is better: bins, then minus the sum of squared fills."""
    fill = np.bincount(assign, weights=lengths)
    return len(fill), -float((fill**2).sum())


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of ``b`` go into ``a``; a's bins that would hold one of their items
    again are dissolved, and what they displace is best-fitted, the longest first."""
    fill = np.bincount(b, weights=lengths)
    well = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(well, max(1, int(len(well) * rng.uniform(0.2, 0.6))), replace=False)] = True
    inject = chosen[b]
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[inject]] = True
    child = a.copy()
    child[hit[a]] = -1
    child[inject] = b[inject] + len(hit)
    loose = refill(child, lengths, np.flatnonzero(child < 0), capacity)
    return place(child, lengths, loose[np.argsort(-lengths[loose], kind="stable")], capacity)


def mutate(a: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolve the emptiest bins and a few others; best-fit their items in a disturbed order."""
    fill = np.bincount(a, weights=lengths)
    gone = np.zeros(len(fill), bool)
    gone[np.argsort(fill)[: max(1, len(fill) // 50)]] = True
    gone[rng.integers(0, len(fill), max(1, len(fill) // 50))] = True
    child = np.where(gone[a], -1, a)
    loose = refill(child, lengths, np.flatnonzero(child < 0), capacity)
    return place(child, lengths, loose[np.argsort(-lengths[loose] * rng.uniform(0.9, 1.1, len(loose)))], capacity)


def evolve(lengths: np.ndarray, capacity: int = CAPACITY, seeds: list[np.ndarray] | None = None, seed: int = 0) -> np.ndarray:
    """Bin of each item. Ends early when no packing can have fewer bins."""
    rng = np.random.default_rng(seed)
    n = len(lengths)
    if not n:
        return np.zeros(0, np.int64)
    least = math.ceil(lengths.sum() / capacity)
    nothing = np.full(n, -1, np.int64)
    people = [np.asarray(s) for s in seeds or []] or [place(nothing, lengths, np.argsort(-lengths, kind="stable"), capacity)]
    while len(people) < POPULATION and min(fitness(p, lengths)[0] for p in people) > least:
        people.append(place(nothing, lengths, np.argsort(-lengths * rng.uniform(0.97, 1.03, n)), capacity))
    scored = sorted(((fitness(p, lengths), i, p) for i, p in enumerate(people)), key=lambda x: x[:2])
    serial = len(scored)
    for _ in range(GENERATIONS):
        if scored[0][0][0] <= least or len(scored) < 2:
            break
        born = []
        for _ in range(POPULATION - 1):
            i, j = rng.choice(len(scored), 2, replace=False)
            child = crossover(scored[min(i, j)][2], scored[max(i, j)][2], lengths, capacity, rng)
            if rng.random() < 0.4:
                child = mutate(child, lengths, capacity, rng)
            born.append((fitness(child, lengths), serial, child))
            serial += 1
        scored = sorted(scored + born, key=lambda x: x[:2])[:POPULATION]
    return scored[0][2]


# --- Spark ----------------------------------------------------------------------------------------


def _epoch(state: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """``state``: (shard, island, origin, item, length, bin); each origin is a whole packing of the
    shard, or has bin -1 before the first epoch. Returns each island's elite."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        shard, island = (int(k) for k in key)
        parts = [g.sort_values("item") for _, g in group.groupby("origin", sort=True)]
        first = parts[0]
        lengths = first["length"].to_numpy(np.int64)
        seeds = [p["bin"].to_numpy(np.int64) for p in parts if (p["bin"] >= 0).all()]
        best = evolve(lengths, capacity, seeds, seed=(shard * 31 + island) * 31 + epoch)
        return pd.DataFrame({"shard": shard, "island": island, "item": first["item"].to_numpy(), "length": lengths, "bin": best})

    return state.groupBy("shard", "island").applyInPandas(run, "shard long, island long, item long, length long, bin long")


def pack_items(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(item, bin_id) for ``items`` (item, length), each shorter than ``capacity`` or as long. Items
    are unique. Bins of different shards have different ids."""

    def packed(rows: DataFrame, first_shard: int) -> tuple[DataFrame, int]:
        n = rows.count()
        shards = max(1, -(-n // shard_items))
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(first_shard)), F.lit(shards)) + first_shard)
        state = dealt.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ISLANDS - 1).cast("long"))).alias("island"), F.lit(0).alias("origin"), "item", "length", F.lit(-1).cast("long").alias("bin"))
        for epoch in range(EPOCHS):
            elite = write_shared(_epoch(state, capacity, epoch), "elite")
            moved = elite.withColumn("island", (F.col("island") + 1) % ISLANDS)
            state = elite.withColumn("origin", F.lit(0)).unionByName(moved.withColumn("origin", F.lit(1)))
        bins = elite.groupBy("shard", "island", "bin").agg(F.sum("length").alias("fill"))
        scores = bins.groupBy("shard", "island").agg(F.count("*").alias("bins"), F.sum(F.col("fill") * F.col("fill")).alias("sq"))
        best = scores.groupBy("shard").agg(F.min_by("island", F.struct("bins", -F.col("sq"), "island")).alias("island"))
        return elite.join(F.broadcast(best) if shards <= 100_000 else best, ["shard", "island"], "left_semi"), first_shard + shards

    one, after = packed(items, 0)
    one = write_shared(one, "packed")
    poor = one.groupBy("shard", "bin").agg(F.sum("length").alias("fill")).filter(F.col("fill") < POOR * capacity)
    poor = write_shared(poor.select("shard", "bin"), "poor")
    good = one.join(poor, ["shard", "bin"], "left_anti")
    again, _ = packed(one.join(poor, ["shard", "bin"], "left_semi").select("item", "length"), after)
    bin_id = (F.col("shard") * (1 << 32) + F.col("bin")).alias("bin_id")
    return good.select("item", bin_id).unionByName(again.select("item", bin_id))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece of every
    row of ``docs``.

    A null or empty text is its end id alone; a null id stays null; repeated rows are packed as
    often as they come; an empty table gives an empty table; other columns are ignored. Pieces of equal
    length are told apart by row key; of two packings with as many sequences the one with the fuller bins
    counts, of equal ones that of the first island. Pieces of a sequence follow each other without a gap.
    """
    pieces = write_shared(token_pieces(docs, id_col, text_col, tokenizer, capacity, with_ids), "pieces")
    full = pieces.filter(F.col("length") == capacity)
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.filter(F.col("length") < capacity)  # one piece of a row at most
    bins = pack_items(rest.select(F.col("_row").alias("item"), "length"), capacity)
    placed = rest.join(bins.select(F.col("item").alias("_row"), F.col("bin_id").alias("sequence_id")), "_row")
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("offset", F.coalesce(before, F.lit(0)))
    return full.unionByName(placed).drop("_row")
