"""SimHash near-duplicate groups: fingerprints compared as vertical bit planes.

A fingerprint is 64 bits, cut into radius + k blocks. Fingerprints that differ in at most ``radius``
bits agree on k blocks at least, so every link is found under one of the choices of k blocks, whose
bits are the key of a bucket. k is the least for which a bucket holds ``PER_BUCKET`` of that many
fingerprints on average (four blocks for a million, ten pairs of five for a thousand millions); the
links found are the same for every k.

Inside buckets the bits are stored vertically: plane b holds bit b of 64 fingerprints in each machine
word, and small buckets take a word each. XOR with a query's bit gives one difference bit per
fingerprint, and a carry-save counter of bit_length(radius) planes adds it to 64 distances with a few
word operations; an overflow plane marks distances over the radius. After every eight planes the
words in which all 64 have overflowed are abandoned.

A bucket hands on a spanning forest of its links, not its pairs: connectivity is whole and the rows
are fewer than the fingerprints. Buckets over ``CHUNK`` fingerprints are dealt as chunks and pairs of
chunks (see ``buckets``).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import bucket_starts, crowded_keys, deal, spanning, whole_buckets
from .common import free_name, hot_split_join, with_row_key, write_shared
from .components import components, least_by

RADIUS = 3
SHINGLE = 3
SEED = 42
CHUNK = 2048
#: fingerprints of a bucket on average, at most
PER_BUCKET = 64
#: words compared with a query each at once
PAIRS = 1 << 16
#: hashes whose bits are counted at once
SLICE = 1 << 17

#: _LANES[byte] spreads the byte's bits over the eight bytes of a word
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


def shingle_hashes(text: bytes, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every word shingle of a text in UTF-8, in slices of bounded size.
    Only A-Z are lower-cased and words end at ASCII white space, which is what bytes do."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return
    if n < size:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n - size + 1, SLICE):
        part = words[lo : lo + SLICE + size - 1]
        if size == 3:
            hashed = [digest(x + b" " + y + b" " + z, SEED) for x, y, z in zip(part, part[1:], part[2:])]
        else:
            hashed = [digest(b" ".join(part[i : i + size]), SEED) for i in range(len(part) - size + 1)]
        yield np.array(hashed, np.uint64)


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(groups, 64): in how many hashes of each group each bit is set. Groups of consecutive rows
    begin at ``starts``. Bytes are spread to eight counters in one word and added word-wise, at
    most 255 rows to a word sum so that no counter overflows."""
    ends = np.append(starts[1:], len(hashes))
    cuts = [np.arange(s, e, 255) for s, e in zip(starts, ends)]
    first = np.cumsum([0] + [len(c) for c in cuts[:-1]])
    lanes = _LANES[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.concatenate(cuts), axis=0)
    wide = sums.view(np.uint8).reshape(len(sums), 64).astype(np.int64)
    return np.add.reduceat(wide, first, axis=0)


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """Fingerprints as uint64: bit b is set if over half of the text's shingle hashes have it."""
    out = np.zeros(len(texts), np.uint64)
    counts: dict[int, np.ndarray] = {}
    totals: dict[int, int] = {}
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            starts = np.cumsum([0] + [len(h) for _, h in held[:-1]])
            for (i, h), c in zip(held, bit_counts(np.concatenate([h for _, h in held]), starts)):
                counts[i] = counts.get(i, 0) + c
                totals[i] = totals.get(i, 0) + len(h)
            held.clear()
            size = 0

    for i, text in enumerate(texts):
        for h in shingle_hashes(text or b""):
            held.append((i, h))
            size += len(h)
            if size >= SLICE:
                flush()
    flush()
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, c in counts.items():
        out[i] = np.bitwise_or.reduce(np.where(c * 2 > totals[i], weights, np.uint64(0)))
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = fingerprints(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])


_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def bit_planes(fps: np.ndarray, place: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(64, words) bit planes of fingerprints stored at the lanes ``place`` of 64-lane words, and the
    words whose set bits say which lanes are taken."""
    lanes = np.zeros((65, words * 64), np.uint8)
    lanes[:64, place] = ((fps >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.uint8)
    lanes[64, place] = 1
    packed = np.packbits(lanes, axis=1, bitorder="little").view("<u8")
    return packed[:64], packed[64]


def near_words(planes: np.ndarray, taken: np.ndarray, fps: np.ndarray, q: np.ndarray, w: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, w, near) for those pairs of a query ``fps[q]`` and a word w of the planes in which a lane is within
    the radius; bit j of near is lane j's. Bit-sliced: see the module."""
    levels = max(1, radius.bit_length())
    found = []
    for lo in range(0, len(q), PAIRS):
        qs, ws = q[lo : lo + PAIRS], w[lo : lo + PAIRS]
        own = fps[qs]
        over = ~taken[ws]
        counter = [np.zeros(len(qs), np.uint64) for _ in range(levels)]
        for b in range(64):
            # the query's bit, in all 64 lanes
            carry = planes[b][ws] ^ (np.uint64(0) - ((own >> np.uint64(b)) & np.uint64(1)))
            for k in range(levels):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if b % 8 == 7:
                alive = over != _ONES
                if not alive.all():
                    qs, ws, own, over = qs[alive], ws[alive], own[alive], over[alive]
                    counter = [c[alive] for c in counter]
                    if not len(qs):
                        break
        if len(qs):
            near = ~over
            if radius + 1 != 1 << levels:  # the counter can hold more than the radius
                more, same = np.zeros(len(qs), np.uint64), np.full(len(qs), _ONES)
                for k in reversed(range(levels)):
                    if radius >> k & 1:
                        same = same & counter[k]
                    else:
                        more |= same & counter[k]
                        same = same & ~counter[k]
                near &= ~more
            some = near != 0
            found.append((qs[some], ws[some], near[some]))
    if not found:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def bucket_links(fps: np.ndarray, starts: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs that connect what the radius connects in each bucket, which begin at ``starts`` (and
    the last ends there). Rows of side 0 are compared with those of side 1, in buckets that have them,
    and with each other in others."""
    sizes = np.diff(starts)
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    across = np.bincount(bucket, weights=side, minlength=len(sizes)) > 0
    stored = np.flatnonzero((side == 1) | ~across[bucket])
    lanes = np.bincount(bucket[stored], minlength=len(sizes))
    words = -(-lanes // 64)
    first_word = np.cumsum(words) - words
    rank = np.arange(len(stored)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    place = first_word[bucket[stored]] * 64 + rank
    row_at = np.full(int(words.sum()) * 64, -1)
    row_at[place] = stored
    planes, taken = bit_planes(fps[stored], place, int(words.sum()))
    asking = np.flatnonzero(side == 0)
    times = words[bucket[asking]]
    q = np.repeat(asking, times)
    w = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times) + first_word[bucket[q]]
    q, w, near = near_words(planes, taken, fps, q, w, radius)
    # a fingerprint is near to itself
    mine = np.zeros(len(fps), np.int64) - 1
    mine[stored] = place
    itself = (mine[q] >= 0) & (mine[q] // 64 == w)
    near[itself] &= ~(np.uint64(1) << (mine[q[itself]] % 64).astype(np.uint64))
    some = near != 0
    q, w, near = q[some], w[some], near[some]
    links: list[tuple[int, int]] = []
    edges = np.flatnonzero(np.append(True, bucket[q][1:] != bucket[q][:-1])) if len(q) else []
    for lo, hi in zip(edges, np.append(edges[1:], len(q)) if len(q) else []):
        at = int(starts[bucket[q[lo]]])
        cuts = lo + np.append(np.flatnonzero(np.append(True, q[lo:hi][1:] != q[lo:hi][:-1])), hi - lo)
        where = {int(q[a]) - at: (a, b) for a, b in zip(cuts[:-1], cuts[1:])}

        def found(i: int, group: np.ndarray, where=where, at=at) -> np.ndarray:
            a, b = where[i]
            bits = np.unpackbits(near[a:b].view(np.uint8).reshape(b - a, 8), axis=1, bitorder="little").astype(bool)
            return (row_at[w[a:b, None] * 64 + np.arange(64)])[bits] - at

        links += [(i + at, j + at) for i, j in spanning(int(sizes[bucket[q[lo]]]), where, found)]
    return links


def _bucket_links(radius: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_buckets(frames):
            fps = frame["fp"].to_numpy().view(np.uint64)
            found = bucket_links(fps, bucket_starts(frame), frame["side"].to_numpy(), radius)
            if found:
                i, j = np.array(found).T
                yield pd.DataFrame({"a": fps[i].view(np.int64), "b": fps[j].view(np.int64)})

    return run


def blocks_to_agree(n: int, radius: int, per_bucket: int | None = None) -> int:
    """k: of radius + k blocks so many agree in each key. The least whose buckets are small enough."""
    k = 1
    while n > (per_bucket or PER_BUCKET) * 2.0 ** (64 * k // (radius + k)) and k < 4:
        k += 1
    return k


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, per_bucket: int | None = None) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column ``fp`` (long) that connect all
    fingerprints within the radius of one another. Works for radius 0 to 15."""
    k = blocks_to_agree(distinct.count(), radius, per_bucket)
    blocks = radius + k
    edges = [64 * i // blocks for i in range(blocks + 1)]
    whole = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    keys = []
    for number, chosen in enumerate(itertools.combinations(whole, k)):
        mask = sum(chosen)
        keys.append(F.xxhash64(F.lit(number), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    crowded = write_shared(crowded_keys(sizes, "key", CHUNK), "crowded")
    return deal(rows, "key", "fp", crowded).select("bucket", "side", "fp").mapInPandas(_bucket_links(radius), "a long, b long")


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row, duplicates and nulls included."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "id long, fp long")


def group_firsts(rows: DataFrame, first: str, radius: int = RADIUS) -> DataFrame:
    """(fp, n, first) for each fingerprint of ``rows`` (fp and the column ``first``): its number of rows, and the least
    ``first`` of its group. Fingerprints without a link take no part in the rounds; a group that holds a
    third of all is met in parts."""
    per_fp = write_shared(rows.groupBy("fp").agg(F.min(first).alias("own"), F.count("*").alias("n")), "distinct")
    roots = write_shared(components(fingerprint_links(per_fp.select("fp"), radius), "a", "b"), "roots")
    linked = write_shared(per_fp.join(roots.withColumnRenamed("node", "fp"), "fp"), "linked")
    least = write_shared(least_by(linked, "root", "own", "fp").withColumnRenamed("n", "members"), "firsts")
    together = hot_split_join(linked, least.select("root", "m"), "root", least.select("root", F.col("members").alias("n")), linked.count())
    alone = per_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left_anti")
    return together.select("fp", "n", F.col("m").alias("first")).unionByName(alone.select("fp", "n", F.col("own").alias("first")))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    component_id is the smallest id that links of at most ``radius`` differing bits reach, the
    row's own included. A null or empty text has fingerprint zero and is linked like any other; a
    null id never names a group unless all ids of the group are null. Repeated rows come out
    repeated; an empty table gives an empty table; other columns are ignored.
    """
    rows = write_shared(fingerprint_table(docs, id_col, text_col), "fingerprints")
    labels = write_shared(group_firsts(rows, "id", radius), "groups")
    joined = hot_split_join(rows, labels.select("fp", F.col("first").alias("component_id")), "fp", labels.select("fp", "n"), rows.count())
    return joined.select("id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each group stays: the one with the smallest id, of several with that id any one of them;
    rows without an id come last. Which rows go is decided by row, not by id, so that rows which share an id
    or have none lose nothing but copies. The columns of ``docs`` come back as they were; an empty table
    gives an empty table.
    """
    own, key = docs.columns, free_name(docs, "_row")
    keyed = write_shared(with_row_key(docs, key), "rows")
    prints = write_shared(fingerprint_table(keyed, key, text_col).withColumnRenamed("id", "_key"), "fingerprints")
    ids = keyed.select(F.col(key).alias("_key"), F.col(f"`{id_col}`").cast("long").alias("_id"))
    order = F.struct(F.col("_id").isNull().alias("without"), F.col("_id").alias("id"), F.col("_key").alias("key"))
    firsts = group_firsts(prints.join(ids, "_key").select("fp", order.alias("place")), "place", radius)
    kept = firsts.select(F.col("first.key").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in own])
