"""Chroma fingerprints of audio columns, and groups of recordings that align.

A recording is brought to one rate and cut into overlapping frames; a frame's spectrum is folded onto
the twelve pitch classes. Over the image of pitch classes by time, sixteen box filters are evaluated
through an integral image, each quantised to two Gray-coded bits: one packed 32-bit integer per frame.

Recordings with equal fingerprints are one class. Classes that share an integer meet in the bucket of
that integer, each with the integers around it; there the bit error of the two windows, laid on each
other at the shared integer, decides whether they align. A bucket hands on all of its alignments, packed by
recording, and a spanning forest of them for the groups; copies are one class and never come out as pairs.
The votes of all buckets for a pair are its offset histogram. No recording is sent to all tasks, and nothing
of the recordings comes to the driver.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import bucket_starts, crowded_keys, deal, spanning, whole_buckets
from .common import hot_split_join, write_shared
from .components import components, least_by

#: samples a second that every recording is brought to, and samples of a frame and between frames
RATE, FRAME, HOP = 2000, 1024, 200
#: lowest and highest frequency that counts, in Hz
LOW_HZ, HIGH_HZ = 60.0, 950.0
#: zero crossings of the resampling filter on either side
CROSSINGS = 16
#: log-ratio at which a filter's value changes its outer level
LEVEL = 0.5
#: longest filter, in frames
WIDEST = 15
#: frames on either side of a shared integer that are compared, and frames with sound that must be among them
AROUND, MIN_SHARED = 16, 16
MAX_BIT_ERROR = 0.08
#: recordings of a bucket that are compared at once; larger buckets are dealt as chunks
CHUNK = 1024
#: rows of a bucket up to which its pairs are compared together with those of other buckets
SMALL = 32
#: alignments that are packed at once, and about as many whose histograms are counted at once
LINKS_AT_ONCE = 1 << 18
#: recordings rendered at once
GROUP = 256

#: (kind, lowest pitch class, height, frames) of each filter, by rule
FILTERS = [(k % 5, (3 * k) % 12 % (13 - h), h, (4, 8, 12, WIDEST)[k % 4]) for k, h in enumerate((4, 6, 9, 3) * 4)]
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def read_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Samples in -1 .. 1, channels averaged, and the rate. What isn't readable PCM has no samples."""
    if not data:
        return np.zeros(0), 0
    try:
        with wave.open(io.BytesIO(data)) as w:
            width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError, struct.error):
        return np.zeros(0), 0
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        triples = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((triples[:, 0] | triples[:, 1] << 8 | triples[:, 2] << 16) ^ 0x800000).astype(np.float64) / 0x800000 - 1
    elif width in (2, 4):
        x = np.frombuffer(raw[: len(raw) // width * width], f"<i{width}") / float(1 << (8 * width - 1))
    else:
        return np.zeros(0), 0
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), rate


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def resample(samples: np.ndarray, rate: int) -> np.ndarray:
    """Samples at RATE a second, through a windowed sinc that ends below half of the lower rate."""
    if rate == RATE or not len(samples) or rate <= 0:
        return samples if rate > 0 else samples[:0]
    step = rate / RATE
    cut = min(1.0, 1.0 / step)  # of half the rate that comes in
    half = int(np.ceil(CROSSINGS / cut))
    n = int(len(samples) / step)
    padded = np.concatenate([np.zeros(half + 1), samples, np.zeros(half + 2)])
    out, taps = np.empty(n), np.arange(-half, half + 1)
    for lo in range(0, n, 1 << 12):  # a long recording is not unrolled at once
        at = np.arange(lo, min(n, lo + (1 << 12))) * step
        whole = np.floor(at).astype(np.int64)
        t = taps - (at - whole)[:, None]
        kernel = cut * np.sinc(cut * t) * np.cos(np.clip(t / (half + 1), -1, 1) * (np.pi / 2)) ** 2
        out[lo : lo + len(at)] = (padded[(whole + half + 1)[:, None] + taps] * kernel).sum(axis=1)
    return out


def _pitch_map() -> np.ndarray:
    """(spectrum bins, 12): which pitch class a bin belongs to."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12), np.float32)
    for i in np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ)):
        out[i, int(round(12 * np.log2(hz[i] / 440.0))) % 12] = 1
    return out


_PITCHES = _pitch_map()


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """(frames, 12) shares of energy by pitch class; a silent frame is all zero."""
    samples = resample(samples, rate)
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP]
    out = np.empty((len(frames), 12))
    window = np.hanning(FRAME).astype(np.float32)
    for lo in range(0, len(frames), 512):  # a long recording is not unrolled at once
        spectrum = np.abs(np.fft.rfft(frames[lo : lo + 512] * window, axis=1)) ** 2
        out[lo : lo + 512] = spectrum @ _PITCHES
    total = out.sum(axis=1, keepdims=True)
    return np.divide(out, total, out=np.zeros_like(out), where=total > 1e-9)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """Packed integers (uint32), one for each frame at which the longest filter fits."""
    n = len(image) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def box(t0, t1, p0, p1):
        return total[t + t1, p1] - total[t + t0, p1] - total[t + t1, p0] + total[t + t0, p0]

    out = np.zeros(n, np.uint32)
    for k, (kind, p, h, w) in enumerate(FILTERS):
        whole = box(0, w, p, p + h)
        if kind == 0:  # upper against lower pitches
            a = box(0, w, p, p + h // 2)
        elif kind == 1:  # earlier against later
            a = box(0, w // 2, p, p + h)
        elif kind == 2:  # opposite quarters
            a = box(0, w // 2, p, p + h // 2) + box(w // 2, w, p + h // 2, p + h)
        elif kind == 3:  # middle against outer pitches
            a = box(0, w, p + h // 3, p + h - h // 3)
        else:  # middle against outer times
            a = box(w // 3, w - w // 3, p, p + h)
        ratio = np.log((a + 0.05) / (whole - a + 0.05))
        out |= _GRAY[np.digitize(ratio, (-LEVEL, 0.0, LEVEL))] << np.uint32(2 * k)
    return out


def fingerprint_audio(data: bytes | None) -> np.ndarray:
    return fingerprint(chroma(*read_wav(data)))


#: the integer of frames without any sound
SILENT = int(fingerprint(np.zeros((WIDEST, 12)))[0])


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits of ``a`` and ``b`` with ``b`` starting ``offset`` frames into ``a``, and
    the frames they share."""
    lo, hi = max(0, offset), min(len(a), offset + len(b))
    if hi <= lo:
        return 1.0, 0
    return float(np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).sum()) / (32 * (hi - lo)), hi - lo


def key_frames(fp: np.ndarray) -> np.ndarray:
    """Frames by whose integer a recording is looked up: of two neighbours the one with the smaller hash,
    so that copies choose alike; none without sound, and the first only of a run of equal ones."""
    if not len(fp):
        return np.zeros(0, np.int64)
    h = fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    least = np.full(len(fp), len(fp) == 1)
    least[1:] |= h[1:] <= h[:-1]
    least[:-1] |= h[:-1] <= h[1:]
    return np.flatnonzero(least & (fp != SILENT) & np.append(True, fp[1:] != fp[:-1]))


def _compared(x: np.ndarray, sound_x: np.ndarray, y: np.ndarray, sound_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(differing bits, bits compared) of windows laid on each other; frames beyond an end aren't compared,
    nor are those that are silent in both. With too few frames no bit is compared."""
    both = (sound_x >= 0) & (sound_y >= 0) & (sound_x + sound_y > 0)
    frames = both.sum(axis=-1)
    bits = (np.bitwise_count(x ^ y) * both).sum(axis=-1)
    return bits, np.where(frames >= MIN_SHARED, 32 * frames, 0)


def _near(bits: np.ndarray, of: np.ndarray) -> np.ndarray:
    return (of > 0) & (bits <= MAX_BIT_ERROR * of)


#: an alignment as one of its two recordings has it: the other one, the number that other is named by, where it starts in
#: this one, differing bits and bits compared
_LINK = np.dtype([("b", "<i8"), ("name", "<i8"), ("offset", "<i4"), ("bits", "<i2"), ("of", "<i2")])


def _bucket_links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All alignments of each bucket, packed by recording: (fp_id, links, joined). Each is with both of its recordings;
    ``joined`` has the other ends of those that alone connect what the bucket connects."""
    width = 2 * AROUND + 1
    for frame in whole_buckets(frames):
        ids, place, side = frame["fp_id"].to_numpy(), frame["place"].to_numpy().astype(np.int64), frame["side"].to_numpy()
        names = frame["name"].to_numpy()
        lengths = np.fromiter(map(len, frame["window"]), np.int64, len(frame))
        values = np.zeros((len(frame), width), np.uint32)
        sound = np.full((len(frame), width), -1, np.int8)  # -1 beyond an end, 0 silent
        row = np.repeat(np.arange(len(frame)), lengths)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(AROUND - np.minimum(place, AROUND), lengths)
        flat = np.concatenate(frame["window"].to_list()).astype(np.int64).astype(np.uint32)
        values[row, at], sound[row, at] = flat, flat != SILENT
        starts = bucket_starts(frame)
        sizes = np.diff(starts)
        pending: list[tuple[np.ndarray, ...]] = []  # rows p and q, bits, bits compared
        tree: list[tuple[int, int]] = []

        def packed(ids=ids, place=place, names=names, pending=pending, tree=tree) -> Iterator[pd.DataFrame]:
            if not pending:
                return
            p, q, bits, of = map(np.concatenate, zip(*pending))
            x, y = np.array(tree, np.int64).reshape(-1, 2).T
            pending.clear()
            tree.clear()
            for lo in range(0, len(p), LINKS_AT_ONCE):
                cut = slice(lo, lo + LINKS_AT_ONCE)
                yield _by_recording(ids, place, names, p[cut], q[cut], bits[cut], of[cut], (x, y) if not lo else (x[:0], y[:0]))

        for size in range(2, SMALL + 1):  # buckets of one size together
            first = starts[:-1][sizes == size]
            if not len(first):
                continue
            i, j = np.triu_indices(size, 1)
            x, y = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
            for lo in range(0, len(x), 1 << 15):
                p, q = x[lo : lo + (1 << 15)], y[lo : lo + (1 << 15)]
                # side 1 comes after side 0; in a bucket across, rows of one side aren't compared
                across = side[np.repeat(first + size - 1, len(i))[lo : lo + (1 << 15)]] == 1
                bits, of = _compared(values[p], sound[p], values[q], sound[q])
                ok = _near(bits, of) & (~across | (side[p] != side[q])) & (ids[p] != ids[q])
                p, q = p[ok], q[ok]
                pending.append((p, q, bits[ok], of[ok]))
                pairs = list(zip(p.tolist(), q.tolist()))
                tree += pairs if size == 2 else _forest(pairs)
                if sum(len(x[0]) for x in pending) >= LINKS_AT_ONCE:
                    yield from packed()
        for s, e in zip(starts[:-1][sizes > SMALL], starts[1:][sizes > SMALL]):
            across = side[e - 1] == 1

            def near(k: int, group: np.ndarray, s=s, e=e, across=across) -> np.ndarray:
                other = np.flatnonzero((ids[s:e] != ids[s + k]) & ((side[s:e] == 1) if across else (np.arange(e - s) > k)))
                if not len(other):
                    return other
                bits, of = _compared(values[s + k], sound[s + k], values[s + other], sound[s + other])
                ok = _near(bits, of)
                other = other[ok]
                pending.append((np.full(len(other), s + k), s + other, bits[ok], of[ok]))
                return other

            asking = np.flatnonzero(side[s:e] == 0)
            tree += [(s + a, s + b) for a, b in spanning(e - s, asking.tolist(), near)]
            if sum(len(x[0]) for x in pending) >= LINKS_AT_ONCE:
                yield from packed()
        yield from packed()


def _by_recording(ids, place, names, p, q, bits, of, tree) -> pd.DataFrame:
    """Alignments of rows ``p`` and ``q`` of a frame, packed for each of their recordings."""
    a, b = np.append(p, q), np.append(q, p)
    links = np.empty(len(a), _LINK)
    links["b"], links["name"], links["offset"] = ids[b], names[b], place[a] - place[b]
    links["bits"], links["of"] = np.tile(bits, 2), np.tile(of, 2)
    of_id = np.append(ids[a], ids[tree[0]])
    own, at = np.unique(of_id, return_inverse=True)
    order, counts = np.argsort(at[: len(a)], kind="stable"), np.bincount(at[: len(a)], minlength=len(own))
    ends = np.cumsum(counts)
    links, joined = links[order], [[] for _ in own]
    for k, other in zip(at[len(a) :].tolist(), ids[tree[1]].tolist()):
        joined[k].append(other)
    return pd.DataFrame({"fp_id": own, "links": [links[e - n : e].tobytes() for e, n in zip(ends, counts)], "joined": joined})


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by recording, each recording's offset histograms: (fp_id, aligned, joined)."""
    held: list[tuple[int, bytes, list[int]]] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and size >= LINKS_AT_ONCE * _LINK.itemsize and row[0] != held[-1][0]:
                yield _voted(held)
                held, size = [], 0
            held.append(row)
            size += len(row[1])
    if held:
        yield _voted(held)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    return np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))


def _voted(held: list[tuple[int, bytes, list[int]]]) -> pa.RecordBatch:
    """The offset with the most votes for each pair; of equal ones the one with the least bit error, the nearer one, and
    the greater one as the recording with the smaller number has it. A recording's alignments come best first."""
    e = np.frombuffer(b"".join(x[1] for x in held), _LINK)
    a = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[1]) // _LINK.itemsize for x in held])
    sign = np.where(a < e["b"], 1, -1)
    off = e["offset"] * sign
    order = np.lexsort((off, e["b"], a))
    a, e, off, sign = a[order], e[order], off[order], sign[order]
    s = _starts(a, e["b"], off)
    hits = np.diff(np.append(s, len(a)))
    error = np.add.reduceat(e["bits"].astype(np.int64), s) / np.add.reduceat(e["of"].astype(np.int64), s)
    a, b, name, off, sign = a[s], e["b"][s], e["name"][s], off[s], sign[s]
    order = np.lexsort((off, -np.abs(off), -error, hits, b, a))
    last = order[np.append(_starts(a[order], b[order])[1:], len(a)) - 1]
    a, b, name, off, error, hits = a[last], b[last], name[last], (off * sign)[last], error[last], hits[last]
    order = np.lexsort((b, off, name, error, a))
    a, b, off, error, hits = a[order], b[order], off[order], error[order], hits[order]
    s = _starts(a)
    joined: dict[int, set[int]] = {}
    for fp_id, _, others in held:
        joined.setdefault(fp_id, set()).update(others)
    fields = {"fp_id": pa.array(b), "offset": pa.array(off.astype(np.int64)), "bit_error": pa.array(error), "hits": pa.array(hits.astype(np.int64))}
    aligned = pa.ListArray.from_arrays(pa.array(np.append(s, len(a)), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
    return pa.RecordBatch.from_arrays([pa.array(a[s]), aligned, pa.array([sorted(joined[x]) for x in a[s].tolist()], pa.list_(pa.int64()))], names=["fp_id", "aligned", "joined"])


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the pairs that connect what all of them connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x] = root[root[x]]
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def fingerprint_table(media: DataFrame, id_col: str, audio_col: str = "audio") -> DataFrame:
    """(id, fp array<int>, places array<int>, n_frames) of every row; unreadable audio has no frame. ``places`` are
    the frames by which the recording is looked up."""
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(audio_col).cast("binary").alias("audio"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                part = batch.slice(lo, GROUP)
                fps = [fingerprint_audio(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.view(np.int32) for x in fps], kind), pa.array([key_frames(x).astype(np.int32) for x in fps], kind), pa.array(list(map(len, fps)), pa.int64())],
                    names=["id", "fp", "places", "n_frames"],
                )

    return rows.mapInArrow(run, "id long, fp array<int>, places array<int>, n_frames long")


def fingerprint_alignments(prints: DataFrame) -> DataFrame:
    """All alignments of the distinct fingerprints of ``prints`` (fp_id, fp, places, name): of two of which an integer
    agrees, at frames that are looked up, and at most MAX_BIT_ERROR of the bits of the frames AROUND it differ. A row for
    each fingerprint that has one: (fp_id, aligned, joined), where ``aligned`` has (fp_id, offset, bit_error, hits) of
    every fingerprint it aligns with, the least bit error first and then the least name. The offset is where that other
    one starts in this one, in frames: the one with the most votes, and bit_error the share of differing bits over
    the windows that vote for it. ``joined`` has those that suffice to connect all that align."""
    keys = write_shared(prints.select("fp_id", F.explode("places").alias("place"), "fp").select(F.expr("fp[place]").alias("key"), "fp_id", "place"), "keys")
    sizes = write_shared(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    # an integer that occurs once links nothing; only the others take their windows along
    total = keys.count()
    shared = hot_split_join(keys, sizes.select("key"), "key", sizes, total)
    cut = F.slice("fp", F.greatest(F.col("place") - AROUND, F.lit(0)) + 1, F.least(F.col("place"), F.lit(AROUND)) + AROUND + 1)
    windows = shared.join(prints.select("fp_id", "fp", "name"), "fp_id").select("key", "fp_id", "name", "place", cut.alias("window"))
    crowded = write_shared(crowded_keys(sizes, "key", CHUNK), "crowded")
    dealt = deal(windows, "key", "fp_id", crowded).select("bucket", "side", "fp_id", "name", "place", "window")
    found = dealt.mapInPandas(_bucket_links, "fp_id long, links binary, joined array<long>")
    kind = "fp_id long, aligned array<struct<fp_id: long, offset: long, bit_error: double, hits: long>>, joined array<long>"
    return found.repartition("fp_id").sortWithinPartitions("fp_id").mapInArrow(_histograms, kind)


def group_recordings(media: DataFrame, id_col: str, audio_col: str = "audio") -> DataFrame:
    """One row per row of ``media``: id, n_frames, class_id (the smallest id with the same fingerprint),
    component_id (the smallest id that alignments reach, the row's own included), and the alignment with the
    least bit error of all that its fingerprint has: link_id (a class_id), offset (where that recording
    starts in this one, in frames) and bit_error; null where it aligns with no other fingerprint.

    Null, empty, unreadable and too short audio has no fingerprint: it is a class of its own under its id and
    aligns with nothing. A null id names a class or component only if all ids of it are null. Repeated rows
    come out repeated, ties go to the smaller id, an empty table gives an empty table, and other columns are ignored.
    """
    prints = write_shared(fingerprint_table(media, id_col, audio_col).withColumn("fp_id", F.when(F.size("fp") > 0, F.xxhash64("fp"))), "prints")
    heard = prints.filter("fp_id IS NOT NULL")
    classes = write_shared(heard.groupBy("fp_id").agg(F.min("id").alias("class_id"), F.count("*").alias("n")), "classes")
    # one row of each class goes on, named by its class; a class of null ids comes last
    name = F.coalesce(F.min("id"), F.lit(2**63 - 1)).alias("name")
    one = write_shared(heard.groupBy("fp_id").agg(F.any_value("fp").alias("fp"), F.any_value("places").alias("places"), name), "distinct")
    links = write_shared(fingerprint_alignments(one).select("fp_id", F.col("aligned")[0].alias("v"), "joined"), "alignments")
    roots = write_shared(components(links.select("fp_id", F.explode("joined").alias("other")), "fp_id", "other"), "roots")
    linked = write_shared(classes.join(roots.withColumnRenamed("node", "fp_id"), "fp_id"), "linked")
    least = write_shared(least_by(linked, "root", "class_id", "fp_id").withColumnRenamed("n", "members"), "firsts")
    firsts = hot_split_join(linked, least.select("root", "m"), "root", least.select("root", F.col("members").alias("n")), linked.count())
    best = links.select("fp_id", F.col("v.fp_id").alias("b"), "v.offset", "v.bit_error")
    best = hot_split_join(best, classes.select(F.col("fp_id").alias("b"), F.col("class_id").alias("link_id")), "b", best.groupBy("b").agg(F.count("*").alias("n")), links.count())
    per_class = classes.join(firsts.select("fp_id", F.col("m").alias("component_id")), "fp_id", "left").join(best, "fp_id", "left")
    per_class = write_shared(per_class.select("fp_id", "n", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), "link_id", "offset", "bit_error"), "groups")
    rows = prints.select("id", "n_frames", "fp_id")
    out = hot_split_join(rows, per_class.drop("n"), "fp_id", per_class.select("fp_id", "n"), rows.count(), "left")
    own = lambda c: F.when(F.col("fp_id").isNull(), F.col("id")).otherwise(F.col(c)).alias(c)
    return out.select("id", "n_frames", own("class_id"), own("component_id"), "link_id", "offset", "bit_error")


# --- recordings made from number vectors ----------------------------------------------------------


def render(values: np.ndarray) -> bytes:
    """A WAV file that plays a vector: chords of 0.1 s over twelve pitches from 110 Hz, each as loud as
    one of the numbers is large, so that like vectors sound alike."""
    v = np.nan_to_num(np.asarray(values, np.float64))
    n = len(v)
    spread = np.sqrt((v**2).mean()) if n else 0.0
    hz = 110.0 * 2 ** (np.arange(12) / 12)
    loud = np.exp(np.clip(v / spread, -3, 3)) if spread else np.zeros(n)
    chords = loud[(np.arange(n)[:, None] + 5 * np.arange(12)) % n] if n else np.zeros((0, 12))
    chords = chords / np.maximum(chords.sum(axis=1, keepdims=True), 1e-9)
    phase = 2 * np.pi * hz[:, None] * np.arange(n * HOP).reshape(n, 1, HOP) / RATE
    return write_wav((0.8 * chords[:, :, None] * np.sin(phase)).sum(axis=1).ravel(), RATE)


def recordings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, audio): a media column that plays each vector; null for a null vector."""
    rows = vectors.select(F.col(id_col).alias(id_col), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                part = batch.slice(lo, GROUP)
                audio = [None if x.as_py() is None else render(np.array([np.nan if y is None else y for y in x.as_py()])) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(audio, pa.binary())], names=[id_col, "audio"])

    return rows.mapInArrow(run, f"{id_col} long, audio binary")
