"""HTML extraction, WARC packages, packing and audio fingerprints."""

import base64
import hashlib
import math
import io
import re
import struct
import time
import wave
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import chroma, packing, queries, warc_zip
from latticework.llm.html_extract import LineParser, extract, main_text, smooth, threshold

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


# --- HTML -----------------------------------------------------------------------------------------

LONG = "This sentence is long enough to be taken for prose, and it has some commas, too. " * 3


def page(body, head="<title>T</title><script>var a='<p>no</p>';</script><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize("body,want", [
    (f"<nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>{LONG}</p><p>One.</p></article><footer>&copy; foot</footer>", f"Head {LONG.strip()} One."),
    (f"<header><h1>Site</h1></header><main><h1>A &amp; B&nbsp;c</h1><p>{LONG}</main><aside>side</aside>", f"A & B c {LONG.strip()}"),
    (f"<div class='cookie-notice'>{LONG}</div><article><p>{LONG}<br>x</p><form>f<input></form><section id=comments><p>{LONG}</p></section></article>", f"{LONG.strip()} x"),
    (f"<div class=sidebar>{LONG}</div><div><p>{LONG}</p><p>{LONG}</p></div><div class='ad'>buy</div>", f"{LONG.strip()} {LONG.strip()}"),
    (f"<article><p>a<b>b</b>c<script>x()</script>d</p><ul><li>one<li>two</ul><p>{LONG}</article>", f"abcd one two {LONG.strip()}"),
    (f"<div id=header>Site</div><div class='wrap has-sidebar'><article class='post'><p>{LONG}</p></article><div class='comment-list'><article class='comment'><p>{LONG}</p></article></div></div>", LONG.strip()),
    (f"<main><p>{LONG}</p><article class='comment'><p>{LONG}</p></article><aside>x</aside><div role=search>y</div></main>", LONG.strip()),
    ("<article><p>&lt;tag&gt; &#233;&eacute; &unknown; 5 < 6</p></article>", "<tag> éé &unknown; 5 < 6"),
])
def test_main_text(body, want):
    assert main_text(page(body)) == want


def test_html_odd_input():
    for html in ("", None, "<", "<p", "<!-- x", "<script>", "<div></div>", page("<nav>only</nav>"), "<p></p>" * 1000):
        assert isinstance(main_text(html), str)
    assert main_text("just text") == "just text"
    assert main_text(page("<div>" * 3000 + LONG)) == LONG.strip()
    assert "deep" in main_text(page("<p><b>" * 200 + "deep " + LONG))


def test_html_steps():
    assert smooth(np.array([0.0, 0.0, 9.0, 0.0, 0.0])).argmax() == 2 and smooth(np.ones(7)) == pytest.approx(np.ones(7))
    assert 1.5 < threshold(np.array([1.0, 1.1, 0.9, 5.0, 5.2])) < 4.5
    parser = LineParser()
    parser.feed("<p>a<p>b<br>c")
    assert [x.text for x in parser.done()] == ["a", "b", "c"]


MENU = "<div><a href=1>Home</a> <a href=2>Shop</a></div><ul>" + "".join(f"<li><a href={i}>Item {i}</a></li>" for i in range(8)) + "</ul>"


@pytest.mark.parametrize("body,want", [
    (f"<div>{MENU}</div><div><h1>Head</h1><p>{LONG}</p><p>One.</p></div><div>Buy our shoes!</div>", f"Head {LONG.strip()} One."),
    (f"<div><a href=1>Home</a></div><div>{LONG}</div><div>One.</div><div>{LONG}</div>", f"{LONG.strip()} One. {LONG.strip()}"),
    (f"{MENU}<p>{LONG}</p><p>One.</p><div><a href=ad>Buy our shoes!</a></div>", f"{LONG.strip()} One."),
    (f"<div><h1>Head</h1></div><div><p>{LONG}</p><p>One.</p></div><div>{MENU}</div>", f"Head {LONG.strip()} One."),
    (f"<article><h1>Head</h1><p>{LONG}</p>{MENU}<table><tr><td>a<td>b</table></article><div><p>{LONG}</p><p>{LONG}</p></div>", f"Head {LONG.strip()} a b {LONG.strip()} {LONG.strip()}"),
    (f"<form id=f>{MENU}<div><p>{LONG}</p><p>One.</p></div></form>", f"{LONG.strip()} One."),
    (f"<div hidden><p>{LONG}</p></div><p>{LONG}</p>", LONG.strip()),
])
def test_ratio_chooses_unmarked_blocks(body, want):
    assert main_text(page(body)) == want


@pytest.mark.parametrize("open_tag", ["<button>Go", "<object data=x>", "<select><option>a", "<video src=x>", "<BUTTON class=b>Go <b>now"])
def test_unclosed_controls_hold_nothing(open_tag):
    assert main_text(page(f"<article><p>{LONG}</p>{open_tag}<p>{LONG}</p><h2>More</h2><p>{LONG}</p></article>")).count(LONG.strip()) == 3
    name = open_tag[1:].split()[0].split(">")[0]
    closed = f"<article><p>{LONG}</p><{name}><p>fallback of its own</p></{name}><p>{LONG}</p></article>"
    assert main_text(page(closed)) == f"{LONG.strip()} {LONG.strip()}"


def test_html_time_is_linear():
    for body in ("<b><div>" + "<i>" * 20_000 + "</b>" * 20_000, "<p>x</i>" * 20_000, "</b>" * 20_000, "<div>" * 20_000 + "x" + "</div>" * 20_000, "<button>" * 20_000, "<p>" + LONG * 3000):
        began = time.perf_counter()
        main_text(page(body))
        assert time.perf_counter() - began < 10


def test_ratio_and_threshold_cut_out_menus_without_marks(monkeypatch):
    """With all marks without weight, the ratio alone keeps menus out of every page; without its threshold they come in."""
    import pyarrow.parquet as pq

    from latticework.llm import html_extract

    html = pq.read_table(f"{SF}/pages.parquet")["html"].to_pylist()
    menus = [re.findall(r"<li><a href=[^>]*>([^<]*)</a></li>", x) for x in html]
    full = [main_text(x) for x in html]
    monkeypatch.setattr(html_extract, "BOILERPLATE_WEIGHTS", (0.0, 0.0, 0.0, -np.inf))
    monkeypatch.setattr(html_extract, "ARTICLE_WEIGHT", 0.0)
    times = lambda texts: np.array([t.count(" ".join(m)) for t, m in zip(texts, menus)])
    bare = [main_text(x) for x in html]
    assert min(map(len, menus)) > 2 and (times(bare) == times(full)).all()
    assert all(set(f.split()) <= set(b.split()) for f, b in zip(full, bare))
    monkeypatch.setattr(html_extract, "clusters", lambda v: (float(v.min()),) * 2)
    assert (times([main_text(x) for x in html]) > times(full)).all()


def test_html_query(spark):
    got = queries.QUERIES["op4_html"](spark, SF).collect()
    assert len(got) == 50 and all(r["n_chars"] == len(r["text"]) and r["text"] for r in got)
    odd = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", page(f"<p>{LONG}"))], PAGES).withColumn("text", F.lit(3))
    assert sorted(r["n_chars"] for r in extract(odd).collect()) == [0, 0, len(LONG.strip())]
    assert extract(odd.limit(0)).count() == 0


# --- WARC -----------------------------------------------------------------------------------------


def reader(data):
    return warc_zip.ZipReader(lambda at, n: data[at : at + n], len(data))


@pytest.mark.parametrize("zip64", [True, False])
def test_zip_directory(zip64):
    data = warc_zip.zip_package([("a/b", b"12345"), ("ü", b""), ("c", b"x" * 1000)], zip64)
    z = reader(data)
    assert z.range("a/b", 1, 3) == b"234" and z.range("ü", 0, 0) == b"" and z.range("c", 0, 1000) == b"x" * 1000
    with zipfile.ZipFile(io.BytesIO(data)) as f:  # the standard library agrees
        assert f.testzip() is None and f.read("a/b") == b"12345"
    with pytest.raises(warc_zip.ArchiveError):
        z.range("c", 999, 2)
    with pytest.raises(warc_zip.ArchiveError):
        z.stored("d")


def test_zip_of_others():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as f:
        f.writestr("s", b"stored")
        f.writestr("d", b"deflated" * 50, zipfile.ZIP_DEFLATED)
        f.comment = b"PK\x05\x06 looks like an end"
    z = reader(out.getvalue())
    assert z.range("s", 0, 6) == b"stored"
    with pytest.raises(warc_zip.ArchiveError, match="compressed"):
        z.range("d", 0, 1)
    for cut in (0, 10, 40):
        with pytest.raises(warc_zip.ArchiveError):
            reader(out.getvalue()[:cut])


def test_record_round_trip():
    payload = b"<p>\r\n\r\n\x00\xff</p>"
    headers, n, back = warc_zip.parse_record(warc_zip.warc_record(7, "http://x/ü\r\ny", payload, warc_zip.digest_of(payload), None, False))
    assert back == payload and n == len(payload) and headers["warc-type"] == "response"
    headers, n, back = warc_zip.parse_record(warc_zip.warc_record(7, None, payload, "D", 9, True))
    assert back == b"" and n == len(payload) and warc_zip._page_of(headers["warc-refers-to"]) == 9


def brute_warc(rows):
    best = {}
    for i, _, h in rows:
        b = (h or "").encode()
        best[b] = max(best.get(b, i), i)
    out = []
    for i, u, h in rows:
        b = (h or "").encode()
        first = best[b] == i
        out.append((i, u, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else best[b]))
    return sorted(out)


def test_warc_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = queries.QUERIES["op5_warc"](spark, SF)
    assert sorted(map(tuple, got.collect())) == brute_warc(rows)


def test_warc_copies_and_edges(spark, monkeypatch):
    monkeypatch.setattr(warc_zip, "PACKAGE_BYTES", 200)
    rows = [(i, f"http://h/{i} ä", "same ü" if i % 2 else "own %d" % (i // 4)) for i in range(40)] + [(90, None, None), (91, "u", ""), (92, "long", "long é " * 500_000)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit(1))
    got = warc_zip.archive_round_trip(pages, with_payload=True).collect()
    assert sorted(tuple(r)[:6] for r in got) == brute_warc(rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r["payload"]) == html[r["page_id"]] for r in got if r["record_type"] == "response")
    assert warc_zip.archive_round_trip(pages.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, "b", "x")], PAGES)
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in warc_zip.archive_round_trip(twice).collect()) == [(0, "revisit"), (1, "response"), (1, "response")]
    small = warc_zip.plan_records(spark.createDataFrame([(1, "a", "x"), (2, "a", "x")], PAGES), min_bytes=5)
    assert not any(r["revisit"] for r in small.collect())


# --- packing --------------------------------------------------------------------------------------


def test_piece_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["", " ", "a", " a", "a ", "a  b", "a \n b", "a\n b\n", "It's the dog's, isn't it? 12 345é", "x y  z", "<|endoftext|> a", "a <|endoftext|> b", "x  <|endoftext|><|endoftext|>\n y <|endoftext|", "ab " * 500, "a\tb \tc", "日本 語", "a\r\nb c"]
    coder = packing.PieceTokenizer(packing.tokenizer_path())
    for _ in range(2):  # the second time from the cache
        for text in texts:
            ids = coder.encode(text)
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces():
    assert packing.pieces_of(1) == [(0, 1)] and packing.pieces_of(1024) == [(0, 1024)]
    assert packing.pieces_of(1025) == [(0, 1), (1, 1024)] and packing.pieces_of(2048) == [(0, 1024), (1024, 1024)]


def test_genetic_packing():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 600, 400)
    best = packing.evolve(lengths, 1000, seed=1)
    fill = np.bincount(best, weights=lengths)
    assert fill.max() <= 1000 and (fill > 0).all() and len(best) == 400
    assert len(fill) <= math.ceil(lengths.sum() / 1000) + 1
    a, b = (packing.place(np.full(400, -1), lengths, rng.permutation(400), 1000) for _ in range(2))
    child = packing.crossover(a, b, lengths, 1000, rng)
    assert (child >= 0).all() and np.bincount(child, weights=lengths).max() <= 1000
    assert packing.evolve(np.zeros(0, np.int64)).size == 0


def hard_lengths():
    rng = np.random.default_rng(5)
    a = rng.integers(380, 491, 400)
    b = np.array([rng.integers(256, 1024 - x - 256 + 1) for x in a])
    return {"thirds": np.concatenate([a, b, 1024 - a - b]), "wide": rng.integers(200, 601, 1500), "narrow": rng.integers(260, 421, 1500)}


@pytest.mark.parametrize("name", ["thirds", "wide", "narrow"])
def test_search_beats_best_fit_where_there_is_room(name):
    lengths = hard_lengths()[name].astype(np.int64)
    fitted = packing.place(np.full(len(lengths), -1), lengths, np.argsort(-lengths, kind="stable"), 1024)
    plain, bound = packing.fitness(fitted, lengths)[0], math.ceil(lengths.sum() / 1024)
    best = packing.evolve(lengths, seeds=[packing.evolve(lengths, seed=1), packing.evolve(lengths, seed=2)], seed=3)
    fill = np.bincount(best, weights=lengths)
    assert fill.max() <= 1024 and (best >= 0).all() and len(fill) - bound <= 0.5 * (plain - bound)


def test_refill_exchanges_for_smaller_items():
    lengths = np.array([600, 300, 500, 524, 424, 100, 324, 77])
    assign = np.array([0, 0, 1, 2, -1, -1, -1, -1])
    loose = packing.refill(assign, lengths, np.flatnonzero(assign < 0), 1024)
    fill = np.bincount(assign[assign >= 0], weights=lengths[assign >= 0])
    assert fill[0] == 1024 and fill.max() <= 1024 and set(loose) == set(np.flatnonzero(assign < 0))
    assert lengths[loose].sum() + fill.sum() == lengths.sum()


def check_layout(rows, capacity=1024):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_query(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want, total = [], 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        total += len(ids)
        want += [(r[0], k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.pieces_of(len(ids)))]
    got = queries.QUERIES["op6_packing"](spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert check_layout(got) <= math.ceil(total / 1024) * 1.03 + 2


def test_packing_shards_and_edges(spark):
    items = spark.createDataFrame([(i, 1 + (i * 37) % 700) for i in range(600)], "item long, length long")
    got = packing.pack_items(items, shard_items=100).collect()
    assert len({r["item"] for r in got}) == 600 == len(got)
    fill = {}
    for r in got:
        fill[r["bin_id"]] = fill.get(r["bin_id"], 0) + 1 + (r["item"] * 37) % 700
    assert max(fill.values()) <= 1024 and len(fill) <= math.ceil(sum(fill.values()) / 1024) + 3
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "word " * 3000)], "doc_id long, text string").withColumn("length", F.lit(0))
    rows = packing.pack_documents(docs, with_ids=True).collect()
    assert sorted(r["length"] for r in rows if r["doc_id"] != 2) == [1, 1, 1]
    assert all(len(r["ids"]) == r["length"] for r in rows)
    check_layout(rows)
    assert packing.pack_documents(docs.limit(0)).count() == 0


# --- audio ----------------------------------------------------------------------------------------


def tune(seed, n=90):
    rng = np.random.default_rng(seed)
    return chroma.render(rng.normal(size=n))


def test_wav_and_fingerprint():
    samples, rate = chroma.read_wav(chroma.write_wav(np.sin(np.arange(4000) / 5), 2000))
    assert rate == 2000 and len(samples) == 4000 and samples == pytest.approx(np.sin(np.arange(4000) / 5), abs=1e-3)
    for bad in (None, b"", b"RIFF", b"x" * 100, chroma.write_wav(np.zeros(10), 2000)):
        assert len(chroma.fingerprint_audio(bad)) == 0
    tone = np.sin(2 * np.pi * 440 * np.arange(8000) / 2000)
    assert (chroma.chroma(tone, 2000).argmax(axis=1) == 0).all()  # A
    image = np.random.default_rng(0).dirichlet(np.ones(12), size=40)
    fp = chroma.fingerprint(image)
    for k, (kind, p, h, w) in enumerate(chroma.FILTERS):  # the integral image against plain sums
        for t in (0, 7, len(fp) - 1):
            box = image[t : t + w, p : p + h]
            a = [box[:, : h // 2].sum(), box[: w // 2].sum(), box[: w // 2, : h // 2].sum() + box[w // 2 :, h // 2 :].sum(), box[:, h // 3 : h - h // 3].sum(), box[w // 3 : w - w // 3].sum()][kind]
            level = np.digitize(np.log((a + 0.05) / (box.sum() - a + 0.05)), (-0.5, 0, 0.5))
            assert int(fp[t]) >> 2 * k & 3 == (0, 1, 3, 2)[level]


def wav24(samples, rate):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(3)
        w.setframerate(rate)
        v = (np.clip(samples, -1, 1) * 8388607).astype("<i4").repeat(2)
        w.writeframes(v.view(np.uint8).reshape(-1, 4)[:, :3].tobytes())
    return out.getvalue()


def test_wav_of_three_bytes():
    x = np.sin(np.arange(500) / 9)
    got, rate = chroma.read_wav(wav24(x, 8000))
    assert rate == 8000 and got == pytest.approx(x, abs=1e-6)


@pytest.mark.parametrize("rate", [1500, 8000, 11025, 44100])
def test_resampling(rate):
    t = np.arange(rate * 2) / rate
    got = chroma.resample(np.sin(2 * np.pi * 220 * t), rate)
    want = np.sin(2 * np.pi * 220 * np.arange(len(got)) / chroma.RATE)
    assert abs(len(got) - 2 * chroma.RATE) <= 1 and got[200:-200] == pytest.approx(want[200:-200], abs=0.01)
    if rate > 2000:  # what lies above half of the rate is gone
        assert np.abs(chroma.resample(np.sin(2 * np.pi * 1400 * t[: rate // 2]), rate)[100:-100]).max() < 0.02


def at_rate(samples, rate):
    """Samples of 2000 a second at another rate, by the spectrum."""
    n = int(len(samples) * rate / 2000)
    spectrum = np.zeros(n // 2 + 1, complex)
    own = np.fft.rfft(samples)
    k = min(len(own), len(spectrum))
    spectrum[:k] = own[:k]
    return np.fft.irfft(spectrum, n) * (n / len(samples))


COPIES = {
    "noise": lambda x, rng: (x + 0.01 * rng.normal(size=len(x)), 2000),
    "later": lambda x, rng: (x[chroma.HOP * 13 + 40 :], 2000),
    "half": lambda x, rng: (x[: len(x) // 2 + 2000], 2000),
    "quieter": lambda x, rng: (0.3 * x, 2000),
    "telephone": lambda x, rng: (at_rate(x, 8000), 8000),
    "disc": lambda x, rng: (at_rate(x, 44100), 44100),
}


def brute_components(fps):
    """Fingerprints linked as the operator says it, by all pairs, all shared integers and plain sums."""
    looked = [chroma.key_frames(f) for f in fps]

    def aligned(a, b, i, j):
        lo = min(i, j, chroma.AROUND)
        x, y = a[i - lo : i + chroma.AROUND + 1], b[j - lo : j + chroma.AROUND + 1]
        n = min(len(x), len(y))
        heard = [k for k in range(n) if int(x[k]) != chroma.SILENT or int(y[k]) != chroma.SILENT]
        bits = sum((int(x[k]) ^ int(y[k])).bit_count() for k in heard)
        return len(heard) >= chroma.MIN_SHARED and bits <= chroma.MAX_BIT_ERROR * 32 * len(heard)

    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in range(len(fps)):
        for q in range(p):
            same = len(fps[p]) and len(fps[p]) == len(fps[q]) and (fps[p] == fps[q]).all()
            if same or any(aligned(fps[p], fps[q], i, j) for i in looked[p] for j in looked[q] if fps[p][i] == fps[q][j]):
                x, y = sorted((find(p), find(q)))
                root[y] = x
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("chunk,small", [(1024, 32), (6, 4)])
def test_groups_match_brute_force(spark, monkeypatch, chunk, small):
    monkeypatch.setattr(chroma, "CHUNK", chunk)
    monkeypatch.setattr(chroma, "SMALL", small)
    rng, audio = np.random.default_rng(4), []
    for seed in range(9):
        x = chroma.read_wav(tune(seed, 60))[0]
        audio += [chroma.write_wav(x, 2000)] * (3 if seed % 2 else 1)
        audio += [chroma.write_wav(*COPIES[c](x, rng)) for c in list(COPIES)[: seed % 5]]
    x = chroma.read_wav(tune(0, 60))[0]
    audio += [chroma.write_wav(x + 0.004 * k * rng.normal(size=len(x)), 2000) for k in range(14)]
    audio += [chroma.write_wav(np.concatenate([np.zeros(20000), chroma.read_wav(tune(k, 40))[0]]), 2000) for k in (50, 51)] + [chroma.write_wav(np.zeros(30000), 2000)] * 2
    ids = [(7 * i) % 89 for i in range(len(audio))]
    media = spark.createDataFrame([*zip(ids, audio), (200, None), (201, b"no audio"), (None, audio[0])], "id long, audio binary").withColumn("fp", F.lit(0))
    got = {r["id"]: r for r in chroma.group_recordings(media, "id").collect()}
    fps = [chroma.fingerprint_audio(a) for a in audio]
    least = {}
    for i, g in zip(ids, groups := brute_components(fps)):
        least[g] = min(i, least.get(g, i))
    assert {i: got[i]["component_id"] for i in ids} == {i: least[g] for i, g in zip(ids, groups)}
    for i, f in zip(ids, fps):
        assert got[i]["class_id"] == min(j for j, g in zip(ids, fps) if len(g) == len(f) and (f == g).all())
        if got[i]["link_id"] is not None:
            other = fps[ids.index(got[i]["link_id"])]
            assert got[i]["bit_error"] <= chroma.MAX_BIT_ERROR and chroma.bit_error(f, other, got[i]["offset"])[0] < 0.15
    assert [tuple(got[i]) for i in (200, 201)] == [(i, 0, i, i, None, None, None) for i in (200, 201)]
    assert got[None]["component_id"] == got[ids[0]]["component_id"] and len(got) == len(ids) + 3
    assert chroma.group_recordings(media.limit(0), "id").count() == 0


@pytest.mark.parametrize("chunk,small,at_once", [(1024, 32, 1 << 18), (1024, 4, 50), (6, 4, 7)])
def test_no_alignment_is_left_out(spark, monkeypatch, chunk, small, at_once):
    """Every pair that aligns is there, with its whole histogram, and the best of all alignments is a row's own."""
    for name, value in {"CHUNK": chunk, "SMALL": small, "LINKS_AT_ONCE": at_once}.items():
        monkeypatch.setattr(chroma, name, value)
    rng, audio = np.random.default_rng(8), []
    for seed in range(4):
        x = chroma.read_wav(tune(seed, 50))[0]
        audio += [chroma.write_wav(x + 0.003 * k * rng.normal(size=len(x)), 2000) for k in range(10)] + [chroma.write_wav(x, 2000)]
        audio += [chroma.write_wav(*COPIES["later"](x, rng)), chroma.write_wav(np.tile(x, 2), 2000)]
    fps = [chroma.fingerprint_audio(a) for a in audio]
    first = [min(j for j, g in enumerate(fps) if np.array_equal(f, g)) for f in fps]
    votes = {}
    for p, q in [(p, q) for p in sorted(set(first)) for q in sorted(set(first)) if p != q]:
        for i in chroma.key_frames(fps[p]):
            for j in chroma.key_frames(fps[q]):
                if fps[p][i] == fps[q][j]:
                    lo = min(i, j, chroma.AROUND)
                    x, y = (f[k - lo : k + chroma.AROUND + 1] for f, k in ((fps[p], i), (fps[q], j)))
                    heard = [(int(u), int(v)) for u, v in zip(x, y) if int(u) != chroma.SILENT or int(v) != chroma.SILENT]
                    bits = sum((u ^ v).bit_count() for u, v in heard)
                    if len(heard) >= chroma.MIN_SHARED and bits <= chroma.MAX_BIT_ERROR * 32 * len(heard):
                        votes.setdefault((p, q), {}).setdefault(int(i - j), []).append((bits, 32 * len(heard)))
    rows = [(i, f.view(np.int32).tolist(), chroma.key_frames(f).tolist(), i) for i, f in enumerate(fps) if first[i] == i]
    prints = spark.createDataFrame(rows, "fp_id long, fp array<int>, places array<int>, name long")
    want = {}
    for (p, q), by_offset in votes.items():
        share = {o: (sum(b for b, _ in v) / sum(n for _, n in v), len(v)) for o, v in by_offset.items()}
        turn = 1 if p < q else -1
        o = max(share, key=lambda o: (share[o][1], -share[o][0], -abs(o), o * turn))
        want.setdefault(p, []).append((q, o, *share[o]))
    got = {r["fp_id"]: [tuple(x) for x in r["aligned"]] for r in chroma.fingerprint_alignments(prints).collect()}
    assert sum(map(len, want.values())) > 300
    assert got == {p: sorted(v, key=lambda x: (x[2], x[0], x[1])) for p, v in want.items()}
    media = spark.createDataFrame([*enumerate(audio)], "id long, audio binary")
    for r in chroma.group_recordings(media, "id").collect():
        best = min(want.get(first[r["id"]], [(None, None, None, 0)]), key=lambda x: (x[2], x[0], x[1]))
        assert (r["link_id"], r["offset"], r["bit_error"]) == best[:3]


def test_copies_are_found(spark):
    """Recall of altered copies, and offsets, against recordings that are not alike."""
    rng, rows = np.random.default_rng(6), []
    n = 40
    for seed in range(n):
        x = chroma.read_wav(tune(100 + seed))[0]
        rows += [(10 * seed, chroma.write_wav(x, 2000))]
        rows += [(10 * seed + 1 + k, wav24(*f(x, rng)) if c == "disc" else chroma.write_wav(*f(x, rng))) for k, (c, f) in enumerate(COPIES.items())]
    got = {r["id"]: r for r in chroma.group_recordings(spark.createDataFrame(rows, "id long, audio binary"), "id").collect()}
    assert all(r["component_id"] // 10 == r["id"] // 10 for r in got.values())  # none is linked that isn't a copy
    for k, c in enumerate(COPIES):
        assert np.mean([got[10 * s + 1 + k]["component_id"] == 10 * s for s in range(n)]) >= 0.9, c
    later = [r["offset"] for r in got.values() if r["id"] % 10 == 2 and r["link_id"] is not None and r["link_id"] % 10 != 2]
    assert later and np.mean([o in (-13, -14) for o in later]) > 0.9


def test_chroma_query_has_a_row_for_each_recording(spark, tmp_path):
    rows = [(i, [float(x) for x in np.random.default_rng(i % 2).normal(size=64)]) for i in range(42)] + [(50, None), (51, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op7_chroma"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "n_frames", "class_id", "component_id", "link_id", "offset", "bit_error"]
    assert {r["vec_id"]: r["component_id"] for r in got.collect()} == {i: i % 2 for i in range(42)} | {50: 50, 51: 51}
    whole = queries.QUERIES["op7_chroma"](spark, SF).collect()
    x = {r["vec_id"]: np.array(r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    groups = brute_components([chroma.fingerprint_audio(chroma.render(x[r["vec_id"]])) for r in whole[:150]])
    mine = [r["component_id"] for r in whole[:150]]
    assert len(whole) == len(x) and all(mine[i] == mine[g] for i, g in enumerate(groups))
