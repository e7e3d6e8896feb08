"""Personal data: fixed patterns, and a character BiLSTM with a CRF that adds what they miss.

The network is trained in numpy, when an operator needs it, from labelled spans: generated texts in
which written-out, grouped and disguised forms of each kind are set among words, numbers, dates,
versions and keys. A span of these kinds holds a digit, an @, or a bracketed or spelled-out sign
(``TRIGGER``); texts are scored in overlapping windows around every such place. Scores of
overlapping windows are averaged, nearer to a window's middle weighing more, and one Viterbi pass
over each whole stretch reconciles them. Spans of the patterns always stay; the network's spans are
added where they touch none of those, or hold them whole and are of their kind.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: characters of a window, and between the starts of windows
WINDOW, STRIDE = 80, 40
#: characters of context around a trigger
MARGIN = 36
#: what every form of the kinds holds, in any case and with any blanks: a digit, an @, a bracketed or spelled sign, or
#: groups of hexadecimal letters; a spelled at counts where a word and a dot of some form follow
TRIGGER = re.compile(
    r"[0-9@]|\sat\s\s*+[\w-]++\s*+(?:\.\s?\w|[\[({]\s*+dot\b|dot\b)|[\[({]\s*+(?:at|dot)\s*+[\])}]|\sdot\s|(?<![0-9a-f])[a-f]{1,4}:[a-f]{1,4}:", re.I
)
#: windows scored at once
BATCH = 512

# --- patterns -------------------------------------------------------------------------------------
# The character sets and forms of the base patterns. Possessive repeats and the look
# behind change no match; they keep long runs of digits linear.

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        after = _DOMAIN.match(text, at + 1) if start < at else None
        if after:
            yield "email", start, after.end()
        done = after.end() if after else at + 1  # no name reaches back over an @
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _byte(digits: str) -> bool:
    """Whether digits, of any number and with any leading zeros, are at most 255."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind as listed and then by start."""
    found = list(_emails(text))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(map(_byte, m.groups())):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGITS.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGITS.sub("", m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


# --- characters and labels ------------------------------------------------------------------------

#: tag 0 is outside; each kind has a first and an inner tag
N_TAGS = 1 + 2 * len(KINDS)
_SIGNS = "@.-_+()[]{}<>:;,/\\|=\"'#*%&$!?~"
N_CHARS = 1 + 26 + 1 + len(_SIGNS) + 4


def _char_table() -> np.ndarray:
    """Class of each code point below 0x250: letters whatever their case, all digits alike, signs."""
    table = np.full(0x250, N_CHARS - 1)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = 1 + i
    table[ord("0") : ord("9") + 1] = 27
    for i, c in enumerate(_SIGNS):
        table[ord(c)] = 28 + i
    table[ord(" ")] = N_CHARS - 4
    table[[9, 10, 11, 12, 13]] = N_CHARS - 3
    for p in range(0xC0, 0x250):
        table[p] = N_CHARS - 2
    return table


_TABLE = _char_table()


def char_classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], N_CHARS - 2)


# --- training texts -------------------------------------------------------------------------------


class _Maker:
    """Texts with labelled spans, from a seed."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, *options):
        return options[self.rng.integers(len(options))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def word(self, low: int = 1, high: int = 10) -> str:
        letters = self.pick("etaoinshrdlcumw", "enisratdhulcgmob", "esaitnrulodcmpé", "eaosrnidlctumpñó", "abcdefghijklmnopqrstuvwxyz")
        w = "".join(self.rng.choice(list(letters), self.rng.integers(low, high + 1)))
        return self.pick(w, w, w, w.capitalize(), w.upper())

    def email(self) -> str:
        user = self.word(2, 9) + self.pick("", ".", "_", "-") + self.pick("", self.digits(2), self.word(2, 6))
        host, top = self.word(3, 8), self.pick("com", "org", "net", "de", "fr", "es", "io", "co.uk")
        if self.rng.random() < 0.3:
            return f"{user}@{self.pick('', 'mail.')}{host}{self.pick('', self.digits(1))}.{top}"
        at = self.pick(" at ", "[at]", " [at] ", "(at)", " (at) ", " @ ", "{at}", " AT ")
        dot = self.pick(" dot ", "[dot]", " [dot] ", "(dot)", " (dot) ", " . ", ".", "{dot}", " DOT ")
        if at.strip().lower() == "at" and dot == ".":
            dot = " dot "
        return f"{user.rstrip('._-')}{at}{host}{dot}{top.replace('.', dot)}"

    def ip(self) -> str:
        part = lambda: str(self.rng.integers(0, 256))
        if self.rng.random() < 0.5:
            return ".".join(part() for _ in range(4))
        if self.rng.random() < 0.6:
            return self.pick("[.]", "(.)", " . ", "[dot]", " dot ").join(part() for _ in range(4))
        return ":".join("".join(self.rng.choice(list("0123456789abcdef"), self.rng.integers(1, 5))) for _ in range(8))

    def passing(self, n: int) -> str:
        """n digits that pass Luhn."""
        d = self.digits(n - 1)
        return next(d + str(c) for c in range(10) if luhn(d + str(c)))

    def card(self) -> str:
        d = self.passing(16)
        sep = self.pick("", "", " ", "-", ".", "/", "  ")
        if self.rng.random() < 0.2:
            d = self.passing(15)
            return sep.join((d[:4], d[4:10], d[10:]))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone(self) -> str:
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        form = self.rng.integers(0, 8)
        lead = self.pick("+1 ", "+49 ", "+33 ", "+", "") if form < 5 else ""
        if form == 0:
            return f"{lead}({a}) {b}-{c}"
        if form == 1:
            return f"{lead}{a}-{b}-{c}"
        if form == 2:
            return f"{lead}{a}.{b}.{c}"
        if form == 3:
            return f"{lead}{a} {b} {c}"
        if form == 4:
            return f"{lead or '+'}{a}{b}{c}"
        if form == 5:
            return f"({a}) {b}-{c}"
        if form == 6:
            return f"0{self.digits(3)}/{self.digits(6)}"
        return f"00{self.digits(2)} {a} {b} {c}"

    def other(self) -> str:
        """What looks a little like personal data and isn't."""
        kind = self.rng.integers(0, 14)
        d = self.digits
        hexes = "".join(self.rng.choice(list("0123456789abcdef"), self.pick(32, 40, 64)))
        return (
            lambda: f'token = "{hexes}"', lambda: hexes, lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(2)}",
            lambda: d(self.rng.integers(1, 8)), lambda: f"{d(2)}:{d(2)}", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"${d(3)}.{d(2)}",
            lambda: f"{d(2)}%", lambda: f"version {d(1)}.{d(1)}", lambda: f"@{self.word(3, 8)}", lambda: f"{self.word()} at {self.word()}",
            lambda: f"{self.word()} dot {self.word()}", lambda: f"({d(4)})",
        )[kind]()

    def example(self, size: int) -> tuple[str, np.ndarray]:
        text, tags = "", []
        plan = self.rng.integers(0, 3)
        while len(text) < size:
            roll = self.rng.random()
            if roll < 0.12 * plan:
                k = int(self.rng.integers(len(KINDS)))
                part = getattr(self, KINDS[k])()
                tags += [1 + 2 * k] + [2 + 2 * k] * (len(part) - 1)
            elif roll < 0.12 * plan + 0.06:
                part = self.other()
                tags += [0] * len(part)
            else:
                part = self.word()
                tags += [0] * len(part)
            gap = self.pick(" ", " ", " ", " ", " ", ", ", ". ", "\n", "*** ", "### ", "!! ", " | ", ": ")
            text, tags = text + part + gap, tags + [0] * len(gap)
        cut = int(self.rng.integers(0, max(1, len(text) - size + 1)))
        if self.rng.random() < 0.5:
            cut = 0
        return text[cut : cut + size], np.array(tags[cut : cut + size])


# --- network --------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Both directions of the LSTM are stacked on the first axis of their weights."""

    emb: np.ndarray
    wx: np.ndarray
    wh: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    trans: np.ndarray

    NAMES = ("emb", "wx", "wh", "bias", "out", "out_bias", "trans")

    @classmethod
    def fresh(cls, rng: np.random.Generator, dim: int = 12, hidden: int = 20) -> Tagger:
        f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        bias = np.zeros((2, 1, 4 * hidden), np.float32)
        bias[:, :, hidden : 2 * hidden] = 1
        return cls(f(N_CHARS, dim, scale=0.4), f(2, dim, 4 * hidden, scale=dim**-0.5), f(2, hidden, 4 * hidden, scale=hidden**-0.5), bias, f(2 * hidden, N_TAGS, scale=0.2), np.zeros(N_TAGS, np.float32), np.zeros((N_TAGS, N_TAGS), np.float32))

    def forward(self, ids: np.ndarray, keep: bool = False):
        """Tag scores (windows, characters, tags) of class ids (windows, characters)."""
        both = np.stack([ids, ids[:, ::-1]])
        n, size = ids.shape
        h_n = self.wh.shape[1]
        table = np.matmul(self.emb, self.wx) + self.bias  # (2, N_CHARS, 4H)
        h = np.zeros((2, n, h_n), np.float32)
        c = np.zeros_like(h)
        hs = np.empty((2, size, n, h_n), np.float32)
        steps = []
        for t in range(size):
            z = np.stack([table[0][both[0, :, t]], table[1][both[1, :, t]]]) + np.matmul(h, self.wh)
            s = _sigmoid(z[:, :, : 3 * h_n])
            i, f, o = s[:, :, :h_n], s[:, :, h_n : 2 * h_n], s[:, :, 2 * h_n :]
            g = np.tanh(z[:, :, 3 * h_n :])
            before = c
            c = f * c + i * g
            tc = np.tanh(c)
            if keep:
                steps.append((i, f, o, g, before, tc, h))
            h = o * tc
            hs[:, t] = h
        joint = np.concatenate([hs[0], hs[1, ::-1]], axis=2).transpose(1, 0, 2)
        scores = joint @ self.out + self.out_bias
        return (scores, joint, both, steps) if keep else scores

    def loss_and_gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        scores, joint, both, steps = self.forward(ids, keep=True)
        n, size, k = scores.shape
        rows = np.arange(n)
        # CRF: forward and backward sums give the marginals, which are the gradients
        a = np.empty_like(scores)
        a[:, 0] = scores[:, 0]
        for t in range(1, size):
            a[:, t] = _logsumexp(a[:, t - 1, :, None] + self.trans, 1) + scores[:, t]
        total = _logsumexp(a[:, -1], 1)
        d_trans = np.zeros_like(self.trans)
        d_scores = np.empty_like(scores)
        b = np.zeros((n, k), np.float32)
        d_scores[:, -1] = np.exp(a[:, -1] - total[:, None])
        for t in range(size - 2, -1, -1):
            joint_log = a[:, t, :, None] + self.trans + (scores[:, t + 1] + b)[:, None, :] - total[:, None, None]
            pair = np.exp(joint_log)
            d_trans += pair.sum(axis=0)
            d_scores[:, t] = pair.sum(axis=2)
            b = _logsumexp(self.trans + (scores[:, t + 1] + b)[:, None, :], 2)
        gold = scores[rows[:, None], np.arange(size), tags].sum(axis=1) + self.trans[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        loss = float((total - gold).mean())
        np.add.at(d_trans, (tags[:, :-1], tags[:, 1:]), -1)
        d_scores[rows[:, None], np.arange(size), tags] -= 1
        d_scores /= n
        grads = {"trans": d_trans / n, "out": joint.reshape(-1, joint.shape[2]).T @ d_scores.reshape(-1, k), "out_bias": d_scores.sum(axis=(0, 1))}
        d_joint = (d_scores @ self.out.T).transpose(1, 0, 2)
        h_n = self.wh.shape[1]
        d_hs = np.stack([d_joint[:, :, :h_n], d_joint[::-1, :, h_n:]])
        d_h, d_c = np.zeros((2, n, h_n), np.float32), np.zeros((2, n, h_n), np.float32)
        d_wh = np.zeros_like(self.wh)
        d_table = np.zeros((2, N_CHARS, 4 * h_n), np.float32)
        for t in range(size - 1, -1, -1):
            i, f, o, g, before, tc, h_before = steps[t]
            d_h = d_h + d_hs[:, t]
            d_c = d_c + d_h * o * (1 - tc * tc)
            dz = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - g * g)], axis=2)
            d_wh += np.matmul(h_before.transpose(0, 2, 1), dz)
            for d in (0, 1):
                one = np.zeros((N_CHARS, n), np.float32)
                one[both[d, :, t], rows] = 1
                d_table[d] += one @ dz[d]
            d_h = np.matmul(dz, self.wh.transpose(0, 2, 1))
            d_c = d_c * f
        grads |= {"wh": d_wh, "bias": d_table.sum(axis=1, keepdims=True), "wx": np.matmul(self.emb.T, d_table), "emb": np.matmul(d_table, self.wx.transpose(0, 2, 1)).sum(axis=0)}
        return loss, grads

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Best tags (sequences, characters) of tag scores."""
        n, size, k = scores.shape
        back = np.empty((n, size, k), np.int8)
        best = scores[:, 0]
        for t in range(1, size):
            options = best[:, :, None] + self.trans
            back[:, t] = options.argmax(axis=1)
            best = options.max(axis=1) + scores[:, t]
        tags = np.empty((n, size), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(size - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags


@functools.lru_cache(maxsize=2)
def trained(steps: int = 500, batch: int = 48, size: int = 64, seed: int = 7) -> Tagger:
    """Train with Adam on ``steps`` batches of generated texts; the same seed gives the same network."""
    maker = _Maker(seed)
    net = Tagger.fresh(np.random.default_rng(seed))
    moment = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in Tagger.NAMES}
    for step in range(1, steps + 1):
        made = [maker.example(size) for _ in range(batch)]
        ids = np.stack([char_classes(t) for t, _ in made])
        tags = np.stack([y for _, y in made])
        if step % 4 == 0:  # windows at the end of a text are padded
            for row in range(0, batch, 3):
                end = int(maker.rng.integers(10, size))
                ids[row, end:], tags[row, end:] = 0, 0
        _, grads = net.loss_and_gradients(ids, tags)
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        rate = 0.02 * (0.05 + 0.95 * (1 - step / steps))
        for k, g in grads.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            setattr(net, k, getattr(net, k) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6))
    return net


# --- texts ----------------------------------------------------------------------------------------


def stretches(text: str) -> list[tuple[int, int]]:
    """Where the text has to be scored: around triggers, merged where they meet."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


#: what an address has in some form, between words: a sign for at, and later one for a dot
_EMAIL_FORM = re.compile(r"[\w.%+-]*\w[^\w@]*(?:@|\bat\b)[^\w@]*\w[^@]*?(?:\.|\bdot\b)\W*\w[^@]*", re.I)
_NAME_SIGNS = "._%+-"


def _plausible(kind: str, text: str) -> bool:
    """What the network proposes has to be able to be of its kind; cards pass Luhn here too."""
    digits = _NOT_DIGITS.sub("", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and bool(re.search(r"[+()/ .-]", text.strip()))
    if kind == "ip":
        if ":" in text:
            return len(re.findall(r"[0-9a-fA-F]+", text)) == 8
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(map(_byte, parts))
    return len(text) <= WINDOW and bool(_EMAIL_FORM.fullmatch(text))


def _bounded(kind: str, text: str, a: int, b: int) -> Iterator[Span]:
    """The network's tags bound a span; words that they cut are taken whole, and signs at the ends left out."""
    least, most = max(0, a - WINDOW), min(len(text), b + WINDOW)
    joins = _NAME_SIGNS if kind == "email" else ""
    while a > least and (text[a - 1].isalnum() or text[a - 1] in joins) and (text[a].isalnum() or text[a] in joins):
        a -= 1
    while b < most and text[b].isalnum() and (text[b - 1].isalnum() or text[b - 1] in joins):
        b += 1
    part = text[a:b]
    start, end = a + len(part) - len(part.lstrip(" \t\n.,;:")), a + len(part.rstrip(" \t\n.,;:"))
    if start < end and _plausible(kind, text[start:end]):
        yield kind, start, end


def _tag_spans(tags: np.ndarray, text: str, at: int) -> Iterator[Span]:
    i, n = 0, len(tags)
    while i < n:
        if not tags[i]:
            i += 1
            continue
        kind, j = (tags[i] - 1) // 2, i + 1
        while j < n and tags[j] == 2 + 2 * kind:
            j += 1
        yield from _bounded(KINDS[kind], text, at + i, at + j)
        i = j


def model_spans(net: Tagger, texts: list[str]) -> list[list[Span]]:
    """The network's spans of each text."""
    found: list[list[Span]] = [[] for _ in texts]
    where = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches(t)]
    where.sort(key=lambda x: x[2] - x[1])
    middle = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
    at = 0
    while at < len(where):
        group, windows = [], 0  # of like lengths, so that little is padded
        while at < len(where) and (not group or windows < BATCH):
            group.append(where[at])
            windows += 1 + max(0, where[at][2] - where[at][1] - WINDOW + STRIDE - 1) // STRIDE
            at += 1
        longest = max(b - a for _, a, b in group)
        total = np.zeros((len(group), longest + WINDOW, N_TAGS), np.float32)
        weight = np.zeros((len(group), longest + WINDOW, 1), np.float32)
        plan, ids = [], []
        for g, (i, a, b) in enumerate(group):
            codes = np.zeros(longest + WINDOW, np.int64)
            codes[: b - a] = char_classes(texts[i][a:b])
            starts = range(0, max(1, b - a - WINDOW + STRIDE), STRIDE)
            plan += [(g, s) for s in starts]
            ids += [codes[s : s + WINDOW] for s in starts]
        for lo in range(0, len(ids), BATCH):
            scores = net.forward(np.stack(ids[lo : lo + BATCH]))
            for (g, s), own in zip(plan[lo : lo + BATCH], scores):
                total[g, s : s + WINDOW] += own * middle[:, None]
                weight[g, s : s + WINDOW] += middle[:, None]
        tags = net.decode((total / np.maximum(weight, 1e-6))[:, :longest])
        for (i, a, b), row in zip(group, tags):
            found[i] += _tag_spans(row[: b - a], texts[i], a)
    return found


def _beside(span: Span, base: list[Span]) -> bool:
    """Whether a span touches no base span, or holds those it touches, all of its kind, and more."""
    touched = [b for b in base if span[1] < b[2] and b[1] < span[2]]
    return all(b[0] == span[0] and span[1] <= b[1] and b[2] <= span[2] and b != span for b in touched)


def all_spans(net: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, both by kind as listed and then by start."""
    hit = [i for i, t in enumerate(texts) if TRIGGER.search(t)]
    added = dict(zip(hit, model_spans(net, [texts[i] for i in hit])))
    out = []
    for i, text in enumerate(texts):
        base = base_spans(text) if i in added else []
        new = [s for s in added.get(i, []) if _beside(s, base)]
        out.append((base, sorted({*base, *new}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets. Where spans overlap, what they
    cover together is replaced once, by the kind of the first."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of base spans by kind, base_sha256, spans, and
    masked (the text with all spans replaced; null for a null text), then the columns ``keep``.

    A null or empty text has no span. Offsets are code points. Repeated rows come out repeated, an
    empty table gives an empty table, and other columns are ignored.
    """
    net = docs.sparkSession.sparkContext.broadcast(trained())  # a few thousand numbers
    own = [f"_{i}" for i in range(len(keep or []))]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(x) for c, x in zip(keep or [], own)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, max(1, whole.num_rows), 1000):
                batch = whole.slice(lo, 1000)
                texts = batch.column(1).to_pylist()
                spans = all_spans(net.value, [t or "" for t in texts])
                cols = [pa.array([sum(s[0] == k for s in base) for base, _ in spans], pa.int64()) for k in KINDS]
                sha = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in spans]
                masked = [t if t is None or not s else mask(t, s) for t, (_, s) in zip(texts, spans)]
                arrays = [batch.column(0), *cols, pa.array(sha, pa.string()), pa.array([_joined(s) for _, s in spans], pa.string()), pa.array(masked, pa.string()), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "masked", *own])

    kinds = dict(rows.dtypes)
    schema = f"doc_id {kinds['doc_id']}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, masked string"
    found = rows.mapInArrow(run, ", ".join([schema, *(f"{x} {kinds[x]}" for x in own)]))
    return found.withColumnsRenamed(dict(zip(own, keep or [])))
