"""Secret scan by a linear-chain conditional random field over tokens, labels begin, inside and outside, decoded by Viterbi.

Features are a token's shape and those of the tokens beside it, the words beside it (hashed) and the file it stands in.
The field is trained here, on the driver, from windows of a bounded sample of documents and windows made by rule from a
fixed seed. All tokens of every text are scored; a bound from the weights proves which can't be part of a secret on the
best path (Field.possible), and Viterbi runs over the stretches between those.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.llm.pii import flat

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(rb"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
#: Words that announce a secret, in lower case.
CUES = (b"password", b"passwd", b"passphrase", b"pwd", b"secret", b"token", b"api_key", b"apikey", b"api-key", b"credential", b"bearer", b"auth")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def long_runs(shape: bytes, least: int) -> list[tuple[int, int]]:
    """Maximal runs without spaces of at least so many bytes."""
    stops = np.flatnonzero(np.frombuffer(shape, np.uint8) == 32)
    edges = np.concatenate([[-1], stops, [len(shape)]])
    at = np.flatnonzero(np.diff(edges) > least)
    return list(zip((edges[at] + 1).tolist(), edges[at + 1].tolist(), strict=True))


def places(b: bytes, words: tuple[bytes, ...]) -> list[tuple[int, int]]:
    """Where any of the words stands."""
    out = []
    for w in words:
        p = b.find(w)
        while p >= 0:
            out.append((p, p + len(w)))
            p = b.find(w, p + 1)
    return out


def base_spans(text: str, b: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) by start, then kind. An assign span is the whole match."""
    out = []
    low = b.lower()
    if any(w.encode() in low for w in WORDS):
        out += [(0, *m.span()) for m in ASSIGN.finditer(b) if len(m[1]) >= 6]
    if b"AKIA" in b:
        out += [(1, *m.span()) for m in ACCESS.finditer(b) if m.end() - m.start() >= 20]
    out += [(2, p, e) for p, e in long_runs(b.translate(HEX), 24)]
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


# --- tokens and their features ----------------------------------------------------------------------------------------
def _bytes_in(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


DIGIT, UPPER, HEXA = _bytes_in(b"0123456789"), _bytes_in(bytes(range(65, 91))), _bytes_in(b"0123456789abcdef")
LOWER = _bytes_in(bytes([*range(97, 123), *range(0xC0, 0x100)]))  # letters of Latin-1 beyond ASCII count as lower case
#: 0 white space, 1 bytes of words, 2 other: a token is a run of one class.
CLASS = np.where(_bytes_in(b" \t\n\r\x0b\x0c"), 0, np.where(DIGIT | UPPER | LOWER | _bytes_in(b"+/_.-"), 1, 2)).astype(np.uint8)
#: Values of each group of shape features: sign, opens with = or :, ends with a quote, length, share of digits, cases, all hexadecimal, letters and digits only, switches between digits and letters, entropy, AKIA, a cue within, a path.
RADIX = (2, 2, 2, 11, 5, 4, 2, 2, 7, 10, 2, 2, 2)
FIRST = np.cumsum((0, *RADIX))[:-1]
N_OWN, N_WORD, N_FILE = sum(RADIX), 1 << 12, 4
#: Shapes of the token, and of those before, after and two before; the file; the words before, after and two before.
SIZE = 4 * N_OWN + N_FILE + 3 * N_WORD
SHIFTS = ((1, -1), (2, 1), (3, -2))
FOLDED = np.array([48 if DIGIT[c] else c + 32 if UPPER[c] else c for c in range(256)], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
POWERS = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, np.uint64))
BLOCK = 1 << 20


@dataclass
class Tokens:
    """Starts, ends, packed shapes and word buckets of tokens."""

    starts: np.ndarray
    ends: np.ndarray
    shapes: np.ndarray
    words: np.ndarray


def tokens(b: bytes) -> Tokens:
    """All tokens of b, read in blocks that end between tokens."""
    parts, lo = [], 0
    while lo < len(b):
        hi = min(len(b), lo + BLOCK)
        while hi < len(b) and CLASS[b[hi]] == CLASS[b[hi - 1]] != 0:
            hi += 1
        parts.append(_block(b, lo, hi))
        lo = hi
    if not parts:
        return Tokens(*(np.zeros(0, np.int64) for _ in range(4)))
    return Tokens(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("starts", "ends", "shapes", "words")))


def _block(b: bytes, lo: int, hi: int) -> Tokens:
    a = np.frombuffer(b, np.uint8, hi - lo, lo)
    c = CLASS[a]
    cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(a)]])
    kept = c[starts] > 0
    starts, ends = starts[kept], ends[kept]
    if not len(starts):
        return Tokens(*(np.zeros(0, np.int64) for _ in range(4)))
    n = ends - starts

    def count(mask: np.ndarray, short: int = 0) -> np.ndarray:
        sums = np.zeros(len(a) + 1, np.int32)
        np.cumsum(mask, out=sums[1:], dtype=np.int32)
        return sums[np.maximum(ends - short, starts)] - sums[starts]

    digits, upper, lower = count(DIGIT[a]), count(UPPER[a]), count(LOWER[a])
    letters = digits + upper + lower
    below = a < 58
    switches = count(np.append(below[1:] != below[:-1], False), 1)
    of = np.repeat(np.arange(len(starts)), n)
    inside = c > 0
    pairs = np.sort(of << 8 | a[inside])
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    runs = np.diff(np.append(first, len(pairs)))
    entropy = np.log2(n) - np.bincount(pairs[first] >> 8, runs * np.log2(runs), len(n)) / n
    opens, closes = a[starts], a[ends - 1]
    cue, akia = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    text = b[lo:hi]
    for flags, said in ((cue, places(text.lower(), CUES)), (akia, places(text, (b"AKIA",)))):
        flags[np.searchsorted(starts, [s for s, _ in said], "right") - 1] = 1
    sign = letters == 0
    values = (
        sign, (opens == 61) | (opens == 58), (closes == 34) | (closes == 39), np.minimum(n // 4, 10),
        np.where(digits == 0, 0, np.where(digits * 4 < n, 1, np.where(digits * 2 < n, 2, np.where(digits < n, 3, 4)))), (upper > 0) + 2 * (lower > 0),
        count(HEXA[a]) == n, letters == n, np.minimum(switches // 2, 6), np.clip((2 * entropy + 1e-9).astype(np.int64), 0, 9), akia, cue, (count(a == 46) > 1) | (count(a == 47) > 0),
    )
    shapes = np.zeros(len(n), np.int64)
    for radix, value in zip(RADIX, values, strict=True):
        shapes *= radix
        shapes += value
    place = (np.flatnonzero(inside) - starts[of]) & 63
    hashes = np.add.reduceat(FOLDED[a[inside]] * POWERS[place], np.concatenate([[0], np.cumsum(n)[:-1]]))
    return Tokens(starts + lo, ends + lo, shapes, (hashes >> np.uint64(40)).astype(np.int64) & (N_WORD - 1))


def _unpacked(shapes: np.ndarray) -> np.ndarray:
    """Shape features, one of each group."""
    out, rest = np.empty((len(shapes), len(RADIX)), np.int64), shapes
    for k in range(len(RADIX) - 1, -1, -1):
        out[:, k] = rest % RADIX[k] + FIRST[k]
        rest = rest // RADIX[k]
    return out


def _file(b: bytes) -> int:
    """What kind of file it is, by the share of signs that code has."""
    signs = b.count(b"=") + b.count(b"{") + b.count(b";") + b.count(b"(")
    share = signs / max(1, len(b))
    return 0 if share < 0.001 else 1 if share < 0.005 else 2 if share < 0.02 else 3


def features(t: Tokens, file_kind: int) -> list[list[int]]:
    """All features of each token of a text."""
    own = _unpacked(t.shapes).tolist()
    out = [[*f, 4 * N_OWN + file_kind] for f in own]
    for part, shift in SHIFTS:
        for k in range(max(0, -shift), min(len(own), len(own) - shift)):
            out[k] += [part * N_OWN + i for i in own[k + shift]]
            out[k].append(4 * N_OWN + N_FILE + (part - 1) * N_WORD + int(t.words[k + shift]))
    return out


class Field:
    """weights: features x labels (begin, inside, outside); moves: label after label."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def decode(self, t: Tokens, file_kind: int) -> list[int]:
        """The best labels by Viterbi. Inside follows only begin or inside."""
        return self.path(np.array([self.weights[f].sum(0) for f in features(t, file_kind)])) if len(t.starts) else []

    def emitted(self, t: Tokens, texts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The scores of the labels of tokens of several texts. texts: the text of each token, ascending; kinds: each text's file."""
        distinct, of = np.unique(t.shapes, return_inverse=True)
        parts = self.weights[: 4 * N_OWN].reshape(4, N_OWN, 3)
        rows = parts[:, _unpacked(distinct)].sum(2)
        words = self.weights[4 * N_OWN + N_FILE :].reshape(3, N_WORD, 3)
        e = rows[0, of] + self.weights[4 * N_OWN : 4 * N_OWN + N_FILE][kinds[texts]]
        n = len(of)
        for part, shift in SHIFTS:
            to, at = slice(max(0, -shift), max(0, min(n, n - shift))), slice(max(0, shift), max(0, min(n, n + shift)))
            e[to] += (rows[part, of[at]] + words[part - 1, t.words[at]]) * (texts[to] == texts[at])[:, None]
        return e

    def path(self, emitted: np.ndarray, after: bool = False, before: bool = False) -> list[int]:
        """The best labels of tokens with these scores, where need be after or before a token outside."""
        e = emitted.tolist()
        (bb, bi, bo), (ib, ii, io), (ob, _, oo) = self.moves.tolist()
        b, i, o = e[0][0] + after * ob, -1e9, e[0][2] + after * oo
        back = []
        for x, y, z in e[1:]:
            to_b = max((b + bb, 0), (i + ib, 1), (o + ob, 2))
            to_i = max((b + bi, 0), (i + ii, 1))
            to_o = max((b + bo, 0), (i + io, 1), (o + oo, 2))
            b, i, o = to_b[0] + x, to_i[0] + y, to_o[0] + z
            back.append((to_b[1], to_i[1], to_o[1]))
        score = np.array([b + before * bo, i + before * io, o + before * oo])
        out = [int(score.argmax())]
        for came in reversed(back):
            out.append(came[out[-1]])
        return out[::-1]

    def possible(self, gain: np.ndarray) -> np.ndarray:
        """Which tokens may be part of a secret on the best path; all others are outside on it.

        gain: scores of begin and inside less those of outside. A stretch of tokens in secrets gains at most the sum of the
        tokens' greater gains with the best moves, and one way out, over being outside, so only tokens in a stretch whose
        bound isn't below 0 are left.
        """
        (bb, bi, bo), (ib, ii, io), (ob, _, oo) = self.moves.tolist()
        u = np.maximum(gain[:, 0] + (max(ob, bb, ib) - oo), gain[:, 1] + (max(bi, ii) - oo))
        u[0] = gain[0, 0]  # no move leads to the first
        sums = np.cumsum(u)
        before = np.concatenate([[0.0], sums[:-1]])
        best = np.maximum.accumulate(sums[::-1])[::-1] - np.minimum.accumulate(before)  # of the stretches through each token
        return best + max(0.0, bo - oo, io - oo) > -1e-6


Window = tuple[Tokens, int, list[int]]


def train(windows: list[Window], epochs: int = 120, rate: float = 0.1, decay: float = 3e-4, caution: float = 2.0) -> Field:
    """Maximum conditional likelihood with a Gaussian prior by Adam; forward and backward run over all windows at once.

    Half of the windows hold secrets, texts far fewer: caution is what the log odds of begin lose for that.
    """
    n, long = len(windows), max(len(w[2]) for w in windows)
    lens = np.array([len(w[2]) for w in windows])
    window, none = np.repeat(np.arange(n), lens), np.zeros(0, np.int64)
    at = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    every = Tokens(none, none, np.concatenate([w[0].shapes for w in windows]), np.concatenate([w[0].words for w in windows]))
    kinds, labels = np.array([w[1] for w in windows]), np.concatenate([np.array(w[2], np.int64) for w in windows])
    mask = np.zeros((n, long), bool)
    mask[window, at] = True
    one = np.zeros((n, long, 3))
    one[window, at, labels] = 1
    distinct, of = np.unique(every.shapes, return_inverse=True)
    names = _unpacked(distinct).ravel()

    def summed(which: np.ndarray, p: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(which, p[:, k], size) for k in range(3)], 1)

    def by_feature(p: np.ndarray) -> np.ndarray:
        """Sums of p (tokens x labels) over the tokens that have each feature."""
        shapes = lambda which, q: summed(names, np.repeat(summed(which, q, len(distinct)), len(RADIX), 0), N_OWN)
        parts, words = [shapes(of, p)], []
        for _, shift in SHIFTS:
            to = np.flatnonzero((at + shift >= 0) & (at + shift < lens[window]))
            parts.append(shapes(of[to + shift], p[to]))
            words.append(summed(every.words[to + shift], p[to], N_WORD))
        return np.concatenate([*parts, summed(kinds[window], p, N_FILE), *words]).ravel()

    theta = np.zeros(SIZE * 3 + 9)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros_like(theta)
    seen[: SIZE * 3] = by_feature(one[window, at])
    for k in range(1, long):
        seen[SIZE * 3 :] += (one[:, k - 1].T @ one[:, k]).ravel()
    allowed = np.ones((3, 3))
    allowed[2, 1] = 0
    for step in range(1, epochs + 1):
        field, moves = Field(theta[: SIZE * 3].reshape(SIZE, 3), theta[SIZE * 3 :].reshape(3, 3)), np.exp(theta[SIZE * 3 :].reshape(3, 3)) * allowed
        e = np.zeros((long, n, 3))
        e[at, window] = field.emitted(every, window, kinds)
        e = np.exp(e - e.max(2, keepdims=True))
        e[0, :, 1] = 0
        alpha, beta, scale = e.copy(), np.ones((long, n, 3)), np.ones((long, n, 1))
        for k in range(long):
            if k:
                alpha[k] *= alpha[k - 1] @ moves
            scale[k] = alpha[k].sum(1, keepdims=True)
            alpha[k] /= scale[k]
        for k in range(long - 2, -1, -1):
            beta[k] = np.where(mask[:, k + 1, None], (e[k + 1] * beta[k + 1] / scale[k + 1]) @ moves.T, 1)
        g = np.zeros_like(theta)
        g[: SIZE * 3] = by_feature((alpha * beta)[at, window])
        later = (e * beta / scale)[1:] * mask.T[1:, :, None]
        g[SIZE * 3 :] = (np.einsum("kni,knj->ij", alpha[:-1], later) * moves).ravel()
        g = (g - seen) / n + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = theta[: SIZE * 3].reshape(SIZE, 3).copy()
    weights[4 * N_OWN : 4 * N_OWN + N_FILE, 0] -= caution
    return Field(weights, theta[SIZE * 3 :].reshape(3, 3).copy())


# --- training windows -------------------------------------------------------------------------------------------------
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
MIXED = LETTERS + LETTERS.upper() + DIGITS
NAMES = ("password", "pwd", "passphrase", "secret", "token", "api key", "api_key", "client_secret", "access key", "credential", "private key", "auth token", "bearer", "key", "signing key", "login")
#: Forms of secrets made by rule; a test holds recall by these.
FORMS = {
    "hex": lambda r: _some(r, "0123456789abcdef", r.randint(20, 64)),
    "access": lambda r: _some(r, LETTERS.upper(), 4) + _some(r, LETTERS.upper() + DIGITS, r.randint(14, 20)),
    "base64": lambda r: _some(r, MIXED + "+/", r.randint(20, 64)) + r.choice(["", "", "=", "=="]),
    "prefixed": lambda r: _some(r, LETTERS, r.randint(2, 4)) + r.choice("_-") + _some(r, MIXED, r.randint(16, 40)),
    "dotted": lambda r: ".".join(_some(r, MIXED + "-_", r.randint(12, 40)) for _ in range(3)),
    "letters": lambda r: "".join(_some(r, LETTERS, r.randint(3, 7)).capitalize() for _ in range(2)),
    "phrase": lambda r: _some(r, LETTERS, r.randint(4, 9)) + _some(r, DIGITS, r.randint(1, 5)),
}
#: Forms that tell nothing without a word that announces a secret.
TIED = ("letters", "phrase")


def _some(rng: random.Random, chars: str, n: int) -> str:
    return "".join(rng.choice(chars) for _ in range(n))


def _plain(r: random.Random) -> str:
    """What looks like a secret and is none: numbers, dates, addresses, paths, versions, names, long words."""
    number = lambda lo, hi: _some(r, DIGITS, r.randint(lo, hi))
    word = lambda lo, hi: _some(r, LETTERS, r.randint(lo, hi))
    return r.choice([
        lambda: number(1, 19), lambda: number(1, 19) + r.choice([".", ",", "%", "$", "!"]), lambda: r.choice("- ").join(number(4, 4) for _ in range(4)), lambda: word(3, 9) + "." + number(1, 3) + "@" + word(3, 9) + "." + word(2, 3), lambda: ".".join(number(1, 3) for _ in range(4)),
        lambda: "+" + number(1, 3) + " " + number(3, 3) + " " + number(6, 8), lambda: "(" + number(3, 3) + ") " + number(3, 3) + "-" + number(4, 4), lambda: word(14, 28), lambda: word(3, 9).upper(), lambda: word(3, 8) + "_" + word(3, 8) + "_" + word(2, 5), lambda: word(3, 7) + word(3, 7).capitalize(), lambda: "https://" + word(4, 12) + "." + word(2, 3) + "/" + word(2, 9) + "/" + number(1, 8), lambda: "/" + "/".join(word(2, 8) for _ in range(3)) + "." + word(2, 3),
        lambda: "%04d-%02d-%02d" % (r.randint(1900, 2100), r.randint(1, 12), r.randint(1, 28)), lambda: "%02d:%02d:%02d" % (r.randint(0, 23), r.randint(0, 59), r.randint(0, 59)), lambda: "v" + ".".join(number(1, 2) for _ in range(3)), lambda: word(2, 5).upper() + "-" + number(2, 6), lambda: word(5, 12).capitalize() + "-" + word(4, 10), lambda: _some(r, "0123456789abcdef", 7),
    ])()


def made(seed: int, n: int) -> list[Window]:
    return [w for _, w in made_by_form(seed, n)]


def made_by_form(seed: int, n: int) -> list[tuple[str, Window]]:
    """Windows by rule with their form ('' for none): every other one holds a secret, announced or not; the others hold what is like it, or such an announcement with plain words after it."""
    rng, out = random.Random(seed), []
    word = lambda: _some(rng, LETTERS, rng.randint(1, 11)) + rng.choice(["", "", "", "", ",", "."])
    for k in range(n):
        before, after = [word() for _ in range(rng.randint(2, 10))], [word() for _ in range(rng.randint(2, 10))]
        name = rng.choice(NAMES)
        name = rng.choice([name, name.upper(), name.capitalize()])
        form, quote = "", rng.choice(["", "", '"', "'"])
        if k % 2:
            form = rng.choice(sorted(FORMS))
            value = FORMS[form](rng)
            told = form in TIED or rng.random() < 0.6
            lead = name + rng.choice([": ", " = ", "=", ":", " ", " is ", '": ']) if told else rng.choice(["", "id ", "with ", "= "])
        elif k % 4:
            value, lead = _plain(rng), rng.choice(["", "", "id ", "no. ", "page ", "at ", "= "])
        else:
            value, lead, quote = word(), rng.choice([name + " ", name + " of the ", "the " + name + " was ", name + ". "]), ""
        b = flat(" ".join(before) + " " + lead + quote + value + quote + " " + " ".join(after))
        start = len(" ".join(before)) + 1 + len(lead) + len(quote)
        out.append((form, labelled(b, [(start, start + len(value))] if form else [])))
    return out


def labelled(b: bytes, secrets: list[tuple[int, int]], lo: int = 0, hi: int | None = None, kind: int | None = None) -> Window:
    """The tokens lo to hi of b as a window; a secret's first token is its begin."""
    t = tokens(b)
    t = Tokens(*(x[lo:hi] for x in (t.starts, t.ends, t.shapes, t.words)))
    labels, begun = [], set()
    for s, e in zip(t.starts.tolist(), t.ends.tolist(), strict=True):
        own = next((x for x in secrets if x[0] < e and s < x[1]), None)
        labels.append(2 if own is None else 1 if own in begun else 0)
        begun.add(own)
    return t, _file(b) if kind is None else kind, labels


def windows(text: str, per_text: int, around: int) -> list[Window]:
    """Windows of a text: around the rules' secrets, and as many around other places, drawn by a seed from the text. A cue of a rule is masked in every second window, or the field would learn the rule."""
    b = flat(text)
    base = base_spans(text, b)
    values = [(ASSIGN.match(b, s).start(1), e) if k == 0 else (s, e) for k, s, e in base]
    rng, out = random.Random(len(b)), []
    t = tokens(b)
    if not len(t.starts):
        return []
    rng.shuffle(values)
    marks = [int(np.searchsorted(t.ends, s, "right")) for s, _ in values[:per_text]]
    digits = np.flatnonzero((t.shapes // np.prod(RADIX[5:])) % RADIX[4] > 0)
    others = [int(rng.choice(digits)) for _ in range(per_text) if len(digits)] + [rng.randrange(len(t.starts)) for _ in range(per_text)]
    for n, k in enumerate(marks + others[: max(2, len(marks))]):
        lo, hi = max(0, k - around), min(len(t.starts), k + around)
        s, e = int(t.starts[lo]), int(t.ends[hi - 1])
        part = b[s:e]
        inside = [(x - s, y - s) for x, y in values if x < e and s < y]
        if n % 2 and inside:
            hidden = bytearray(part)
            for s, e in places(part.lower(), CUES):
                if all(e <= x or y <= s for x, y in inside):
                    hidden[s:e] = bytes(rng.choice(LETTERS.encode()) for _ in range(e - s))
            part = bytes(hidden)
            inside = [(x, y) for x, y in inside if y - x >= 16]
        out.append(labelled(part, inside, kind=_file(b)))
    return out


WINDOW = "h long, k int, shapes array<bigint>, words array<bigint>, kind int, labels array<bigint>"


def _windows(per_text: int, around: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(h, k, t.shapes.tolist(), t.words.tolist(), kind, labels) for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True) for k, (t, kind, labels) in enumerate(windows(text, per_text, around))]
            if out:
                longs = pa.list_(pa.int64())
                kinds = (pa.int64(), pa.int32(), longs, longs, pa.int32(), longs)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["h", "k", "shapes", "words", "kind", "labels"])

    return run


def fitted(docs: DataFrame, sample: int = 2000, most: int = 2000, per_text: int = 4, around: int = 12) -> Field:
    """The field, from most windows of about sample documents, and as many made by rule.

    Documents come in by a hash of their text, at a rate that the number of documents gives; each gives per_text windows
    around rule matches at most and as many others (two if it has none), of around tokens on each side, so what comes to
    the driver is bounded by the sample and not by texts.
    """
    n = max(1, docs.count())
    text = F.coalesce("text", F.lit(""))
    h = F.pmod(F.xxhash64(text), F.lit(1 << 31))
    rows = docs.select(text.alias("text"), h.alias("h")).where(F.col("h") < F.lit(min(1 << 31, (sample << 31) // n)))
    found = rows.dropDuplicates(["h"]).mapInArrow(_windows(per_text, around), WINDOW).orderBy("h", "k").limit(most).collect()
    none = np.zeros(0, np.int64)
    own = [(Tokens(np.array(r["shapes"]), none, np.array(r["shapes"]), np.array(r["words"])), r["kind"], r["labels"]) for r in found]
    return train([*made(7, most), *own])


# --- spans ------------------------------------------------------------------------------------------------------------
def found(all_bytes: list[bytes], field: Field, bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Of each text, the spans that the field tags and no base span covers or touches. Texts are scored together."""
    edges = np.cumsum([0, *(len(b) + 1 for b in all_bytes)])
    t = tokens(b"\n".join(all_bytes))
    out: list[list[tuple[int, int, int]]] = [[] for _ in all_bytes]
    if not len(t.starts):
        return out
    of = np.searchsorted(edges, t.starts, "right") - 1
    e = field.emitted(t, of, np.array([_file(b) for b in all_bytes]))
    gain = e[:, :2] - e[:, 2:]
    cuts = np.searchsorted(of, np.arange(len(all_bytes) + 1)).tolist()
    for k, (first, stop) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if first == stop:
            continue
        turns = np.flatnonzero(np.diff(field.possible(gain[first:stop]), prepend=False, append=False)) + first
        for lo, hi in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            labels = field.path(e[lo:hi], lo > first, hi < stop)
            at = 0
            while at < len(labels):
                if labels[at] != 0:
                    at += 1
                    continue
                last = at
                while last + 1 < len(labels) and labels[last + 1] == 1:
                    last += 1
                s, x = int(t.starts[lo + at] - edges[k]), int(t.ends[lo + last] - edges[k])
                if not any(a < x and s < z for _, a, z in bases[k]):
                    out[k].append((3, s, x))
                at = last + 1
    return out


def _scan(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]))
        for batch in batches:
            bases, more, waiting, size = [], [], [], 0
            every = batch.column("text").to_pylist()
            for n, text in enumerate(every, 1):
                waiting.append(flat(text))
                bases.append(base_spans(text, waiting[-1]))
                size += len(text)
                if size >= BLOCK or n == len(every):
                    more += found(waiting, shared.value, bases[len(more) :])
                    waiting, size = [], 0
            spans = [sorted([*a, *b], key=lambda x: (x[1], x[0])) for a, b in zip(bases, more, strict=True)]
            as_rows = lambda all_spans: pa.array([[dict(zip("kse", x, strict=True)) for x in own] for own in all_spans], kind)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "base": as_rows(bases), "spans": as_rows(spans)})

    return run


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base and spans of each row of docs (doc_id, text): arrays of (k: kind, s: start, e: end) by start, then kind.

    base are the rules' spans; spans adds those that the field tags elsewhere (kind crf). Null texts are empty and have no
    spans; a null doc_id is kept; repeated rows give a row each; an empty table gives none (and the field is then trained
    on windows made by rule alone).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(field or fitted(docs))
    kind = "array<struct<k:int,s:int,e:int>>"
    return rows.mapInArrow(_scan(shared), f"doc_id long, base {kind}, spans {kind}")


def named(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
