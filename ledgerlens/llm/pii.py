"""Personal data: generated candidates, boosted trees, calibrated thresholds.

The base patterns' spans always stay. High-recall generators propose further,
overlapping spans of the four kinds in other formats (obfuscated or spaced emails,
IPv6 with and without ::, every run of digit groups that could be a card or a phone).
Gradient-boosted trees score each by format and context features; the scores are
calibrated, and a kind's threshold is the least that keeps its precision at PRECISION; what
stands in a run of further digits has one of its own.
Of overlapping selected spans the most probable stays; none overlaps a base span.

The trees are trained here, on TRAIN_ROWS labelled rows of a seeded generator of
positive and negative examples of each kind. Calibration and thresholds come from a
second generator: other formats, which the trees have not seen, in other prose. No
corpus row is used, so results don't depend on the corpus. Candidates, features and
the choice among overlaps take time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS, SEED = 6000, 20240613
#: Least precision of spans that stand apart, and of those in a run of further digits, where a wrong one is mostly part of personal data too.
PRECISION = (0.98, 0.85)
TREES, DEPTH, RATE, BINS = 100, 4, 0.2, 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


_NO_DIGIT = re.compile(r"[^0-9]+")


def _digits(s: str) -> str:
    return _NO_DIGIT.sub("", s)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each @: the run of local characters before it, as far as the last match's end, and the domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base findings by kind, then start."""
    out = [("email", a, b) for a, b in base_emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _CHAIN.finditer(text):
            parts = m[0].split(".")
            at = m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = at + sum(map(len, four)) + 3
                if all(map(_octet, four)):
                    out.append(("ip", at, end))
                at = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# -- candidates --------------------------------------------------------------
_AT = re.compile(r"\x20?@\x20?|\x20?[(\[{]\x20?(?:at|AT)\x20?[)\]}]\x20?|\x20(?:at|AT)\x20")
_DOT = r"(?:\.|\x20?[(\[{]\x20?(?:dot|DOT)\x20?[)\]}]\x20?|\x20(?:dot|DOT)\x20)"
_LOOSE_DOMAIN = re.compile(rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]++(?![0-9A-Za-z])")
_GROUPS = re.compile(r"[0-9]++(?:[\x20()./-]{1,2}[0-9]++)*+")
_GROUP = re.compile(r"[0-9]++")
#: Digits of a phone and of a card number.
PHONE_DIGITS, CARD_DIGITS = (7, 15), (12, 19)


def candidates(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "@" in text or "at" in text or "AT" in text:
        end = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            d = _LOOSE_DOMAIN.match(text, m.end()) if start < m.start() else None
            if d:
                out.append(("email", start, d.end()))
                end = m.end()
    if ":" in text:
        out += [("ip", m.start(), m.end()) for m in _IPV6.finditer(text) if m.end() - m.start() < 64]
    for m in _GROUPS.finditer(text):
        if m.end() - m.start() < PHONE_DIGITS[0]:
            continue
        groups = [g.span() for g in _GROUP.finditer(text, m.start(), m.end())]
        bounds = range(len(groups))
        if sum(z - a for a, z in groups) > CARD_DIGITS[1]:  # more than one number: they begin and end at spaces or brackets, if there are some
            apart = [k for k in bounds if k == 0 or not text[groups[k - 1][1] : groups[k][0]].strip(" ()") and text[groups[k][0] - 1] in " (" or text[groups[k - 1][1]] == " "]
            bounds = apart if len(apart) > 1 else bounds
        stops = [*bounds[1:], len(groups)]
        for k, i in enumerate(bounds):
            first = a = groups[i][0]
            while a > 0 and text[a - 1] == "(" and a > m.start() - 2:
                a -= 1
            if a > 0 and text[a - 1] == "+" and i == 0:
                a -= 1
            n, at = 0, i
            for x in range(k, len(stops)):
                stop = stops[x]
                n += sum(z - y for y, z in groups[at:stop])
                at = stop
                if n > CARD_DIGITS[1]:
                    break
                end = groups[stop - 1][1]
                if PHONE_DIGITS[0] <= n <= PHONE_DIGITS[1]:
                    out.append(("phone", a, end))
                if n >= CARD_DIGITS[0]:
                    out.append(("card", first, end))
    return out


# -- features ----------------------------------------------------------------
#: Words that speak for a kind, and against any: fixed values.
_CUES = {
    "email": ("mail", "email", "contact", "write", "reach", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login", "addr", "adresse", "from"),
    "card": ("card", "visa", "credit", "payment", "amex", "cc", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "dial", "ring", "telefon", "appelez", "rufen"),
}
_AGAINST = ("order", "invoice", "isbn", "version", "serial", "ref", "total", "page", "id", "tracking", "eur", "usd", "item", "lot", "mac", "time", "key", "no", "fingerprint")
_CONTEXT = 40
_SEPARATORS = " ().-/ "
_WORD = re.compile(r"[^\W\d_]+")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}.*|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2}.*|(?:19|20)[0-9]{2}.{1,3}(?:19|20)[0-9]{2}")
_TLD = re.compile(r"(?:\.|dot[)\]} ]*)(?:com|org|net|edu|gov|io|de|fr|es|info|co|uk|eu)$", re.IGNORECASE)


def _touching(text: str, at: int, step: int) -> float:
    """Whether a digit stands beyond at most two separators: the span is part of a longer run."""
    for _ in range(3):
        if not 0 <= at < len(text):
            return 0.0
        if "0" <= text[at] <= "9":
            return 1.0
        if text[at] not in _SEPARATORS:
            return 0.0
        at += step
    return 0.0


def _valid_ipv6(s: str) -> bool:
    halves = s.split("::")
    groups = [g for h in halves for g in h.split(":") if h]
    return len(halves) <= 2 and all(1 <= len(g) <= 4 for g in groups) and (len(groups) == 8 if len(halves) == 1 else 1 <= len(groups) <= 7)


@lru_cache(maxsize=1 << 14)
def _shape(kind: str, shape: str) -> tuple[float, ...]:
    """Features of a form alone: all digits are 0 in it."""
    groups = [len(g) for g in _GROUP.findall(shape)]
    parts = shape.split(":")
    return (
        *(float(kind == k) for k in KINDS),
        float(sum(groups)),
        float(len(shape)),
        float(len(groups)),
        float(max(groups, default=0)),
        float(min(groups, default=0)),
        float(len({c for c in shape if c in _SEPARATORS})),
        float("(" in shape and ")" in shape),
        float(shape.count("(") != shape.count(")")),
        float(len(set(groups)) == 1),
        float(groups[-2:] == [3, 4] or groups[-2:] == [4, 4]),
        float("." in shape and "-" not in shape and "(" not in shape),
        float("@" in shape),
        float("(" in shape or "[" in shape or "{" in shape),
        float(" at " in shape or " AT " in shape),
        float(" dot " in shape or " DOT " in shape),
        float(shape.count(":")),
        float(kind == "ip" and _valid_ipv6(shape)),
        float(max(map(len, parts)) if kind == "ip" else 0),
        float(kind == "ip" and all(len(p) == 2 for p in parts)),
    )


@lru_cache(maxsize=1 << 12)
def _cued(kind: str, words: tuple[str, ...]) -> tuple[float, float]:
    return (
        float(any(w.startswith(c) for w in words for c in _CUES[kind] if len(c) > 2) or any(w in _CUES[kind] for w in words)),
        float(any(w == c or len(c) > 3 and w.startswith(c) for w in words for c in _AGAINST)),
    )


_ZEROS = str.maketrans("123456789", "000000000")


def features(text: str, kind: str, a: int, b: int) -> tuple[float, ...]:
    s = text[a:b]
    number = kind in ("card", "phone")
    shape = s.translate(_ZEROS) if number or kind == "ip" else s
    words = tuple(_WORD.findall(text[max(0, a - _CONTEXT) : a].lower())[-4:])
    d = _digits(s) if kind == "card" else ""
    prev, after = text[a - 1 : a], text[b : b + 1]
    return (
        *_shape(kind, shape),
        *_cued(kind, words),
        1.0 if number and (s[0] == "+" or s[:2] == "00") else 0.0,
        1.0 if number and (s[0] == "0" or s[:2] == "(0") else 0.0,
        1.0 if kind == "card" and luhn(d) else 0.0,
        1.0 if d[:1] in ("3", "4", "5", "6") and d else 0.0,
        1.0 if number and b - a < 25 and _DATE.fullmatch(s) else 0.0,
        1.0 if prev and (prev.isalnum() or prev in ("#", "$", "€", "_")) else 0.0,
        1.0 if after and (after.isalnum() or after in ("%", "_")) else 0.0,
        _touching(text, a - 1, -1) if number else 0.0,
        _touching(text, b, 1) if number else 0.0,
        1.0 if kind == "email" and _TLD.search(s) else 0.0,
        1.0 if kind == "ip" and any(c in "abcdefABCDEF" for c in s) else 0.0,
    )


#: Places of the two features that tell whether further digits touch a span.
_WITHIN = [-4, -3]


# -- boosted trees -----------------------------------------------------------
class Boosted:
    """Logistic gradient boosting with histogram splits; full trees of a fixed depth, leaves by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> None:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self._binned(x)
        self.bias = float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
        score = np.full(len(y), self.bias)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, BINS + 1, np.int64)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                for n in range((1 << level) - 1, (2 << level) - 1):
                    at = np.flatnonzero(node == n)
                    if len(at) >= 20:
                        feature[n], cut[n] = self._split(binned[at], grad[at], hess[at])
                node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - ((1 << depth) - 1)
            value = rate * np.bincount(leaf, grad, 1 << depth) / (np.bincount(leaf, hess, 1 << depth) + 1.0)
            score += value[leaf]
            self.trees.append((feature, cut, value))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    @staticmethod
    def _split(b: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, int]:
        """The feature and bin with the highest gain; no cut if none has any."""
        n, bins = b.shape[1], BINS + 1
        cells = (b + np.arange(n) * bins).ravel()
        left, w = (np.cumsum(np.bincount(cells, np.repeat(v, n), n * bins).reshape(n, bins), axis=1) for v in (grad, hess))
        total, weight = grad.sum(), hess.sum()
        gain = left**2 / (w + 1) + (total - left) ** 2 / (weight - w + 1) - total**2 / (weight + 1)
        f, k = np.unravel_index(int(gain.argmax()), gain.shape)
        return (int(f), int(k)) if gain[f, k] > 1e-6 else (0, bins)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while node[0] < len(feature):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out


class Detector:
    """Trees, the calibration of their scores, and each kind's threshold."""

    def __init__(self, rows: int = TRAIN_ROWS, seed: int = SEED) -> None:
        x, y, _ = _labelled(rows, seed, "train")
        self.trees = Boosted(x, y)
        x, truth, spans = _labelled(rows, seed + 1, "calibrate")
        held = self.trees.score(x)
        self.slope, self.shift = _platt(held, truth)
        p = self._calibrated(held)
        # What is left when the most probable of overlapping candidates stays.
        by_text: dict[int, list] = {}
        for k, (t, kind, a, b) in enumerate(spans):
            by_text.setdefault(t, []).append((-p[k], a, b, kind, k))
        left = np.array([c[4] for mine in by_text.values() for c in _apart(sorted(mine))])
        kind_of, within = np.array([KINDS.index(spans[k][1]) for k in left]), x[left][:, _WITHIN].any(axis=1)
        of = [[left[(kind_of == k) & (within == inside)] for inside in (False, True)] for k in range(len(KINDS))]
        self.thresholds, self.within = ({kind: _threshold(p[of[k][n]], truth[of[k][n]], PRECISION[n]) for k, kind in enumerate(KINDS)} for n in (0, 1))

    def _calibrated(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * score + self.shift)))

    def passes(self, kind: str, row: tuple[float, ...], p: float) -> bool:
        """Whether a span counts; one that further digits touch, as in a list of numbers, has a threshold of its own."""
        return p >= (self.within if row[_WITHIN[0]] or row[_WITHIN[1]] else self.thresholds)[kind]

    def probabilities(self, rows: list[tuple[float, ...]]) -> np.ndarray:
        return self._calibrated(self.trees.score(np.array(rows)))


def _labelled(rows: int, seed: int, source: str) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str, int, int]]]:
    """Features, labels, and text number and span, of each row's example and of all that the generators propose in its text.

    Of these, what is an example of a positive row of that text is one too; parts of it,
    other kinds and all else are not.
    """
    x, y, where = [], [], []
    texts, spans, good = examples(rows, seed, source)
    positive: dict[str, set] = {}
    for t, s, g in zip(texts, spans, good):
        positive.setdefault(t, set()).update([s] * g)
    probes: dict[str, set] = {}
    for t, s in zip(texts, spans):
        probes.setdefault(t, set()).add(s)
    for k, (t, own) in enumerate(probes.items()):
        for c in sorted({*own, *candidates(t)}):
            x.append(features(t, *c))
            y.append(float(c in positive[t]))
            where.append((k, *c))
    return np.array(x), np.array(y), where


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * score + b)))
        g = np.array([((p - y) * score).sum() + 1e-3 * (a - 1), (p - y).sum() + 1e-3 * b])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * score * score).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _threshold(p: np.ndarray, y: np.ndarray, least: float) -> float:
    """The least of at least one half that keeps precision; over 1 if none does."""
    order = np.argsort(-p, kind="stable")
    precision = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ok = np.flatnonzero((precision >= least) & (p[order] >= 0.5))
    return float(p[order][ok[-1]]) if len(ok) else 1.1


#: Words of the two generators' prose: fixed values.
_FILL = {
    "train": ("the", "of", "and", "with", "then", "sent", "new", "see", "for", "at", "by", "was", "here", "our", "from"),
    "calibrate": ("le", "und", "que", "les", "der", "with", "est", "por", "this", "nicht", "une", "para", "at", "are", "into", "mais", "y", "von"),
}


def examples(rows: int, seed: int, source: str = "train") -> tuple[list[str], list[tuple[str, int, int]], list[int]]:
    """Texts, one span of each, and whether it is personal data; no format of one source is in the other."""
    rng = Random(seed)
    training = source == "train"
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    tld = lambda: rng.choice(("com", "org", "net", "de", "fr", "es", "io", "edu"))
    group = lambda: f"{rng.randrange(65536):x}"
    nonzero = lambda n: rng.choice("123456789") + num(n - 1)

    def card(n: int) -> str:
        body = ("3" if n < 16 else rng.choice("3456")) + num(n - 2)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def spaced(d: str, sep: str, sizes: tuple[int, ...]) -> str:
        out, at = [], 0
        for k in sizes:
            out.append(d[at : at + k])
            at += k
        return sep.join([*out, d[at:]]) if at < len(d) else sep.join(out)

    def positive(kind: str) -> str:
        if kind == "email":
            local = f"{word()}{rng.choice(('', '.' + word(), num(2)))}"
            if training:
                at = rng.choice(("(at)", " (at) ", "[at]", " [at] ", " at ", " AT ", " @ "))
                dot = rng.choice((".", " dot ", "(dot)", "[dot]")) if at.strip() not in ("at", "AT") else " dot "
                return f"{local}{at}{word()}{dot}{tld()}"
            at = rng.choice((" {at} ", "{at}", " (AT) ", "( at )", "@ ", " at "))
            dot = rng.choice((" (dot) ", "{dot}", " [dot] ")) if at != " at " else rng.choice((" dot ", " DOT "))
            return f"{local}{at}{word()}{dot}{word() + dot if rng.random() < 0.3 else ''}{tld()}"
        if kind == "ip":
            if training:
                some = [group() for _ in range(rng.randint(1, 5))]
                return rng.choice((":".join(group() for _ in range(8)), f"2001:db8::{':'.join(some)}", f"{':'.join(some)}::{group()}", f"fe80::{':'.join(some[:4])}"))
            return rng.choice((f"2001:{group()}:0:0:0:0:{rng.randint(1, 9)}:{rng.randint(1, 9)}", f"2a02:{group()}:{group()}::{rng.randint(1, 99)}", ":".join(f"{rng.randrange(65536):04X}" for _ in range(8)), f"fd00:{group()}::{group()}:{group()}"))
        if kind == "card":
            if training:
                return rng.choice((spaced(card(15), rng.choice((" ", "-")), (4, 6)), card(15), spaced(card(16), rng.choice((".", "/", ". ")), (4, 4, 4))))
            return rng.choice((spaced(card(14), rng.choice((" ", "-")), (4, 6)), spaced(card(15), ".", (4, 6)), spaced(card(16), rng.choice((" / ", ". ", "./"))[:2], (4, 4, 4)), spaced(card(19), ".", (4, 4, 4, 4))))
        d = nonzero(10)
        if training:
            return rng.choice((f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"00{nonzero(2)} {d[:3]} {d[3:6]} {d[6:]}", f"0{d[:3]}/{d[3:]}", f"0{d[0]} {num(2)} {num(2)} {num(2)} {num(2)}", f"0{d[:2]} {d[2:9]}", f"0{d[:3]} {d[3:7]}-{d[7:]}", f"0{d[:3]} {d[3:9]}", f"0{d[:3]}-{d[3:9]}", f"1 ({d[:3]}) {d[3:6]}-{d[6:]}", f"00{nonzero(2)} {d[:2]} {d[2:9]}"))
        return rng.choice((f"({d[:3]}) {d[3:6]} {d[6:]}", f"({d[:3]}) {d[3:6]}.{d[6:]}", f"(0{d[:2]}) {d[2:6]} {d[6:]}", f"0{d[:2]}-{d[2:9]}", f"1-{d[:3]}-{d[3:6]}-{d[6:]}", f"0{d[:4]} {d[4:]}", f"00{nonzero(2)}-{num(2)}-{d[:7]}", f"0{d[0]}.{num(2)}.{num(2)}.{num(2)}.{num(2)}"))

    def negative(kind: str) -> str:
        if kind == "email":
            if training:
                return rng.choice((f"{word()} at {word()}.{word()}", f"{word()} @ {num(2)}.{num(2)}", f"{word()} at {word()} dot {word()}"))
            return rng.choice((f"{word()} at {num(1)}.{num(2)}", f"{word()} at {word()}.{word()}.{word()}", f"{word()} @ {word()}.{num(1)}", f"{word()} AT {word()}.{word()}"))
        if kind == "ip":
            two = lambda top: f"{rng.randrange(top):02}"
            if training:
                return rng.choice((":".join(two(60) for _ in range(3)), ":".join(f"{rng.randrange(256):02x}" for _ in range(6)), ":".join(two(100) for _ in range(8)), ":".join(num(1) for _ in range(rng.randint(3, 5))), ":".join(f"{rng.randrange(256):02x}" for _ in range(16)), ":".join(num(rng.randint(1, 4)) for _ in range(rng.randint(3, 7))), ":".join(group() for _ in range(rng.randint(9, 12))), f"{group()}::{group()}::{group()}", "::", f"{num(1)}::"))
            return rng.choice((":".join(two(60) for _ in range(4)), ":".join(f"{rng.randrange(256):02X}" for _ in range(6)), ":".join(f"{rng.randrange(256):02X}" for _ in range(20)), f"{num(2)}:{num(3)}:{num(4)}", ":".join(two(100) for _ in range(7)), f"{num(1)}:{num(1)}::{num(1)}:{num(1)}::{num(1)}"))
        if kind == "card":
            bad = card(16)
            bad = bad[:-1] + str((int(bad[-1]) + rng.randint(1, 9)) % 10)
            if training:
                return rng.choice((num(rng.randint(12, 15)), bad, spaced(bad, rng.choice((" ", "-", "/", ".")), (4, 4, 4)), f"97{rng.choice('89')}-{num(1)}-{num(4)}-{num(4)}-{num(1)}"))
            return rng.choice((num(rng.randint(17, 19)), spaced(num(14), " ", (2, 4, 4)), spaced(bad, ". ", (4, 4, 4)), spaced(num(12), ".", (3, 3, 3)), spaced(num(15), "-", (5, 5))))
        day, month = f"{rng.randint(1, 28):02}", f"{rng.randint(1, 12):02}"
        if training:
            return rng.choice((num(rng.randint(7, 15)), f"20{num(2)}-{month}-{day}", f"{day}.{month}.20{num(2)}", f"20{num(2)}-{month}-{day} {num(2)}", f"{num(3)} {num(3)} {num(3)}", f"{num(1)}.{num(1)}.{num(2)}.{num(5)}", f"{num(4)} - {num(4)}", f"{nonzero(2)} {num(2)} {num(2)} {num(2)}", f"{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}", f"{num(5)}-{num(4)}", f"{nonzero(1)}.{num(3)}.{num(3)}"))
        return rng.choice((f"20{num(2)}/{month}/{day}", f"{day}-{month}-20{num(2)}", f"{day}/{month}/19{num(2)}", nonzero(rng.randint(7, 12)), f"{num(5)} {num(5)}", f"{num(2)}.{num(4)} {num(1)}.{num(4)}", f"{num(2)}-{num(4)}-{num(2)}", f"19{num(2)}-20{num(2)}", f"{nonzero(2)}.{num(3)}.{num(3)}.{num(3)}", f"{nonzero(3)} {num(3)} {num(3)} {num(3)}"))

    texts, spans, y = [], [], []
    fill = _FILL[source]
    for k in range(rows):
        kind, good = KINDS[k // 2 % len(KINDS)], k % 2
        s = positive(kind) if good else negative(kind)
        lead = [rng.choice(fill) if training else rng.choice((rng.choice(fill), word())) for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.35:
            lead.append(rng.choice(_CUES[kind]) + rng.choice(("", ":", "s")) if good or rng.random() < 0.15 else rng.choice(_AGAINST) + rng.choice(("", ":", " no")))
        before = " ".join(lead) + rng.choice((" ", " ", "\n")) if lead else ""
        if not good and rng.random() < 0.15:
            before += rng.choice(("#", "x", "$"))
        row = [s]
        if good and kind == "phone" and rng.random() < 0.2:  # another right after it, half of the time of the same form
            same = lambda: "".join(rng.choice("123456789") if c in "123456789" else c for c in s) if rng.random() < 0.5 else positive(kind)  # noqa: E731, B023
            row.append(same())
        text, at = f"{before}{' '.join(row)}{rng.choice((' ', '. ', ', ', chr(10)))}{rng.choice(fill)}", len(before)
        for part in row:
            texts.append(text)
            spans.append((kind, at, at + len(part)))
            y.append(good)
            at += len(part) + 1
    return texts, spans, y


@lru_cache(maxsize=1)
def detector() -> Detector:
    return Detector()


# -- spans -------------------------------------------------------------------
class _Taken:
    """Disjoint ranges in order; whether a further one meets any takes a bisection."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a

    def add(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def _apart(ranked: list[tuple]) -> Iterator[tuple]:
    """Those of ``(.., start, end, ..)``, best first, that no better one overlaps."""
    taken = _Taken([])
    for c in ranked:
        if not taken.meets(c[1], c[2]):
            taken.add(c[1], c[2])
            yield c


#: Candidates that are scored at once.
SCORED = 1 << 16


def find(texts: list[str], model: Detector) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Base spans and all spans of each text, by kind, then start."""
    bases = [base_spans(t) for t in texts]
    passed: list[list[tuple[float, int, int, str]]] = [[] for _ in texts]
    rows: dict[tuple[float, ...], int] = {}  # equal features are scored once
    of: list[tuple[int, str, int, int, int]] = []

    def score() -> None:
        each = list(rows)
        p = model.probabilities(each).tolist() if rows else []
        for k, kind, a, b, row in of:
            if model.passes(kind, each[row], p[row]):
                passed[k].append((-p[row], a, b, kind))
        rows.clear()
        of.clear()

    for k, t in enumerate(texts):
        taken = _Taken([s[1:] for s in bases[k]])
        for kind, a, b in candidates(t):
            if not taken.meets(a, b):
                of.append((k, kind, a, b, rows.setdefault(features(t, kind, a, b), len(rows))))
                if len(of) == SCORED:
                    score()
    score()
    out = []
    for base, mine in zip(bases, passed):
        chosen = [(kind, a, b) for _, a, b, kind in _apart(sorted(mine))]
        out.append((base, sorted([*base, *chosen], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row: ``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256, spans`` (base and selected).

    A null text is an empty one; a null doc_id stays null; equal rows give equal rows; an
    empty table gives none. Offsets are code points, end exclusive. Only doc_id and text
    are read, so further columns of any name do no harm.
    """
    model = detector()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = find([t or "" for t in b.column(1).to_pylist()], model)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            shas = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(shas, pa.string()), pa.array([_joined(every) for _, every in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(find([text], detector())[0][1], key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
