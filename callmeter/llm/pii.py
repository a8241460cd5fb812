"""Personal data by a semi-Markov conditional random field beside fixed patterns (operator 5)."""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table
from .langid import blocks

# The kinds, in order.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[0::2]) + sum(d * 2 - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """The fixed patterns' accepted matches as (index of kind, start, end), in order. Time is linear in the text."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((0, start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# ---- the random field: segments over the units of an island, a run of text around digits, at signs and their like ----

_HIT = re.compile(r"[0-9@]|[\[({]\s?(?:at|dot|@|\.)\s?[\])}]|(?<!\S)(?:dot|\.)(?!\S)", re.I)
_TOKEN = re.compile(r"\S+")
_UNIT = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_BEFORE = re.compile(r"([^\W\d_]+)\W*$")
_DIGITS = re.compile(r"[0-9]+")
_COARSE = re.compile(r"[0-9]+|[^\W\d_]+")
#: Whitespace-separated words of an island before its first hit and after its last.
BEFORE, AFTER = 3, 1
LONGEST = 28
BUCKETS = 1 << 14


def islands(text: str, taken: list[tuple[int, int, int]] = ()):
    """Lists of units (start, end): where something with digits, an at sign or a bracketed word for one stands, with some
    words around, cut into runs of digits, letters and blanks. Nothing in `taken` (kind, start, end) is part of one."""
    if not _HIT.search(text):
        return
    clear, at = [], 0
    for _, s, e in sorted(taken, key=lambda x: x[1]):
        if s > at:
            clear.append((at, s))
        at = max(at, e)
    clear.append((at, len(text)))
    for lo, hi in clear:
        if not _HIT.search(text, lo, hi):
            continue
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
        starts, first, last = [s for s, _ in tokens], None, None
        for m in _HIT.finditer(text, lo, hi):
            k = bisect(starts, m.start()) - 1
            if first is None or k - BEFORE > last + AFTER + 1:
                if first is not None:
                    yield _units(text, tokens, first, last)
                first = k
            last = bisect(starts, m.end() - 1) - 1
        if first is not None:
            yield _units(text, tokens, first, last)


def _units(text: str, tokens: list[tuple[int, int]], first: int, last: int) -> list[tuple[int, int]]:
    lo, hi = tokens[max(0, first - BEFORE)][0], tokens[min(len(tokens) - 1, last + AFTER)][1]
    return [(u.start(), u.end()) for u in _UNIT.finditer(text, lo, hi)]


def marker(unit: str) -> str:
    """What a unit stands for: @ or . for the words "at" and "dot", else nothing."""
    return {"at": "@", "dot": "."}.get(unit.lower(), "") if len(unit) < 4 else ""


def shape(s: str) -> str:
    """Runs of digits as their length's class, runs of letters as one letter, words for signs as those, all else as it is."""
    out = []
    for u in _UNIT.finditer(s):
        c = u[0][0]
        out.append(("1" if len(u[0]) == 1 else "3" if len(u[0]) <= 3 else "8" if len(u[0]) <= 8 else "9") if c.isdigit() else (marker(u[0]) or "a") if c.isalpha() else " " if c.isspace() else c)
    return "".join(out)


_AT = re.compile(r"\s*[\[({]\s*(?:at|@)\s*[\])}]\s*|\s+at\s+|\s+@\s+|@", re.I)
_DOT = re.compile(r"\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*|\s+dot\s+|\s+\.\s+|\.", re.I)
_PLAIN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]*[^\W_][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def styles(signs: list[str]) -> str:
    """The ways in which signs are written: bracketed, as a word, spaced, plain."""
    return "".join(sorted({"b" if x.strip()[0] in "[({" else "w" if x.strip()[0].isalpha() else "s" if x[0].isspace() else "p" for x in signs}))


def span_features(text: str, start: int, end: int) -> list[int]:
    """Hashed features of a whole candidate span: shape, groups of digits and what parts them, check sum, range of the
    parts, whether it reads as an address once its words for signs are written as such, how these are written, and what stands
    around it."""
    s = text[start:end]
    groups = _DIGITS.findall(s)
    digits = "".join(groups)
    n, lengths = len(digits), "-".join(str(min(len(g), 9)) for g in groups[:8])
    letters = any(c.isalpha() for c in s)
    parts = [x.strip(" \t[](){}") for x in _DIGITS.split(s)[1:-1]]
    alike = "none" if not parts else (parts[0][:3] or "blank") if len(set(parts)) == 1 else "mixed"
    word = _BEFORE.search(text, max(0, start - 24), start)
    left, right = shape(text[max(0, start - 2) : start]), shape(text[end : end + 3])
    size = "0" if not n else "s" if n < 9 else "m" if n < 13 else "l" if n <= 15 else "x" if n <= 19 else "o"
    signs = _DOT.sub(".", _AT.sub("@", s)) if letters or "@" in s else ""
    ats, dots = (styles(_AT.findall(s)), styles(_DOT.findall(s))) if signs or len(groups) == 4 else ("", "")
    last = _COARSE.findall(s)[-1].lower() if signs else ""
    address = bool(signs) and _PLAIN_EMAIL.fullmatch(signs) is not None
    octets = len(groups) == 4 and not letters and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    octets = octets or len(groups) == 4 and signs.replace(".", "").isdigit() and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    check = not letters and 13 <= n <= 19 and luhn(digits)
    coarse = _COARSE.sub(lambda m: "9" if m[0][0].isdigit() else marker(m[0]) or "a", s)
    names = (
        f"coarse {coarse} {octets} {check} {size}",
        f"digits {size} {letters}", f"plus {s[:1] if s[:1] in '+(' else digits[:2] == '00'} {size} {letters}", f"check {check} {size} {letters}", f"octets {octets} {alike}", f"octets {octets} {letters}",
        f"groups {lengths if not letters else ''} {alike}", f"address {address} {s.count('@')}", f"letters {letters} {address} {bool(n)}", f"left {left} {s[:1].isalnum()}", f"right {right} {s[-1:].isalnum()}", f"around {address} {octets} {check} {left[-1:]} {right[:2]}",
        f"word {word[1].lower() if word else ''}", f"edge {shape(s[:1])} {shape(s[-1:])}", f"check {check} {alike}",
        f"layout {lengths if not letters else ''} {s[:1] if s[:1] in '+(' else ''}", f"parts {alike} {size} {letters}", f"signs {ats} {dots} {address} {octets}", f"last {last[:8]} {address} {ats}",
    )
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]


class Field:
    """Weights of span features for each kind. A segment of one unit outside any entity scores 0. An entity has at most
    LONGEST units, begins with a digit, a letter, a plus sign or a bracket, ends with a digit, a letter or a bracket,
    holds a digit, an at sign or a word for one, but only one at sign, no mark of NEVER and no two plain words side by
    side."""

    NEVER = frozenset(",;:|\"'!?=<>\n")

    def __init__(self, weight: np.ndarray | None = None):
        self.weight = np.zeros((BUCKETS, len(KINDS))) if weight is None else weight

    @staticmethod
    def candidates(text: str, units: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
        out, n = [], len(units)
        first = [text[s] for s, _ in units]
        plain = [c.isalpha() and not marker(text[s:e]) for c, (s, e) in zip(first, units)]
        marks = np.cumsum([0, *(c.isdigit() or c == "@" or bool(marker(text[s:e])) for c, (s, e) in zip(first, units))]).tolist()
        starts = [c.isalnum() or c in "+(" for c in first]
        ats = np.cumsum([0, *(c == "@" or marker(text[s:e]) == "@" for c, (s, e) in zip(first, units))]).tolist()
        wall = 0
        for j in range(n):
            if first[j] in Field.NEVER:
                wall = j + 1
            if plain[j] and j >= 2 and first[j - 1].isspace() and plain[j - 2]:
                wall = j
            if not (first[j].isalnum() or first[j] == ")"):
                continue
            for i in range(max(wall, j - LONGEST + 1), j + 1):
                if starts[i] and marks[j + 1] > marks[i] and ats[j + 1] - ats[i] < 2 and units[j][1] - units[i][0] >= 5:
                    out.append((i, j, span_features(text, units[i][0], units[j][1])))
        return out

    def scores(self, found: list) -> np.ndarray:
        return self.weight[np.array([f for _, _, f in found])].sum(1) if found else np.zeros((0, len(KINDS)))

    def best(self, text: str, units: list, found: list | None = None) -> list[tuple[int, int, int]]:
        """The jointly best boundaries and kinds, as (index of kind, start, end): dynamic programming over the units."""
        found = self.candidates(text, units) if found is None else found
        s = self.scores(found)
        top, kind = s.max(1) if len(s) else [], s.argmax(1) if len(s) else []
        by: dict[int, list] = {}
        for k, (i, j, _) in enumerate(found):
            if top[k] > 0:
                by.setdefault(j, []).append(k)
        value, back = [0.0], []
        for j in range(len(units)):
            v, b = value[j], None
            for k in by.get(j, ()):
                if (w := value[found[k][0]] + top[k]) > v:
                    v, b = w, k
            value.append(v)
            back.append(b)
        out, j = [], len(units) - 1
        while j >= 0:
            if (k := back[j]) is None:
                j -= 1
            else:
                out.append((int(kind[k]), units[found[k][0]][0], units[found[k][1]][1]))
                j = found[k][0] - 1
        return out[::-1]

    def gradient(self, units: list, found: list, truth: set) -> tuple[float, np.ndarray]:
        """Log-likelihood of the true segmentation (kind, start, end) and its gradient by candidate and kind, from forward
        and backward sums over the units."""
        s, n = self.scores(found), len(units)
        most = s.max(1)
        total = most + np.log(np.exp(s - most[:, None]).sum(1))
        each = total.tolist()
        ends: list[list] = [[] for _ in range(n)]
        begins: list[list] = [[] for _ in range(n)]
        for k, (i, j, _) in enumerate(found):
            ends[j].append(k)
            begins[i].append(k)

        def add(x: float, y: float) -> float:
            return x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))

        fwd, bwd = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(n):
            v = fwd[j]
            for k in ends[j]:
                v = add(v, fwd[found[k][0]] + each[k])
            fwd[j + 1] = v
        for i in range(n - 1, -1, -1):
            v = bwd[i + 1]
            for k in begins[i]:
                v = add(v, bwd[found[k][1] + 1] + each[k])
            bwd[i] = v
        whole = np.array([fwd[i] + bwd[j + 1] for i, j, _ in found]) - fwd[n]
        g = -np.exp(np.minimum(0, whole[:, None] + s))
        like = -fwd[n]
        for k, (i, j, _) in enumerate(found):
            for t in range(len(KINDS)):
                if (t, units[i][0], units[j][1]) in truth:
                    g[k, t] += 1
                    like += s[k, t]
        return like, g


# ---- what the field learns: accepted spans, the same written otherwise, and near misses ----


def variants(kind: int, s: str) -> list[str]:
    """Other ways to write an accepted span, which the fixed patterns miss: usual ones, then some drawn by a hash of it."""
    d = _NOT_DIGIT.sub("", s)
    draw = np.random.default_rng(zlib.crc32(s.encode("utf-8", "surrogatepass")))
    one = lambda *some: some[draw.integers(len(some))]
    dot = lambda: one("[.]", "(.)", "[dot]", " (dot) ", " dot ", " . ")
    drawn = []
    for _ in range(6):
        if kind == 0:
            name, _, rest = s.partition("@")
            drawn.append(name + one("@", "[at]", " (at) ", "[ @ ]", " at ", " @ ") + rest.replace(".", dot()))
        elif kind == 1:
            a, b, *p = s.split(".")
            drawn.append(f"{a}{one('.', dot())}{b}" + "".join(one(".", dot()) + x for x in p))
        elif kind == 2:
            cuts = np.sort(draw.choice(np.arange(3, len(d) - 2), draw.integers(1, 4), replace=False)).tolist()
            drawn.append(one(".", "/", "_", " . ", " _ ", "..").join(d[i:j] for i, j in zip([0, *cuts], [*cuts, len(d)])))
    if kind == 0:
        name, _, rest = s.partition("@")
        spelt = rest.replace(".", " [dot] ")
        return [f"{name} [at] {rest}", f"{name}(at){rest}", f"{name} @ {rest}", f"{name} [at] {spelt}", f"{name} at {rest.replace('.', ' dot ')}", f"{name}[@]{rest.replace('.', '[.]')}", f"{name} (at) {rest.replace('.', ' (dot) ')}", *drawn]
    if kind == 1:
        p = s.split(".")
        return ["[.]".join(p), " . ".join(p), "(.)".join(p), " dot ".join(p), "[dot]".join(p), ".".join(p[:3]) + "[.]" + p[3], *drawn]
    if kind == 2:
        p = [d[i : i + 4] for i in range(0, len(d), 4)]
        return [".".join(p), "/".join(p), " - ".join(p), "  ".join(p), "_".join(p), "\u2013".join(p), "\u00a0".join(p), *drawn]
    p = [d[:-10], d[-10:-7], d[-7:-4], d[-4:]] if len(d) > 10 else ["", d[:3], d[3:6], d[6:]]
    long = [x for x in p if x]
    local = ["-", ".", " ", "/"][int(d[-1]) % 4].join(p[1:])
    return [f"({p[1]}) {p[2]}-{p[3]}", "-".join(p[1:]), ".".join(p[1:]), f"00{' '.join(long)}", f"+{'/'.join(long)}", f"({p[1]}){p[2]}-{p[3]}", f"{p[0]}-{'-'.join(p[1:])}".strip("-"), " ".join(p[1:]), "/".join(p[1:]), local, *(one("-", ".", "/", " ").join([one("1", "44"), *p[1:]]) for _ in range(2)), f"0{d[-10:-8]} {d[-8:-4]} {d[-4:]}"]


def misses(kind: int, s: str) -> list[str]:
    """Texts that look like an accepted span or its variants and are none."""
    d = _NOT_DIGIT.sub("", s)
    if kind == 0:
        name, _, rest = s.partition("@")
        return [f"{name} at {rest.partition('.')[0]}", f"{name} [at] {rest.partition('.')[0]}", rest.replace(".", " dot "), f"@{name}", f"{name} at {rest}", f"at {name}. {rest.partition('.')[0]}", f"{name} {rest}", f"{name} at {rest.partition('.')[0]} dot {('the', 'or', 'it')[len(rest) % 3]}", f"be at {name} dot on"]
    if kind == 1:
        p = s.split(".")
        far = [str(int(p[0]) + 256), *p[1:]]
        return [".".join(p[:3]), "[.]".join(far), " . ".join(far), ".".join([*p, p[0]]).replace(".", "[.]"), f"{p[0]}.{p[1]}"]
    if kind == 2:
        bad = d[:-1] + str((int(d[-1]) + 1 + int(d[0]) % 8) % 10)
        return [bad, *variants(2, bad), d[:8]] if not luhn(bad) else []
    return [d[-7:-4] + "-" + d[-4:], f"20{d[-2:]}-0{1 + int(d[-3]) % 9}-1{d[-1]}", f"1{d[-1]}:{d[-2]}5:3{d[-3]}", f"{d[-3]}.{d[-2:]}", d[-6:], f"({d[-2:]})"]


#: Lengths of the groups in which telephone numbers are written; others are no near misses.
_LAYOUTS = frozenset([(3, 3, 4), (1, 3, 3, 4), (2, 3, 3, 4), (3, 3, 3, 4), (3, 4, 4), (5, 3, 4)])


def numbers(text: str, count: int = 12) -> list[str]:
    """Numbers in groups that stand for nothing personal, as dates, codes and measures do: groups of any length and
    separator, and letters in some, drawn by a hash of text. Never in a telephone number's layout, and no card or IP."""
    draw = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    out = []
    while len(out) < count:
        some, total = draw.random(), draw.integers(9, 12)
        if some < 0.4:
            lengths = tuple(draw.integers(1, draw.choice([4, 8]), draw.integers(2, 6)).tolist())
        elif some < 0.7:  # as many digits as a telephone number, parted elsewhere
            cuts = np.sort(draw.choice(np.arange(1, total), draw.integers(1, 4), replace=False))
            lengths = tuple(np.diff(cuts, prepend=0, append=total).tolist())
        else:
            lengths = ((4, 2, 2, 2), (4, 2, 2), (2, 2, 4), (1, 3, 3), (4, 4, 4), (1, 12), (8, 6))[draw.integers(7)]
        groups = ["".join(map(str, draw.integers(0, 10, n))) for n in lengths]
        mark = other = "-/. "[draw.integers(4)]
        v = mark.join(groups)
        if draw.random() < 0.3:
            k = draw.integers(1, len(groups))
            other = "-/. :"[draw.integers(5)]
            v = mark.join(groups[:k]) + other + mark.join(groups[k:])
        if draw.random() < 0.2:
            v = "ABTVX"[draw.integers(5)] + v
        if lengths not in _LAYOUTS and not base_spans(v) and not luhn("".join(groups)) and (len(lengths) != 4 or max(lengths) > 3 or mark != other):
            out.append(v)
    return out


def reshaped(kind: int, s: str, turn: int) -> str:
    """An accepted span of another build, by turns: fewer or other parts of an address, another length of country code."""
    if kind == 0:
        name, _, rest = s.partition("@")
        labels = rest.split(".")
        first = name.split(".")[0] or name
        name = [name, first, f"{name}_{turn % 90}", f"{first}{turn % 1000}", f"{name[:1]}-{name[-2:]}", f"{first[:4]}_{first[-3:]}", f"{first[-4:]}.{first[:1]}"][turn % 7].strip("._-")
        return f"{name or 'a'}@{['.'.join(labels), '.'.join(labels[-2:]), '.'.join([labels[0], 'org']), '.'.join([*labels[-2:-1], 'de']), '-'.join(labels[:2]) + '.net'][turn // 5 % 5]}"
    if kind == 3:
        return f"+{['', '1', '44', '351'][turn % 4] or s[1:].split(' ')[0]} ({turn % 900 + 100}) {_NOT_DIGIT.sub('', s)[-7:-4]}-{s[-4:]}"
    return s


def examples(windows: list[str]) -> list[tuple[str, set]]:
    """(text, truth) of each window and of the window with each variant and near miss of its first accepted span, and
    with other numbers, instead, some of them without what stands before or after it, or with a stop after it.

    What the fixed patterns accept in such a text is true as well; a variant that they accept themselves is left out, and
    so are spans that begin or end within a word."""
    def accepted(text: str) -> list[tuple[int, int, int]]:
        out, at = [], 0
        for k, s, e in sorted(base_spans(text), key=lambda x: (x[1], -x[2], x[0])):
            if s >= at:
                out.append((k, s, e))
                at = e
        return out

    out = []
    for number, text in enumerate(windows):
        found = [(k, s, e) for k, s, e in accepted(text) if (text[s] == "+" or text[s].isalnum()) and not text[s - 1 : s].isalnum() and not text[e : e + 1].isalnum()][:1]
        out.append((text, set(accepted(text))))
        for k, s, e in found:
            for true, make in ((True, variants), (False, misses), (False, lambda _, v: numbers(v))):
                for i, v in enumerate(make(k, reshaped(k, text[s:e], number))):
                    v = make(k, reshaped(k, text[s:e], 7 * number + i))[i] if k in (0, 3) else v
                    turn = (number + i) % 6
                    before, after = "" if turn in (1, 3) else text[:s], "" if turn in (2, 3) else text[e:]
                    if (stop := zlib.crc32(f"{number} {i}".encode()) % 8) < 4:
                        after = (". ", ", ", "; ", ".")[stop] + after.lstrip()
                    changed, at = before + v + after, len(before)
                    rest = accepted(changed)
                    if not any(x < at + len(v) and at < y for _, x, y in rest):
                        out.append((changed, {*rest, (k, at, at + len(v))} if true else set(rest)))
    return out


def train(data: list[tuple[str, set]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Fits the field to texts and their true spans: AdaGrad on the conditional log-likelihood, in a fixed mixed order.

    Two of three rows are learned without the spans' exact form, the first of their features, lest the field only know
    the forms it has seen."""
    field, square = Field(), np.full((BUCKETS, len(KINDS)), 1e-8)
    rows = []
    for text, truth in sorted(data, key=lambda x: zlib.crc32(x[0].encode("utf-8", "surrogatepass"))):
        for units in islands(text):
            if found := Field.candidates(text, units):
                found = found if len(rows) % 3 == 0 else [(i, j, f[1:]) for i, j, f in found]
                index = np.array([f for _, _, f in found])
                at, inverse = np.unique(index, return_inverse=True)
                rows.append((units, found, truth, at, inverse.ravel(), index.shape[1]))
    for _ in range(epochs):
        for units, found, truth, at, inverse, width in rows:
            _, g = field.gradient(units, found, truth)
            step = -decay * field.weight[at]
            each = np.repeat(g, width, 0)
            for t in range(len(KINDS)):
                step[:, t] += np.bincount(inverse, each[:, t], len(at))
            square[at] += step * step
            field.weight[at] += rate * step / np.sqrt(square[at])
    return field


def fit(docs: DataFrame, per_kind: int = 40, without: int = 150, context: tuple[int, int] = (32, 16)) -> Field:
    """A field trained on a bounded sample of docs (text): of each kind, the windows around at most `per_kind` accepted
    spans (those with the lowest hashes, so every kind is learned however rare it is), each also with its variants and
    near misses, and at most `without` islands that hold no accepted span. Other columns are ignored; null texts teach
    nothing; a kind without a span in docs isn't learned."""
    before, after = context

    def extract(batches):
        for batch in batches:
            for _, _, texts in blocks(batch, 0):
                out = []
                for text in texts:
                    base = base_spans(text)
                    out += [(k, text[max(0, s - before) : e + after]) for k, s, e in base]
                    for units in islands(text, base):
                        if len(units) <= 60:
                            out.append((len(KINDS), text[max(0, units[0][0] - before) : units[-1][1] + after]))
                out = list(dict.fromkeys(x for x in out if x[0] == len(KINDS) or any(k == x[0] for k, _, _ in base_spans(x[1]))))
                yield pa.record_batch({"kind": pa.array([k for k, _ in out], pa.int32()), "window": pa.array([w for _, w in out], pa.string())})

    found = docs.select(F.col("text").cast("string")).mapInArrow(extract, "kind int, window string").withColumn("h", F.xxhash64("window")).groupBy("kind", "h").agg(F.min("window").alias("window"))
    place = F.row_number().over(W.partitionBy("kind").orderBy("h"))
    some = found.withColumn("place", place).where(F.col("place") <= F.when(F.col("kind") < len(KINDS), per_kind).otherwise(without)).where(F.col("place") <= max(per_kind, without))
    windows = {r["window"]: r["kind"] for r in some.collect()}
    clear = [w for w in sorted(windows) if windows[w] == len(KINDS) and not base_spans(w)]
    return train(examples(sorted(w for w in windows if windows[w] < len(KINDS))) + [(w, set()) for w in clear])


def find(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, base, added): arrays of spans (kind, start, end) in code points, by kind, then start.

    base: what the fixed patterns accept. added: what the field finds in the text between those. Null and empty texts
    have none; a null doc_id stays null; repeated rows come out as often as they occur; an empty table gives no rows;
    other columns are ignored. Time is linear in the text, however many spans it has.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            base, added = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                b = base_spans(text)
                more = [x for units in islands(text, b) for x in shared.value.best(text, units)]
                base.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in b])
                added.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(more)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(added, kind)], names=["doc_id", "base", "added"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, base {span}, added {span}")


def op5_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(docs))
    rank = {k: i for i, k in enumerate(KINDS)}
    order = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    both = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(order[s["kind"]].alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(both).alias("spans"), F.size("added").cast("long").alias("n_added"))
