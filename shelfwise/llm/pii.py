"""Personal data by candidate gradient boosting (operator 3).

Base spans are matches of four fixed patterns; they always stay. Beyond them, high-recall generators propose overlapping
spans of each kind (spelled-out e-mail addresses, groups of digits and hexadecimal groups of any format). A boosted-tree
model for each kind scores a candidate by its format and its context, a threshold calibrated for the kind's precision
selects, and of selected candidates that overlap each other or a base span the best ones stay (base first, then score).
The trees are trained here, in numpy, on spans and contexts drawn from templates with a fixed seed; no corpus is needed,
and the model's size is fixed.

Spans count code points, the end is exclusive. Patterns are matched in time proportional to the text; candidates are scored
some thousands at a time, at most 13 of each kind for a group of digits, so memory is bounded beside the text.

Defined cases: a null or empty text has no spans; long texts are searched whole; base spans of different kinds may
overlap; `redact` merges overlapping spans and names the first one's kind; rows that repeat get equal results; an empty
table gives an empty result; further columns are ignored by `find` and returned by `redact`.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Kinds in the order in which they are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# a match takes whole runs of digits, so none begins within one
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Each match holds one @; its name reaches back over allowed characters, no further than the match before."""
    floor, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > floor and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end(), "email"
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by start, then by kind as listed."""
    out = list(emails(text)) if "@" in text else []
    if re.search("[0-9]", text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split("."))]
        out += [(*m.span(), "card") for m in _CARD.finditer(text) if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


#: What proposes spans of each kind.
_SPELLED = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\}|<at>|\sat\s|@|＠)\s?[\w-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\sdot\s|\.)\s?[\w-]{2,63}){1,4}", re.I)
_AT = re.compile(r"\(at\)|\[at\]|\{at\}|<at>|＠|@|\sdot\s", re.I)
_HEX = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")
_OCTETS = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\)|\(dot\)|\[dot\])\s?[0-9]{1,3}){3}(?![0-9])", re.I)
_GROUP = re.compile("[0-9]+")
_BETWEEN = re.compile(r"[ ().\-/_+]{1,3}")
#: Digits of a number: 7 to 19.
FEWEST, MOST = 7, 19
#: Candidates that are scored at once.
SLICE = 4096


def joined(text: str, b: int, a: int) -> bool:
    """Whether what lies between two groups of digits may lie within a number."""
    return a - b <= 3 and bool(_BETWEEN.fullmatch(text, b, a))


def single_runs(text: str, groups: list[tuple[int, int]]) -> list[int]:
    """For each group the end of the run of single digits that begins with it, 0 for other groups, -1 within a run."""
    out, k = [0] * len(groups), 0
    while k < len(groups):
        j = k
        while j < len(groups) and groups[j][1] - groups[j][0] == 1 and (j == k or joined(text, groups[j - 1][1], groups[j][0])):
            j += 1
        if j - k >= FEWEST:
            out[k], out[k + 1 : j] = j, [-1] * (j - k - 1)
        k = max(j, k + 1)
    return out


def numbers(text: str) -> Iterator[tuple[int, int]]:
    """Every span of whole groups of digits, joined by three separators at most, with 7 to 19 digits; from each group 13 at most.

    A number spelled digit by digit is a whole run of single digits or none: parts of such a run are no candidates.
    """
    groups = [m.span() for m in _GROUP.finditer(text)]
    runs = single_runs(text, groups)
    for k, (a, b) in enumerate(groups):
        if runs[k] < 0:
            continue
        start = a
        while start and a - start < 2 and text[start - 1] in "+(":
            start -= 1
        if runs[k]:
            if runs[k] - k <= MOST:
                yield start, groups[runs[k] - 1][1]
            continue
        n = 0
        for j in range(k, len(groups)):
            if j > k and (runs[j] or not joined(text, b, groups[j][0])):
                break
            n, b = n + groups[j][1] - groups[j][0], groups[j][1]
            if n > MOST:
                break
            if n >= FEWEST:
                yield start, b


def candidates(text: str) -> Iterator[Span]:
    """Proposed spans. Of a number's digits what no card or phone can have is asked first: a card passes Luhn's check and has 13 at least, a phone 15 at most."""
    if _AT.search(text):
        yield from ((*m.span(), "email") for m in _SPELLED.finditer(text))
    if re.search("[0-9]", text):
        if "." in text or ":" in text:
            yield from ((*m.span(), "ip") for p in (_OCTETS, _HEX) for m in p.finditer(text))
        for a, b in numbers(text):
            d = digits_of(text[a:b])
            if len(d) >= 13 and luhn(d):
                yield a, b, "card"
            if len(d) <= 15:
                yield a, b, "phone"


_WORDS = {
    "email": ("mail", "contact", "write", "reach", "courriel", "correo", "kontakt"),
    "ip": ("ip", "host", "server", "address", "login", "addr"),
    "card": ("card", "visa", "master", "credit", "carte", "karte", "tarjeta", "amex", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "cell", "fax", "ring", "anruf", "telefon", "appel", "llam", "whatsapp", "sms"),
}
_AGAINST = ("order", "isbn", "version", "invoice", "item", "ref", "page", "serial", "no.", "id", "price", "total", "article", "date", "year")


_DIGIT_BEFORE = re.compile(r"[0-9]([ ().\-/_+]{0,3})$")
_DIGIT_AFTER = re.compile(r"([ ().\-/_+]{0,3})[0-9]")


def cue(before: str, kind: str) -> tuple[bool, bool]:
    """Whether words before a candidate speak for its kind, or against it."""
    return any(w in before for w in _WORDS[kind]), any(w in before for w in _AGAINST)


def edge(m: re.Match | None, inner: str) -> list[float]:
    """How digits go on beside a candidate: not at all, by blanks, by another separator; and by one that it has within."""
    if not m:
        return [0, 0]
    mark = m[1].strip() or m[1]
    return [1 if not m[1].strip() else 2, mark[:1] in inner]


_DATE = re.compile(r"(19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}.*|[0-9]{1,2}[-./][0-9]{1,2}[-./](19|20)[0-9]{2}.*", re.S)
_YEAR_FIRST = re.compile(r"(19|20)[0-9]{2}[-./][0-9]{2}(?![0-9])")
_DATE_WITHIN = re.compile(r"(?<![0-9])((19|20)[0-9]{2}([-./])[0-9]{1,2}\3[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\4(19|20)[0-9]{2})(?![0-9])")


def describe(text: str, span: Span, seen: dict | None = None) -> list[float]:
    """A candidate's format and the characters on both sides; seen keeps what spans that begin alike have in common."""
    a, b, kind = span
    s, after = text[a:b], text[b : b + 12].lower()
    seen = {} if seen is None else seen
    if a not in seen:
        before = text[max(0, a - 30) : a].lower()
        seen[a] = before, _DIGIT_BEFORE.search(before), before[-1:] in "$€£#", before[-2:].strip()[-1:] == ":"
    before, digit_before, money, colon = seen[a]
    if (a, kind) not in seen:
        seen[a, kind] = cue(before, kind)
    d = digits_of(s)
    groups = _GROUP.findall(s)
    sizes = [len(g) for g in groups]
    spelled = kind == "email"
    return [
        b - a, len(d), len(groups), max(sizes, default=0), min(sizes, default=0), s.count("-"), s.count("."), s.count(" "),
        s.count("/") + s.count("_"), s.count("("), s.count(":"), s[:1] == "+", s[:2] == "00", luhn(d) if len(d) > 11 else -1, int(d[:1] or -1), int(d[:2] or -1),
        "@" in s or "＠" in s, spelled and bool(re.search(r"[(\[{<]at[)\]}>]", s, re.I)), spelled and bool(re.search(r"[(\[{<]dot[)\]}>]|\sdot\s", s, re.I)), spelled and bool(re.search(r"\sat\s", s, re.I)),
        *seen[a, kind], money, after[:1] in "%€$£",
        all(len(g) < 4 and int(g) <= 255 for g in groups[:4]), any(c.isalpha() for c in s), colon,
        bool(_DATE.fullmatch(s)), len({*sizes}), *edge(digit_before, s), *edge(_DIGIT_AFTER.match(after), s),
        bool(_YEAR_FIRST.match(s)), sizes[-3:] == [3, 3, 4], sizes[0] if sizes else 0, sizes[-1] if sizes else 0, bool(_DATE_WITHIN.search(s)),
    ]


@dataclass
class Trees:
    """Boosted regression trees on the logistic loss; depth 3, splits at values between those seen."""

    start: float
    trees: list[list[tuple[int, float, float]]]  # seven nodes each: feature (-1: leaf), threshold, value
    rate: float = 0.2

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for tree in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(3):
                f, t = (np.array([n[k] for n in tree])[at] for k in (0, 1))
                f = f.astype(int)
                down = 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > t)
                at = np.where(f >= 0, down, at)
            z += self.rate * np.array([n[2] for n in tree])[at]
        return 1 / (1 + np.exp(-z))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 100) -> Trees:
        model = cls(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), [])
        cuts = [(u[1:] + u[:-1]) / 2 if (u := np.unique(c)).size < 24 else np.unique(np.quantile(c, np.linspace(0.03, 0.97, 24))) for c in x.T]
        z = np.full(len(y), model.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            tree = [(-1, 0.0, 0.0)] * 15
            rows = {0: np.arange(len(y))}
            for node in range(15):
                if node not in rows:
                    continue
                r = rows[node]
                tree[node] = (-1, 0.0, float(g[r].sum() / (h[r].sum() + 1)))
                if node >= 7:
                    continue
                best = (1e-3, -1, 0.0)
                for f, own in enumerate(cuts):
                    if not own.size:
                        continue
                    place = np.searchsorted(own, x[r, f])  # x > own[k] for the first `place` cuts
                    gs, hs = (np.cumsum(np.bincount(place, weights=w[r], minlength=own.size + 1)) for w in (g, h))
                    gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                    k = int(gain.argmax())
                    best = max(best, (float(gain[k]), f, float(own[k])))
                if best[1] >= 0:
                    tree[node] = (best[1], best[2], tree[node][2])
                    right = x[r, best[1]] > best[2]
                    rows[2 * node + 1], rows[2 * node + 2] = r[~right], r[right]
            model.trees.append(tree)
            step = cls(0.0, [tree], model.rate)
            z += np.log(np.maximum(q := step.score(x), 1e-12) / np.maximum(1 - q, 1e-12))
        return model


def drawn(seed: int, n: int) -> Iterator[tuple[str, Span, bool]]:
    """Texts with one marked candidate each, and whether it is personal data: from templates."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9)))

    def card(good: bool) -> str:
        body = r.choice("3456") + num(r.choice((13, 14, 14, 14)))
        check = next(c for c in "0123456789" if luhn(body + c))
        d = body + (check if good else str((int(check) + r.randint(1, 9)) % 10))
        sep = r.choice((".", "/", "_", "  ", " - ", "")) if good else r.choice((" ", "-", "", "."))
        return sep.join([d[:4], d[4:8], d[8:12], d[12:]])

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{num(2)} {a} {b} {c}", f"1-{a}-{b}-{c}", f"{a} {b} {c}", f"+{num(2)}/{a}/{b}{c}", f"0{num(2)} {num(4)} {c}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}"))

    def date() -> str:
        y, m, d = r.choice(("19", "20")) + num(2), f"{r.randint(1, 12):02d}", f"{r.randint(1, 28):02d}"
        return r.choice((f"{y}-{m}-{d}", f"{d}.{m}.{y}", f"{d}/{m}/{y}", f"{y}/{m}/{d}"))

    def across_dates() -> tuple[str, tuple[int, int]]:
        """Dates side by side, and a span over parts of them."""
        whole = r.choice((" ", " ", " - ", "/")).join(date() for _ in range(r.randint(2, 5)))
        return whole, r.choice(list(numbers(whole)))

    def email() -> str:
        at, dot = r.choice((" (at) ", "(at)", " [at] ", "[at]", " at ", "＠", "{at}")), r.choice((" (dot) ", "[dot]", " dot ", "."))
        return word() + r.choice(("", "." + word(), num(2))) + at + word() + (" dot " if at == " at " else dot) + r.choice(("com", "org", "net", "de", "example.com"))

    ip = lambda: r.choice((r.choice((" . ", "[.]", "(.)", "(dot)")).join(str(r.randint(1, 255)) for _ in range(4)), ":".join("%x" % r.randint(1, 65535) for _ in range(8))))
    other = {
        "card": lambda: r.choice((card(False), num(r.randint(7, 25)), phone(), f"20{num(2)}-{num(2)}-{num(2)} {num(2)}.{num(2)}")),
        "phone": lambda: r.choice((num(r.randint(7, 20)), f"20{num(2)}-{num(2)}-{num(2)} {num(2)}", f"{num(2)}.{num(2)}.20{num(2)} {num(2)}", f"20{num(2)}-{num(2)}-{num(2)}", f"{num(3)}.{num(3)}.{num(3)}", f"{num(2)}/{num(2)}/20{num(2)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", card(False), f"{num(4)} {num(4)}", f"{num(1)} {num(3)} {num(3)}")),
        "ip": lambda: r.choice((f"{num(2)}:{num(2)}:{num(2)}", f"{r.randint(256, 999)} . {num(3)} . {num(3)} . {num(3)}", f"{num(1)} . {num(1)} . {num(2)} . {num(1)}")),
        "email": lambda: r.choice((f"{word()} at {word()}.{word()}", f"{word()} at {word()} . {word()}", f"{word()} @ {word()}.{word()}")),
    }
    real = {"card": lambda: card(True), "phone": phone, "ip": ip, "email": email}
    beside = lambda: r.choice((phone(), phone(), card(True), f"20{num(2)}-{num(2)}-{num(2)}", ".".join(str(r.randint(1, 255)) for _ in range(4)), num(r.randint(1, 9))))
    fours = lambda s: " ".join(re.findall("[0-9]{1,4}", digits_of(s)))
    for k in range(n):
        kind, good = KINDS[k % 4], k // 4 % 2 == 0
        s = real[kind]() if good else other[kind]()
        left = right = ""
        if kind in ("card", "phone") and r.random() < 0.4:  # numbers side by side; a part of one, or of both, is none
            s = real[kind]()
            if kind == "card" and r.random() < 0.5:
                s = fours(s)
            near = r.choice((beside, real[kind]))()
            if kind == "card" and " " in s and r.random() < 0.5:
                near = fours(card(True))
            if kind == "phone" and r.random() < 0.5:  # of one format
                near = "".join(num(1) if c.isdigit() else c for c in s)
            sep = r.choice((" ", " ", "  ", " / ", " - "))
            left, right = r.choice(((near + sep, ""), ("", sep + near), ("", "")))
            if not good:
                whole, at = left + s + right, len(left)
                wrong = [x for x in numbers(whole) if x != (at, at + len(s)) and x != (len(whole) - len(near), len(whole)) and x != (0, len(near))]
                if kind == "card":
                    wrong = [x for x in wrong if not luhn(digits_of(whole[slice(*x)]))] or wrong
                if wrong:
                    a, b = r.choice(wrong)
                    left, s, right = whole[:a], whole[a:b], whole[b:]
                else:
                    s, left, right = other[kind](), "", ""
        if kind in ("card", "phone") and not good and r.random() < 0.2:
            whole, (a, b) = across_dates()
            left, s, right = whole[:a], whole[a:b], whole[b:]
        # digits without a telling format count as personal only after a word that says so
        vague = kind == "phone" and good and re.fullmatch(r"[0-9]{3}[. ][0-9]{3}[. ][0-9]{4}|0[0-9]{2} [0-9]{4} [0-9]{4}|0[0-9]( [0-9]{2}){4}", s)
        hint = r.choice(_WORDS[kind]) if vague or r.random() < (0.4 if good or left or right else 0.05) else r.choice(_AGAINST) if not good and r.random() < 0.5 else word()
        before = " ".join(word() for _ in range(3)) + f" {hint}{r.choice((' ', ': '))}" + left
        yield before + s + right + " " + word(), (len(before), len(before) + len(s), kind), good


@cache
def trained() -> dict[str, tuple[Trees, float]]:
    """By kind: the trees, and the lowest threshold (0.5 at least) at which 99.5 % of what is selected from a second draw is right."""
    out = {}
    sets = [[(describe(t, s), s[2], y) for t, s, y in drawn(seed, 10_000)] for seed in (11, 12)]
    for kind in KINDS:
        (x, y), (cx, cy) = ((np.array([f for f, k, _ in rows if k == kind], float), np.array([v for _, k, v in rows if k == kind], float)) for rows in sets)
        model = Trees.fit(x, y)
        p = model.score(cx)
        grid = np.arange(0.5, 1.0, 0.01)
        right = [cy[p >= t].mean() if (p >= t).any() else 1.0 for t in grid]
        out[kind] = model, float(next((t for t, ok in zip(grid, right) if ok >= 0.995), 0.99))
    return out


class Taken:
    """Stretches of a text that don't overlap, in order; a question takes time in proportion to the logarithm of their number."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b, _ in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a

    def add(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def all_spans(text: str, models: dict[str, tuple[Trees, float]] | None = None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then by kind as listed."""
    base = base_spans(text)
    taken = Taken(base)
    proposed = (c for c in candidates(text) if not taken.meets(c[0], c[1]))
    chosen: list[tuple[float, Span]] = []
    # some thousands at a time, so that a text of many numbers needs no more memory than they do
    while part := list(islice(proposed, SLICE)):
        seen: dict = {}
        for kind, (model, threshold) in (models or trained()).items():
            own = [c for c in part if c[2] == kind]
            if own:
                p = model.score(np.array([describe(text, c, seen) for c in own], float))
                chosen += [(s, c) for s, c in zip(p.tolist(), own) if s >= threshold]
    if not chosen:
        return base, base
    added: list[Span] = []
    for _, c in sorted(chosen, key=lambda x: (-x[0], x[1][0], -x[1][1], x[1][2])):
        if not taken.meets(c[0], c[1]):
            taken.add(c[0], c[1])
            added.append(c)
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, the base counts n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added."""
    models = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(x, models.value) for x in common.texts_of(batch["text"])]
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], *counts, pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([listed(every) for _, every in found], pa.string()), pa.array([len(every) - len(base) for base, every in found], pa.int64()),
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact_text(text: str, models: dict[str, tuple[Trees, float]] | None = None) -> str:
    out, at, until, kind = [], 0, 0, ""
    for a, b, k in [*all_spans(text, models)[1], (len(text) + 1, 0, "")]:
        if until and a >= until:
            out.append(f"[{kind.upper()}]")
            at, until = until, 0
        if until:
            until = max(until, b)
        elif b:
            out.append(text[at:a])
            until, kind = b, k
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets; other columns as they were, a null text stays null."""
    at, models = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            texts = pa.array([None if x is None else redact_text(x, models.value) for x in column.to_pylist()], column.type)
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
