"""Personal data: exact patterns, and a character BiLSTM with CRF transitions.

Patterns find base spans of four kinds by fixed rules.  The model adds spans they miss:
spelt-out or bracketed addresses, card numbers run together with other digits or parted
by dots, phone numbers without a plus, IPv6 and bracketed IP addresses, and two kinds
without patterns, ``secret`` (keys, tokens, passwords with digits) and ``id`` (national
numbers).  It is a bidirectional LSTM over characters with a linear-chain CRF on top,
written and trained in numpy at the driver on generated labelled spans; the seed is fixed,
so every run has the same model, and its size doesn't depend on the data.

A text is cut in overlapping windows, which are decoded by Viterbi.  Every span that can
stand holds a digit, an @, or an at or dot that is spelt out (``_anchors``), so windows
without any of these are passed over.  Spans of all windows of a text are reconciled at
once: parts of one kind that windows' edges have cut are joined where they overlap; what
still ends at an inner edge, overlaps a base span or breaks its kind's structure
(``_valid``) goes, and of the rest the set of disjoint spans with the largest total score
stays (dynamic programming).  All of it is linear in the text but for sorting.

The pass over the texts is one ``mapInArrow``; nothing is shuffled.

Edge cases: null text is empty; offsets are code points; an empty text has no
spans and the digest of the empty string; repeated rows have equal results; a null doc_id
keeps its row; a very long text is worked on in pieces of some MB beside the text itself;
extra columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_arrow, table, text_buffer

BASE_KINDS = 4
KINDS = ("email", "ip", "card", "phone", "secret", "id")
WINDOW, STRIDE = 160, 96
BATCH = 512

# ------------------------------------------------------------------- patterns

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can't begin inside a run of digits unless its first digit does
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, in order of kind and start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


# ---------------------------------------------------------------------- model

#: Classes: digits, each letter, non-ASCII characters, each of these, and the rest of ASCII.
_SINGLE = "@.-_+()/:%, \n\"'=|#[]{}<>;$!"
_DIGITS, _HIGH, _OTHER = 0, 53, 54
N_CLASSES = 55 + len(_SINGLE)
_CLASS = np.full(129, _OTHER, np.int8)
_CLASS[128] = _HIGH
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = _DIGITS, np.arange(27, 53), np.arange(1, 27)
for _k, _c in enumerate(_SINGLE):
    _CLASS[ord(_c)] = 55 + _k
TAGS = 1 + 2 * len(KINDS)  # outside; for each kind, begin and inside
EMBED, HIDDEN = 16, 24
_NEVER = -1e4
_ALLOWED = np.zeros((TAGS, TAGS))
for _t in range(TAGS):
    if _t and _t % 2 == 0:
        _ALLOWED[:, _t] = _NEVER
        _ALLOWED[_t - 1, _t] = _ALLOWED[_t, _t] = 0
_FIRST = np.array([_NEVER if t and t % 2 == 0 else 0.0 for t in range(TAGS)])


def classes_of(text: str) -> np.ndarray:
    out = np.empty(len(text), np.int8)
    for at in range(0, len(text), 1 << 20):
        points = np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)
        out[at : at + len(points)] = _CLASS[np.minimum(points, 128)]
    return out


class Tagger:
    """Parameters by name; two LSTMs (f, b), an output layer and transitions."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        self.p = {"embed": rng.normal(0, 0.3, (N_CLASSES + 1, e)), "out": rng.normal(0, 0.2, (2 * h, TAGS)), "out_b": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
        for d in "fb":
            bias = np.zeros(4 * h)
            bias[h : 2 * h] = 1.0
            self.p |= {f"w{d}": rng.normal(0, 0.25, (e + h, 4 * h)), f"c{d}": bias}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _lstms(self, x: np.ndarray, keep: bool):
        """Both LSTMs side by side, the backward one on reversed steps: (2, n, steps, h) states."""
        n, steps, _ = x.shape
        h = HIDDEN
        w = np.stack([self.p["wf"], self.p["wb"]])
        wx = np.empty((steps, 2, n, 4 * h), x.dtype)
        wx[:, 0] = (x @ w[0, :EMBED] + self.p["cf"]).transpose(1, 0, 2)
        wx[:, 1] = (x @ w[1, :EMBED] + self.p["cb"]).transpose(1, 0, 2)[::-1]
        wx[..., : 3 * h] *= 0.5  # a sigmoid is a half and half a tanh of the half
        inner = w[:, EMBED:].copy()
        inner[..., : 3 * h] *= 0.5
        state, cell = np.zeros((2, n, h), x.dtype), np.zeros((2, n, h), x.dtype)
        out, kept = np.empty((steps, 2, n, h), x.dtype), []
        for t in range(steps):
            z = np.matmul(state, inner)
            z += wx[t]
            np.tanh(z, out=z)
            gates = z[..., : 3 * h]
            gates *= 0.5
            gates += 0.5
            i, f, o, new = z[..., :h], z[..., h : 2 * h], z[..., 2 * h : 3 * h], z[..., 3 * h :]
            if keep:
                kept.append((state, cell, i, f, o, new))
            cell = f * cell + i * new
            state = o * np.tanh(cell)
            out[t] = state
        return out, kept

    def emissions(self, ids: np.ndarray, keep: bool = False):
        x = self.p["embed"][ids]
        out, kept = self._lstms(x, keep)
        both = np.concatenate([out[:, 0], out[::-1, 1]], axis=2).transpose(1, 0, 2)
        return both @ self.p["out"] + self.p["out_b"], (x, both, kept)

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        n, steps, _ = e.shape
        into = (self.p["trans"] + _ALLOWED).T.astype(e.dtype)[None]  # by tag, then by the tag before
        best, back = e[:, 0] + _FIRST.astype(e.dtype), np.empty((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            by = best[:, None, :] + into
            at = by.argmax(axis=2)
            back[t] = at
            best = np.take_along_axis(by, at[:, :, None], axis=2)[:, :, 0] + e[:, t]
        tags = np.empty((n, steps), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        return tags

    def gradient(self, ids: np.ndarray, tags: np.ndarray):
        """Gradients of the CRF's mean negative log-likelihood."""
        n, steps = ids.shape
        e, (x, both, kept) = self.emissions(ids, keep=True)
        # forward and backward sums of each step are scaled to add up to 1
        into = np.exp(self.p["trans"].astype(np.float64) + _ALLOWED)
        own = np.exp(e - e.max(axis=2, keepdims=True), dtype=np.float64).transpose(1, 0, 2)
        a, b, scale = np.empty((steps, n, TAGS)), np.ones((steps, n, TAGS)), np.empty((steps, n, 1))
        for t in range(steps):
            a[t] = own[0] * np.exp(_FIRST) if t == 0 else (a[t - 1] @ into) * own[t]
            scale[t] = a[t].sum(axis=1, keepdims=True)
            a[t] /= scale[t]
        for t in range(steps - 2, -1, -1):
            b[t] = ((b[t + 1] * own[t + 1]) / scale[t + 1]) @ into.T
        de = (a * b).transpose(1, 0, 2).copy()
        g = {"trans": into * (a[:-1].reshape(-1, TAGS).T @ (b[1:] * own[1:] / scale[1:]).reshape(-1, TAGS))}
        np.subtract.at(g["trans"], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1.0)
        de[np.arange(n)[:, None], np.arange(steps), tags] -= 1
        de = (de / n).astype(x.dtype)
        g["trans"] /= n
        g["out"], g["out_b"] = both.reshape(-1, both.shape[2]).T @ de.reshape(-1, TAGS), de.sum(axis=(0, 1))
        h = HIDDEN
        dh = (de @ self.p["out"].T).transpose(1, 0, 2)
        part = np.stack([dh[..., :h], dh[::-1, :, h:]], axis=1)
        inner = np.stack([self.p["wf"][EMBED:], self.p["wb"][EMBED:]]).transpose(0, 2, 1)
        back_h, back_c = np.zeros((2, n, h), x.dtype), np.zeros((2, n, h), x.dtype)
        dzs = np.empty((steps, 2, n, 4 * h), x.dtype)
        for t in range(steps - 1, -1, -1):
            state, cell, i, f, o, new = kept[t]
            now = np.tanh(f * cell + i * new)
            s = part[t] + back_h
            c = back_c + s * o * (1 - now**2)
            dz = dzs[t]
            dz[..., :h] = c * new * i * (1 - i)
            dz[..., h : 2 * h] = c * cell * f * (1 - f)
            dz[..., 2 * h : 3 * h] = s * now * o * (1 - o)
            dz[..., 3 * h :] = c * i * (1 - new**2)
            back_h, back_c = np.matmul(dz, inner), c * f
        before = np.stack([k[0] for k in kept])
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            flat = dzs[:, k].reshape(-1, 4 * h)
            own = x.transpose(1, 0, 2) if d == "f" else x.transpose(1, 0, 2)[::-1]
            g[f"w{d}"] = np.concatenate([own.reshape(-1, EMBED).T @ flat, before[:, k].reshape(-1, h).T @ flat])
            g[f"c{d}"] = flat.sum(axis=0)
            there = (dzs[:, k] @ self.p[f"w{d}"][:EMBED].T)
            dx += (there if d == "f" else there[::-1]).transpose(1, 0, 2)
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], ids, dx)
        return g

    def train(self, ids: np.ndarray, tags: np.ndarray, steps: int, batch: int = 48, rate: float = 0.01, seed: int = 12) -> Tagger:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for s in range(1, steps + 1):
            rows = rng.choice(len(ids), batch, replace=False)
            g = self.gradient(ids[rows], tags[rows])
            norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
            now = rate * min(1.0, 2 * (1 - s / (steps + 1)))
            for k, x in g.items():
                x = x * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x**2
                self.p[k] -= (now * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-7)).astype(np.float32)
        return self


# ------------------------------------------------------- generated training set


def _card(rng) -> str:
    n = rng.choice([16, 16, 16, 19, 15])
    body = "".join(rng.choices("0123456789", k=n - 1))
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


_COMMON = "the of and to in at on is it for with as by an or not dot from der die und el la de les et que un que".split()
_KEYWORDS = "token secret password passwd pwd key api_key apikey auth access_key client_secret bearer".split()
_HASHES = "commit sha1 md5 sha256 checksum revision hash build".split()
_LOWER, _HEX, _MIXED = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def generated(rng: random.Random, least: int) -> tuple[str, list[tuple[int, int, int]]]:
    """A text of at least so many characters and its labelled spans; numbers that are
    nobody's (dates, prices, versions, codes, hashes) are outside."""
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    drawn = lambda of, k: "".join(rng.choices(of, k=k))
    letters = lambda lo, hi: drawn("etaoinshrdlucméüñpmgbfyvkw", rng.randrange(lo, hi))
    plain = lambda lo, hi: drawn(_LOWER, rng.randrange(lo, hi))
    pick = lambda *options: rng.choice(options)

    def email():
        local = pick(plain(2, 9), plain(1, 6) + pick(".", "_", "+", "-") + plain(2, 8), plain(2, 8) + digits(rng.randrange(1, 4)))
        host, end = pick(pick("mail", "corp", "site", "example", "post") + digits(rng.randrange(0, 2)), plain(3, 9), plain(2, 6) + "-" + plain(2, 6)), pick("com", "org", "co.uk", "net", "de", "io", "example.com")
        if rng.random() < 0.45:
            return f"{local}@{host}.{end}"
        at, dot = pick((" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" at ", " dot "), (" [at] ", "."), ("{at}", "{dot}"), ("<at>", "."), ("[at]", "."))
        out = f"{local}{at}{host}{dot}{end.replace('.', dot)}"
        return out.replace("at", "AT").replace("dot", "DOT") if rng.random() < 0.2 and "at" not in local + host + end and "dot" not in local + host + end else out

    def ip():
        parts = [str(rng.randrange(256)) for _ in range(4)]
        x = rng.random()
        if x < 0.5:
            return ".".join(parts)
        if x < 0.75:
            return pick("[.]", "(.)").join(parts)
        groups = [drawn(_HEX, rng.randrange(1, 5)) for _ in range(8)]
        return pick(":".join(groups), ":".join(groups[:4]) + "::" + ":".join(groups[4 : rng.randrange(5, 8)]))

    def card():
        c, sep = _card(rng), pick("", "", " ", "-", ".")
        return sep.join(c[i : i + 4] for i in range(0, len(c), 4))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {a} {b} {c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"00{digits(2)} {a} {b} {c}", f"0{digits(2)} {digits(4)} {c}", f"(0{a}) {b}{c}", f"0{a}/{b}{c}")

    def secret():
        own = pick(drawn(_HEX, pick(32, 40, 40, 64)), drawn(_MIXED, rng.randrange(20, 41)), drawn(_MIXED, rng.randrange(20, 41)))
        if rng.random() < 0.25:
            own = pick("AKIA" + drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "sk-" + drawn(_MIXED, 40), "ghp_" + drawn(_MIXED, 36), "xoxb-" + digits(11) + "-" + drawn(_MIXED, 24))
            return ("", own, "") if rng.random() < 0.5 else (pick(*_KEYWORDS) + pick("=", ": ", " = "), own, "")
        if rng.random() < 0.25:
            own = plain(2, 7) + digits(rng.randrange(1, 5)) + pick("", "!", "#", "$", "_x") + pick("", plain(1, 4), drawn(_MIXED, 3))
        if not any(c.isdigit() for c in own) or len(own) < 6:
            own += digits(3)
        word, quote = pick(*_KEYWORDS), pick("", '"', "'", '"')
        return (word.upper() if rng.random() < 0.2 else word) + pick(" = ", "=", ": ", ":", " is ") + quote, own, quote

    def identity():
        a = f"{digits(3)}-{digits(2)}-{digits(4)}"
        return pick(a, a, f"{drawn('ABCEGHJKLMNPRSTWXYZ', 2)} {digits(2)} {digits(2)} {digits(2)} {drawn('ABCD', 1)}", f"{drawn('ABCEGHJKLMNPRSTWXYZ', 2)}{digits(6)}{drawn('ABCD', 1)}", f"{digits(3)}.{digits(3)}.{digits(3)}-{digits(2)}", f"{digits(8)}{drawn('TRWAGMYFPDXBNJZSQVHLCKE', 1)}")

    def nobodys():
        return pick(f"{digits(4)}-{digits(2)}-{digits(2)}", f"${digits(2)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", digits(rng.randrange(1, 8)), f"{digits(2)}:{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", letters(2, 5) + digits(3), f"{digits(1)},{digits(3)},{digits(3)}", digits(12), f"{letters(3, 6)}-{digits(5)}", f"{digits(3)} {digits(2)} {digits(3)}", "@" + letters(3, 8), f"{digits(1)}.{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{pick(*_HASHES)} {drawn(_HEX, pick(7, 8, 32, 40, 64))}", f"{pick(*_HASHES)}: {drawn(_HEX, 40)}", f"{plain(3, 6)} = {digits(rng.randrange(1, 6))}", f"{plain(2, 5)}_{digits(2)}", f"({letters(2, 7)})", f"[{digits(1)}]", f"{pick('a', 'on', 'the')} {pick('dot', 'at')} {letters(2, 7)}", f"{pick(*_KEYWORDS)} {letters(3, 8)}", f"{pick(*_KEYWORDS)}: {letters(3, 8)}")

    parts, spans, n = [], [], 0

    def add(what: str, kind: int = -1) -> None:
        nonlocal n
        if kind >= 0:
            spans.append((kind, n, n + len(what)))
        parts.append(what)
        n += len(what)

    while n < least:
        x = rng.random()
        if x < 0.24:
            kind = rng.randrange(0, len(KINDS))
            for again in range(1 + (rng.random() < 0.2)):  # some stand next to another of their kind
                add(" " * again)
                if KINDS[kind] == "secret":
                    before, own, after = secret()
                    add(before)
                    add(own, kind)
                    add(after)
                else:
                    add((email, ip, card, phone, None, identity)[kind](), kind)
        elif x < 0.38:
            add(nobodys())
        else:
            add(pick(*_COMMON) if rng.random() < 0.35 else letters(1, 10))
        add(pick(" ", " ", " ", " ", ". ", ", ", "\n", "%%% ", "&&& ", " | "))
    return "".join(parts), spans


def examples(n: int, seed: int = 7, length: int = 112) -> tuple[np.ndarray, np.ndarray]:
    """(class ids, tags) of n pieces of generated text."""
    rng = random.Random(seed)
    ids, tags = np.empty((n, length), np.int64), np.zeros((n, length), np.int64)
    for r in range(n):
        text, spans = generated(rng, 2 * length)
        cut = rng.randrange(length // 2)
        ids[r] = classes_of(text)[cut : cut + length]
        row = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            row[a:b] = 2 + 2 * kind
            row[a] = 1 + 2 * kind
        row = row[cut : cut + length]
        if row[0] and row[0] % 2 == 0:  # a span cut by the window's start begins there
            row[0] -= 1
        tags[r] = row
    return ids, tags


@lru_cache(maxsize=2)
def trained(steps: int = 500, windows: int = 3000) -> Tagger:
    return Tagger().train(*examples(windows), steps=steps)


# -------------------------------------------------------------------- decoding


_AT = re.compile(r"\s*[\[({<]\s?at\s?[\])}>]\s*|\s+at\s+", re.I)
_DOT = re.compile(r"\s*[\[({<]\s?dot\s?[\])}>]\s*|\s+dot\s+", re.I)
_SPELT = re.compile(r"\bdot\b|[\[({<] ?at ?[\])}>]")
_PHONE_LIKE = re.compile(r"[+(]?[0-9][\x20()./0-9-]+[0-9]")
_CARD_LIKE = re.compile(r"[0-9](?:[\x20.-]?[0-9])+")
_ID_LIKE = re.compile(r"[A-Z]{0,2}(?:[\x20.-]?[0-9]+)+[\x20-]?[A-Z]?")


def _is_ip(s: str) -> bool:
    if "." in s:
        parts = re.split(r"\[\.\]|\(\.\)|\.", s)
        return len(parts) == 4 and all(p.isdecimal() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    try:
        return s.count(":") >= 3 and s[0] != ":" and ipaddress.ip_address(s) is not None
    except ValueError:
        return False


def _valid(kind: int, s: str, before: str, after: str) -> bool:
    """Whether s can be of its kind at all; whole tokens only."""
    if (before.isalnum() and s[0].isalnum()) or (after.isalnum() and s[-1].isalnum()):
        return False
    digits = _DIGIT.findall(s)
    if kind == 0:
        plain = _DOT.sub(".", s if "@" in s else _AT.sub("@", s, count=1))
        if plain.count("@") != 1 or ("@" not in s and not _SPELT.search(s.lower())):
            return False
        local, domain = plain.split("@")
        return bool(_LOCAL.match(local)) and bool(_DOMAIN.fullmatch(domain))
    if kind == 1:
        return _is_ip(s) and before not in ".:" and after != ":" if before else _is_ip(s) and after != ":"
    if kind == 2:
        return 13 <= len(digits) <= 19 and bool(_CARD_LIKE.fullmatch(s)) and luhn("".join(digits))
    if kind == 3:
        return 9 <= len(digits) <= 15 and bool(_PHONE_LIKE.fullmatch(s)) and bool(re.search(r"[\x20()./-]", s)) and (not before or before not in "+.-/") and (not after or after not in "-/")
    if kind == 4:
        return 6 <= len(s) <= 200 and bool(digits) and not re.search(r"\s", s) and any(c.isalpha() for c in s)
    return 6 <= len(digits) <= 12 and bool(_ID_LIKE.fullmatch(s)) and (not before or before not in "+.-/") and (not after or after not in "-/")


def best_disjoint(spans: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (score, kind, start, end): the disjoint ones of largest total score."""
    spans = sorted(set(spans), key=lambda s: (s[3], s[2], -s[0], s[1]))
    ends = [s[3] for s in spans]
    best, pick = [0.0], []
    for k, (score, _, start, _) in enumerate(spans):
        j = bisect_right(ends, start, 0, k)
        take = best[j] + score
        pick.append((take > best[k], j))
        best.append(max(take, best[k]))
    out, k = [], len(spans)
    while k:
        taken, j = pick[k - 1]
        if taken:
            out.append(spans[k - 1][1:])
            k = j
        else:
            k -= 1
    return out[::-1]


def _anchors(text: str, ids: np.ndarray) -> np.ndarray:
    """Where the text has a digit, an @, or an at or dot that is spelt out."""
    own = np.flatnonzero((ids == _DIGITS) | (ids == 55))
    low = text.lower() if "t" in text or "T" in text else ""
    if len(low) == len(text) and ("dot" in low or any(b + x in low for b in "[({<" for x in ("at", " at"))):
        own = np.union1d(own, np.array([m.start() for m in _SPELT.finditer(low)], np.int64))
    return own


def _windows(anchors: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold an anchor."""
    k = anchors // STRIDE
    return np.unique(np.concatenate([np.maximum(k - back, 0) for back in range(-(-WINDOW // STRIDE))])) * STRIDE


def _joined_parts(found: list[tuple[float, int, int, int, bool, bool]]) -> list[tuple[float, int, int, int]]:
    """(score, kind, start, end) of (score, kind, start, end, cut at the left, at the right):
    parts of one kind that overlap are one span if an edge has cut one of them there; what is
    still cut goes."""
    out, by_kind = [], {}
    for f in sorted(found, key=lambda f: (f[1], f[2], -f[3])):
        had = by_kind.get(f[1])
        if had is not None and f[2] < had[3] and (had[5] or f[4]):
            if f[3] > had[3]:
                rate = (had[0] / (had[3] - had[2]) + f[0] / (f[3] - f[2])) / 2
                by_kind[f[1]] = (rate * (f[3] - had[2]), f[1], had[2], f[3], had[4] and f[2] >= had[2], f[5])
            elif f[3] == had[3]:
                by_kind[f[1]] = (*had[:5], had[5] and f[5])
            continue
        if had is not None:
            out.append(had)
        by_kind[f[1]] = f
    return [f[:4] for f in (*out, *by_kind.values()) if not (f[4] or f[5])]


def _merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint intervals that the spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def find_spans(texts: list[str], model: Tagger) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text: its base spans, and those that the model adds."""
    base = [base_spans(t) if t else [] for t in texts]
    found: list[list[tuple[float, int, int, int, bool, bool]]] = [[] for _ in texts]
    todo: list[tuple[int, int, int, np.ndarray]] = []

    def flush() -> None:
        ids = np.stack([w[3] for w in todo])
        e, _ = model.emissions(ids)
        tags = model.viterbi(e)
        size = np.array([w[2] for w in todo])
        tags[np.arange(WINDOW)[None, :] >= size[:, None]] = 0
        # one row after another, each with an outside tag at its end
        flat = np.concatenate([tags, np.zeros((len(tags), 1), np.int8)], axis=1).ravel()
        gain = np.zeros((len(tags), WINDOW + 1))
        gain[:, :-1] = np.take_along_axis(e, tags[:, :, None].astype(np.int64), axis=2)[:, :, 0] - e[:, :, 0]
        total = np.concatenate([[0.0], np.cumsum(gain)])
        begin = np.flatnonzero((flat > 0) & (flat % 2 == 1))
        stops = np.flatnonzero((flat == 0) | (flat % 2 == 1))
        end = stops[np.searchsorted(stops, begin + 1)]
        score = total[end] - total[begin]
        for k in np.flatnonzero(score > 0).tolist():
            row, at = divmod(int(begin[k]), WINDOW + 1)
            until = at + int(end[k] - begin[k])
            text, base_at, length, _ = todo[row]
            found[text].append((float(score[k]), (int(flat[begin[k]]) - 1) // 2, base_at + at, base_at + until, at == 0 and base_at > 0, until == length and base_at + length < len(texts[text])))
        todo.clear()

    for k, text in enumerate(texts):
        if not text:
            continue
        ids = classes_of(text)
        anchors = _anchors(text, ids)
        if not len(anchors):
            continue
        for at in _windows(anchors):
            w = np.full(WINDOW, N_CLASSES, np.int64)
            own = ids[at : at + WINDOW]
            if not len(own):
                continue
            w[: len(own)] = own
            todo.append((k, int(at), len(own), w))
            if len(todo) == BATCH:
                flush()
    if todo:
        flush()
    out = []
    for text, own, more in zip(texts, base, found, strict=True):
        kept = []
        starts, ends = _merged(own)
        for score, kind, a, b in _joined_parts(more):
            while b > a and text[b - 1] in " -.(,":
                b -= 1
            k = bisect_left(starts, b)
            if k and ends[k - 1] > a:
                continue
            if b > a and _valid(kind, text[a:b], text[a - 1] if a else "", text[b] if b < len(text) else ""):
                kept.append((score, kind, a, b))
        out.append((own, best_disjoint(kept)))
    return out


# ------------------------------------------------------------------ DataFrames


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_found long"


def _finder(shared):
    def run(batches):
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(off[:-1], off[1:], strict=True)]
            rows = [(*(sum(k == kind for k, _, _ in own) for kind in range(BASE_KINDS)), hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(own + more), len(own) + len(more)) for own, more in find_spans(texts, shared.value)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:6]), pa.array(cols[6], pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found"])

    return run


def find(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, all spans of each row of docs, and how
    many these are."""
    spark = docs.sparkSession
    bound_arrow(spark)
    shared = spark.sparkContext.broadcast(trained())  # a few thousand numbers
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_finder(shared), _FOUND)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind; overlapping spans become one, of
    the kind that starts first."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with all spans replaced by [KIND]; other columns stay, null texts too."""
    spark = docs.sparkSession
    bound_arrow(spark)
    shared = spark.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def clean(text):
        import pandas as pd

        some = text[text.notna()]
        found = find_spans(list(some), shared.value)
        return pd.Series([masked(t, own + more) for t, (own, more) in zip(some, found, strict=True)], index=some.index, dtype=object).reindex(text.index)

    return docs.withColumn("text", clean(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: personal data in all documents."""
    return find(table(spark, sf_dir, "documents"))
