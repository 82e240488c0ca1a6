"""Secret spans: fixed patterns, and a linear-chain conditional random field that adds more.

Tokens are all words and signs of a text, short and letter-only ones too, and a chain is a whole
line; Viterbi decodes it exactly. A token's features are its shape, the two tokens before it,
the one after it, what touches it and how near a word such as "password" is. The field is
trained by maximum likelihood on pattern matches and other lines. Each match is also learned
with hidden neighbours and with values of forms that no pattern has: short, with signs, of
letters only, of several words. Key-like tokens that no pattern matches are unlabelled: their
states are summed over. ``FIT_DOCS`` ids and ``FIT_CHAINS`` chains of either kind, by hash
order, bound what is fitted on.

Defined results: null or empty text has no spans. Field spans that touch a pattern span are
left to the pattern. Rows that repeat an id are scanned one by one. Spans count code points.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.llm import words as W
from brickyard.llm.common import stage

FIT_DOCS = 20_000
FIT_CHAINS = 3_000
CHAIN = 24            # tokens of a chain to fit on
FORGET = 500_000      # words whose scores a task remembers
SLICE = 1 << 21       # bytes of text decoded at once
SPACE = 1 << 13       # hashed features
STEPS = 150
KINDS = ("assign", "access", "hex", "field")

# The patterns and least lengths of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

# Kinds of bytes: white space, letters and digits, signs inside words, other signs, their tails.
_SPACE, _WORD, _JOIN, _SIGN, _TAIL = range(5)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = _WORD
_KIND[[ord(c) for c in "+/.-"]] = _JOIN
_KIND[[32, *range(9, 14), *range(28, 32)]] = _SPACE
_VALUE = _KIND == _WORD
_VALUE[[ord(c) for c in "\"'="]] = True
LINE = re.compile(r"[^\n]+")
WORD_FEATURES = ("word", "prev", "prevb", "next")
_LOW = {c: c + 32 for c in range(65, 91)}
CUES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "passphrase")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Pattern matches (start, end, kind), by start and then kind."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def token_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of all words and signs of UTF-8 texts, in order.

    A word runs from a letter, digit or underscore to the last one before anything but those and
    the signs ``+ / . -``, with one or two closing ``=``. Characters beyond ASCII are letters,
    but for the signs of Latin-1 and general punctuation; any other sign stands alone.
    """
    n = len(data)
    kind = _KIND[data]
    for lead, size, rest in ((0xC2, 2, None), (0xE2, 3, (0x80, 0x81))):
        at = np.flatnonzero(data == lead)
        at = at[at + size <= n]
        if rest is not None:
            at = at[np.isin(data[at + 1], rest)]
        kind[at] = _SIGN
        for i in range(1, size):
            kind[at + i] = _TAIL
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    run = (kind == _WORD) | (kind == _JOIN)
    first = run.copy()
    first[1:] &= ~run[:-1] | edge[1:-1]
    last = run.copy()
    last[:-1] &= ~run[1:] | edge[1:-1]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    letters = np.concatenate(([0], np.cumsum(kind == _WORD)))
    some = letters[stop] > letters[begin]
    begin, stop = begin[some], stop[some]
    place = np.flatnonzero(kind == _WORD)
    start = place[letters[begin]] if len(begin) else begin
    end = place[letters[stop] - 1] + 1 if len(begin) else stop
    # one or two closing "=" belong to the word they touch, where nothing of a value follows
    upto = offsets[np.searchsorted(offsets, start, "right")] if len(start) else start
    pad = np.concatenate((data, np.zeros(3, np.uint8)))
    ahead = [np.where(end + i < upto, pad[end + i], 0) for i in range(3)]
    one, two = ahead[0] == 61, (ahead[0] == 61) & (ahead[1] == 61)
    end = end + np.where(two & ~_VALUE[ahead[2]], 2, np.where(one & ~two & ~_VALUE[ahead[1]], 1, 0))
    covered = np.zeros(n + 1, np.int32)
    np.add.at(covered, start, 1)
    np.add.at(covered, end, -1)
    alone = np.flatnonzero((np.cumsum(covered)[:n] == 0) & ((kind == _SIGN) | (kind == _JOIN)))
    size = np.where(data[alone] == 0xC2, 2, np.where(data[alone] == 0xE2, 3, 1))
    start, end = np.concatenate((start, alone)), np.concatenate((end, alone + size))
    by = np.argsort(start, kind="stable")
    return start[by], end[by]


def _points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of all words and signs of a text, in code points."""
    data = np.frombuffer(text.encode(), np.uint8)
    start, end = token_spans(data, np.array([0, len(data)]))
    points = _points(data)
    return list(zip(points[start].tolist(), points[end].tolist()))


def _low(t: str) -> str:
    return t.translate(_LOW)


def _shape_key(t: str) -> tuple:
    """What the shape features of a word are made of, and the word itself where it is one."""
    n = len(t)
    if t.isascii() and t.isalpha() and t[1:].islower():  # as most words are
        upper = t[0] < "a"
        runs = "Aa" if upper else "a"
        return (min(n, 64) // 4, False, upper, True, False, 0, not upper and not t.strip("abcdef"),
                min(9, len(runs) * 8 // n), len(set(t)) * 8 // min(n, 64), runs, 0, 0, 0, _low(t))
    digit = sum(map(str.isdigit, t))
    upper, lower = sum(map(str.isupper, t)), sum(map(str.islower, t))
    if lower == n:
        runs = "a"
    else:
        runs = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a"
                                                if c.islower() else c for c in t))
    return (min(n, 64) // 4, bool(digit), bool(upper), bool(lower), digit + upper + lower < n, digit * 6 // n,
            not t.strip("0123456789abcdef"), min(9, len(runs) * 8 // n), len(set(t)) * 8 // min(n, 64), runs[:8],
            min(4, t.count(".")), min(3, t.count("/")), min(3, t.count("-")),
            _low(t) if t.isalpha() or n == 1 else "")


def _shape_names(size, digit, upper, lower, sign, digits, hexadecimal, switch, kinds, runs, dots, strokes, dashes
                 ) -> list[str]:
    classes = "".join(k for k, v in (("9", digit), ("A", upper), ("a", lower), ("/", sign)) if v)
    return [f"len{size}", f"class{classes}", f"digits{digits}", f"hex{int(hexadecimal)}", f"switch{switch}",
            f"kinds{kinds}", f"shape{runs}", f"dots{dots}{strokes}{dashes}"]


def _shape(t: str) -> list[str]:
    *shape, own = _shape_key(t)
    return [*_shape_names(*shape), f"word\0{own}"]


def _around(words: list[str], spans: list[tuple[int, int]]) -> Iterator[tuple[str, str, str, str, str]]:
    """Each token's features of place: two before, one after, what touches it, the nearest cue."""
    last, n = -9, len(words)
    for i, word in enumerate(words):
        before, after = words[i - 1] if i else "", words[i + 1] if i + 1 < n else ""
        glue = (2 * (i > 0 and spans[i - 1][1] == spans[i][0])
                + (i + 1 < n and spans[i][1] == spans[i + 1][0]))
        yield (f"prev\0{before}", f"prevb\0{words[i - 2] if i > 1 else ''}", f"next\0{after}",
               f"glue{glue}", f"cue{min(9, i - last)}")
        if word.rstrip("=") in CUES:
            last = i


def features(text: str, spans: list[tuple[int, int]], hide: bool = False) -> list[list[str]]:
    """Feature names of each token of a line; every token has equally many."""
    words = [_low(text[a:b]) for a, b in spans]
    return [["bias", *_shape(text[a:b]), *(["hidden"] * 5 if hide else near)]
            for (a, b), near in zip(spans, _around(words, spans))]


@functools.lru_cache(1 << 16)
def _word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(W.hashes(data, np.array([0]), np.array([len(data)]))[0])


def _places(hashes: np.ndarray, feature: int) -> np.ndarray:
    """Indices of one of ``WORD_FEATURES`` for words with these hashes."""
    return (W.mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (feature + 1) % 2**64)) % np.uint64(SPACE)).astype(np.int64)


def _index(name: str) -> int:
    kind, mark, word = name.partition("\0")
    if mark:
        return int(_places(np.array([_word_hash(word)], np.uint64), WORD_FEATURES.index(kind))[0])
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % SPACE


def hashed(names: list[list[str]]) -> np.ndarray:
    return np.array([[_index(f) for f in row] for row in names], np.int32)


@dataclass
class Field:
    """Weights of the chain over the states outside (0), begin (1) and inside (2)."""

    emit: np.ndarray   # SPACE x 3
    step: np.ndarray   # 3 x 3; outside to inside is impossible

    def decode(self, x: np.ndarray) -> list[int]:
        """The best state sequence of one chain of features."""
        return viterbi(self.emit[x].sum(1), np.array([len(x)]), self.step).tolist()


def viterbi(score: np.ndarray, length: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best states of chains that follow each other in ``score``, ties towards the lower state.

    All chains take a step together; those that are used up drop out, so the steps are as many
    as the longest chain has.
    """
    first = np.cumsum(length) - length
    by = np.argsort(-length, kind="stable")
    left = np.searchsorted(-length[by], -np.arange(1, (length.max() if len(length) else 0) + 1), "right")
    back, states = np.zeros((len(score), 3), np.int8), np.zeros(len(score), np.int8)
    best, step = np.zeros((len(length), 3), score.dtype), step.astype(score.dtype)
    for t, count in enumerate(left):
        at = first[by[:count]] + t
        if t:
            way = best[:count, :, None] + step
            back[at] = way.argmax(axis=1)
            best[:count] = way.max(axis=1) + score[at]
        else:
            best[:count] = score[at] + step[0]
    state = best.argmax(axis=1).astype(np.int8)
    for t in range(len(left) - 1, -1, -1):
        count = left[t]
        at = first[by[:count]] + t
        states[at] = state[:count]
        if t:
            state[:count] = back[at, state[:count]]
    return states


class Reader:
    """Field spans of whole texts; scores of words are remembered from text to text.

    What a word adds to the score of its own place and of its neighbours depends on the word
    alone, so a place's score is a sum of looked-up numbers.
    """

    def __init__(self, field: Field):
        self.field = field
        self.place: dict[int, int] = {}
        self.shapes: dict[tuple, np.ndarray] = {}
        self.emit = field.emit.astype(np.float32)
        self.score = np.zeros((1 << 12, 4, 3), np.float32)  # of the word itself, and before, two before, after a place
        self.cue = np.zeros(1 << 12, bool)
        self.glue = np.stack([self._sum([f"glue{i}"]) for i in range(4)])
        self.near = np.stack([self._sum([f"cue{i}"]) for i in range(10)])
        self.bias = self._sum(["bias"])
        self.edge = np.stack([self._sum([f + "\0"]) for f in WORD_FEATURES[1:]])

    def _sum(self, names: list[str]) -> np.ndarray:
        return self.emit[hashed([names])[0]].sum(axis=0)

    def _shape(self, word: str) -> tuple[np.ndarray, bool]:
        """Score of a word's shape, and whether its letters are a feature too."""
        *shape, own = _shape_key(word)
        known = self.shapes.get(tuple(shape))
        if known is None:
            known = self.shapes[tuple(shape)] = self._sum(_shape_names(*shape)) + self.bias
        return known, own != ""

    def _add(self, words: list[str], low: np.ndarray) -> None:
        """Scores of new words; ``low`` has their hashes in lower case."""
        first, n = len(self.place), len(words)
        while first + n > len(self.score):
            self.score = np.concatenate((self.score, np.zeros_like(self.score)))
            self.cue = np.concatenate((self.cue, np.zeros_like(self.cue)))
        shapes = [self._shape(w) for w in words]
        empty = np.uint64(_word_hash(""))
        own = np.where([letters for _, letters in shapes], low, empty)
        emit, at = self.emit, slice(first, first + n)
        self.score[at, 0] = np.array([s for s, _ in shapes]) + emit[_places(own, 0)]
        for j in (1, 2, 3):
            self.score[at, j] = emit[_places(low, j)]
        self.cue[at] = [w[0] in "aAsStTpP" and _low(w).rstrip("=") in CUES for w in words]

    def _ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        key, first, which = np.unique(W.hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.place) + len(key) > FORGET:
            self.place.clear()
        keys, known = key.tolist(), self.place
        new = [n for n, k in enumerate(keys) if k not in known]
        if new:
            raw, at = data.tobytes(), first[new]
            words = [raw[a:b].decode(errors="replace") for a, b in zip(start[at].tolist(), end[at].tolist())]
            self._add(words, W.hashes(W.LOWER[data], start[at], end[at]))
            known.update(zip([keys[n] for n in new], range(len(known), len(known) + len(new))))
        return np.array([known[k] for k in keys], np.int64)[which]

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, start, end) of the field's spans in code points of each text."""
        start, end = token_spans(data, offsets)
        if not len(start):
            return
        row = np.searchsorted(offsets, start, "right") - 1
        line = row + np.concatenate(([0], np.cumsum(data == 10)))[start]
        ids = self._ids(data, start, end)
        new = np.concatenate(([True], line[1:] != line[:-1]))
        head = np.flatnonzero(new)
        place = np.arange(len(ids)) - np.repeat(head, np.diff(np.append(head, len(ids))))
        length = np.diff(np.append(head, len(ids)))
        rest = np.repeat(length, length) - place - 1
        score = self.score[ids, 0]
        for step, j, inside in ((1, 1, place >= 1), (2, 2, place >= 2), (-1, 3, rest >= 1)):
            add = self.score[np.roll(ids, step), j]
            add[~inside] = self.edge[j - 1]
            score += add
        touch = np.zeros(len(ids), bool)
        touch[1:] = (end[:-1] == start[1:]) & ~new[1:]
        after = np.concatenate((touch[1:], [False]))
        score += self.glue[2 * touch + after]
        mark = np.where(self.cue[ids], np.arange(len(ids)), -1)
        seen = np.concatenate(([-1], np.maximum.accumulate(mark)[:-1]))
        away = np.where(seen >= np.arange(len(ids)) - place, np.arange(len(ids)) - seen, 9)
        score += self.near[np.minimum(9, away)]
        state = viterbi(score, length, self.field.step)
        begin = np.flatnonzero(state == 1)
        if not len(begin):
            return
        # inside follows begin or inside of the same line; the span ends with the last of them
        stop = np.flatnonzero((state > 0) & np.concatenate(((state[1:] != 2) | new[1:], [True])))
        stop = stop[np.searchsorted(stop, begin)]
        points = _points(data)
        base = points[offsets[:-1]]
        yield from zip(row[begin].tolist(), (points[start[begin]] - base[row[begin]]).tolist(),
                       (points[end[stop]] - base[row[begin]]).tolist())


def _expected(score: np.ndarray, move: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """State probabilities of each step and expected transitions of chains of one length."""
    n, length, _ = score.shape
    fwd = [score[:, 0] + move[0]]
    for i in range(1, length):
        fwd.append(np.logaddexp.reduce(fwd[-1][:, :, None] + move, axis=1) + score[:, i])
    bwd = [np.zeros((n, 3))]
    for i in range(length - 1, 0, -1):
        bwd.append(np.logaddexp.reduce(move + (bwd[-1] + score[:, i])[:, None, :], axis=2))
    bwd = bwd[::-1]
    norm = np.logaddexp.reduce(fwd[-1], axis=1)[:, None]
    state = [np.exp(f + b - norm) for f, b in zip(fwd, bwd)]
    pair = np.zeros((3, 3))
    pair[0] += state[0].sum(0)
    for i in range(1, length):
        pair += np.exp(fwd[i - 1][:, :, None] + move + (score[:, i] + bwd[i])[:, None, :]
                       - norm[:, :, None]).sum(0)
    return state, pair


def train(examples: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, ridge: float = 1e-3
          ) -> Field | None:
    """Maximum likelihood by Adam; (features, states) per chain, state -1 is unlabelled."""
    if not examples or not any((y > 0).any() for _, y in examples):
        return None
    groups: dict[int, list] = {}
    for x, y in examples:
        groups.setdefault(len(y), []).append((x, y))
    data = [(np.stack([x for x, _ in g]), np.stack([y for _, y in g])) for _, g in sorted(groups.items())]
    emit, step = np.zeros((SPACE, 3)), np.zeros((3, 3))
    ban = np.zeros((3, 3))
    ban[0, 2] = -1e4
    total = sum(len(y) for _, y in data)
    moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(step), np.zeros_like(step)]
    for t in range(1, steps + 1):
        g_emit, g_step = -ridge * emit, -ridge * step
        for x, y in data:
            score, move = emit[x].sum(2), step + ban
            shut = np.where((y[:, :, None] >= 0) & (y[:, :, None] != np.arange(3)), -1e4, 0.0)
            (true, seen), (got, pair) = _expected(score + shut, move), _expected(score, move)
            g_step += (seen - pair) / total
            gap = (np.stack(true, 1) - np.stack(got, 1)).reshape(-1, 3) / total
            flat = x.ravel()
            for s in range(3):
                g_emit[:, s] += np.bincount(flat, np.repeat(gap[:, s], x.shape[2]), SPACE)
        for w, g, a, b in ((emit, g_emit, *moments[:2]), (step, g_step, *moments[2:])):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w += 0.1 * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)
    return Field(emit.astype(np.float32), step + ban)


def values(text: str) -> list[tuple[int, int]]:
    """Spans of the secret values in pattern matches, without the words that announce them."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [m.span() for m in HEX.finditer(text)]
    return sorted(set(out))


def states(text: str, spans: list[tuple[int, int]], truth: list[tuple[int, int]]) -> np.ndarray:
    """Begin, inside or outside for each token by the spans it lies in, -1 for key-like others."""
    y, last = np.zeros(len(spans), np.int32), None
    for i, (start, end) in enumerate(spans):
        hit = next((t for t in truth if t[0] < end and start < t[1]), None)
        if hit is not None:
            y[i] = 2 if hit == last else 1
        elif end - start >= 8 and any(c.isalpha() for c in text[start:end]):
            t = text[start:end]
            y[i] = -1 if any(c.isdigit() for c in t) or not (t.islower() or t.isupper() or t[1:].islower()) else 0
        last = hit
    return y


def segments(text: str) -> Iterator[tuple[bool, str]]:
    """Stretches of lines of about ``CHAIN`` tokens, and whether they hold a pattern match."""
    hits = values(text)
    for line in LINE.finditer(text):
        found = [(a + line.start(), b + line.start()) for a, b in tokens(line[0])]
        for i in range(0, len(found), CHAIN):
            x, y = found[i][0], found[min(i + CHAIN, len(found)) - 1][1]
            yield any(a < y and x < b for a, b in hits), text[x:y]


def forms(rng: random.Random, words: list[str]) -> list[tuple[str, str]]:
    """(text, value) examples of secrets without a fixed pattern; an empty value is none."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = "".join(rng.choice(letters) for _ in range(rng.randrange(5, 8)))
    word, head = rng.choice(words + [made]), f"{rng.choice(words)} {rng.choice(words)} "
    signed = ("".join({"a": "@", "s": "$", "o": "0", "e": "3", "i": "1"}.get(c, c) if rng.random() < 0.8 else c
                      for c in word[:9]).capitalize() + rng.choice("!#$%&*") * rng.randrange(2)
              + rng.choice(("", "7", "42", "!")))
    if signed.isalpha():
        signed += "!"
    short = "".join(rng.choice(letters + "0123456789") for _ in range(rng.randrange(3, 7))) + rng.choice("0123456789")
    mixed = "".join(rng.choice(letters + letters.upper()) for _ in range(rng.randrange(9, 23))) + "qZ"
    phrase = " ".join(rng.choice(words) for _ in range(rng.randrange(3, 6)))
    cue, tail = rng.choice(CUES), rng.choice((";", "", " ;", "\"", ","))
    quote = "\"" if tail == "\"" else ""
    out = [(f"{head}{cue}{rng.choice((' is ', ': ', '=', ' = ', ' '))}{quote}{v}{tail}", v)
           for v in (signed, short, mixed)]
    return [*out, (f"{head}{cue}{rng.choice((': ', '=', ' = '))}{quote}{phrase}{tail}", phrase),
            (f"{head}{cue} {rng.choice(('is', 'was', 'and', 'of', 'for'))} {rng.choice(words)} {phrase}", "")]


def examples(chains: list[tuple[bool, str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, states) of the picked chains and of the forms made for each match."""
    out = []

    def add(text: str, truth: list[tuple[int, int]], hide: bool) -> None:
        found = tokens(text)
        y, x = states(text, found, truth), hashed(features(text, found, hide))
        for i in range(0, len(found), 2 * CHAIN):
            own = y[i:i + 2 * CHAIN].copy()
            own[0] = min(own[0], 1)
            out.append((x[i:i + 2 * CHAIN], own))

    words = sorted({w.lower() for _, t in chains for w in re.findall(r"[^\W\d_]{3,}", t)} - set(CUES)) or ["word"]
    for positive, text in chains:
        add(text, values(text), False)
        if positive:
            add(text, values(text), True)
            rng = random.Random(int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little"))
            for n, (made, value) in enumerate(forms(rng, words)):
                at = made.rindex(value) if value else 0
                add(made, [(at, at + len(value))] if value else [], False)
                if n == 2:  # letters of both cases: also by shape alone
                    add(made, [(at, at + len(value))], True)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        fit_docs: int = FIT_DOCS, fit_chains: int = FIT_CHAINS) -> Field | None:
    """The field from pattern matches; None where the sample has none."""
    order = F.xxhash64("_id")
    own = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    picked = own.select("_id").distinct().orderBy(order, "_id").limit(fit_docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for text in batch["_text"] for r in segments(text)],
                               columns=["positive", "chain"])

    found = stage(own.join(F.broadcast(picked), "_id").select("_text")
                  .mapInPandas(run, "positive boolean, chain string").distinct(), "secret-chains")
    chains = []
    for positive in (True, False):
        chains += [(positive, r.chain) for r in found.filter(F.col("positive") == positive)
                   .orderBy(F.xxhash64("chain"), "chain").limit(fit_chains).collect()]
    return train(examples(chains)) if any(p for p, _ in chains) else None


def scan(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text"
         ) -> DataFrame:
    """One row per document: counts by kind, base_sha256 and all spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None if field is None else Reader(field)
        for batch in batches:
            added: dict[int, list[Span]] = {}
            if reader is not None:
                for at, data, offsets in W.texts(batch.column("text"), SLICE):
                    for row, start, end in reader.spans(data, offsets):
                        added.setdefault(at + row, []).append((start, end, "field"))
            rows = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                base = base_spans(text or "")
                more = [s for s in added.get(i, ()) if not any(b[0] < s[1] and s[0] < b[1] for b in base)]
                count = [sum(s[2] == k for s in base) for k in KINDS[:3]]
                rows.append((*count, hashlib.sha256(written(base).encode()).hexdigest(),
                             written(ordered(base + more)), len(more)))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_field"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, "
             "base_sha256 string, spans string, n_field bigint")


def secrets(docs: DataFrame) -> DataFrame:
    return scan(docs, fit(docs))
