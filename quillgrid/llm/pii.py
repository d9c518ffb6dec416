"""Personal data: a character-level bidirectional LSTM with CRF transitions beside fixed patterns.

The fixed patterns give the base spans.  The network finds what they miss: spelled-out, broken and
disguised forms.  It is trained in numpy on labelled spans in windows of a bounded sample: base spans
as they stand, base spans and made-up ones in disguise, and look-alikes that are none.  It reads
overlapping windows of every whole text; for each character the window in whose middle it lies
decides, so the decoded windows agree on one global labelling.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, hash_sample, table, whole_ids

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, between the starts of two windows, and of a window in training.
WINDOW, STRIDE, SHORT = 256, 224, 80
#: Documents of the training sample (about), characters of the part that is taken from each, and windows drawn from them at most.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_WINDOWS = 1500, 4000, 3000
#: Sizes of the network, and the mean probability of its labels from which a span is added.
EMBED, HIDDEN, CONFIDENCE = 16, 16, 0.7
#: Windows that one pass through the network reads at most, steps whose states it holds, and characters of texts that are laid side by side for it.
BATCH, RUN, BLOCK = 1024, 16, 1 << 20
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
VOCAB = 131  # ASCII, and: other letter, other character, padding
PAD = 130

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The look-behinds start a run of digits at its beginning only; a match that fails there fails within the run too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, one look at each at sign: the local part reaches back to the last match at most."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        last = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = text.find("@", last)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind by the fixed patterns, leftmost and non-overlapping; failing matches are dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(_emails(text))
    if _DIGIT.search(text):
        if "." in text:
            found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


def encode(text: str) -> np.ndarray:
    """Input symbols of a text's characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points, np.where((points >= 0xC0) & (points < 0x2000), 128, 129)).astype(np.uint8)


@dataclass
class Tagger:
    """Weights of the network; arrays are float32 by name.  Arrays of both reading directions are stacked.

    The activation of cells and, moved to 0 to 1, of gates is x / (1 + |x|), whose slope is (1 - |y|) squared.
    """

    w: dict[str, np.ndarray]

    @staticmethod
    def fresh(rng: np.random.Generator) -> Tagger:
        w = {"emb": rng.normal(0, 0.5, (VOCAB, EMBED)), "out": rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
        w |= {"x": rng.normal(0, EMBED**-0.5, (2, EMBED, 4 * HIDDEN)), "h": rng.normal(0, HIDDEN**-0.5, (2, HIDDEN, 4 * HIDDEN)), "c": np.zeros((2, 1, 4 * HIDDEN))}
        w["c"][:, :, HIDDEN : 2 * HIDDEN] = 1.5  # gates remember at first
        return Tagger({k: v.astype(np.float32) for k, v in w.items()})

    def states(self, symbols: np.ndarray, kept: list | None = None) -> np.ndarray:
        """Hidden states (time, batch, both directions) of windows (batch, time); ``kept`` collects what the backward pass needs."""
        size, n = symbols.shape
        inputs = self.w["emb"] @ self.w["x"] + self.w["c"]  # of each symbol, by direction
        by_time = np.ascontiguousarray(symbols.T)
        h, c, moved = (np.zeros((2, size, HIDDEN), np.float32) for _ in range(3))
        states = np.empty((n, size, 2 * HIDDEN), np.float32)
        z, g, half = np.empty((2, size, 4 * HIDDEN), np.float32), np.empty((2, size, 4 * HIDDEN), np.float32), np.float32(0.5)
        gate = [g[:, :, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4)]  # input, forget, output (each (1 + g) / 2), and the new content
        for t in range(n):
            if kept is not None:
                kept.append([c.copy(), h.copy()])
            inputs[0].take(by_time[t], axis=0, out=g[0], mode="clip")
            inputs[1].take(by_time[n - 1 - t], axis=0, out=g[1], mode="clip")
            np.matmul(h, self.w["h"], out=z)
            z += g
            np.abs(z, out=g)
            g += 1
            np.divide(z, g, out=g)
            np.multiply(gate[1], c, out=moved)
            c += moved
            np.multiply(gate[0], gate[3], out=moved)
            c += moved
            c += gate[3]
            c *= half
            np.abs(c, out=moved)
            moved += 1
            np.divide(c, moved, out=moved)
            np.multiply(gate[2], moved, out=h)
            h += moved
            h *= half
            states[t, :, :HIDDEN], states[n - 1 - t, :, HIDDEN:] = h[0], h[1]
            if kept is not None:
                kept[-1] += [g.copy(), moved.copy()]
        return states

    def emissions(self, symbols: np.ndarray) -> np.ndarray:
        """Tag scores (tag, time, batch) of windows (batch, time).

        The steps of :meth:`states` for reading: each gate is brought into a block of its own, so that all that follows runs over whole
        blocks; states have twice their value, by weights of half (which is exact); their scores are summed ``RUN`` steps at a time.
        """
        size, n = symbols.shape
        inputs = self.w["emb"] @ self.w["x"] + self.w["c"]  # of each symbol, by direction
        weights, out, half = self.w["h"] / 2, self.w["out"].T.reshape(TAGS, 2, HIDDEN).transpose(1, 0, 2) / 2, np.float32(0.5)
        by_time = np.ascontiguousarray(symbols.T)
        e = np.empty((TAGS, n, size), np.float32)
        e[:] = self.w["bias"][:, None, None]
        z, h, run = np.empty((2, size, 4 * HIDDEN), np.float32), np.zeros((2, size, HIDDEN), np.float32), np.empty((2, RUN, size, HIDDEN), np.float32)
        blocks = np.arange(2 * size).reshape(2, size) * 4 + np.array([2, 0, 1, 3])[:, None, None]  # where gates stand in z: output, input, forget, new content
        moved_in = np.empty((4, 2, size, HIDDEN), np.float32)
        added, by_gate = moved_in.reshape(z.shape), z.reshape(-1, HIDDEN)
        g = np.zeros((5, 2, size, HIDDEN), np.float32)  # the gates, the new content, and the cell
        gates, content, cell = g[:4], g[3:], g[4]
        moved, squashed = np.empty((2, 2, size, HIDDEN), np.float32), np.empty((2, size, HIDDEN), np.float32)
        for t in range(n):
            inputs[0].take(by_time[t], axis=0, out=added[0], mode="clip")
            inputs[1].take(by_time[n - 1 - t], axis=0, out=added[1], mode="clip")
            np.matmul(h, weights, out=z)
            z += added
            by_gate.take(blocks, axis=0, out=moved_in, mode="clip")
            np.abs(moved_in, out=gates)
            gates += 1
            np.divide(moved_in, gates, out=gates)
            np.multiply(g[1:3], content, out=moved)
            moved += content
            np.add(moved[0], moved[1], out=cell)
            cell *= half
            np.abs(cell, out=squashed)
            squashed += 1
            np.divide(cell, squashed, out=squashed)
            np.multiply(g[0], squashed, out=h)
            h += squashed
            k = t % RUN
            run[0, k], run[1, RUN - 1 - k] = h[0], h[1]
            if k == RUN - 1 or t == n - 1:
                e[:, t - k : t + 1] += (out[0] @ run[0, : k + 1].reshape(-1, HIDDEN).T).reshape(TAGS, k + 1, size)
                e[:, n - 1 - t : n - t + k] += (out[1] @ run[1, RUN - 1 - k :].reshape(-1, HIDDEN).T).reshape(TAGS, k + 1, size)
        return e

    def passes(self, e: np.ndarray) -> tuple[np.ndarray, ...]:
        """(tag factors, forward and backward weights, scale by time) of the chain; the product of the weights is the tags' probabilities."""
        trans = np.exp(self.w["trans"].astype(np.float64))
        n, size = e.shape[:2]
        p = np.exp((e - e.max(2, keepdims=True)).astype(np.float64))
        a, b, scale = np.empty_like(p), np.empty_like(p), np.zeros((n, size, 1))
        a[0] = p[0]
        for t in range(n):
            if t:
                a[t] = (a[t - 1] @ trans) * p[t]
            scale[t] = a[t].sum(1, keepdims=True)
            a[t] /= scale[t]
        b[-1] = 1.0
        for t in range(n - 2, -1, -1):
            b[t] = ((b[t + 1] * p[t + 1]) @ trans.T) / scale[t + 1]
        return p, a, b, scale

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tag probabilities, transition probabilities summed over time, log partition) of the chain."""
        p, a, b, scale = self.passes(e)
        trans, pairs = np.exp(self.w["trans"].astype(np.float64)), np.zeros((TAGS, TAGS))
        for t in range(1, len(e)):
            pairs += trans * (a[t - 1].T @ (b[t] * p[t] / scale[t]))
        return a * b, pairs, (np.log(scale) + e.max(2, keepdims=True)).sum((0, 2))

    def best_scores(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best score of a labelling up to each place by its last tag (time, tag, batch), score of the one that is outside throughout).

        ``e``: tag scores (tag, time, batch).
        """
        n = e.shape[1]
        trans, best, outside = self.w["trans"][:, :, None], np.empty((n, TAGS, e.shape[2]), e.dtype), e[0, 0]
        best[0] = e[:, 0]
        for t in range(1, n):
            np.max(best[t - 1][:, None, :] + trans, axis=0, out=best[t])
            best[t] += e[:, t]
            outside = outside + self.w["trans"][0, 0] + e[0, t]
        return best, outside

    def trace(self, best: np.ndarray) -> np.ndarray:
        """The best tag sequence (time, batch): the best predecessor of each chosen tag, backwards."""
        path = np.empty((len(best), best.shape[2]), np.int64)
        path[-1] = best[-1].argmax(0)
        for t in range(len(best) - 2, -1, -1):
            path[t] = (best[t] + self.w["trans"][:, path[t + 1]]).argmax(0)
        return path

    def gradients(self, symbols: np.ndarray, tags: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean negative log likelihood of windows and their tags (batch, time)."""
        kept: list = []
        states = self.states(symbols, kept)
        e = states @ self.w["out"] + self.w["bias"]
        p, pairs, partition = self.marginals(e)
        y = tags.T
        gold = np.take_along_axis(e, y[:, :, None], 2)[:, :, 0].sum(0) + self.w["trans"][y[:-1], y[1:]].sum(0)
        n, size = y.shape
        de = p.copy()
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
        de = (de / size).astype(np.float32)
        np.subtract.at(pairs, (y[:-1].ravel(), y[1:].ravel()), 1)
        found = {"trans": (pairs / size).astype(np.float32), "out": np.einsum("tbh,tbk->hk", states, de), "bias": de.sum((0, 1))}
        dh = de @ self.w["out"].T
        dz = np.empty((n, 2, size, 4 * HIDDEN), np.float32)
        carry_h = carry_c = np.zeros((2, size, HIDDEN), np.float32)
        back, dw = self.w["h"].transpose(0, 2, 1), np.zeros_like(self.w["h"])
        for t in range(n - 1, -1, -1):
            before, last, g, squashed = kept[t]
            gates = (1 + g[:, :, : 3 * HIDDEN]) / 2
            slope = (1 - np.abs(g)) ** 2
            slope[:, :, : 3 * HIDDEN] *= 0.5
            ht = np.stack([dh[t, :, :HIDDEN], dh[n - 1 - t, :, HIDDEN:]]) + carry_h
            ct = carry_c + ht * gates[:, :, 2 * HIDDEN :] * (1 - np.abs(squashed)) ** 2
            dz[t] = np.concatenate([ct * g[:, :, 3 * HIDDEN :], ct * before, ht * squashed, ct * gates[:, :, :HIDDEN]], axis=2) * slope
            dw += last.transpose(0, 2, 1) @ dz[t]
            carry_h, carry_c = dz[t] @ back, ct * gates[:, :, HIDDEN : 2 * HIDDEN]
        # By symbol: the inputs of a direction are a table of VOCAB rows.
        table = np.zeros((2, VOCAB, 4 * HIDDEN), np.float32)
        for k, seen in enumerate((symbols.T, symbols.T[::-1])):
            at = np.zeros((VOCAB, n * size), np.float32)
            at[seen.ravel(), np.arange(n * size)] = 1
            table[k] = at @ dz[:, k].reshape(n * size, -1)
        found |= {"h": dw, "c": table.sum(1, keepdims=True), "x": self.w["emb"].T @ table, "emb": (table @ self.w["x"].transpose(0, 2, 1)).sum(0)}
        return found, float((partition - gold).mean())

    def candidates(self, e: np.ndarray) -> np.ndarray:
        """Windows that may not be outside throughout, of tag scores (tag, time, batch): none that is not is left out.

        A bound of :meth:`best_scores`: tags that begin a span count as one tag and tags inside as another, each with the best score and
        the best transitions of any of them.  Sums and maxima of floats keep their order, so the bound holds as computed.
        """
        groups = (slice(0, 1), slice(1, None, 2), slice(2, None, 2))
        trans = np.array([[self.w["trans"][a, b].max() for b in groups] for a in groups], e.dtype)[:, :, None]
        top = np.stack([e[k].max(0) for k in groups], axis=1)
        bound, outside = top[0].copy(), e[0, 0]
        for t in range(1, len(top)):
            np.max(bound[:, None] + trans, axis=0, out=bound)
            bound += top[t]
            outside = outside + self.w["trans"][0, 0] + e[0, t]
        return np.flatnonzero(bound.max(0) > outside)

    def decode(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, best tags (window, time), their probabilities) of the windows that are not outside throughout, of tag scores (tag, time, batch)."""
        best, outside = self.best_scores(e)
        some = np.flatnonzero(best[-1].max(0) > outside)
        tags = self.trace(best[:, :, some])
        _, a, b, _ = self.passes(e[:, :, some].transpose(1, 2, 0))
        return some, tags.T, np.take_along_axis(a * b, tags[:, :, None], 2)[:, :, 0].T

    def read(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(text number, position, tag, probability) of all characters that are not outside.

        Overlapping windows are reconciled over each whole text: a character takes its tag from the
        window in which it stands furthest from an edge.
        """
        # Texts stand side by side, each with padding up to the end of its last window.
        windows = np.array([max(1, -(-(len(t) - WINDOW) // STRIDE) + 1) for t in texts], np.int64)
        room = (windows - 1) * STRIDE + WINDOW
        base = np.cumsum(room) - room
        symbols = np.full(int(room.sum()), PAD, np.uint8)
        for t, at in zip(texts, base, strict=True):
            for k in range(0, len(t), BLOCK):
                part = encode(t[k : k + BLOCK])
                symbols[at + k : at + k + len(part)] = part
        own = np.repeat(np.arange(len(texts)), windows)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
        margin, offsets = (WINDOW - STRIDE) // 2, np.arange(WINDOW)
        found, held = [], []  # ``held``: windows and tag scores of candidates, decoded together

        def settle() -> None:
            if sum(len(k) for k, _ in held):
                at = np.concatenate([k for k, _ in held])
                some, tags, p = self.decode(np.concatenate([e for _, e in held], axis=2))
                at = at[some]
                low = np.where(nth[at] == 0, 0, margin)[:, None]
                high = np.where(nth[at] == windows[own[at]] - 1, WINDOW, margin + STRIDE)[:, None]
                k, c = np.nonzero((tags > 0) & (offsets >= low) & (offsets < high))
                found.append((own[at][k], nth[at][k] * STRIDE + c, tags[k, c], p[k, c]))
            held.clear()

        # Passes of about one size: small ones cost nearly as much as large ones.
        for part in np.array_split(np.arange(len(own)), -(-len(own) // BATCH)) if len(own) else []:
            e = self.emissions(symbols[(base[own[part]] + nth[part] * STRIDE)[:, None] + offsets])
            some = self.candidates(e)
            if sum(len(k) for k, _ in held) + len(some) > BATCH:
                settle()
            held.append((part[some], e[:, :, some]))
        settle()
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def spans(self, texts: list[str], confidence: float = CONFIDENCE) -> list[dict[str, list[tuple[int, int]]]]:
        """Spans of each kind in each text that the network is sure of."""
        found: list[dict[str, list[tuple[int, int]]]] = [{k: [] for k in KINDS} for _ in texts]
        own, pos, tag, p = self.read(texts)
        if not len(pos):
            return found
        kind = (tag + 1) // 2
        starts = np.concatenate([[True], (np.diff(pos) != 1) | (np.diff(own) != 0) | (np.diff(kind) != 0)]) | (tag % 2 == 1)
        at = np.flatnonzero(starts)
        ends = np.append(at[1:], len(pos))
        for s, e in zip(at[tag[at] % 2 == 1], ends[tag[at] % 2 == 1], strict=True):
            if p[s:e].mean() >= confidence and pos[e - 1] < len(texts[own[s]]):
                found[own[s]][KINDS[kind[s] - 1]].append((int(pos[s]), int(pos[e - 1]) + 1))
        return found


_AT, _DOT = r"(?:\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\s?@\s?)", r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\s?\.\s?|\sdot\s)"
_PART = "[a-z0-9_+-]+"
#: Disguised addresses; a bare "at" counts only beside a spelled "dot", as "look at a.com" is none.
_SPELLED_EMAIL = re.compile(rf"{_PART}(?:(?:\.|{_DOT}){_PART})*(?:{_AT}{_PART}(?:{_DOT}{_PART})*{_DOT}[a-z]{{2,}}|\sat\s{_PART}(?:\sdot\s{_PART})*\sdot\s[a-z]{{2,}})", re.IGNORECASE)
_SPELLED_IP = re.compile(rf"[0-9]{{1,3}}({_DOT})[0-9]{{1,3}}(?:\1[0-9]{{1,3}}){{2}}", re.IGNORECASE)
_BROKEN_CARD = re.compile(r"[0-9]{4}([^0-9A-Za-z]{1,3})[0-9]{4}(?:\1[0-9]{1,6}){1,3}")
_BROKEN_PHONE = re.compile(r"(?:(?:\+|00|plus) ?[0-9]{1,3}[^0-9A-Za-z]{0,3})?\(?[0-9]{1,4}\)?(?:[^0-9A-Za-z]{1,3}[0-9]{2,4}){1,4}", re.IGNORECASE)
_DATE = re.compile(r"(?:[0-9]{4}([-./ ])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./ ])[0-9]{1,2}\2[0-9]{4}|[0-9]{4}[^0-9]{1,3}[0-9]{4})")


def plausible(kind: str, span: str) -> bool:
    """Whether a span that the network found can be of its kind: the whole span has one of the disguised forms and passes the kind's counts."""
    numbers = re.findall("[0-9]+", span)
    digits = "".join(numbers)
    if kind == "email":
        return bool(_SPELLED_EMAIL.fullmatch(span))
    if kind == "ip":
        return bool(_SPELLED_IP.fullmatch(span)) and all(int(x) <= 255 for x in numbers)
    if kind == "card":
        return bool(_BROKEN_CARD.fullmatch(span)) and 16 <= len(digits) <= 19 and luhn(digits)
    return bool(_BROKEN_PHONE.fullmatch(span)) and 8 <= len(digits) <= 15 and not _DATE.fullmatch(span)


_ATS = ["@", " @ ", " at ", " at ", " AT ", "(at)", "[at]", " (at) ", " [at] ", "{at}", " <at> ", "[@]", "(@)"]
_DOTS = [".", " dot ", " dot ", " DOT ", "[.]", "(.)", "[dot]", "(dot)", " [dot] ", " (dot) ", " . "]
_ENDS = ["com", "org", "net", "edu", "de", "fr", "es", "uk", "io", "info"]


def disguised(kind: str, rng: np.random.Generator, word, span: str = "") -> str:
    """A made-up span of a kind, or the given base span, in a spelled-out or broken form.  ``word()`` gives a word of letters."""
    pick = lambda items: items[int(rng.integers(len(items)))]
    number = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    if kind == "email":
        local, _, domain = (span or f"{word()}{pick(['.', '_', '-', ''])}{pick([word(), number(2), ''])}@{word()}{pick(['', number(1), '.' + word()])}.{pick(_ENDS)}").partition("@")
        at, dot = pick(_ATS), pick(_DOTS)
        if at.strip().lower() == "at" and dot.strip().lower() != "dot":
            dot = " dot "
        elif at == "@" and dot == ".":
            at = "[at]"
        return local.strip(".").replace(".", dot if rng.random() < 0.5 else ".") + at + domain.strip(".-").replace(".", dot)
    if kind == "ip":
        return pick(_DOTS[1:]).join(span.split(".") if span else [str(x) for x in rng.integers(0, 256, 4)])
    if kind == "card":
        digits = re.sub("[^0-9]", "", span)
        if not digits:
            digits = number(15)
            digits += next(d for d in "0123456789" if luhn(digits + d))
        gap = pick([".", "/", "_", "  ", " - ", " . ", "\u00a0", "--", " / "])
        return gap.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    a, b, c = number(3), number(3), number(4)
    gap = pick(["-", ".", " ", "/", " - "])
    lead = pick(["", "", "00" + number(1) + gap, "plus " + number(1) + " ", "+" + number(1) + "/", "+ " + number(2) + " ", number(1) + " "])
    return lead + pick([f"({a}) {b}-{c}", f"{a}{gap}{b}{gap}{c}", f"({a}){gap}{b}{gap}{c}", f"{a} / {b} {c[:2]} {c[2:]}"])


def lookalike(rng: np.random.Generator, word) -> str:
    """Something that resembles personal data and is none."""
    n = lambda low, high: str(int(rng.integers(low, high)))
    made = [
        lambda: f"{n(1900, 2100)}-{n(10, 13)}-{n(10, 29)}", lambda: f"{n(1, 29)}/{n(1, 13)}/{n(1900, 2100)}", lambda: f"{n(10, 24)}:{n(10, 60)}:{n(10, 60)}",
        lambda: f"v{n(0, 20)}.{n(0, 20)}.{n(0, 20)}", lambda: f"section {n(1, 9)}.{n(1, 9)}.{n(1, 9)}", lambda: f"${n(1, 999)},{n(100, 999)}.{n(10, 99)}", lambda: f"{n(0, 9)}.{n(10000, 99999)}",
        lambda: f"ISBN 978-{n(0, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}", lambda: f"pages {n(1, 500)}-{n(500, 999)}", lambda: f"{n(1900, 2000)}-{n(2000, 2100)}", lambda: f"order {n(10**9, 10**10)}",
        lambda: "".join("0123456789abcdef"[k] for k in rng.integers(0, 16, 40)), lambda: f"{word()} at {word()}", lambda: f"look at {word()}.com", lambda: f"the dot on the {word()} at noon",
        lambda: f"@{word()}", lambda: f"{word()}@{word()}", lambda: f"{word()}.{word()}", lambda: "-".join("".join("0123456789abcdef"[k] for k in rng.integers(0, 16, m)) for m in (8, 4, 4, 4, 12)),
        lambda: f"{n(10**15, 10**16)}", lambda: f"{n(256, 999)}.{n(256, 999)}.{n(256, 999)}.{n(256, 999)}", lambda: f"{n(1, 99)} dot {n(1, 99)}", lambda: f"{n(1, 9)} x {n(10, 99)} - {n(10, 99)}",
    ]
    return made[int(rng.integers(len(made)))]()


def tags_of(text: str, spans: dict[str, list[tuple[int, int]]]) -> np.ndarray:
    """Begin and inside tags of a text's spans; kinds listed first win where spans overlap."""
    out = np.zeros(len(text), np.int64)
    for k in range(len(KINDS) - 1, -1, -1):
        for s, e in spans[KINDS[k]]:
            out[s:e] = 2 * k + 2
            out[s] = 2 * k + 1
    return out


def examples(texts: list[str], rng: np.random.Generator, most: int = SAMPLE_WINDOWS) -> tuple[list, list]:
    """Labelled windows (symbols, tags): with spans, and without.

    Each text gives windows around its base spans, half of them with the span in disguise, and windows elsewhere into which a made-up
    disguised span, a look-alike or nothing is put.
    """
    words = sorted({w.lower() for t in texts[:300] for w in re.findall(r"[^\W\d_]{2,9}", t)}) or ["name"]
    plain = [w for w in words if w.isascii()] or ["name"]
    word = lambda: plain[int(rng.integers(len(plain)))]
    with_span, without = [], []

    def add(text: str, spans: dict[str, list[tuple[int, int]]], near: int) -> None:
        at = max(0, near - int(rng.integers(0, SHORT)))
        labels = tags_of(text, spans)[at : at + SHORT]
        x, y = np.full(SHORT, PAD), np.zeros(SHORT, np.int64)
        part = encode(text[at : at + SHORT])
        x[: len(part)], y[: len(part)] = part, labels
        (with_span if y.any() else without).append((x, y))

    for text in rng.permutation(np.array(texts, object)):
        if len(with_span) >= most and len(without) >= most:
            break
        base = base_spans(text)
        for kind in KINDS:
            for s, e in base[kind][:4]:
                low, high = max(0, s - SHORT), e + SHORT
                near = {k: [(a - low, b - low) for a, b in base[k] if low <= a and b <= high] for k in KINDS}
                add(text[low:high], near, s - low)
                left, right, made = text[low:s], text[e:high], disguised(kind, rng, word, text[s:e])
                add(left + made + right, {k: [(len(left), len(left) + len(made))] if k == kind else [] for k in KINDS}, len(left))
        for _ in range(3):
            s = int(rng.integers(0, max(1, len(text))))
            s = text.find(" ", s) + 1 or s
            left, right = text[max(0, s - SHORT) : s], text[s : s + SHORT]
            if any(v for v in base_spans(left + right).values()):
                continue
            draw, kind = rng.random(), KINDS[int(rng.integers(len(KINDS)))]
            made = disguised(kind, rng, word) if draw < 0.4 else lookalike(rng, word) if draw < 0.8 else ""
            gap = " " if made and rng.random() < 0.9 else ""
            whole = left + made + gap + right
            spans = base_spans(whole)  # a made-up span may have its plain form
            if draw < 0.4 and not any(spans.values()):
                spans[kind] = [(len(left), len(left) + len(made))]
            add(whole, spans, len(left))
    return with_span[:most], without[:most]


def train(texts: list[str], steps: int = 700, batch: int = 32, rate: float = 0.02, seed: int = 2) -> Tagger:
    """A tagger of labelled windows of the texts, half of each batch with spans.  Weights that are not finite are an error."""
    rng = np.random.default_rng(seed)
    pools = [p for p in examples(texts, rng) if p]
    model = Tagger.fresh(rng)
    if len(pools) < 2:
        model.w["out"][:] = 0
        model.w["bias"][0] = 50.0  # nothing to learn from: all is outside
        return model
    m, v = ({k: np.zeros_like(x) for k, x in model.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        picked = [p[i] for p in pools for i in rng.integers(0, len(p), batch // len(pools))]
        g, _ = model.gradients(np.stack([x for x, _ in picked]), np.stack([y for _, y in picked]))
        norm = np.sqrt(sum(float((x.astype(np.float64) ** 2).sum()) for x in g.values()))
        lr = rate * (1 - 0.95 * step / steps)
        for k, x in g.items():
            x = x * np.float32(min(1.0, 5.0 / max(norm, 1e-12)))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            model.w[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    if not all(np.isfinite(x).all() for x in model.w.values()):
        raise FloatingPointError("training of the tagger diverged")
    return model


def sample(docs: DataFrame, text_col: str = "text") -> list[str]:
    """Parts of distinct texts, drawn by a hash, so reruns agree: half of texts with a digit or an at sign, half of any texts.

    Of a long text the part around its first digit or sign is taken, or else one at a place that the hash gives.
    """
    rows = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    sign = F.regexp_instr("text", F.lit("[0-9@]"))
    found = []
    for kind, part in (("signs", rows.where(sign > 0)), ("any", rows)):
        key = F.xxhash64(F.lit(kind), "text")
        room = F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)
        at = F.greatest(F.lit(1), F.least(sign - SAMPLE_CHARS // 2, room)) if kind == "signs" else F.pmod(F.shiftright(key, 30), room).cast("int") + 1
        total = part.agg(F.approx_count_distinct(key, 0.02)).first()[0]
        drawn = hash_sample(part, SAMPLE_DOCS // 2, kind, "text", total).select(key.alias("key"), F.substr("text", at, F.lit(SAMPLE_CHARS)).alias("text")).distinct()
        found += [r["text"] for r in drawn.collect()]
    return sorted(found)


def find(texts: list[str | None], model: Tagger, block: int = BLOCK) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text (base, all) spans (kind, start, end), by kind as listed, then start.

    The network adds a plausible span of a kind where no span of any kind overlaps it.  Texts are
    read together until ``block`` characters are in hand.
    """
    out = [([], [])] * len(texts)
    flat = lambda spans: [(k, s, e) for k in KINDS for s, e in sorted(spans[k])]
    held: list[int] = []
    size = 0

    def flush() -> None:
        for i, added in zip(held, model.spans([texts[i] for i in held]), strict=True):
            base = base_spans(texts[i])
            every = {k: list(base[k]) for k in KINDS}
            covered = sorted(x for k in KINDS for x in base[k])
            begins, reach = [s for s, _ in covered], list(accumulate((e for _, e in covered), max))
            for k in KINDS:
                for s, e in added[k]:
                    n = bisect_left(begins, e)
                    if (not n or reach[n - 1] <= s) and plausible(k, texts[i][s:e]):
                        every[k].append((s, e))
            out[i] = flat(base), flat(every)
        held.clear()

    for i, text in enumerate(texts):
        if isinstance(text, str) and text:
            held.append(i)
            size += len(text)
            if size >= block:
                flush()
                size = 0
    flush()
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of base spans by kind, base_sha256, and all spans.

    Spans are in code points, end exclusive, over whole texts; null text is empty.  Repeated rows
    give repeated rows, an empty table an empty result; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            rows = []
            for base, every in find(b["text"].tolist(), m):
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    schema = "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return whole_ids(as_text(docs, id_col, text_col).mapInPandas(each, schema))


def op2(spark, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    docs = table(spark, sf_dir, "documents")
    return detect(docs, train(sample(docs)))
