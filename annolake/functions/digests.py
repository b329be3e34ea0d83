"""Many short MD5 digests at once, in numpy: what derived collections are drawn by (see ``annolake.sources.fixtures``)."""

from __future__ import annotations

import hashlib
import math

import numpy as np

try:
    from _md5 import md5  # a short text costs less here than in OpenSSL
except ImportError:
    from hashlib import md5

TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = np.array([int(abs(math.sin(k + 1)) * 2**32) for k in range(64)], np.uint32)
START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
#: Messages digested at once, so that all of it stays in a core's cache.
BLOCK = 16_384


def head(text: str) -> int:
    """The first six hex digits of a text's MD5, as a number."""
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:3], "big")


def marked_digests(text: str, places: list[tuple[int, int]], before: str = "", after: str = "") -> list[bytes]:
    """MD5 of before + `mark_entity` of a text + after, for each of its places (start, end inclusive).

    What stands before a mark is digested once for all places, and no marked text is made; what follows it is digested once a place.
    """
    data = text.encode()
    at = None if len(data) == len(text) else np.concatenate([[0], np.cumsum(utf8_sizes(text))]).tolist()
    byte = (lambda k: min(max(k, 0), len(data))) if at is None else (lambda k: at[min(max(k, 0), len(text))])
    view, state, done, tail = memoryview(data), hashlib.md5(before.encode()), 0, after.encode()
    out = [b""] * len(places)
    for k in sorted(range(len(places)), key=lambda k: places[k][0]):
        a, b = byte(places[k][0]), byte(places[k][1] + 1)
        state.update(view[done:a])
        done, own = a, state.copy()
        own.update(b"[E1]" + data[a:b] + b"[/E1]")
        own.update(view[b:])
        own.update(tail)
        out[k] = own.digest()
    return out


def marked_pair_digests(data: bytes, first: list[tuple[int, int]], second: list[tuple[int, int]], marks: tuple[bytes, bytes] = (b"E1", b"E2")) -> list[str]:
    """MD5, in hex, of a text with two places marked, for each pair of places in bytes (ends exclusive; the first one before the second; in order of both).

    What stands before the first mark is digested once for all pairs, what stands between once for all pairs of one first place; the rest once a pair.
    """
    (a, b), view, before, done, last, out = marks, memoryview(data), hashlib.md5(), 0, None, []
    for one, (s, e) in zip(first, second):
        if one != last:
            before.update(view[done : one[0]])
            done, last = one[0], one
            state, at = before.copy(), one[1]
            state.update(b"[%b]%b[/%b]" % (a, data[one[0] : one[1]], a))
        state.update(view[at:s])
        own, at = state.copy(), s
        own.update(b"[%b]%b[/%b]" % (b, data[s:e], b))
        own.update(view[e:])
        out.append(own.hexdigest())
    return out


class Contexts:
    """What `mark_pair_context` shows of pairs of places (start, end inclusive; by their starts) in a text, as `head` numbers.

    What a place shows before, in and behind it is made once a place; a pair far apart costs a copy of the first one's state and what the second one shows.
    """

    def __init__(self, text: str, places: list[tuple[int, int]], window: int):
        self.text, self.places, self.window = text, places, window
        self.starts = np.array([s for s, _ in places], np.int64)
        self.seconds: dict[str, list[bytes]] = {}

    def shown(self, mark: str) -> list[bytes]:
        """Of each place as the second one, far behind the first."""
        if mark not in self.seconds:
            text, w = self.text, self.window
            self.seconds[mark] = [f"{text[max(s - w, 0) : s]}[{mark}]{text[s : e + 1]}[/{mark}]{text[e + 1 : e + 1 + w]}".encode() for s, e in self.places]
        return self.seconds[mark]

    def heads(self, first: np.ndarray, second: np.ndarray, is_subject: bool) -> np.ndarray:
        """first, second: numbers of places, in order of both; is_subject: whether the first ones are."""
        one, two = ("E1", "E2") if is_subject else ("E2", "E1")
        text, places, w, shown = self.text, self.places, self.window, self.shown(two)
        out: list[bytes] = []
        tell = out.append
        at = np.concatenate([[0], np.flatnonzero(np.diff(first)) + 1, [len(first)]]).tolist() if len(first) else [0]
        for x, y in zip(at, at[1:]):
            s, e = places[first[x]]
            begin = md5(f"{text[max(s - w, 0) : s]}[{one}]{text[s : e + 1]}[/{one}]".encode())
            far = x + int(np.searchsorted(self.starts[second[x:y]], e + 1 + 2 * w, "right"))
            for b in second[x:far].tolist():
                state, (t, u) = begin.copy(), places[b]
                state.update(f"{text[e + 1 : t]}[{two}]{text[t : u + 1]}[/{two}]{text[u + 1 : u + 1 + w]}".encode())
                tell(state.digest())
            begin.update(f"{text[e + 1 : e + 1 + w]} … ".encode())
            copy = begin.copy
            for said in map(shown.__getitem__, second[far:y].tolist()):
                state = copy()
                state.update(said)
                tell(state.digest())
        words = np.frombuffer(b"".join(out), np.uint8).reshape(-1, 16).astype(np.int64)
        return words[:, 0] << 16 | words[:, 1] << 8 | words[:, 2]


def utf8_sizes(text: str) -> np.ndarray:
    """How many bytes each character takes."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


def heads(words: np.ndarray) -> np.ndarray:
    """The same of padded blocks of one message each: (16, n) words, a column a message.

    Three of the 64 steps don't change the digest's first word.
    """
    n, used = words.shape[1], words.any(1)
    a, b, c, d = (np.full(n, x, np.uint32) for x in START)
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(61):
        kind = k // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=t), np.bitwise_and(t, b, out=t), np.bitwise_xor(t, d, out=t)
        elif kind == 1:
            np.bitwise_xor(b, c, out=t), np.bitwise_and(t, d, out=t), np.bitwise_xor(t, c, out=t)
        elif kind == 2:
            np.bitwise_xor(b, c, out=t), np.bitwise_xor(t, d, out=t)
        else:
            np.invert(d, out=t), np.bitwise_or(t, b, out=t), np.bitwise_xor(t, c, out=t)
        at, turn = ((1, 5, 3, 7)[kind] * k + (0, 1, 5, 0)[kind]) % 16, TURNS[kind][k % 4]
        np.add(t, a, out=t), np.add(t, SINES[k], out=t)
        if used[at]:
            np.add(t, words[at], out=t)
        np.left_shift(t, np.uint32(turn), out=u), np.right_shift(t, np.uint32(32 - turn), out=t)
        np.bitwise_or(t, u, out=t), np.add(t, b, out=t)
        a, b, c, d, t = d, t, b, c, a
    b += START[0]
    return ((b & 0xFF) << 16 | b & 0xFF00 | b >> 16 & 0xFF).astype(np.int32)


def text_heads(texts: list[str], first: tuple[str, ...] = ("",)) -> np.ndarray:
    """`head` of each text; first: characters (ASCII) that a row of results each has as the first one instead."""
    data = [x.encode() for x in texts]
    out = np.empty((len(first), len(data)), np.int32)
    for a in range(0, len(data), BLOCK):
        own = data[a : a + BLOCK]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        rows = np.frombuffer(b"".join([x[:55].ljust(64, b"\0") for x in own]), np.uint8).reshape(-1, 64).copy()
        rows[np.arange(len(own)), np.minimum(sizes, 55)] = 0x80
        words = np.ascontiguousarray(rows.view("<u4").T)
        words[14] = sizes * 8
        for k, char in enumerate(first):
            if char:
                words[0] = words[0] & np.uint32(0xFFFFFF00) | np.uint32(ord(char))
            out[k, a : a + BLOCK] = heads(words)
        for j in np.flatnonzero(sizes > 55).tolist():  # more than a block each
            out[:, a + j] = [head(f"{char}{texts[a + j][1:]}" if char else texts[a + j]) for char in first]
    return out


def prefixes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of 64 bytes, and their sizes."""
    data = [x.encode() for x in texts]
    if max(map(len, data), default=0) > 55:
        raise ValueError("a digest's text has more than 55 bytes")
    rows = np.frombuffer(b"".join(x.ljust(64, b"\0") for x in data), np.uint8).reshape(-1, 64)
    return rows, np.fromiter(map(len, data), np.int64, len(data))


def numbered_heads(rows: np.ndarray, sizes: np.ndarray, which: np.ndarray, numbers: np.ndarray, first: tuple[tuple[int, str], ...] = ()) -> np.ndarray:
    """`head` of text + number: of each of `numbers` (0 or more) behind the text at `which` of the `prefixes`.

    first: (place among the first four bytes, character) pairs: a row of results for each, with that character there instead.
    """
    out = np.empty((max(len(first), 1), len(numbers)), np.int32)
    for a in range(0, len(numbers), BLOCK):
        own, left = which[a : a + BLOCK], numbers[a : a + BLOCK].astype(np.int64)
        block = rows[own]
        digits = np.ones(len(own), np.int64)
        for k in range(1, 19):
            more = left >= 10**k
            if not more.any():
                break
            digits += more
        size = sizes[own] + digits
        if len(size) and size.max() > 55:
            raise ValueError("a digest's text has more than 55 bytes")
        flat, begin = block.ravel(), np.arange(len(own)) * 64
        flat[begin + size] = 0x80
        at = begin + size - 1
        while len(left):
            flat[at] = left % 10 + 48
            left = left // 10
            if not left.all():
                some = left > 0
                at, left = at[some], left[some]
            at = at - 1
        words = np.ascontiguousarray(block.view("<u4").T)
        words[14] = size * 8
        for k, (place, char) in enumerate(first or ((-1, ""),)):
            if place >= 0:
                words[0] = words[0] & np.uint32(~(0xFF << 8 * place) & 0xFFFFFFFF) | np.uint32(ord(char) << 8 * place)
            out[k, a : a + BLOCK] = heads(words)
    return out if first else out[0]
