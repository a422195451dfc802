"""Whole texts to ids of a public tokenizer, exactly as the tokenizers library gives them.

The library is called once per distinct piece: texts of ordinary characters are split into the pieces
that its byte-level pattern makes, with array operations on the Arrow buffer, and each piece's ids are
kept in a bounded table of the worker. A text with anything else (runs of white space, control
characters, characters beyond Latin Extended-A, `<|`) goes through the library whole."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from sedimenta.llm import textkit

MOST_PIECES = 400_000
"""Pieces that a worker keeps at once; beyond it those go that weren't met again."""


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_SPACE, _LINE, _L, _N, _O = range(5)
_ONE = np.full(256, _O, np.uint8)
_ONE[32], _ONE[10] = _SPACE, _LINE
_ONE[48:58] = _N
_ONE[65:91] = _ONE[97:123] = _L
_PLAIN = np.zeros(256, bool)
_PLAIN[[10, *range(32, 127), *range(0x80, 0xC0), 0xC2, 0xC3, 0xC4, 0xC5]] = True
#: U+0080 to U+017F by their two bytes
_TWO = np.full(256, _L, np.uint8)
_TWO[:64] = _O
_TWO[[0x2A, 0x35, 0x3A]] = _L
_TWO[[0x32, 0x33, 0x39, 0x3C, 0x3D, 0x3E]] = _N
_TWO[[64 + 0x17, 64 + 0x37]] = _O


def classes(data: np.ndarray) -> np.ndarray:
    cls = _ONE[data]
    lead = np.flatnonzero(data >= 0xC0)
    lead = lead[lead + 1 < len(data)]
    c = _TWO[(np.minimum(data[lead] - np.uint8(0xC2), 3).astype(np.int64) << 6) | (data[lead + 1] & 63)]
    cls[lead], cls[lead + 1] = c, c
    return cls


def _after(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """mask of the byte before, False at each text's first byte."""
    out = np.zeros(len(mask), bool)
    out[1:] = mask[:-1]
    out[offs[:-1][offs[:-1] < len(mask)]] = False
    return out


def odd_texts(data: np.ndarray, offs: np.ndarray, runs: bool, banned: tuple[bytes, ...]) -> np.ndarray:
    """Texts that the splitting here does not cover. runs: white space in a row counts."""
    bad = ~_PLAIN[data]
    if runs:
        ws = (data == 32) | (data == 10)
        bad |= ws & _after(ws, offs)
    for pair in banned:
        bad |= (data == pair[1]) & _after(data == pair[0], offs)
    out = np.zeros(len(offs) - 1, bool)
    out[np.searchsorted(offs, np.flatnonzero(bad), "right") - 1] = True
    return out


def byte_level_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s`."""
    n = len(data)
    cls = classes(data)
    start = np.ones(n, bool)
    start[1:] = cls[1:] != cls[:-1]
    start |= cls == _LINE
    start &= ~_after(cls == _SPACE, offs)
    head = offs[:-1][offs[:-1] < n]
    start[head] = True
    at = np.flatnonzero((data == 39) & start)
    if len(at):
        end = offs[np.searchsorted(offs, at, "right")]
        pad = np.concatenate([data, np.zeros(3, np.uint8)])
        a, b = pad[at + 1], pad[at + 2]
        one = (at + 1 < end) & np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = (at + 2 < end) & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
        for ok, k in ((one, 2), (two, 3)):
            start[at[ok] + 1] = False
            nxt = at[ok] + k
            start[nxt[nxt < end[ok]]] = True
    return start


class Encoder:
    """ids of texts by a byte-level BPE file without a normalizer."""

    def __init__(self, path: str):
        self.lib = _tokenizer(path)
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met = np.zeros(0, bool)
        self.flat = np.zeros(0, np.uint32)

    def _forget(self):
        """Only pieces stay that were met since the last time, in another slice than their first; none if they fill over half of the table."""
        keep = np.flatnonzero(self.met)
        if len(keep) > MOST_PIECES // 2:
            keep = keep[:0]
        self.flat = self.flat[textkit.ragged(self.at[keep], self.n[keep])]
        self.keys, self.n, self.met = self.keys[keep], self.n[keep], np.zeros(len(keep), bool)
        self.at = np.cumsum(self.n) - self.n

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids, counts = [], []
        for i in range(0, len(pieces), 20_000):
            e = self.lib.encode(pieces[i : i + 20_000], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            counts.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(pieces[i : i + 20_000])))
        n = np.concatenate(counts)
        at = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate([self.flat, *ids])
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n, self.met = (np.insert(x, where, y) for x, y in ((self.keys, keys), (self.at, at), (self.n, n), (self.met, False)))

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the table, whether they aren't there) of keys."""
        pos = np.searchsorted(self.keys, keys)
        miss = np.ones(len(keys), bool)
        inside = pos < len(self.keys)
        miss[inside] = self.keys[pos[inside]] != keys[inside]
        return pos, miss

    def __call__(self, col: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text); `end` is put after each text."""
        data, offs = textkit.utf8(col)
        docs = len(offs) - 1
        odd = odd_texts(data, offs, True, (b"<|", b"\xc2\x85", b"\xc2\xa0"))
        counts = np.zeros(docs, np.int64)
        fast = np.zeros(0, np.uint32)
        if len(data) and not odd.all():
            starts = np.flatnonzero(byte_level_starts(data, offs))
            ends = np.append(starts[1:], len(data))
            doc = np.searchsorted(offs, starts, "right") - 1
            if odd.any():
                keep = ~odd[doc]
                starts, ends, doc = starts[keep], ends[keep], doc[keep]
            h = textkit.span_hashes(data, starts, ends)
            order = np.argsort(h)
            s = h[order]
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            uniq, rep = s[new], order[new]
            which = np.empty(len(h), np.int64)
            which[order] = np.cumsum(new) - 1
            pos, miss = self._find(uniq)
            self.met[pos[~miss]] = True
            if len(self.keys) + np.count_nonzero(miss) > MOST_PIECES:
                self._forget()
                pos, miss = self._find(uniq)
            if miss.any():
                raw = data.tobytes()
                self._learn(uniq[miss], [raw[a:b].decode() for a, b in zip(starts[rep[miss]].tolist(), ends[rep[miss]].tolist())])
                pos = np.searchsorted(self.keys, uniq)
            at, n = self.at[pos][which], self.n[pos][which]
            fast = self.flat[textkit.ragged(at, n)]
            counts += np.bincount(doc, weights=n, minlength=docs).astype(np.int64)
        slow = np.flatnonzero(odd)
        some = [x.ids for x in self.lib.encode_batch([col[int(i)].as_py() for i in slow], add_special_tokens=False)] if len(slow) else []
        counts[slow] = [len(x) for x in some]
        extra = int(end is not None)
        to = np.concatenate([[0], np.cumsum(counts + extra)])
        out = np.empty(to[-1], np.uint32)
        plain = np.flatnonzero(~odd)
        out[textkit.ragged(to[plain], counts[plain])] = fast
        for i, x in zip(slow, some, strict=True):
            out[to[i] : to[i] + len(x)] = x
        if extra:
            out[to[1:] - 1] = end
        return out, to


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
