"""Token ids of whole texts with the tokenizers library, each distinct piece encoded once for a worker.

A text is cut into pieces before each run of ASCII white space and between a Latin
letter and an ASCII punctuation mark after it. The patterns of the byte-level
vocabularies never look back and never join characters across such places, so the
ids of the pieces, one after the other, are those of the text. A vocabulary that
drops white space gets pieces without it, and with A-Z as a-z where it lowers.
Texts with other white space (where it counts) or with the strings of added tokens
are encoded by the library as they are.

Pieces are known by two 64-bit hashes. Their ids are held in sorted arrays of at
most ``PIECES`` entries; when these are full, pieces not used since the last time go.
New pieces of one Latin word each are encoded many at a time, as one text; its ids
are cut where a token ends a word or begins one.

Defined cases: null and empty texts have no ids (the end id alone, if one is
given); equal texts have equal ids; very long texts are pieces like all others.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import common as C

#: Distinct pieces kept by a worker: about 40 bytes each.
PIECES = 1_000_000
#: New pieces encoded by one call of the library.
AT_ONCE = 4096
_BASES = (0x2545F4914F6CDD1D, 0x369DEA0F31A53F85)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_LATIN = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False


def _first_bytes(buf: np.ndarray, *pattern: tuple[int, ...]) -> np.ndarray:
    """Places where bytes out of the given sets follow each other."""
    at = np.flatnonzero(np.isin(buf, pattern[0]))
    for j, some in enumerate(pattern[1:], 1):
        at = at[at + j < len(buf)]
        at = at[np.isin(buf[at + j], some)]
    return at


def _odd_space(buf: np.ndarray) -> np.ndarray:
    """Places of white space and separators outside the six of ASCII."""
    high = np.flatnonzero((buf >= 0x1C) & (buf <= 0x1F))
    if not (buf >= 0xC2).any():
        return high
    return np.concatenate(
        [
            high, _first_bytes(buf, (0xC2,), (0x85, 0xA0)), _first_bytes(buf, (0xE1,), (0x9A,), (0x80,)), _first_bytes(buf, (0xE2,), (0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)),
            _first_bytes(buf, (0xE2,), (0x81,), (0x9F,)), _first_bytes(buf, (0xE3,), (0x80,), (0x80,)),
        ]
    )


class Known:
    """Ids of pieces by hash, in sorted arrays."""

    def __init__(self):
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.n, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        self.ids = np.zeros(0, np.uint32)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The entry of each piece, -1 if there is none; ``key`` is ascending."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = (self.key[at] == key) & (self.check[at] == check)
        self.used[at[hit]] = True
        return np.where(hit, at, -1)

    def add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Takes in new pieces, ids one after the other; those with the key of an old one replace it."""
        if len(self.key) + len(key) > PIECES:
            self._keep(self.used)
            if len(self.key) + len(key) > PIECES:
                self._keep(np.zeros(len(self.key), bool))
            self.used[:] = False
        self._keep(~np.isin(self.key, key, assume_unique=True))
        at = np.searchsorted(self.key, key)
        put = lambda old, new: np.insert(old, at, new)
        start = len(self.ids) + np.cumsum(n) - n
        self.key, self.check, self.start, self.n, self.used = put(self.key, key), put(self.check, check), put(self.start, start), put(self.n, n), put(self.used, np.ones(len(key), bool))
        self.ids = np.concatenate([self.ids, ids])

    def _keep(self, keep: np.ndarray) -> None:
        if keep.all():
            return
        self.ids = self.ids[_spread(self.start[keep], self.n[keep])]
        self.key, self.check, self.n, self.used = self.key[keep], self.check[keep], self.n[keep], self.used[keep]
        self.start = np.cumsum(self.n, dtype=np.int64) - self.n


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of all spans, one after the other."""
    n = n.astype(np.int64)
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        normal, split = t.normalizer, t.pre_tokenizer.pre_tokenize_str
        self.lowers = normal is not None and normal.normalize_str("AÄ") == "aä"
        self.spaced = len(t.encode(" ,", add_special_tokens=False).ids) != len(t.encode("  ,", add_special_tokens=False).ids)  # white space gives tokens
        self.added = [a.content.encode() for a in t.get_added_tokens_decoder().values()]
        vocabulary = t.get_vocab(with_added_tokens=False)
        self.edge = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        suffix = getattr(t.model, "end_of_word_suffix", None)
        if not self.spaced and suffix:  # a word's last token
            self.ends = True
            self.edge[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        else:  # a word's first token has the space or line feed before it
            self.ends = False
            marks = tuple(split(c + "a")[0][0][0] for c in " \n")
            self.edge[[i for w, i in vocabulary.items() if w.startswith(marks)]] = True
        self.known = Known()

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _new(self, pieces: list[bytes], simple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and the number of each; ``simple``: one Latin word (after a space or line feed, if white space counts)."""
        ids, n = [np.zeros(0, np.uint32)] * len(pieces), np.zeros(len(pieces), np.int32)
        order = np.flatnonzero(simple).tolist()
        hard = np.flatnonzero(~simple).tolist()
        for a in range(0, len(order), AT_ONCE):
            some = order[a : a + AT_ONCE]
            got = self.plain((b"" if self.spaced else b" ").join([pieces[i] for i in some]).decode("utf-8", "replace"))
            at = np.flatnonzero(self.edge[got])
            at = np.append(0, at + 1) if self.ends else np.append(at, len(got))
            if len(at) != len(some) + 1 or at[0] != 0 or at[-1] != len(got):
                hard += some  # not as expected: one by one
                continue
            for k, i in enumerate(some):
                ids[i] = got[at[k] : at[k + 1]]
        for a in range(0, len(hard), AT_ONCE):
            some = hard[a : a + AT_ONCE]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([pieces[i].decode("utf-8", "replace") for i in some], add_special_tokens=False)):
                ids[i] = np.array(e.ids, np.uint32)
        n[:] = [len(x) for x in ids]
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), n

    def _hashes(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        values, out = (C.LOWER_VALUES if self.lowers else C.BYTE_VALUES)[buf], []
        for base, inverse in zip(_BASES, _INVERSES):
            sums = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(values * C.powers(base, len(buf)), out=sums[1:])
            out.append(C.mix64((sums[end] - sums[start]) * C.powers(inverse, len(buf) + 1)[start] + (end - start).astype(np.uint64)))
        return out

    def _cut(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pieces, and which of them are one Latin word; texts are followed by a line feed each."""
        solid = _SOLID[buf]
        begin = np.zeros(len(buf) + 1, bool)  # of runs of other than white space
        begin[0], begin[1:-1] = solid[0], solid[1:] & ~solid[:-1]
        latin = _LETTER[buf]
        two = np.flatnonzero(buf[1:] & 0xC0 == 0x80)  # letters of two bytes
        two = two[(buf[two] == 0xC3) & (buf[two + 1] != 0x97) & (buf[two + 1] != 0xB7)]
        latin[two] = latin[two + 1] = True
        begin[1:-1] |= latin[:-1] & _PUNCT[buf[1:]]
        start = np.flatnonzero(begin)
        stop = np.flatnonzero(solid & ~np.append(solid[1:], False)) + 1  # ends of runs
        end = np.append(start[1:], len(buf))
        end = np.minimum(end, stop[np.searchsorted(stop, start, side="right")] if len(start) else end)
        other = np.concatenate([[0], np.cumsum(~latin)])
        simple = other[end] == other[start]
        if self.spaced:  # with the white space before it
            gap = np.zeros(len(start), np.int64)
            last = np.append(0, end[:-1])
            text = np.searchsorted(off, start, side="right") - 1
            gap = start - np.maximum(last, off[text])
            simple &= gap == 1
            start = start - gap
            one = buf[np.minimum(start, len(buf) - 1)]
            simple &= (one == 0x20) | (one == 0x0A)
            # White space at the end of a text is a piece of its own.
            close = off[1:] - 1
            tail = np.searchsorted(end, close, side="right") - 1
            before = np.maximum(np.where(tail >= 0, end[np.maximum(tail, 0)] if len(end) else 0, 0), off[:-1])
            lone = np.flatnonzero(before < close)
            if len(lone):
                start, end, simple = np.append(start, before[lone]), np.append(end, close[lone]), np.append(simple, np.zeros(len(lone), bool))
                order = np.argsort(start, kind="stable")
                start, end, simple = start[order], end[order], simple[order]
        return start, end, simple

    def flat(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with their end ids, one text after the other, offsets of the texts)."""
        buf, off = C.joined(texts, b"\n")
        tail = np.zeros(0, np.uint32) if end is None else np.array([end], np.uint32)
        count = len(off) - 1
        if not count:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        odd = np.concatenate([_odd_space(buf) if self.spaced else np.zeros(0, np.int64), *(_first_bytes(buf, *((c,) for c in a)) for a in self.added)])
        own = np.zeros(count, bool)
        own[np.searchsorted(off, odd, side="right") - 1] = True
        start, stop, simple = self._cut(buf, off)
        text = np.searchsorted(off, start, side="right") - 1
        if own.any():
            keep = ~own[text]
            start, stop, simple, text = start[keep], stop[keep], simple[keep], text[keep]
        key, check = self._hashes(buf, start, stop)
        uniq, first, back = np.unique(key, return_index=True, return_inverse=True)
        at, known = self.known.find(uniq, check[first]), self.known
        while (at < 0).any():
            miss = np.flatnonzero(at < 0)
            raw, m = buf.tobytes(), first[miss]
            ids, n = self._new([raw[a:z] for a, z in zip(start[m].tolist(), stop[m].tolist())], simple[m])
            known.add(uniq[miss], check[m], ids, n)
            at = known.find(uniq, check[first])
            if (at < 0).any():  # the pieces of this block and those at hand are too many: the block's alone
                self.known, known, at = Known(), Known(), np.full(len(uniq), -1)
        at = at[back]
        n = known.n[at].astype(np.int64)
        ids = known.ids[_spread(known.start[at], n)]
        per = np.bincount(text, n, count).astype(np.int64)
        if not own.any():
            edge = np.cumsum(per)
            if end is not None:
                ids = np.insert(ids, edge, np.uint32(end))
                per = per + 1
            return ids, np.concatenate([[0], np.cumsum(per)])
        edge, out = np.concatenate([[0], np.cumsum(per)]), []
        for k in range(count):
            out.append(np.concatenate([self.plain(texts[k].as_py()) if own[k] else ids[edge[k] : edge[k + 1]], tail]))
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def batch(self, texts: list[str | None], end: int | None = None) -> list[bytes]:
        """The ids of each text (null: empty) and the end id, as little-endian unsigned 32-bit integers."""
        ids, off = self.flat(pa.array(texts, pa.string()), end)
        return [ids[a:z].astype("<u4").tobytes() for a, z in zip(off, off[1:])]


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
