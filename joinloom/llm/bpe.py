"""Byte-level BPE over whole batches of texts in numpy.

Pre-tokens are found by array operations on code points, made unique by hash, and
merged rank by rank: in each step every sequence of a ragged array applies its own
lowest-ranked pair, at all its places at once.  A sequence without a known pair is
done.  Since a merge only makes pairs of higher rank, this gives the sequences that
merging one pair at a time gives.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np

from joinloom.llm import arrays
from joinloom.llm.arrays import U

#: Bytes of text encoded at a time, unless one text alone is longer.
CHUNK = 1 << 20
_NONE = np.int32(2**31 - 1)
_OTHER, _LETTER, _NUMBER, _SPACE, _BLANK = range(5)

# The code points with Unicode's White_Space property, and the
# contractions that byte-level BPE of this family splits off.
WHITE_SPACE = (
    9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
    0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], np.uint8)
    table[list(WHITE_SPACE)] = _SPACE
    table[32] = _BLANK
    return table


def pretoken_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which code points begin a pre-token; first: those that begin a text."""
    c = _classes()[cp]
    white = c >= _SPACE
    before = np.concatenate([[_OTHER], c[:-1]]).astype(np.uint8)
    before_white, after_white = before >= _SPACE, np.concatenate([white[1:], [True]])
    last = np.concatenate([first[1:], [True]])
    # White space: the run begins, or its last code point stands before a word.
    begins = np.where(white, ~before_white | (~after_white & ~last), (before == _SPACE) | (~before_white & (before != c)))
    begins |= first
    mark = np.flatnonzero((cp == 39) & begins)
    if len(mark):
        padded = np.concatenate([cp, np.zeros(3, cp.dtype)])
        stop = np.concatenate([first, np.ones(3, bool)])
        for s in CONTRACTIONS:
            ok = np.ones(len(mark), bool)
            for k, ch in enumerate(s, 1):
                ok &= (padded[mark + k] == ord(ch)) & ~stop[mark + k]
            hit = mark[ok]
            for k in range(1, len(s) + 1):
                begins[hit + k] = False
            end = hit + len(s) + 1
            begins[end[end < len(cp)]] = True
    return begins


class _Known:
    """Pre-tokens met before, by hash: an open-addressed table of a fixed size.
    When half of the slots or the room for symbols is used, no more are added."""

    def __init__(self, bits: int = 21):
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, U)
        self.at, self.size = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
        self.ids, self.used, self.count = np.empty(6 << (bits - 1), np.int32), 0, 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 if unknown."""
        slot = (h >> self.shift).view(np.int64)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != h) & (found != 0))
        slot[found == 0] = -1
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            slot[open_[found == 0]] = -1
            open_ = open_[(found != h[open_]) & (found != 0)]
        return slot

    def add(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        if self.count + len(h) > len(self.keys) // 2 or self.used + len(ids) > len(self.ids):
            return
        self.ids[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(size) - size
        slot, todo = (h >> self.shift).view(np.int64), np.arange(len(h))
        while len(todo):
            s = slot[todo]
            free = self.keys[s] == 0
            self.keys[s[free]] = h[todo[free]]
            own = self.keys[s] == h[todo]
            self.at[s[own]], self.size[s[own]] = at[todo[own]], size[todo[own]]
            todo = todo[~own]
            slot[todo] = (slot[todo] + 1) & self.mask
        self.used += len(ids)
        self.count += len(h)


class Bpe:
    """A byte-level BPE vocabulary in the ``tokenizers`` library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        model, vocab = raw["model"], raw["model"]["vocab"]
        pre = raw["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or raw["normalizer"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        self.special = {t["content"]: t["id"] for t in raw["added_tokens"]}
        self.byte_ids = np.array([vocab[ch] for ch in _byte_letters()], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._fill(left, right)
        self.known = _Known()

    def _fill(self, left: np.ndarray, right: np.ndarray) -> None:
        """An open-addressed table from pair to rank, four slots a pair at least."""
        bits = max(4, int(4 * len(left)).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        key = left << 32 | right
        for rank, (k, slot) in enumerate(zip(key.tolist(), self._slots(key).tolist(), strict=True)):
            while self.keys[slot] not in (-1, k):
                slot = (slot + 1) & self.mask
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = k, rank

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(U) * U(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        slot = self._slots(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def merge(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of sequences that lie end to end -> the same after all merges."""
        index, done = np.arange(len(size)), []
        final = np.zeros(len(size), np.int64)
        start = np.cumsum(size) - size
        rank = np.full(len(sym), _NONE, np.int32)
        inner = np.ones(len(sym), bool)
        inner[start + size - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self.rank(sym[at], sym[at + 1])
        while len(index):
            low = np.minimum.reduceat(rank, start)
            live = low != _NONE
            if not live.all():
                keep = np.repeat(live, size)
                done.append((index[~live], size[~live], sym[~keep]))
                final[index[~live]] = size[~live]
                index, size, sym, rank, low = index[live], size[live], sym[keep], rank[keep], low[live]
                if not len(index):
                    break
                start = np.cumsum(size) - size
            seq = np.repeat(np.arange(len(size)), size)
            hit = rank == low[seq]
            at = np.flatnonzero(hit)
            if len(at) > 1:  # of overlapping places, as in aaa, each second one
                head = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(seq[at]) > 0)])
                if not head.all():
                    run = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                    at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            size = size - np.bincount(seq[at], minlength=len(size))
            rank[at] = _NONE  # of (at, at + 1); anew below
            sym, rank, seq = sym[keep], rank[keep], seq[keep]
            at = moved[at]
            start = np.cumsum(size) - size
            near = np.concatenate([at, at[at > 0] - 1])
            near = near[near + 1 < len(sym)]
            same = seq[near] == seq[near + 1]
            rank[near[~same]] = _NONE
            near = near[same]
            rank[near] = self.rank(sym[near], sym[near + 1])
        out = np.empty(int(final.sum()), np.int32)
        place = np.cumsum(final) - final
        for i, n, s in done:
            out[spread(place[i], n)] = s
        return out, final

    def _pretokens(self, texts: list[str]):
        """An array of ids; where each pre-token's ids begin there and how many they are;
        how many pre-tokens stand before each text (and in all)."""
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(length)
        if not len(cp):
            none = np.empty(0, np.int64)
            return none.astype(np.int32), none, none, np.zeros(len(texts) + 1, np.int64)
        first = np.zeros(len(cp) + 1, bool)
        first[ends - length] = True
        begin = np.flatnonzero(pretoken_starts(cp, first[:-1]))
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        byte = np.concatenate([[0], np.cumsum(width)])
        buf = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
        start, end = byte[begin], byte[np.concatenate([begin[1:], [len(cp)]])]
        h = arrays.span_hashes(buf, start, end)
        slot = self.known.find(h)
        old, new = np.flatnonzero(slot >= 0), np.flatnonzero(slot < 0)
        hashes, one, which = np.unique(h[new], return_index=True, return_inverse=True)
        start, size = start[new[one]], (end - start)[new[one]]
        ids, sizes = self.merge(self.byte_ids[buf[spread(start, size)]], size)
        every, where = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        every[old], where[old] = self.known.size[slot[old]], self.known.at[slot[old]]
        every[new], where[new] = sizes[which], (self.known.used + np.cumsum(sizes) - sizes)[which]
        store = self.known.ids
        if self.known.used + len(ids) > len(store):
            store = np.concatenate([store[: self.known.used], ids])
        else:
            store[self.known.used : self.known.used + len(ids)] = ids
        self.known.add(hashes, ids, sizes)
        return store, where, every, np.searchsorted(begin, np.concatenate([[0], ends]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's begin (and the end).  Special
        strings in a text are special tokens, as is the library's default."""
        parts, owner = self._split(texts)
        ids, place, sizes, bound = self._pretokens(parts)
        flat = ids[spread(place, sizes)]
        edge = np.concatenate([[0], np.cumsum(sizes)])[bound]
        if len(parts) == len(texts):
            return flat, edge
        pieces = [flat[edge[i] : edge[i + 1]] if k is None else np.array([k], np.int32) for i, (_, k) in enumerate(owner)]
        own = np.bincount([i for i, _ in owner], [len(p) for p in pieces], len(texts)).astype(np.int64)
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum(own)])

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        parts, owner = self._split(texts)
        _, _, sizes, bound = self._pretokens(parts)
        own = np.diff(np.concatenate([[0], np.cumsum(sizes)])[bound])
        if len(parts) == len(texts):
            return own
        own += np.array([o[1] is not None for o in owner])
        return np.bincount(np.array([o[0] for o in owner]), own, len(texts)).astype(np.int64)

    def _split(self, texts: list[str]) -> tuple[list[str], list[tuple[int, int | None]]]:
        """Texts cut at special strings: parts, and each part's text and special id."""
        if not any(s in t for t in texts for s in self.special):
            return texts, []
        parts, owner = [], []
        for i, t in enumerate(texts):
            cut = [(t, None)]
            for s, k in self.special.items():
                cut = [y for x in cut for y in ([x] if x[1] is not None else _interleave(x[0].split(s), k))]
            parts += [x for x, _ in cut]
            owner += [(i, k) for _, k in cut]
        return parts, owner


def _interleave(segments: list[str], special: int) -> list[tuple[str, int | None]]:
    out = [(segments[0], None)]
    for s in segments[1:]:
        out += [("", special), (s, None)]
    return out


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. and so on."""
    total = int(size.sum())
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return np.arange(total) + shift


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary's strings."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


@lru_cache(2)
def load(path: str) -> Bpe:
    return Bpe(path)


def chunks(texts: list[str]):
    """Slices of texts of about CHUNK characters together."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHUNK:
            yield slice(first, i)
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield slice(first, len(texts))
