"""Benchmark decontamination by templates.

A text's tokens are canonicalised twice: plainly (A-Z and the capitals of Latin-1 lower-cased), and as a
template in which numbers and units after a number are typed placeholders.  Where a
name stands is decided by the item: each of its capitalised words, also one that opens
a sentence, is a gap of the window's hash, so a text's word there may be any, in
either case.  Texts are hashed once for each set of gaps that the items' windows have.
Windows of tokens are hashed and joined with the windows of the benchmark's items.
Where neighbouring capitalised words are one name, or a unit follows its number, there
are also windows in which they are one token, so a name or quantity may change its
number of words.
Windows of mostly placeholders are hashed with the marks between their tokens.  Those
that hold no word and no mark but , . ; count only in a chain with one that does, so
of an item of bare numbers only verbatim copies can be told from any other numbers.
Matching windows of a text and an item on one diagonal are an alignment; alignments in
order and no further apart than the item is long are a chain.  In a chain each
placeholder's value in the item must stand for one value in the text and the other
way round.  An item is in the text if the windows of a chain, and verbatim windows
anywhere, cover the asked share of its tokens.

The benchmark's windows are broadcast in blocks of bounded size, one pass over the
texts for each block; an ordinary benchmark is one block.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinloom.llm import arrays
from joinloom.llm.arrays import U

# Words that are units when they follow a number.
UNITS = (
    "mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mph kph kmh dollar dollars cent cents euro euros percent degree degrees w kw watt watts v volt volts hz khz mhz ghz kb mb gb tb"
).split()


@dataclass(frozen=True)
class Settings:
    """``window`` tokens are hashed together, with the marks between them if more
    than half are placeholders; an item is found if ``covered`` of its tokens are.  Shorter items
    are one window; those under ``least`` tokens are looked for if ``short``, word for
    word and with the marks between their tokens.  ``block``:
    characters of items that are broadcast at a time, besides one long item."""

    window: int = 8
    covered: float = 0.5
    least: int = 5
    block: int = 8 << 20
    short: bool = False


_DIGIT, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n\r\"|"]] = True
_WEAK = np.frombuffer(b",.;", np.uint8)
_NUMBER, _UNIT = arrays.mix(np.array([1, 2], U))
#: Odd factors of a window's tokens, one for each place in it.
_PLACES = arrays.mix(np.arange(3, 67, dtype=U)) | U(1)


_FIELDS = ("plain", "template", "number", "unit", "capital", "name", "joins", "marks", "telling")


@dataclass
class Tokens:
    """plain: hash of each token as it stands; template: the same, or its
    placeholder's type; number and unit: which are placeholders; capital: which begin
    with a capital; name: those that don't open a sentence; joins: which are one name
    or quantity with the token before; marks: hash of the marks before, 0 if none, and
    telling: whether others than , . ; are among them; first: each text's first."""

    plain: np.ndarray
    template: np.ndarray
    number: np.ndarray
    unit: np.ndarray
    capital: np.ndarray
    name: np.ndarray
    joins: np.ndarray
    marks: np.ndarray
    telling: np.ndarray
    first: np.ndarray

    def part(self, a: int, b: int) -> Tokens:
        return Tokens(*(getattr(self, f)[a:b] for f in _FIELDS), np.array([0, b - a]))


@dataclass
class Stream:
    """The tokens of texts, then those near joined ones once more, with these as one.

    begin and end: what each covers in ``Tokens``; run: equal for tokens that follow
    each other in one text; joined: which are several; measure: a quantity's unit, or
    0; plain_end: how many are not of the second kind."""

    plain: np.ndarray
    template: np.ndarray
    number: np.ndarray
    unit: np.ndarray
    capital: np.ndarray
    name: np.ndarray
    marks: np.ndarray
    telling: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    run: np.ndarray
    joined: np.ndarray
    measure: np.ndarray
    plain_end: int

    def whole(self, n: int) -> np.ndarray:
        """Which windows of n tokens lie in one text and are not there already."""
        inside = self.run[: len(self.run) - n + 1] == self.run[n - 1 :]
        inside[self.plain_end :] &= counts(self.joined, n)[self.plain_end :] > 0
        return inside


def stream(t: Tokens, window: int) -> Stream:
    size = len(t.plain)
    owner = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    begin = np.flatnonzero(~t.joins)
    end = np.append(begin[1:], size)
    joined = end - begin > 1
    sums = np.concatenate([[0], np.cumsum(joined)])
    at = np.arange(len(begin))
    near = np.flatnonzero(sums[np.minimum(at + window, len(begin))] > sums[np.maximum(at - window + 1, 0)])
    begin, end, joined = begin[near], end[near], joined[near]
    quantity = joined & t.number[begin]
    within = np.arange(size) - np.maximum.accumulate(np.where(t.joins, 0, np.arange(size)))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(t.plain * _PLACES[within % len(_PLACES)])])
    plain = np.where(joined & ~quantity, arrays.mix(sums[end] - sums[begin]), t.plain[begin])
    measure = np.zeros(len(begin), U)
    measure[quantity] = t.plain[begin[quantity] + 1]
    after = np.diff(near, prepend=-1) != 1
    run = np.cumsum(after | (np.diff(owner[begin], prepend=-1) != 0)) + len(t.first)
    template = np.where(t.number[begin], _NUMBER, plain)
    none = np.zeros(size, bool)
    own = (plain, template, t.number[begin], t.unit[begin], t.capital[begin], t.name[begin] | (joined & ~quantity), t.marks[begin], t.telling[begin], begin, end, run, joined, measure)
    raw = (t.plain, t.template, t.number, t.unit, t.capital, t.name, t.marks, t.telling, np.arange(size), np.arange(1, size + 1), owner, none, np.zeros(size, U))
    return Stream(*(np.concatenate(x) for x in zip(raw, own, strict=True)), size)


def tokens(batch: list[str]) -> Tokens:
    buf, starts = arrays.joined(batch)
    upper = np.concatenate([[False], (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)])
    digit = _DIGIT[buf]
    lone, lead, mark = _lone(buf)
    # A point or comma between digits belongs to the number.
    inner = np.zeros(len(buf), bool)
    inner[1:-1] = ((buf[1:-1] == 44) | (buf[1:-1] == 46)) & digit[:-2] & digit[2:]
    kinds = np.where(digit | inner, 1, np.where(_LETTER[buf], 2, 0)).astype(np.int8)
    kinds[lone] = 3
    kinds[mark] = 0
    edge = np.flatnonzero(np.append(lead, False) | (np.diff(kinds, prepend=np.int8(0), append=np.int8(0)) != 0))
    begin, end = edge[:-1], edge[1:]
    kept = kinds[begin] > 0 if len(begin) else np.empty(0, bool)
    begin, end = begin[kept], end[kept]
    number = kinds[begin] == 1
    plain = arrays.span_hashes(buf + np.where(upper, 0x20, 0).astype(np.uint8), begin, end, fold=True)
    first = np.searchsorted(begin, starts)
    stops = np.concatenate([[0], np.cumsum(_STOP[buf])])
    before = np.concatenate([[0], end[:-1]]) if len(end) else end
    opens = stops[begin] > stops[before]
    opens[first[first < len(begin)]] = True
    after = np.minimum(begin + 1, len(buf) - 1)
    capital = ((buf[begin] >= 65) & (buf[begin] <= 90)) | upper[after]
    follows = np.concatenate([[False], number[:-1]]) & ~opens if len(number) else number
    unit = ~number & follows & np.isin(plain, _unit_hashes())
    capital = capital & ~number & ~unit
    template = np.where(number, _NUMBER, np.where(unit, _UNIT, plain))
    spaced = np.zeros(len(begin), bool)
    spaced[1:] = (begin[1:] == end[:-1] + 1) & (buf[end[:-1]] == 32)
    joins = unit | (spaced & capital & np.concatenate([[False], capital[:-1]])[: len(begin)] & ~opens)
    # What stands between tokens: all that is neither theirs nor white space.
    is_mark = (kinds == 0) & ~arrays._SPACE[buf]
    till = np.concatenate([[0], np.cumsum(is_mark)])
    found = buf[is_mark]
    marks = np.where(till[begin] > till[before], arrays.span_hashes(found, till[before], till[begin]), U(0))
    told = np.concatenate([[0], np.cumsum(is_mark & ~np.isin(buf, _WEAK))])
    telling = told[begin] > told[before]
    return Tokens(plain, template, number, unit, capital, capital & ~opens, joins, marks, telling, first)


def _lone(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of characters that are tokens alone, as their scripts have no spaces
    (Han, kana, Thai, Lao, Burmese, Khmer); the first of each; bytes of those scripts'
    and full-width marks."""
    none = np.zeros(len(buf), bool)
    if not (buf >= 0xE0).any():
        return none, none, none
    b, c, d = buf, np.append(buf[1:], np.uint8(0)), np.append(buf[2:], np.zeros(2, np.uint8))[: len(buf)]
    within = lambda x, low, high: (x >= low) & (x <= high)
    mark = (b == 0xE3) & (c == 0x80) & ~within(d, 0x85, 0x87)
    mark |= (b == 0xEF) & (((c == 0xBC) & (within(d, 0x81, 0x8F) | within(d, 0x9A, 0xA0) | within(d, 0xBB, 0xBF))) | ((c == 0xBD) & ((d == 0x80) | within(d, 0x9B, 0xA5))))
    three = within(b, 0xE3, 0xE9) | ((b == 0xE0) & within(c, 0xB8, 0xBB)) | ((b == 0xE1) & (within(c, 0x80, 0x82) | within(c, 0x9E, 0x9F))) | ((b == 0xEF) & within(c, 0xA4, 0xAB))
    three &= ~mark
    four = (b == 0xF0) & within(c, 0xA0, 0xB3)

    def all_of(first: np.ndarray, n: int) -> np.ndarray:
        out = first.copy()
        for k in range(1, n):
            out[k:] |= first[:-k]
        return out

    return all_of(three, 3) | all_of(four, 4), three | four, all_of(mark, 3)


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        _units.append(arrays.strings(UNITS))
    return _units[0]


def terms(values: np.ndarray, n: int) -> list[np.ndarray]:
    """What the tokens at each place of all windows of n tokens add to their hashes
    (over the ends of texts too; the caller leaves those out)."""
    return [values[k : len(values) - n + 1 + k] * _PLACES[k] for k in range(n)]


def covered(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and how much the spans of each cover; in order of key and start."""
    of, which = np.unique(key, return_inverse=True)
    far = which * (int(stop.max(initial=0)) + 1)  # so that no key's spans reach into the next one's
    till = np.concatenate([[0], np.maximum.accumulate(stop + far)[:-1]])[: len(stop)]
    return of, np.bincount(which, np.maximum(0, stop + far - np.maximum(start + far, till)), len(of))


def counts(flags: np.ndarray, n: int) -> np.ndarray:
    """How many of each window's tokens are flagged."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[n:] - sums[: len(sums) - n]


class Table:
    """Windows by hash; most hashes that aren't there are told by their upper bits."""

    def __init__(self, h: np.ndarray, item: np.ndarray, at: np.ndarray, items: int):
        order = np.lexsort((at, item, h))
        self.keys, self.item, self.at, self.items = h[order], item[order], at[order], items
        self.unique, which = np.unique(self.keys, return_inverse=True)
        self.pair = which * items + self.item  # in order
        self.shift = U(64 - min(24, max(10, len(h).bit_length() + 7)))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[h >> self.shift] = True

    def _at(self, hashes: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.seen.take((hashes >> self.shift).view(np.int64)))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which hashes meet which windows: their number, the item, its token."""
        pos = self._at(hashes)
        low, high = (np.searchsorted(self.keys, hashes[pos], side) for side in ("left", "right"))
        which, row = spread(low, high)
        return pos[which], self.item[row], self.at[row]

    def find_of(self, hashes: np.ndarray, owner: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``find``, but only windows of items wanted for the hash's text: owner is each
        hash's text, wanted the sorted numbers text * items + item."""
        pos = self._at(hashes)
        low, high = (np.searchsorted(wanted, (owner[pos] + more) * self.items) for more in (0, 1))
        which = np.minimum(np.searchsorted(self.unique, hashes[pos]), len(self.unique) - 1)
        some = (high > low) & (self.unique[which] == hashes[pos])
        pos, low, high, which = pos[some], low[some], high[some], which[some]
        of, row = spread(low, high)
        pos, pair = pos[of], which[of] * self.items + wanted[row] % self.items
        of, row = spread(*(np.searchsorted(self.pair, pair, side) for side in ("left", "right")))
        return pos[of], self.item[row], self.at[row]


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges low..high, and which range each is of."""
    count = high - low
    which = np.repeat(np.arange(len(low)), count)
    return which, np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(which))


class Index:
    """The windows of a block of items, by their length and gaps (a bit for each)."""

    #: The gaps' key of plain windows.
    PLAIN = -1
    #: That of plain windows with the marks in them, for short items.
    SHORT = -2
    #: Added to the gaps' key: marks are hashed too; nothing in the window is telling.
    DENSE, WEAK = 1 << 61, 1 << 60
    #: A window in more items than this is looked up only for items of which another one
    #: was found in the text; see ``_split``.
    COMMON = 16

    def __init__(self, items: list[tuple[int, str]], s: Settings):
        self.s, self.ids, self.items = s, [], []
        t = tokens([x for _, x in items])
        self.found: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        seen: dict[bytes, int] = {}
        for k, (item, _) in enumerate(items):
            own = t.part(t.first[k], t.first[k + 1])
            key = own.plain.tobytes() + own.unit.tobytes() + own.capital.tobytes() + own.name.tobytes()
            if len(own.plain) < (1 if s.short else s.least):
                continue
            if len(own.plain) < s.least:
                key += own.marks[1:].tobytes()
            if key in seen:
                self.ids[seen[key]].append(item)
                continue
            seen[key] = len(self.ids)
            self._add(stream(own, s.window), len(self.ids))
            self.ids.append([item])
        #: Where each item's tokens begin in these, and how many it has.
        self.first = np.concatenate([[0], np.cumsum([len(x.begin) for x in self.items], dtype=int)])
        self.begin, self.end = (np.concatenate([*(getattr(x, f) for x in self.items), np.empty(0, int)]) for f in ("begin", "end"))
        self.size = np.array([x.plain_end for x in self.items], int)
        self.tables = self._split({(n, gaps): tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for n, by in self.found.items() for gaps, parts in by.items()})
        del self.found

    def _split(self, found: dict) -> dict[int, dict[int, tuple[Table | None, Table | None]]]:
        """Each table's windows that are looked up in every text, and those that wait.

        Windows in many items (a header that they share) would give each text that holds
        them hits of all these.  If an item's such windows cover too little of it
        together, it can't be found by them alone, so they wait for another hit."""
        common = {}
        for key, (h, _, _) in found.items():
            _, which, count = np.unique(h, return_inverse=True, return_counts=True)
            common[key] = count[which] > self.COMMON
        spans = [(item[c], *self._span(item[c], at[c], key[0])) for key, (_, item, at) in found.items() if (c := common[key]).any()]
        waits = np.ones(len(self.items), bool)
        if spans:
            item, start, stop = (np.concatenate(x) for x in zip(*spans, strict=True))
            order = np.lexsort((start, item))
            of, share = covered(item[order], start[order], stop[order])
            waits[of] = share < self.s.covered * self.size[of]
        out = defaultdict(dict)
        for (n, gaps), (h, item, at) in found.items():
            late = common[n, gaps] & waits[item]
            out[n][gaps] = tuple(Table(h[x], item[x], at[x], len(self.items)) if x.any() else None for x in (~late, late))
        return dict(out)

    def _span(self, item: np.ndarray, at: np.ndarray, n: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The item's tokens that windows of n cover."""
        return self.begin[self.first[item] + at], self.end[self.first[item] + at + n - 1]

    def _add(self, own: Stream, item: int) -> None:
        """Plain windows; templates with gaps at all capitalised words, or if these are
        too many at the names within sentences, or else with none; and, if there are
        too many, with marks and gaps, unless gaps outnumber all that is not a gap."""
        self.items.append(own)
        size = own.plain_end
        if size < self.s.least:
            self.found[size][self.SHORT].append(((sum(terms(own.plain, size)) + marked(own, size))[:1], np.array([item]), np.array([0])))
            return
        short = size - int((own.end - own.begin - 1)[size:].sum())  # its tokens with joined ones as one
        self._add_windows(own, int(min(self.s.window, size)), item, slice(0, size if short < self.s.window else None))
        if self.s.least <= short < min(self.s.window, size):
            self._add_windows(own, short, item, slice(size, None))

    def _add_windows(self, own: Stream, n: int, item: int, part: slice) -> None:
        if len(own.plain) < n:
            return
        whole = own.whole(n)
        chosen = np.zeros(len(whole), bool)
        chosen[part] = True
        chosen &= whole
        at = np.flatnonzero(chosen[: own.plain_end])
        if len(at):
            self.found[n][self.PLAIN].append((sum(terms(own.plain, n))[at], np.full(len(at), item), at))
        parts, left, dense = terms(own.template, n), chosen, chosen
        for gap in (own.capital, own.name, np.zeros(len(own.name), bool)):
            enough = left & (2 * counts(own.number | own.unit | gap, n) <= n)
            left = left & ~enough
            dense = dense & ~(enough & (counts(gap, n) > 0))
            masks = sum(gap[k : len(gap) - n + 1 + k].astype(int) << k for k in range(n))
            for mask in np.unique(masks[enough]).tolist():
                at = np.flatnonzero(enough & (masks == mask))
                self.found[n][mask].append((gapped(parts, mask)[at], np.full(len(at), item), at))
        between = marked(own, n)
        inner = lambda flags: counts(flags[1:], n - 1)[: len(between)]
        for gap in (own.capital, own.name):
            slots = counts(own.number | own.unit | gap, n)
            left = dense & (2 * slots > n) & (2 * (n - counts(gap, n) + inner(own.marks != 0)) >= n)
            weak = (slots == n) & (inner(own.telling) == 0)
            masks = sum(gap[k : len(gap) - n + 1 + k].astype(int) << k for k in range(n)) + self.DENSE + weak * self.WEAK
            for mask in np.unique(masks[left]).tolist():
                at = np.flatnonzero(left & (masks == mask))
                self.found[n][mask].append((gapped(parts, mask)[at] + between[at], np.full(len(at), item), at))

    def search(self, texts: list[str]) -> list[dict[int, float]]:
        """For each text the items found in it and their covered share."""
        raw, out = tokens(texts), [{} for _ in texts]
        t, hits, waiting = stream(raw, self.s.window), [], []
        owner = np.searchsorted(raw.first, t.begin, "right") - 1

        def add(inside: np.ndarray, gaps: int, n: int, pos: np.ndarray, item: np.ndarray, at: np.ndarray) -> None:
            hits.append(np.stack([pos, item, at, np.full(len(pos), gaps), np.full(len(pos), n)])[:, inside[pos]])

        for n, tables in self.tables.items():
            if len(t.plain) < n:
                continue
            inside = t.whole(n)
            plain, parts = sum(terms(t.plain, n)), terms(t.template, n)
            whole = sum(parts)
            between = marked(t, n) if any(gaps >= self.DENSE or gaps == self.SHORT for gaps in tables) else U(0)
            dense = whole + between
            for gaps, (now, late) in tables.items():
                if gaps < 0:
                    hashes = plain if gaps == self.PLAIN else plain + between
                else:
                    hashes = gapped(parts, gaps, dense if gaps >= self.DENSE else whole)
                if now:
                    add(inside, gaps, n, *now.find(hashes))
                if late:
                    waiting.append((late, hashes, inside, gaps, n))
        if waiting and any(x.shape[1] for x in hits):
            wanted = np.unique(np.concatenate([owner[x[0]] * len(self.items) + x[1] for x in hits]))
            for late, hashes, inside, gaps, n in waiting:
                add(inside, gaps, n, *late.find_of(hashes, owner, wanted))
        if not hits or not (hits := np.concatenate(hits, axis=1)).shape[1]:
            return out
        text = owner[hits[0]]
        start, stop = self._span(hits[1], hits[2], hits[4])
        pair = text * len(self.items) + hits[1]
        order = np.lexsort((start, pair))
        of, share = covered(pair[order], start[order], stop[order])
        enough = np.isin(pair, of[share >= self.s.covered * self.size[of % len(self.items)]])
        hits, text = hits[:, enough], text[enough]
        order = np.lexsort((t.begin[hits[0]], hits[1], text))
        hits, text = hits[:, order], text[order]
        edge = np.flatnonzero((np.diff(text, prepend=-1, append=-1) != 0) | (np.diff(hits[1], prepend=-1, append=-1) != 0))
        for i, j in zip(edge, edge[1:], strict=False):
            m = int(hits[1, i])
            share = self._share(t, self.items[m], hits[:, i:j])
            if share >= self.s.covered:
                for one in self.ids[m]:
                    out[text[i]][one] = max(out[text[i]].get(one, 0.0), share)
        return out

    def _share(self, t: Stream, own: Stream, hits: np.ndarray) -> float:
        """The share of an item that its windows in a text cover."""
        weak = (hits[3] >= 0) & (hits[3] & self.WEAK > 0)
        if weak.any():  # without a telling window near by they can't be in a chain that counts
            at = t.begin[hits[0]]
            others = np.append(at[~weak], -(1 << 60))
            right = np.minimum(np.searchsorted(others[:-1], at), max(len(others) - 2, 0))
            near = np.minimum(abs(at - others[right]), abs(at - others[right - 1])) <= 2 * own.plain_end
            hits = hits[:, ~weak | near]
        verbatim, every = np.zeros(own.plain_end, bool), np.zeros(own.plain_end, bool)
        for _, _, a, gaps, n in hits.T.tolist():
            span = slice(own.begin[a], own.end[a + n - 1])
            every[span] = True
            if gaps < 0:
                verbatim[span] = True
        if every.mean() < self.s.covered or verbatim.all():
            return float(verbatim.mean())
        best, chains = verbatim, []
        for x in self._aligned(t, own, hits[:, hits[3] >= 0]):
            chain = x
            for before in chains:
                joined = before.extended(x, own.plain_end)
                if joined and (joined.telling, joined.mark.sum()) > (chain.telling, chain.mark.sum()):
                    chain = joined
            chains.append(chain)
            if chain.telling and (verbatim | chain.mark).sum() > best.sum():
                best = verbatim | chain.mark
            if best.all():
                break
        return float(best.mean())

    def _aligned(self, t: Stream, own: Stream, hits: np.ndarray) -> list[Chain]:
        """The windows of each diagonal, dealt so that slots are consistent, in order."""
        out: dict[int, list[Chain]] = defaultdict(list)
        for p, _, a, gaps, n in hits.T.tolist():
            gap = (gaps >> np.arange(n) & 1).astype(bool)
            if (t.number[p : p + n] & gap).any():
                continue
            slots = np.flatnonzero(gap | own.number[a : a + n] | own.unit[a : a + n])
            pairs = {(int(own.plain[a + k]), int(t.plain[p + k])) for k in slots}
            pairs |= {(int(x), int(y)) for x, y in zip(own.measure[a : a + n], t.measure[p : p + n], strict=True) if x and y}
            if not consistent({}, {}, pairs):
                continue
            at, to, start, stop = int(t.begin[p]), int(t.end[p + n - 1]), int(own.begin[a]), int(own.end[a + n - 1])
            same = out[at - start]
            one = next((x for x in same if consistent(x.there, x.back, pairs)), None)
            if one is None:
                same.append(one := Chain(at, to, start, stop, at - start, np.zeros(own.plain_end, bool), {}, {}, False))
            one.add(pairs)
            one.telling |= not gaps & self.WEAK
            one.mark[start:stop] = True
            one.to, one.stop = max(one.to, to), max(one.stop, stop)
        return sorted((x for same in out.values() for x in same), key=lambda x: (x.at, x.start))


#: Tokens by which a name or quantity may grow or shrink where alignments overlap.
SHIFT = 4


@dataclass
class Chain:
    """Alignments: where the last begins and all end in the text (at, to) and in the
    item (start, stop), its diagonal, the item's tokens they cover, the slots' values,
    and whether any window holds a word or a telling mark."""

    at: int
    to: int
    start: int
    stop: int
    diagonal: int
    mark: np.ndarray
    there: dict[int, int]
    back: dict[int, int]
    telling: bool

    def add(self, pairs) -> None:
        self.there.update(pairs)
        self.back.update((y, x) for x, y in pairs)

    def extended(self, x: Chain, reach: int) -> Chain | None:
        """This chain with one more alignment, if that is in order, near and consistent.
        Text is not used twice: alignments overlap only by what a slot's length shifts."""
        if x.at <= self.at or x.start <= self.start or x.at - self.to > reach:
            return None
        if (x.at < self.to or x.start < self.stop) and abs(x.diagonal - self.diagonal) > SHIFT and x.diagonal != self.diagonal:
            return None
        if not consistent(self.there, self.back, x.there.items()):
            return None
        return Chain(x.at, max(self.to, x.to), x.start, max(self.stop, x.stop), x.diagonal, self.mark | x.mark, self.there | x.there, self.back | x.back, self.telling or x.telling)


def consistent(there: dict[int, int], back: dict[int, int], pairs) -> bool:
    """Whether each value still stands for one value, both ways, with these pairs."""
    return all(there.get(x, y) == y and back.get(y, x) == x for x, y in pairs) and len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs})


def marked(x: Stream, n: int) -> np.ndarray:
    """What the marks within windows of n tokens add to their hashes."""
    places = [x.marks[k : len(x.marks) - n + 1 + k] * (_PLACES[k] ^ U(0x5DEECE66D << 1)) for k in range(1, n)]
    return sum(places, np.zeros(len(x.marks) - n + 1, U))


def gapped(parts: list[np.ndarray], mask: int, whole: np.ndarray | None = None) -> np.ndarray:
    """Hashes of windows without the places of the mask's bits."""
    out, copied = sum(parts) if whole is None else whole, whole is None
    for k, x in enumerate(parts):
        if mask >> k & 1:
            out = np.subtract(out, x, out=out if copied else None)
            copied = True
    return out


def _blocks(benchmark: DataFrame, s: Settings):
    """Lists of items of bounded size, so that the driver never holds all."""
    block, held = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        if r.item_id is None:
            continue
        if block and held + len(r.text) > s.block:
            yield block
            block, held = [], 0
        block.append((r.item_id, r.text))
        held += len(r.text)
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per distinct doc_id of ``docs`` (doc_id, text): doc_id, contaminated,
    item_ids (sorted), coverage (the largest share of an item that was found, 0 if none).

    benchmark: item_id, text; items with a null id are not looked for, a null text is
    empty, and a text without a letter or digit is never found.  A null text holds nothing.  Rows with a null doc_id give one row together;
    repeated rows of a doc_id give one.  No other columns are read.  An empty benchmark
    contaminates nothing; empty documents give an empty table.  A text is searched whole; a
    very long one is one row of a task.  Items with equal texts are each found.
    """
    found = None
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in _blocks(benchmark, s):
        passed = _search(keyed, block, s)
        found = passed if found is None else found.unionByName(passed)
    if found is None:
        found = keyed.select("doc_id", F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("coverage"))
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids"))))
    out = found.groupBy("doc_id").agg(items.alias("item_ids"), F.max("coverage").alias("coverage"))
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "coverage")


def _search(keyed: DataFrame, block: list[tuple[int, str]], s: Settings) -> DataFrame:
    shared = keyed.sparkSession.sparkContext.broadcast(Index(block, s))

    def run(batches):
        for b in arrays.slices(batches):
            texts, found = arrays.texts(b.column("text")), []
            for part in arrays.chunks(np.array([len(t) for t in texts])):
                found += shared.value.search(texts[part])
            items = pa.array([sorted(x) for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), items, pa.array([max(x.values(), default=0.0) for x in found], pa.float64())], ["doc_id", "item_ids", "coverage"])

    return keyed.mapInArrow(run, "doc_id long, item_ids array<long>, coverage double")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no item: one pass for each block.

    A row is judged by its own text, so a null doc_id or a repeated one changes nothing;
    a null text holds nothing and stays.  Else as ``decontaminate``."""
    for block in _blocks(benchmark, s):
        docs = _clean(docs, docs.sparkSession.sparkContext.broadcast(Index(block, s)))
    return docs


def _clean(docs: DataFrame, shared) -> DataFrame:
    def run(batches):
        for b in arrays.slices(batches):
            texts, found = arrays.texts(b.column("text")), []
            for part in arrays.chunks(np.array([len(t) for t in texts])):
                found += shared.value.search(texts[part])
            yield b.filter(pa.array([not x for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
