"""Edit distances, many at once.

Distances follow the bit-parallel method with blocks of 64 rows: a column of the table is held as the
bits of its upward and downward steps. Pairs of like lengths go through it together, a numpy
operation each for all of them and for all blocks: each block is a column behind the one above it,
whose carry it takes. Only blocks within reach of the diagonal are touched. Pairs that must exceed
their limit are left behind on the way.

Most pairs of lines are far apart, also where they hold one passage at different places. These are
refuted before: a line is cut into parts, and each part is looked up, at its best, in the stretch of
the other line that an alignment within the limit can bring it to.
"""

from __future__ import annotations

import numpy as np

from . import wordhash

SIMILARITY = 0.8
#: Sequences longer than this are compared one pair at a time, and lines of which fewer than this are of like lengths; so many
#: pairs go together; steps between looks at the limit.
LONG, FEW, TOGETHER, LOOK = 4096, 24, 2048, 16
#: Bytes of the table of letters' places of pairs that go together, and letters from which each pair has numbers of its own.
PLACES_BYTES, MANY_KINDS = 12_000_000, 128
#: Letters of a part, the kinds that letters are folded into there (a power of 2), and parts and their steps that go together.
PART, KINDS, PARTS_TOGETHER, STEPS_TOGETHER = 64, 64, 2048, 1 << 20
_ONE, _ALL = np.uint64(1), ~np.uint64(0)


def distance(a, b) -> int:
    """Edit distance of two sequences, bit-parallel over the first."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top, out = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    plus, minus = full, 0
    for c in b:
        match = where.get(c, 0)
        diagonal = ((match & plus) + plus ^ plus | match | minus) & full
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        out += bool(up & top) - bool(down & top)
        up, down = up << 1 | 1, down << 1
        plus = (down | ~(diagonal | up)) & full
        minus = up & diagonal & full
    return out


def edit_similarity(a: str, b: str) -> float:
    """1 less the edit distance by the longer length; 1 for two empty lines."""
    longest = max(len(a), len(b))
    return 1 - distance(a, b) / longest if longest else 1.0


def capped_distances(a: list, b: list, limit: np.ndarray) -> np.ndarray:
    """For pairs of sequences of numbers from 0 on: their edit distance or a bound that is on the same side of the limit."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.maximum(la, lb)
    apart = np.abs(la - lb) > limit
    out[apart] = limit[apart] + 1
    todo = np.flatnonzero((la > 0) & (lb > 0) & ~apart & (out > limit))
    longest = out[todo]
    for i in todo[longest > LONG].tolist():
        out[i] = distance(a[i].tolist(), b[i].tolist())
    todo, longest = todo[longest <= LONG], longest[longest <= LONG]
    kinds = 1 + int(max(np.concatenate([x[i] for i in todo]).max() for x in (a, b))) if len(todo) else 0
    kind = _blocks(longest)
    for k in np.unique(kind).tolist():
        own = todo[kind == k]
        most = max(64, min(TOGETHER, PLACES_BYTES // (8 * min(kinds, 64 << k) << k)))
        for some in np.array_split(own, -(-len(own) // most)):
            some = some[np.argsort(-lb[some], kind="stable")]
            out[some] = _together([a[i] for i in some], [b[i] for i in some], la[some], lb[some], limit[some], kinds)
    return out


def _blocks(sizes: np.ndarray) -> np.ndarray:
    """Kinds of like lengths: 1, 2, 3 to 4, 5 to 8, ... blocks."""
    return np.ceil(np.log2(np.maximum(sizes, 64) / 64)).astype(np.int64)


def _close(a: list, b: list, limit: np.ndarray) -> np.ndarray:
    """Which pairs are within their limits: by capped_distances, and alone where few are of like lengths."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    alone = (np.minimum(la, lb) > 0) & (np.abs(la - lb) <= limit) & (np.maximum(la, lb) > limit)
    kind = _blocks(np.maximum(la, lb))
    alone &= np.bincount(kind[alone], minlength=kind.max(initial=0) + 1)[kind] < FEW
    out = np.zeros(len(a), bool)
    for i in np.flatnonzero(alone).tolist():
        out[i] = distance(a[i].tolist(), b[i].tolist()) <= limit[i]
    rest = np.flatnonzero(~alone)
    out[rest] = capped_distances([a[i] for i in rest.tolist()], [b[i] for i in rest.tolist()], limit[rest]) <= limit[rest]
    return out


def _padded(x: np.ndarray, sizes: np.ndarray, width: int, filler: int) -> np.ndarray:
    out = np.full((len(sizes), width), filler, np.int64)
    out[np.arange(width) < sizes[:, None]] = x
    return out


def _own_numbers(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The same pairs with numbers that each pair counts from 1; 0 in b for what its a has not. And one more than the largest."""
    pair = np.arange(len(la))
    ka, kb = a + np.repeat(pair, la) * kinds, b + np.repeat(pair, lb) * kinds
    there = np.unique(ka)
    before = np.searchsorted(there, pair * kinds)
    at = np.minimum(np.searchsorted(there, kb), len(there) - 1)
    na = np.searchsorted(there, ka) - np.repeat(before, la) + 1
    return na, np.where(there[at] == kb, at - np.repeat(before, lb) + 1, 0), int(na.max()) + 1


def _places(rows: np.ndarray, kinds: int) -> np.ndarray:
    """blocks x (kinds x pairs): the bits of the places in a block of 64 that hold a number, of each pair."""
    n, width = rows.shape
    out, at = np.zeros((width // 64, kinds * n), np.uint64), rows.T * np.int64(n) + np.arange(n)
    for i in range(width):
        block = out[i // 64]
        block[at[i]] |= _ONE << np.uint64(i % 64)
    return out


def _in_reach(up: np.ndarray, down: np.ndarray, more: np.ndarray, less: np.ndarray, la: np.ndarray, lb: np.ndarray, above: np.ndarray, limit: np.ndarray, low: int, step: int) -> np.ndarray:
    """Which pairs may end within their limits, as the blocks from low on stand before a step. above: the rise of the blocks left behind.

    From a place of the table to its end it takes as many edits at least as it is off the end's diagonal.
    Every eighth row is looked at: rows between are at most 4 away, and a diagonal step from one
    block into the next misses the places looked at by one, so that 10 less are certain.
    """
    count = lambda x: np.bitwise_count(x.copy().view(np.uint8)).astype(np.int32).reshape(*x.shape, 8)
    rises = np.cumsum(count(up) - count(down), axis=2, dtype=np.int32)
    carries = np.cumsum(more.astype(np.int32) - less.astype(np.int32), axis=0, dtype=np.int32)
    tops = (above + step - low + 1).astype(np.int32) - carries
    tops[1:] += np.cumsum(rises[:-1, :, 7], axis=0, dtype=np.int32)
    off = (la - lb + step).astype(np.int32) - 65 * np.arange(low, low + len(up), dtype=np.int32)[:, None]
    least = (tops + np.abs(off)).min(axis=0)
    rises += tops[:, :, None]
    rises += np.abs(off[:, :, None] - np.arange(8, 65, 8, dtype=np.int32))
    return (np.minimum(least, rises.min(axis=(0, 2))) <= limit + 10) | (lb + low <= step)


def _together(a: list, b: list, la: np.ndarray, lb: np.ndarray, limit: np.ndarray, kinds: int) -> np.ndarray:
    """capped_distances of pairs whose second sequences get no longer down the lists; none is empty, all numbers are below kinds."""
    n, blocks = len(a), -(-int(la.max()) // 64)
    # Columns by which a row may be left of or right of the diagonal: an alignment goes there and back within its limit.
    left, right = (int(((limit + x) // 2).max()) for x in (la - lb, lb - la))
    flat = [np.concatenate(x).astype(np.int64) for x in (a, b)]
    if kinds > MANY_KINDS:
        *flat, kinds = _own_numbers(*flat, la, lb, kinds)
    width = kinds * n + n  # a number more stands for the places after a line's end
    places = _places(_padded(flat[0], la, 64 * blocks, kinds), kinds + 1).ravel()
    columns = _padded(flat[1], lb, int(lb[0]) + blocks, 0).T * n + np.arange(n)  # where to look in a block's places
    base = width * np.arange(blocks)[:, None]
    up, down = np.full((blocks, n), _ALL), np.zeros((blocks, n), np.uint64)
    more, less = np.ones((blocks + 1, n), np.uint64), np.zeros((blocks + 1, n), np.uint64)  # carries into each block
    bits = np.clip(la - 64 * np.arange(blocks)[:, None], 0, 64).astype(np.uint64)
    within = np.where(bits == 64, _ALL, (_ONE << np.minimum(bits, np.uint64(63))) - _ONE)
    # out: what of a pair's distance is known; pairs left behind stay above their limit.
    out, pair, sums, low, last = limit + 1, np.arange(n), lb.copy(), 0, blocks - 1
    rise_of = lambda w, some: np.bitwise_count(up[w, some] & within[w, some]).astype(np.int64) - np.bitwise_count(down[w, some] & within[w, some])
    ends = set(lb.tolist())
    for step in range(int(lb[0]) + blocks):  # block w is at column step - w
        high = min(last, step, (step + left) // 65)
        dropped = low if step >= 65 * low + 64 + right else -1
        if dropped >= 0:  # out of reach from its column on
            some = slice(0, int(np.searchsorted(-lb, low - step, "right")))
            sums[some] += rise_of(low, some)
            low += 1
        for w in range(low, high + 1):
            if step - w in ends:
                some = slice(*(int(np.searchsorted(-lb, w - step, side)) for side in ("left", "right")))
                sums[some] += rise_of(w, some)
        if step and step % LOOK == 0 and low <= high:
            keep = _in_reach(*(x[low : high + 1] for x in (up, down, more, less)), la, lb, sums - lb, limit[pair], low, step)
            done = lb + blocks <= step
            out[pair[done]] = sums[done]
            keep = np.flatnonzero(keep & ~done)
            if not len(keep):
                return out
            if len(keep) < 0.9 * len(pair):
                pair, la, lb, sums, columns = pair[keep], la[keep], lb[keep], sums[keep], columns[:, keep]
                up, down, more, less, within = (x[:, keep] for x in (up, down, more, less, within))
                ends = set(lb.tolist())
        own = slice(low, high + 1)
        match = places.take(columns[step - high : step - low + 1][::-1] + base[own])
        plus, minus, carried, lost = up[own], down[own], more[own], less[own]
        either = match | minus
        match |= lost
        diagonal = match & plus
        diagonal += plus
        diagonal ^= plus
        diagonal |= match
        fall = plus & diagonal
        diagonal |= plus
        rise = ~diagonal
        rise |= minus
        next_more, next_less = rise >> np.uint64(63), fall >> np.uint64(63)
        rise <<= _ONE
        rise |= carried
        fall <<= _ONE
        fall |= lost
        down[own] = rise & either
        either |= rise
        np.invert(either, out=either)
        either |= fall
        up[own] = either
        more[low + 1 : high + 2], less[low + 1 : high + 2] = next_more, next_less
        if dropped >= 0:
            more[low], less[low] = _ONE, 0
    out[pair] = sums
    return out


class _Words:
    """The words of some lines, by hash and place."""

    def __init__(self, lines: list[str]):
        self.data = "\n".join([*lines, ""]).encode()
        raw = np.frombuffer(self.data, np.uint8)
        starts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
        self.h, self.begin, at = wordhash.words(raw, starts)
        gaps = np.flatnonzero((raw == 32) | (raw == 10))
        self.end = gaps[np.searchsorted(gaps, self.begin)]
        self.first, self.last = at[:-1], at[1:]

    def text(self, first: int, last: int) -> str:
        """Words first to last, as they stand."""
        return self.data[self.begin[first] : self.end[last - 1]].decode() if first < last else ""


def _folded(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all lines as numbers below KINDS, and where each line's begin. Longer lines than LONG count as empty."""
    lines = [x if len(x) <= LONG else "" for x in lines]
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    return np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint8) & np.uint8(KINDS - 1), np.append(0, ends)[:-1]


def _least(x: np.ndarray, first: np.ndarray, size: np.ndarray, y: np.ndarray, begin: np.ndarray, width: np.ndarray) -> np.ndarray:
    """For parts of x, of at most PART numbers: no more than their least distance to any run inside a stretch of y."""
    out = np.zeros(len(first), np.int64)
    order = np.argsort(width, kind="stable")
    while len(order):
        fit = int(np.searchsorted(width[order] * np.arange(1, len(order) + 1), STEPS_TOGETHER, "right"))
        fit = min(max(fit, 1), PARTS_TOGETHER)
        own, order = order[:fit], order[fit:]
        steps, rows, sizes = int(width[own[-1]]), np.arange(fit) * KINDS, size[own]
        places = np.zeros(fit * KINDS, np.uint64)
        for i in range(int(sizes.max())):
            some = np.flatnonzero(sizes > i)
            places[rows[some] + x[first[own[some]] + i]] |= _ONE << np.uint64(i)
        within = _ALL >> (64 - sizes).astype(np.uint64)
        # A stretch shorter than the widest one goes on into what follows, which only makes its part's distance less.
        columns = np.add(np.lib.stride_tricks.sliding_window_view(y, steps)[begin[own]].T, rows, dtype=np.int64, order="C")
        up, down, least = np.full(fit, _ALL), np.zeros(fit, np.uint64), sizes.astype(np.uint8)
        fall, rise = np.empty(fit, np.uint64), np.empty(fit, np.uint64)
        for step in range(steps):
            match = places.take(columns[step])
            np.bitwise_and(match, up, out=fall)
            fall += up
            fall ^= up
            fall |= match
            match |= down
            np.bitwise_or(fall, up, out=rise)
            np.invert(rise, out=rise)
            rise |= down
            fall &= up
            rise <<= _ONE
            fall <<= _ONE
            np.bitwise_or(match, rise, out=up)
            np.invert(up, out=up)
            up |= fall
            np.bitwise_and(match, rise, out=down)
            now = np.bitwise_count(up & within)
            now -= np.bitwise_count(down & within)  # never below 0
            np.minimum(least, now, out=least)
        out[own] = least
    return out


def limits(a: list[str], b: list[str]) -> np.ndarray:
    """The edits at which pairs of lines still have a similarity of SIMILARITY."""
    longest = np.fromiter((max(len(x), len(y)) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    return np.floor((1 - SIMILARITY) * longest + 1e-6).astype(np.int64)


def apart(a: list[str], b: list[str], limit: np.ndarray) -> np.ndarray:
    """Which pairs are surely further apart than their limits: few that are stay, and none that are not go.

    An alignment with at most so many edits keeps near the diagonal, and what its parts cost adds up. Every second
    part mostly tells already.
    """
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.abs(la - lb) > limit
    (x, xs), (y, ys) = _folded(a), _folded(b)
    y = np.append(y, np.zeros(int(limit[la <= LONG].max(initial=0)) + PART + 2, np.uint8))
    low, high = -((limit - lb + la) // 2), (limit + lb - la) // 2  # diagonals that it may take
    parts, sums = -(-la // PART), np.zeros(len(a), np.int64)
    for turn in (0, 1):
        todo = np.flatnonzero(~out & (np.maximum(la, lb) <= LONG))
        own = (parts[todo] + 1 - turn) // 2
        pair = np.repeat(todo, own)
        if not len(pair):
            continue
        nth = 2 * (np.arange(len(pair)) - np.repeat(np.cumsum(own) - own, own)) + turn
        first, last = (la[pair] * n // parts[pair] for n in (nth, nth + 1))
        begin = np.clip(first + low[pair], 0, lb[pair])
        width = np.maximum(np.minimum(last + high[pair], lb[pair]) - begin, 1)
        sums += np.bincount(pair, _least(x, xs[pair] + first, last - first, y, ys[pair] + begin, width), len(a)).astype(np.int64)
        out |= sums > limit
    return out


def alike(a: list[str], b: list[str]) -> np.ndarray:
    """Which pairs of lines of words with single spaces have an edit similarity of SIMILARITY or more."""
    limit = limits(a, b)
    out = ~apart(a, b, limit)
    left = np.flatnonzero(out)
    out[left] = within([a[i] for i in left.tolist()], [b[i] for i in left.tolist()], limit[left])
    return out


def within(a: list[str], b: list[str], limit: np.ndarray) -> np.ndarray:
    """Which pairs of lines of words with single spaces are at most their limit apart.

    Equal words at both ends are left out first. Words edited in the rest, each as costly as the
    longest with its space, may be few enough to be sure; other pairs are compared letter by letter.
    """
    if not len(a):
        return np.zeros(0, bool)
    x, y = _Words(a), _Words(b)
    shorter = np.minimum(x.last - x.first, y.last - y.first)
    pair = np.repeat(np.arange(len(a)), shorter)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(shorter) - shorter, shorter)
    equal_run = lambda differs: _first(differs, nth, pair, shorter)
    head = equal_run(x.h[x.first[pair] + nth] != y.h[y.first[pair] + nth])
    tail = np.minimum(equal_run(x.h[x.last[pair] - 1 - nth] != y.h[y.last[pair] - 1 - nth]), shorter - head)
    ends = [(w.first + head, w.last - tail) for w in (x, y)]
    numbers = np.unique(np.concatenate([x.h, y.h]), return_inverse=True)[1].astype(np.int32)
    codes = [[own[i:j] for i, j in zip(f.tolist(), e.tolist(), strict=True)] for own, (f, e) in zip((numbers[: len(x.h)], numbers[len(x.h) :]), ends, strict=True)]
    costliest = np.maximum(*(_longest(w.end - w.begin, f, e) for w, (f, e) in zip((x, y), ends, strict=True))) + 1
    few = limit // costliest
    out = _close(*codes, few)
    todo = np.flatnonzero(~out)
    letters: tuple[list, list] = ([], [])
    (xf, xl), (yf, yl) = ends
    for i in todo.tolist():
        s, t = x.text(xf[i], xl[i]), y.text(yf[i], yl[i])
        if not s and a[i]:
            t += " "  # the words left over and the space between them and the rest
        elif not t and b[i]:
            s += " "
        for c, text in zip(letters, (s, t), strict=True):
            c.append(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    if len(todo):
        alphabet = np.unique(np.concatenate([*letters[0], *letters[1]]))
        codes = [[np.searchsorted(alphabet, c).astype(np.int32) for c in side] for side in letters]
        out[todo] = _close(*codes, limit[todo])
    return out


def _first(differs: np.ndarray, nth: np.ndarray, pair: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each pair the first place that differs, its size if none does."""
    out = sizes.copy()
    at = np.flatnonzero(differs)
    np.minimum.at(out, pair[at], nth[at])
    return out


def _longest(width: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The largest width from first to last, 0 where there is none."""
    out = np.zeros(len(first), np.int64)
    some = np.flatnonzero(first < last)
    if len(some):
        edges = np.stack([first[some], last[some]], axis=1).ravel()
        out[some] = np.maximum.reduceat(np.append(width, 0), edges)[::2]
    return out
