"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit similarity, one occurrence a group.

Lines are normalised (lower case, ASCII punctuation left out, single spaces). Equal normalised lines
are one node. A node has two 64-bit SimHashes, over its words and over its pairs of words, and a
sketch: the least hashes of its word shingles (longer ones in longer lines).

Nodes are dealt by two routes. SimHashes within BLOCK_DISTANCE bits are found by the pigeonhole rule:
of m blocks at least m - BLOCK_DISTANCE agree, so values are dealt out by every choice of that many
blocks; m depends on how many values there are (the more, the more bits must agree), and changes only
how many are dealt the same by chance. Lines at the edit similarity of SIMILARITY are mostly further
apart: they share runs of words, so nodes are also dealt by every hash of their sketch, and are near
if their SimHashes differ in at most DISTANCE and PAIR_DISTANCE bits.

The nodes of a deal meet in groups of bounded size (see meeting). First each node is paired with the
nearest one before it in all its deals alone, and verified by the edit similarity of the normalised lines.
Then, in deals that still hold several components of these links, all near nodes of different
components are verified inside their groups, so a crowd never makes all its pairs and none is left out.
Verified links make groups. The first line of a group by document and place stays, all its other
occurrences go. Lines without words always stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark import workspace
from shelfspark.operators import graph

from . import edits, meeting, tokenizing, wordhash

#: Bits in which SimHashes over words may differ in a pigeonhole deal, in a sketch's deal, and those over pairs of words.
BLOCK_DISTANCE, DISTANCE, PAIR_DISTANCE, SIMILARITY = 3, 18, 24, edits.SIMILARITY
#: Lines shorter than this have too few pairs of words for the last bound.
SHORT = 100
#: Hashes of a sketch, and the words of its shingles (half of them of each length) in lines of at most so many words.
SKETCH, SHINGLES = 8, ((9, 3, 3), (15, 3, 4), (24, 4, 5), (1 << 40, 5, 5))
#: Lines of at most so many words are also sketched by all their words but one.
VERY_FEW_WORDS = 5
KEYS = [f"k{i}" for i in range(SKETCH)]
LINES = "row long, doc_id long, copy long, line int, h long, s long, g long, size int, " + ", ".join(f"{k} long" for k in KEYS)
LINE_COLUMNS = [c.split()[0] for c in LINES.split(", ")]
#: Rows without texts, and pairs of lines and their characters, that a worker takes together.
MANY_ROWS, MANY_PAIRS, MANY_LETTERS = 50_000, 4_000, 3_000_000
#: Rows of a group held against all of it at once, pairs whose hashes are compared and pairs gathered together, those
#: refuted together, and those compared before components are looked up again.
STRIP, MANY_SHARED, MANY_NEAR, MANY_FAR, MANY_CHECKED = 128, 50_000, 200_000, 16_000, 2_000
#: Members of a pigeonhole deal that are held against all of it before they are dealt out; and lines compared last in a task.
LARGE_DEAL, LINES_A_TASK = 1 << 14, 8_000
#: Bytes of lines that are hashed at once; a longer line goes alone.
PIECE = 250_000
#: Where the sketch begins among the columns that _join takes.
KEYS_AT = 10


def normalise(text: str) -> bytes:
    """Lower case, ASCII punctuation as spaces; newlines stay."""
    return text.lower().encode().translate(wordhash.NO_PUNCTUATION)


def normal_line(line: str) -> str:
    """A line as its edit similarity is taken of."""
    return b" ".join(normalise(line).split()).decode()


class Lines:
    """Every line with words of some normalised texts: its text's index, its number in it, and its digest."""

    def __init__(self, texts: list[bytes]):
        data, starts = wordhash.join(texts)
        words, begin, _ = wordhash.words(data, starts)
        ends = np.flatnonzero(data == 10)
        line = np.searchsorted(ends, begin)  # of each word
        first = np.flatnonzero(np.diff(line, prepend=-1))
        own = line[first]
        at = np.concatenate([[0], ends + 1])[own]
        self.text = np.searchsorted(starts, at, "right") - 1
        self.number = own - np.searchsorted(ends, starts[self.text])
        self._words, self._first, self.counts = words, first, np.diff(np.append(first, len(words)))
        self._line = np.repeat(np.arange(len(first)), self.counts)
        self._place = np.arange(len(words)) - np.repeat(first, self.counts)
        self._left = np.repeat(self.counts, self.counts) - self._place  # words from each to its line's end
        self._grams = {1: words}
        if len(first):
            placed = wordhash.mix(words ^ (self._place + 1).astype(np.uint64) * wordhash.GOLDEN)
            self.h = wordhash.mix(np.add.reduceat(placed, first))
        else:
            self.h = np.zeros(0, np.uint64)
        # Characters: bytes that begin one and are no white space, and a space between words.
        letters = np.concatenate([[0], np.cumsum(~wordhash.IS_SPACE[data] & ((data >= 192) | (data < 128)))])
        self.size = letters[ends[own]] - letters[at] + self.counts - 1

    def simhashes(self) -> tuple[np.ndarray, np.ndarray]:
        """SimHashes over words, and over pairs of words (the word itself in lines of one)."""
        if not len(self._first):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        pairs = self._shingles(2)
        whole = (self._left > 1) | (self._place == 0) & (self._left == 1)
        held = np.maximum(self.counts - 1, 1)
        return _simhash(self._words, self._first, self.counts), _simhash(pairs[whole], np.cumsum(held) - held, held)

    def sketches(self) -> np.ndarray:
        """lines x SKETCH: the least different hashes of the line's shingles, 0 where there are fewer.

        Longer lines have longer shingles, so that lines which only share common words seldom share
        a hash. Lines of very few words have the hashes of all their words, and of all but each one.
        """
        out = np.zeros((len(self._first), SKETCH), np.uint64)
        half, least = SKETCH // 2, 0
        for most, k, longer in SHINGLES:
            lines = (self.counts > least) & (self.counts <= most)
            if lines.any():
                if k == longer:
                    out |= self._least(k, lines, SKETCH)
                else:
                    out[:, :half] |= self._least(k, lines, half)
                    out[:, half:] |= self._least(longer, lines, half)
            least = most
        few = np.flatnonzero(self.counts <= VERY_FEW_WORDS)
        if len(few):
            out[few, SKETCH - VERY_FEW_WORDS - 1 :] = self._all_but_one(few)
        return out

    def _all_but_one(self, lines: np.ndarray) -> np.ndarray:
        """Of lines of very few words the hashes of all words, and of all but the first, the second, ... word."""
        n = VERY_FEW_WORDS
        held = np.arange(n) < self.counts[lines][:, None]
        words = self._words[np.minimum(self._first[lines][:, None] + np.arange(n), len(self._words) - 1)]
        at = lambda x, place: wordhash.mix(x ^ wordhash.mix(np.uint64(place + 1) * np.full(1, wordhash.GOLDEN)))
        here, before = (np.where(held, np.stack([at(words[:, j], max(0, j - d)) for j in range(n)], axis=1), 0) for d in (0, 1))
        out = np.zeros((len(lines), n + 1), np.uint64)
        out[:, n] = here.sum(axis=1)
        for i in range(n):
            out[:, i] = np.where(held[:, i] & (self.counts[lines] > 1), here[:, :i].sum(axis=1) + before[:, i + 1 :].sum(axis=1), 0)
        return np.where(out == 0, 0, wordhash.mix(out) | np.uint64(1))

    def _shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; means nothing where the line ends before."""
        if k not in self._grams:
            shorter = self._shingles(k - 1)
            out = shorter.copy()
            if len(out) >= k:
                out[: 1 - k] = wordhash.mix(shorter[: 1 - k] * wordhash.GOLDEN + self._words[k - 1 :])
            self._grams[k] = out
        return self._grams[k]

    def _least(self, k: int, lines: np.ndarray, n: int) -> np.ndarray:
        """lines x n: the n least different shingles of k words of the marked lines."""
        own = np.flatnonzero(lines[self._line] & (self._left >= k))
        h = wordhash.mix(self._shingles(k)[own] + np.uint64(k) * wordhash.GOLDEN)
        key = np.sort(self._line[own].astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
        key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
        line = (key >> np.uint64(40)).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(lines)))])
        nth = np.arange(len(key)) - begin[line]
        kept = nth < n
        out = np.zeros((len(lines), n), np.uint64)
        out[line[kept], nth[kept]] = wordhash.mix((key[kept] & np.uint64((1 << 40) - 1)) * np.uint64(8) + np.uint64(k)) | np.uint64(1)
        return out


#: A byte's bits, each in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _simhash(h: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each line, whose hashes begin at first: every bit that more than half of them have.

    Bits are counted eight at a time, in the bytes of a number, over at most 255 hashes at once.
    """
    parts = -(-counts // 255)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    sums = np.add.reduceat(_SPREAD[h.view(np.uint8)].reshape(-1, 8), np.repeat(first, parts) + 255 * nth, axis=0).view(np.uint8).reshape(-1, 64)
    if (parts > 1).any():
        sums = np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0, dtype=np.int32)
    return np.packbits(2 * sums.astype(np.int32) > counts[:, None], axis=1).reshape(-1).view(np.uint64)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokenizing.hand_back()
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        numbered = batch.num_columns > 3
        done = 0
        for keys, texts in tokenizing.slices(batch.column(0), batch.column(1)):
            at = slice(done, done + len(keys))
            rows = batch.column(3)[at].to_numpy() if numbered else np.arange(row, row + len(keys))
            row, done = row + len(keys), done + len(keys)
            own, copies = (pa.array(rows, pa.int64()), pa.array(keys, pa.int64())), batch.column(2)[at]
            for index, before, pieces in _pieces(map(normalise, texts)):
                lines = Lines(pieces)
                text, (s, g) = pa.array(index[lines.text]), lines.simhashes()
                columns = [*(x.take(text) for x in (*own, copies)), pa.array((lines.number + before[lines.text]).astype(np.int32))]
                columns += [pa.array(x.view(np.int64)) for x in (lines.h, s, g)] + [pa.array(lines.size.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(x) for x in lines.sketches().view(np.int64).T.copy()], LINE_COLUMNS)


def _pieces(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Whole lines of some texts, about PIECE bytes at a time: each piece's text by number, the lines before it there, and the pieces."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for n, text in enumerate(texts):
        at = lines = 0
        while at >= 0:
            cut = text.find(b"\n", at + PIECE)
            piece = text[at : cut if cut >= 0 else None]
            held.append((n, lines, piece))
            size += len(piece)
            lines, at = lines + piece.count(b"\n") + 1, cut + 1 if cut >= 0 else -1
            if size >= PIECE:
                yield np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held]
                held, size = [], 0
    if held:
        yield np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held]


def plan_blocks(values: int) -> tuple[int, int]:
    """How many blocks, and how many must agree: enough bits that few values are dealt the same by chance."""
    for m in range(BLOCK_DISTANCE + 1, 64):
        agree = m - BLOCK_DISTANCE
        if 64 * agree // m >= min(40, max(1, values).bit_length() - 6):
            return m, agree
    raise ValueError("too many values")


def _deal(s: np.ndarray, m: int, agree: int) -> np.ndarray:
    """values x deals: the agreed bits of each choice of blocks, mixed with the choice's number. Always even."""
    cuts = [64 * i // m for i in range(m + 1)]
    masks = [np.uint64((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(m)]
    out = []
    for number, choice in enumerate(combinations(range(m), agree)):
        mask = np.bitwise_or.reduce([masks[i] for i in choice])
        out.append(wordhash.mix((s & mask) ^ wordhash.mix(np.full(1, number + 1, np.uint64) * wordhash.GOLDEN)) & ~np.uint64(1))
    return np.stack(out, axis=1)


def near(deal: np.ndarray, s: np.ndarray, g: np.ndarray, size: np.ndarray, some: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a group are near which, and the bits that they are apart; of groups in the first axis if there are more.

    Odd deals are sketches. some: only these against all.
    """
    facing = lambda x: (x[..., some, None], x[..., None, :])
    least = np.ceil(SIMILARITY * size - 1e-6).astype(size.dtype)  # the least size alike
    (la, lb), (ka, kb), (ta, tb) = facing(size), facing(least), facing(size < SHORT)
    sketch = (deal[..., some] & 1).astype(bool)[..., :, None]
    words, pairs = (np.bitwise_count(np.bitwise_xor(*facing(x))) for x in (s, g))
    found = words <= np.where(sketch, np.uint8(DISTANCE), np.uint8(BLOCK_DISTANCE))
    found &= (pairs <= np.uint8(PAIR_DISTANCE)) | ~sketch | (ta & tb)
    found &= la >= kb
    found &= lb >= ka
    return found, words + pairs


def _close(s: np.ndarray) -> np.ndarray:
    """Which values have another one within BLOCK_DISTANCE bits, a strip of them at a time."""
    return np.concatenate([(np.bitwise_count(s[at : at + STRIP, None] ^ s) <= BLOCK_DISTANCE).sum(axis=1) > 1 for at in range(0, len(s), STRIP)])


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by deal those that are not alone in theirs."""
    held: pa.RecordBatch | None = None  # the last row so far
    joins = False  # whether it has the deal of the one before it

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        deal = rows.column(0).to_numpy()
        same = deal[1:] == deal[:-1]
        mark = np.append(same, False) | np.append(joins, same)
        yield rows.slice(0, len(deal) - 1).filter(pa.array(mark[:-1]))
        held, joins = rows.slice(len(deal) - 1), bool(mark[-1])
    if held is not None and joins:
        yield held


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Groups by size: rows, and the places of the rows of groups of one size, groups x members."""
    for rows, edges in meeting.whole_groups(batches, keys, MANY_ROWS):
        sizes = np.diff(edges)
        for n in np.unique(sizes[sizes > 1]).tolist():
            places = edges[:-1][sizes == n][:, None] + np.arange(n)
            for some in np.array_split(places, -(-places.size * n // 1_000_000)):
                yield rows, some, np.arange(n)


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows deal, a, b, part, id, s, g, size sorted by group: those with a near one, and the nearest of less id with its bits apart."""
    tokenizing.hand_back()
    for rows, place, n in _groups(batches, 3):
        deal, part, node = (rows.column(i).to_numpy()[place] for i in (0, 3, 4))
        s, g, size = rows.column(5).to_numpy().view(np.uint64)[place], rows.column(6).to_numpy().view(np.uint64)[place], rows.column(7).to_numpy()[place]
        some, at, least = _least_apart(deal, part, node, s, g, size, n)
        kept, none = rows.take(pa.array(place[some])), least[some] == 255
        columns = [pa.array(np.take_along_axis(node, at, axis=1)[some], pa.int64(), mask=none), pa.array(least[some].astype(np.int32), pa.int32(), mask=none)]
        yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*rows.schema.names, "nearest", "bits"])


def _least_apart(deal: np.ndarray, part: np.ndarray, node: np.ndarray, s: np.ndarray, g: np.ndarray, size: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of groups x members: which have a near one, the place of the nearest of less id, and the bits to it (255 if there is none).

    Large groups are taken a strip of members at a time.
    """
    step = len(n) if len(n) <= 4 * STRIP else STRIP
    out: tuple[list, list, list] = ([], [], [])
    for begin in range(0, len(n), step):
        strip = slice(begin, begin + step)
        close, bits = near(deal, s, g, size, strip)
        found = _met(close, part, n, strip)
        bits[~(found & (node[:, None, :] < node[:, strip, None]))] = 255
        at = bits.argmin(axis=2)
        for x, y in zip(out, (found.any(axis=2), at, np.take_along_axis(bits, at[:, :, None], axis=2)[:, :, 0]), strict=True):
            x.append(y)
    return tuple(np.concatenate(x, axis=1) for x in out)


def _met(found: np.ndarray, part: np.ndarray, n: np.ndarray, some: slice) -> np.ndarray:
    """Pairs of two parts, or within the part if there is but one; no row with itself."""
    across = (part.min(axis=1) != part.max(axis=1))[:, None, None]
    return found & (n[some, None] != n[None, :]) & (~across | (part[:, some, None] != part[:, None, :]))


class Forest:
    """Roots of components, joined by the links found so far."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def _near_pairs(rows: pa.RecordBatch, own: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i and j of the near rows of a group that are of different roots and not partners, and the bits they are apart.

    Taken a strip of rows at a time; pairs that share several hashes are left to the least of them.
    """
    column = lambda c: rows.column(c)[own].to_numpy(zero_copy_only=False)
    deal, part, node, s, g, size, root = (column(c) for c in (0, 3, 4, 5, 6, 7, 9))
    partner = rows.column(8)[own].fill_null(-1).to_numpy()
    keys = np.stack([column(KEYS_AT + k) for k in range(SKETCH)], axis=1) if deal[0] & 1 else None
    across, n = part.min() != part.max(), len(deal)
    found = []
    for begin in range(0, n, STRIP):
        strip = slice(begin, min(n, begin + STRIP))
        close, bits = near(deal, s.view(np.uint64), g.view(np.uint64), size, strip)
        close &= root[strip, None] != root
        close &= np.arange(n) > np.arange(strip.start, strip.stop)[:, None]
        if across:
            close &= part[strip, None] != part
        i, j = np.nonzero(close)
        bits, i = bits[i, j], i + begin
        new = (partner[i] != node[j]) & (partner[j] != node[i])
        i, j, bits = i[new], j[new], bits[new]
        for at in range(0, len(i), MANY_SHARED if keys is not None else len(i) or 1):
            x, y, z = (v[at : at + MANY_SHARED] if keys is not None else v for v in (i, j, bits))
            if keys is not None:
                shared = (keys[x][:, :, None] == keys[y][:, None, :]).any(axis=2) & (keys[x] != 0)
                first = np.where(shared, keys[x], np.iinfo(np.int64).max).min(axis=1) == deal[0]
                x, y, z = x[first], y[first], z[first]
            found.append((x.astype(np.int32) + own.start, y.astype(np.int32) + own.start, z))
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint8)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _parts(sizes: np.ndarray, most: int, letters: int = MANY_LETTERS) -> Iterator[slice]:
    """Runs of at most so many entries, and of so many letters in sum but for single ones."""
    sums, at = np.cumsum(sizes), 0
    while at < len(sizes):
        upto = int(np.searchsorted(sums, (sums[at - 1] if at else 0) + letters, "right"))
        end = min(max(upto, at + 1), at + most)
        yield slice(at, end)
        at = end


def _settled(rows: pa.RecordBatch, pairs: list, forest: Forest) -> Iterator[pa.RecordBatch]:
    """Links among pairs of places of rows, enough to join all that they join.

    Of every two components the nearest pair is compared first, then twice as many, and so on; pairs
    whose components a link has joined meanwhile are left out.
    """
    i, j, bits = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.argsort(bits, kind="stable")
    i, j = i[order], j[order]
    node, size = rows.column(4).to_numpy(), rows.column(7).to_numpy().astype(np.int64)
    roots, own = np.unique(rows.column(9).to_numpy(), return_inverse=True)
    lines: dict[int, str] = {}
    raw, take = rows.column(KEYS_AT + SKETCH), 1

    def now() -> np.ndarray:
        """The component of every row as it stands, numbered from 0."""
        return np.unique(np.fromiter(map(forest.find, roots.tolist()), np.int64, len(roots)), return_inverse=True)[1][own]

    while len(i):
        held = now()
        apart = held[i] != held[j]
        i, j = i[apart], j[apart]
        both = np.minimum(held[i], held[j]) * len(roots) + np.maximum(held[i], held[j])
        order = np.argsort(both, kind="stable")
        begins = np.flatnonzero(np.diff(both[order], prepend=-1))
        nth = np.empty(len(both), np.int64)
        nth[order] = np.arange(len(both)) - np.repeat(begins, np.diff(np.append(begins, len(both))))
        chosen = nth < take
        x, y = i[chosen], j[chosen]
        i, j, take = i[~chosen], j[~chosen], 2 * take
        for many in _parts(size[x] + size[y], MANY_FAR, 4 * MANY_LETTERS):
            held = now()
            apart = held[x[many]] != held[y[many]]
            u, v = x[many][apart], y[many][apart]
            new = [k for k in np.unique(np.concatenate([u, v])).tolist() if k not in lines]
            lines.update(zip(new, map(normal_line, raw.take(pa.array(new, pa.int64())).to_pylist()), strict=True))
            limit = edits.limits([lines[k] for k in u.tolist()], [lines[k] for k in v.tolist()])
            left = ~edits.apart([lines[k] for k in u.tolist()], [lines[k] for k in v.tolist()], limit)
            u, v, limit = u[left], v[left], limit[left]
            for some in _parts(size[u] + size[v], MANY_CHECKED):
                held = now() if some.start else held
                run = some.start + np.flatnonzero(held[u[some]] != held[v[some]])
                same = run[edits.within([lines[k] for k in u[run].tolist()], [lines[k] for k in v[run].tolist()], limit[run])]
                for one, other in zip(roots[own[u[same]]].tolist(), roots[own[v[same]]].tolist(), strict=True):
                    forest.join(one, other)
                yield pa.RecordBatch.from_arrays([pa.array(f(node[u[same]], node[v[same]])) for f in (np.minimum, np.maximum)], ["u", "v"])


def _facing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows deal, a, b, part, id, s, g, size, partner, root, keys sorted by group: those that _join compares with some other."""
    tokenizing.hand_back()
    for rows, edges in meeting.whole_groups(batches, 3, MANY_ROWS):
        kept = np.zeros(rows.num_rows, bool)
        for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if end - begin > 1:
                i, j, _ = _near_pairs(rows, slice(begin, end))
                kept[i] = kept[j] = True
        yield rows.filter(pa.array(kept))


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows deal, a, b, part, id, s, g, size, partner, root, keys, raw sorted by group: links between near rows of different roots.

    A row and its partner have been compared before. The links join all that any near pair of a group joins.
    """
    tokenizing.hand_back()
    forest = Forest()
    for rows, edges in meeting.whole_groups(batches, 3):
        pairs: list = []
        held = 0
        for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if end - begin > 1:
                pairs.append(_near_pairs(rows, slice(begin, end)))
                held += len(pairs[-1][0])
            if held >= MANY_NEAR:
                yield from _settled(rows, pairs, forest)
                pairs, held = [], 0
        if pairs:
            yield from _settled(rows, pairs, forest)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows u, v and their lines as they stand: links."""
    for batch in batches:
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
        for run in _parts(sizes, MANY_PAIRS):
            some = batch.slice(run.start, run.stop - run.start)
            same = edits.alike(*([normal_line(t) for t in some.column(c).to_pylist()] for c in (2, 3)))
            u, v = (some.column(c).to_numpy()[same] for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(f(u, v)) for f in (np.minimum, np.maximum)], ["u", "v"])


def _raw_lines(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, raw: the line as it stands in a document that holds it, for every wanted id."""
    place = workspace.materialize(wanted.distinct().join(workspace.shuffled(nodes.select("id", "doc_id", "copy", "line")), "id"), "wanted_lines")
    held = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_copy"), "text")
    by_doc = place.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("id", "line")).alias("lines"))
    by_doc = workspace.materialize(by_doc, "wanted_by_document")
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_copy") == F.col("copy"))
    cut = held.join(workspace.broadcast_if_small(by_doc), same).select(F.split("text", "\n", -1).alias("cut"), "lines")
    found = cut.select("cut", F.explode("lines").alias("x")).select("x.id", F.get("cut", F.col("x.line")).alias("raw"))
    found = workspace.materialize(found.dropDuplicates(["id"]), "raw_lines")  # rows alike in id and text give a line twice
    workspace.discard(place, by_doc)
    return found


def _links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links u, v of node ids, enough to join all that links join."""
    m, agree = plan_blocks(nodes.count())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deals = _deal(batch.column(1).to_numpy().view(np.uint64), m, agree).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(deals.ravel()), *(pa.array(np.repeat(batch.column(i).to_numpy(), deals.shape[1])) for i in (0, 1))], ["deal", "id", "s"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of pigeonhole deals with a near SimHash in theirs; those of a deal beyond LARGE_DEAL are left to its groups."""
        for rows, edges in meeting.whole_groups(batches, 1, MANY_ROWS):
            sizes, s, kept = np.diff(edges), rows.column(2).to_numpy().view(np.uint64), np.zeros(rows.num_rows, bool)
            for n in np.unique(sizes[sizes > 1]).tolist():
                places = edges[:-1][sizes == n][:, None] + np.arange(n)
                if n > meeting.PART_ROWS:
                    for own in places:
                        kept[own] = _close(s[own]) if n <= LARGE_DEAL else True
                    continue
                for some in np.array_split(places, -(-places.size * n // 1_000_000)):
                    kept[some] = (np.bitwise_count(s[some][:, :, None] ^ s[some][:, None, :]) <= BLOCK_DISTANCE).sum(axis=2) > 1
            yield rows.select(["deal", "id"]).filter(pa.array(kept))

    by_block = nodes.select("id", "s").mapInArrow(deal, "deal long, id long, s long").repartition("deal").sortWithinPartitions("deal")
    by_sketch = nodes.select(F.explode(F.array(*KEYS)).alias("deal"), "id").where("deal <> 0").repartition("deal").sortWithinPartitions("deal")
    # One after the other, so that the shuffle of the first is gone when the second's is written.
    by_block = workspace.materialize(by_block.mapInArrow(close, "deal long, id long"), "dealt_by_block")
    workspace.discard()
    by_sketch = workspace.materialize(by_sketch.mapInArrow(_several, "deal long, id long"), "dealt_by_sketch")
    workspace.discard()
    dealt = by_block.unionByName(by_sketch)
    grouped = meeting.deal(dealt, "deal", "id").join(workspace.shuffled(nodes.select("id", "s", "g", "size")), "id").select("deal", "a", "b", "part", "id", "s", "g", "size")
    kind = "deal long, a int, b int, part int, id long, s long, g long, size int, nearest long, bits int"
    close_by = workspace.materialize(grouped.repartition("deal", "a", "b").sortWithinPartitions("deal", "a", "b").mapInArrow(_nearest, kind), "near_lines")
    workspace.discard(by_block, by_sketch)

    best = close_by.where("nearest IS NOT NULL").groupBy("id").agg(F.min_by("nearest", "bits").alias("partner"))
    pairs = workspace.materialize(best.select(F.col("id").alias("u"), F.col("partner").alias("v")), "line_pairs")
    raw = _raw_lines(docs, nodes, close_by.select("id"))
    a, b = raw.select(F.col("id").alias("u"), F.col("raw").alias("ra")), raw.select(F.col("id").alias("v"), F.col("raw").alias("rb"))
    links = workspace.materialize(pairs.join(workspace.shuffled(a), "u").join(workspace.shuffled(b), "v").select("u", "v", "ra", "rb").mapInArrow(_verify, "u long, v long"), "line_links", meeting.BATCH_BYTES)

    roots = graph.components(links)
    rooted = close_by.drop("nearest", "bits").join(workspace.shuffled(pairs.select(F.col("u").alias("id"), F.col("v").alias("partner"))), "id", "left")
    rooted = rooted.join(workspace.shuffled(roots.withColumnRenamed("node", "id")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = workspace.materialize(rooted, "rooted_lines")
    workspace.discard(close_by)
    by_deal = Window.partitionBy("deal")
    several = rooted.withColumn("least", F.min("root").over(by_deal)).withColumn("most", F.max("root").over(by_deal)).where("least < most").drop("least", "most")
    # A pair is compared in the least deal of its two rows here, so each has its own along and no node moves for it.
    own = F.array_distinct(F.collect_list(F.when(F.col("deal") % 2 != 0, F.col("deal"))).over(Window.partitionBy("id")))
    keys = [F.coalesce(F.get("own", F.lit(i)), F.lit(0)).alias(k) for i, k in enumerate(KEYS)]
    met = several.withColumn("own", own).select("deal", "a", "b", "part", "id", "s", "g", "size", "partner", "root", *keys)
    kind = ", ".join(f"{c} {t}" for c, t in met.dtypes)
    by_group = lambda rows: rows.repartition("deal", "a", "b").sortWithinPartitions("deal", "a", "b")
    facing = workspace.materialize(by_group(met).mapInArrow(_facing, kind), "facing_lines")  # few of them: only these move with their texts
    workspace.discard(rooted)
    # Comparing them takes far longer than their bytes tell, so their number says how many tasks share it.
    texts = facing.join(workspace.shuffled(raw), "id").select(*facing.columns, "raw")
    texts = texts.repartition(facing.count() // LINES_A_TASK + 1, "deal", "a", "b").sortWithinPartitions("deal", "a", "b")
    more = texts.mapInArrow(_join, "u long, v long")
    more = workspace.materialize(more, "line_links", meeting.BATCH_BYTES)
    workspace.discard(facing, raw)
    return links.unionByName(more)


def duplicate_lines(docs: DataFrame, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The lines of docs: row, doc_id, line, h; and the ones to drop: row, line.

    docs needs doc_id and text. row: a column that numbers its rows; without it rows are numbered as
    they are read. Null and empty texts have no lines with words. Null ids come first, and ids may
    repeat. Equal lines of one document are duplicates of each other too. Rows alike in all columns
    count as different documents: the later one loses its lines. An empty table gives no rows.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("copy"), *([F.col(row).cast("long").alias("row")] if row else []))
    digests = workspace.materialize(read.mapInArrow(_digest, LINES), "lines", meeting.BATCH_BYTES)
    # All of fixed width, so that hashing and no sorting finds the nodes; first() takes one row's values.
    nodes = digests.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "copy", "line", "s", "g", "size", *KEYS)])
    nodes = workspace.materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "line_nodes")
    workspace.discard()  # the shuffle, before more is written
    lines = workspace.materialize(digests.select("row", "doc_id", "line", "h"), "line_places")
    workspace.discard(digests)
    roots = workspace.materialize(graph.components(_links(docs, nodes)), "line_roots")
    # Lines that occur once and are like no other stay out of all that follows.
    ends = roots.select(F.col("node").alias("id"), "root").unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
    grouped = nodes.select("h", "id", "n").join(workspace.shuffled(ends), "id", "left").where("n > 1 OR root IS NOT NULL").select("h", F.coalesce("root", "id").alias("root"))
    grouped = workspace.materialize(grouped, "line_groups")
    workspace.discard(nodes)
    crowded = workspace.materialize(lines.select("row", "doc_id", "line", "h").join(workspace.broadcast_if_small(grouped), "h").select("row", "doc_id", "line", "root"), "crowded_lines")
    stays = crowded.groupBy("root").agg(F.min(F.struct("doc_id", "row", "line")).alias("stays"))
    stays = workspace.broadcast_if_small(workspace.materialize(stays, "first_lines"))
    drop = crowded.join(stays, "root").where((F.col("row") != F.col("stays.row")) | (F.col("line") != F.col("stays.line"))).select("row", "line")
    return lines, drop


def dedup_texts(docs: DataFrame) -> DataFrame:
    """docs with duplicate lines taken out of the texts; n_chars, if there, follows the text. Rows and other columns stay.

    A document all of whose lines occur earlier is left with its lines without words, or an empty text.
    Columns of docs may have any names.
    """
    numbered = workspace.materialize(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    with workspace.scope(docs.sparkSession):  # what the dropped lines are found from goes
        _, drop = duplicate_lines(numbered.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), "row"), "row")
        dropped = workspace.keep(workspace.materialize(drop.groupBy("row").agg(F.collect_set("line").alias("lost")), "dropped_lines"))
    workspace.discard()
    joined = numbered.join(workspace.broadcast_if_small(dropped), "row", "left").withColumn("cut", F.when(F.col("lost").isNotNull(), F.split("doc.text", "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("cut") - 1), "lost")  # by a hash set: linear in the lines
    left = F.array_join(F.transform(kept, lambda i: F.get("cut", i)), "\n")
    out = {"text": F.when(F.col("lost").isNull(), F.col("doc.text")).otherwise(left)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("lost").isNull(), F.col("doc.n_chars")).otherwise(F.length(left).cast(docs.schema["n_chars"].dataType))
    return joined.select(*[out.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op1_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document with lines: doc_id, n_lines with words, n_kept, and dropped, the numbers of the lines that go."""
    lines, drop = duplicate_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    lost = drop.groupBy("row").agg(F.array_sort(F.collect_list("line")).alias("dropped"))
    per_row = lines.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_lines"))
    out = per_row.join(workspace.shuffled(lost), "row", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("dropped")).alias("n_kept"), "dropped")
