"""Whole-text tokenising with a memo of space-delimited chunks.

The tokenizers here split a text before any merge and never merge over such a split, so the ids of a
text are the ids of its chunks one after the other as long as chunks end where a split must be.
Most chunks of a corpus are frequent words: each worker keeps a bounded memo from chunk to ids and
runs the tokenizer only on chunks that it has not met, many at a time. The ids are those of a whole
text encoded in one call; tests compare both, also on odd white space.
"""

from __future__ import annotations

import ctypes
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The code points that Unicode calls White_Space, as the inside of a character class.
_WIDE = f"\x85\xa0{chr(0x1680)}{chr(0x2000)}-{chr(0x200A)}{chr(0x2028)}{chr(0x2029)}{chr(0x202F)}{chr(0x205F)}{chr(0x3000)}"
WHITE = f"\t-\r {_WIDE}"
#: White space besides space and newline, and the separators that only Python counts as such.
RARE = re.compile(f"[\t\x0b-\r\x1c-\x1f{_WIDE}]")
#: A word with the space before it, or white space that no word takes.
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
MEMO_ENTRIES = 600_000
SLICE_CHARS = 1_000_000


#: Punctuation that never shares a token with a letter or digit before it.
ENDINGS = ".,;:!?*$%&#|"


Batch = tuple[np.ndarray, np.ndarray, np.ndarray]
Encode = Callable[[list], Iterator[Batch]]


@lru_cache(maxsize=10_000)
def _solid(char: str) -> bool:
    """Whether a word's last character still ends in a letter or digit in composed lower case, as tokenizers may see it."""
    return char.isalnum() and unicodedata.normalize("NFC", char).lower()[-1].isalnum()


class ChunkMemo(dict):
    """Chunk to serial number, with the ids of each serial.

    encode: gives batches of a list of new chunks: their positions in it, their ids one after another
    and how many each has. A chunk that ends in punctuation after a
    letter or digit is made of the ids of the word and of the punctuation, so that a word is encoded
    once whatever follows it. ending: the chunk that stands for punctuation right after a word.
    """

    def __init__(self, encode: Encode, ending: Callable[[str], object] = str, entries: int = MEMO_ENTRIES):
        super().__init__()
        self._encode, self._ending, self._entries = encode, ending, entries
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self._new: list = []
        self._flat, self._used = np.zeros(1 << 20, np.uint32), 0
        self._begin, self._size, self._n = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32), 0

    def __missing__(self, chunk) -> int:
        serial = self[chunk] = self._n + len(self._new)
        self._new.append(chunk)
        return serial

    def _add(self, serials: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        total = self._used + len(ids)
        while len(self._flat) < total:
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        self._flat[self._used : total] = ids
        self._begin[serials] = self._used + np.cumsum(sizes) - sizes
        self._size[serials] = sizes
        self._used = total

    def _gather(self, serials: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of serials one after another, and where each ends."""
        sizes = self._size[serials]
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(self._begin[serials] - (ends - sizes), sizes)
        return self._flat[at], ends

    def _settle(self) -> None:
        """Encode the chunks met since the last call."""
        if not self._new:
            return
        whole, made = [], []
        for serial, chunk in enumerate(self._new[:], self._n):
            if type(chunk) is str and chunk and chunk[-1] in ENDINGS and (word := chunk.rstrip(ENDINGS)) and _solid(word[-1]):
                made.append((serial, self[word], self[self._ending(chunk[len(word) :])]))
            else:
                whole.append(serial)
        found = set(whole)
        done = {m[0] for m in made}
        whole += [s for s in range(self._n, self._n + len(self._new)) if s not in found and s not in done]
        n = self._n + len(self._new)
        while len(self._begin) < n:
            self._begin, self._size = (np.concatenate([x, np.zeros_like(x)]) for x in (self._begin, self._size))
        serials = np.array(whole, np.int64)
        for at, ids, sizes in self._encode([self._new[s - self._n] for s in whole]):
            self._add(serials[at], sizes, ids)
        if made:
            table = np.array(made)
            ids, ends = self._gather(table[:, 1:].ravel())
            self._add(table[:, 0], np.diff(ends[1::2], prepend=0), ids)
        self._n, self._new = n, []

    def ids(self, chunked: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, given as chunks, and where each text's ids begin (one more entry: the end)."""
        if len(self) > self._entries:
            self._reset()
        counts = np.fromiter(map(len, chunked), np.int64, len(chunked))
        serials = np.fromiter(map(self.__getitem__, chain.from_iterable(chunked)), np.int64, int(counts.sum()))
        self._settle()
        ids, ends = self._gather(serials)
        upto = np.concatenate([[0], ends])
        return ids, upto[np.concatenate([[0], np.cumsum(counts)])]


def spaced_chunks(text: str) -> list:
    """Chunks for byte-level splitting: a str stands for a space and itself, a 1-tuple for just itself.

    A single space between two other characters that are no white space always begins a new token,
    so texts whose only white space is such spaces and newlines within chunks are cut there at the
    speed of str.split; other texts go through the CHUNK pattern.
    """
    if not text:
        return []
    chunks = text.split(" ")
    if "" not in chunks and not RARE.search(text) and "\n " not in text and " \n" not in text:
        chunks[0] = (chunks[0],)
        return chunks
    return [c[1:] if len(c) > 1 and c[0] == " " and not c[1].isspace() else (c,) for c in CHUNK.findall(text)]


def plain_chunks(text: str) -> list[str]:
    """Chunks for tokenizers that drop white space: cut at every space and newline."""
    return text.replace("\n", " ").split(" ")


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


GROUP = 1000


def batch(positions: list[int], ids: list) -> Batch:
    """The ids of some chunks, each given as a list or array."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.array(positions, np.int64), np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes


def _groups(positions: list[int]) -> list[list[int]]:
    return [positions[i : i + GROUP] for i in range(0, len(positions), GROUP)]


def byte_level_encoder(path: str) -> Encode:
    """Encodes spaced_chunks with a byte-level BPE file of the tokenizers library.

    Chunks that begin with a space are encoded joined, since the split between them is certain, and
    told apart by the bytes that each id stands for.
    """
    t = _load(path)
    vocab = t.get_vocab()
    width = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        width[i] = len(token)  # one character of a byte-level token is one byte
    encoded = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(chunks: list) -> Iterator[Batch]:
        alone = [i for i, c in enumerate(chunks) if type(c) is not str]
        if alone:
            yield batch(alone, encoded([chunks[i][0] for i in alone]))
        groups = _groups([i for i, c in enumerate(chunks) if type(c) is str])
        for group, got in zip(groups, encoded([" " + " ".join([chunks[i] for i in g]) for g in groups]), strict=True):
            ids = np.array(got, np.uint32)
            ends = np.cumsum([1 + len(chunks[i].encode()) for i in group])
            upto = np.cumsum(width[ids])
            cuts = np.searchsorted(upto, ends) + 1
            if not len(ids) or upto[-1] != ends[-1] or (upto[cuts - 1] != ends).any():  # a token over a cut: not with these splits
                yield batch(group, encoded([f" {chunks[i]}" for i in group]))
            else:
                yield np.array(group), ids, np.diff(cuts, prepend=0)

    return encode


def word_level_encoder(path: str) -> Encode:
    """Encodes plain_chunks with a file whose pre-tokenizer drops white space and marks a word's last token.

    Chunks of letters alone are one word each; they are encoded joined by spaces and told apart by
    the tokens that end a word. On composed letters in lower case the file's normalizer and pattern
    do nothing but cut at the spaces, so words that Python's lower case makes such (all but those
    with a capital sigma, which it treats by context) go through a copy that only does that.
    """
    from tokenizers import pre_tokenizers

    t = _load(path)
    plain = _load(path)
    plain.normalizer = None
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocab = t.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    for token, i in vocab.items():
        ends[i] = token.endswith("</w>")
    encoded = lambda texts, t=t: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(chunks: list) -> Iterator[Batch]:
        kinds: tuple[list, list, list] = ([], [], [])
        for i, c in enumerate(chunks):
            simple = c.isascii() or "\u03a3" not in c and unicodedata.is_normalized("NFC", c) and c.lower().isalpha()
            kinds[0 if not c.isalpha() else 1 if simple else 2].append(i)
        alone = kinds[0]
        for joined, tokenizer in ((kinds[1], plain), (kinds[2], t)):
            groups = _groups(joined)
            texts = [" ".join([chunks[i] for i in g]) for g in groups]
            for group, got in zip(groups, encoded([x.lower() for x in texts] if tokenizer is plain else texts, tokenizer), strict=True):
                ids = np.array(got, np.uint32)
                cuts = np.flatnonzero(ends[ids]) + 1
                if len(cuts) != len(group) or cuts[-1] != len(ids):  # lower case took some letter apart
                    alone += group
                else:
                    yield np.array(group), ids, np.diff(cuts, prepend=0)
        if alone:
            yield batch(alone, encoded([chunks[i] for i in alone]))

    return encode


_MEMOS: dict = {}


def memo(key: tuple, make: Callable[[], Encode], ending: Callable[[str], object] = str, entries: int = MEMO_ENTRIES) -> ChunkMemo:
    """The worker's memo of one tokenizer; it outlives tasks. For spaced_chunks ending is `alone`."""
    if key not in _MEMOS:
        _MEMOS[key] = ChunkMemo(make(), ending, entries)
    return _MEMOS[key]


def alone(text: str) -> tuple[str]:
    """The chunk of spaced_chunks that stands for a text without a space before it."""
    return (text,)


def slices(keys: pa.Array, texts: pa.Array) -> Iterator[tuple[list, list[str]]]:
    """Rows in slices of about SLICE_CHARS bytes, so that few texts are Python objects at a time; null texts become empty."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + SLICE_CHARS)))
        yield keys[begin:end].to_pylist(), [t or "" for t in texts[begin:end].to_pylist()]
        begin = end


def hand_back() -> None:
    """Return memory that a worker's earlier stages have freed and kept."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
