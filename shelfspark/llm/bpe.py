"""Byte-level BPE from a rank file, in time linear in the text.

The ids that the merges give are the one sequence of tokens in which every two neighbours are
compatible, that is, which the merges of both together would leave as they are. The encoder takes
the longest token at each place (an Aho-Corasick automaton over the vocabulary, whose bytes are
mapped to Latin-1 characters), and where a token is not compatible with the one before it, tries the
next shorter one, or steps back. Places known to lead nowhere are marked, so that each is tried once.
Compatibility of two tokens is decided by undoing their merges along the seam, and remembered.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import tokenizing

PAIR_ENTRIES = 1_000_000
WORD_ENTRIES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    """Encoder and decoder for one rank file. Every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.token = {i: b for b, i in ranks.items()}
        self._ranks = ranks
        self._pattern = regex.compile(pattern)
        self._automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self._automaton.add_word(b.decode("latin-1"), (len(b), i))
        self._automaton.make_automaton()
        self._halves: dict[int, tuple[int, int]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int] = {}
        self._words: dict[str, np.ndarray] = {}

    def _merged_from(self, i: int) -> tuple[int, int]:
        """The two tokens whose merge made token i; a single byte is its own two halves."""
        if i not in self._halves:
            b = self.token[i]
            if len(b) == 1:
                self._halves[i] = (i, i)
            else:
                parts = [b[k : k + 1] for k in range(len(b))]
                while len(parts) > 2:
                    best = min(range(len(parts) - 1), key=lambda k: (r if (r := self._ranks.get(parts[k] + parts[k + 1], i)) < i else i, k))
                    parts[best : best + 2] = [parts[best] + parts[best + 1]]
                self._halves[i] = (self._ranks[parts[0]], self._ranks[parts[1]])
        return self._halves[i]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave left and right as they are when they stand side by side."""
        key = (left, right)
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) >= PAIR_ENTRIES:
                self._pairs.clear()
            known = self._pairs[key] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        """Undo merges at the seam from the last made to the first made.

        At each point of the merging, left and right are the tokens that touch at the seam. Their
        union breaks the seam if its rank comes before the merge that next changes either of them
        (with equal ranks the merge further left comes first).
        """
        token, ranks = self.token, self._ranks
        left_next = right_next = len(ranks) + 1 << 1  # when the token at the seam is merged on, doubled; right's ties come later
        while True:
            union = ranks.get(token[left] + token[right])
            if union is not None and union * 2 < min(left_next, right_next):
                return False
            # The token that was made later is the one to undo; two equal tokens: the right one was made later.
            if left > right:
                last = self._merged_from(left)[1]
                if last != left or len(token[left]) > 1:
                    left_next, left = left * 2, last
                    continue
            elif len(token[right]) > 1:
                right_next, right = right * 2 + 1, self._merged_from(right)[0]
                continue
            if len(token[left]) > 1:
                left_next, left = left * 2, self._merged_from(left)[1]
            elif len(token[right]) > 1:
                right_next, right = right * 2 + 1, self._merged_from(right)[0]
            else:
                return True

    def _next_shorter(self, i: int) -> int:
        """The longest token that is a proper prefix of token i, or -1."""
        if i not in self._shorter:
            b = self.token[i]
            self._shorter[i] = next((self._ranks[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self._ranks), -1)
        return self._shorter[i]

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if (whole := self._ranks.get(word)) is not None and self._is_own(whole):
            return [whole]
        n, longest = len(word), {}
        for end, (width, i) in self._automaton.iter(word.decode("latin-1")):
            at = end - width + 1
            if at not in longest or len(self.token[longest[at]]) < width:
                longest[at] = i
        out: list[int] = []
        dead = bytearray(n + 1)
        at, i = 0, longest[0]
        while at < n:
            end = at + len(self.token[i])
            if not dead[end] and (not out or self._compatible(out[-1], i)):
                out.append(i)
                at, i = end, longest.get(end, -1)
                continue
            i = self._next_shorter(i)
            while i < 0:  # nothing fits here: give up this place and shorten the token before it
                dead[at] = 1
                i = out.pop()
                at -= len(self.token[i])
                i = self._next_shorter(i)
        return out

    def _is_own(self, i: int) -> bool:
        """Whether the merges of a token's own bytes give the token."""
        if len(self.token[i]) == 1:
            return True
        a, b = self._merged_from(i)
        return self.token[a] + self.token[b] == self.token[i]

    def encode_chunks(self, chunks: list) -> Iterator[tokenizing.Batch]:
        """Ids of chunks as tokenizing.spaced_chunks gives them."""
        out = []
        for c in chunks:
            parts = []
            for word in self._pattern.findall(f" {c}" if type(c) is str else c[0]):
                if (ids := self._words.get(word)) is None:
                    if len(self._words) >= WORD_ENTRIES:
                        self._words.clear()
                    ids = self._words[word] = np.array(self.encode_word(word.encode()), np.uint32)
                parts.append(ids)
            out.append(parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32))
        yield tokenizing.batch(list(range(len(out))), out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids."""
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_BPES: dict[tuple[str, str], Bpe] = {}


def _bpe(path: str, pattern: str) -> Bpe:
    if (path, pattern) not in _BPES:
        _BPES[path, pattern] = Bpe(read_ranks(path), pattern)
    return _BPES[path, pattern]


def encode_texts(texts: list[str], path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts, one after another, and where each begins."""
    memo = tokenizing.memo(("bpe", path, pattern), lambda: _bpe(path, pattern).encode_chunks, tokenizing.alone)
    return memo.ids([tokenizing.spaced_chunks(t) for t in texts])


def digest(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, sha256 of its ids as little-endian 32-bit integers and of the bytes they decode to.

    Null and empty texts have no ids. Rows with equal keys are kept. Any text length is encoded
    whole. A map over rows: no shuffle, and nothing is kept but the bounded memos.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for batch in batches:
            for ks, texts in tokenizing.slices(batch.column(0), batch.column(1)):
                ids, at = encode_texts(texts, path, pattern)
                own = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ks, pa.int64()),
                        pa.array(np.diff(at)),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own]),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in own]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of documents with the public byte-level ranks."""
    import public_tokenizers as tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
