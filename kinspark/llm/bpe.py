"""Byte-pair encoding by a priority queue over a doubly linked symbol list.

The vocabulary, the merges and the special tokens come from a tokenizer file
(the JSON format of the ``tokenizers`` library) of the kind with word ends:
texts are normalised (NFC, white space to one space, lower case), words are
found by the file's pattern, and every word is merged on its own.  A heap holds
(rank, position) of the pairs that can merge; an entry whose pair has changed
meanwhile is stale and skipped.  Decoding concatenates vocabulary strings, with
a space between tokens as the library does for a file without a decoder.

Defined cases: a null or empty text has no tokens and decodes to the empty
text; repeated rows encode alike; an empty table gives an empty result.  Whole
texts are encoded, very long ones in segments; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kinspark.llm import text as T
from kinspark.llm.pretoken import Cache, segments

#: White space as Unicode defines it; Python's str.split takes U+001C..U+001F too.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
OWN_SPLIT = regex.compile("[\x1c-\x1f]")
WHITE_RUN = regex.compile(f"[{WHITE}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the letters
    from U+0100 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


def merge_word(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Apply merges, lowest rank first and leftmost among equals, until none applies.

    ``ranks``: by left << 20 | right; ``merged``: the symbol that each rank makes.
    """
    n = len(symbols)
    queue = []
    for i in range(n - 1):
        rank = ranks.get(symbols[i] << 20 | symbols[i + 1])
        if rank is not None:
            queue.append(rank << 32 | i)
    if not queue:
        return symbols
    heapify(queue)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while queue:
        top = heappop(queue)
        rank, i = top >> 32, top & 0xFFFFFFFF
        j = after[i]
        if j >= n or ranks.get(symbols[i] << 20 | symbols[j]) != rank:
            continue  # stale: one side has merged since
        symbols[i] = joined = merged[rank]
        symbols[j] = -1  # no pair has it: entries at j are stale from now on
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get(joined << 20 | symbols[k])
            if rank is not None:
                heappush(queue, rank << 32 | i)
        h = before[i]
        if h >= 0:
            rank = ranks.get(symbols[h] << 20 | joined)
            if rank is not None:
                heappush(queue, rank << 32 | h)
    return [s for s in symbols if s >= 0]


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.vocab[left] << 20 | self.vocab[right]] = rank
            self.merged.append(self.vocab[left + right])
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        named = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.strings: list[str | None] = [named.get(i) for i in range(max(named) + 1)]
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.end] for x in letters]
        self.words = Cache(self._word)
        self.pieces = Cache(self._piece, 200_000)

    def _word(self, word: str) -> bytes:
        """Ids (little-endian) of a normalised word."""
        *inner, last = word.encode()
        return array("I", merge_word([*map(self.inner.__getitem__, inner), self.last[last]], self.ranks, self.merged)).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a run without white space."""
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")  # no final sigma
        piece = piece.lower()
        if piece.isalpha():
            return self.words[piece]
        return b"".join([self.words[w] for w in self.pattern.findall(piece)])

    def _plain(self, text: str) -> bytes:
        pieces = text.split() if not OWN_SPLIT.search(text) else [p for p in WHITE_RUN.split(text) if p]
        found = self.pieces
        return b"".join([found[p] for p in pieces])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special_pattern is not None and self.special_pattern.search(text):
            parts = self.special_pattern.split(text)
            return b"".join([array("I", [self.special[part]]).tobytes() if k % 2 else self._plain(part) for k, part in enumerate(parts)])
        return self._plain(text)

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings of the ids, a space between them; unknown ids are left out."""
        known = self.strings
        try:
            return " ".join([known[i] for i in ids])
        except (IndexError, TypeError):
            return " ".join([known[i] for i in ids if 0 <= i < len(known) and known[i] is not None])


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One encoder for each file and Python worker."""
    return WordBpe(path)


def encode_texts(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids and of the decoded text; with ``ids`` both themselves too."""

    def compute(column: pa.Array) -> dict[str, pa.Array]:
        bpe = load(path)
        count, of_ids, of_text, kept = [], [], [], []
        for x in column.to_pylist():
            n, a, b, held = 0, hashlib.sha256(), hashlib.sha256(), ([], [])
            for part in segments(x or ""):
                raw = bpe.encode(part)
                numbers = array("I", raw).tolist()
                text = bpe.decode(numbers)
                a.update(raw)
                if text:
                    b.update((" " + text if n else text).encode())
                n += len(numbers)
                if ids:
                    held[0].extend(numbers)
                    held[1].append(text)
            count.append(n)
            of_ids.append(a.hexdigest())
            of_text.append(b.hexdigest())
            kept.append(held)
        out = {"n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())}
        if ids:
            out |= {"ids": pa.array([k[0] for k in kept], pa.list_(pa.int64())), "decoded": pa.array([" ".join(filter(None, k[1])) for k in kept], pa.string())}
        return out

    return T.map_texts(docs, ["doc_id"], compute, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, decoded string" * ids, small=True)
