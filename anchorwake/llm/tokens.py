"""Token counts by byte-pair merging, without building the tokens.

A text is cut into special strings and pretokens as the tokenizer file says. Each
pretoken is a linked list of byte symbols; a heap gives the adjacent pair with the
lowest merge rank, leftmost first, until no pair has a rank. Its count is the number of
its bytes less the number of merges; no identifier is looked up. Pretokens repeat, so
their counts are kept in a table of bounded size.

Defined results: null and empty texts have 0 bytes and 0 tokens; every row of the input
gives one row, repeated rows too; an empty table gives an empty result; other columns of
the input are not read, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pretokens of byte-level BPE (fixed value of the public tokenizer's format).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pretokens of longer texts (characters) are counted in parts, so that memory stays bounded.
_LONG = 1 << 20


def _byte_names() -> list[str]:
    """The character by which tokenizer files name each byte: itself if printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    names, spare = [], 256
    for b in range(256):
        names.append(chr(b if b in plain else spare))
        spare += b not in plain
    return names


class PairMerger:
    """Merge ranks of a tokenizer file and the counts that follow from them."""

    def __init__(self, path: str, kept: int = 800_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        ids: dict[str, int] = {name: i for i, name in enumerate(_byte_names())}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            made = ids.setdefault(a + b, len(ids))
            self.ranks[ids[a], ids[b]] = rank, made
        # As the library does it: special tokens are cut out as they stand in the text.
        special = sorted((x["content"] for x in spec.get("added_tokens", [])), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self._pretoken = regex.compile(PRETOKEN)
        self._kept = kept
        self._counts: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Number of symbols that remain of a pretoken."""
        n = len(piece)
        if n < 2:
            return n
        ranks = self.ranks
        symbol, left, right = list(piece), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r[0], i, r[1], piece[i], piece[i + 1]) for i in range(n - 1) if (r := ranks.get((piece[i], piece[i + 1])))]
        heapify(heap)
        count = n
        while heap:
            _, i, made, a, b = heappop(heap)
            j = right[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = made, -1
            k = right[i] = right[j]
            count -= 1
            if k < n:
                left[k] = i
                if r := ranks.get((made, symbol[k])):
                    heappush(heap, (r[0], i, r[1], made, symbol[k]))
            h = left[i]
            if h >= 0 and (r := ranks.get((symbol[h], made))):
                heappush(heap, (r[0], h, r[1], symbol[h], made))
        return count

    def count(self, text: str) -> int:
        """Number of tokens of a text."""
        if self._special is None:
            return self._plain(text)
        found, parts = 0, []
        at = 0
        for m in self._special.finditer(text):
            parts.append(text[at : m.start()])
            found, at = found + 1, m.end()
        if not found:
            return self._plain(text)
        return found + sum(map(self._plain, [*parts, text[at:]]))

    def _plain(self, text: str) -> int:
        if len(text) <= _LONG:
            return self._total(self._pretoken.findall(text))
        found, pieces = 0, (m.group() for m in self._pretoken.finditer(text))
        while part := list(islice(pieces, _LONG)):
            found += self._total(part)
        return found

    def _total(self, pieces: list[str]) -> int:
        counts = self._counts
        try:
            return sum(map(counts.__getitem__, pieces))
        except KeyError:
            for piece in set(pieces).difference(counts):
                counts[piece] = self.merged(piece.encode())
            total = sum(map(counts.__getitem__, pieces))
            if len(counts) > self._kept:
                counts.clear()
            return total


_mergers: dict[str, PairMerger] = {}


def _counted(path: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _mergers:
            _mergers[path] = PairMerger(path)
        count = _mergers[path].count
        for part in parts:
            texts = part.column(1)
            found = [count(x.as_py() or "") for x in texts]
            sizes = [x.as_buffer().size if x.is_valid else 0 for x in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Count the tokens of every text: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``path`` is a byte-level BPE file of the tokenizers library, at the same place on all machines.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(_counted(path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
