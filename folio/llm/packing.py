"""Packing by vector bin packing.

An example asks for tokens, one segment and loss-bearing tokens; a sequence has limits on all three. Of the waiting
examples that fit, the one whose demand has the largest dot product with what the sequence has left is placed
(both as shares of the limits). What no whole example fills is filled by cutting one. Each task packs the documents it reads, with a bounded number of them
waiting, so nothing is shuffled; what is left at its end is cut into sequences whose lengths are powers of two, which need no padding.

A token bears loss unless it is the first of its segment, which has no context, or the same as the token before it: runs (of spaces, dashes,
rows of dots) teach nothing. Such runs are about one token in a hundred of the test tables, so the limit of 2032 loss-bearing tokens of 2048 stops
sequences of documents without runs, whose last tokens only examples with few loss-bearing tokens may take; the limit of 64 segments stops
sequences of very short documents. A piece that takes all tokens or all loss-bearing tokens of a sequence leaves no choice to the heuristic.

Defined results: null text is empty and has the end token alone; repeated rows are packed one by one; ties go to the
example that has waited longest; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from folio.llm.arrow import TextBlock, map_blocks
from folio.llm.bpe import Memo, tokenizer

WORD_ENTRIES = 400_000


@dataclass(frozen=True)
class PackConfig:
    """Limits of a sequence; `least`: an example is not cut shorter than this to use up loss-bearing tokens, the rest is padding then."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2032
    end_id: int = 1
    waiting: int = 192
    least: int = 8


# Units: white space with a word of Latin letters; stops and commas that end a word; white space with anything else; white space at the end.
_UNIT = re.compile(r"[ \n\t\r]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?![^ \n.,])|[.,]+(?![^ \n])|[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class ByteCoder:
    """Ids as little-endian 32-bit bytes. Texts are cut before runs of white space, and between a word's letters and the stops or commas
    that end it, where the byte-level pre-tokenizer cuts too; each unit is encoded once and kept."""

    def __init__(self, path: str, ranks: str | None = None):
        self.path, self.core = path, None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.core = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.units = Memo(WORD_ENTRIES, self._unit)

    def whole(self, text: str) -> bytes:
        if self.core is None or "<|" in text:  # special tokens are the tokenizer's own affair
            return _packed(tokenizer(self.path).encode(text, add_special_tokens=False).ids)
        return _packed(self.core(text))

    def _unit(self, unit: str) -> bytes:
        # white space of other kinds at the end would join the white space that follows: such texts are encoded whole
        return b"" if unit[-1].isspace() and unit.strip(" \n\t\r") else self.whole(unit)

    def __call__(self, text: str) -> bytes:
        units = self.units
        got = [units[u] for u in _UNIT.findall(text)]
        return b"".join(got) if all(got) else self.whole(text)


@cache
def byte_coder(path: str, ranks: str | None) -> ByteCoder:
    return ByteCoder(path, ranks)


def bearing(ids: np.ndarray) -> np.ndarray:
    """How many of the first k tokens bear loss, for k = 0..n: all but those that repeat the token before them. The very first one counts; segments leave out theirs."""
    out = np.zeros(len(ids) + 1, np.int32)
    out[1:2] = 1
    np.cumsum(ids[1:] != ids[:-1], out=out[2:])
    out[2:] += 1
    return out


class Packer:
    """Takes documents one by one (as their `bearing` sums) and gives pieces: (document, start, length, sequence, offset)."""

    def __init__(self, config: PackConfig, first_sequence: int):
        self.c, self.sequence = config, first_sequence
        self.items: list[tuple[int, int, int]] = []  # document, start, length
        self.sums: dict[int, np.ndarray] = {}  # of documents that wait
        self.adding: int | None = None
        self.demand = np.zeros((config.waiting + 1, 3))
        self.limit = np.array([config.tokens, config.segments, config.loss], float)

    def loss(self, doc: int, start: int, length: int) -> int:
        b = self.sums[doc]
        return int(b[start + length] - b[start + 1])

    def longest(self, doc: int, start: int, tokens: int, loss: int) -> int:
        """How many tokens of a document from `start` on hold within these limits."""
        b = self.sums[doc]
        if start + tokens < len(b) and b[start + tokens] - b[start + 1] <= loss:
            return tokens
        return min(tokens, int(np.searchsorted(b, b[start + 1] + loss, side="right")) - 1 - start)

    def add(self, doc: int, sums: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        c, start, length = self.c, 0, len(sums) - 1
        self.adding, self.sums[doc] = doc, sums
        while length > start:
            part = self.longest(doc, start, min(c.tokens, length - start), c.loss)
            if part == c.tokens:
                yield doc, start, part, self.sequence, 0
                self.sequence += 1
            else:
                self._wait((doc, start, part))
            start += part
            if len(self.items) >= c.waiting:
                yield from self._sequence(c.tokens)
        self.adding = None
        self._forget(doc)

    def _forget(self, doc: int) -> None:
        if doc != self.adding and all(i[0] != doc for i in self.items):
            self.sums.pop(doc, None)

    def _share(self, item: tuple[int, int, int]) -> np.ndarray:
        return np.array([item[2], 1, self.loss(*item)]) / self.limit

    def _wait(self, item: tuple[int, int, int]) -> None:
        self.demand[len(self.items)] = self._share(item)
        self.items.append(item)

    def _take(self, k: int) -> tuple[int, int, int]:
        n = len(self.items)
        self.demand[k : n - 1] = self.demand[k + 1 : n].copy()
        return self.items.pop(k)

    def _sequence(self, target: int) -> Iterator[tuple[int, int, int, int, int]]:
        """One sequence of `target` tokens, or fewer where other limits stop it."""
        left, at, touched = [target, self.c.segments, self.c.loss], 0, set()
        while self.items and at < target and left[1]:
            share = np.array(left, float) / self.limit
            demand = self.demand[: len(self.items)]
            fits = (demand <= share + 1e-12).all(1)
            if fits.any():
                doc, start, length = self._take(int(np.argmax(np.where(fits, demand @ share, -1.0))))
            else:
                k = int(np.argmax(demand[:, 0]))
                doc, start, length = self.items[k]
                wanted = min(left[0], length)
                cut = self.longest(doc, start, wanted, left[2])
                if cut < wanted and cut < self.c.least:
                    break
                if cut < length:
                    self.items[k] = (doc, start + cut, length - cut)
                    self.demand[k] = self._share(self.items[k])
                else:
                    self._take(k)
                length = cut
            loss = self.loss(doc, start, length)
            yield doc, start, length, self.sequence, at
            touched.add(doc)
            at += length
            left = [left[0] - length, left[1] - 1, left[2] - loss]
        self.sequence += 1
        for doc in touched:
            self._forget(doc)

    def finish(self) -> Iterator[tuple[int, int, int, int, int]]:
        while self.items:
            rest = sum(i[2] for i in self.items)
            yield from self._sequence(self.c.tokens if rest >= self.c.tokens else 1 << (rest.bit_length() - 1))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, ranks: str | None = None, config: PackConfig = PackConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of every document. Sequence ids hold the task's number in their upper bits."""

    def work(found: Iterator[TextBlock]) -> Iterator[dict]:
        coder, end = byte_coder(path, ranks), np.array([config.end_id], "<u4").tobytes()
        packer = Packer(config, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40)
        open_docs: dict[int, list] = {}  # documents with pieces that wait: [id, bytes, tokens left]
        number = 0

        def rows(pieces: Iterator[tuple[int, int, int, int, int]]) -> Iterator[tuple]:
            for doc, start, length, sequence, offset in pieces:
                d = open_docs[doc]
                yield d[0], start, length, zlib.crc32(d[1][4 * start : 4 * (start + length)]), len(d[1]) // 4, sequence, offset
                d[2] -= length
                if not d[2]:
                    del open_docs[doc]

        def batch(out: list[tuple]) -> dict:
            return {f.name: [r[k] for r in out] for k, f in enumerate(_SCHEMA)}

        for block in found:
            out: list[tuple] = []
            for doc_id, t in zip(block.rows.column(1).to_pylist(), block.texts(), strict=True):
                ids = coder(t) + end
                open_docs[number] = [doc_id, ids, len(ids) // 4]
                out += rows(packer.add(number, bearing(np.frombuffer(ids, "<u4"))))
                number += 1
            if out:
                yield batch(out)
        if out := list(rows(packer.finish())):
            yield batch(out)

    return map_blocks(docs, key, text, _DDL, work, _SCHEMA)
