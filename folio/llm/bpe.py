"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over four bytes marks places in the text that depend on the content alone, so that passages which several documents share
are cut alike; cuts fall anywhere between two ASCII characters, also within words. The whole words of a chunk are encoded once and kept;
a chunk that was seen before gives their ids at once. Then the joins are repaired:

* The word that a cut runs through is encoded anew, from white space to white space. No token crosses white space, so there both chunks
  agree with the encoding of the whole text.
* A word longer than LONG characters (a text without white space is one) is not taken as a whole. Its parts between cuts are encoded by
  themselves, and at each join a window of the last and first tokens is encoded anew, and doubled, until both of its ends agree: a
  sequence of tokens is the encoding of its text if and only if every two neighbours, encoded together, give themselves again. Where
  the pre-tokenizer cuts pieces is settled first, from the last three characters on the left to the first common place on the right.

Inside chunks that are new, words that were seen before are reused too. Chunks and words are kept by worker, in stores of bounded size: on a
cluster every worker encodes a shared passage once for itself, which costs less than shuffling all chunks.

Words of plain Latin letters, digits and punctuation are split and merged here with the vocabulary's own ranks; everything
else (combining marks, other scripts, special tokens) goes through the tokenizer or its own splitting.

Defined results: null text is empty and has no ids; repeated rows are encoded one by one; an empty table gives an empty
result. Ids are those of the whole text encoded at once, for every text.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm.arrow import TextBlock, map_blocks

#: Cut where the rolling hash has so many zero bits: chunks of about 2**CUT_BITS bytes.
CUT_BITS = 8
#: Entries that a worker's stores hold before they begin anew; bounds its memory, not the results.
CHUNK_ENTRIES, WORD_ENTRIES = 20_000, 400_000
#: Words with more bytes are joined from the parts between cuts.
LONG = 64


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Memo(dict):
    """A store of bounded size: when full, it keeps its entries as the older half, from which those still in use return."""

    def __init__(self, entries: int, make):
        super().__init__()
        self.half, self.old, self.make = entries // 2, {}, make

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


@cache
def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


_CONTROL = re.compile(rb"[\x1c-\x1f]")
_END = b"\xff"  # never part of UTF-8: stands for the end of a word
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class WordCoder:
    """Ids of single words, as the tokenizer in `path` gives them."""

    def __init__(self, path: str):
        self.path, self.merger = path, None
        self.pieces = Memo(WORD_ENTRIES, lambda piece: self.merger.encode_single_piece(piece.encode() + _END))
        self.open = Memo(CHUNK_ENTRIES, lambda piece: self.merger.encode_single_piece(piece.encode()))
        self.fits = Memo(WORD_ENTRIES, lambda pair: self.merger.encode_single_piece(self.raw[pair[0]] + self.raw[pair[1]]) == list(pair))
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        kinds = [n.get("type") for n in (said.get("normalizer") or {}).get("normalizers", [])]
        if model.get("end_of_word_suffix") == "</w>" and kinds == ["NFC", "Replace", "Lowercase"]:
            self.merger = self._merger(model["vocab"], [t["content"] for t in said["added_tokens"]])

    def _merger(self, vocab: dict[str, int], special: list[str]):
        import tiktoken

        self.to_byte = to_byte = {c: b for b, c in byte_letters().items()}
        ranks = {}
        for token, number in vocab.items():
            if token in special:
                continue
            end = token.endswith("</w>") and len(token) > 4
            ranks[bytes(to_byte[c] for c in (token[:-4] if end else token)) + _END * end] = number
        if len(ranks) != len(vocab) - sum(s in vocab for s in special):
            return None
        self.raw = {number: token for token, number in ranks.items()}
        return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __call__(self, word: str) -> list[int]:
        if self.merger is None or not _PLAIN.fullmatch(word) or "<|" in word:
            return tokenizer(self.path).encode(word, add_special_tokens=False).ids
        ids: list[int] = []
        for piece in _PIECE.findall(word.lower()):
            ids += self.pieces[piece]
        return ids

    def normal(self, text: str) -> str:
        return text.lower() if _PLAIN.fullmatch(text) else tokenizer(self.path).normalizer.normalize_str(text)

    def split(self, text: str) -> list[str]:
        """The pieces of a normalised text, as the pre-tokenizer cuts it."""
        if _PLAIN.fullmatch(text):
            return _PIECE.findall(text)
        return [bytes([self.to_byte[c] for c in piece]).decode() for piece, _ in tokenizer(self.path).pre_tokenizer.pre_tokenize_str(text)]

    def _agreed(self, left: str, right: list[str]) -> tuple[list[str], int]:
        """The pieces of `left` and what follows, up to the first place where one of `right` ends (or begins) anyway; and how many of `right` are in them."""
        many = 1
        while True:
            shown = left + "".join(right[:many])
            got = self.split(shown)
            ends = list(itertools.accumulate(map(len, got)))
            if ends and ends[-1] == len(shown):  # white space of other kinds is dropped by the split: then nothing is known of places
                place = {e: k for k, e in enumerate(itertools.accumulate(map(len, right[:many]), initial=len(left)))}
                sure = len(shown) if many >= len(right) else len(shown) - 3
                for k, e in enumerate(ends):
                    if e in place and e <= sure:
                        return got[: k + 1], place[e]
            if many >= len(right):
                return got, len(right)
            many *= 2

    def _repair(self, a: list[int], b: list[int], end: bytes = b"") -> None:
        """Appends tokens `b` (or the end of a word) to `a`; encodes a growing window over the join until both its ends agree."""
        i = j = 1
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            window = self.merger.encode_single_piece(b"".join([self.raw[t] for t in a[len(a) - i :] + b[:j]]) + end)
            before = i == len(a) or self.fits[a[-i - 1], window[0]]
            after = j == len(b) or self.fits[window[-1], b[j]]
            if before and after:
                a[len(a) - i :] = window + b[j:]
                return
            i, j = (i if before else 2 * i), (j if after else 2 * j)

    def spanning(self, parts: list[str]) -> list[int]:
        """Ids of one long word from its parts between cuts."""
        # a piece is [its beginning, its last characters (4 at least if it is long), the tokens of a long one's beginning and last characters]
        done: list[list] = []
        for part in parts:
            right = self.split(self.normal(part))
            k, seen = len(done), 0
            while k and seen < 3:
                k -= 1
                seen += len(done[k][1]) + 4 * (done[k][2] is not None)
            left = "".join([d[1] for d in done[k:]])
            got, used = self._agreed(left, right)
            kept = None
            if k < len(done) and done[k][2] is not None:  # a long piece begins the window; it can only grow
                kept = done[k]
                more = got[0][len(kept[1]) :]
                if more:
                    self._repair(kept[2], self.open[more])
                    kept[1] = got[0][-4:]
                got = got[1:]
            del done[k:]
            if kept:
                done.append(kept)
            done += [[None, p, None] for p in got] + [[None, p, None] for p in right[used:]]
            for d in done[k:]:
                if d[2] is None and len(d[1]) > LONG:
                    d[2], d[1] = list(self.open[d[1]]), d[1][-4:]
        ids: list[int] = []
        for _, last, tokens in done:
            if tokens is None:
                ids += self.pieces[last]
            else:
                self._repair(tokens, [], _END)
                ids += tokens
        return ids


@cache
def word_coder(path: str) -> WordCoder:
    return WordCoder(path)


def cuts(data: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Places between two ASCII bytes where the rolling hash of the four bytes before has `bits` leading zeros."""
    if len(data) < 5:
        return np.zeros(0, np.int64)
    word = np.lib.stride_tricks.sliding_window_view(data, 4)[:-1]
    h = np.ascontiguousarray(word).view("<u4").ravel() * np.uint32(2654435761)
    at = np.flatnonzero(h < np.uint32(1 << (32 - bits))) + 4
    return at[(data[at - 1] < 0x80) & (data[at] < 0x80)]


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


class ChunkCoder:
    """Encodes UTF-8 texts; keeps what chunks and words gave before."""

    def __init__(self, path: str):
        self.path, self.word = path, word_coder(path)
        self.names = self.id_names()
        self.chunks, self.words = Memo(CHUNK_ENTRIES, self._chunk), Memo(WORD_ENTRIES, self._word)
        self.fresh = 0

    def id_names(self) -> dict[int, str]:
        return {v: k for k, v in tokenizer(self.path).get_vocab(with_added_tokens=True).items()}

    def _word(self, raw: bytes) -> tuple[int, str, str]:
        ids = self.word(raw.decode())
        return len(ids), " ".join(map(str, ids)), " ".join([self.names[i] for i in ids])

    def _chunk(self, raw: bytes) -> tuple[int, str, str]:
        self.fresh += 1
        words = self.words
        parts = [p for w in raw.split() if (p := words[w])[0]]
        return sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])

    def _join(self, raw: bytes, at: list[int]) -> tuple[int, str, str]:
        """The word that cuts run through, at these places in it."""
        # special tokens and white space of other kinds inside: the tokenizer's own affair
        if len(raw) <= LONG or b"<|" in raw or self.word.merger is None or (not raw.isascii() or _CONTROL.search(raw)) and len(raw.decode().split()) > 1:
            return self.words[raw]
        ids = self.word.spanning([raw[a:b].decode() for a, b in zip([0, *at], [*at, len(raw)], strict=True)])
        return len(ids), " ".join(map(str, ids)), " ".join([self.names[i] for i in ids])

    def encode(self, data: np.ndarray, offsets: np.ndarray, bits: int = CUT_BITS) -> list[tuple[int, str, str]]:
        """For each row the number of its ids, the ids in decimal, and its tokens; the latter two joined by spaces."""
        white, at = np.flatnonzero(_WHITE[data]), cuts(data, bits)
        row = np.searchsorted(offsets, at, side="right") - 1
        # the word around each cut: from the white space (or row's edge) before to that after
        k, edge = np.searchsorted(white, at), np.concatenate([[-1], white, [len(data)]])
        begin, end = np.maximum(edge[k] + 1, offsets[row]), np.minimum(edge[k + 1], offsets[row + 1])
        through = (begin < at) & (at < end)
        at, begin, end, row = at[through], begin[through], end[through], row[through]
        new = np.flatnonzero(np.concatenate([[True], begin[1:] != begin[:-1]])) if len(begin) else np.zeros(0, np.int64)
        first = np.searchsorted(row[new], np.arange(len(offsets))).tolist()
        stop = [*new[1:].tolist(), len(at)]
        begin, end, new, at, o, raw, chunks = begin[new].tolist(), end[new].tolist(), new.tolist(), at.tolist(), offsets.tolist(), data.tobytes(), self.chunks
        out = []
        for r in range(len(o) - 1):
            pos, parts = o[r], []
            for w in range(first[r], first[r + 1]):
                parts.append(chunks[raw[pos : begin[w]]])
                parts.append(self._join(raw[begin[w] : end[w]], [c - begin[w] for c in at[new[w] : stop[w]]]))
                pos = end[w]
            parts = [p for p in (*parts, chunks[raw[pos : o[r + 1]]]) if p[0]]
            out.append((sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])))
        return out


@cache
def coder(path: str) -> ChunkCoder:
    return ChunkCoder(path)


def encode(text: str, path: str) -> list[int]:
    raw = np.frombuffer(text.encode(), np.uint8)
    said = coder(path).encode(raw, np.array([0, len(raw)], np.int64))[0][1]
    return [int(x) for x in said.split()]


def decode(ids: list[int], path: str) -> str:
    """The tokenizer's own decoding, special tokens included. Vocabularies without a decoder join tokens by spaces."""
    t = tokenizer(path)
    if t.decoder is None:
        names = coder(path).names
        return " ".join([names[i] for i in ids if i in names])
    return t.decode(ids, skip_special_tokens=False)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digested(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of its ids (decimal, joined by a space) and of what they decode to; no shuffle."""

    def work(found: Iterator[TextBlock]) -> Iterator[dict]:
        coding, plain = coder(path), tokenizer(path).decoder is None
        for block in found:
            done = coding.encode(block.data, block.offsets)
            back = [d[2] for d in done] if plain else [decode([int(x) for x in d[1].split()], path) for d in done]
            yield {
                "doc_id": block.rows.column(1), "n_tokens": [d[0] for d in done],
                "ids_sha256": [hashlib.sha256(d[1].encode()).hexdigest() for d in done],
                "decoded_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in back],
            }

    return map_blocks(docs, key, text, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work, _SCHEMA)


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def token_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the array of ids of every row."""

    def work(found: Iterator[TextBlock]) -> Iterator[dict]:
        for block in found:
            yield {"doc_id": block.rows.column(1), "ids": [[int(x) for x in d[1].split()] for d in coder(path).encode(block.data, block.offsets)]}

    return map_blocks(docs, key, text, "doc_id long, ids array<int>", work, _IDS)
