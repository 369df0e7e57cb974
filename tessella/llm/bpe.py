"""Byte-level BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over the characters cuts every text into chunks whose limits depend on nearby
characters only, so that documents which share a passage share its chunks. A worker encodes
each chunk once and keeps the result in a bounded cache. A chunk that is encoded alone can be
wrong at its two ends, as a piece of the pre-tokenizer may run across the cut; the last piece
before a cut and the text after it are therefore encoded again until a piece ends where one
ends in the chunk's own encoding. From there on both encodings are the same, because a piece
depends only on the text from its start to one character past its end.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from functools import cache, cached_property

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bound_batches

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pieces for an engine that would go back otherwise: runs give nothing back, and blanks at the end go at once.
FAST_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: A blank between letters: a piece starts there.
_BETWEEN = regex.compile(r"(?r)(?<=\p{L}) (?=\p{L})")
#: Chunks: a cut where the rolling hash has CUT_BITS zero bits, at least MIN_CHUNK and at most MAX_CHUNK characters after the last.
WINDOW, CUT_BITS, MIN_CHUNK, MAX_CHUNK = 16, 10, 256, 8192
#: Characters of chunks whose encodings a worker keeps.
CACHE_CHARS = 8 << 20
#: Characters that are hashed at one time.
_BLOCK = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character; this maps them back."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """The encoder of a tokenizer file, equal to the tokenizers library on every text.

    The file must be byte-level BPE with the usual pattern, and its ids must follow the order of
    its merges; then an id is a merge's rank. Anything else raises ValueError.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, model = byte_alphabet(), spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path} is not plain byte-level BPE")
        if any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} has added tokens that take in blanks or stand alone")
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.table = {i: bytes(alphabet[c] for c in t) for t, i in model["vocab"].items() if t not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"]["".join(m)] for m in merges]
        if order != sorted(set(order)):
            raise ValueError(f"the ids of {path} don't follow its merges")
        # an encoding without special tokens looks for the empty string at every byte of a text; these are looked for and never taken
        unused = added or {"<|unused|>": max(self.table) + 1}
        self.ranks = tiktoken.Encoding("file", pat_str=FAST_PATTERN, mergeable_ranks={b: i for i, b in self.table.items()}, special_tokens=unused)
        self.table |= {i: t.encode() for t, i in added.items()}
        self.path = path
        # the longest of those that begin at one place, as the library takes them
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.added = added
        self.piece = regex.compile(PATTERN)

    @cached_property
    def library(self) -> Tokenizer:
        """The library's own encoder, to compare with; workers don't load it."""
        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def __reduce__(self):
        raise TypeError("open the file in each worker")

    def plain(self, text: str) -> np.ndarray:
        """The ids of a text without special tokens."""
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False) if text else np.empty(0, np.uint32)

    def segments(self, text: str):
        """The text as runs without special tokens (str) and ids of special tokens (int)."""
        at = 0
        for m in self.special.finditer(text) if any(t in text for t in self.added) else ():
            if m.start() > at:
                yield text[at : m.start()]
            yield self.added[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:]

    def decode(self, ids: np.ndarray) -> str:
        """The library's decode(ids, skip_special_tokens=False)."""
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


@cache
def open_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


def cuts(text: str) -> list[int]:
    """Where content-defined chunks of a text end; the last is its length."""
    out, at, n = [], 0, len(text)
    if n <= MIN_CHUNK:
        return [n] if n else []
    for base in range(0, n, _BLOCK):
        # the window's first characters come from the block before, so that a block's limit is of no account
        low = max(0, base - WINDOW + 1)
        x = np.frombuffer(text[low : base + _BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        k = 1
        while k < WINDOW:
            y = x.copy()
            y[k:] += x[:-k] * np.uint32(2 * k + 0x1CE4E5B9)
            y ^= y >> np.uint32(13)
            x, k = y, 2 * k
        hit = np.flatnonzero((x * np.uint32(0x133111EB)) >> np.uint32(32 - CUT_BITS) == 0) + low + 1
        for h in hit[hit > base].tolist():
            if h - at >= MIN_CHUNK:
                while h - at > MAX_CHUNK:
                    at += MAX_CHUNK
                    out.append(at)
                if h - at >= MIN_CHUNK:
                    out.append(h)
                    at = h
    while n - at > MAX_CHUNK:
        at += MAX_CHUNK
        out.append(at)
    if at < n:
        out.append(n)
    return out


class ChunkEncoder:
    """Encodes whole texts chunk by chunk; a chunk that was met before is not encoded again."""

    def __init__(self, bpe: ByteBPE, cache_chars: int = CACHE_CHARS):
        self.bpe, self.limit, self.held = bpe, cache_chars, 0
        self.known: OrderedDict[str, list] = OrderedDict()
        self.hits = self.misses = 0

    def chunk(self, text: str) -> list:
        """A chunk's ids, and the start of its last piece once that was asked for."""
        got = self.known.get(text)
        if got is not None:
            self.hits += 1
            self.known.move_to_end(text)
            return got
        self.misses += 1
        got = self.known[text] = [self.bpe.plain(text), None]
        self.held += len(text)
        while self.held > self.limit and len(self.known) > 1:
            self.held -= len(self.known.popitem(last=False)[0])
        return got

    def last_piece(self, text: str) -> int:
        """Where the last piece starts: scan from the last place where a piece certainly starts."""
        m = _BETWEEN.search(text)
        start = m.start() if m else 0
        for p in self.bpe.piece.finditer(text, start):
            start = p.start()
        return start

    def run(self, text: str) -> np.ndarray:
        """The ids of a run without special tokens."""
        ends = cuts(text)
        if len(ends) == 1:
            return self.chunk(text)[0]
        parts, at, tail, sure = [], 0, None, 0
        # tail: the ids of what follows it are still to come; sure: no piece ends between tail and it
        for end in ends:
            if tail is None or end > sure:
                known = self.chunk(text[at:end])
                ids, over, fresh = known[0], 0, []
                if tail is not None:
                    over, fresh, sure = self.repair(text, tail, at, end)
                if over is not None:
                    parts += fresh
                    if end == len(text):
                        parts.append(ids[over:])
                        tail = end
                        break
                    if known[1] is None:
                        known[1] = self.last_piece(text[at:end])
                    parts.append(ids[over : len(ids) - len(self.bpe.plain(text[at + known[1] : end]))])
                    tail = at + known[1]
            at = end
        parts.append(self.bpe.plain(text[tail:]))
        return np.concatenate(parts)

    def repair(self, text: str, tail: int, at: int, end: int) -> tuple[int | None, list[np.ndarray], int]:
        """Split again from ``tail``, across the cut at ``at``, until a piece ends where one ends in the chunk at:end.

        Returns how many of the chunk's own ids lie before that place, the ids from ``tail`` up to
        it, and 0. Without such a place it returns None, nothing and the end of the piece that runs
        out of the chunk: then the whole chunk has to be encoded again with what follows. Pieces
        are encoded one by one, as two pieces of blanks that stand alone would be taken for one.
        """
        own, mine, over, fresh = self.bpe.piece.finditer(text, at, end), at, 0, []
        for p in self.bpe.piece.finditer(text, tail):
            if p.end() >= end:
                return None, [], p.end()
            fresh.append(self.bpe.plain(p[0]))
            while mine < p.end():
                piece = next(own)
                mine, over = piece.end(), over + len(self.bpe.plain(piece[0]))
            if mine == p.end():
                return over, fresh, 0
        raise AssertionError("pieces cover the text")

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text, as the tokenizers library gives them."""
        parts = [np.array([s], np.uint32) if isinstance(s, int) else self.run(s) for s in self.bpe.segments(text or "")]
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


@cache
def worker_encoder(path: str) -> ChunkEncoder:
    """One per worker process, so that chunks are reused from batch to batch and task to task."""
    return ChunkEncoder(open_bpe(path))


def with_token_ids(df: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``df`` with an array<int> column of each whole text's ids; a null text has none.

    ``path`` is a tokenizer file that every worker can open. Empty texts have an empty array;
    other columns and repeated rows pass unchanged. A column named ``out`` is replaced.
    """
    bound_batches(df.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(texts):
        encoder = worker_encoder(path)
        return texts.map(lambda t: encoder.encode(t).astype(np.int32))

    return df.withColumn(out, ids(F.col(text)))


def with_decoded(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of each row's ids, special tokens included; null ids decode to ''."""
    bound_batches(df.sparkSession)

    @F.pandas_udf("string")
    def decoded(rows):
        bpe = open_bpe(path)
        return rows.map(lambda r: "" if r is None else bpe.decode(np.asarray(r)))

    return df.withColumn(out, decoded(F.col(ids)))
