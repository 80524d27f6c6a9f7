"""Operators 5 and 7: byte-level BPE encoding, decoding and attribution of tokens.

The vocabulary is a public ``tokenizers`` file; its path (or its name in the
``public_tokenizers`` package, looked up where the work is done) is a parameter.

Encoding: the pattern of the vocabulary splits a text into pieces, and each is
merged by rank.  A long text is encoded by *tree concatenation* before anything
splits it: it is halved at any character, down to leaves, the leaves are encoded
in parallel, and at each join the text around the seam is encoded anew, in a
window that grows until both of its ends lie where the pattern ends a piece
whatever surrounds them.  Tokens outside such a window are those of the sides,
as the pattern looks back at nothing and no further ahead than those ends.

Where no such place is near, the window is one piece (a long run of letters, for
instance), and both sides have encoded their part of it.  Then tokens around the
seam are encoded anew and grown until they agree exactly with both sides: a
sequence of tokens is the encoding of a piece iff each adjacent pair is the
encoding of the pair's bytes, so a window whose outermost tokens are those of
the sides settles the join.  Either way the result is exactly that of encoding
in one go.

Null texts count as empty: no tokens, decoded to "".  Repeated rows stay, and an
empty table gives an empty one.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import OUT_BYTES

VOCABULARY = "byte_bpe_50k.json"
#: Texts of more bytes than this are encoded as a tree, down to leaves of about this size.
LEAF_BYTES = 4096
#: Tokens on each side of a seam in its first window within a piece.
WINDOW = 8
#: Characters on each side of a seam in its first window.
REACH = 32

#: Fixed value: the pattern by which byte-level BPE splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Places where PATTERN ends a piece in any surroundings: before white space, before a digit, and after letters and digits of settled
#: blocks before punctuation.  Unassigned characters count as nothing, as libraries know different versions of Unicode.
ENDS = regex.compile(
    r"(?<=[^\s\p{C}])(?=[ \t\n\r])|(?<=[^\s\p{N}\p{C}])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
    r"|(?<=[A-Za-z0-9À-ÖØ-öø-ÿА-яぁ-ゖァ-ヺ一-龥가-힣])(?=[!-/:-@\[-`{-~、。，！？：；])"
)


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the rest, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, vocabulary: str, leaf_bytes: int = LEAF_BYTES):
        with open(find(vocabulary), encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_of_char()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.core = tiktoken.Encoding("lotwise", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.added, self.leaf, self.joins = added, leaf_bytes, 0
        self.pieces = regex.compile(PATTERN)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        size = max([*ranks.values(), *added.values()]) + 1
        self.bytes_of = [b""] * size
        for b, i in ranks.items():
            self.bytes_of[i] = b
        for s, i in added.items():
            self.bytes_of[i] = s.encode()
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)

    def encode(self, text: str, pool: ThreadPoolExecutor | None = None) -> np.ndarray:
        if len(text) * 4 <= self.leaf or len(text.encode()) <= self.leaf:
            return self._leaf(text)
        parts = []
        for part in self.marks.split(text) if self.marks else [text]:
            parts.append(np.array([self.added[part]], np.int32) if part in self.added else self._tree(part, pool))
        return np.concatenate(parts)

    def _leaf(self, text: str) -> np.ndarray:
        return np.asarray(self.core.encode_to_numpy(text, allowed_special="all"), np.int32)

    def _tree(self, text: str, pool: ThreadPoolExecutor | None) -> np.ndarray:
        """A text without added tokens."""
        size = max(1, self.leaf * len(text) // max(1, len(text.encode())))
        leaves = [text]
        while max(map(len, leaves)) > size:
            leaves = [half for x in leaves for half in ((x[: len(x) // 2], x[len(x) // 2 :]) if len(x) > size else (x,))]
        run = pool.map if pool and len(leaves) > 1 else map
        done = list(zip(leaves, run(self._leaf, leaves), strict=True))
        while len(done) > 1:  # neighbours meet, level by level
            pairs = [(done[i], done[i + 1]) for i in range(0, len(done) - 1, 2)]
            self.joins += len(pairs)
            done = list(run(self._join, pairs)) + done[2 * len(pairs) :]
        return done[0][1]

    def _join(self, pair: tuple[tuple[str, np.ndarray], tuple[str, np.ndarray]]) -> tuple[str, np.ndarray]:
        """Text and tokens of two neighbours as one; each side's own end is as good as a place of ENDS."""
        (before, left), (after, right) = pair
        reach, x = REACH, 0
        while reach < len(before):
            found = [m.start() for m in ENDS.finditer(before[-reach:])]
            if found:
                x = len(before) - reach + found[-1]
                break
            reach *= 2
        reach, y = REACH, len(after)
        while reach < len(after):
            first = ENDS.search(after[:reach])
            if first:
                y = first.start()
                break
            reach *= 2
        head, tail = before[x:], after[:y]
        i, j = len(left) - self._count(left[::-1], head), self._count(right, tail)
        if len(head) + len(tail) <= self.leaf:
            seam = self._leaf(head + tail)
        elif self.whole(head) and self.whole(tail) and self.whole(head + tail):
            seam = self._meet((left[i:].tolist(), right[:j].tolist()))
        else:
            seam = [t for piece in self.pieces.findall(head + tail) for t in self.encode_piece(piece.encode())]
        return before + after, np.concatenate([left[:i], np.array(seam, np.int32), right[j:]])

    def _count(self, ids: np.ndarray, text: str) -> int:
        """How many of the first tokens have the bytes of the text; a token has a byte at least."""
        size = len(text.encode())
        return int(np.searchsorted(np.cumsum(self.lengths[ids[:size]]), size)) + 1 if size else 0

    def whole(self, text: str) -> bool:
        """Whether the pattern leaves the text in one piece."""
        found = self.pieces.match(text)
        return found is not None and found.end() == len(text)

    def encode_piece(self, piece: bytes, pool: ThreadPoolExecutor | None = None) -> list[int]:
        """One piece that the pattern does not split, as a tree if it is long."""
        leaves = [piece]
        while max(map(len, leaves)) > self.leaf:
            leaves = [half for x in leaves for half in ((x[: len(x) // 2], x[len(x) // 2 :]) if len(x) > self.leaf else (x,))]
        one = self.core._encode_single_piece
        done = list(pool.map(one, leaves)) if pool and len(leaves) > 1 else list(map(one, leaves))
        while len(done) > 1:  # neighbours meet, level by level
            pairs = [(done[i], done[i + 1]) for i in range(0, len(done) - 1, 2)]
            met = list(pool.map(self._meet, pairs)) if pool else list(map(self._meet, pairs))
            done = met + done[2 * len(pairs) :]
        return done[0]

    def _meet(self, pair: tuple[list[int], list[int]]) -> list[int]:
        left, right = pair
        if not left or not right:
            return left + right
        a, b = min(WINDOW, len(left)), min(WINDOW, len(right))
        while True:
            seam = self.core._encode_single_piece(b"".join(self.bytes_of[t] for t in left[-a:] + right[:b]))
            l_ok = a == len(left) or seam[0] == left[-a]
            r_ok = b == len(right) or seam[-1] == right[b - 1]
            if l_ok and r_ok:
                return left[:-a] + seam + right[b:]
            a = a if l_ok else min(2 * a, len(left))
            b = b if r_ok else min(2 * b, len(right))

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", errors="replace")


def find(vocabulary: str) -> str:
    """A path stays; a bare name is looked up in the package of public vocabularies, on this machine."""
    if os.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


@lru_cache(maxsize=4)
def encoder(vocabulary: str, leaf_bytes: int = LEAF_BYTES) -> Bpe:
    """Loaded once in each Python worker."""
    return Bpe(vocabulary, leaf_bytes)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, int(batch.num_rows * OUT_BYTES / max(batch.nbytes, OUT_BYTES)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def bpe_encode(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", ids: str = "token_ids", decoded: str | None = None, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """All rows and columns, with a column ``ids`` (array of int) and, if ``decoded`` names one, a column of the text decoded from them.

    Columns of those names are replaced.  Null text: no ids, decoded "".
    """
    ship(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in {ids, decoded}]
    names = [f.name for f in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{ids}` array<int>"] + [f"`{decoded}` string"] * bool(decoded))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary, leaf_bytes)
        with ThreadPoolExecutor(2) as pool:
            for batch in batches:
                for part in _slices(batch):
                    found = [bpe.encode(t or "", pool) for t in part.column(text).to_pylist()]
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                    flat = pa.array(np.concatenate([np.empty(0, np.int32), *found]), pa.int32())
                    columns = [part.column(n) for n in names] + [pa.ListArray.from_arrays(pa.array(offsets), flat)]
                    if decoded:
                        columns.append(pa.array([bpe.decode(x) for x in found], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, ids] + [decoded] * bool(decoded))

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def bpe_decode(df: DataFrame, vocabulary: str = VOCABULARY, ids: str = "token_ids", decoded: str = "text") -> DataFrame:
    """All rows and columns, with ``decoded`` (replaced if there) from the array ``ids``; null ids: null."""
    ship(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != decoded]
    names = [f.name for f in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{decoded}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            for part in _slices(batch):
                out = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(out, pa.string())], names=[*names, decoded])

    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


#: How tokens that cross a boundary are allocated.
RULES = ("start", "majority", "split")


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section, as doubles.

    starts, ends: the tokens' spans, ascending and disjoint; bounds: n + 1 ascending section bounds that cover them.
    start: a token counts where it begins; majority: where most of it lies, ties to the earlier section;
    split: in shares of its length.
    """
    n = len(bounds) - 1
    first = np.searchsorted(bounds, starts, side="right") - 1
    first = np.clip(first, 0, n - 1)
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float)
    last = np.clip(np.searchsorted(bounds, ends, side="left") - 1, first, n - 1)
    inside = first == last
    out = np.bincount(first[inside], minlength=n).astype(float)
    for s, e, i, j in zip(starts[~inside], ends[~inside], first[~inside], last[~inside], strict=True):
        cover = np.minimum(bounds[i + 1 : j + 2], e) - np.maximum(bounds[i : j + 1], s)
        if rule == "majority":
            out[i + int(np.argmax(cover))] += 1
        else:
            out[i : j + 1] += cover / (e - s)
    return out


def line_bounds(text: bytes) -> np.ndarray:
    """Sections by line: each newline ends one and belongs to it; an empty text is one empty section."""
    at = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    ends = at if len(at) and at[-1] == len(text) else np.append(at, len(text))
    return np.concatenate([[0], ends]).astype(np.int64)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text", fields: list[str] | None = None, rule: str = "start", leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """Tokens of each section of each document, the document encoded once as a whole.

    Without ``fields`` the sections are the lines of ``text``.  With ``fields`` (string columns) the document is those
    columns joined by newlines, each field with the newline after it a section.  Tokens' spans are joined to the sections'
    spans as sorted intervals, so the sections' counts of a document add up to its own; ``rule`` (see ``attribute``)
    says where a token that crosses a boundary counts.

    Returns key, section (from 0), field (null for lines), start_char, end_char, n_tokens (double), doc_tokens.
    Null or empty text: one empty section without tokens.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    used = list(fields or [text])
    schema = f"`{key}` {kind}, section int, field string, start_char long, end_char long, n_tokens double, doc_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary, leaf_bytes)
        with ThreadPoolExecutor(2) as pool:
            for batch in batches:
                for part in _slices(batch):
                    rows, section, field, start, end, count, total = [], [], [], [], [], [], []
                    for r, values in enumerate(zip(*[part.column(u + 1).to_pylist() for u in range(len(used))], strict=True)):
                        if fields:
                            whole = "\n".join(v or "" for v in values)
                            data = whole.encode()
                            sizes = [len((v or "").encode()) + 1 for v in values]
                            bounds = np.concatenate([[0], np.cumsum(sizes)])
                            bounds[-1] -= 1
                        else:
                            whole = values[0] or ""
                            data = whole.encode()
                            bounds = line_bounds(data)
                        ids = bpe.encode(whole, pool)
                        ends = np.cumsum(bpe.lengths[ids])
                        counts = attribute(ends - bpe.lengths[ids], ends, bounds, rule)
                        chars = bounds
                        if len(data) != len(whole):  # byte bounds to character bounds
                            leads = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                            chars = np.where(bounds > 0, leads[np.maximum(bounds, 1) - 1], 0)
                        n = len(counts)
                        rows.append(np.full(n, r))
                        section.append(np.arange(n))
                        field += used if fields else [None] * n
                        start.append(chars[:-1])
                        end.append(chars[1:])
                        count.append(counts)
                        total.append(np.full(n, len(ids)))
                    if not rows:
                        continue
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(np.concatenate(rows))),
                            pa.array(np.concatenate(section), pa.int32()),
                            pa.array(field, pa.string()),
                            pa.array(np.concatenate(start), pa.int64()),
                            pa.array(np.concatenate(end), pa.int64()),
                            pa.array(np.concatenate(count), pa.float64()),
                            pa.array(np.concatenate(total), pa.int64()),
                        ],
                        names=[key, "section", "field", "start_char", "end_char", "n_tokens", "doc_tokens"],
                    )

    return docs.select(F.col(f"`{key}`"), *[F.col(f"`{u}`").alias(f"_{i}") for i, u in enumerate(used)]).mapInArrow(run, schema)
