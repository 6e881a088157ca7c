"""Packing token sequences with an order-preserving dynamic programme.

Documents keep the order in which their partition holds them. Their token streams are laid end to end, and windows of
at most ``size`` tokens are cut out of that stream. Cuts may fall at the end of a document (free), at the end of a
sentence (``sentence_penalty``) or between two words (``word_penalty``); a word longer than a window is cut anywhere.
A window of n tokens is padded to ``size`` unless n is a power of two. The programme minimises padding plus penalties:

    best[i] = penalty[i] + min( size - pos[i] + min over pos[j] >= pos[i] - size of (best[j] + pos[j]),
                                min over powers of two of best[at pos[i] - 2**t] )

The inner minimum over a sliding window is kept by a monotone queue, so each boundary costs O(1) amortised.
The stream is worked off in blocks of ``block`` tokens; the last two windows of a block's solution are taken up again by the next
block, so memory stays bounded for any partition. One open end remains per partition. Windows of a power of two under an eighth of ``size`` are
taken in a partition's last block only, as they would save no padding before it.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .shared import by_bytes, small_batches, with_nulls, with_plain_ids, word_hashes

PIECES = "doc_id long, no_id boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
DOC, SENTENCE, WORD_END = 0, 1, 2


def plan_cuts(pos: np.ndarray, kind: np.ndarray, size: int, penalties: tuple[float, float, float], least: int = 1) -> list[int]:
    """Indices into ``pos`` (ascending positions, pos[0] the start) of the cheapest cuts, the last boundary included.

    No gap between neighbours in ``pos`` may exceed ``size``. ``least``: the least power of two taken as a window of its own.
    """
    p, k, n = pos.tolist(), kind.tolist(), len(pos)
    best, back = [0.0] * n, [0] * n
    queue = deque([0])  # indices j with increasing best[j] + p[j]
    exact: dict[int, list[int]] = {}  # boundaries a power of two before another
    for w in (1 << t for t in range(size.bit_length()) if least <= 1 << t < size):
        before = np.searchsorted(pos, pos - w)
        for i in np.flatnonzero(pos[before] == pos - w).tolist():
            exact.setdefault(i, []).append(int(before[i]))
    for i in range(1, n):
        here = p[i]
        while p[queue[0]] < here - size:
            queue.popleft()
        j = queue[0]
        cost = size - here + best[j] + p[j]
        for q in exact.get(i, ()):
            if best[q] <= cost:
                cost, j = best[q], q
        best[i], back[i] = cost + penalties[k[i]], j
        value = best[i] + here
        while queue and best[queue[-1]] + p[queue[-1]] >= value:
            queue.pop()
        queue.append(i)
    cuts, i = [], n - 1
    while i:
        cuts.append(i)
        i = back[i]
    return cuts[::-1]


#: Fixed values of the vocabulary's pre-tokenizer: its pattern, and the mark that ends a word.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_MARK = "</w>"
_STOPS = np.isin(np.arange(256), list(b".!?"))  # bytes that end a sentence at a word's end


class WordEncoder:
    """Token ids of a text as little-endian uint32 bytes, word by word through a bounded cache.

    Text is cut only at spaces and line feeds, which the tokenizer drops itself and no token spans, so the ids equal
    those of the whole text. New words of printable Latin letters go through the same merges as byte ranks (the mark of a word's
    end is byte 0xFF, which no text holds, and joins the last byte first, as those pairs come first in the vocabulary);
    all other words go through the tokenizer itself.
    """

    def __init__(self, path: str, limit: int = 250_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(set(t) & {" ", "\n"} for t in self.special):
            raise ValueError("added tokens must not hold spaces or line feeds, as texts are encoded by word")
        self.pieces, self.plain = regex.compile(PIECE).findall, re.compile("[!-~\u00a1-\u012f\u0131-\u017f]+").fullmatch
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            body = token.removesuffix(WORD_MARK)
            ranks[bytes(byte_of[c] for c in body) + b"\xff" * (body != token)] = i
        self.ranks = None if len(ranks) < self.tokenizer.get_vocab_size(with_added_tokens=False) else tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.forget()

    def forget(self) -> None:
        """``slot``: a word's place by its hash; ``first`` and ``sizes`` index ``flat``, by place."""
        self.slot: dict[int, int] = {}
        self.flat, self.first, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, hashes: list[int], words: list[str]) -> None:
        """Add words, all in one piece, as steps for each word cost more than its merges."""
        ranks, plain, pieces = self.ranks, self.plain if self.ranks else lambda w: False, self.pieces
        found: list = [None] * len(words)
        rest = []
        for k, w in enumerate(words):
            if plain(w) and not any(t in w for t in self.special):
                low = w.lower()
                found[k] = ranks(low.encode() + b"\xff") if low.isalpha() else [i for x in pieces(low) for i in ranks(x.encode() + b"\xff")]
            else:
                rest.append(k)
        for i in range(0, len(rest), 10_000):
            part = rest[i : i + 10_000]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([words[k] for k in part], add_special_tokens=False), strict=True):
                found[k] = e.ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        self.slot.update(zip(hashes, range(len(self.slot), len(self.slot) + len(hashes)), strict=True))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: its ids, the positions after its words, and whether a sentence or line ends there."""
        raw = [t.encode() for t in texts]
        hashes, bounds, start, end, data = word_hashes(raw, lower=False, space=(32, 10), spans=True)
        unique, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.slot) + len(unique) > self.limit:
            self.forget()
        keys = unique.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.slot]
        whole = data.tobytes()
        self.learn([keys[i] for i in new], [whole[a:b].decode() for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)])
        place = np.fromiter(map(self.slot.__getitem__, keys), np.int64, len(keys))[inverse]
        sizes, ends = self.sizes[place], _STOPS[data[end - 1]] | (data[np.minimum(end, len(data) - 1)] == 10)
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.first[place] - total[:-1], sizes) + np.arange(total[-1])]
        return [(ids[total[a] : total[b]], total[a + 1 : b + 1] - total[a], ends[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def boundaries(at: np.ndarray, sentence: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries of a document of which ``at`` holds the positions after its words: ascending positions and kinds, the end id's last.

    Word ends are boundaries only where the sentence ends beside them lie over ``near`` tokens apart.
    """
    total = int(at[-1]) if len(at) else 0
    ends = at[sentence]
    if total and (not len(ends) or ends[-1] < total):
        ends = np.append(ends, total)
    step = np.diff(ends, prepend=0)
    if not step.all():
        ends, step = ends[step > 0], step[step > 0]
    pos, kind = ends, np.full(len(ends), SENTENCE, np.int8)
    if (step > near).any():
        inside = np.unique(at[(at > 0) & (at < total)])
        inside = inside[(step > near)[np.searchsorted(ends, inside)]]
        inside = np.setdiff1d(inside, ends, assume_unique=True)
        order = np.argsort(np.concatenate([pos, inside]), kind="stable")
        pos = np.concatenate([pos, inside])[order]
        kind = np.concatenate([kind, np.full(len(inside), WORD_END, np.int8)])[order]
    return np.append(pos, total + 1), np.append(kind, np.int8(DOC))


def split_gaps(pos: np.ndarray, kind: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Add word-kind boundaries where two neighbours lie more than ``most`` apart (one enormous word)."""
    if len(pos) < 2 or np.diff(pos).max() <= most:
        return pos, kind
    extra = [np.arange(a + most, b, most) for a, b in zip(pos[:-1], pos[1:], strict=True) if b - a > most]
    more = np.concatenate(extra)
    order = np.argsort(np.concatenate([pos, more]), kind="stable")
    return np.concatenate([pos, more])[order], np.concatenate([kind, np.full(len(more), WORD_END, np.int8)])[order]


class Packer:
    """The stream of one partition: documents go in, pieces of finished sequences come out."""

    def __init__(self, size: int, penalties: tuple[float, float, float], block: int, first_id: int):
        self.size, self.penalties, self.block, self.sequence = size, penalties, block, first_id
        self.docs: deque = deque()  # ((doc_id, no_id), ids, start in document of what is left, tokens in all)
        self.pos, self.kind, self.length = [], [], 0

    def add(self, doc_id: tuple, ids: bytes, pos: np.ndarray, kind: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, ids, 0, len(ids) >> 2))
        self.pos.append(pos + self.length)
        self.kind.append(kind)
        self.length += len(ids) >> 2
        return self.cut(False) if self.length >= self.block else []

    def cut(self, last: bool) -> list[tuple]:
        if not self.length:
            return []
        pos, kind = split_gaps(np.concatenate([[0], *self.pos]), np.concatenate([np.zeros(1, np.int8), *self.kind]), self.size)
        if last:  # the open end may be cut into powers of two
            tail = (self.length // self.size - 1) * self.size if self.length > self.size else 0
            more = np.setdiff1d(np.arange(max(tail, 0) + 1, self.length), pos)
            order = np.argsort(np.concatenate([pos, more]), kind="stable")
            pos = np.concatenate([pos, more])[order]
            kind = np.concatenate([kind, np.full(len(more), WORD_END, np.int8)])[order]
        cuts = [int(pos[i]) for i in plan_cuts(pos, kind, self.size, self.penalties, 1 if last else self.size // 8)]
        if not last:
            cuts = cuts[:-2] or cuts[:1]
        out, at = [], 0
        for end in cuts:
            offset = 0
            while at < end:
                doc_id, ids, start, tokens = self.docs[0]
                n = min(end - at, tokens - start)
                out.append((*doc_id, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), tokens, self.sequence, offset))
                if start + n == tokens:
                    self.docs.popleft()
                else:
                    self.docs[0] = (doc_id, ids, start + n, tokens)
                at, offset = at + n, offset + n
            self.sequence += 1
        keep = pos > at
        self.pos, self.kind, self.length = [pos[keep] - at], [kind[keep]], self.length - at
        return out


def pack_documents(
    docs: DataFrame,
    tokenizer: str | Callable[[], str],
    size: int = 4096,
    end_id: int = 2,
    sentence_penalty: float = 8.0,
    word_penalty: float = 64.0,
    block: int = 1 << 18,
) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    ``tokenizer``: path of a tokenizers file, or a function that gives it on the executor. Null and empty texts are one
    end id. Null ids stay null; repeated rows are packed each; other columns are not read. An empty table gives no rows.
    Texts may be of any length: they are encoded by words and cut freely. Strings of the tokenizer's special tokens get those tokens' ids, as
    its defaults have it. Ties between cuts of equal cost go to the first that the queue meets, the same in each run over the same partitions.
    Sequence ids carry the partition's number in their upper half, so no partition waits for another.
    """
    small_batches(docs.sparkSession)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc = encoder(tokenizer() if callable(tokenizer) else tokenizer)
        packer = Packer(size, (0.0, sentence_penalty, word_penalty), block, TaskContext.get().partitionId() << 33)
        for batch in batches:
            texts, ids, rows = [t if isinstance(t, str) else "" for t in batch["text"]], list(zip(batch["doc_id"].tolist(), batch["no_id"].tolist(), strict=True)), []
            for first, last in by_bytes(texts):
                for doc_id, (own, at, sentence) in zip(ids[first:last], enc.encode(texts[first:last]), strict=True):
                    rows += packer.add(doc_id, np.append(own, np.uint32(end_id)).astype("<u4").tobytes(), *boundaries(at, sentence, max(1, size // 16)))
            yield frame(rows)
        yield frame(packer.cut(True))

    return with_nulls(with_plain_ids(docs, "text").mapInPandas(pack, PIECES))


def frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({c: "bool" if c == "no_id" else "int64" for c in names})
