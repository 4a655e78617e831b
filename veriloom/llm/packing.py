"""Vector bin packing of documents into token sequences.

An item asks for three things at once: tokens, segments and loss-bearing tokens. The dot-product heuristic puts into the
open sequence the item whose demand points most in the direction of what is still free. Texts may be cut, so what no
longer fits whole fills the rest of a sequence, and a sequence that can't be filled is closed at a power of two, where
it needs no padding; what is cut off returns to the pool. Each task packs the documents that it reads, so nothing is
shuffled, and a lost task packs the same sequences again.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.base import in_arrow

LENGTH = 1024
SEGMENTS = 256
POOL = 256
END = 0


@dataclass
class Piece:
    """Part of a document's ids; the document's first ``prompt`` ids bear no loss."""

    doc_id: int | None
    ids: np.ndarray
    start: int
    total: int
    prompt: int = 0

    @property
    def silent(self) -> int:
        """Leading ids without loss: nothing predicts the first id of a segment."""
        return max(1, self.prompt - self.start)

    @property
    def demand(self) -> tuple[int, int, int]:
        """Tokens, segments, loss-bearing tokens."""
        return len(self.ids), 1, max(0, len(self.ids) - self.silent)

    def room(self, free: np.ndarray) -> int:
        """How many of its ids keep within what is free."""
        return int(min(free[0], free[2] + self.silent))

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.ids[:n], self.start, self.total, self.prompt), Piece(self.doc_id, self.ids[n:], self.start + n, self.total, self.prompt)


class Packer:
    """Fills one sequence after another from a pool of bounded size."""

    def __init__(self, limits: tuple[int, int, int]) -> None:
        self.limits = np.array(limits, float)
        self.pool: list[Piece] = []

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Whole sequences go out at once; the remainder waits in the pool."""
        while len(piece.ids) >= (full := piece.room(self.limits)):
            one, piece = piece.split(full)
            yield from self.closed([one])
        if len(piece.ids):
            self.pool.append(piece)
            if len(self.pool) >= POOL:
                yield from self.fill()

    def fill(self) -> Iterator[list[Piece]]:
        pool, self.pool = self.pool, []
        need = np.array([p.demand for p in pool], float)
        alive = np.ones(len(pool), bool)
        free = self.limits.copy()
        out: list[Piece] = []
        while alive.any() and free[0] > 0 and free[1] > 0:
            score = (need / self.limits) @ (free / self.limits)
            fits = alive & (need <= free).all(axis=1)
            if free[1] >= 2 and fits.any():
                i = int(np.where(fits, score, -1).argmax())
            else:  # the last segment, or nothing fits whole: the largest is cut to what is free
                i = int(np.where(alive, need[:, 0], -1).argmax())
            piece = pool[i]
            room = piece.room(free)
            if len(piece.ids) > room:
                piece, rest = piece.split(room)
                pool[i], need[i] = rest, rest.demand
            else:
                alive[i] = False
            out.append(piece)
            free -= piece.demand
        self.pool = [p for p, a in zip(pool, alive) if a]
        yield from self.closed(out)

    def closed(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        n = sum(len(p.ids) for p in pieces)
        surplus = n - (1 << n.bit_length() - 1) if n < self.limits[0] else 0
        while surplus:
            last = pieces.pop()
            if len(last.ids) > surplus:
                kept, last = last.split(len(last.ids) - surplus)
                pieces.append(kept)
            self.pool.append(last)
            surplus -= len(last.ids)
        yield pieces

    def rest(self) -> Iterator[list[Piece]]:
        while self.pool:
            yield from self.fill()


#: White space by Unicode, as the vocabulary's pre-tokenizer sees it. Of its tokens none goes on from other signs to
#: white space, so a text may be encoded in parts that begin there.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_LONG = re.compile(f"(?<![{_WHITE}])[{_WHITE}]{{1000,}}[^{_WHITE}]*|(?<![^{_WHITE}])[^{_WHITE}]{{1000,}}")
_EDGE = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
PART = 1 << 20


class Encoder:
    """Ids of whole texts, as ``tokenizers`` gives them with the vocabulary at ``path``.

    Ordinary words are encoded by ``tiktoken`` from the same vocabulary, a third of the work; a word or a run of white
    space of 1,000 signs or more, on which it backtracks, goes to ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        added = read["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(f"[{_WHITE}]", t["content"]) for t in added):
            raise ValueError("added tokens must be words")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = dict(zip(map(chr, plain), plain)) | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in read["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.path = path

    @functools.cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _part(self, text: str) -> Iterator[np.ndarray]:
        at = 0
        for m in _LONG.finditer(text):
            begin = m.start()
            while begin > at and text[begin - 1] in _WHITE:  # the white space before a word goes with it
                begin -= 1
            if begin > at:
                yield self.fast.encode_to_numpy(text[at:begin], allowed_special="all")
            yield np.array(self.tokenizer.encode(text[begin : m.end()], add_special_tokens=False).ids, "<u4")
            at = m.end()
        if at < len(text):
            yield self.fast.encode_to_numpy(text[at:], allowed_special="all")

    def encode(self, text: str) -> np.ndarray:
        parts, at = [np.zeros(0, "<u4")], 0
        while len(text) - at > PART:
            edge = _EDGE.search(text, at + PART)
            if not edge:
                break
            parts += self._part(text[at : edge.start()])
            at = edge.start()
        parts += self._part(text[at:])
        return np.concatenate(parts)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long"


def _pack(path: str, limits: tuple[int, int, int], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        packer = Packer(limits)
        sequence = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def put(done: Iterator[list[Piece]]) -> None:
            nonlocal sequence
            for pieces in done:
                at = 0
                n = sum(len(p.ids) for p in pieces)
                padded = n if n & (n - 1) == 0 else limits[0]
                for p in pieces:
                    raw = p.ids.tobytes()
                    rows.append((p.doc_id, p.start, len(p.ids), zlib.crc32(raw), p.total, sequence, at, padded, *((raw,) if with_ids else ())))
                    at += len(p.ids)
                sequence += 1

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * (8 + with_ids)
            rows.clear()
            kinds = [pa.int64()] * 8 + [pa.binary()] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [*COLUMNS.replace(" long", "").split(", "), *["ids"] * with_ids])

        for batch in batches:
            ids, texts, prompts = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            for i, doc in enumerate(ids):
                got = np.append(encoder.encode(texts[i].as_py() or ""), np.array([END], "<u4"))
                put(packer.add(Piece(doc, got, 0, len(got), prompts[i] or 0)))
                if len(rows) > 20_000:
                    yield batch_of()
        put(packer.rest())
        yield batch_of()

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, segments: int = SEGMENTS, loss_tokens: int = LENGTH, with_ids: bool = False, prompt: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    padded_to`` and, on request, ``ids`` (little-endian unsigned 32-bit).

    A document is its ids and a closing id 0; a null text counts as empty, so it is the closing id alone. No sequence
    holds more than ``length`` ids, ``segments`` pieces or ``loss_tokens`` loss-bearing ids, and each is full or a power
    of two long, so nothing is padded under the default limits. A piece's first id bears no loss, nor do a document's
    first ids, as many as the column ``prompt`` says (of instructions; null or no such column: none). Repeated rows and
    null ids are packed like any other; an empty table gives no rows; extra columns are ignored. ``path`` names the file
    of a byte-level vocabulary; the strings of its added tokens get their ids wherever they stand.
    """
    if min(length, segments) < 1 or loss_tokens < 0:
        raise ValueError("limits must leave room for one id")
    silent = F.col(f"`{prompt}`") if prompt else F.lit(None)
    docs = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"), silent.cast("long").alias("prompt"))
    return docs.transform(in_arrow, _pack(path or vocabulary(), (length, segments, loss_tokens), with_ids), COLUMNS + ", ids binary" * with_ids)
