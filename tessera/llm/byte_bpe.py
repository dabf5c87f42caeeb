"""Byte-level BPE over Arrow batches: encoding, offsets and decoding.

The rank file becomes a model of the ``tokenizers`` library: every byte maps
to one printable character, and every way to split a vocabulary entry into two
others becomes a merge, in rank order, so a merge joins whatever pair spells
the lowest-ranked entry. Text is cut by the pattern; each distinct piece is
merged once and remembered, and a text's ids are its pieces' ids in a row.
Decoding reverses the byte table, so a character that was split over tokens
comes back from its bytes.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, frugal, in_runs, small_batches, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pieces that a worker remembers (about 250 bytes each) before it starts anew: 50 MB.
REMEMBERED = 200_000
#: Ids that are decoded at once.
CHUNK = 1 << 16


def byte_characters() -> list[str]:
    """A printable character for every byte: itself, or the next free one from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class ByteTable:
    """The bytes of every id: all that decoding needs."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        for t, r in self.ranks.items():
            self.lengths[r] = len(t)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        by_rank = dict(zip(self.ranks.values(), self.ranks.keys(), strict=True))
        self.bytes = np.frombuffer(b"".join(by_rank.get(r, b"") for r in range(size)), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids spell."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return np.zeros(0, np.uint8)
        return self.bytes[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1])]

    def decode_long(self, ids: np.ndarray) -> bytes:
        """As ``decode``, with the memory of some ids at a time; a character split between them is whole again."""
        return b"".join(self.decode(ids[lo : lo + CHUNK]).tobytes() for lo in range(0, len(ids), CHUNK))

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character range of each token; a part of a character spans that character."""
        raw = self.decode(ids)
        first = np.cumsum((raw & 0xC0) != 0x80)
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return (first[ends - n] - 1).astype(np.int32), first[ends - 1].astype(np.int32)


class ByteBPE(ByteTable):
    """Encodes and decodes by a rank file; one per worker and file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        super().__init__(path)
        ranks = self.ranks
        self.letters = {b: ord(c) for b, c in enumerate(byte_characters())}
        merges = sorted((rank, ranks[t[:i]], ranks[t[i:]], t[:i], t[i:]) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        model = tokenizers.models.BPE(vocab={self.spelled(t): r for t, r in ranks.items()}, merges=[(self.spelled(a), self.spelled(b)) for *_, a, b in merges], ignore_merges=True)
        self.tokenizer = tokenizers.Tokenizer(model)
        del self.ranks, ranks, merges, model  # the library has its own copies
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def spelled(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self.letters)

    def learn(self, pieces: list[str]) -> None:
        """Merges the distinct pieces, many to a call, and remembers their ids."""
        for lo in range(0, len(pieces), 512):
            some = pieces[lo : lo + 512]
            done = self.tokenizer.encode([self.spelled(p.encode()) for p in some], is_pretokenized=True, add_special_tokens=False)
            ids, words = np.array(done.ids, np.int32), np.array(done.word_ids, np.int64)
            ends = np.searchsorted(words, np.arange(len(some)), side="right")
            begin = 0
            for piece, end in zip(some, ends.tolist(), strict=True):
                self.known[piece] = ids[begin:end].tobytes()
                begin = end

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        return b"".join([self._run(pieces) for pieces in in_runs(self.pattern, text)])

    def _run(self, pieces: list[str]) -> bytes:
        try:
            return b"".join([self.known[p] for p in pieces])
        except KeyError:
            pass
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn([p for p in dict.fromkeys(pieces) if p not in self.known])
        return b"".join([self.known[p] for p in pieces])


@functools.cache
def loaded(path: str) -> ByteBPE:
    return ByteBPE(path)


@functools.cache
def loaded_table(path: str) -> ByteTable:
    return ByteTable(path)


def _grown(batch: pa.RecordBatch, drop: str | None = None, **new: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != drop]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new.values()], names=[*names, *new])


def _parts(batch: pa.RecordBatch, by: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of some rows, fewer where the lists or texts are long."""
    at = batch.schema.get_field_index(by)
    rows = max(1, min(1000, batch.num_rows * (1 << 20) // max(1, batch.column(at).nbytes)))
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def encode(df: DataFrame, text: str = "text", *, path: str | None = None, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """``df`` with ``ids`` (array of int) and, if asked for, ``starts``, ``ends`` and ``bytes``.

    ``starts`` and ``ends`` are the character offsets of each token; with
    ``decoded`` the text makes room for ``bytes``, what its ids spell, decoded
    in the same pass over the batch, so a core runs one worker. A null text
    counts as empty; an empty one has no ids. Texts are taken whole, one at a
    time, so a worker needs the memory of a small batch and no more. Clashing
    input columns are replaced; repeated rows stay; an empty table gives an
    empty result.
    """
    path = path or public_tokenizers.path(RANKS)
    names = ["ids", *(["starts", "ends"] if offsets else []), *(["bytes"] if decoded else [])]
    df = small_batches(df.drop(*(n for n in names if n != text)))
    ints = T.ArrayType(T.IntegerType(), False)
    left_out = text if decoded else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part in _parts(batch, text):
                ids = [np.frombuffer(bpe.encode(t.as_py() or ""), np.int32) for t in part.column(part.schema.get_field_index(text))]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
                lists = lambda values: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int32), *values]).astype(np.int32)))
                new = {"ids": lists(ids)}
                if offsets:
                    spans = [bpe.offsets(x) if len(x) else (x, x) for x in ids]
                    new |= {"starts": lists([s for s, _ in spans]), "ends": lists([e for _, e in spans])}
                if decoded:
                    new["bytes"] = pa.array([bpe.decode_long(x) for x in ids], pa.binary())
                yield _grown(part, left_out, **new)

    made = {"bytes": T.BinaryType()}
    fields = [f for f in df.schema.fields if f.name != left_out]
    return df.mapInArrow(frugal(run, lambda: loaded(path).known.clear()), T.StructType([*fields, *(T.StructField(n, made.get(n, ints), False) for n in names)]))


def decode(df: DataFrame, ids: str = "ids", *, path: str | None = None) -> DataFrame:
    """``df`` with ``bytes``, what the ids spell; null or no ids spell nothing.

    Bytes need not be whole characters when ids were cut in the middle of one.
    An input column named ``bytes`` is replaced; an empty table gives an empty
    result.
    """
    path = path or public_tokenizers.path(RANKS)
    df = small_batches(df.drop("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded_table(path)
        for batch in batches:
            for part in _parts(batch, ids):
                lists = part.column(part.schema.get_field_index(ids))
                none = np.empty(0, np.int32)
                out = [table.decode_long(x.values.to_numpy(zero_copy_only=False) if x.is_valid and len(x.values) else none) for x in lists]
                yield _grown(part, bytes=pa.array(out, pa.binary()))

    return df.mapInArrow(frugal(run), T.StructType([*df.schema.fields, T.StructField("bytes", T.BinaryType(), False)]))


def digests(df: DataFrame, *keep: str) -> DataFrame:
    """n_tokens and the SHA-256 of ids and decoded bytes."""
    return df.select(
        *[col(c) for c in keep],
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.col("bytes"), 256).alias("decoded_sha256"),
    )


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, decoded=True), "doc_id")
