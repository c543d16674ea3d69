"""Byte-level BPE over whole texts, cut into overlapping chunks.

Chunks are split into pre-tokens in parallel. Where two neighbours' pre-tokens start at the same place, they agree from
there on, as the pattern never looks back; the texts are stitched at such places and every pre-token is then encoded by
itself. Decoding joins the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from relrank.llm.common import slices, texts

CHUNK = 32_768  # code points that a chunk adds
OVERLAP = 1_024
LOOKAHEAD = 16  # the pattern may look so far past the end of a match; it may not look back
CACHED = 1 << 16  # pre-tokens whose ids a worker remembers
IDS = "doc_id long, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@dataclass(frozen=True)
class Vocabulary:
    """The lines of a rank file and the pattern that splits texts; some MB at most, shipped with the tasks."""

    lines: bytes
    pattern: str

    @classmethod
    def load(cls, spark: SparkSession, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as file:  # a file of the installed tokenizers, read by the driver
            return cls(file.read(), pattern)

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.lines.splitlines())}


class Encoder(dict):
    """The ids of a pre-token; remembers them."""

    _made: dict[int, Encoder] = {}

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.split = regex.compile(vocabulary.pattern)
        self._encoding = tiktoken.Encoding(
            "pieces", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks(), special_tokens={}
        )

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> Encoder:
        key = hash(vocabulary)
        if key not in cls._made:
            cls._made[key] = cls(vocabulary)
        return cls._made[key]

    def __missing__(self, piece: str) -> list[int]:
        ids = self._encoding._encode_single_piece(piece.encode())
        if len(piece) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, pieces: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, pieces)))


def _id_rows(vocabulary: Vocabulary, keys: list[int | None], ids: list[list[int]]) -> pa.RecordBatch:
    ends = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=ends[1:])
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"]
    )


class Decoder:
    """The bytes and the decimal form of every id."""

    _made: dict[int, Decoder] = {}

    def __init__(self, vocabulary: Vocabulary):
        self.raw = {rank: piece for piece, rank in vocabulary.ranks().items()}
        self.decimal = {rank: str(rank) for rank in self.raw}

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> Decoder:
        key = hash(vocabulary)
        if key not in cls._made:
            cls._made[key] = cls(vocabulary)
        return cls._made[key]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


def _digest_rows(vocabulary: Vocabulary, keys: list[int | None], ids: list[list[int]]) -> pa.RecordBatch:
    decoder = Decoder.of(vocabulary)
    decimal = decoder.decimal.__getitem__
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys, pa.int64()),
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([sha256(" ".join(map(decimal, x)).encode()).hexdigest() for x in ids], pa.string()),
            pa.array([sha256(decoder.decode(x)).hexdigest() for x in ids], pa.string()),
        ],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def starts(text: str, pattern: regex.Pattern) -> list[int]:
    """Where the pre-tokens of ``text`` start; its length comes last."""
    found = [0]
    for piece in pattern.findall(text):
        found.append(found[-1] + len(piece))
    if found[-1] != len(text):
        raise ValueError("the pattern must match every character")
    return found


def stitch(chunks: Iterator[tuple[int, str, list[int], bool]], pattern: regex.Pattern) -> Iterator[list[str]]:
    """The pre-tokens of a text, from its chunks in order: (place, text, starts, is it the last)."""
    place, text, at, last = next(chunks)
    own = 0  # at[own:] are starts of the whole text's pre-tokens
    while not last:
        next_place, next_text, next_at, next_last = next(chunks)
        sure = bisect.bisect_right(at, len(text) - LOOKAHEAD, own)  # later ones may change with what follows
        offset = next_place - place
        theirs = set(next_at[:-1])
        sync = next((i for i in range(bisect.bisect_left(at, offset, own), sure) if at[i] - offset in theirs), None)
        if sync is None:  # one run covers the overlap: split what is unsure again, with what follows
            sync = max(sure - 1, own)
            yield [text[a:b] for a, b in zip(at[own:sync], at[own + 1 : sync + 1])]
            text = text[at[sync] :] + next_text[len(text) - offset :]
            place += at[sync]
            at, own, last = starts(text, pattern), 0, next_last
            continue
        yield [text[a:b] for a, b in zip(at[own:sync], at[own + 1 : sync + 1])]
        own = bisect.bisect_left(next_at, at[sync] - offset)
        place, text, at, last = next_place, next_text, next_at, next_last
    yield [text[a:b] for a, b in zip(at[own:-1], at[own + 1 :])]


def _encode_whole(vocabulary: Vocabulary, rows):
    def encode(batches):
        encoder = Encoder.of(vocabulary)
        for batch, _, _ in slices(batches):
            ids = [encoder.ids(encoder.split.findall(t)) for t in batch.column("text").to_pylist()]
            yield rows(vocabulary, batch.column("doc_id").to_pylist(), ids)

    return encode


def _cut(chunk: int, overlap: int):
    def cut(batches):
        for batch, _, _ in slices(batches):
            for key, same, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "same", "text"))):
                places = range(0, len(text), chunk)
                yield pa.RecordBatch.from_pylist(
                    [
                        {"doc_id": key, "same": same, "place": p, "last": p == places[-1], "text": text[p : p + chunk + overlap]}
                        for p in places
                    ],
                    pa.schema([("doc_id", pa.int64()), ("same", pa.string()), ("place", pa.int64()), ("last", pa.bool_()), ("text", pa.string())]),
                )

    return cut


def _split(vocabulary: Vocabulary):
    def split(batches):
        pattern = regex.compile(vocabulary.pattern)
        for batch, _, _ in slices(batches):
            found = [np.array(starts(t, pattern), np.int32) for t in batch.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else []).cast(pa.int32()))
            yield batch.append_column("starts", column)

    return split


def _encode_chunks(vocabulary: Vocabulary, finish):
    """Chunks sorted by text and place become the ids of each text. Equal rows lie side by side; each gives a row."""

    def rows(batches):
        for batch, _, _ in slices(batches):
            yield from zip(*(batch.column(c).to_pylist() for c in ("doc_id", "same", "place", "text", "starts", "last")))

    def encode(batches):
        encoder, stream = Encoder.of(vocabulary), rows(batches)
        row = next(stream, None)
        while row is not None:
            key, copies = row[:2], 0
            following: list = []

            def chunks(row=row, key=key, following=following):
                nonlocal copies
                place = -1
                while row is not None and row[:2] == key:
                    copies += row[2] == 0
                    if row[2] != place:
                        place = row[2]
                        yield row[2:]
                    row = next(stream, None)
                following.append(row)

            source = chunks()
            ids: list[int] = []
            for pieces in stitch(source, encoder.split):
                ids.extend(encoder.ids(pieces))
            for _ in source:  # the copies of the last chunk
                pass
            yield finish(vocabulary, [key[0]] * copies, [ids] * copies)
            row = following[0]

    return encode


def _run(docs: DataFrame, vocabulary: Vocabulary, columns: tuple[str, str], chunk: int, overlap: int, finish, schema: str):
    if overlap <= LOOKAHEAD or chunk < 1:
        raise ValueError("the overlap must be longer than the lookahead")
    narrow = texts(docs, *columns)
    whole = narrow.where(F.char_length("text") <= chunk).mapInArrow(_encode_whole(vocabulary, finish), schema)
    parts = (
        narrow.where(F.char_length("text") > chunk)
        .withColumn("same", F.sha2("text", 256))
        .mapInArrow(_cut(chunk, overlap), "doc_id long, same string, place long, last boolean, text string")
        .repartition("doc_id", "same", "place")
        .mapInArrow(
            _split(vocabulary), "doc_id long, same string, place long, last boolean, text string, starts array<int>"
        )
        .repartition("doc_id", "same")
        .sortWithinPartitions("doc_id", "same", "place")
    )
    return whole.unionByName(parts.mapInArrow(_encode_chunks(vocabulary, finish), schema))


def encode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """doc_id and the token ids of every row's whole text, without special tokens.

    Texts of up to ``chunk`` code points are one chunk and stay in their task; the chunks of longer ones are spread
    over the tasks. Null and empty texts have no ids. Repeated rows, null ids among them, give a row each. An empty
    table gives an empty result. ``overlap`` must be more than LOOKAHEAD.
    """
    return _run(docs, vocabulary, (id_col, text_col), chunk, overlap, _id_rows, IDS)


def round_trip(
    docs: DataFrame,
    vocabulary: Vocabulary,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``encode``, then decode the ids, in the same task: doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by
    a space) and decoded_sha256. The ids themselves never leave the task. Rows as in ``encode``."""
    return _run(docs, vocabulary, (id_col, text_col), chunk, overlap, _digest_rows, DIGESTS)


def decoded(ids: str | Column, vocabulary: Vocabulary) -> Column:
    """The bytes that an array of ids stands for; null for null."""

    @arrow_udf("binary")
    def join(column: pa.Array) -> pa.Array:
        decoder = Decoder.of(vocabulary)
        return pa.array([None if x is None else decoder.decode(x) for x in column.to_pylist()], pa.binary())

    return join(ids)
