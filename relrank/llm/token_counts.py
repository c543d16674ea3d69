"""Token counts of a unigram tokenizer, without building tokens.

An Aho-Corasick automaton enumerates all pieces that end at a character, the longest first; dynamic programming carries
the best score and its number of pieces. Of equal scores the piece that starts first wins, as in the tokenizer's own
lattice. A text is cut where no piece can cross, and what lies between is remembered.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from relrank.llm.common import slices, texts

SPACE = "▁"  # what the tokenizer writes for a blank
UNKNOWN_PENALTY = 10.0  # an unknown character scores so much less than the worst piece
NORMAL, BYTE = 1, 6  # kinds of pieces in a model file
REMEMBERED = 1 << 19
EXACT = 2.0**53


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass(frozen=True)
class Unigram:
    """Pieces with their log scores; characters that are no pieces become one piece per byte."""

    pieces: tuple[tuple[str, float], ...]

    @classmethod
    def load(cls, path: str) -> Unigram:
        """Pieces and scores of a model file of the installed tokenizers, read by the driver."""
        with open(path, "rb") as file:
            found = [dict(_fields(value)) for number, value in _fields(file.read()) if number == 1]
        kinds = [(p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)) for p in found]
        if sum(kind == BYTE for _, _, kind in kinds) != 256:
            raise ValueError("the model has no pieces for bytes")
        return cls(tuple((text, score) for text, score, kind in kinds if kind == NORMAL))


class Counter(dict):
    """Score and number of pieces of a part of a text, as one number; remembers short parts.

    Only sums of whole numbers do not depend on what comes before. Of a model with other scores, nothing is remembered: the
    score is carried through the text from part to part, and rounded where the tokenizer rounds it.
    """

    _made: dict[int, Counter] = {}

    def __init__(self, model: Unigram):
        super().__init__()
        self._whole_numbers = all(score == int(score) for _, score in model.pieces)
        self._automaton = ahocorasick.Automaton()
        for text, score in model.pieces:
            self._automaton.add_word(text, (len(text), score))
        self._automaton.make_automaton()
        self._known = {text for text, _ in model.pieces if len(text) == 1}
        self._unknown = min((s for _, s in model.pieces), default=0.0) - UNKNOWN_PENALTY
        # Where no piece has a blank inside, a run of blanks starts a new part; so does any line end.
        pairs = {pair for text, _ in model.pieces for pair in zip(text, text[1:])}
        words = not any(a != SPACE and b == SPACE for a, b in pairs)
        line = "" if any("\n" in pair for pair in pairs) else "\n"
        part = f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" if words else f"[^{line}]+" if line else "(?s:.+)"
        self._parts = re.compile(f"{line}|{part}" if line else part)

    @classmethod
    def of(cls, model: Unigram) -> Counter:
        key = hash(model)
        if key not in cls._made:
            cls._made[key] = cls(model)
        return cls._made[key]

    def __missing__(self, part: str) -> complex:
        count, score = self._best(part)
        found = complex(score, count)  # one number, so that a text is one sum
        if len(part) <= 40:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = found
        return found

    def _best(self, part: str, before: float = 0.0) -> tuple[int, float]:
        size = len(part)
        score: list[float | None] = [before] + [None] * size
        count = [0] * (size + 1)
        done = 0

        def end_with_unknown(at: int) -> None:
            """The character before ``at`` alone, if it is no piece: the last choice there."""
            if part[at - 1] not in self._known:
                value = score[at - 1] + self._unknown
                if score[at] is None or value > score[at]:
                    score[at], count[at] = value, count[at - 1] + len(part[at - 1].encode())

        for end, (length, own) in self._automaton.iter(part):
            end += 1
            while done < end - 1:  # all pieces that end there have been seen
                done += 1
                end_with_unknown(done)
            value = score[end - length] + own
            if score[end] is None or value > score[end]:
                score[end], count[end] = value, count[end - length] + 1
        while done < size:
            done += 1
            end_with_unknown(done)
        return count[size], score[size]

    def whole(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        parts = self._parts.findall(SPACE + text.replace(" ", SPACE))
        if self._whole_numbers:
            found = sum(map(self.__getitem__, parts))
            if abs(found.real) < EXACT:
                return int(found.imag), found.real
        count, score = 0, 0.0
        for part in parts:
            more, score = self._best(part, score)
            count += more
        return count, score


def count_tokens(docs: DataFrame, model: Unigram, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and score of the best segmentation of each row's whole text.

    Blanks are written as SPACE and one stands before the text, nothing else is normalised. Characters that no piece
    has count as one piece per byte if the model falls back to bytes. Scores may be any numbers, log probabilities among
    them; whole ones are faster. Null and empty texts have 0 tokens and score 0.
    Repeated rows and null ids give a row each; an empty table gives an empty result.
    """

    def count(batches):
        counter = Counter.of(model)
        for batch, _, _ in slices(batches):
            found = [counter.whole(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "n_tokens", "score"],
            )

    return texts(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_tokens long, score double")
