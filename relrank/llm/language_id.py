"""Language identification by bit-sliced Bloom filters of byte n-grams.

A slot of the filter is a bitmask of languages. The masks at an n-gram's slots, combined by AND, name all languages that
hold it at once. The bits are counted per language over a text, corrected for the filter's false positives, and the
language with most n-grams wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from relrank.llm.common import LOWER, mix, slices, stored

GRAM = 4  # bytes
HASHES = 3
LANGUAGES = 64  # bits of a mask; a slot has as many masks as all languages need
SAMPLE_ROWS = 1_000  # labelled rows per language that are learned from, in the order of the md5 of their ids
PROFILE = 20_000  # n-grams per language, those in most rows
LEAST_SHARE = 0.005  # of a language's rows that an n-gram must be in
SLOTS = 1 << 19  # 4 MB for every 64 languages, for any input
UNKNOWN = "und"

_FOLD = LOWER.copy()
_FOLD[:128][[not chr(c).isalpha() for c in range(128)]] = 32


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every GRAM bytes of the texts, each text between two blanks; first and last + 1 of each text's."""
    rows = len(offsets) - 1
    padded = np.full(len(data) + rows + GRAM, 32, np.uint32)
    padded[np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(offsets))] = _FOLD[data]
    size = len(padded) - GRAM + 1
    found = np.zeros(size, np.uint32)
    for i in range(GRAM):
        found |= padded[i : i + size] << np.uint32(8 * i)
    first = offsets[:-1] + np.arange(rows)
    return found, first, np.maximum(first, offsets[1:] + np.arange(rows) + 2 - GRAM + 1)


def _slots(codes: np.ndarray, slots: int) -> list[np.ndarray]:
    mixed = mix(codes.astype(np.uint64))
    return [((mixed >> np.uint64(20 * i)) & np.uint64(slots - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass(frozen=True)
class LanguageModel:
    """Names, masks (one row for every LANGUAGES names, SLOTS long), and how often each language's bits are all set by
    chance."""

    names: tuple[str, ...]
    masks: np.ndarray
    chance: np.ndarray

    @classmethod
    def of(cls, profiles: dict[str, np.ndarray], slots: int = SLOTS) -> LanguageModel:
        """``profiles``: n-grams by language, the most likely language first (it wins ties)."""
        masks = np.zeros((-(-len(profiles) // LANGUAGES), slots), np.uint64)
        for number, codes in enumerate(profiles.values()):
            row, bit = divmod(number, LANGUAGES)
            for at in _slots(np.asarray(codes, np.uint32), slots):
                masks[row, at] |= np.uint64(1 << bit)
        bits = [((masks[i // LANGUAGES] >> np.uint64(i % LANGUAGES)) & np.uint64(1)).mean() for i in range(len(profiles))]
        return cls(tuple(profiles), masks, np.array(bits) ** HASHES)

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages): the part of a text's n-grams that the language holds."""
        codes, first, last = grams(data, offsets)
        slots = _slots(codes, self.masks.shape[1])
        size = np.maximum(last - first, 1)
        shares = np.zeros((len(first), len(self.names)))
        for number, chance in enumerate(self.chance):
            row, bit = divmod(number, LANGUAGES)
            if bit == 0:
                found = np.bitwise_and.reduce([self.masks[row][at] for at in slots])
            sums = np.concatenate([[0], np.cumsum((found >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)
            counted = (sums[last] - sums[first]) / size
            shares[:, number] = np.clip((counted - chance) / (1 - chance), 0, 1)
        return shares


def _profile(batches):
    """(lang, gram, rows) of each slice of texts of one language after the other."""
    for batch, data, offsets in slices(batches):
        codes, first, last = grams(data, offsets)
        owner = np.repeat(np.arange(len(first)), last - first)
        codes = codes[np.arange(len(owner)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[owner]]
        distinct = np.unique(owner.astype(np.uint64) << np.uint64(32) | codes)
        langs = np.array(batch.column("lang").to_pylist(), object)[(distinct >> np.uint64(32)).astype(np.int64)]
        codes = (distinct & np.uint64(0xFFFFFFFF)).astype(np.int64)
        for lang in dict.fromkeys(langs):
            found, rows = np.unique(codes[langs == lang], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found)), pa.array(found), pa.array(rows.astype(np.int64))], ["lang", "gram", "rows"]
            )


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_ROWS
) -> LanguageModel:
    """Profiles of the n-grams of each ``lang_col`` value, from ``sample`` rows of it that are not held out.

    The sample bounds what is counted and what reaches the driver (PROFILE n-grams a language, however many rows it has).
    Any number of languages can be learned; each 64 make every look-up a mask wider. Rows that repeat an id
    are drawn together. Rows without id, text or language teach nothing; a table without any gives a model that knows
    no language.
    """
    usable = F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)
    order = F.md5(F.col(id_col).cast("string"))
    keys = docs.where(usable).select(F.col(lang_col).alias("lang"), order.alias("order"))
    # The last hash that is drawn, from ids alone: first in 256 parts of each language, then over what those leave.
    part = F.row_number().over(Window.partitionBy("lang", F.substring("order", 1, 2)).orderBy("order"))
    at = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    few = keys.withColumn("at", part).where(F.col("at") <= sample).drop("at")
    cuts = few.withColumn("at", at).where(F.col("at") <= sample).groupBy("lang").agg(F.max("order").alias("cut"))
    cuts = stored(cuts)  # its size is known then: a row per language is broadcast while it is small
    rows = docs.where(usable).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), order.alias("order"))
    drawn = stored(rows.join(cuts, "lang").where("order <= cut").select("lang", "text"))
    counts = drawn.repartition(F.xxhash64("text")).mapInArrow(_profile, "lang string, gram long, rows long")
    sizes = drawn.groupBy("lang").agg(F.count("*").alias("size"))
    common = counts.groupBy("lang", "gram").agg(F.sum("rows").alias("rows")).join(sizes, "lang")
    common = common.where(F.col("rows") >= LEAST_SHARE * F.col("size"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rows"), "gram"))
    table = common.withColumn("at", best).where(F.col("at") <= PROFILE).select("lang", "gram", "size").toArrow()
    frame = table.to_pandas()
    order = frame.groupby("lang")["size"].first().sort_index().sort_values(ascending=False, kind="stable")
    return LanguageModel.of({lang: frame.loc[frame["lang"] == lang, "gram"].to_numpy() for lang in order.index})


def _letters(texts: list[str | None], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.concatenate([[0], np.cumsum((_FOLD[data] != 32) & (data < 128))])
    found = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(map(str.isalpha, texts[i] or ""))
    return found


def predict(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", prefix: str = ""
) -> DataFrame:
    """The columns of ``docs`` with lang_pred and score (names after ``prefix``), instead of any such columns.

    The score is the part of the text's n-grams that the language holds. ``und`` with score 0 for null and for texts
    without letters; a text of which no language holds anything gets the language with most rows, with score 0. Ties
    go to the language with more learned rows, then by name. Every row gives a row, repeated ones too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lang, score = f"{prefix}lang_pred", f"{prefix}score"
    docs = docs.drop(lang, score)

    def label(batches):
        known = shared.value
        for batch, data, offsets in slices(batches, text_col):
            letters = _letters(batch.column(text_col).to_pylist(), data, offsets)
            if known.names:
                shares = known.shares(data, offsets)
                best = shares.argmax(axis=1)
                names = np.where(letters, np.array(known.names, object)[best], UNKNOWN)
                scores = np.where(letters, shares.max(axis=1), 0.0)
            else:
                names, scores = np.full(len(letters), UNKNOWN, object), np.zeros(len(letters))
            yield batch.append_column(lang, pa.array(names, pa.string())).append_column(score, pa.array(scores, pa.float64()))

    schema = StructType([*docs.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])
    return docs.mapInArrow(label, schema)


LEAST_SCORE = 0.1


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or that score less than LEAST_SCORE."""
    labelled = predict(docs, model, text_col, prefix="_language_")
    known = (F.col("_language_lang_pred") != UNKNOWN) & (F.col("_language_score") >= LEAST_SCORE)
    return labelled.where(known).drop("_language_lang_pred", "_language_score")
