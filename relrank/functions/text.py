"""Prompts, chunks, annotations and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip removes.
STRIPPED = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Where a long text may be cut, in order of preference.
SEPARATORS = ("\n\n", "\n", ".", "!", "?", ",", " ")
CHUNK_SIZE = 1500  # fixed value
WORD = "[a-z]{4,}"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _text(c: str | Column) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def clean(c: str | Column) -> Column:
    """Strip white space at both ends; null becomes ''."""
    return F.btrim(_text(c), F.lit(STRIPPED))


def words(c: str | Column) -> Column:
    """The distinct words of four or more letters a-z."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_text(c)), F.lit(WORD), F.lit(0)))


# The labels of the three templates.
def doc_text(title: str | Column, body: str | Column) -> Column:
    return F.concat(F.lit("Title: "), _text(title), F.lit(", Context: "), _text(body))


def point_prompt(query: str | Column, doc: str | Column) -> Column:
    return F.concat(F.lit("Query:"), _text(query), F.lit("\nDocument:"), _text(doc))


def pair_prompt(query: str | Column, doc1: str | Column, doc2: str | Column, style: str = "score") -> Column:
    # Both spellings are fixed, the misspelt one included.
    labels = {
        "train": ("Query:", "\nDocument 1:", "\nDocuemt 2:"),
        "score": ("Query: ", "\nDocument 1: ", "\nDocument 2: "),
    }
    if style not in labels:
        raise ValueError(f"style must be one of {sorted(labels)}, not {style!r}")
    q, a, b = labels[style]
    return F.concat(F.lit(q), _text(query), F.lit(a), _text(doc1), F.lit(b), _text(doc2))


def _last_cut(text: Column, start: Column, separator: Column, size: int) -> Column:
    """Offset of the last ``separator`` in (start, start + size], or null.

    A run of newlines may be cut one newline later than a left-to-right scan would cut it; the chunk is
    stripped of them anyway.
    """
    width = F.length(separator)
    window = F.substr(text, start + 1, width + size)
    back = F.position(separator, F.reverse(window))
    at = F.length(window) - back + 1 - width
    return F.when((back > 0) & (at > 0), start + at)


def first_chunk(c: str | Column, size: int = CHUNK_SIZE) -> Column:
    """The first chunk of at most ``size`` characters.

    A text that fits is only stripped. A longer one is cut before the last occurrence, within ``size``, of
    the first separator that occurs there, and without any at ``size``. A cut among leading blanks would
    give a blank chunk: it moves the start instead, and the search goes on with the same separator and then
    the later ones.
    """
    # The one-element array makes Spark evaluate the text once, however long the expression behind it is.
    return F.get(F.transform(F.array(_text(c)), lambda text: _first_chunk(text, size)), F.lit(0))


def _first_chunk(text: Column, size: int) -> Column:
    def step(state: Column, separator: Column) -> Column:
        blanks = state["blanks"]
        cut = _last_cut(text, state["start"], separator, size)
        behind = F.when(cut <= blanks, _last_cut(text, cut, separator, size)).otherwise(cut)
        found = F.struct(
            blanks.alias("blanks"),
            F.when(cut <= blanks, cut).otherwise(state["start"]).alias("start"),
            F.when(behind > blanks, behind).alias("end"),
        )
        return F.when(state["end"].isNotNull(), state).otherwise(found)

    initial = F.struct(
        (F.length(text) - F.length(F.ltrim(text, F.lit(STRIPPED)))).alias("blanks"),
        F.lit(0).alias("start"),
        F.lit(None).cast("int").alias("end"),
    )
    separators = F.lit(list(SEPARATORS))
    end = F.aggregate(separators, initial, step, lambda s: F.coalesce(s["end"], s["start"] + size))
    return F.when(F.length(text) <= size, clean(text)).otherwise(clean(F.substr(text, F.lit(1), end)))


def parse_annotation(c: str | Column) -> tuple[Column, Column]:
    """'rel,senti' as two int columns."""
    parts = F.split(_col(c), ",")
    return tuple(F.trim(F.get(parts, F.lit(i))).cast("int") for i in (0, 1))


def file_stem(c: str | Column) -> Column:
    """The lower-cased file name up to its first dot; a trailing slash is ignored."""
    name = F.element_at(F.split(F.rtrim(_col(c), F.lit("/")), "/"), -1)
    return F.lower(F.trim(F.split_part(name, F.lit("."), F.lit(1))))
