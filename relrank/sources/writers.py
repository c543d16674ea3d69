"""Writers of the collection files. Each writes a folder of part files, one per task."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relrank.operators.sampling import flatten_triples
from relrank.sources.readers import QUOTING

KEEP_BLANKS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_tsv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> None:
    """A quoted TSV; maps are written as JSON."""
    maps = {f.name for f in df.schema if isinstance(f.dataType, T.MapType)}
    flat = df.select(*[(F.to_json(f"`{c}`").alias(c) if c in maps else F.col(f"`{c}`")) for c in df.columns])
    flat.write.mode(mode).options(**QUOTING, **KEEP_BLANKS).csv(path, header=header)


def qrels_lines(df: DataFrame) -> DataFrame:
    """'qid Q0 docid label'."""
    label = F.col("label").cast("int").cast("string")
    return df.select(F.concat_ws(" ", "qid", F.lit("Q0"), "docid", label).alias("value"))


def write_qrels(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    qrels_lines(df).write.mode(mode).text(path)


def run_lines(df: DataFrame, run_id: str) -> DataFrame:
    """'qid, Q0, docid, rank, score, run id', the score with four decimals."""
    return df.select(
        F.format_string("%s, Q0, %s, %d, %.4f, %s", "qid", "docid", "rank", "score", F.lit(run_id)).alias("value")
    )


def write_run(df: DataFrame, run_id: str, path: str, mode: str = "append") -> None:
    run_lines(df, run_id).write.mode(mode).text(path)


def write_triples(triples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Ten columns without a header."""
    write_tsv(flatten_triples(triples), path, header=False, mode=mode)


def _folder_value(value: str | None) -> str:
    """A value in a folder's name, escaped as Spark does it."""
    if not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value)


def _json_pieces(rows: Iterable[tuple[str, str]]) -> Iterator[str]:
    """{query: [document, …]} from (query, document) in the order of the queries."""
    last = None
    for n, (query, doc) in enumerate(rows):
        if n and query == last:
            yield ", "
        else:
            yield ("], " if n else "{") + json.dumps(query) + ": ["
        yield doc
        last = query
    yield "]}"


def _csv_pieces(header: str) -> Callable[[Iterable[tuple[str, str]]], Iterator[str]]:
    def pieces(rows: Iterable[tuple[str, str]]) -> Iterator[str]:
        yield header
        for _, line in rows:
            yield "\n" + line
        yield "\n"

    return pieces


def _write_topics(rows: DataFrame, place: list[str], root: str, name: str, pieces) -> None:
    """A file root/folder=…/stem=…/name for every topic of ``rows`` (folder, stem, query, value and the columns of
    ``place``, which order them).

    Topics are dealt out over a fixed number of tasks, as the cost is in the files and not in their bytes, by which Spark
    would put them into few. A task opens its files itself: a small file costs Spark's writer many times its write.
    """

    def write(batches):
        files, top = FileSystem.from_uri(root)
        columns = ("folder", "stem", "query", "value")
        found = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns)))
        for (folder, stem), topic in groupby(found, key=lambda row: row[:2]):
            path = f"{top}/folder={_folder_value(folder)}/stem={_folder_value(stem)}"
            files.create_dir(path, recursive=True)
            draft = f"{path}/.{uuid.uuid4().hex}"  # hidden till it is whole; a task that runs again replaces its files
            with files.open_output_stream(draft, compression=None) as out:
                for piece in pieces(row[2:] for row in topic):
                    out.write(piece.encode())
            files.move(draft, f"{path}/{name}")
        return iter(())

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, "folder", "stem").sortWithinPartitions("folder", "stem", *place)
    written = dealt.select("folder", "stem", "query", "value").mapInArrow(write, "path string")
    written.write.format("noop").mode("overwrite").save()


def write_fair_tree(docs: DataFrame, annotations: DataFrame, root: str) -> None:
    """Folders root/folder=…/stem=… with the documents of one topic as JSON and its annotations as CSV, in the order of
    ``pos``: what ``read_fair_tree`` reads.

    ``docs`` has folder, stem, query, docid, title, body; ``annotations`` has folder, stem, docid, mapped_annotation, pos.
    The executors write the files through ``pyarrow.fs``. A topic's documents are one JSON value, as the format has it, so
    topics must fit a task each when they are read.
    """
    files, top = FileSystem.from_uri(root)
    if files.get_file_info(top).type != FileType.NotFound:
        raise FileExistsError(root)
    doc = F.to_json(F.struct("docid", "title", "body"), {"ignoreNullFields": "false"})
    topics = docs.select("folder", "stem", "query", "docid", "title", "body", doc.alias("value"))
    _write_topics(topics, ["query", "docid", "title", "body"], root, "docs.txt", _json_pieces)
    names = [c for c in annotations.columns if c not in ("folder", "stem", "pos")]
    options = {"quote": '"', "escape": '"', **{k: str(v).lower() for k, v in KEEP_BLANKS.items()}}
    line = F.to_csv(F.struct(*names), options)
    notes = annotations.select("folder", "stem", F.lit("").alias("query"), "pos", line.alias("value"))
    _write_topics(notes, ["pos"], root, "notes.csv", _csv_pieces(",".join(names)))
