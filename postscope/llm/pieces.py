"""SentencePiece ids and decoded text by a table of distinct chunks.

In a model whose pieces hold the whitespace marker only in front, no piece crosses from
a word to the next marker, so a text's ids are those of its marked words side by side.
Each task keeps a table from distinct chunks (marked words, line breaks) to their ids
and to what these ids decode to, asks the library once for each new chunk, and joins
the entries back by position. Whole texts are encoded in one pass over the input without
a shuffle.

Cases: a null or empty text has the end id only and decodes to the empty text. Texts may
be of any length. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscope.llm.shared import small_batches

MARK = "▁"
#: A task's table is begun anew beyond so many chunks, which bounds its memory.
TABLE_ENTRIES = 400_000
GUARD = "a"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ChunkTable:
    """Ids of distinct chunks of one model, and surfaces of those that do not decode to themselves.

    A chunk is a run of markers with the characters up to the next marker, cut at line
    breaks as well where no piece of several characters holds one.
    """

    def __init__(self, model: bytes):
        self.codec = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.codec.id_to_piece(i) for i in range(self.codec.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("the model has pieces that cross whitespace markers")
        if any("\n" in p for p in pieces) or len(self.codec.encode("\n")) != 2:
            self.rule = re.compile(" +[^ ]*|[^ ]+")
        else:
            self.rule = re.compile(" +[^ \n]*|\n|[^ \n]+")
        self.guard = self.codec.encode("\n" + GUARD)[2:]
        self.end = self.codec.eos_id()
        self.ids: dict[str, str] = {}
        self.surface: dict[str, str] = {}

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text as the library sees it, with the marker it puts in front."""
        return self.rule.findall(" " + text.replace(MARK, " ")) if text else []

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.ids) > TABLE_ENTRIES:
            self.ids.clear()
            self.surface.clear()
        new = list(set().union(*texts).difference(self.ids))
        marked = [c for c in new if c[0] == " "]
        bare = [c for c in new if c[0] != " "]
        ids = self.codec.encode([c[1:] or "" for c in marked], num_threads=1) if marked else []
        # the library gives no ids for an empty text, but a lone marker has one
        lone = self.codec.encode("\n")[:1]
        found = [(c, i if c != " " else lone) for c, i in zip(marked, ids)]
        if bare:  # behind a line break, whose ids (marker, break) are cut off, nothing is put in front
            found += [(c, i[2:]) for c, i in zip(bare, self.codec.encode(["\n" + c for c in bare], num_threads=1))]
        shown = self.codec.decode([self.guard + i for _, i in found], num_threads=1) if found else []
        for (chunk, i), text in zip(found, shown):
            self.ids[chunk] = " ".join(map(str, i))
            if text[len(GUARD) :] != chunk:
                self.surface[chunk] = text[len(GUARD) :]

    def codec_rows(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """Decimal ids with the end id, joined by blanks, and decoded text of each text."""
        cut = [self.chunks(t or "") for t in texts]
        self.learn(cut)
        ids, surface, end = self.ids, self.surface, str(self.end)
        out = []
        for parts in cut:
            text = "".join([surface.get(c, c) for c in parts])
            out.append((" ".join([*[ids[c] for c in parts], end]), text[1:] if text[:1] == " " else text))
        return out


_tables: dict[bytes, ChunkTable] = {}


def chunk_table(model: bytes) -> ChunkTable:
    """The table of this worker for a model."""
    key = hashlib.sha256(model).digest()
    if key not in _tables:
        _tables[key] = ChunkTable(model)
    return _tables[key]


def _some(column: pa.Array, rows: int = 256) -> Iterator[tuple[int, list[str | None]]]:
    for at in range(0, len(column), rows):
        yield at, column[at : at + rows].to_pylist()


def encode_pieces(docs: DataFrame, model: bytes) -> DataFrame:
    """Every row of ``docs`` (its doc_id) with its number of ids, the ids and the decoded text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(shared.value)
        for batch in batches:
            for at, texts in _some(batch.column(1)):
                rows = table.codec_rows(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[at : at + len(rows)],
                        pa.array([[int(x) for x in r[0].split(" ")] for r in rows], pa.list_(pa.int32())),
                        pa.array([r[1] for r in rows], pa.string()),
                    ],
                    names=["doc_id", "ids", "decoded"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(encode, "doc_id long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """As ``encode_pieces``, with digests in place of ids and text, which then never leave the task."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(shared.value)
        for batch in batches:
            for at, texts in _some(batch.column(1)):
                rows = table.codec_rows(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[at : at + len(rows)],
                        pa.array([r[0].count(" ") + 1 for r in rows], pa.int64()),
                        pa.array([hashlib.sha256(r[0].encode()).hexdigest() for r in rows], pa.string()),
                        pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, DIGESTS)
