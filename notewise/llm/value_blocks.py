"""Contour vectors in blocks, each with a dictionary of the integers that occur in every dimension.

A block keeps, for each dimension, the sorted distinct integers of its rows and a 16-bit code for each row.  Squared distances to a
few entries are then table work: one small table a dimension (distinct integer x entry), gathered by the codes and added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewise.llm.frames import picked
from notewise.llm.topk import usable
from notewise.session import checkpointed

BLOCK_ROWS = 4096
#: Rows whose distances are held at once.
SLICE_ROWS = 512


@dataclass(frozen=True)
class Block:
    """``values[d]`` are the distinct integers of dimension d in order, ``codes[d]`` each row's place among them."""

    values: list[np.ndarray]
    codes: np.ndarray

    @property
    def rows(self) -> int:
        return self.codes.shape[1]

    def column(self, d: int) -> np.ndarray:
        return self.values[d][self.codes[d]]


def largest(width: int) -> int:
    """Integers are clipped to this size, so that squared distances of vectors of ``width`` components fit a long."""
    return int((2.0 ** 61 / max(width, 1)) ** 0.5) // 2


def long_sum(column: str) -> Column:
    """Sum of a long column; the largest long if it is beyond that."""
    return F.least(F.sum(F.col(column).cast("decimal(19,0)")), F.lit(2 ** 63 - 1).cast("decimal(38,0)")).cast("long")


def usable_vectors(sequences: DataFrame, piece: str, contour: str, style: str | None = None) -> DataFrame:
    """(piece, style, contour as doubles) of the rows whose vector is not null and has finite components only."""
    names = {"piece": piece, "contour": contour, **({"style": style} if style else {})}
    rows = picked(sequences, **names).where(usable("contour"))
    kept = rows.withColumn("contour", F.col("contour").cast("array<double>"))
    return kept if style else kept.withColumn("style", F.lit(None).cast("int"))


def integers(vectors: list, width: int, scale: int) -> np.ndarray:
    """floor(scale x) of every component, clipped; shorter vectors are filled up with zeros."""
    out, top = np.zeros((len(vectors), width)), largest(width)
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return np.clip(np.floor(scale * out), -top, top).astype(np.int64)


def encoded(x: np.ndarray) -> Block:
    pairs = [np.unique(x[:, d], return_inverse=True) for d in range(x.shape[1])]
    return Block([v for v, _ in pairs], np.array([c for _, c in pairs], np.uint16).reshape(x.shape[1], len(x)))


def vector_blocks(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """``usable_vectors`` as checkpointed blocks of at most BLOCK_ROWS rows: pieces, styles, sizes, dictionary and codes."""
    kind, mark = (vectors.schema[c].dataType.simpleString() for c in ("piece", "style"))

    def packed(rows: pa.Table) -> pa.RecordBatch:
        vector = rows.column("contour").combine_chunks()
        flat, offsets = vector.values.to_numpy(), vector.offsets.to_numpy()
        block = encoded(integers([flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])], width, scale))
        dictionary = np.concatenate([*block.values, np.zeros(0, np.int64)])
        columns = [pa.array([rows.column(c).to_pylist()], pa.list_(rows.schema.field(c).type)) for c in ("piece", "style")]
        columns += [pa.array([[len(v) for v in block.values]], pa.list_(pa.int32())), pa.array([dictionary.tobytes()]), pa.array([block.codes.tobytes()])]
        return pa.RecordBatch.from_arrays(columns, ["pieces", "styles", "sizes", "dictionary", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                held.append(batch.slice(at, BLOCK_ROWS))
                rows += held[-1].num_rows
                if rows >= BLOCK_ROWS:
                    table = pa.Table.from_batches(held)
                    yield packed(table.slice(0, BLOCK_ROWS))
                    held = table.slice(BLOCK_ROWS).to_batches()
                    rows -= BLOCK_ROWS
        if rows:
            yield packed(pa.Table.from_batches(held))

    schema = f"pieces array<{kind}>, styles array<{mark}>, sizes array<int>, dictionary binary, codes binary"
    return checkpointed(vectors.select("piece", "style", "contour").mapInArrow(run, schema))


def decoded(row: dict) -> Block:
    values = np.split(np.frombuffer(row["dictionary"], np.int64), np.cumsum(row["sizes"])[:-1]) if row["sizes"] else []
    return Block(values, np.frombuffer(row["codes"], np.uint16).reshape(len(row["sizes"]), -1))


def nearest(block: Block, entries: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry in the dimensions from ``first`` on; ties to the lower index.

    Each dimension's table has one row an occurring integer and one column an entry.
    """
    dims = range(first, first + entries.shape[1])
    reach = sum(max(abs(int(v[-1]) - int(e.min())), abs(int(v[0]) - int(e.max()))) ** 2 for v, e in ((block.values[d], entries[:, d - first]) for d in dims))
    kind = np.int32 if reach < 2 ** 31 else np.int64
    tables = [np.square(block.values[d][:, None] - entries[None, :, d - first]).astype(kind) for d in dims]
    index, distance = np.zeros(block.rows, np.int64), np.zeros(block.rows, np.int64)
    for at in range(0, block.rows, SLICE_ROWS):
        part = slice(at, min(at + SLICE_ROWS, block.rows))
        total = np.zeros((part.stop - at, len(entries)), kind)
        gathered = np.empty_like(total)
        for table, d in zip(tables, dims):
            np.take(table, block.codes[d, part], axis=0, out=gathered, mode="clip")
            total += gathered
        index[part] = total.argmin(axis=1)
        distance[part] = np.take_along_axis(total, index[part, None], 1)[:, 0]
    return index, distance


def refined(blocks: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The books (entry x position, one for each consecutive part of the dimensions) after rounds of assignment and averaging.

    An entry becomes the componentwise floor(sum / count) of the parts nearest to it; unused ones stay.  A task adds its blocks up
    first and sends one number a slot (part, entry, position or count); as many reach the driver, whatever the number of rows.
    """
    for _ in range(rounds if len(books[0]) else 0):
        now = books

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in now]
            for batch in batches:
                for row in batch.to_pylist():
                    block, first = decoded(row), 0
                    for book, total in zip(now, sums):
                        index, _ = nearest(block, book, first)
                        total[:, -1] += np.bincount(index, minlength=len(book))
                        for d in range(book.shape[1]):
                            high, low = np.divmod(block.column(first + d), 1 << 20)
                            parts = [np.bincount(index, weights=x, minlength=len(book)).astype(np.int64) for x in (high, low)]
                            total[:, d] += (parts[0] << 20) + parts[1]
                        first += book.shape[1]
            flat = np.concatenate([s.ravel() for s in sums])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["slot", "total"])

        # sums of clipped components may pass a long, so they are added up as decimals
        found = blocks.select("sizes", "dictionary", "codes").mapInArrow(run, "slot bigint, total bigint").groupBy("slot").agg(
            F.sum(F.col("total").cast("decimal(19,0)")).alias("total")).collect()
        slots = {r["slot"]: int(r["total"]) for r in found}
        books, first = [], 0
        for book in now:
            new = book.copy()
            for e in range(len(book)):
                at = first + e * (book.shape[1] + 1)
                count = slots.get(at + book.shape[1], 0)
                if count:
                    new[e] = [slots.get(at + p, 0) // count for p in range(book.shape[1])]
            first += book.size + len(book)
            books.append(new)
    return books


def assigned(blocks: DataFrame, books: list[np.ndarray], schema: str, make) -> DataFrame:
    """Rows of ``schema`` (piece, style and what ``make`` gives of indexes and distances, each rows x parts)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("sizes", "dictionary", "codes")}
                block, first, found = decoded(row), 0, []
                for book in books:
                    found.append(nearest(block, book, first))
                    first += book.shape[1]
                columns = make(np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1))
                keys = [batch.column(c)[k].values for c in ("pieces", "styles")]
                yield pa.RecordBatch.from_arrays([*keys, *[pa.array(c) for c in columns]], names)

    return blocks.mapInArrow(run, schema)
