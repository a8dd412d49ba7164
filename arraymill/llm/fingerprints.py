"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows the
text and two sketches of any sizes can be compared or merged: the sketch of a union is the union of
the sketches. A text of whose hashes fewer than ``FEW`` lie below, as a short one, keeps them all; its
fingerprint is marked by ``ALL``.

Likeness is the containment estimate |A and B| / |A|: how much of A's text the other one has, however
unequal their lengths. A's kept hashes are looked up in B's sketch; those of an A that keeps all, in
all of B's hashes. Defined results: null counts as the empty text; a text without words has the empty
sketch, whose likeness is 1 to another such text and 0 to all others. Documents follow one another by
ascending doc_id, null first, rows of the same doc_id by their texts; after the last comes the first,
so a table of one row follows itself. Texts are read whole, however long; a task holds a batch of them
and the one before. Columns besides don't matter, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_or_empty, written
from .shingles import pieces, shingle_hashes

FRACTION = 1 / 8
WIDTH = 5
#: Hashes below the fraction under which a text keeps all of its hashes.
FEW = 8
#: Texts whose hashes a task holds at once.
SLICE = 500
#: The mark of a fingerprint that has all hashes.
ALL = "*"
#: Leading bits of a hash that a written fingerprint keeps.
BITS = 48
_SHIFT = np.uint64(64 - BITS)


@dataclass(frozen=True)
class Sketch:
    """Sorted distinct retained hashes; whether they are all of the text's; the bound that scales the others."""

    hashes: np.ndarray
    all: bool
    most: int

    def __len__(self) -> int:
        return len(self.hashes)

    def below(self) -> np.ndarray:
        """The hashes that a sketch keeps of any text."""
        return self.hashes[self.hashes <= np.uint64(self.most)] if self.all else self.hashes


def sketches(texts: list[bytes], fraction: float = FRACTION, width: int = WIDTH) -> list[tuple[Sketch, np.ndarray]]:
    """Each text's sketch and all of its sorted distinct hashes."""
    out = []
    most = min(int(fraction * 2**BITS), 2**BITS) - 1
    for low, high in pieces(texts):
        hashes, offset = shingle_hashes(texts[low:high], width)
        hashes >>= _SHIFT
        for a, b in zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True):
            own = np.unique(hashes[a:b])
            n = int(np.searchsorted(own, np.uint64(most), side="right"))
            out.append((Sketch(own if n < FEW else own[:n], n < FEW or n == len(own), most), own))
    return out


def _share(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def containment(a: Sketch, b: Sketch, every: np.ndarray | None = None) -> float:
    """Share of the first sketch that the second text has too; ``every`` are all of that text's hashes.

    From sketches alone an a that keeps all hashes is compared below the bound of b, if b is scaled.
    """
    if a.all and (b.all or every is not None):
        return _share(a.hashes, b.hashes if b.all else every)
    return _share(a.below(), b.below())


def union(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of two texts' shingles together."""
    if a.all and b.all:
        return Sketch(np.union1d(a.hashes, b.hashes), True, a.most)
    return Sketch(np.union1d(a.below(), b.below()), False, a.most)


def as_text(sketch: Sketch) -> str:
    """Hexadecimal digits, ``BITS / 4`` for each hash in ascending order, after the mark of one that has all."""
    digits = sketch.hashes.astype(">u8").tobytes().hex()
    n, skip = 16, (64 - BITS) // 4
    return (ALL if sketch.all and len(sketch) else "") + "".join([digits[i + skip : i + n] for i in range(0, len(digits), n)])


def fingerprints(docs: DataFrame, fraction: float = FRACTION, width: int = WIDTH) -> DataFrame:
    """``doc_id, fingerprint`` of every text."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_text(s) for s, _ in sketches(texts, fraction, width)], pa.string())], names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(sketched, f"doc_id {kind}, fingerprint string")


def edited(text: str, after: str) -> str:
    """The text with its last half of code points replaced by the first as many of the next one's."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _against_next(texts: list[str], fraction: float, width: int) -> list[pa.Array]:
    """The results of all texts but the last, each followed by the next."""
    changed = [edited(t, a) for t, a in zip(texts[:-1], texts[1:], strict=True)]
    mine = sketches([t.encode() for t in texts], fraction, width)
    other = sketches([t.encode() for t in changed], fraction, width)
    return [
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array([as_text(s) for s, _ in mine[:-1]], pa.string()),
        pa.array([as_text(s) for s, _ in other], pa.string()),
        pa.array([containment(a, b, every) for (a, _), (b, every) in zip(mine[:-1], other, strict=True)], pa.float64()),
        pa.array([containment(a, b, every) for (a, _), (b, every) in zip(mine[:-1], mine[1:], strict=True)], pa.float64()),
    ]


def compared(docs: DataFrame, fraction: float = FRACTION, width: int = WIDTH, partitions: int | None = None) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    Tasks read ranges of documents in order and hand on their first and last text, two records each,
    which then meet across the ranges' borders.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    order = ["doc_id", F.substring("text", 1, 64)]
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions("doc_id", "text")
    columns = ["doc_id", *(c.split()[0] for c in _RESULT.split(", "))]
    names = ["kind", "part", "text", *columns]

    def record(kind: int, n: int, text: list[str | None], ids: pa.Array, results: list[pa.Array] | None = None) -> pa.RecordBatch:
        part = TaskContext.get().partitionId()
        results = results or [pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(text, pa.string()), ids, *results], names=names)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, last = None, []
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            texts = last + batch.column(1).to_pylist()
            if ids is None:
                yield record(1, 1, texts[:1], pa.nulls(1, batch.column(0).type))
            ids = batch.column(0) if ids is None else pa.concat_arrays([ids, batch.column(0)])
            if len(texts) > 1:
                n = len(texts) - 1
                yield record(0, n, [None] * n, ids.slice(0, n), _against_next(texts, fraction, width))
            ids, last = ids.slice(len(texts) - 1), texts[-1:]
        if ids is not None:
            yield record(2, 1, last, ids)

    out, _ = written(dealt.mapInArrow(follow, f"kind int, part int, text string, doc_id {kind}, {_RESULT}"), "fingerprints")
    firsts = out.filter("kind = 1").select(F.col("part").alias("following"), F.col("text").alias("after"))
    # a row for each range
    every = Window.partitionBy(F.lit(0)).orderBy("part")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = out.filter("kind = 1").select("part", F.coalesce(F.lead("part").over(every), F.min("part").over(whole)).alias("following"))
    borders = out.filter("kind = 2").select("part", "doc_id", "text").join(ranges, "part").join(firsts, "following").select("doc_id", "text", "after")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, after) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *_against_next([text, after], fraction, width)], names=columns)

    return out.filter("kind = 0").select(*columns).unionByName(borders.mapInArrow(across, f"doc_id {kind}, {_RESULT}"))
