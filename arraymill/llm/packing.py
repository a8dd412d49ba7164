"""Packing documents into fixed token windows: concatenate and cut.

The token streams of all documents are laid end to end and cut every ``window`` tokens. Two passes
find where each document lies: the first tokenises and sums within a partition, the second adds the
prefix sums over the partitions' totals. A document that crosses cuts yields boundary records, one
piece for each window that it touches. Only the last window can fall short; it is the only padding.

Defined results: a null text is an empty one; every document ends with the end token, so an empty
one has one token. Rows that repeat are packed each by itself. A null doc_id is carried as null.
Columns of the input other than the id and the text don't matter, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, text_or_empty, written

END_ID = 1
WINDOW = 2048
#: Bytes of text whose chunks are encoded at once.
TEXT_BYTES = 8_000_000
_SPACES = [chr(i).encode() for i in range(0x3001) if chr(i).isspace()]
_BLANK, _WIDE = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[b[0] for b in _SPACES if len(b) == 1]] = True
_WIDE[[b[0] for b in _SPACES if len(b) > 1]] = True
_BLANKS_2, _BLANKS_3 = (np.array([int.from_bytes(b, "big") for b in _SPACES if len(b) == n], np.int32) for n in (2, 3))


def _spaced(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a blank of Unicode, of one to three bytes, begins at each place ``at``; three bytes must follow it."""
    first = data[at]
    out = _BLANK[first]
    wide = np.flatnonzero(_WIDE[first])
    if len(wide):
        two = first[wide].astype(np.int32) << 8 | data[at[wide] + 1]
        out[wide] = np.isin(two, _BLANKS_2) | np.isin(two << 8 | data[at[wide] + 2], _BLANKS_3)
    return out


def chunk_starts(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of texts start, texts that lie end to end in ``data`` between ``edges``; and each text's number of chunks.

    A chunk ends before a space, and before and after a newline, that stands alone between two non-blanks of its text.
    """
    wide = np.zeros(len(data) + 6, np.uint8)
    wide[3:-3] = data
    at = np.flatnonzero((data == 32) | (data == 10))
    text = np.searchsorted(edges, at, side="right") - 1
    # blanks of the text before or after touch nothing of this one, but then the place is at an end and no cut anyway
    inner = (at > edges[text]) & (at + 1 < edges[text + 1])
    at, text = at[inner], text[inner]
    alone = ~_spaced(wide, at + 4)
    before = wide[at + 2]
    alone &= ~_BLANK[before]
    tail = np.flatnonzero(before >= 128)
    for n in (2, 3):
        back = at[tail] + 3 - n
        alone[tail] &= ~(_spaced(wide, back) & (wide[back] >= (0xC2, 0xE1)[n - 2]) & (wide[back] <= (0xC2, 0xE3)[n - 2]))
    at, text = at[alone], text[alone]
    line = data[at] == 10
    starts = np.sort(np.concatenate([edges[:-1], at, at[line] + 1]))
    return starts, 1 + np.bincount(text, 1 + line, minlength=len(edges) - 1).astype(np.int64)


def _laid(own: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings end to end, and the places between them."""
    if not len(own):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    edges = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1].astype(np.int64)
    return np.frombuffer(own.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]], edges - edges[0]


class Encoder:
    """The ids that the byte-level vocabulary's own library gives, many times as fast.

    The rank file holds the same vocabulary. Its splitting pattern never joins what stands on either
    side of a single space or newline between two non-blanks, so texts fall into chunks that repeat.
    Those of many texts are encoded once each, laid end to end where chunks begin at a space, between
    newlines where not. Texts with a special token's string take the plain way.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        ranks = vocabulary.removesuffix(".json") + ".tiktoken"
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.vocabulary, self._plain = vocabulary, None
        self.fast = fast.encode_ordinary
        self.lengths = np.zeros(max(table.values()) + 1, np.int64)
        self.lengths[list(table.values())] = [len(x) for x in table]

    def plain(self, text: str) -> bytes:
        if self._plain is None:
            from tokenizers import Tokenizer

            self._plain = Tokenizer.from_file(self.vocabulary)
        return np.array(self._plain.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _joined(self, chunks: pa.StringArray, between: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, and how many each has; ``between`` newlines keep them apart."""
        if between:
            chunks = pc.binary_join_element_wise(chunks, "", "\n")
        raw, offset = _laid(chunks)
        ids = np.array(self.fast(raw.tobytes().decode()), dtype="<u2")
        high = np.searchsorted(np.cumsum(self.lengths[ids]), offset[1:]) + 1
        return np.delete(ids, high - 1) if between else ids, np.diff(high, prepend=0) - between

    def chunks(self, distinct: pa.StringArray) -> pa.BinaryArray:
        """Ids of each chunk as little-endian 16-bit bytes."""
        raw, offset = _laid(distinct)
        padded = np.concatenate([np.zeros(3, np.uint8), raw, np.zeros(3, np.uint8)])
        low, high = offset[:-1] + 3, offset[1:] + 3
        spaced = padded[low] == 32
        first = padded[low + spaced]
        # nothing that may be a blank at either end, but for one space in front
        whole = (high > low + spaced) & ~_BLANK[first] & ~_WIDE[first] & ~_BLANK[padded[high - 1]]
        whole &= (padded[high - 1] < 128) | ~(_WIDE[padded[high - 2]] | _WIDE[padded[high - 3]])
        kinds = [np.flatnonzero(k) for k in (whole & spaced, whole & ~spaced, ~whole)]
        ids, counts = [np.zeros(0, "<u2")], [np.zeros(0, np.int64)]
        for between in (0, 1):
            if len(kinds[between]):
                own, count = self._joined(distinct.take(pa.array(kinds[between])), between)
                ids.append(own)
                counts.append(count)
        for chunk in distinct.take(pa.array(kinds[2])).to_pylist():
            ids.append(np.array(self.fast(chunk), dtype="<u2"))
            counts.append(np.array([len(ids[-1])]))
        ends = np.append(0, np.cumsum(2 * np.concatenate(counts))).astype(np.int32)
        laid = pa.BinaryArray.from_buffers(pa.binary(), len(distinct), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(ids))])
        order = np.concatenate(kinds)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return laid.take(pa.array(place))

    def __call__(self, texts: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray]:
        """Of each text the ids and the end token as little-endian 16-bit bytes; their numbers."""
        data, edges = _laid(texts)
        starts, count = chunk_starts(data, edges)
        offset = np.append(starts, len(data)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offset), pa.py_buffer(data)).dictionary_encode()
        known = pa.concat_arrays([self.chunks(chunks.dictionary), pa.array([np.array([END_ID], dtype="<u2").tobytes()], pa.binary())])
        ends = np.cumsum(count)
        spelt = known.take(pa.array(np.insert(chunks.indices.to_numpy(), ends, len(known) - 1)))
        offset = _laid(spelt)[1][np.append(0, ends + np.arange(1, len(ends) + 1))].astype(np.int32)
        ids = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offset), spelt.buffers()[2]])
        special = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        if len(special):
            own = [self.plain(t) + known[-1].as_py() for t in texts.take(pa.array(special)).to_pylist()]
            mask = np.zeros(len(texts), bool)
            mask[special] = True
            ids = pc.replace_with_mask(ids, pa.array(mask), pa.array(own, pa.binary()))
        return ids, pc.binary_length(ids).to_numpy().astype(np.int64) // 2


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def tokenised(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass: ``doc_id, part, start, n, ids``; start counts tokens within the partition.

    ids are 16-bit little-endian with the end token; a vocabulary must have fewer than 65,536 ids.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = _encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + TEXT_BYTES, side="right")))
                piece = batch.slice(low, high - low)
                ids, n = encoder(piece.column(1))
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(n), ids], names=["doc_id", "part", "start", "n", "ids"])
                low = high
            give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(encode, f"doc_id {kind}, part int, start bigint, n bigint, ids binary")


def packed(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Second pass over a written ``tokenised`` table: the pieces, with their ids as 16-bit bytes."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total")).collect()  # a row for each partition
    ahead, offsets = 0, {}
    for row in sorted(totals):
        offsets[row["part"]] = ahead
        ahead += row["total"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            part, start, n = (batch.column(i).to_numpy() for i in (1, 2, 3))
            base = np.array([offsets[p] for p in part.tolist()], dtype=np.int64) + start
            first, last = base // window, (base + n - 1) // window
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            low = np.maximum(seq * window, base[row])
            high = np.minimum((seq + 1) * window, (base + n)[row])
            begin, length = low - base[row], high - low
            ids = [memoryview(x.as_buffer()) for x in batch.column(4)]
            kept = [ids[r][2 * s : 2 * (s + k)].tobytes() for r, s, k in zip(row.tolist(), begin.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(begin), pa.array(length), pa.array(kept, pa.binary()), pa.array(n[row]), pa.array(seq), pa.array(low - seq * window)], names=names)

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(cut, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the packed sequences: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``."""
    tokens, _ = written(tokenised(docs, vocabulary, id_col, text_col), "tokens")
    return packed(tokens, window)


def ids_crc32(pieces: DataFrame) -> DataFrame:
    """``ids`` replaced by ``ids_crc32`` of the ids as unsigned little-endian 32-bit numbers."""
    # in the JVM: a second function in Arrow would need a second worker for each task
    wide = F.unhex(F.regexp_replace(F.hex("ids"), "(.{4})", "$10000"))
    return pieces.select(*[F.crc32(wide).alias("ids_crc32") if name == "ids" else pieces[f"`{name}`"] for name in pieces.columns])
