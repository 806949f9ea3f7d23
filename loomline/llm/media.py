"""Media columns: payloads stored as FLAC, read back as PCM blocks with sample offsets.

``encode_media`` turns a text or binary column into FLAC streams, ``pcm_blocks`` turns
streams into rows of samples that start at a known offset, and ``media_features`` reads
streams back and digests what it finds. All three are maps without a shuffle.

Rows are worked on in groups of about ``GROUP_BYTES`` and frames in slices, so memory
follows the longest single row, not the batch.

Defined cases: a null or empty text is a payload of 64 zero bytes; ids may be null or
repeat, each row stands alone; equal payloads give equal streams whatever else shares
their batch; an empty table gives an empty result; a damaged stream raises FlacError
(``on_error="null"`` gives null blocks' row instead); other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac
from .common import arrow_schema, record_batch

PAD = 64
GROUP_BYTES = 1 << 20

MEDIA = "doc_id long, n_bytes long, media binary"
BLOCKS = "doc_id long, sample_offset long, n_samples long, pcm binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(data: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of PAD."""
    return data + bytes(-len(data) % PAD if data else PAD)


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[slice, list[bytes]]]:
    """Runs of rows that hold about GROUP_BYTES together."""
    values, start, held, size = batch.column(column), 0, [], 0
    for i in range(len(values)):
        v = values[i].as_py() or b""
        held.append(v)
        size += len(v)
        if size >= GROUP_BYTES:
            yield slice(start, i + 1), held
            start, held, size = i + 1, [], 0
    if held:
        yield slice(start, start + len(held)), held


def encode_media(df: DataFrame, id_col: str = "doc_id", data_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes before padding, media): each value's bytes, padded, as a FLAC stream."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(MEDIA)
        for batch in batches:
            for rows, values in _groups(batch, 1):
                ids = batch.column(0)[rows].to_pylist()
                streams = flac.encode_many([padded(v) for v in values])
                yield record_batch(list(zip(ids, map(len, values), streams, strict=True)), schema)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(data_col).cast("binary").alias("data")).mapInArrow(encode, MEDIA)


def pcm_blocks(media: DataFrame, on_error: str = "raise") -> DataFrame:
    """One row per PCM block: the samples (signed bytes) and the offset of the first."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(BLOCKS)
        for batch in batches:
            for rows, values in _groups(batch, 1):
                ids = batch.column(0)[rows].to_pylist()
                out = []
                for doc_id, blocks in zip(ids, _decoded(values, on_error), strict=True):
                    if blocks is None:
                        out.append((doc_id, None, None, None))
                    else:
                        out += [(doc_id, at, len(pcm), pcm.astype(np.int8).tobytes()) for at, pcm in blocks]
                yield record_batch(out, schema)

    return media.select("doc_id", "media").mapInArrow(decode, BLOCKS)


def _decoded(streams: list[bytes], on_error: str) -> list:
    try:
        return flac.decode_many(streams)
    except flac.FlacError:
        if on_error == "raise":
            raise
    out = []
    for s in streams:
        try:
            out += flac.decode_many([s])
        except flac.FlacError:
            out.append(None)
    return out


def sample_range(stream: bytes, first: int, count: int) -> np.ndarray:
    """Samples first..first+count of a stream: only the frames that hold them are decoded."""
    info, points, at = flac.parse_metadata(stream)
    stop = min(first + count, info["samples"])
    picked = [i for i, p in enumerate(points) if p[0] < stop and p[0] + p[2] > first]
    if not picked:
        return np.zeros(0, np.int64)
    a = at + points[picked[0]][1]
    b = at + points[picked[-1] + 1][1] if picked[-1] + 1 < len(points) else len(stream)
    starts = np.array([points[i][1] - points[picked[0]][1] for i in picked])
    data = np.frombuffer(stream[a:b], np.uint8)
    pcm = np.concatenate(flac.decode_frames(data, starts, np.append(starts[1:], b - a), info["bits"]))
    base = points[picked[0]][0]
    return pcm[first - base : stop - base]


def feature_of(payload: np.ndarray, blocks: int) -> str:
    """Integer features of the decoded samples: energy, peak, sign changes, total variation, blocks."""
    x = payload.astype(np.int16) - 128
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    variation = int(np.abs(x[1:] - x[:-1]).sum(dtype=np.int64))
    energy = int((x.astype(np.int32) ** 2).sum(dtype=np.int64))
    return f"energy={energy};peak={int(np.abs(x).max())};sign_changes={changes};variation={variation};blocks={blocks}"


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of each stream, from its stored bytes alone."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(FEATURES)
        for batch in batches:
            for rows, streams in _groups(batch, 2):
                head = [c[rows].to_pylist() for c in batch.columns[:2]]
                out = []
                for doc_id, n_bytes, stream, blocks in zip(*head, streams, flac.decode_many(streams), strict=True):
                    payload = (np.concatenate([pcm for _, pcm in blocks]) + 128).astype(np.uint8)
                    raw = payload.tobytes()
                    out.append((doc_id, n_bytes, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-PAD:]), len(stream), hashlib.sha256(stream).hexdigest(), feature_of(payload, len(blocks))))
                yield record_batch(out, schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(digest, FEATURES)
