"""Substring deduplication by content-defined chunks.

A gear hash rolls over each text's bytes (each step shifts the hash left and
adds a random word for the byte, so it depends on the last ``REACH`` bytes
only); a text is cut where ``mask_bits`` high bits of it are zero, at least
``least`` and at most ``most`` bytes after the cut before.  Cuts depend on
content, so an insertion changes the chunks around it and no others.

Chunks are dealt by digest (128 bits), in as many groups as the input's bytes
need.  Inside a run of texts only the earliest of equal chunks travels, so a passage
of all documents costs one entry for each run.  A chunk that starts earlier elsewhere
(smaller id, or further left in the same document) is repeated; neighbouring
repeated chunks form spans, and spans of at least ``span`` bytes are removed.

Parameters (:class:`Chunking`), with their trade-off: chunks are the unit of what
can be found, so they must be well below the passages that are looked for, while
the index has one entry (40 bytes, about 28 compressed) for each.  The defaults,
56 bytes on average, find passages of 50 words; with ``mask_bits`` 10 and ``least``
256 the index shrinks to a few per cent of the text, and finds passages of some
2,000 bytes and more.  ``span`` leaves shorter repeats alone, stock phrases
mostly; 0 removes every repeated chunk.

Defined results: null text is empty; null ids come last (the id 2^63 - 1 is
reserved for them and reads as null); texts that share an id are in the order of
their hash; of rows repeated outright the first keeps what the others lose; an
empty table gives an empty result; other columns are ignored, whatever their
names.  Texts are hashed whole, in stretches, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from ..session import map_batches
from .blobs import BYTE_WORDS, pack_arrays, unpack_arrays
from .shared import written
from .suffix_dedup import _dest, _document_spans, _slices, finish, grouped, groups_for, keyed

REACH = 16


@dataclass(frozen=True)
class Chunking:
    """Sizes of chunks, and of the spans that are removed, in bytes."""

    mask_bits: int = 5
    least: int = 24
    most: int = 512
    span: int = 100

    def __post_init__(self) -> None:
        if not (0 <= self.mask_bits <= REACH and 0 < self.least <= self.most <= 65_535 and self.span >= 0):
            raise ValueError("no such chunks")


STRETCH, RUN = 4 << 20, 24 << 20
GEAR = (BYTE_WORDS >> np.uint64(17)).astype(np.uint16)


def gear_cuts(data: np.ndarray, mask_bits: int) -> np.ndarray:
    """Places after which the rolling hash allows a cut."""
    found = []
    for s in range(0, len(data), STRETCH):
        part = data[max(0, s - REACH + 1) : s + STRETCH]
        h, width = GEAR[part], 1
        # by doubling: the hash of 2w bytes is that of the last w plus that of the first w, shifted
        while width < REACH:
            wide = h.copy()
            wide[width:] += h[:-width] << np.uint16(width)
            h, width = wide, width * 2
        at = np.flatnonzero(h < 1 << (16 - mask_bits)) + max(0, s - REACH + 1)
        found.append(at[at >= s])
    return np.concatenate(found) + 1 if found else np.empty(0, np.int64)


def chunk_ends(data: np.ndarray, how: Chunking) -> list[int]:
    """The ends of the chunks of one text."""
    n, last, out = len(data), 0, []
    for cut in gear_cuts(data, how.mask_bits).tolist():
        while cut - last > how.most:
            last += how.most
            out.append(last)
        if cut - last >= how.least:
            out.append(cut)
            last = cut
    while n - last > how.most:
        last += how.most
        out.append(last)
    if n > last:
        out.append(n)
    return out


CHUNK = np.dtype([("d", "<u8"), ("d2", "<u8"), ("id", "<i8"), ("th", "<i8"), ("start", "<i4"), ("end", "<i4")])


def _packed(c: np.ndarray) -> bytes:
    """Chunks column by column, which compresses better than row by row."""
    return pack_arrays(*[c[f] for f in ("d", "d2", "id", "th", "start")], (c["end"] - c["start"]).astype("<u2"))


def _unpacked(blob: bytes) -> np.ndarray:
    *same, size = unpack_arrays(blob)
    c = np.zeros(len(size), CHUNK)
    for f, x in zip(("d", "d2", "id", "th", "start"), same, strict=True):
        c[f] = x
    c["end"] = c["start"] + size
    return c
SPANS = np.dtype([("id", "<i8"), ("th", "<i8"), ("start", "<i4"), ("end", "<i4")])


def _split_late(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest of each digest, those that come later)."""
    c = c[np.lexsort((c["start"], c["th"], c["id"], c["d2"], c["d"]))]
    new = np.concatenate([[True], (c["d"][1:] != c["d"][:-1]) | (c["d2"][1:] != c["d2"][:-1])])
    first = np.flatnonzero(new)
    lead = c[np.repeat(first, np.diff(np.append(first, len(c))))]
    late = (c["id"] != lead["id"]) | (c["th"] != lead["th"]) | (c["start"] != lead["start"])
    return c[first], c[late]


def _span_blobs(c: np.ndarray, parts: int) -> list[tuple]:
    if not len(c):
        return []
    rec = np.zeros(len(c), SPANS)
    for f in SPANS.names:
        rec[f] = c[f]
    bucket = np.abs(rec["th"] % parts)
    order = np.argsort(bucket, kind="stable")
    return [(2, d, pack_arrays(rec[order][s])) for d, s in _slices(bucket[order], parts)]


def _chunks(parts: int, how: Chunking):
    def emit(found: list[np.ndarray]) -> pd.DataFrame:
        first, late = _split_late(np.concatenate(found))
        out = _span_blobs(late, parts)
        dest = _dest(first["d"], parts)
        order = np.argsort(dest, kind="stable")
        out += [(1, d, _packed(first[order[s]])) for d, s in _slices(dest[order], parts)]
        return pd.DataFrame(out, columns=["kind", "dest", "blob"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, size = [], 0
        for pdf in batches:
            for i, th, data in zip(pdf["id"], pdf["th"], pdf["data"], strict=True):
                ends = chunk_ends(np.frombuffer(data, np.uint8), how)
                if not ends:
                    continue
                starts = [0, *ends[:-1]]
                digests = b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(starts, ends, strict=True)])
                c = np.zeros(len(ends), CHUNK)
                pair = np.frombuffer(digests, "<u8").reshape(-1, 2)
                c["d"], c["d2"], c["id"], c["th"], c["start"], c["end"] = pair[:, 0], pair[:, 1], i, th, starts, ends
                found.append(c)
                size += len(data)
                if size >= RUN:
                    yield emit(found)
                    found, size = [], 0
        if found:
            yield emit(found)

    return rows


def _repeated(parts: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(2, d, b) for k, d, b in zip(pdf["kind"], pdf["dest"], pdf["blob"], strict=True) if k == 2]
        blobs = [_unpacked(b) for k, b in zip(pdf["kind"], pdf["blob"], strict=True) if k == 1]
        if blobs:
            out += _span_blobs(_split_late(np.concatenate(blobs))[1], parts)
        return pd.DataFrame(out, columns=["kind", "dest", "blob"])

    return run


def _long_spans(least: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _document_spans(pdf)
        kept = []
        for i, th, spans in zip(out["id"], out["th"], out["spans"], strict=True):
            s, e = np.frombuffer(spans, "<i4").reshape(2, -1)
            ok = e - s >= least
            if ok.any():
                kept.append((i, th, np.stack([s[ok], e[ok]]).tobytes()))
        return pd.DataFrame(kept, columns=["id", "th", "spans"])

    return run


def repeated_chunks(texts: DataFrame, how: Chunking) -> DataFrame:
    """From rows (id, th, data): id, th, spans of the documents that repeat earlier chunks."""
    parts = groups_for(texts)
    chunks = map_batches(texts, _chunks(parts, how), "kind int, dest long, blob binary")
    late = grouped(chunks, "dest", _repeated(parts), "kind int, dest long, blob binary")
    spans = grouped(late, "dest", _long_spans(how.span), "id long, th long, spans binary")
    return written(spans, "chunk-spans")


def chunk_dedup(docs: DataFrame, how: Chunking | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row of ``docs``."""
    how = how or Chunking()
    texts = keyed(docs, id_col, text_col)
    return finish(texts, repeated_chunks(texts, how), max(1, how.span))
