"""Best-fit packing of tokenised documents into fixed-length sequences.

Bulk-synchronous best fit over a distributed table:

* every document is tokenised where it is read; only those longer than a
  sequence are cut, and the first piece takes the remainder, so all other
  pieces of it fill a sequence on their own;
* the pieces are range-sorted by size.  Every range ranks its rows and reports
  how many it has of each size; the ranges' reports, added up in order, give each
  piece its rank among those of its size.  Equal sizes are one run from there on;
* a *round* lays the runs of unplaced pieces and the runs of open gaps in order
  of size and sweeps them: a gap takes the largest free piece that is no larger
  than itself (the successor relation, read from the piece's side: the smallest
  gap that still holds it).  Where several gaps or pieces contend, *rank*
  decides: a stretch of ranks meets a stretch of gaps one to one, so no piece
  goes to two gaps.  A gap that holds several pieces of the run it meets, all of
  which best fit would put there one after the other, takes them at once;
* gaps shrink by what they took, and the next round begins.  When a round
  matches next to nothing, the largest pieces left open further sequences, as
  many as the tokens left would fill;
* the rounds' verdicts are stretches (size, ranks, sequences, place), which every
  range looks up for its own rows.

The rounds see counts for each size, at most ``most`` numbers however large the
corpus is, so they need no job of their own; rows move once, in the range sort,
and no row is placed but by a round.  The stretches are bounded by sizes and
rounds, not by rows; over ``PLAN_ROWS`` of them are dealt to the ranges instead
of being sent to every task.

Defined results: null text is the empty text, one token (the closing id 0);
special tokens that a text spells out get their own id, as the tokenizer has it;
rows with null or repeated ids are packed each on its own (the id 2^63 - 1 is
reserved and reads as null); ties in size are broken by place in the input; an
empty table gives an empty result; other columns are ignored, whatever their
names.  Very long texts are tokenised whole, one at a time.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_batches, ship
from .shared import drop_written, written

SEQUENCE = 2048
#: Stands for null ids inside the operator.
LAST_ID = (1 << 63) - 1
#: Rows of a range, and the share of gaps or pieces (the fewer) matched up to which further sequences are opened.
RANGE_ROWS, FEW = 250_000, 0.02
#: Up to so many stretches are sent to every task.
PLAN_ROWS = 500_000
#: A worker's memory of encoded words is emptied at so many entries, and after each task.
WORD_MEMORY = 200_000

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


#: The characters for which Python's expressions split as the vocabulary's own do; other texts are encoded whole.
_PLAIN = re.compile(r"[\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*")
_LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
#: The pre-tokenisation that byte-level BPE vocabularies of this kind publish, for those characters.
_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")


def _merge_ranks(path: str) -> dict[bytes, int] | None:
    """Byte strings and ranks of a byte-level BPE file whose ids follow its merges, else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    for k, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        if model["vocab"][left + right] != 256 + k:
            return None
    return ranks


class WordEncoder(dict):
    """Token ids of texts as little-endian bytes, remembering words.

    Byte-level BPE never merges across the pieces of its pre-tokenisation, so a
    text is the concatenation of its encoded pieces.  Pieces that were seen
    before come from memory; the memory is emptied when it is full.
    """

    def __init__(self, path: str):
        super().__init__()
        self.path, self._model = path, None
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        ranks = _merge_ranks(path)
        self.piece = None
        if ranks:
            import tiktoken

            self.piece = tiktoken.Encoding("pieces", pat_str=r"(?s:.)+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORD_MEMORY:
            self.clear()
        ids = self[word] = struct.pack(f"<{len(x)}I", *x) if (x := self.piece(word)) else b""
        return ids

    @property
    def model(self):
        """The tokenizer itself, loaded for the first text that needs it."""
        if self._model is None:
            from tokenizers import Tokenizer

            self._model = Tokenizer.from_file(self.path)
        return self._model

    def ids(self, text: str) -> bytes:
        if self.piece and _PLAIN.fullmatch(text) and not any(t in text for t in self.added):
            return b"".join(map(self.__getitem__, _TOKENS.findall(text)))
        return np.asarray(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens, the first one the shorter."""
    first = n % most or most
    return [(0, min(n, first)), *((s, most) for s in range(first, n, most))]


def pieces(docs: DataFrame, vocabulary: str, most: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece; ``uid`` tells rows apart whatever the ids are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, k = _encoder(vocabulary), TaskContext.get().partitionId() << 36
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = encoder.ids(text if isinstance(text, str) else "") + b"\0\0\0\0"
                for piece, (start, n) in enumerate(cut(len(ids) // 4, most)):
                    rows.append((k, doc_id, piece, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                    k += 1
            yield pd.DataFrame(rows, columns=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])
        encoder.clear()

    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc_id")
    return map_batches(docs.select(key, F.col(text_col).alias("text")), run, PIECES)


# --- ranks: range sort, counts for each range and size -----------------------


def _ranked(sizes: DataFrame, parts: int) -> DataFrame:
    """``sizes`` with pid (its range) and rank (among the rows of its size in that range)."""
    ranged = sizes.repartitionByRange(parts, F.desc("size"), "uid").sortWithinPartitions(F.desc("size"), "uid")
    schema = ", ".join(f"`{n}` {t}" for n, t in sizes.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, last, done = TaskContext.get().partitionId(), -1, 0
        for pdf in batches:
            if not len(pdf):
                continue
            size = pdf["size"].to_numpy("int64")
            first = np.flatnonzero(np.concatenate([[True], size[1:] != size[:-1]]))
            rank = np.arange(len(size)) - np.repeat(first, np.diff(np.append(first, len(size))))
            if size[0] == last:
                rank[size == last] += done
            last, done = int(size[-1]), int(rank[-1]) + 1
            pdf["pid"], pdf["rank"] = pid, rank
            yield pdf

    return map_batches(ranged, run, f"{schema}, pid int, rank long")


# --- rounds: runs of pieces and of gaps --------------------------------------


class Rounds:
    """Rounds of best fit over runs.  ``left``: pieces of each size that are not placed, taken
    from rank 0 upwards; ``gaps``: for each gap the runs (first sequence, sequences) that have it.
    ``plan`` collects stretches (size, first rank, pieces, first sequence, place)."""

    def __init__(self, counts: dict[int, int], most: int):
        self.most, self.left, self.next_rank = most, dict(counts), dict.fromkeys(counts, 0)
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.sequences = 0
        self.plan: list[tuple[int, int, int, int, int]] = []

    def _put(self, size: int, n: int, first: int, place: int) -> None:
        self.plan.append((size, self.next_rank[size], n, first, place))
        self.next_rank[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]

    def open(self, size: int, n: int) -> None:
        """``n`` pieces of a size begin a sequence each."""
        self._put(size, n, self.sequences, 0)
        if size < self.most:
            self.gaps.setdefault(self.most - size, []).append((self.sequences, n))
        self.sequences += n

    def sweep(self) -> int:
        """One round; the number of pieces that it placed."""
        free: list[int] = []  # sizes with pieces, smallest first
        placed, after = 0, {}
        for size in sorted(set(self.left) | set(self.gaps)):
            if size in self.left:
                free.append(size)
            for first, n in self.gaps.get(size, ()):
                while n and free:
                    piece = free[-1]
                    have = self.left[piece]
                    m = min(n, have)
                    # as many for each gap as fit and as there are for all of them
                    times = min(size // piece, have // m)
                    for k in range(times):
                        self._put(piece, m, first, self.most - size + k * piece)
                    placed += m * times
                    if rest := size - times * piece:
                        after.setdefault(rest, []).append((first, m))
                    first, n = first + m, n - m
                    if piece not in self.left:
                        free.pop()
                if n:
                    after.setdefault(size, []).append((first, n))
        self.gaps = after
        return placed

    def run(self) -> None:
        for size in sorted(self.left, reverse=True):
            if 2 * size > self.most:  # no two of these share a sequence
                self.open(size, self.left[size])
        while self.left:
            before = min(sum(self.left.values()), sum(n for runs in self.gaps.values() for _, n in runs))
            placed = self.sweep()
            if self.left:
                least = min(self.left)
                self.gaps = {g: runs for g, runs in self.gaps.items() if g >= least}
                if placed <= FEW * before:
                    # the open sequences are used up
                    want = -(-sum(s * n for s, n in self.left.items()) // self.most)
                    for size in sorted(self.left, reverse=True):
                        n = min(want, self.left[size])
                        self.open(size, n)
                        placed, want = placed + n, want - n
                        if not want:
                            break
            if not placed:
                raise AssertionError("a round of packing placed nothing")


def _placed(pdf: pd.DataFrame, plan: np.ndarray, base: dict[int, int]) -> pd.DataFrame:
    """Rows of one range with their sequence and place; ``base``: its ranks' first number by size."""
    size, rank = pdf["size"].to_numpy("int64"), pdf["rank"].to_numpy("int64")
    kinds, which = np.unique(size, return_inverse=True)
    rank = rank + np.array([base[int(s)] for s in kinds], np.int64)[which]
    out_bin, out_place = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    lo, hi = np.searchsorted(plan[:, 0], kinds, side="left"), np.searchsorted(plan[:, 0], kinds, side="right")
    for k, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        rows = np.flatnonzero(which == k)
        at = a + np.searchsorted(plan[a:b, 1], rank[rows], side="right") - 1
        out_bin[rows], out_place[rows] = plan[at, 3] + rank[rows] - plan[at, 1], plan[at, 4]
    pdf["sequence_id"], pdf["offset"] = out_bin, out_place
    return pdf


def pack(sizes: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """Rows (uid, size from 1 to ``most``, ...) with their sequence_id and offset."""
    schema = ", ".join(f"`{n}` {t}" for n, t in sizes.dtypes)
    ranked = written(_ranked(sizes, max(1, -(-sizes.count() // RANGE_ROWS))), "ranked")
    # a row for each range and size that it has: as many as sizes and ranges together
    reports = sorted(ranked.groupBy("pid", "size").count().collect())
    counts: dict[int, int] = {}
    base: dict[int, dict[int, int]] = {}
    for pid, size, n in reports:
        base.setdefault(pid, {})[size] = counts.get(size, 0)
        counts[size] = counts.get(size, 0) + n
    rounds = Rounds(counts, most)
    rounds.run()
    plan = np.array(sorted(rounds.plan), np.int64).reshape(-1, 5)
    out = f"{schema}, sequence_id long, offset long"
    if len(plan) <= PLAN_ROWS:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for pid, rows in pdf.groupby("pid", sort=False):
                    yield _placed(rows.copy(), plan, base[int(pid)]).drop(columns=["pid", "rank"])

        return map_batches(ranked, run, out)

    def parts_of() -> Iterator[tuple[int, bytes, int]]:
        """Each range's stretches."""
        for pid, sizes_of in base.items():
            mine = plan[np.isin(plan[:, 0], list(sizes_of))]
            first = np.array([sizes_of[s] for s in mine[:, 0].tolist()], np.int64)
            last = first + np.array([here[pid, s] for s in mine[:, 0].tolist()], np.int64)
            mine = mine[(mine[:, 1] < last) & (mine[:, 1] + mine[:, 2] > first)]
            yield pid, mine.tobytes(), len(mine)

    here = {(pid, size): n for pid, size, n in reports}
    dealt = sizes.sparkSession.createDataFrame(pd.DataFrame(parts_of(), columns=["p_pid", "stretches", "n"]), "p_pid int, stretches binary, n long")

    def one(rows: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        pid = int(rows["pid"].iloc[0])
        return _placed(rows, np.frombuffer(mine["stretches"].iloc[0], np.int64).reshape(-1, 5), base[pid]).drop(columns=["pid", "rank"])

    ship(sizes.sparkSession)
    return ranked.groupBy("pid").cogroup(dealt.groupBy("p_pid")).applyInPandas(one, out)


def best_fit_packing(docs: DataFrame, vocabulary: str, most: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = written(pieces(docs, vocabulary, most, id_col, text_col), "pieces")
    packed = pack(rows.withColumn("size", F.col("length")), most)
    drop_written(rows)
    real = F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")).alias("doc_id")
    return packed.select(real, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
