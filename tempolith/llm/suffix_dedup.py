"""Removal of repeated byte strings by a distributed suffix merge sort.

A byte goes if a string of ``width`` bytes that covers it also starts earlier
(smaller id, or the same document further left), judged on the input.

1. *Anchors.*  In every window of ``width`` bytes the smallest hash of its runs
   of ``GRAM`` bytes marks an anchor (the leftmost of equals): equal windows have equal anchors
   at equal places, and about one place in forty is one.  Only suffixes at
   anchors are sorted; each stands for the windows that chose it.
2. *Candidates.*  Anchor hashes are dealt by value; those that occur once in all
   documents cannot belong to a repeated window and end here.
3. *Runs.*  Where a text is read again, the candidate suffixes (the text from
   the anchor on, as far as its windows reach, then what its windows cover to
   the left) are sorted to runs; inside a run only the earliest of equal ones
   goes on, the others are settled, so a passage that all documents share
   costs one entry for each run.  Runs are exchanged front-coded: the length of
   the prefix shared with the entry before, and the rest.
4. *Merge.*  A loser tree whose nodes keep the common prefix with the last
   winner merges the runs; it compares characters only beyond prefixes it
   knows.  Entries that share their whole length are one string: all but the
   earliest are removed.  Entries that share only the anchor's run overlap in
   part; their windows meet by a hash of all ``width`` bytes inside the merged
   interval, and those that meet are compared byte by byte.
5. Anchors that occur more than ``HOT`` times (a skewed key) are spread: dealt by
   the whole suffix, merged likewise, and their windows, bytes and all, dealt by the
   window's hash in one more exchange.

No byte is removed on the word of a hash.  The number of groups follows the bytes
of the input (``PART`` bytes of text each), so no group grows with it.  Widths
from ``GRAM`` to ``GRAM + 254`` are supported, others are a ValueError.

Defined results: null text is empty; texts shorter than ``width`` lose nothing;
null ids come last in the order (the id 2^63 - 1 is reserved for them and reads as
null); texts that share an id are in the order of their hash; of rows repeated
outright the first keeps what the others lose.  An empty table gives an empty
result.  Other columns are ignored, whatever their names.  Long texts are cut into
overlapping stretches and lose nothing by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import map_batches
from .blobs import gram_hashes, merge_spans, pack_arrays, sliding_min, unpack_arrays
from .shared import drop_written, shuffle_parts, written

WIDTH, GRAM = 100, 24
#: Bytes of text that are hashed at a time, and that make a run.
STRETCH, RUN = 1 << 21, 16 << 20
#: Bytes of text for each group of an exchange, and the occurrences from which an anchor is spread.
PART, HOT = 12 << 20, 20_000
#: Windows that are compared at a time, beyond those of one anchor.
SLICE = 200_000
LAST_ID = (1 << 63) - 1

KEYED = ["id", "th"]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    return docs.select(key.alias("id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("data"))


def anchors_of(data: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(hash, first window, windows, anchor) of each anchor of one text."""
    n = len(data) - width + 1
    found = []
    for s in range(0, max(n, 0), STRETCH):
        part = data[s : min(s + STRETCH, n) + width - 1]
        h = gram_hashes(part, GRAM)
        packed = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        place = (sliding_min(packed, width - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        found.append((h[place[first]], first + s, np.diff(np.append(first, len(place))), place[first] + s))
    if not found:
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e, e
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _dest(h: np.ndarray, parts: int) -> np.ndarray:
    # anchors are minima, so their hashes crowd near zero: spread them first
    with np.errstate(over="ignore"):
        spread = h * np.uint64(0x9E3779B97F4A7C15)
    return ((spread >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _slices(dest: np.ndarray, parts: int):
    """(destination, rows) for each destination that has rows; ``dest`` is sorted."""
    at = np.searchsorted(dest, np.arange(parts + 1))
    return [(d, slice(a, b)) for d, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]


def _anchor_blobs(parts: int, width: int):
    """Anchors of all texts, as (dest, run, data); the documents of a run, as a blob with kind 0."""

    def emit(run: int, ids: list, ths: list, found: list) -> Iterator[tuple]:
        yield run % parts, run, 0, pack_arrays(np.array(ids, np.int64), np.array(ths, np.int64))
        h, first, count, anchor, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        dest = _dest(h, parts)
        order = np.lexsort((h, dest))
        h, first, count, anchor, doc, dest = (x[order] for x in (h, first, count, anchor, doc, dest))
        for d, s in _slices(dest, parts):
            yield d, run, 1, pack_arrays(h[s], doc[s].astype(np.int32), first[s].astype(np.int32), count[s].astype(np.uint8), (anchor[s] - first[s]).astype(np.uint8))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, size = TaskContext.get().partitionId() << 24, 0
        ids, ths, found = [], [], []
        for pdf in batches:
            for i, th, data in zip(pdf["id"], pdf["th"], pdf["data"], strict=True):
                if len(data) < width:
                    continue
                a = anchors_of(np.frombuffer(data, np.uint8), width)
                found.append((*a, np.full(len(a[0]), len(ids), np.int32)))
                ids.append(i)
                ths.append(th)
                size += len(data)
                if size >= RUN:
                    yield pd.DataFrame(list(emit(run, ids, ths, found)), columns=["dest", "run", "kind", "blob"])
                    run, size, ids, ths, found = run + 1, 0, [], [], []
        if ids:
            yield pd.DataFrame(list(emit(run, ids, ths, found)), columns=["dest", "run", "kind", "blob"])

    return rows


def _candidates(pdf: pd.DataFrame) -> pd.DataFrame:
    """All anchors of one destination: for each run those that are not alone."""
    tables = pdf[pdf["kind"] == 0]
    out = list(zip(tables["run"], [0] * len(tables), tables["blob"], strict=True))
    blobs = pdf[pdf["kind"] == 1].sort_values("run")
    if len(blobs):
        parts = [unpack_arrays(b) for b in blobs["blob"]]
        every = np.concatenate([p[0] for p in parts])
        every.sort()
        start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        times = np.diff(np.append(start, len(every)))
        many, counts = every[start][times > 1], times[times > 1]
        for run, (h, doc, first, count, back) in zip(blobs["run"], parts, strict=True):
            if len(many):
                at = np.minimum(np.searchsorted(many, h), len(many) - 1)
                hit = many[at] == h
                if hit.any():
                    out.append((run, 1, pack_arrays(doc[hit], first[hit], count[hit], back[hit], counts[at[hit]] > HOT)))
    return pd.DataFrame(out, columns=["run", "kind", "blob"])


def _by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a run, a row for each document."""
    table = pdf[pdf["kind"] == 0]["blob"].tolist()
    blobs = pdf[pdf["kind"] == 1]["blob"].tolist()
    if not table or not blobs:
        return pd.DataFrame({"id": pd.Series(dtype="int64"), "th": pd.Series(dtype="int64"), "found": pd.Series(dtype=object)})
    ids, ths = unpack_arrays(table[0])
    doc, first, count, back, hot = (np.concatenate(x) for x in zip(*(unpack_arrays(b) for b in blobs), strict=True))
    order = np.lexsort((first, doc))
    doc, first, count, back, hot = (x[order] for x in (doc, first, count, back, hot))
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    end = np.append(at[1:], len(doc))
    rec = np.rec.fromarrays([first, count, back, hot.astype(np.uint8)], dtype=CAND)
    return pd.DataFrame({"id": ids[doc[at]], "th": ths[doc[at]], "found": [rec[a:b].tobytes() for a, b in zip(at, end, strict=True)]})


CAND = np.dtype([("first", "<i4"), ("count", "u1"), ("back", "u1"), ("hot", "u1")])


# --- front-coded runs and their merge ---------------------------------------


def common_prefixes(keys: list[bytes]) -> np.ndarray:
    """Of sorted keys: the length of the prefix each shares with the one before."""
    out = np.zeros(len(keys), np.int64)
    size = np.array([len(k) for k in keys])
    for s in range(1, len(keys), 20_000):
        part = keys[s - 1 : s + 20_000]
        wide = int(size[s - 1 : s + 20_000].max())
        grid = np.frombuffer(b"".join(k.ljust(wide, b"\0") for k in part), np.uint8).reshape(len(part), wide)
        same = grid[1:] == grid[:-1]
        n = np.where(same.all(axis=1), wide, same.argmin(axis=1))
        out[s : s + len(part) - 1] = np.minimum(n, np.minimum(size[s : s + len(part) - 1], size[s - 1 : s + len(part) - 2]))
    return out


def front_code(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shared = common_prefixes(keys)
    rest = b"".join(k[n:] for k, n in zip(keys, shared.tolist(), strict=True))
    return shared.astype(np.uint16), np.array([len(k) for k in keys], np.uint16), np.frombuffer(rest, np.uint8)


def decode(shared: np.ndarray, size: np.ndarray, rest: np.ndarray) -> Iterator[tuple[bytes, int]]:
    data, at, key = rest.tobytes(), 0, b""
    for n, m in zip(shared.tolist(), size.tolist(), strict=True):
        key = key[:n] + data[at : at + m - n]
        at += m - n
        yield key, n


def _differ(a: bytes, b: bytes, n: int) -> int:
    """The length of the common prefix, of which ``n`` bytes are known."""
    end, step = min(len(a), len(b)), 16
    while n < end:
        if a[n : n + step] == b[n : n + step]:
            n += step
        elif step == 1:
            return n
        else:
            step = max(1, step // 4)
    return end


class LoserTree:
    """Merges sorted runs of (key, prefix shared with the run's entry before).

    Each inner node holds the run that lost there, with the length of the prefix
    that its head shares with the winner it lost to.  When the winner's run moves
    on, its new head knows its prefix with the last winner, and so does every
    loser on its path; the longer prefix is the smaller key, and only equal
    lengths need characters, beyond that length.
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int]]]):
        self.runs = runs
        self.leaves = 1 << max(0, (len(runs) - 1).bit_length())
        self.heads: list[bytes | None] = [None] * self.leaves
        self.known = [0] * self.leaves
        for i, r in enumerate(runs):
            head = next(r, None)
            if head:
                self.heads[i], self.known[i] = head[0], 0
        self.tree = [0] * self.leaves
        self.tree[0] = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.leaves:
            return node - self.leaves
        win, lose = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.tree[node] = lose
        return win

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes that with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = self.known[a], self.known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = _differ(x, y, p)
        if n < len(x) and (n == len(y) or x[n] > y[n]):
            self.known[a] = n
            return b, a
        self.known[b] = n
        return a, b

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        """(run, key, prefix shared with the key before) in order."""
        tree, heads, known, runs, leaves, play = self.tree, self.heads, self.known, self.runs, self.leaves, self._play
        win = tree[0]
        while (key := heads[win]) is not None:
            yield win, key, known[win]
            head = next(runs[win], None)
            if head is None:
                heads[win] = None
            else:
                heads[win], known[win] = head
            node = (win + leaves) >> 1
            while node:
                win, tree[node] = play(win, tree[node])
                node >>= 1
            tree[0] = win


META = np.dtype([("id", "<i8"), ("th", "<i8"), ("first", "<i4"), ("count", "u1"), ("back", "u1"), ("hot", "u1")])
SPAN = np.dtype([("id", "<i8"), ("th", "<i8"), ("start", "<i4"), ("end", "<i4")])


def _spans(id_: np.ndarray, th: np.ndarray, start: np.ndarray, end: np.ndarray, parts: int) -> list[tuple]:
    """Removed spans as (2, bucket of the document, blob)."""
    if not len(id_):
        return []
    rec = np.rec.fromarrays([id_, th, start, end], dtype=SPAN)
    bucket = np.abs(th % parts)
    order = np.argsort(bucket, kind="stable")
    rec = rec[order]
    return [(2, d, pack_arrays(rec[s])) for d, s in _slices(bucket[order], parts)]


def _runs(parts: int, width: int):
    """Texts with their candidates -> sorted, front-coded runs by destination, and settled spans."""

    def emit(keys: list[bytes], meta: np.ndarray) -> list[tuple]:
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys, meta = [keys[i] for i in order], meta[order]
        shared = common_prefixes(keys)
        size = np.array([len(k) for k in keys])
        new = np.concatenate([[True], ~((shared[1:] == size[1:]) & (size[1:] == size[:-1]))])
        group = np.cumsum(new) - 1
        # the earliest of each group of equal keys
        rank = np.lexsort((meta["first"], meta["th"], meta["id"], group))
        best = rank[np.flatnonzero(np.concatenate([[True], group[rank][1:] != group[rank][:-1]]))]
        lead = meta[best][group]
        late = (meta["id"] != lead["id"]) | (meta["th"] != lead["th"]) | (meta["first"] != lead["first"])
        gone = meta[late]
        out = _spans(gone["id"], gone["th"], gone["first"].astype(np.int32), gone["first"] + gone["count"].astype(np.int32) - 1 + width, parts)
        keys, meta = [keys[i] for i in best], meta[best]
        gram = np.frombuffer(b"".join(k[:GRAM] for k in keys), np.uint8).reshape(-1, GRAM)
        dest = _dest(gram_hashes(gram.ravel(), GRAM)[::GRAM], parts)
        hot = np.flatnonzero(meta["hot"])
        for i in hot:
            dest[i] = int.from_bytes(hashlib.blake2b(keys[i], digest_size=4).digest(), "little") % parts
        order = np.argsort(dest, kind="stable")
        for d, s in _slices(dest[order], parts):
            part = [keys[i] for i in order[s]]
            out.append((1, d, pack_arrays(*front_code(part), meta[order[s]])))
        return out

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: list[bytes] = []
        metas: list[np.ndarray] = []
        size = 0
        for pdf in batches:
            for i, th, data, found in zip(pdf["id"], pdf["th"], pdf["data"], pdf["found"], strict=True):
                c = np.frombuffer(found, CAND)
                meta = np.zeros(len(c), META)
                meta["id"], meta["th"] = i, th
                for f in CAND.names:
                    meta[f] = c[f]
                metas.append(meta)
                for first, count, back in zip(c["first"].tolist(), c["count"].tolist(), c["back"].tolist(), strict=True):
                    a = first + back
                    # from the anchor on, then what lies before it, then the lengths, so that equal keys are equal strings
                    keys.append(data[a : first + count - 1 + width] + data[first:a] + bytes((count, back)))
                    size += count + width
                if size >= RUN:
                    yield pd.DataFrame(emit(keys, np.concatenate(metas)), columns=["kind", "dest", "blob"])
                    keys, metas, size = [], [], 0
        if keys:
            yield pd.DataFrame(emit(keys, np.concatenate(metas)), columns=["kind", "dest", "blob"])

    return rows


WINDOWS = np.dtype([("h", "<u8"), ("id", "<i8"), ("th", "<i8"), ("start", "<i4")])


def _window_rows(texts: list[bytes], meta: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row for each window of entries, texts being their strings in order; all windows of the
    strings' bytes, and the place of each row's window among them."""
    out = np.zeros(int(meta["count"].astype(np.int64).sum()), WINDOWS)
    data = np.frombuffer(b"".join(texts), np.uint8)
    h = gram_hashes(data, width)
    size = np.array([len(t) for t in texts])
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    count = meta["count"].astype(np.int64)
    which = np.repeat(np.arange(len(texts)), count)
    k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    at = base[which] + k
    out["h"], out["id"], out["th"], out["start"] = h[at], meta["id"][which], meta["th"][which], meta["first"][which] + k
    return out, np.lib.stride_tricks.sliding_window_view(data, width), at


def _late_windows(w: np.ndarray, view: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The windows whose string (row ``at`` of ``view``) also starts earlier."""
    order = np.lexsort((w["start"], w["th"], w["id"], w["h"]))
    w, at = w[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], w["h"][1:] != w["h"][:-1]]))
    lead = np.repeat(first, np.diff(np.append(first, len(w))))
    apart = lambda i, j: (w["id"][i] != w["id"][j]) | (w["th"][i] != w["th"][j]) | (w["start"][i] != w["start"][j])
    late = apart(np.arange(len(w)), lead)
    clash: set[int] = set()
    for rows in np.array_split(np.flatnonzero(late), max(1, late.sum() // 20_000)):
        clash.update(lead[rows[(view[at[rows]] != view[at[lead[rows]]]).any(axis=1)]].tolist())
    for g in clash:  # strings with one hash that are not equal
        leads: dict[bytes, int] = {}
        for i in np.flatnonzero(lead == g).tolist():
            late[i] = bool(apart(i, leads.setdefault(view[at[i]].tobytes(), i)))
    return w[late]


def _window_spans(w: np.ndarray, width: int, parts: int) -> list[tuple]:
    return _spans(w["id"], w["th"], w["start"], w["start"] + np.int32(width), parts) if len(w) else []


def _text_of(key: bytes, back: int) -> bytes:
    return key[len(key) - 2 - back : -2] + key[: len(key) - 2 - back]


def _merge(parts: int, width: int):
    """One destination: its runs -> removed spans (2) and, of hot anchors, windows (3)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = [(2, d, b) for k, d, b in zip(pdf["kind"], pdf["dest"], pdf["blob"], strict=True) if k == 2]
        blobs = [unpack_arrays(b) for k, b in zip(pdf["kind"], pdf["blob"], strict=True) if k == 1]
        if not blobs:
            return pd.DataFrame(out, columns=["kind", "dest", "blob"])
        metas, place = [b[3] for b in blobs], [0] * len(blobs)
        order_meta: list[int] = []
        offsets = np.concatenate([[0], np.cumsum([len(m) for m in metas])]).tolist()
        every = np.concatenate(metas)
        group, interval = [], []  # of each entry in order: its string, its anchor
        g = i = -1
        texts: list[bytes] = []  # of the groups
        last = 0
        for r, key, shared in LoserTree([decode(*b[:3]) for b in blobs]):
            n = len(key)
            if shared != n or n != last:
                g += 1
                texts.append(key)
                if shared < GRAM:
                    i += 1
            last = n
            order_meta.append(offsets[r] + place[r])
            place[r] += 1
            group.append(g)
            interval.append(i)
        meta, group, interval = every[order_meta], np.array(group), np.array(interval)
        rank = np.lexsort((meta["first"], meta["th"], meta["id"], group))
        best = rank[np.flatnonzero(np.concatenate([[True], group[rank][1:] != group[rank][:-1]]))]
        lead = meta[best][group]
        late = (meta["id"] != lead["id"]) | (meta["th"] != lead["th"]) | (meta["first"] != lead["first"])
        gone = meta[late]
        out += _spans(gone["id"], gone["th"], gone["first"], gone["first"] + gone["count"].astype(np.int32) - 1 + width, parts)
        # anchors with several strings: their windows
        reps, where = meta[best], interval[best]
        several = np.bincount(where, minlength=i + 1)[where] > 1
        pick = np.flatnonzero(several & (reps["hot"] == 0))
        # an interval lies in one slice, so that slices can be compared one by one
        cuts = np.flatnonzero(np.concatenate([[True], where[pick][1:] != where[pick][:-1]])) if len(pick) else np.empty(0, int)
        k, ends = 0, np.append(cuts[1:], len(pick))
        windows = np.cumsum(reps["count"][pick].astype(np.int64))
        while k < len(cuts):
            done = windows[cuts[k] - 1] if cuts[k] else 0
            end = max(k + 1, int(np.searchsorted(windows[ends - 1], done + SLICE, side="right")))
            rows = pick[cuts[k] : cuts[end] if end < len(cuts) else len(pick)]
            windows_of = _window_rows([_text_of(texts[x], int(reps["back"][x])) for x in rows], reps[rows], width)
            out += _window_spans(_late_windows(*windows_of), width, parts)
            k = end
        for s in range(0, len(hot := np.flatnonzero(reps["hot"])), 2_000):
            rows = hot[s : s + 2_000]
            w, view, at = _window_rows([_text_of(texts[x], int(reps["back"][x])) for x in rows], reps[rows], width)
            dest = _dest(w["h"], parts)
            # windows that follow each other stay together: their bytes compress to little more than one each
            order = np.argsort(dest, kind="stable")
            out += [(3, d, pack_arrays(w[order[sl]], view[at[order[sl]]])) for d, sl in _slices(dest[order], parts)]
        return pd.DataFrame(out, columns=["kind", "dest", "blob"])

    return run


def _hot_windows(parts: int, width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, view = (np.concatenate(x) for x in zip(*map(unpack_arrays, pdf["blob"]), strict=True))
        return pd.DataFrame(_window_spans(_late_windows(w, view, np.arange(len(w))), width, parts), columns=["kind", "dest", "blob"])

    return run


def _document_spans(pdf: pd.DataFrame) -> pd.DataFrame:
    rec = np.concatenate([unpack_arrays(b)[0] for b in pdf["blob"]])
    rec = rec[np.lexsort((rec["start"], rec["th"], rec["id"]))]
    at = np.flatnonzero(np.concatenate([[True], (rec["id"][1:] != rec["id"][:-1]) | (rec["th"][1:] != rec["th"][:-1])]))
    out = []
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(rec)], strict=True):
        s, e = merge_spans(rec["start"][a:b], rec["end"][a:b])
        out.append((rec["id"][a], rec["th"][a], np.stack([s, e]).astype("<i4").tobytes()))
    return pd.DataFrame(out, columns=["id", "th", "spans"])


def apply_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for i, th, data, spans in zip(pdf["id"], pdf["th"], pdf["data"], pdf["spans"], strict=True):
            if spans is None:
                out.append((i, th, len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                continue
            s, e = np.frombuffer(spans, "<i4").reshape(2, -1)
            digest, at = hashlib.sha256(), 0
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            out.append((i, th, len(data), int((e - s).sum()), len(s), digest.hexdigest()))
        yield pd.DataFrame(out, columns=["id", "th", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


RESULT = "id long, th long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def grouped(df: DataFrame, key: str, f, schema: str) -> DataFrame:
    from ..session import ship

    ship(df.sparkSession)
    return df.groupBy(key).applyInPandas(f, schema)


def groups_for(texts: DataFrame) -> int:
    """Groups of an exchange: as many as the session's shuffles have, more if the texts are long."""
    size = texts.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    return max(shuffle_parts(texts.sparkSession), -(-size // PART))


def repeated_spans(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """From rows (id, th, data): id, th, spans (two rows of little-endian ints) of documents that lose bytes."""
    if not GRAM <= width <= GRAM + 254:
        raise ValueError(f"width must be from {GRAM} to {GRAM + 254}")
    parts = groups_for(texts)
    anchors = map_batches(texts, _anchor_blobs(parts, width), "dest long, run long, kind int, blob binary")
    found = grouped(anchors, "dest", _candidates, "run long, kind int, blob binary")
    cands = written(grouped(found, "run", _by_document, "id long, th long, found binary"), "candidates")
    cands_once = cands.dropDuplicates(KEYED)
    joined = texts.join(cands_once.hint("shuffle_hash"), KEYED)
    runs = map_batches(joined.select("id", "th", "data", "found"), _runs(parts, width), "kind int, dest long, blob binary")
    merged = written(grouped(runs, "dest", _merge(parts, width), "kind int, dest long, blob binary"), "merged")
    hot = grouped(merged.where("kind = 3"), "dest", _hot_windows(parts, width), "kind int, dest long, blob binary")
    spans = merged.where("kind = 2").unionByName(hot)
    spans = written(grouped(spans, "dest", _document_spans, "id long, th long, spans binary"), "spans")
    drop_written(cands, merged)
    return spans


def finish(texts: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    """Counts and digest of each document, from its removed spans.  Of rows repeated
    outright all but one lose everything, if they have ``least`` bytes."""
    marked = texts.join(spans.hint("shuffle_hash"), KEYED, "left").select("id", "th", "data", "spans")
    out = map_batches(marked, apply_spans, RESULT)
    again = F.row_number().over(Window.partitionBy("id", "th").orderBy("id")) > 1
    whole = again & (F.col("n_bytes") >= least)
    nothing = hashlib.sha256(b"").hexdigest()
    return out.withColumn("whole", whole).select(
        F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"),
        "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(F.col("whole"), F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(F.col("whole"), F.lit(nothing)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def suffix_dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row of ``docs``."""
    texts = keyed(docs, id_col, text_col)
    return finish(texts, repeated_spans(texts, width), width)
