"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

* A document's set of ``shingle``-word shingles is hashed to 64 bits; documents
  with equal sets form one class from there on (a fingerprint of 128 bits), so
  thousands of copies cost one member.
* SuperMinHash: each element walks a random permutation of the signature's
  places; its j-th step offers rank j plus a random fraction to one place.  A
  document is done when no place can be improved by a later step, which for
  long documents is after one or two.
* ``BANDS`` bands of ``ROWS`` places: sets with a similarity of 0.8 share a band
  with probability 1 - 3e-6.
* *Star links.*  In each bucket the member that shares most buckets with others
  is the pivot; every other member is verified against it on the full sets.
* *The rest.*  Buckets whose members are not yet connected go on: members
  outside the pivot's component are compared with all others, in tiles of
  bounded size.  A tile indexes its members' shingles and looks up the rarest
  fifth of each set, of which a partner at the threshold must have one; nothing
  is capped and no link between components is lost.
* Components: edges are contracted by union-find inside each partition, then by
  alternating large-star and small-star rounds over written tables.

Defined results: null or blank text has no shingles, is linked with nothing and
is kept; fewer words than a shingle form one shingle; null ids come last and
their component id is null (the id 2^63 - 1 is reserved for them); ties, as between
pivots, go to the larger id and never change a component; rows repeated outright
share everything.  Very long texts are hashed whole, one at a time.  An empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_batches, ship
from .blobs import BYTE_WORDS
from .mixing import mix64
from .shared import drop_written, written
from .suffix_dedup import LAST_ID, keyed

PLACES, ROWS = 96, 4
BANDS = PLACES // ROWS
PERCENT = 80
#: Bytes of text that are hashed together; members of a tile's side, and their shingles on average.
STRETCH = 1 << 20
TILE, TILE_SHINGLES = 2048, 1 << 19
_BASE = 0xD6E8FEB86659FD93


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, _BASE, np.uint64)
        down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


#: Bytes whose powers are in memory at a time.
SEGMENT = 1 << 18


@lru_cache(maxsize=1)
def _segment_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(SEGMENT + 1)


def word_hashes(data: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each run of bytes that are not blank (the last byte is), segment by
    segment: memory beside the words themselves does not grow with the text."""
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        s0 = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, s0 + SEGMENT, side="right")))
        part = data[s0 : end[j - 1]]
        up, down = _segment_powers() if len(part) <= SEGMENT else _powers(len(part) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_WORDS[part] * up[: len(part)], dtype=np.uint64)])
            a, b = start[i:j] - s0, end[i:j] - s0
            out[i:j] = mix64((total[b] - total[a]) * down[a])
        i = j
    return out, start


def shingle_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingles of text i are hashes[bounds[i]:bounds[i + 1]], sorted."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    size = np.array([len(t) + 1 for t in texts])
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    word, start = word_hashes(data, blank)
    with np.errstate(over="ignore"):
        doc = np.searchsorted(np.cumsum(size), start, side="right")
        n_words = np.bincount(doc, minlength=len(texts))
        first = np.cumsum(n_words) - n_words
        place = np.arange(len(word)) - first[doc]
        salt = lambda j: mix64(np.asarray(j, np.uint64) + np.uint64(0x51ED27)) | np.uint64(1)
        full = np.flatnonzero(place + k <= n_words[doc])
        h = np.zeros(len(full), np.uint64)
        for j in range(k):
            h += mix64(word[full + j] * salt(j))
        short = np.flatnonzero((n_words[doc] < k))
        owner = doc[full]
        if len(short):
            piece = mix64(word[short] * salt(place[short]))
            docs, at = np.unique(doc[short], return_index=True)
            h = np.concatenate([h, np.add.reduceat(piece, at) + salt(n_words[docs] + 1000)])
            owner = np.concatenate([owner, docs])
        h = mix64(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.empty(0, bool)
    h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def super_min_hash(h: np.ndarray, bounds: np.ndarray, places: int = PLACES) -> np.ndarray:
    """A signature of ``places`` ranks for each set; empty sets keep the largest rank everywhere."""
    n = len(bounds) - 1
    sig = np.full(n * places, 0xFFFFFFFF, np.uint32)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    state, perm = h, None
    for j in range(places):
        if not len(doc):
            break
        with np.errstate(over="ignore"):
            r = mix64(state + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & (1 << 64) - 1))
        k = j + ((r >> np.uint64(32)) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)
        rank = np.uint32(j << 24) | (r & np.uint64(0xFFFFFF)).astype(np.uint32)
        if perm is None:
            to = k
        else:
            rows = np.arange(len(doc))
            to = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
        np.minimum.at(sig, doc * places + to, rank)
        # later steps offer at least j + 1: a document is done when every place is below that
        active = sig.reshape(n, places).max(axis=1) >= np.uint32((j + 1) << 24)
        go = active[doc]
        if perm is None:
            first = k[go]
            perm = np.tile(np.arange(places, dtype=np.uint8), (len(first), 1))
            perm[np.arange(len(first)), first] = 0
        elif not go.all():
            perm = perm[go]
        doc, state = doc[go], state[go]
    return sig.reshape(n, places)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band, the band's number mixed in."""
    n, bands = len(sig), sig.shape[1] // rows
    out = np.tile(np.arange(bands, dtype=np.uint64) + np.uint64(77), (n, 1))
    part = sig.reshape(n, bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            out = mix64(out * np.uint64(0xA0761D6478BD642F) + part[:, :, r])
    return out.view(np.int64)


def _stretches(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    size = pdf["data"].str.len().cumsum().to_numpy()
    at = 0
    while at < len(pdf):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + STRETCH)))
        yield pdf.iloc[at:end]
        at = end


def fingerprints(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two sums of hashes for each text; those of texts without shingles mean nothing."""
    with np.errstate(over="ignore"):
        # the zero at the end keeps the bounds of blank texts there in range
        return np.stack([np.add.reduceat(np.append(mix64(h ^ np.uint64(c)), np.uint64(0)), bounds[:-1]) for c in (0x1234567, 0xABCDEF0123)], axis=1)


SKETCH = "id long, th long, n_shingles long, print binary, bands array<long>"


def _sketch(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for pdf in _stretches(whole):
                h, bounds = shingle_hashes(pdf["data"].tolist(), k)
                n = np.diff(bounds)
                prints = fingerprints(h, bounds)
                keys = band_keys(super_min_hash(h, bounds))
                yield pd.DataFrame({"id": pdf["id"], "th": pdf["th"], "n_shingles": n, "print": [p.tobytes() for p in prints], "bands": list(keys)})

    return run


def _sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for pdf in _stretches(whole):
                h, bounds = shingle_hashes(pdf["data"].tolist(), k)
                yield pd.DataFrame({"id": pdf["id"], "th": pdf["th"], "elements": [h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]})

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            yield pdf.loc[ok, ["a_id", "a_th", "b_id", "b_th"]]

    return run


def tile_links(sets: list[np.ndarray], component: np.ndarray, seek: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (a member sought for, another of another component) at the threshold."""
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    found = []
    for x in seek.tolist():
        s = sets[x]
        lo, hi = np.searchsorted(element, s, side="left"), np.searchsorted(element, s, side="right")
        n = len(s)
        need = n - -(-n * percent // 100) + 1
        rare = np.argsort(hi - lo, kind="stable")[:need]
        posts = [owner[a:b] for a, b in zip(lo[rare], hi[rare], strict=True)]
        for y in np.unique(np.concatenate(posts)).tolist() if posts else []:
            if component[y] != component[x]:
                m = len(sets[y])
                if 100 * min(n, m) >= percent * max(n, m) and similar(s, sets[y], percent):
                    found.append((x, y))
    return found


def _tile(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # a member may come twice, as one to seek and as one of all
        pdf = pdf.sort_values("seek", ascending=False).drop_duplicates(["a_id", "a_th"])
        sets = [np.frombuffer(x, np.uint64) for x in pdf["elements"]]
        component = pdf.groupby(["r_id", "r_th"], sort=False).ngroup().to_numpy()
        pairs = tile_links(sets, component, np.flatnonzero(pdf["seek"].to_numpy()), percent)
        a, b = [x for x, _ in pairs], [y for _, y in pairs]
        i, t = pdf["a_id"].to_numpy(), pdf["a_th"].to_numpy()
        return pd.DataFrame({"a_id": i[a], "a_th": t[a], "b_id": i[b], "b_th": t[b]})

    return run


LINK = "a_id long, a_th long, b_id long, b_th long"


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of a partition, batch by batch: each batch's edges
    become at most one for each node, to the smallest node it is known to be with."""
    for pdf in batches:
        parent: dict[tuple, tuple] = {}

        def root(x: tuple) -> tuple:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent[x]
            return top

        for a, b in zip(zip(pdf["a_id"], pdf["a_th"], strict=True), zip(pdf["b_id"], pdf["b_th"], strict=True), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        rows = [(*x, *r) for x in list(parent) if (r := root(x)) != x]
        yield pd.DataFrame(rows, columns=["a_id", "a_th", "b_id", "b_th"]).astype("int64")


def _node(prefix: str):
    return F.struct(F.col(f"{prefix}_id").alias("id"), F.col(f"{prefix}_th").alias("th"))


def components(links: DataFrame) -> DataFrame:
    """node (struct id, th), root: a row for each node that has links."""
    edges = map_batches(links.select("a_id", "a_th", "b_id", "b_th"), _contract, LINK)
    edges = written(edges.select(_node("a").alias("u"), _node("b").alias("v")).distinct(), "edges")
    while True:
        # large star: larger neighbours go to the smallest of the neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        # small star: a node's smaller neighbours, and itself, go to the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_written(large)
        mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        same = mark(new) == mark(edges)
        drop_written(edges)
        edges = new
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x = sets.select(F.col("id").alias("a_id"), F.col("th").alias("a_th"), F.col("elements").alias("x"))
    y = sets.select(F.col("id").alias("b_id"), F.col("th").alias("b_th"), F.col("elements").alias("y"))
    return pairs.join(x, ["a_id", "a_th"]).join(y, ["b_id", "b_th"]).select("a_id", "a_th", "b_id", "b_th", "x", "y")


def groups(texts: DataFrame, shingle: int, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(sketches, roots): a row (id, th, n_shingles, print) for each text; for each print the
    id and th of the first document of its component."""
    sketches = written(map_batches(texts, _sketch(shingle), SKETCH), "sketches")
    classes = sketches.where("n_shingles > 0").groupBy("print").agg(F.min(F.struct("id", "th", "bands", "n_shingles")).alias("c"))
    classes = written(classes.select("print", F.struct("c.id", "c.th").alias("node"), "c.bands", "c.n_shingles"), "classes")

    member = classes.select("node", "n_shingles", F.explode("bands").alias("key"))
    crowd = member.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = written(member.join(crowd, "key"), "members")
    score = member.groupBy("node").agg(F.sum("n").alias("score"))
    pivot = member.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node")).alias("p")).select("key", F.col("p.node").alias("pivot"))
    pivot = written(pivot, "pivots")
    pairs = member.join(pivot, "key").where("node <> pivot").select("node", "pivot").distinct()
    pairs = pairs.select(F.col("node.id").alias("a_id"), F.col("node.th").alias("a_th"), F.col("pivot.id").alias("b_id"), F.col("pivot.th").alias("b_th"))

    wanted = member.select("node").distinct().select("node.id", "node.th")
    once = texts.join(wanted.hint("shuffle_hash"), ["id", "th"]).dropDuplicates(["id", "th"])
    sets = written(map_batches(once, _sets(shingle), "id long, th long, elements binary"), "sets")
    star = written(map_batches(_with_sets(pairs, sets), _verify(percent), LINK), "star")
    roots = components(star)

    # buckets that are not yet one component
    placed = member.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), "n", "n_shingles")
    placed = placed.join(pivot, "key").where("node <> pivot")
    lead = pivot.join(roots.select(F.col("node").alias("pivot"), F.col("root").alias("p_root")), "pivot", "left").select("key", F.coalesce("p_root", "pivot").alias("p_root"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rest = placed.join(open_keys, "key").join(lead, "key").withColumn("seek", F.col("root") != F.col("p_root"))
    # tiles are bounded by members and by shingles, so by bytes
    needed = lambda n, shingles: F.greatest(F.lit(1).cast("long"), F.ceil(n / TILE), F.ceil(shingles / TILE_SHINGLES))
    seeker = F.col("seek").cast("long")
    sizes = rest.groupBy("key").agg(
        needed(F.sum(seeker), F.sum(seeker * F.col("n_shingles"))).alias("seekers"), needed(F.count(F.lit(1)), F.sum("n_shingles")).alias("all")
    )
    rest = rest.join(sizes, "key")
    spread = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    one = rest.where("seek").select("key", "node", "root", F.lit(True).alias("seek"), spread(F.col("seekers"), 1).alias("t1"), every(F.col("all")).alias("t2"))
    two = rest.select("key", "node", "root", F.lit(False).alias("seek"), every(F.col("seekers")).alias("t1"), spread(F.col("all"), 2).alias("t2"))
    tiles = one.unionByName(two).select("key", "t1", "t2", "seek", F.col("node.id").alias("a_id"), F.col("node.th").alias("a_th"), F.col("root.id").alias("r_id"), F.col("root.th").alias("r_th"))
    tiles = tiles.join(sets.select(F.col("id").alias("a_id"), F.col("th").alias("a_th"), "elements"), ["a_id", "a_th"])
    ship(texts.sparkSession)
    more = written(tiles.groupBy("key", "t1", "t2").applyInPandas(_tile(percent), LINK), "more")
    if not more.isEmpty():
        # the found links join whole components
        joined = roots.select(F.col("node.id").alias("a_id"), F.col("node.th").alias("a_th"), F.col("root.id").alias("b_id"), F.col("root.th").alias("b_th"))
        roots = components(joined.unionByName(more))
    out = classes.select("print", "node").join(roots, "node", "left").select("print", F.coalesce("root", "node").alias("root"))
    return sketches, out


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of ``docs``."""
    sketches, roots = groups(keyed(docs, id_col, text_col), shingle, percent)
    own = sketches.select("id", "th", "n_shingles", "print").join(roots, "print", "left")
    real = lambda c: F.when(c != LAST_ID, c)
    return own.select(
        real(F.col("id")).alias("doc_id"),
        "n_shingles",
        F.when(F.col("n_shingles") > 0, real(F.col("root.id"))).otherwise(real(F.col("id"))).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.col("id") == F.col("root.id")).otherwise(True).alias("kept"),
    )


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, columns unchanged."""
    names = docs.columns
    texts = keyed(docs, id_col, text_col)
    sketches, roots = groups(texts, shingle, percent)
    own = sketches.select("id", "th", "n_shingles", "print").join(roots, "print", "left")
    stay = own.where((F.col("n_shingles") == 0) | ((F.col("id") == F.col("root.id")) & (F.col("th") == F.col("root.th"))))
    stay = stay.select(F.col("id").alias("k_id"), F.col("th").alias("k_th"), (F.col("n_shingles") == 0).alias("k_blank")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("whole"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("k_id"), F.xxhash64(text).alias("k_th"))
    kept = whole.join(stay.hint("shuffle_hash"), ["k_id", "k_th"])
    first = kept.where("not k_blank").dropDuplicates(["k_id", "k_th"])
    return first.unionByName(kept.where("k_blank")).select(*[F.col("whole").getField(c).alias(c) for c in names])
