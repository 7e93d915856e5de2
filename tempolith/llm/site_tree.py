"""Main text of web pages by site style trees.

The pages of a host are laid over one another: elements with the same path of
tags, classes and ids from the root are one node of the host's tree (digits in
names count as one digit).  A node gathers, over the pages that have it, how
varied its *presentation* is (the sequence of its child elements, with runs in
powers of two) and how varied its *content* (its text): each as the entropy of
the distribution over pages, to the base of their number, so 0 for what never
changes and 1 for what always does.  A node's importance is the mean of both,
shrunk towards ``PRIOR`` by ``WEIGHT`` pages, so that few pages prove little.
Importance is composed up the tree: a branch is as important as the most important
element in it.  Every element that holds text is judged, prose and marked
articles included: a branch below ``CUT`` is template and goes.

Names are evidence beside the tree, for what only a name can tell.  An
element that calls itself navigation, footer, advert, form, notice and the like, or
that lies outside the part which the page marks as its article, must be more
important by ``NAMED_SHIFT``: its presentation has to vary as well as its content.  What
readers write varies like an article, so their comments count ``READER_SHIFT`` less, which
no importance makes up.  Names do not count on an element that holds the page's article
or nearly all of its prose.  Scripts, styles, controls and hidden elements are no text at all.
A page is not left without text: while next to no prose is left, the cut branch
that holds most of it is put back.

The tree is never gathered: its nodes are counted by aggregations that combine
before the shuffle, over one row for each page and path; the importances are a row
for each path that two pages have, sent to the tasks if they are few, and otherwise
joined by path and carried back to their pages.

Defined results: null html gives the empty text; pages without url share one
host; text without any markup is one block; repeated rows get a row each, but
copies of a page (by digest) count once in the tree of their host; equal
importances are no tie to break, as every branch is held against ``CUT`` by itself;
unclosed and stray tags are tolerated, and a tag with an unclosed quote ends at its
``>``; an empty table gives an empty result; other columns are ignored, whatever their
names.  Pages are read whole.  The id 2^63 - 1 is reserved for null and reads as null.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_batches
from .shared import drop_written, written
from .suffix_dedup import LAST_ID

#: Importance below which a branch is template; importance without evidence, and the pages that it counts for.
CUT, PRIOR, WEIGHT = 0.15, 0.4, 2
#: What names take from the importance of a branch.
NAMED_SHIFT, READER_SHIFT = 0.6, 1.0
#: Up to so many paths are sent to every task; a page's digest is salted for the join of more.
BROADCAST_PATHS, SALTS = 200_000, 64
#: Under that share of its prose a page has lost its text; text is prose in certain elements, and anywhere from so many characters.
LOST, LONG = 0.25, 140

#: A quoted value may hold anything but the beginning of a tag; an unclosed quote is a character like others.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)|<(/?)([A-Za-z][^\s/<>]*)((?>(?:[^<>"']+|"(?:[^"<]|<(?![A-Za-z/!]))*"|'(?:[^'<]|<(?![A-Za-z/!]))*'|["'])*))(?:>|(?=<)|$)|<[!?][^<>]*>?""",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, up to their own end tag.
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul caption".split()
)
PARAGRAPHS = frozenset("p blockquote pre figcaption article main".split())
#: No text whatever it holds; and names of template.
SILENT = frozenset("head title script style template noscript iframe object svg math canvas audio video select button textarea".split())
NOISE = frozenset("nav footer aside form menu dialog".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert comment comments "
    "disqus reply replies respond sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs footer masthead share sharing social related recommended "
    "newsletter subscribe subscription signup login popup modal overlay widget pagination pager toolbar skip".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Template by name only where it does not hold the article.
NAMED = frozenset(["form"])
#: What readers write may outweigh the article: it is text only where there is next to nothing else.
READER_WORDS, NOTHING = frozenset("comment comments disqus reply replies respond".split()), 0.05
#: Of page headers; inside an article they hold its title.
HEADER_WORDS = frozenset(["header", "topbar", "hero"])
#: An opening tag ends an open element of the first set, up to one of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


class Page:
    """The elements of a page and its blocks of text, in page order."""

    def __init__(self, source: str, host: str = ""):
        root = xxhash.xxh64_intdigest(host.encode("utf-8", "replace"))
        self.tag, self.path, self.parent, self.noise, self.inside, self.kids = ["#"], [root], [0], [False], [""], [[]]
        #: What an element is called: 0 nothing, 1 template by form or words, 2 readers' comments, 3 template by tag, 4 no text.
        self.own = [0]
        self.blocks: list[tuple[int, str]] = []
        self._stack = [0]
        self._text: list[str] = []
        self._owner = 0
        self._read(source)
        self._settle()

    def _flush(self) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            if text:
                self.blocks.append((self._owner, text))
            self._text = []

    def _add(self, text: str) -> None:
        if not self._text:
            self._owner = self._stack[-1]
        self._text.append(text)

    def _close(self, names: set[str], until: set[str]) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            name = self.tag[self._stack[k]]
            if name in names:
                del self._stack[k:]
                return
            if name in until:
                return

    def _open(self, name: str, attributes: str) -> int:
        top = self._stack[-1]
        label, words, own = name, set(), 4 if name in SILENT else (1 if name in NAMED else 3) if name in NOISE else 0
        inside = self.inside[top]
        if attributes and not attributes.isspace():
            a = {k.lower(): x or y or z for k, x, y, z in _ATTRIBUTE.findall(attributes)}
            kind = f"{a.get('class', '')} {a.get('id', '')}".strip()
            if kind:
                label += "." + _DIGITS.sub("0", kind)
                words = set(_WORDS.findall(_HUMP.sub(" ", kind).lower()))
            hidden = a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")) is not None or re.search(r"(?:^|\s)hidden(?:\s|$)", attributes) is not None
            if hidden:
                own = 4
            elif name == "article" and words & {"comment", "comments", "ad", "ads"}:
                own = max(own, 2)
            elif words & NOISE_WORDS and name not in ("html", "body", "article", "main"):
                own = max(own, 2 if words & READER_WORDS else 1)
            if a.get("role", "").lower() in NOISE_ROLES:
                own = max(own, 1)
        if not own and inside != "article" and (name == "header" or (words & HEADER_WORDS and name not in ("html", "body", "article", "main"))):
            own = 1
        if name == "article" or (name == "main" and inside != "article"):
            inside = name
        node = len(self.tag)
        self.tag.append(name)
        self.path.append(xxhash.xxh64_intdigest(label.encode("utf-8", "replace"), self.path[top]))
        self.parent.append(top)
        self.own.append(own)
        self.noise.append(self.noise[top] or own > 0)
        self.inside.append(inside)
        self.kids.append([])
        self.kids[top].append(name)
        return node

    def _read(self, source: str) -> None:
        at = 0
        find = _TOKEN.search
        while m := find(source, at):
            if m.start() > at:
                self._add(source[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if name in BLOCK:
                    self._flush()
                for k in range(len(self._stack) - 1, 0, -1):
                    if self.tag[self._stack[k]] == name:
                        del self._stack[k:]
                        break
                    if self.tag[self._stack[k]] in ("article", "table") and name not in ("html", "body", "main", "div", "section"):
                        break
                continue
            if name in BLOCK:
                self._flush()
                self._close({"p"}, {"div", "section", "article", "main", "td", "th", "li", "body", "blockquote"})
            elif name == "br":
                self._add(" ")
            if name in ENDS:
                self._close(*ENDS[name])
            node = self._open(name, m[3])
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif name not in VOID and not m[3].endswith("/"):
                self._stack.append(node)
        if at < len(source):
            self._add(source[at:])
        self._flush()

    def _spread(self, least: int = 1) -> list[bool]:
        out = [False] * len(self.own)
        for node in range(1, len(out)):
            out[node] = out[self.parent[node]] or self.own[node] >= least
        return out

    def _settle(self) -> None:
        """Take forms and words back where they would remove the article or nearly all prose."""
        if not any(0 < x < 3 for x in self.own):
            return
        hard = self._spread(3)
        prose = [(owner, n) for owner, n in self._prose() if not hard[owner]]
        marks = [node for node in range(len(self.tag)) if self.tag[node] in ("article", "main") and not hard[node]]
        bare = not prose
        if bare:
            prose = [(owner, len(block)) for owner, block in self.blocks if not hard[owner]]
        total, held, mains = sum(n for _, n in prose), self._held(prose), self._held([(node, 1) for node in marks if self.tag[node] == "main"])
        articles = self._held([(node, 1) for node in marks])
        for node in range(1, len(self.own)):
            if not 0 < self.own[node] < 3 or self.noise[self.parent[node]] or hard[node]:
                continue
            if any(not self.noise[m] for m in marks):
                break
            most = held[node] * 2 > total
            holds = mains[node] or (articles[node] and most)
            if not holds and most and (not bare or self.tag[node] in NAMED):
                holds = sum(n for owner, n in prose if not self.noise[owner]) < (NOTHING if self.own[node] == 2 else LOST) * total
            if holds:
                self.own[node] = 0
                self.noise = self._spread()

    def _style(self, node: int) -> str:
        """The child elements in order, runs counted in powers of two."""
        return " ".join(f"{tag}{sum(1 for _ in run).bit_length()}" for tag, run in itertools.groupby(self.kids[node]))

    def nodes(self) -> list[tuple[int, int, int]]:
        """(path, presentation, content) of each path of block elements that hold text."""
        silent, text = self._spread(4), {}
        for owner, block in self.blocks:
            node = owner
            while node:
                text.setdefault(node, []).append(block)
                node = self.parent[node]
        found: dict[int, tuple[set, list]] = {}
        for node in sorted(text):
            if self.tag[node] in BLOCK and not silent[node]:
                styles, blocks = found.setdefault(self.path[node], (set(), []))
                styles.add(self._style(node))
                blocks += text[node]
        return [(path, xxhash.xxh64_intdigest("\n".join(sorted(styles))), xxhash.xxh64_intdigest("\n".join(blocks).encode("utf-8", "replace"))) for path, (styles, blocks) in found.items()]

    def _prose(self) -> list[tuple[int, int]]:
        """(owner, characters) of the blocks of prose."""
        out = []
        for owner, block in self.blocks:
            if self.tag[self._block_of(owner)] in PARAGRAPHS or len(block) >= LONG:
                out.append((owner, len(block)))
        return out

    def _held(self, weights: list[tuple[int, int]]) -> list[int]:
        """For each element the sum of the weights at and below it."""
        held = [0] * len(self.tag)
        for owner, n in weights:
            held[owner] += n
        for node in range(len(held) - 1, 0, -1):
            held[self.parent[node]] += held[node]
        return held

    def _composed(self, importance) -> list[float]:
        """For each element the greatest importance of a block element with text in its branch."""
        holds = self._held([(owner, 1) for owner, _ in self.blocks])
        out = [importance(self.path[n]) if holds[n] and self.tag[n] in BLOCK else 0.0 for n in range(len(self.tag))]
        for node in range(len(out) - 1, 0, -1):
            out[self.parent[node]] = max(out[self.parent[node]], out[node])
        return out

    def _cut(self, gone: set[int]) -> list[bool]:
        cut = [node in gone for node in range(len(self.tag))]
        for node in range(1, len(cut)):
            cut[node] = cut[node] or cut[self.parent[node]]
        return cut

    def text(self, importance) -> str:
        """The blocks outside the branches that are cut; ``importance`` of a path."""
        worth = self._composed(importance)
        shift = (0.0, NAMED_SHIFT, READER_SHIFT, NAMED_SHIFT, 9.0)
        judged = [n for n in range(1, len(self.tag)) if self.tag[n] in BLOCK or self.own[n]]
        named = {n for n in judged if self.own[n] and worth[n] - shift[self.own[n]] < CUT}
        low = {n for n in judged if not self.own[n] and worth[n] < CUT}
        cut = self._cut(named)
        prose = [(owner, n) for owner, n in self._prose() if not cut[owner]] or [(owner, len(block)) for owner, block in self.blocks if not cut[owner]]
        total, held = sum(n for _, n in prose), self._held(prose)
        cut = self._cut(named | low)
        # put back from the largest holding down, from the root down
        for node in sorted(low, key=lambda node: (-held[node], node)):
            if not held[node] or sum(n for owner, n in prose if not cut[owner]) >= LOST * total:
                break
            low.discard(node)
            cut = self._cut(named | low)
        good = [(owner, block) for owner, block in self.blocks if not cut[owner]]
        scope = self._scope(good)
        if scope:
            good = [(owner, block) for owner, block in good if self.inside[owner] in ("article", scope) or worth[self._block_of(owner)] - NAMED_SHIFT >= CUT]
        return "\n\n".join(block for _, block in good)

    def _block_of(self, node: int) -> int:
        while node and self.tag[node] not in BLOCK:
            node = self.parent[node]
        return node

    def _scope(self, good: list[tuple[int, str]]) -> str:
        """The innermost of article, main part and page ('') that holds the prose: articles may be
        cards beside it, so the longest one is compared with the prose that is outside them."""
        held = {"main": 0, "": 0}
        articles: dict[int, int] = {}
        for owner, block in good:
            if self.inside[owner] == "article":
                node = top = owner
                while node:
                    if self.tag[node] == "article":
                        top = node
                    node = self.parent[node]
                articles[top] = articles.get(top, 0) + len(block)
        kept = {owner for owner, _ in good}
        for owner, n in self._prose():
            if owner in kept and self.inside[owner] != "article":
                held[self.inside[owner]] += n
        longest = max(articles.values(), default=0)
        if articles and held["main"] <= longest and held[""] <= longest:
            return "article"
        if any(self.inside[owner] == "main" for owner, _ in good) and (held["main"] > longest or not articles):
            return "main"
        return "article" if articles and held[""] <= longest else ""


def host_of(url):
    bare = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    return F.regexp_replace(F.regexp_extract(bare, r"^([^/?#]*)", 1), r"^.*@|:\d*$", "")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for host, source in zip(pdf["host"], pdf["html"], strict=True):
            if source:
                page = _signed(xxhash.xxh64_intdigest(source.encode("utf-8", "replace")))
                rows += [(page, *map(_signed, x)) for x in Page(source, host).nodes()]
        yield pd.DataFrame(rows, columns=["page", "path", "style", "content"])


def importances(pages: DataFrame) -> DataFrame:
    """From rows (host, html): path, pages, importance of each path that at least two pages have."""
    rows = map_batches(pages, _nodes, "page long, path long, style long, content long")
    # copies of a page give the same rows
    nodes = written(rows.distinct(), "nodes")

    def entropy(kind: str) -> DataFrame:
        counts = nodes.groupBy("path", kind).agg(F.count(F.lit(1)).alias("c"))
        sums = counts.groupBy("path").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
        # to the base m: (log m - sum(c log c) / m) / log m
        return sums.where("m > 1").select("path", F.col("m").alias(f"{kind}_pages"), (1 - F.col("s") / F.col("m") / F.log("m")).alias(kind))

    both = entropy("style").join(entropy("content"), "path")
    proof, mean = F.col("style_pages") - 1, (F.col("style") + F.col("content")) / 2
    out = both.select("path", F.col("style_pages").alias("pages"), ((proof * mean + WEIGHT * PRIOR) / (proof + WEIGHT)).alias("importance"))
    out = written(out, "importances")
    drop_written(nodes)
    return out


TEXTS = "page_id long, url string, text string, n_chars long"


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: a row for each row of ``pages``."""
    base = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("page_id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    known = importances(base.select("host", "html"))

    def rows(pdf: pd.DataFrame, tables) -> pd.DataFrame:
        out = pdf[["page_id", "url"]].copy()
        out["text"] = [Page(source, host).text(table) for host, source, table in zip(pdf["host"], pdf["html"], tables, strict=True)]
        out["n_chars"] = [len(t) for t in out["text"]]
        return out

    few = known.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS
    if few:
        table = sorted((r["path"], r["importance"]) for r in known.select("path", "importance").collect())  # at most BROADCAST_PATHS rows
        path, worth = np.array([p for p, _ in table], np.int64), np.array([w for _, w in table], np.float32)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of = dict(zip(path.tolist(), worth.tolist(), strict=True))
            for pdf in batches:
                yield rows(pdf, itertools.repeat(lambda p: of.get(_signed(p), PRIOR), len(pdf)))

        out = map_batches(base, run, TEXTS)
    else:
        # copies have the same paths, so the paths of each digest are looked up once
        keyed = base.withColumn("th", F.xxhash64("host", "html"))

        def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = [(th, _signed(p)) for th, host, source in zip(pdf["th"], pdf["host"], pdf["html"], strict=True) for p, _, _ in Page(source, host).nodes()]
                yield pd.DataFrame(found, columns=["th", "path"])

        of_page = map_batches(keyed.select("th", "host", "html"), paths, "th long, path long").distinct().join(known, "path")
        of_page = of_page.groupBy("th").agg(F.collect_list("path").alias("path"), F.collect_list("importance").alias("worth"))
        of_page = of_page.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(of_page, ["th", "salt"], "left")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                tables = [dict(zip(map(int, p), w, strict=True)) if p is not None else {} for p, w in zip(pdf["path"], pdf["worth"], strict=True)]
                yield rows(pdf, [(lambda p, of=of: of.get(_signed(p), PRIOR)) for of in tables])

        out = map_batches(joined.select("page_id", "url", "host", "html", "path", "worth"), run, TEXTS)
    return out.withColumn("page_id", F.when(F.col("page_id") != LAST_ID, F.col("page_id")))
