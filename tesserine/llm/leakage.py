"""Problem 9: evaluation texts leaking into training text, by greedy string tiling.

Items lose their stock instructions (sentences that at least ``SHARED`` items have). Token trigrams of what remains are the
seeds; their hashes roll along every document (Karp-Rabin over token ids), and a document is compared with the items whose
seeds it holds. For such a pair the longest non-overlapping matches are marked again and again, longest first, down to
three tokens; marked tiles near one another in both texts are chained, changed words inside a chain counting against it.

A pair is reported when one chain spans ``SPAN`` words of the item (or nearly all of a shorter item), at least ``KEPT`` of
the spanned words match and, beside two distinctive seeds, ``OWN`` of its distinctive seeds or ``KEPT`` of its distinctive
words (three at least, aligned with the chain) are matched, or when the tiles together, in any order, cover ``COVERED`` of an
item of twenty words or more under the same condition. Distinctive are seeds and words that at most ``max(3, 2 %)`` of the
items have: tasks that merely use the same phrases share hardly any. Shuffled words share no seeds. A changed word breaks
three seeds but one word only, so scattered changes cost a pair no more than the words they change.

The items travel to the executors in blocks of at most ``BLOCK_WORDS`` words, one pass over the documents per block, so the
size of what is broadcast is bounded whatever the number of items. No candidate is capped.

Cases: null or empty texts match nothing; an item that consists of stock instructions only matches nothing; documents with
equal text give one pair each; repeated rows give one pair; ties between tiles go to the earlier place in the document.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.session import map_rows

SHARED = 3
SPAN = 20
KEPT = 0.5
COVERED = 0.5
OWN = 0.35
BLOCK_WORDS = 2_000_000
_SEED = 3
_WORD = re.compile(r"[^\W_]+")
#: Letters of scripts that put no blanks between words; each counts as a word.
_UNSPACED = re.compile("[\u0e00-\u0e7f\u0e80-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_ESCAPE = re.compile(r"\\(?:[nrt\"/]|u[0-9a-fA-F]{4})")
#: Soft hyphens, zero-width characters and marks of direction, which stand inside words and are not seen.
_UNSEEN = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff]")
_INLINE = re.compile(r"</?(?:a|abbr|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr)(?:\s[^<>]*)?/?>", re.I)
_LAYOUT = re.compile(r"</?(?:article|blockquote|br|center|dd|div|dl|dt|h[1-6]|hr|li|ol|p|pre|section|table|tbody|td|th|thead|tr|ul)(?:\s[^<>]*)?/?>", re.I)
_SENTENCE_END = r"(?<=[.!?。！？])\s+"
_BASE = 1_000_003


def words(text: str | None) -> list[str]:
    """Case-folded words, behind escapes, entities, tags of layout and typographic forms; single letters of scripts without blanks."""
    import html
    import unicodedata

    if not text:
        return []
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m.group()[2:], 16)) if m.group()[1] == "u" else " ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _LAYOUT.sub(" ", _INLINE.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text))
        if _UNSPACED.search(text):
            text = _UNSPACED.sub(r" \g<0> ", text)
    return _WORD.findall(text.casefold())


def own_texts(items: DataFrame) -> DataFrame:
    """Each item with its sentences that fewer than SHARED items have, in order."""
    clean = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null").dropDuplicates(["item_id", "text"])
    parts = clean.select("item_id", F.posexplode(F.split("text", _SENTENCE_END)).alias("at", "sentence"))
    parts = parts.withColumn("key", F.trim(F.regexp_replace(F.lower("sentence"), r"[^\p{L}\p{N}]+", " "))).where("key <> ''")
    shared = parts.groupBy("key").agg(F.countDistinct("item_id").alias("n")).where(F.col("n") >= SHARED).select("key")
    kept = parts.join(shared, "key", "left_anti")
    return kept.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sentence"))), lambda x: x.sentence), " ").alias("text"))


def common_seeds(own: DataFrame, total: int) -> set[str]:
    """Seeds and single words that more than ``max(3, 2 %)`` of the items have.

    Each stands in a fiftieth of the items, so there are at most a hundred times as many as an item has words.
    """

    def run(rows):
        for r in rows:
            w = words(r["text"])
            for seed in {" ".join(w[i : i + _SEED]) for i in range(len(w) - _SEED + 1)} | set(w):
                yield (seed,)

    counted = map_rows(own, run, "seed string", ["text"]).groupBy("seed").agg(F.count("*").alias("n"))
    return {r.seed for r in counted.where(F.col("n") > max(3, total // 50)).select("seed").collect()}


class Items:
    """A block of items, indexed by the hashes of their seeds."""

    def __init__(self, rows: list[tuple[int, str]], common: set[str]) -> None:
        import numpy as np

        self.ids = [r[0] for r in rows]
        self.words = [words(r[1]) for r in rows]
        vocabulary: dict[str, int] = {}
        for w in self.words:
            for x in w:
                vocabulary.setdefault(x, len(vocabulary) + 1)
        self.vocabulary = vocabulary
        self.tokens = [np.array([vocabulary[x] for x in w], dtype=np.uint64) for w in self.words]
        places: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.tokens):
            for i, h in enumerate(self.rolling(t).tolist()):
                places.setdefault(h, []).append((k, i))
        self.places = places
        self.hashes = np.array(sorted(places), dtype=np.uint64)
        self.distinctive = {h for h, p in places.items() if " ".join(self.words[p[0][0]][p[0][1] : p[0][1] + _SEED]) not in common}
        self.rare = [[x not in common for x in w] for w in self.words]
        self.own = [[h in self.distinctive for h in self.rolling(t).tolist()] for t in self.tokens]

    @staticmethod
    def rolling(t):
        """Hashes of all windows of three tokens, each from its neighbour's terms."""
        import numpy as np

        if len(t) < _SEED:
            return np.zeros(0, dtype=np.uint64)
        b = np.uint64(_BASE)
        with np.errstate(over="ignore"):
            return (t[:-2] * b + t[1:-1]) * b + t[2:]

    def seeds(self, doc_words: list[str]):
        """Token ids of a document, and (place, hash) of each window that is a seed."""
        import numpy as np

        get = self.vocabulary.get
        t = np.array([get(w, 0) for w in doc_words], dtype=np.uint64)
        if len(t) < _SEED or np.count_nonzero(t) < _SEED or not len(self.hashes):
            return t, []
        known = t > 0
        at = np.nonzero(known[:-2] & known[1:-1] & known[2:])[0]
        if not len(at):
            return t, []
        h = self.rolling(t)[at]
        j = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[j] == h
        return t, list(zip(at[hit].tolist(), h[hit].tolist()))

    def matches(self, text: str | None) -> list[tuple[int, float, int]]:
        """Leaked items of a text: (item, share of its words found, longest span)."""
        t, seeds = self.seeds(words(text))
        if len(seeds) < 2:
            return []
        by: dict[int, list[tuple[int, int]]] = {}
        special: dict[int, set[int]] = {}
        for d, h in seeds:
            rare = h in self.distinctive
            for k, i in self.places[h]:
                by.setdefault(k, []).append((d, i))
                if rare:
                    special.setdefault(k, set()).add(h)
        found = []
        doc = t.tolist()
        for k, rare in special.items():
            if len(rare) >= 2 and len(by[k]) >= 3:
                share, span, leaked = compare(doc, self.tokens[k].tolist(), by[k], self.own[k], self.rare[k])
                if leaked:
                    found.append((self.ids[k], share, span))
        return found


def tiles(doc: list[int], item: list[int], seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (document place, item place, length), longest matches marked first, none overlapping."""
    starts = set(seeds)
    runs = []
    for d, i in seeds:
        if (d - 1, i - 1) in starts:
            continue
        n = _SEED
        while (d + n - _SEED + 1, i + n - _SEED + 1) in starts:
            n += 1
        runs.append((n, d, i))
    import heapq

    heap = [(-n, d, i) for n, d, i in runs]
    heapq.heapify(heap)
    used_d, used_i = bytearray(len(doc)), bytearray(len(item))
    out = []
    while heap:
        n, d, i = heapq.heappop(heap)
        n = -n
        free = [not used_d[d + j] and not used_i[i + j] for j in range(n)]
        if all(free):
            for j in range(n):
                used_d[d + j] = used_i[i + j] = 1
            out.append((d, i, n))
            continue
        j = 0
        while j < n:  # what is left of a run that others cut goes back, shorter
            if not free[j]:
                j += 1
                continue
            begun = j
            while j < n and free[j]:
                j += 1
            if j - begun >= _SEED:
                heapq.heappush(heap, (begun - j, d + begun, i + begun))
    return out


def compare(doc: list[int], item: list[int], seeds: list[tuple[int, int]], own: list[bool], rare: list[bool]) -> tuple[float, int, bool]:
    """Share of the item's words in tiles, the longest connected span, and whether that is a leak."""
    marked = sorted(tiles(doc, item, seeds), key=lambda x: (x[1], x[0]))
    n = len(item)
    covered = sum(x[2] for x in marked)
    best_span, leaked = 0, False
    need = min(SPAN, max(_SEED, int(0.8 * n)))
    chains: list[list] = []  # item begin, item end, document begin, document end, matched places of the item, own seeds
    for d, i, length in marked:
        joined = None
        for c in reversed(chains):
            gap_i, gap_d = i - c[1], d - c[3]
            if 0 <= gap_i <= 8 and 0 <= gap_d <= 45:
                joined = c
                break
        if joined:
            begun = joined[1]
            joined[4] += [begun + k for k in _in_order(item[begun:i], doc[joined[3] : d])]
            joined[4] += range(i, i + length)
            joined[1], joined[3] = i + length, d + length
            joined[5] += sum(own[i : i + length - 2])
        else:
            chains.append([i, i + length, d, d + length, [*range(i, i + length)], sum(own[i : i + length - 2])])

    def enough(seeds_found: int, found: list[int], begin: int, end: int) -> bool:
        if seeds_found < 2:
            return False
        held = sum(rare[k] for k in set(found))
        return seeds_found >= OWN * sum(own[begin : max(begin, end - 2)]) or held >= max(3, KEPT * sum(rare[begin:end]))

    for c in chains:
        _grow(c, doc, item)
        span = c[1] - c[0]
        if len(c[4]) >= KEPT * span and enough(c[5], c[4], c[0], c[1]):
            best_span = max(best_span, span)
            leaked = leaked or span >= need
    leaked = leaked or n >= 20 and covered >= COVERED * n and enough(sum(c[5] for c in chains), [k for c in chains for k in c[4]], 0, n)
    return covered / max(1, n), best_span, leaked


def _in_order(a: list[int], b: list[int]) -> list[int]:
    """Places of the words of ``a`` that stand in ``b`` in the same order (both short)."""
    if not a or not b:
        return []
    rows = [[0] * (len(b) + 1)]
    for x in a:
        above, row = rows[-1], [0]
        for j, y in enumerate(b, 1):
            row.append(above[j - 1] + 1 if x == y and x else max(above[j], row[-1]))
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def _grow(c: list, doc: list[int], item: list[int]) -> None:
    """Lengthen a chain at both ends over single changed words, while a word behind them matches in place."""
    for step in (-1, 1):
        while True:
            i, d = (c[0], c[2]) if step < 0 else (c[1] - 1, c[3] - 1)
            for k in (1, 2, 3):
                a, b = i + step * k, d + step * k
                if 0 <= a < len(item) and 0 <= b < len(doc) and item[a] == doc[b]:
                    c[4].append(a)
                    if step < 0:
                        c[0], c[2] = a, b
                    else:
                        c[1], c[3] = a + 1, b + 1
                    break
            else:
                break


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (item_id, doc_id, share, span) of items that leaked into documents."""
    own = own_texts(items)
    rows = own.select("item_id", "text").orderBy("item_id")
    common = common_seeds(own, rows.count())
    found, block, size = None, [], 0

    def search(block):
        index = Items(block, common)

        def run(batch):
            for r in batch:
                for item, share, span in index.matches(r["text"]):
                    yield item, r["doc_id"], share, span

        return map_rows(documents, run, "item_id bigint, doc_id bigint, share double, span int", ["doc_id", "text"])

    for r in rows.toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text) // 4 + 1
        if size >= BLOCK_WORDS:
            part = search(block)
            found = part if found is None else found.unionByName(part)
            block, size = [], 0
    if block or found is None:
        part = search(block)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("item_id", "doc_id").agg(F.max("share").alias("share"), F.max("span").alias("span"))
