"""Problem 8: filling fixed-capacity containers, by first-fit decreasing over a tournament tree.

Texts are measured in tokens of a public tokenizer. The rows are dealt at random (by a hash of the id) into groups of about
``GROUP`` texts; each group is packed by itself, so packing needs one small shuffle and no task grows with the data. Within
a group the largest item goes first, into the first container with room; a tournament tree of the containers' room finds it
in logarithmic time. Only a text longer than the capacity is split: into full containers and one rest, which is packed like
any other item. A group leaves at most about one container partly empty, which is below 0.1 % at the group size used.

Cases: null and empty texts have no tokens and are left out; equal texts under several ids are items of their own; a
repeated row (equal id) is one item; items of equal size go by id; a null or non-positive capacity gives no containers.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.session import map_rows, stored

GROUP = 20_000
#: Rank file of the tokenizer where neither the caller nor the session (``spark.tesserine.vocabulary``) names one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Long texts are counted in parts of about so many characters, each ending where the splitting pattern ends a piece.
PART = 100_000
#: Fixed value: the published splitting pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The tokenizer of a rank file."""
    import base64

    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Before a single blank between other characters the pattern always ends a piece, as only a piece's first character is a blank.
_PIECE_END = re.compile(r"(?<=\S) (?=\S)")


def parts_of(text: str, size: int = PART):
    """The text in parts that the tokenizer reads like the whole; one without blanks is one part."""
    at = 0
    while len(text) - at > size:
        m = _PIECE_END.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and tokens of each non-empty text."""
    vocabulary = vocabulary or documents.sparkSession.conf.get("spark.tesserine.vocabulary", None) or VOCABULARY

    def run(rows):
        count = encoding(vocabulary).encode_ordinary
        for r in rows:
            if r["text"] and r["doc_id"] is not None:
                n = sum(len(count(p)) for p in parts_of(r["text"]))
                if n:
                    yield r["doc_id"], n

    return map_rows(documents, run, "doc_id bigint, tokens bigint", ["doc_id", "text"])


class Tournament:
    """Room of containers in a tree of maxima; finds the first container with enough room."""

    def __init__(self, capacity: int, expected: int) -> None:
        self.size = 1
        while self.size < max(2, expected):
            self.size *= 2
        self.capacity, self.used = capacity, 0
        self.tree = [0] * (2 * self.size)

    def grow(self) -> None:
        """Double the number of leaves."""
        leaves = self.tree[self.size :] + [0] * self.size
        self.size *= 2
        self.tree = [0] * self.size + leaves
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def put(self, item: int) -> int:
        """Number of the first container with room for ``item``, which then holds it; a new one if none has."""
        tree = self.tree
        if tree[1] >= item:
            i = 1
            while i < self.size:
                i *= 2
                if tree[i] < item:
                    i += 1
            bin_ = i - self.size
            room = tree[i] - item
        else:
            if self.used == self.size:
                self.grow()
                tree = self.tree
            bin_ = self.used
            self.used += 1
            i = self.size + bin_
            room = self.capacity - item
        tree[i] = room
        i //= 2
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            best = a if a >= b else b
            if tree[i] == best:
                break
            tree[i] = best
            i //= 2
        return bin_


def first_fit_decreasing(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int]]:
    """(container, id, piece, size) of each item or piece; items are (id, size)."""
    pieces: list[tuple[int, int, int]] = []
    for key, size in items:
        whole, rest = divmod(size, capacity) if size > capacity else (0, size)
        pieces += [(capacity, key, p) for p in range(whole)]
        if rest:
            pieces.append((rest, key, whole))
    pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
    tree = Tournament(capacity, sum(p[0] for p in pieces) // capacity + 1)
    return [(tree.put(size), key, piece, size) for size, key, piece in pieces]


#: Most tasks that the groups are dealt to.
TASKS = 20_000


def pack(documents: DataFrame, specs: DataFrame, vocabulary: str | None = None, group: int = GROUP) -> DataFrame:
    """One row per item or piece: spec_id, grp, container, doc_id, piece, tokens. Every capacity and group is a task's work of its own."""
    sizes = stored(token_counts(documents, vocabulary).dropDuplicates(["doc_id"]), "p8-sizes")
    groups = max(1, -(-sizes.count() // group))
    dealt = sizes.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))
    wanted = specs.select("spec_id", "capacity_tokens").where("spec_id is not null and capacity_tokens > 0").distinct()
    # The capacities are settings, a handful of rows, so every item meets each of them.
    capacities = [(r.spec_id, r.capacity_tokens) for r in wanted.orderBy("spec_id").collect()]
    schema = "spec_id bigint, grp int, container bigint, doc_id bigint, piece int, tokens bigint"
    if not capacities:
        return documents.sparkSession.createDataFrame([], schema)
    each = F.explode(F.array(*[F.struct(F.lit(s).cast("bigint").alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for s, c in capacities])).alias("s")
    items = dealt.select("doc_id", "tokens", "grp", each).select("doc_id", "tokens", "grp", "s.spec_id", "s.capacity")

    def run(key, batch):
        import pandas as pd

        spec, capacity, grp = key
        out = [(spec, grp, *placed) for placed in first_fit_decreasing(list(zip(batch["doc_id"].tolist(), batch["tokens"].tolist())), int(capacity))]
        return pd.DataFrame(out, columns=["spec_id", "grp", "container", "doc_id", "piece", "tokens"])

    # A number given here is kept, so that small groups are not put together into one task.
    spread = items.repartition(min(TASKS, groups * len(capacities)), "spec_id", "capacity", "grp")
    return spread.groupBy("spec_id", "capacity", "grp").applyInPandas(run, schema)


def pack_summary(documents: DataFrame, specs: DataFrame, **options) -> DataFrame:
    """Per capacity: containers used, tokens packed and the share of unused space."""
    packed = pack(documents, specs, **options)
    filled = packed.groupBy("spec_id", "grp").agg((F.max("container") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    total = filled.groupBy("spec_id").agg(F.sum("containers").alias("containers"), F.sum("tokens").alias("tokens"))
    capacity = specs.select("spec_id", "capacity_tokens").distinct()
    return total.join(capacity, "spec_id").select("spec_id", "capacity_tokens", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused"))
