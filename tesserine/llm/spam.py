"""Problem 10: keyword-stuffed and link-list pages, by robust Mahalanobis distance per language.

Every page gets features of density, entropy, repetition and function words over its whole text. Per language, centre and
scatter are fitted robustly over all pages: first medians and median deviations, then concentration steps that refit mean
and covariance to the half of the pages that lies nearest, then reweighting steps that refit them to all pages within the
chi-square cut, so that all genres of ordinary pages shape the scatter. Everything is sums over all rows, and a third of
spam in a language does not move the fit. Small languages shrink towards the pooled scatter. A page is flagged when its
distance is an outlier (chi-square quantile) and its deviation points in a spam direction: fewer sentences together with
repetition, with links, or with separators. No single feature decides.

The language of a page is that whose function words it has most, else the labelled one; labels may be null or wrong.

Cases: null, empty and very short texts (under ``FEWEST`` words) are never flagged; repeated rows give one row; equal
texts under several ids are judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.session import map_rows, stored

FEATURES = ["function_words", "sentences", "repetition", "entropy", "links", "separators", "tags"]
FEWEST = 8
#: Quantiles of chi-square with seven degrees of freedom: 99.99 % (outliers), 99.9 % (pages of the refit), median. Fixed values.
CUT, NEAR, MEDIAN = 29.88, 24.32, 6.346
#: Concentration steps, and reweighting steps after them.
STEPS, REFITS = 2, 2
#: Words of an ordinary page that every page is counted as having besides its own, so that short pages are judged mildly.
PRIOR = 6
#: A deviation points at spam when it has this cosine with a spam direction.
COSINE = 0.35
#: Pages of a language at which its own scatter weighs as much as the pooled one.
SHRINK = 60
_SPREAD_FLOOR = [0.03, 0.08, 0.04, 0.03, 0.05, 0.05, 0.02]
_DIRECTIONS = [
    [-1.0, -1.0, 1.5, -1.0, 0.0, 0.0, 0.0],
    [-1.0, -1.0, 0.0, 0.0, 1.5, 0.0, 0.0],
    [-1.0, -1.0, 0.5, 0.0, 0.0, 1.0, 0.5],
    [-1.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.5],
]
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+")
_TAG = re.compile(r"(?<!\w)#\w+")
_SPLIT = re.compile(r"([.!?:](?=\s|$)|[。！？]|\n)")
_MARKS = b"\"$%&'()*+,-/;<=>@[\\]^`{|}~"
_BLANKED = bytes.maketrans(_MARKS, b" " * len(_MARKS))
_OTHER_MARKS = "’‘“”«»„–—·•…，；、：（）《》"
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_SEPARATORS = ",;|/·•>，；"


def page_features(text: str | None, label: str | None) -> tuple[str, list[float]] | None:
    """Language and features of a page; None when it has too few words."""
    from tesserine.llm.stopwords import LANGUAGES_OF, WORDS

    text = text or ""
    if _CJK.search(text):
        text = _CJK.sub(lambda m: f" {m.group()} ", text)
    text = text.lower()
    links = 0
    if "://" in text or "www." in text:
        text, links = _URL.subn(" ", text)
    separators = sum(map(text.count, _SEPARATORS))
    tags = len(_TAG.findall(text)) if "#" in text else 0
    # Bytes are translated by a table of 256, which is far quicker than characters by a mapping.
    plain = text.encode("utf-8", "replace").translate(_BLANKED).decode("utf-8")
    if not plain.isascii():
        for c in _OTHER_MARKS:
            if c in plain:
                plain = plain.replace(c, " ")
    pieces = _SPLIT.split(plain)
    segments = [(w, end != "\n" and end != "") for x, end in zip(pieces[::2], [*pieces[1::2], ""]) if (w := x.split())]
    words = list(chain.from_iterable(x for x, _ in segments))
    n = len(words)
    total = n + links
    if total < FEWEST:
        return None
    counts = Counter(words)
    best, language = 0, (label or "").strip().lower()[:2]
    get = LANGUAGES_OF.get
    hits = [list(filter(None, map(get, x))) for x, _ in segments]
    by_language = Counter(chain.from_iterable(chain.from_iterable(hits)))
    for k, c in by_language.items():
        if c > best or c == best and k < language:
            best, language = c, k
    if language not in WORDS:
        language = "en"
    if best < 0.05 * n and (label or "").strip().lower()[:2] in WORDS:
        language = (label or "").strip().lower()[:2]
    known = WORDS[language]
    pairs = Counter(chain.from_iterable(zip(x, x[1:]) for x, _ in segments))
    top, favourite = 0, None
    for p, c in pairs.items():
        if (c > top or c == top and p < favourite) and p[0] not in known and p[1] not in known:
            top, favourite = c, p
    if top <= 2:
        favourite = None
    in_sentences = function_words = 0
    for (segment, ended), hit in zip(segments, hits):
        m = len(segment)
        if not hit:
            continue
        most = len([h for h in hit if language in h])
        if most * 2 < len(hit):
            most = max(Counter(chain.from_iterable(hit)).values())
        function_words += most
        if m < 4 or most < (0.07 if ended else 0.2) * m:
            continue
        if m >= 12 and len({w for w in segment if w in LANGUAGES_OF}) < 1 + min(m // 12, 3):
            continue
        if favourite and segment.count(favourite[0]) > 1 and 2 * sum(1 for p in zip(segment, segment[1:]) if p == favourite) > 0.34 * m:
            continue
        in_sentences += m
    top_word = max((v for w, v in counts.items() if w not in known), default=0)
    entropy = 1 - sum(v * math.log(v) for v in counts.values() if v > 1) / (n * math.log(n)) if n > 1 else 1.0
    big = max(n, 40)
    return language, [
        math.sqrt(function_words / n) if n else 0.0,
        (in_sentences + PRIOR * 0.8) / (total + PRIOR),
        math.sqrt(max(2 * (top - 1) / big, (top_word - 1) / big, 0.0)),
        entropy,
        math.sqrt(links / total),
        math.sqrt(separators / total),
        math.sqrt(tags / total),
    ]


def _feature_rows(rows):
    for r in rows:
        if r["doc_id"] is None:
            continue
        found = page_features(r["text"], r["lang"])
        if found:
            yield (r["doc_id"], found[0], *found[1])


def features(documents: DataFrame) -> DataFrame:
    """One row per page: doc_id, language and features; pages with too few words are left out."""
    return map_rows(documents, _feature_rows, "doc_id bigint, language string, " + ", ".join(f"{c} double" for c in FEATURES), ["doc_id", "text", "lang"])


def _sums(df: DataFrame) -> list:
    k = len(FEATURES)
    aggregates = [F.count("*").alias("n")]
    aggregates += [F.sum(a).alias(f"s{i}") for i, a in enumerate(FEATURES)]
    aggregates += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}_{j}") for i in range(k) for j in range(i, k)]
    return df.groupBy("language").agg(*aggregates).collect()


def _moments(rows: list) -> dict[str, tuple]:
    """Mean and covariance per language, shrunk towards the pooled covariance."""
    import numpy as np

    k = len(FEATURES)
    raw, pooled, weight = {}, np.zeros((k, k)), 0
    for r in rows:
        n = r.n
        m = np.array([r[f"s{i}"] for i in range(k)]) / n
        c = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                c[i, j] = c[j, i] = r[f"q{i}_{j}"] / n - m[i] * m[j]
        raw[r.language] = (n, m, c)
        pooled += n * c
        weight += n
    pooled /= max(1, weight)
    floor = np.diag(np.square(_SPREAD_FLOOR))
    return {g: (m, (n * c + SHRINK * pooled) / (n + SHRINK) + floor) for g, (n, m, c) in raw.items()}


def _distances(points: DataFrame, model: dict[str, tuple]) -> DataFrame:
    """Squared distance of each page under its language's model, and its best cosine with a spam direction."""
    import numpy as np

    inverse = {g: (m, np.linalg.inv(c), np.sqrt(np.diag(c))) for g, (m, c) in model.items()}
    directions = np.array(_DIRECTIONS)
    directions = directions / np.linalg.norm(directions, axis=1, keepdims=True)

    schema = "doc_id bigint, language string, " + ", ".join(f"{c} double" for c in FEATURES) + ", distance double, direction double"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            languages = np.array(batch.column("language").to_pylist(), dtype=object)
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in FEATURES], axis=1) if batch.num_rows else np.zeros((0, len(FEATURES)))
            distance, direction = np.zeros(len(x)), np.zeros(len(x))
            for g, (m, p, sd) in inverse.items():
                here = languages == g
                if here.any():
                    d = x[here] - m
                    z = d / sd
                    distance[here] = np.einsum("ij,jk,ik->i", d, p, d)
                    direction[here] = (z @ directions.T).max(1) / (np.linalg.norm(z, axis=1) + 1e-9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(distance), pa.array(direction)], names=[*batch.schema.names, "distance", "direction"])

    return points.select("doc_id", "language", *FEATURES).mapInArrow(run, schema)


def fit(points: DataFrame) -> dict[str, tuple]:
    """Robust centre and scatter per language: {language: (mean, covariance)}."""
    import numpy as np

    k = len(FEATURES)
    medians = {r.language: [r[f"m{i}"] for i in range(k)] for r in points.groupBy("language").agg(*[F.percentile_approx(c, 0.5, 10000).alias(f"m{i}") for i, c in enumerate(FEATURES)]).collect()}
    if not medians:
        return {}
    centred = F.create_map(*[x for g, m in medians.items() for x in (F.lit(g), F.array(*[F.lit(float(v)) for v in m]))])
    deviation = points.withColumn("__m", centred[F.col("language")])
    spread = {r.language: [r[f"d{i}"] for i in range(k)] for r in deviation.groupBy("language").agg(*[F.percentile_approx(F.abs(F.col(c) - F.col("__m")[i]), 0.5, 10000).alias(f"d{i}") for i, c in enumerate(FEATURES)]).collect()}
    model = {g: (np.array(medians[g]), np.diag(np.square(1.4826 * np.array(spread[g])) + np.square(_SPREAD_FLOOR))) for g in medians}
    for _ in range(STEPS):
        near = _distances(points, model)
        half = {r.language: r.h for r in near.groupBy("language").agg(F.percentile_approx("distance", 0.5, 10000).alias("h")).collect()}
        limit = F.create_map(*[x for g, h in half.items() for x in (F.lit(g), F.lit(float(h)))])
        model = _moments(_sums(near.where(F.col("distance") <= limit[F.col("language")])))
    near = _distances(points, model)
    scale = {r.language: max(1.0, r.h / MEDIAN) for r in near.groupBy("language").agg(F.percentile_approx("distance", 0.5, 10000).alias("h")).collect()}
    model = {g: (m, c * scale.get(g, 1.0)) for g, (m, c) in model.items()}
    for _ in range(REFITS):
        model = model | _moments(_sums(_distances(points, model).where(F.col("distance") <= NEAR)))
    return model


def scored_pages(documents: DataFrame) -> DataFrame:
    """Pages with features, distance, direction and the verdict ``spam``."""
    points = stored(features(documents), "p10-features")
    model = fit(points)
    scored = _distances(points, model)
    return scored.withColumn("spam", (F.col("distance") > CUT) & (F.col("direction") > COSINE)).dropDuplicates(["doc_id"])


def spam_pages(documents: DataFrame) -> DataFrame:
    """Ids of the pages that consist mainly of keywords, links or tags."""
    return scored_pages(documents).where("spam").select("doc_id")
