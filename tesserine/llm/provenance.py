"""Problem 1: generated, minified, vendored and data files among source code.

Linear support-vector classifiers, one per kind of file and view of it. The views are the content behind the leading comment
(hashed byte n-grams), the form of that content as words, the components of the path, and, for vendored files only, the
leading comment. The giveaway header is masked from all of them: phrases that tell of generation, the repository's own name,
versions and numbers.

No labelled data exist, so plain signs label a bounded sample of about ``SAMPLE`` file versions (never more than twice that),
and every view is trained with the signs of another: content and form with those of the leading comment and the file's name
(or, for minified and data files, of the share of literals and the lines' form), the path with those of the leading comment
and content, the leading comment with those of the path. So no classifier reads what labelled its examples. The fit is
repeated after files without a sign that the first fit takes for one kind have been given up as negatives. Thresholds are
set on repositories that training did not see.

Cases: null path or content count as empty; an empty file is hand-written; repeated versions give one row; without any
labelled file of a kind, that kind's classifier never fires. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.session import map_rows

KINDS = ["generated", "minified", "vendored", "data"]
SAMPLE = 6000
#: Fits; after each but the last, unlabelled files that look like one kind are given up as negatives.
TURNS = 3
#: Weight of the path against the content, except for vendored files, of which the path tells most.
PATH_WEIGHT = 0.3
BATCH = 128
#: Score from which an unlabelled file is no longer a negative example in the next fit.
DOUBT = -0.5
_BITS, _ORDERS, _HEAD_BITS, _HEAD_ORDERS = 16, (3, 5), 14, (4, 6)
#: Repositories out of ten that only set the thresholds.
HELD_OUT = 2

# Signs that label the sample.
_GENERATED_HEAD = re.compile(r"(?i)code generated (?:by|from)|<auto-generated|auto-?generated (?:file|by|from|code)|(?:file|module|code) (?:was|is|has been) (?:automatically |auto-?|machine[ -]|programmatically )?generated|generated (?:automatically )?(?:by|from|using|with) [\w./-]+[;,.]? *(?:v?\d|do not|don't|changes)|do not (?:edit|modify)(?: this file)?[ .]*(?:by hand|manually|directly)?\W*$|machine[ -](?:made|generated|written)|produced by the \w+ (?:compiler|generator)|wurde (?:automatisch )?(?:erzeugt|generiert)|fichier (?:a été )?généré|@generated\b", re.M)
_GENERATED_NAME = re.compile(r"(?i)(?:_pb2?(?:_grpc)?|[._-]pb|[._](?:gen|g|generated|stub|designer)|zz_generated\w*)\.\w+$")
_VENDOR_DIRS = frozenset("vendor third_party thirdparty third-party node_modules bower_components external contrib vendored deps".split())
_MINIFIED_NAME = re.compile(r"(?i)[._-](?:min|bundle|packed|prod)\.\w+$|-\d+\.\d+\.\d+\.\w+$")
_FOREIGN = re.compile(r"(?i)\b([a-z][\w-]{2,})[ ,]+(?:v|version )?\d+\.\d+(?:\.\d+)?\b")
_FOREIGN_AUTHORS = re.compile(r"(?i)copyright[^\n]*?\bthe ([\w-]+) (?:project )?(?:authors|contributors|developers|team)")
_COMMENT_LINE = re.compile(r"\s*(?://|#(?!\[|!\[)|/\*|\*|--|;|<!--|$)")
_DOC_BLOCK = re.compile(r"/\*\*(?!/)[\s\S]*?\*/")
_VERSION = re.compile(r"v?\d+(?:\.\d+)+")


def head_of(text: str) -> int:
    """Length of the leading comment lines of a file, blank lines included."""
    at, n = 0, len(text)
    block = False
    while at < n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        line = text[at:end].strip()
        if block:
            block = "*/" not in line
        elif line.startswith("/*"):
            block = "*/" not in line[2:]
        elif line and not line.startswith(("//", "#!", "# ", "#\t", "--", ";;", "<!--")) and line != "#":
            break
        at = end + 1
    return min(at, n)


def masked_head(text: str, repo: str) -> str:
    """The leading comment without phrases that tell of generation, the repository's name, versions and documentation blocks."""
    head = _GENERATED_HEAD.sub(" ", text[: head_of(text)])
    if repo:
        head = re.sub(re.escape(repo), "OWNREPO", head, flags=re.I)
    head = _DOC_BLOCK.sub("", re.sub(r"\d+", "0", head))
    lines = [re.sub(r"^\W+", "", x).strip() for x in head.split("\n") if not x.lstrip().startswith(("///", "//!"))]
    return " | ".join(x for x in lines if x)


def signs(repo: str, path: str, text: str) -> dict[str, list[int]]:
    """Which kinds plain signs speak for, by where they stand: "head", "path" and "body" give 1 or 0 for each kind."""
    out = {"head": [0, 0, 0, 0], "path": [0, 0, 0, 0], "body": [0, 0, 0, 0]}
    head = text[: head_of(text)]
    parts = path.lower().split("/")
    body = text[len(head) :]
    told = _GENERATED_HEAD.search(head) is not None
    out["head"][0] = int(told)
    out["path"][0] = int(_GENERATED_NAME.search(parts[-1]) is not None)
    lines = body.count("\n") + 1
    if len(body) > 200 and (len(body) / lines > 150 and body.count(" ") < 0.08 * len(body)):
        out["body"][1] = 1
    out["path"][1] = int(_MINIFIED_NAME.search(parts[-1]) is not None)
    own = set(re.split(r"[^a-z0-9]+", repo.lower()))
    foreign = [m.group(1).lower() for m in _FOREIGN.finditer(head)] + [m.group(1).lower() for m in _FOREIGN_AUTHORS.finditer(head)]
    out["head"][2] = int(not told and any(f != repo.lower() and f not in own for f in foreign if len(f) > 3))
    out["path"][2] = int(bool(set(parts[:-1]) & _VENDOR_DIRS))
    literal = sum(map(len, _LITERALS.findall(body)))
    if len(body) > 300 and literal > 0.6 * len(body) and body.count("(") < 0.004 * len(body) and not out["body"][1] and not told and not out["path"][0]:
        out["body"][3] = 1
    return out


def path_words(path: str) -> str:
    """Components of a path as words; digits and random tails in names are left out."""
    parts = path.lower().split("/")
    words = [f"dir={p}" for p in parts[:-1]]
    name = parts[-1]
    words += [f"part={p}" for p in re.split(r"[^a-z]+", name) if len(p) > 1]
    words += [f"suffix={x}" for x in re.findall(r"[._-][a-z]+\d?(?=\.)|\.[a-z]+$", name)]
    return " ".join(words)


_SHAPES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZbcdefghijklmnopqrstuvwxyz_123456789", b"a" * 52 + b"000000000")
_LITERALS = re.compile(r"\"[^\"\n ]*\"|'[^'\n ]*'|\b\d[\d., -]*")


def shape_words(text: str) -> str:
    """The form of a file as words: share of literals, of its commonest line forms, length of lines, blanks and calls."""
    body = text[head_of(text) :]
    n = max(1, len(body))
    plain = re.sub(rb"0+", b"0", re.sub(rb"a+", b"a", body.encode("utf-8", "replace").translate(_SHAPES)))
    lines = [x for x in (y.strip() for y in plain.split(b"\n")) if len(x) > 3]
    counts = Counter(lines)
    common = [c for _, c in counts.most_common(3)]
    total = max(1, len(lines))
    literal = sum(map(len, _LITERALS.findall(body)))
    longest = max(map(len, body.split("\n")), default=0)
    shape = {
        "literal": int(10 * literal / n),
        "first": int(10 * (common[0] if common else 0) / total),
        "three": int(10 * sum(common) / total),
        "kinds": min(9, int(10 * len(counts) / total)),
        "longest": min(12, longest.bit_length()),
        "line": min(12, (n // (body.count("\n") + 1)).bit_length()),
        "blank": min(9, int(40 * body.count(" ") / n)),
        "calls": min(9, int(400 * body.count("(") / n)),
        "size": min(14, n.bit_length()),
    }
    return " ".join(f"{k}{chr(97 + v) * 3}" for k, v in shape.items())


def content_bytes(text: str, path: str) -> bytes:
    """What the first classifiers read: the masked content, digits as 0 and runs of blanks as one."""
    body = text[head_of(text) :]
    return re.sub(rb"\s+", b" ", body.encode("utf-8", "replace").translate(_DIGITS))


_DIGITS = bytes.maketrans(b"123456789", b"000000000")


class Model:
    """Weights and thresholds of the classifiers."""

    def __init__(self, weights, cuts, head_cut, report) -> None:
        self.weights, self.cuts, self.head_cut, self.report = weights, cuts, head_cut, report

    def decide(self, rows: list[tuple[str, str, str]]) -> list[list[float]]:
        """Margins above the threshold per kind for (repo, path, content) rows."""
        import numpy as np

        if not rows or self.weights is None:
            return [[-1.0] * len(KINDS)] * len(rows)
        z, y = _scored(self.weights, _views(rows))
        best = z - self.cuts
        best[:, 2] = np.maximum(best[:, 2], y - self.head_cut)
        best[np.array([not t.strip() for _, _, t in rows])] = -1
        return best.tolist()


def _views(rows) -> dict[str, list[bytes]]:
    """What the classifiers read of (repo, path, content) rows."""
    return {
        "content": [content_bytes(t, p) for _, p, t in rows],
        "form": [shape_words(t).encode() for _, _, t in rows],
        "path": [path_words(p).encode() for _, p, _ in rows],
        "head": [masked_head(t, r).lower().encode("utf-8", "replace") for r, _, t in rows],
    }


_HASHED = {"content": (_ORDERS, _BITS, 3), "form": (_HEAD_ORDERS, _HEAD_BITS, 5), "path": (_HEAD_ORDERS, _HEAD_BITS, 5), "head": (_HEAD_ORDERS, _HEAD_BITS, 5)}


def _scored(weights, views):
    """Scores per kind from content, form and path together, and of vendored files from the leading comment."""
    import numpy as np

    from tesserine.llm.hashed import score_texts

    z = sum(score_texts(weights[v], views[v], *_HASHED[v][:2]) for v in ("content", "form", "path"))
    y = score_texts(weights["head"], views["head"], *_HASHED["head"][:2])[:, 0]
    y[np.array([len(h) < 4 for h in views["head"]])] = -1
    return z, y


def train(source_files: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit the classifiers on about ``sample`` file versions, drawn by a hash of their ids, so that only they reach the driver."""
    usable = source_files.where("content is not null and content <> ''")
    share = min(1.0, sample / max(1, usable.count()))
    place = F.pmod(F.xxhash64("file_id"), F.lit(1_000_000)) / 1_000_000
    rows = usable.where(place < share).select("file_id", "repo", "path", "content").limit(2 * sample).collect()
    rows.sort(key=lambda r: r.file_id)
    unique = {r.file_id: r for r in rows}
    return fit([(r.repo or "", r.path or "", r.content) for r in unique.values()])


def fit(rows: list[tuple[str, str, str]]) -> Model:
    """Fit the classifiers on (repo, path, content) rows."""
    import zlib

    import numpy as np

    from tesserine.llm.hashed import train_hinge

    told = [signs(*r) for r in rows]
    by = {w: np.array([t[w] for t in told], dtype=np.float32).reshape(len(rows), len(KINDS)) for w in ("head", "path", "body")}
    labels = np.clip(by["head"] + by["path"] * np.array([1, 0, 1, 0]) + by["body"], 0, 1) if len(rows) else np.zeros((0, len(KINDS)))
    if not labels.any():
        return Model(None, None, None, {})
    held = np.array([zlib.crc32(r[0].encode()) % 10 < HELD_OUT for r in rows])
    if held.all() or not held.any():
        held = np.arange(len(rows)) % 5 == 0
    views = _views(rows)
    has_head = np.array([len(h) >= 4 for h in views["head"]])
    # Each view is taught by the others' signs; where only its own speak, the file is no example.
    taught = {
        "content": np.clip(by["head"] + by["body"] + by["path"] * np.array([1, 0, 0, 0]), 0, 1),
        "form": np.clip(by["head"] + by["body"] + by["path"] * np.array([1, 0, 0, 0]), 0, 1),
        "path": np.clip(by["head"] + by["body"], 0, 1),
        "head": by["path"][:, 2:3],
    }

    def learn(view, use):
        y = taught[view]
        own = labels[:, 2] if view == "head" else labels.max(1)
        at = np.nonzero(use & ((y.max(1) > 0) | (own == 0)))[0]
        orders, bits, epochs = _HASHED[view]
        return train_hinge([views[view][i] for i in at], y[at], y.shape[1], orders, bits, epochs=epochs)

    keep = ~held
    doubtful = np.zeros(len(rows), dtype=bool)
    for turn in range(TURNS):
        weights = {v: learn(v, keep & has_head if v == "head" else keep) for v in views}
        weights["content"] *= 0.5
        # A vendored file reads like any other; its path and leading comment tell (figures in the README).
        weights["content"][:, 2] = weights["form"][:, 2] = 0
        weights["path"][:, [0, 1, 3]] *= PATH_WEIGHT
        z, y = _scored(weights, views)
        if turn < TURNS - 1:
            doubtful = (labels.sum(1) == 0) & ((z > DOUBT).any(1) | (y > DOUBT))
            keep = ~held & ~doubtful
    any_label = labels.any(1)
    cuts, report = np.zeros(len(KINDS)), {}
    use = held & ~doubtful
    head_cut = _cut(y[use & has_head], labels[use & has_head, 2], any_label[use & has_head]) if by["path"][:, 2].any() else 1e9
    for k, kind in enumerate(KINDS):
        if not labels[:, k].any():
            cuts[k] = 1e9
            continue
        # Of vendored files, those count here whose path can tell.
        cuts[k] = _cut(z[use, k], (by["path"] if k == 2 else labels)[use, k], any_label[use])
        right = z[use, k] > cuts[k]
        if k == 2:
            right |= y[use] > head_cut
        truth = labels[use, k] > 0
        report[kind] = {"held_out": int(use.sum()), "labelled": int(truth.sum()), "precision": float((right & truth).sum() / max(1, right.sum())), "recall": float((right & truth).sum() / max(1, truth.sum()))}
    return Model(weights, cuts.astype(np.float32), np.float32(head_cut), report)


def _cut(z, y, other) -> float:
    """The threshold between the scores of unlabelled files and those of this kind, a third of the way up the gap; files of another kind don't count."""
    import numpy as np

    clean, mine = z[~other], z[y > 0]
    if not len(clean) or not len(mine):
        return 0.0
    low, high = float(clean.max()), float(np.quantile(mine, 0.05))
    return max(0.0, low + (high - low) / 3 if high > low else low)


def kinds_of_files(source_files: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per file version: file_id, kind ("hand-written" or the kind with the largest margin), margin."""
    shared = source_files.sparkSession.sparkContext.broadcast(train(source_files, sample))

    def run(rows):
        held = []

        def flush():
            for (file, *_), margins in zip(held, shared.value.decide([h[1:] for h in held])):
                best = max(range(len(KINDS)), key=margins.__getitem__)
                yield file, KINDS[best] if margins[best] > 0 else "hand-written", float(margins[best])

        for r in rows:
            held.append((r["file_id"], r["repo"] or "", r["path"] or "", r["content"] or ""))
            if len(held) >= BATCH:
                yield from flush()
                held = []
        yield from flush()

    return map_rows(source_files, run, "file_id bigint, kind string, margin double", ["file_id", "repo", "path", "content"]).dropDuplicates(["file_id"])


def not_hand_written(source_files: DataFrame) -> DataFrame:
    """Ids of the file versions that nobody wrote by hand in their repository."""
    return kinds_of_files(source_files).where("kind <> 'hand-written'").select("file_id")


def hand_written(source_files: DataFrame) -> DataFrame:
    """The hand-written file versions that remain, whole rows."""
    return source_files.join(not_hand_written(source_files), "file_id", "left_anti")
