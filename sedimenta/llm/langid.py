"""Hierarchical language identification: family first, then one-versus-one linear SVMs within it.

Features are square roots of hashed byte n-gram counts (orders 1 to 4) of the whole lower-cased text,
normalised. Linear support vector machines (squared hinge) are trained here on a bounded sample of
labelled rows; families vote first, then only the languages of the winning family.

Machines that hold two languages apart say nothing of a third that none has seen. So a text is also held
against the mean features of each language, and its cosine against those of labelled texts of its size."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm import textkit
from sedimenta.llm.shared import ddl, positional

SAMPLE = 4000
"""Rows that the classifiers are fitted on, at most about so many; predictions cover all rows."""
PER_LANGUAGE = 500
DIM = 4096
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "pa", "gu", "ur"),
}
"""Languages by family; one that isn't listed is a family of its own."""

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    docs = len(offs) - 1
    x = _FOLD[data].astype(np.uint32)
    owner = np.repeat(np.arange(docs, dtype=np.int64) * DIM, np.diff(offs))
    out = np.zeros(docs * DIM)
    code = np.zeros(len(x), np.uint32)
    for n in range(1, 5):
        code = (code << np.uint32(8))[: len(x) - n + 1] | x[n - 1 :] if n <= len(x) else code[:0]
        inside = owner[: len(code)] == owner[n - 1 :] if len(code) else np.zeros(0, bool)
        slot = ((code * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519)) >> np.uint32(20)
        out += np.bincount((owner[: len(code)] + slot)[inside], minlength=docs * DIM)
    out = np.sqrt(out.reshape(docs, DIM))
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return (out / np.maximum(norm, 1e-9)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised squared-hinge machine, classes weighted evenly; y is +1 or -1."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    x = np.ascontiguousarray(x, np.float32)
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb, t = w.copy(), b, 1.0
    rate = 1.0 / (1.0 + 4 * c * float(weight.max()))
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (x @ vw + np.float32(vb))) * weight * y / np.float32(len(y))
        gw, gb = vw / np.float32(len(y)) - np.float32(2 * c) * (gap @ x), -2 * c * float(gap.sum())
        nw, nb = vw - np.float32(rate) * gw, vb - rate * gb
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        step = (t - 1) / nt
        vw, vb = nw + np.float32(step) * (nw - w), nb + step * (nb - b)
        w, b, t = nw, nb, nt
    return w.astype(np.float64), float(b)


class Model:
    """Families and languages with their pairwise machines."""

    def __init__(self, x: np.ndarray, langs: list[str], sizes: np.ndarray):
        names = np.array(langs, object)
        means = np.stack([x[names == n].mean(0, dtype=np.float64) for n in sorted(set(langs))])
        self.means = (means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)).T
        least = np.full(66, np.inf)
        np.minimum.at(least, self._octave(sizes) + 1, (x @ self.means).max(1))
        near = np.minimum(np.minimum(least[:-2], least[2:]), least[1:-1])
        self.least = np.where(np.isfinite(near), near, least.min())
        family = {n: next((f for f, own in FAMILIES.items() if n in own), n) for n in set(langs)}
        of = np.array([family[n] for n in langs], object)
        self.families = sorted(set(family.values()))
        self.members = {f: sorted(n for n in family if family[n] == f) for f in self.families}
        self.top = self._pairs(x, of, self.families)
        self.within = {f: self._pairs(x, names, own) for f, own in self.members.items()}

    @staticmethod
    def _octave(sizes):
        return np.log2(np.maximum(sizes, 1)).astype(int)

    def typical(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The cosine with the nearest language's mean, as a multiple of the least one that a labelled row of
        the sample of like size (by powers of two, one up or down) has: below 1 no such row was as odd."""
        return (x @ self.means).max(1) / np.maximum(self.least[self._octave(sizes)], 1e-9)

    @staticmethod
    def _pairs(x, labels, names):
        out = {}
        for a, b in combinations(range(len(names)), 2):
            rows = np.flatnonzero((labels == names[a]) | (labels == names[b]))
            out[a, b] = svm(x[rows], np.where(labels[rows] == names[a], 1.0, -1.0))
        return out

    @staticmethod
    def _vote(x, pairs, n):
        """(winner, confidence): most duels won, then the largest sum of margins."""
        votes, total, worst = np.zeros((len(x), n)), np.zeros((len(x), n)), np.full((len(x), n), np.inf)
        for (a, b), (w, bias) in pairs.items():
            m = x @ w + bias
            votes[:, a] += m > 0
            votes[:, b] += m <= 0
            total[:, a] += m
            total[:, b] -= m
            worst[:, a] = np.minimum(worst[:, a], m)
            worst[:, b] = np.minimum(worst[:, b], -m)
        win = (votes + 1e-3 * np.tanh(total)).argmax(1) if n else np.zeros(len(x), int)
        return win, 1 / (1 + np.exp(-3 * np.clip(worst[np.arange(len(x)), win], -20, 20)))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top, score = self._vote(x, self.top, len(self.families))
        lang = np.empty(len(x), object)
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(top == i)
            if len(rows):
                win, sure = self._vote(x[rows], self.within[f], len(self.members[f]))
                lang[rows] = np.array(self.members[f], object)[win]
                score[rows] *= sure
        return lang, np.clip(score, 0.0, 1.0)


def train(docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from the labelled rows that `use` admits; None if there are none."""
    rows = docs.where(use & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    each = max(2, min(PER_LANGUAGE, SAMPLE // len(sizes)))
    share = F.create_map(*[F.lit(v) for n, c in sizes.items() for v in (n, float(min(1.0, each / c)))])

    def run(batches):
        for batch in batches:
            for b in textkit.slices(batch, "text"):
                data, offs = textkit.utf8(b.column(1))
                yield pa.record_batch([b.column(0), b.column(2), pa.array([r.tobytes() for r in features(data, offs)], pa.binary()), pa.array(np.diff(offs).astype(np.int64))], ["lang", "h", "x", "size"])

    drawn = rows.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).mapInArrow(run, "lang string, h long, x binary, size long").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    x = np.frombuffer(b"".join(drawn.column("x").to_pylist()), np.float32).reshape(-1, DIM)
    return Model(x, drawn.column("lang").to_pylist(), drawn.column("size").to_numpy()) if len(x) else None


def _letters(b: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    ascii_ = np.flatnonzero(((data | 32) >= 97) & ((data | 32) <= 122))
    has = np.zeros(len(offs) - 1, bool)
    has[np.searchsorted(offs, ascii_, "right") - 1] = True
    for i in np.flatnonzero(~has & (np.diff(offs) > 0)).tolist():
        has[i] = any(map(str.isalpha, b.column("text")[i].as_py()))
    return has


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and typical, a row for each row; keep: the columns of docs that stay (all).

    typical: how near the text is to a learned language, as a multiple of the least that a labelled row of
    its size has. A null text, or one without a letter of any script, is `und` with score and typical 0, and so is every
    row when nothing was learned. With a single language all others are that with score 1. Other columns are
    carried along; columns of docs named lang_pred, score or typical are replaced. An empty table gives none."""
    names = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score", "typical")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, back = positional(docs, names, text_col)

    def run(batches):
        model = shared.value
        for batch in batches:
            for b in textkit.slices(batch, "text"):
                data, offs = textkit.utf8(b.column("text"))
                has = _letters(b, data, offs)
                lang, score, typical = np.full(b.num_rows, "und", object), np.zeros(b.num_rows), np.zeros(b.num_rows)
                if model is not None and has.any():
                    rows_ = np.flatnonzero(has)
                    x = features(data, offs)[rows_].astype(np.float64)
                    lang[rows_], score[rows_] = model.predict(x)
                    typical[rows_] = model.typical(x, np.diff(offs)[rows_])
                yield pa.record_batch([*b.columns[1:], pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(typical)], [*b.schema.names[1:], "lang_pred", "score", "typical"])

    return back(rows.mapInArrow(run, f"{ddl(rows, 1)}lang_pred string, score double, typical double"), "lang_pred", "score", "typical")
