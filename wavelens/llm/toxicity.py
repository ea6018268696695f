"""Toxicity by a subsequence-string-kernel support vector machine with Nyström landmarks.

The kernel of two strings sums, over all letter subsequences of length four (three for a landmark of three letters) they share, a decay for every letter and gap
the occurrences span, and is normalised by the strings' own kernels. A letter more or less, or a gap, costs a decay rather
than the match. As a string's own kernel grows with letters put into it, a string that holds a landmark's letters in order and up to a quarter as many others (at least one)
counts at least as the decay to the power of those others. A text's strings are its letter runs, the runs that punctuation inside a chunk or spaces between single
letters have torn apart, and overlapping stretches of runs that are too long; digits that stand for letters count as them.
The kernel of a text with a landmark is the largest of its strings', to the power ``POWER``; a text's features are these
kernels times the inverse root of the landmarks' own matrix. A linear machine with hinge loss is trained on them and its
margin is calibrated to a probability.

The model is fitted on the driver on at most ``sample`` labelled rows (those first in a fixed hash order, 6,000 unless told
otherwise), and never on a held-out row; landmarks are the strings of that sample that tell its labels apart best. Landmarks that
mark toxic rows nearly alone are also shown to the machine as texts of their own, with four times a row's weight, since most toxic rows hold several. Scoring
covers every whole text in Arrow batches. A string is compared with a landmark in full unless that is proven needless: the kernel's square is at most the
share of the landmark's own kernel that subsequences of letters the string has make up (by Cauchy and Schwarz), so where that is below ``FLOOR`` so is the feature, and features below ``FLOOR``
are zero by definition.

Null and empty texts score like a text without strings, as do those whose strings all have fewer than three letters. Rows without a label do not train; of several labels of
an id the smallest counts, of several texts the first; without both labels in the sample every text gets the sample's rate of label 1 (0 for an empty sample). Rows with equal
texts score alike; other columns are carried along.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

DECAY, ORDER, SHORT, POWER, WIDTH, FLOOR = 0.85, 4, 3, 2, 24, 0.05
#: Landmarks with more different letters than this are compared with every string.
_CODES, _SETS = 40, 12
_RUN = re.compile(r"[^\W_]+")
_SINGLES = re.compile(r"(?:\b[^\W_][\W_]{1,2}){3,}[^\W_]\b")
_DIGITS = str.maketrans("0134578", "oieastb")


@lru_cache(1)
def _fold() -> np.ndarray:
    """Code of each codepoint below 2^16: 1-26 for letters with their accents off, 27-39 shared by all others."""
    out = np.array([27 + c % 13 for c in range(1 << 16)], np.int16)
    for c in range(0x250):
        base = unicodedata.normalize("NFD", chr(c).lower())[:1]
        if "a" <= base <= "z":
            out[c] = ord(base) - 96
    out[0xDF] = 19
    return out


def strings(text: str) -> set[str]:
    """The distinct strings of a text that the kernel sees."""
    low = text.lower()
    found = set()
    for chunk in set(low.split()):
        if chunk.isalpha():
            found.add(chunk)
        elif runs := _RUN.findall(chunk):
            found.update(runs)
            if len(runs) > 1:
                found.add("".join(runs))
    found.update("".join(_RUN.findall(torn)) for torn in _SINGLES.findall(low))
    return {s for s in found if len(s) >= SHORT}


def _stretches(s: str) -> list[str]:
    return [s] if len(s) <= WIDTH else [s[i : i + WIDTH] for i in range(0, len(s) - WIDTH // 2, WIDTH // 2)]


def codes(words: list[str], width: int, pad: int) -> np.ndarray:
    raw = np.frombuffer("".join(w.translate(_DIGITS)[:width].ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width)
    return np.where(raw == 0, pad, _fold()[np.minimum(raw, 0xFFFF)])


def kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Subsequence kernel of each row of s with the same row of t (codes; pads match nothing)."""
    n, lt = t.shape
    t = np.ascontiguousarray(t.T)  # positions first, so that every step runs along rows
    prime = np.zeros((lt + 1, order, n), np.float32)
    prime[:, 0] = 1
    total, decay = np.zeros(n, np.float32), np.float32(DECAY)
    for a in range(s.shape[1]):
        same = (s[:, a] == t) * np.float32(DECAY * DECAY)
        total += (same * prime[:-1, order - 1]).sum(0)
        met = same[:, None] * prime[:-1, : order - 1]
        prime[:, 1:] *= decay
        run = np.zeros((order - 1, n), np.float32)
        for b in range(lt):
            run *= decay
            run += met[b]
            prime[b + 1, 1:] += run
    return total.astype(float)


def left_out(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each row, how many letters of s are left out if it holds t's letters in order, else -1 (codes; pads below 0)."""
    at, size = np.zeros(len(s), np.int64), (t >= 0).sum(1)
    for a in range(s.shape[1]):
        want = t[np.arange(len(t)), np.minimum(at, t.shape[1] - 1)]
        at += (at < size) & (s[:, a] >= 0) & (s[:, a] == want)
    return np.where(at == size, (s >= 0).sum(1) - size, -1)


class Landmarks:
    """Landmark strings with what is needed to compare new strings with them."""

    def __init__(self, words: list[str]):
        self.words = words
        self.t = codes(words, max(map(len, words), default=1), -2)
        self.size = (self.t >= 0).sum(1)
        self.order = np.minimum(self.size, ORDER)
        same = np.where(self.t < 0, -1, self.t)
        self.own = np.where(self.order < ORDER, kernel(same, self.t, SHORT), kernel(same, self.t))
        self.bounds = [self._bound(j) for j in range(len(words))]

    def _bound(self, j: int) -> tuple[list[int], np.ndarray] | None:
        """A landmark's different letters, and by the set of those a string has (as bits) whether a feature can reach the floor."""
        t, order = self.t[j], int(self.order[j])
        letters = sorted(set(t[t >= 0].tolist()))
        if len(letters) > _SETS:
            return None
        have = (np.arange(1 << len(letters))[:, None] >> np.arange(len(letters))) & 1
        keep = np.zeros((len(have), _CODES), bool)
        keep[:, letters] = have.astype(bool)
        kept = keep[:, np.maximum(t, 0)] & (t >= 0)
        own = np.concatenate([kernel(np.where(k, t, -1), np.where(k, t, -2), order) for k in np.array_split(kept, max(1, len(kept) // 2048))])
        return letters, own / max(self.own[j], 1e-30) >= FLOOR ** (2 / POWER) - 1e-6

    def candidates(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of codes and landmarks whose feature may reach the floor."""
        has = np.zeros((len(c), _CODES + 1), bool)
        has[np.arange(len(c))[:, None], np.where(c >= 0, c, _CODES)] = True
        may = np.ones((len(c), len(self.words)), bool)
        for j, bound in enumerate(self.bounds):
            if bound:
                letters, reach = bound
                may[:, j] = reach[has[:, letters] @ (1 << np.arange(len(letters)))]
        return np.nonzero(may)

    def kernels(self, s: np.ndarray, m: np.ndarray, own: dict[int, np.ndarray]) -> np.ndarray:
        """Normalised kernels of rows of codes with the landmarks of the given numbers."""
        out = np.zeros(len(s))
        t = self.t[m, : self.size[m].max()]
        for order in (SHORT, ORDER):
            at = np.flatnonzero(self.order[m] == order)
            if len(at):
                out[at] = kernel(s[at], t[at], order) / np.sqrt(np.maximum(own[order][at] * self.own[m[at]], 1e-30))
        rest = left_out(s, t)
        few = (rest > 0) & (rest <= np.maximum(1, self.size[m] // 4))
        return np.minimum(np.where(few, np.maximum(out, DECAY ** np.maximum(rest, 0)), out), 1.0)

    def compare(self, words: list[str]) -> dict[str, list[tuple[int, float]]]:
        """Features of each string: the landmarks it resembles, with the value; strings that resemble none are left out."""
        parts = [(w, p) for w in words for p in _stretches(w)]
        out: dict[str, list[tuple[int, float]]] = {}
        for at in range(0, len(parts), 8192):
            chunk = sorted(parts[at : at + 8192], key=lambda x: len(x[1]))
            c = codes([p for _, p in chunk], WIDTH, -1)
            row, mark = self.candidates(c)
            used = np.unique(row)
            own = {order: np.zeros(len(chunk)) for order in (SHORT, ORDER)}
            for lo in range(0, len(used), 4096):
                u = used[lo : lo + 4096]
                s = c[u, : len(chunk[u[-1]][1])]
                for order in own:
                    own[order][u] = kernel(s, np.where(s < 0, -2, s), order)
            length = (c >= 0).sum(1)
            o = np.lexsort((length[row], self.size[mark]))  # batches of like lengths waste few steps
            row, mark = row[o], mark[o]
            for lo in range(0, len(row), 4096):
                r, m = row[lo : lo + 4096], mark[lo : lo + 4096]
                v = self.kernels(c[r, : length[r].max()], m, {o: x[r] for o, x in own.items()}) ** POWER
                hit = np.flatnonzero(v >= FLOOR)
                for i, j, x in zip(r[hit].tolist(), m[hit].tolist(), v[hit].tolist()):
                    out.setdefault(chunk[i][0], []).append((j, x))
        return out


class Model:
    """Landmarks, weights on their kernels, and calibration."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, slope: float, shift: float):
        self.landmarks, self.weights, self.bias, self.slope, self.shift = landmarks, weights, bias, slope, shift

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """Scores texts; what strings resemble is remembered."""

    SEEN = 1 << 17

    def __init__(self, model: Model):
        self.model, self.marks = model, Landmarks(model.landmarks)
        self.seen: set[str] = set()
        self.hits: dict[str, list[tuple[int, float]]] = {}

    def features(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.model.landmarks)))
        for at in range(0, len(texts), 256):  # the strings of all texts at once would not be small
            per = [strings(t) for t in texts[at : at + 256]]
            if len(self.seen) > self.SEEN:
                self.seen.clear(), self.hits.clear()
            new = set().union(*per) - self.seen
            self.seen |= new
            if new and len(self.model.landmarks):
                self.hits.update(self.marks.compare(sorted(new)))
            for i, found in enumerate(per, at):
                for w in self.hits.keys() & found:
                    for j, v in self.hits[w]:
                        if v > x[i, j]:
                            x[i, j] = v
        return x

    def scores(self, texts: list[str]) -> np.ndarray:
        m = self.model
        margin = self.features(texts) @ m.weights + m.bias
        return 1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -30, 30)))


def choose_landmarks(texts: list[str], labels: np.ndarray, most: int) -> list[str]:
    """Strings, or beginnings of strings, whose presence tells the labels apart best, by a smoothed log ratio weighted with
    their count; of those that begin alike only the best."""
    parts = lambda found: {s for s in found if len(s) <= WIDTH} | {s[:k] for s in found for k in (6, 7) if len(s) > k + 1}
    n0, n1 = max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))
    least = 2 if n1 < 100 else 3 if n1 < 300 else 4
    count = (Counter(), Counter())
    for t, y in zip(texts, labels.tolist()):
        if y:
            count[1].update(parts(strings(t)))
    kept = {w for w, a in count[1].items() if a >= least}
    for t, y in zip(texts, labels.tolist()):
        if not y:
            count[0].update(parts(strings(t)) & kept)
    rated = []
    for w in kept:
        a, b = count[1][w], count[0][w]
        ratio = math.log((a + 0.1) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        if ratio > 1.2:
            rated.append((-ratio * math.sqrt(a), -len(w), w))
    chosen: list[str] = []
    for _, _, w in sorted(rated):
        if len(chosen) == most:
            break
        if not any(w.startswith(c) or c.startswith(w) for c in chosen):
            chosen.append(w)
    return chosen


def _hinge(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 8.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Linear machine with hinge loss by dual coordinate descent."""
    x = np.concatenate([z, np.ones((len(z), 1))], 1)
    s = np.where(y > 0, 1.0, -1.0)
    alpha, w, norm = np.zeros(len(x)), np.zeros(x.shape[1]), (x * x).sum(1)
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            g = s[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), c * weight[i])
            w += (new - alpha[i]) * s[i] * x[i]
            alpha[i] = new
    return w[:-1], float(w[-1])


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, by Newton steps."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        r = p * (1 - p) + 1e-9
        h = np.array([[(r * margin * margin).sum() + 1e-3, (r * margin).sum()], [(r * margin).sum(), r.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return max(float(a), 1e-3), float(b)


def fit(texts: list[str], labels: list[int], landmarks: int = 96) -> Model:
    """The model of a labelled sample."""
    y = np.array(labels, np.int64)
    rate = float(y.mean()) if len(y) else 0.0
    if rate in (0.0, 1.0) or not (marks := choose_landmarks(texts, y, landmarks)):
        return Model([], np.zeros(0), 0.0, 1.0, -30.0 if rate == 0 else math.log(rate / (1 - rate)) if rate < 1 else 30.0)
    scorer = Scorer(Model(marks, np.zeros(len(marks)), 0.0, 1.0, 0.0))
    x = scorer.features(texts)
    own = scorer.marks
    i, j = np.divmod(np.arange(len(marks) ** 2), len(marks))
    same = np.where(own.t < 0, -1, own.t)
    w = np.zeros(len(i))
    for order in (SHORT, ORDER):
        at = np.flatnonzero(own.order[j] == order)
        w[at] = kernel(same[i[at]], own.t[j[at]], order) / np.sqrt(np.maximum(kernel(same, own.t, order)[i[at]] * own.own[j[at]], 1e-30))
    w = w.reshape(len(marks), -1) ** POWER
    value, vector = np.linalg.eigh((w + w.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 0.05))) @ vector.T
    weight = np.where(y > 0, min(4.0, (1 - rate) / rate) ** 0.5, 1.0)
    # a sentence of one well-attested landmark alone is toxic too, though most texts hold several
    sure = [j for j in range(len(marks)) if (x[y > 0, j] > 0.9).sum() >= 6 and (x[y == 0, j] > 0.9).sum() * 20 <= (x[y > 0, j] > 0.9).sum()]
    alone = w[sure]
    v, bias = _hinge(np.concatenate([x, alone]) @ root, np.concatenate([y, np.ones(len(sure), np.int64)]), np.concatenate([weight, np.full(len(sure), 4.0)]))
    weights = root @ v
    slope, shift = _calibrate(x @ weights + bias, y.astype(float))
    return Model(marks, weights, bias, slope, shift)


def fit_on(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 6000) -> Model:
    """Fits on at most ``sample`` labelled rows that are not held out; a document's first label and text count."""
    y = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where("_k IS NOT NULL AND _y IN (0, 1)").where(~held_out("_k"))
    y = y.groupBy("_k").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_k"), "_k").limit(sample)
    rows = docs.select(F.col(key).alias("_k"), F.coalesce(text, F.lit("")).alias("_t")).join(F.broadcast(y), "_k").groupBy("_k").agg(F.min("_t").alias("_t"), F.min("_y").alias("_y")).collect()
    rows.sort(key=lambda r: r._k)
    return fit([r._t for r in rows], [r._y for r in rows])


def held_out(key: str) -> F.Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """The frame with a score column for every row; a column of that name is replaced."""
    keep = [f for f in docs.schema.fields if f.name != out]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(out, T.DoubleType())])

    def run(batches):
        scorer = model.scorer()
        for batch in batches:
            for part, texts in text_slices(batch, text):
                got = scorer.scores([t.decode("utf-8", "replace") for t in texts])
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), pa.array(got)], [*names, out])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(key, held_out, score, predicted) of every row, by a model fitted on the labelled rows that are not held out."""
    scored = score(docs.select(key, text), fit_on(docs, labels, key, text), text, "score")
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
