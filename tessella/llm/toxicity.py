"""Toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks.

Two word fragments are compared by their common subsequences of three characters, gaps allowed, each occurrence weighted
by DECAY**(the characters that it skips), so that inserted and dropped characters only lower the value.  A fragment is
the subsequences that begin in LOCAL consecutive places of a word (a mark stands before its first character), so that an
insult counts whatever follows it in a compound.  A linear support vector machine in the landmarks' feature space is
trained on fragments, rounds of hard negatives included; as it is linear in the kernel, its sum over landmarks is kept
as one weight for each subsequence.  A text scores by its strongest fragment, over the whole text.

Labels hold for texts, so witnesses come first: words, and stems that words share, which toxic texts hold far more often
than clean ones (a G test over groups of near-equal texts, in rounds that leave out the words already explained).
Landmarks are the stems, the words that carry them, frequent clean words, and hard ones found while training.

Characters fold to 32 classes: letters in lower case, look-alike digits and signs to their letters, other bytes by
value; signs inside a word are skipped.  Words of more than ``WIDTH`` bytes are compared in overlapping parts; letters
spelled out one by one count as one word.

The fit reads the whole texts of a bounded sample of rows (``per_label`` of each label).  Edge cases: null and empty
texts score as a clean word; without both labels, or without a witness, every text scores 0; repeated rows score alike.
"""

from __future__ import annotations

import gc
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import bounded, extended, sample_ids
from ._text import handed_back, segment_max, settle, slices, span_hashes, words

WIDTH = 24
REACH = 7  # the farthest that a subsequence's last character is from its first
LOCAL = 6  # places in which a fragment's subsequences begin
DECAY = 0.75
STEMS = range(4, 9)  # characters of the stems that are tried, the mark included
LEAST_G = 28.0  # a stem's or word's G statistic: beyond chance among ten million of them
ODDS = 3.0  # times as often in toxic texts as in clean ones
SHY = 0.01  # a unit is the width of the machine's margin on one side
CLASSES = 32
MARK = 31  # the class that stands before a word
STEP = 1024  # words compared at once
MEMORY = 250_000  # words whose value a worker keeps


def _classes() -> np.ndarray:
    t = np.full(256, 31, np.uint8)
    t[97:123] = np.arange(1, 27)
    t[65:91] = np.arange(1, 27)
    for c, like in zip(b"0134579@$", b"oieastgas", strict=True):
        t[c] = like - 96
    t[128:] = 27 + np.arange(128) % 4
    return t


CLASS = _classes()
LOOKALIKE_SIGN = np.zeros(256, bool)
LOOKALIKE_SIGN[[ord("@"), ord("$")]] = True
OFFSETS = [(a, b, DECAY ** (b - 2)) for b in range(2, REACH + 1) for a in range(1, b)]


def padded(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the words' characters after a mark, 0 after the end, and for each row its word; signs are left out."""
    n = end - start
    parts = np.maximum(1, -(-(n - WIDTH) // (WIDTH // 2)) + 1)
    word = np.repeat(np.arange(len(n)), parts)
    first = np.concatenate([[0], np.cumsum(parts)])[:-1]
    lo = start[word] + (np.arange(len(word)) - first[word]) * (WIDTH // 2)
    at = lo[:, None] + np.arange(WIDTH)
    inside = at < end[word][:, None]
    c = np.where(inside, CLASS[buf[np.minimum(at, len(buf) - 1)]], 0)
    sign = c == 31
    if len(buf):
        odd = LOOKALIKE_SIGN[buf[np.minimum(at, len(buf) - 1)]] | (c == 0) | sign
        sign |= (np.logical_and.accumulate(odd[:, ::-1], 1)[:, ::-1] | np.logical_and.accumulate(odd, 1)) & odd
    c[sign] = 0
    loose = np.flatnonzero(((c[:, 1:] > 0) & (c[:, :-1] == 0)).any(1))
    c[loose] = np.take_along_axis(c[loose], np.argsort(c[loose] == 0, axis=1, kind="stable"), 1)
    return np.concatenate([np.full((len(c), 1), MARK), c], 1).astype(np.int32), word


def codes(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.float32]]:
    """For each pair of offsets: (rows x places) subsequence codes, 0 where there is none, and the weight."""
    live, c = c > 0, c.astype(np.int32, copy=False)
    for a, b, w in OFFSETS:
        n = c.shape[1] - b
        if n <= 0:
            break
        ok = live[:, :n] & live[:, a : a + n] & live[:, b:]
        yield np.where(ok, (c[:, :n] * CLASSES + c[:, a : a + n]) * CLASSES + c[:, b:], 0), np.float32(w)


def trim(c: np.ndarray) -> np.ndarray:
    return c[:, : max(3, int((c > 0).any(0).nonzero()[0].max(initial=0)) + 1)]


def fragments(c: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The characters that the fragments beginning there can reach."""
    wide = np.concatenate([c, np.zeros((len(c), LOCAL + REACH), c.dtype)], 1)
    return wide[row[:, None], at[:, None] + np.arange(LOCAL + REACH)]


@dataclass(frozen=True)
class Landmarks:
    slot: np.ndarray  # code -> row of table; row 0 is empty
    there: np.ndarray  # the code of each other row
    table: np.ndarray  # rows x m

    @staticmethod
    def of(fragments_: np.ndarray) -> "Landmarks":
        row, code, weight = [], [], []
        for x, w in codes(fragments_):
            i, j = np.nonzero(x[:, :LOCAL])
            row.append(i), code.append(x[i, j]), weight.append(np.full(len(i), w))
        row, code, weight = map(np.concatenate, (row, code, weight))
        there, at = np.unique(code, return_inverse=True)
        table = np.zeros((len(there) + 1, len(fragments_)), np.float32)
        np.add.at(table, (at + 1, row), weight)
        slot = np.zeros(CLASSES**3, np.int32)
        slot[there] = np.arange(1, len(there) + 1)
        return Landmarks(slot, there, table)

    def kernel(self, fragments_: np.ndarray) -> np.ndarray:
        """The kernel of each fragment and landmark."""
        out = np.zeros((len(fragments_), self.table.shape[1]), np.float32)
        for lo in range(0, len(out), STEP):
            for x, w in codes(fragments_[lo : lo + STEP]):
                s = self.slot[x[:, :LOCAL]]
                for j in range(s.shape[1]):
                    i = np.flatnonzero(s[:, j])
                    out[lo + i] += w * self.table[s[i, j]]
        return out

    def weights(self, alpha: np.ndarray) -> np.ndarray:
        """One weight for each subsequence: the sum over landmarks of alpha times theirs."""
        out = np.zeros(CLASSES**3, np.float32)
        out[self.there] = self.table[1:] @ alpha
        return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray | None  # by subsequence code
    bias: float
    slope: float

    def places(self, c: np.ndarray) -> np.ndarray:
        """Decision values of the fragments that begin at each place."""
        v = np.zeros((len(c), c.shape[1] + LOCAL), np.float32)
        for x, w in codes(c):
            v[:, LOCAL : LOCAL + x.shape[1]] += w * self.weights[x]
        total = np.cumsum(v, 1)
        last = total[:, -1:]
        ends = np.concatenate([total, np.repeat(last, LOCAL, 1)], 1)
        return (ends[:, 2 * LOCAL - 1 : 2 * LOCAL - 1 + c.shape[1]] - total[:, LOCAL - 1 : LOCAL - 1 + c.shape[1]]) + np.float32(self.bias)

    def values(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Decision values of words: of their strongest fragments."""
        out = np.empty(len(start))
        for lo in range(0, len(start), STEP):
            c, word = padded(buf, start[lo : lo + STEP], end[lo : lo + STEP])
            v = self.places(trim(c)).max(1)
            out[lo : lo + STEP] = segment_max(v, np.searchsorted(word, np.arange(min(STEP, len(start) - lo) + 1)), self.bias)
        return out


SPELLED = re.compile(rb"(?<![^\s])(?:[A-Za-z0-9@$][\s._*-]+){3,}[A-Za-z0-9@$](?![^\s])")


def spelled(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of four or more single characters: their joined bytes, one run a line, and the text of each."""
    raw, out, doc = buf.tobytes(), [], []
    for d, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        for m in SPELLED.finditer(raw[a:b]):  # a text's own bytes, so that neither runs nor look-around leave it
            out.append(re.sub(rb"[\s._*-]+", b"", m[0]))
            doc.append(d)
    return out, np.array(doc, np.int64)


def svm(f: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps on the active set."""
    x = np.concatenate([f, np.ones((len(f), 1))], 1)
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], l2 * weight.sum())
    reg[-1] = 1e-9
    for _ in range(30):
        on = y * (x @ w) < 1
        xo = x[on] * weight[on, None]
        new = np.linalg.solve(xo.T @ x[on] + np.diag(reg + 1e-9), xo.T @ y[on])
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w[:-1], float(w[-1])


def laid(words_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of words laid one after another."""
    size = np.array([len(w) for w in words_], np.int64)
    end = np.cumsum(size)
    return np.frombuffer(b"".join(words_), np.uint8), end - size, end


def inserted(counts: Counter, rng: np.random.Generator) -> Counter:
    """Each witness with one letter inserted at each inner place of its first characters, so that the border leaves room for them."""
    return Counter({w[:i] + bytes([97 + int(rng.integers(26))]) + w[i:]: 0.3 * n / (len(w) - 1) for w, n in sorted(counts.items()) if len(w) >= 5 for i in range(1, min(len(w), 8))})


STRIP = re.compile(rb"^[^A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff]+$")


def hash_of(w: bytes) -> int:
    h = 0xCBF29CE484222325
    for c in w:
        h = (h ^ c) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def g_test(p: np.ndarray, n: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Signed G statistic of being in p of n1 and n of n0."""
    p, n, out = p.astype(float), n.astype(float), 0.0
    for seen, of in ((p, n1), (n, n0)):
        for x, share in ((seen, (p + n) / (n1 + n0)), (of - seen, 1 - (p + n) / (n1 + n0))):
            out = out + 2 * np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(of * share, 1e-12)), 0)
    return out * np.sign(p / n1 - n / n0)


@dataclass(frozen=True)
class Sentences:
    """Labelled texts as sets of word numbers."""

    words: list[bytes]  # by number, ascending
    sets: list[np.ndarray]  # word numbers of each text, ascending
    labels: np.ndarray

    @staticmethod
    def of(texts: list[str], labels: np.ndarray) -> "Sentences":
        number: dict[bytes, int] = {}
        sets = [np.array(sorted({number.setdefault(w, len(number)) for w in words_of(t)}), np.int32) for t in texts]
        words_ = sorted(number)
        place = np.empty(len(words_), np.int32)
        place[[number[w] for w in words_]] = np.arange(len(words_), dtype=np.int32)
        return Sentences(words_, [np.sort(place[s]) for s in sets], labels)

    def some(self, which: np.ndarray) -> "Sentences":
        return Sentences(self.words, [s for s, x in zip(self.sets, which, strict=True) if x], self.labels[which])

    def groups(self) -> np.ndarray:
        """A number for each group of texts that share the four least hashes of their longer words, as near-equal ones do more often than not."""
        h = np.array([hash_of(w) if len(w) >= 5 else 2**64 - 1 for w in self.words], np.uint64)
        known: dict[tuple, int] = {}
        return np.array([known.setdefault((int(y), *np.sort(h[s])[:4].tolist()) if len(s) else (i,), len(known)) for i, (s, y) in enumerate(zip(self.sets, self.labels, strict=True))])

    def counts(self, label: int) -> np.ndarray:
        """Texts of that label that hold each word."""
        return np.bincount(np.concatenate([np.zeros(0, np.int32), *(s for s, y in zip(self.sets, self.labels, strict=True) if y == label)]), minlength=len(self.words))


def stems(w: bytes) -> set[bytes]:
    m = b"^" + w
    return {m[i : i + k] for k in STEMS for i in range(len(m) - k + 1)} | {m}


def witnesses(of: Sentences) -> dict[int, bytes]:
    """Words that speak for toxicity, by number, each with its stem (a mark is b"^")."""
    group = of.groups()
    toxic = np.zeros(int(group.max(initial=-1)) + 1, bool)
    toxic[group] = of.labels == 1
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    pair = np.unique(np.concatenate([s.astype(np.int64) * len(toxic) + g for s, g in zip(of.sets, group.tolist(), strict=True)]))
    word, holder = pair // len(toxic), pair % len(toxic)
    first = np.searchsorted(word, np.arange(len(of.words) + 1))
    pos = np.bincount(word, weights=toxic[holder], minlength=len(of.words))
    neg = np.diff(first) - pos
    speaks = pos * n0 >= np.maximum(ODDS * neg * n1, 1e-9)
    tried: Counter = Counter()
    for i in np.flatnonzero(speaks & (pos >= 2)).tolist():
        for s in stems(of.words[i]):
            tried[s] += pos[i]
    tried = Counter({s: n for s, n in tried.items() if n >= 6})
    carry: dict[bytes, list[int]] = defaultdict(list)
    against: Counter = Counter()
    for i in np.flatnonzero(np.diff(first)).tolist():
        for s in stems(of.words[i]) & tried.keys():
            carry[s].append(i)
            against[s] += neg[i]
    found: dict[int, bytes] = {}

    def strength(s: bytes) -> float:
        groups = np.unique(np.concatenate([np.zeros(0, np.int64), *(holder[first[i] : first[i + 1]] for i in carry[s] if i not in found)]))
        p = int(toxic[groups].sum())
        n = len(groups) - p
        return float(g_test(np.array(p), np.array(n), n1, n0)) if p and p * n0 >= ODDS * n * n1 else 0.0

    values = {s: strength(s) for s in sorted(carry) if tried[s] * n0 >= ODDS * against[s] * n1}
    while values:
        s = max(values, key=lambda s: (values[s], len(s), s))
        if values[s] < LEAST_G:
            break
        now = strength(s)
        if now < values[s]:  # words that it shares with another stem are gone
            values[s] = now
            continue
        found |= {i: s for i in carry[s] if i not in found and speaks[i]}
        del values[s]
    return found


def words_of(text: str) -> set[bytes]:
    return {w for w in (STRIP.sub(b"", w) for w in text.lower().encode().split()) if 3 <= len(w) <= WIDTH}


def border(values: np.ndarray, labels: np.ndarray) -> float:
    """The value that parts the labels best, each label counting alike, less SHY for each unit that it lies off the machine's own."""
    order = np.argsort(values, kind="stable")
    v, y = values[order], labels[order]
    right = np.concatenate([[0], np.cumsum(y == 0)]) / max(1, (y == 0).sum()) + 1 - np.concatenate([[0], np.cumsum(y == 1)]) / max(1, (y == 1).sum())
    edges = np.concatenate([[v[0] - 1], (v[1:] + v[:-1]) / 2, [v[-1] + 1]])
    right[1:-1][v[1:] == v[:-1]] = -1
    return float(edges[np.argmax(right - SHY * np.abs(edges))])


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """texts: labelled documents, of which a quarter, by group of near-equal texts, sets the border."""
    of = Sentences.of(texts, labels)
    aside = np.array([hash_of(b"%d" % g) % 4 == 0 for g in of.groups()], bool)
    model = machine(of.some(~aside))
    if model.weights is None or len(set(labels[aside].tolist())) < 2:
        return model
    del of
    scorer = Scorer(model)
    raw = [t.encode() for t, x in zip(texts, aside, strict=True) if x]
    values = np.concatenate([scorer.values(np.frombuffer(b"".join(raw[i : i + 64]), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw[i : i + 64]])]).astype(np.int64)) for i in range(0, len(raw), 64)])
    return Model(model.weights, model.bias - border(values, labels[aside]), model.slope)


def machine(of: Sentences, m: int = 400, rounds: int = 5, seed: int = 3) -> Model:
    none = Model(None, -8.0, 1.0)
    if len(set(of.labels.tolist())) < 2:
        return none
    pos, neg = of.counts(1), of.counts(0)
    stem_at = witnesses(of)
    stem_of = {of.words[i]: s for i, s in stem_at.items()}
    rng = np.random.default_rng(seed)
    often = [of.words[i] for i in np.lexsort((np.arange(len(neg)), -neg)).tolist() if neg[i] and i not in stem_at]
    pool = sorted(often)
    counts = Counter({of.words[i]: float(pos[i]) for i in stem_at})
    if not counts or not pool:
        return none
    carriers = sorted(counts, key=lambda w: (-counts[w], w))[: m // 4]
    counts.update(inserted(counts, rng))
    plus = sorted(counts)
    parts = sorted({s.removeprefix(b"^") for s in stem_of.values()})
    clean = often[: m // 4]

    def at_start(ws: list[bytes]) -> np.ndarray:
        c, word = padded(*laid(ws))
        return fragments(c, np.searchsorted(word, np.arange(len(ws))), np.zeros(len(ws), np.int64))

    def strongest(ws: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Each word's strongest fragment and its value."""
        value, out = np.empty(len(ws), np.float32), np.empty((len(ws), LOCAL + REACH), np.uint8)
        for lo in range(0, len(ws), STEP):
            c, word = padded(*laid(ws[lo : lo + STEP]))
            row = np.searchsorted(word, np.arange(min(STEP, len(ws) - lo)))
            v = model.places(c)[row]
            at = v.argmax(1)
            value[lo : lo + STEP], out[lo : lo + STEP] = v[np.arange(len(at)), at], fragments(c, row, at)
        return value, out

    def begin(w: bytes) -> int:
        return max(0, (b"^" + w).find(stem_of.get(w, b"^")))

    c, word = padded(*laid(plus))
    x_plus = fragments(c, np.searchsorted(word, np.arange(len(plus))), np.array([begin(w) for w in plus]))
    some = [pool[i] for i in rng.permutation(len(pool))[:4000]]
    x_minus = np.unique(at_start(sorted({*some, *clean})), axis=0)
    marks = np.unique(at_start([*dict.fromkeys([*parts[: m // 4], *carriers, *clean])]), axis=0)
    model, hard = none, np.zeros((0, LOCAL + REACH), np.uint8)
    for _ in range(rounds):
        land = Landmarks.of(np.unique(np.concatenate([marks, hard]), axis=0))
        k = land.kernel(np.unique(np.concatenate([marks, hard]), axis=0)).astype(np.float64)
        value, vector = np.linalg.eigh((k + k.T) / 2)
        good = value > 1e-6 * value[-1]
        white = vector[:, good] / np.sqrt(value[good])
        f = np.concatenate([land.kernel(x_plus), land.kernel(x_minus)]) @ white
        y = np.concatenate([np.ones(len(x_plus)), -np.ones(len(x_minus))])
        weight = np.concatenate([[np.sqrt(counts[w]) for w in plus], np.ones(len(x_minus))])
        weight[: len(plus)] *= 0.5 * len(x_minus) / weight[: len(plus)].sum()
        w, bias = svm(f, y, weight)
        model = Model(land.weights((white @ w).astype(np.float32)), bias, 4.0)
        v, x = strongest(pool, model)
        order = np.argsort(-v, kind="stable")
        worst = order[: max(400, min(2000, int((v > -0.5).sum())))]
        x_minus = np.unique(np.concatenate([x_minus, x[worst]]), axis=0)
        hard = np.unique(x[order[: m // 4]], axis=0)
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = 4000, seed: int = 29) -> Model:
    """Fits on at most ``per_label`` rows of each label of ``labels`` (key, label 0 or 1)."""
    ids = sample_ids(labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias(label)), key, label, per_label, seed)
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(ids), key).select(key, label, "_t").dropDuplicates([key, label]).collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    texts, labels_ = [r[2] for r in rows], np.array([int(r[1] > 0) for r in rows])
    del rows
    model = fit(texts, labels_)
    del texts
    gc.collect()
    handed_back()
    return model


class Scorer:
    """Document scores; remembers the values of words by hash."""

    latest: "tuple[str, Scorer] | None" = None

    @classmethod
    def of(cls, name: str, model: Model) -> "Scorer":
        """The worker's scorer for the model of that name, so that tasks share what it remembers."""
        if cls.latest is None or cls.latest[0] != name:
            cls.latest = name, cls(model)
        return cls.latest[1]

    @classmethod
    def forget(cls) -> None:
        cls.latest = None

    def __init__(self, model: Model):
        self.model, self.keys, self.vals = model, np.zeros(0, np.uint64), np.zeros(0)

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        m = self.model
        if m.weights is None:
            return np.zeros(len(offs) - 1)
        return 1 / (1 + np.exp(-np.clip(m.slope * self.values(buf, offs), -40, 40)))

    def values(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Decision values of texts."""
        m = self.model
        start, end, first = words(buf, offs)
        best = np.full(len(offs) - 1, m.bias)
        if len(start):
            h, at, back = np.unique(span_hashes(buf, start, end), return_index=True, return_inverse=True)
            i = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
            new = np.ones(len(h), bool) if not len(self.keys) else self.keys[i] != h
            v = np.empty(len(h))
            v[~new] = self.vals[i[~new]] if len(self.keys) else 0
            v[new] = m.values(buf, start[at[new]], end[at[new]])
            if new.any():
                self.keys, self.vals = (h, v) if len(self.keys) > MEMORY else (np.concatenate([self.keys, h[new]]), np.concatenate([self.vals, v[new]]))
                order = np.argsort(self.keys, kind="stable")
                self.keys, self.vals = self.keys[order], self.vals[order]
            best = segment_max(v[back], first, m.bias)
        runs, doc = spelled(buf, offs)
        if runs:
            e = np.cumsum([len(r) for r in runs])
            np.maximum.at(best, doc, m.values(np.frombuffer(b"".join(runs), np.uint8), e - [len(r) for r in runs], e))
        return best


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``score``, 0 to 1; the support vector machine's own border is at 0.5."""
    schema = extended(docs, keep, "score double")
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("toxicity", Scorer.forget)
        scorer = Scorer.of(name, shared.value)
        for rows, buf, offs in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), pa.array(scorer(buf, offs), pa.float64())], names=schema.names)

    return bounded(docs.select(*keep, F.col(text).alias("_text"))).mapInArrow(run, schema)
