"""Toxicity by a support vector machine over a gap-weighted subsequence kernel.

A text is a bag of short snippets, read across word borders: each word, each two
neighbouring words run together, and runs of very short words. Case and marks
are dropped, and digits that stand for letters are read as those letters. The
kernel compares two snippets by their common subsequences of three characters
(the borders count as characters), each weighted by ``DECAY`` to the power of
the length it spans, up to ``SPAN``, and divided by the snippets' own norms. So
an inserted, dropped or replaced character costs a part of the likeness only.

A label belongs to a whole text, an insult to a few letters of it, so the machine
is trained by multiple instances. To start, a text labelled 1 stands by the
snippets that best tell texts labelled 1 from those labelled 0; then, in
``ROUNDS`` rounds, by those with the largest margins, and a text labelled 0 by
its own largest ones. Each positive snippet also trains with letters changed
(virtual support vectors), which sets the border where disguises lie. Landmark
snippets give a Nyström feature map, in which a squared-hinge linear machine is
fitted. A text's margin is the largest of its snippets', and a logistic curve
over the training texts turns it into a score.

Since the kernel is a dot product of sparse features, the trained machine folds
into one weight per triple of characters; scoring looks those up.

Defined results: null and empty texts, and texts without any snippet near the
border, have a margin of -1 (so a low score). Texts are read whole, however
long; words over ``WINDOW`` characters through overlapping windows. Equal texts
score equally; null, repeated and tied ids are rows of their own; columns other
than the text only pass through, whatever their names. Labels that are null or
not 0 or 1 are left out; of a doc_id with both labels, 1 counts. Without texts
of both labels every score is 0.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, keep, shuffle_parts, small_batches, text_or_empty

DECAY, SPAN = 0.8, 9
WINDOW, STRIDE = 16, 8
JOINED = 14  # two neighbouring words are also read as one up to this length
SHORT = 2  # three or more words in a row of at most this length are also read as one
MAX_TRAIN = 20_000  # labelled texts that training may use
MAX_SNIPPETS = 12_000  # snippets of either sign that a fit may use, those with the largest margins
ROUNDS, DISGUISES, LANDMARKS, COST = 4, 5, 512, 100.0
WITNESSES, RIVALS = 3, 10  # snippets that may stand for one text labelled 1 and 0
CHARACTERS = 1 << 20  # texts are read together up to this length, and snippets compared up to this number

_BITS = 6
_SIZE = 1 << _BITS  # symbols: 0 border, 1 to 26 letters, the rest hashed
_LETTERLIKE = str.maketrans("0134578@$!|", "oieastbasil")
_DIGITS = re.compile(r"[0134578@$!|]+(?=[a-z])")
_MARKS = re.compile(r"[^\w\s]|_")


def words_of(text: str) -> list[str]:
    """Words in lower case and without marks; letter-like digits and signs before a letter read as letters."""
    return _MARKS.sub("", _DIGITS.sub(lambda m: m.group().translate(_LETTERLIKE), text.lower())).split()


@functools.cache
def _kinds() -> np.ndarray:
    """Of each code point: 1 if words keep it, 2 if it parts words, and 4 more if it may stand for a letter."""
    kinds = np.fromiter((c.isalnum() + 2 * c.isspace() for c in map(chr, range(0x110000))), np.uint8, 0x110000)
    kinds[list(_LETTERLIKE)] |= 4
    return kinds


def read(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``words_of`` of many texts at once: code points of all words one after another; length and text number of each word."""
    low = [t.lower() for t in texts]
    end = np.cumsum([len(t) + 1 for t in low])
    points = _points("\n".join([*low, ""]))
    kind = _kinds().take(points)
    alike = np.flatnonzero(kind & 4)
    if len(alike):
        last = np.r_[alike[1:] - alike[:-1] > 1, True]
        after = points[alike[last] + 1]
        meant = alike[((after >= 97) & (after <= 122))[np.cumsum(last) - last]]
        letter = np.zeros(128, np.int32)
        letter[list(_LETTERLIKE)] = list(_LETTERLIKE.values())
        points[meant], kind[meant] = letter[points[meant]], 1
    kind &= 3
    seen = np.flatnonzero(kind)
    kept = kind[seen] == 1
    edge = np.flatnonzero(np.diff(np.r_[False, kept, False].view(np.int8)))
    first, n = edge[::2], edge[1::2] - edge[::2]
    return points[seen[kept]], n, np.searchsorted(end, seen[first], "right")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(bytearray(text.encode("utf-32-le", "surrogatepass")), np.int32)


def _text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def _symbols(points: np.ndarray) -> np.ndarray:
    return np.where((points >= 97) & (points <= 122), points - 96, 27 + points % 37)


def symbols(text: str) -> np.ndarray:
    return _symbols(_points(text))


def snippets(texts: list[list[str]]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """All words one after another; start, length and text number of each snippet."""
    flat = [w for t in texts for w in t]
    n = np.fromiter(map(len, flat), np.int64, len(flat))
    return "".join(flat), *snippets_at(n, np.repeat(np.arange(len(texts)), [len(t) for t in texts]))


def snippets_at(n: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text number of each snippet, from length and text number of each word."""
    start = np.cumsum(n) - n
    if not len(n):
        return start, n, text
    pair = np.flatnonzero((text[1:] == text[:-1]) & (n[1:] + n[:-1] <= JOINED))
    edge = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (n[1:] > SHORT) | (n[:-1] > SHORT)])
    size = np.diff(np.r_[edge, len(n)])
    first, last = edge[size > 2], (edge + size)[size > 2] - 1
    start, text, n = (
        np.r_[start, start[pair], start[first]],
        np.r_[text, text[pair], text[first]],
        np.r_[n, n[pair] + n[pair + 1], (start + n)[last] - start[first]],
    )
    parts = np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1
    row = np.repeat(np.arange(len(n)), parts)
    part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    return start[row] + STRIDE * part, np.minimum(WINDOW, n[row] - STRIDE * part), text[row]


def distinct(code: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of one of each lot of equal snippets, and for every snippet the number of its lot.

    Ten symbols fit into one integer, a snippet into two. Rows are sorted by a
    hash of both and lots told apart by both, so no two different ones meet.
    """
    held = 60 // _BITS
    if len(start):
        code, start = code[start.min() : start.max() + WINDOW], start - start.min()
    padded = np.r_[code, np.zeros(2 * held, code.dtype)].astype(np.uint64)
    packed = np.zeros(len(code) + held + 1, np.uint64)
    for i in range(held):
        packed = packed << _BITS | padded[i : i + len(packed)]
    left = (_BITS * (held - np.minimum(n, held))).astype(np.uint64)
    head = packed[start] >> left | n.astype(np.uint64) << 60
    tail = np.zeros(len(n), np.uint64)
    long = np.flatnonzero(n > held)
    tail[long] = packed[start[long] + held] >> (_BITS * (2 * held - n[long])).astype(np.uint64)
    order = np.argsort(head + tail * 0x9E3779B97F4A7C15)
    head, tail = head[order], tail[order]
    new = np.ones(len(n), bool)
    new[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
    lot = np.empty(len(n), np.int64)
    lot[order] = np.cumsum(new) - 1
    return order[new], lot


@functools.cache
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the triples of ``n`` symbols and their weights."""
    at = np.array([c for c in itertools.combinations(range(n), 3) if c[2] - c[0] < SPAN], np.int64)
    return at[:, 0], at[:, 1], at[:, 2], (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


def _keys(code: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Triples (rows) of snippets (columns) of length ``n``, borders at both ends, and their weights."""
    framed = np.zeros((n + 2, len(start)), np.int32)
    framed[1:-1] = code[start[None, :] + np.arange(n)[:, None]]
    i, j, k, weight = _triples(n + 2)
    keys = (framed << 2 * _BITS).take(i, 0)
    keys += (framed << _BITS).take(j, 0)
    keys += framed.take(k, 0)
    return keys, weight


def _norms(keys: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Length of each row's features, the weights of equal triples added up first."""
    bits = len(weight).bit_length()
    placed = np.sort(keys << bits | np.arange(len(weight), dtype=keys.dtype), axis=1)
    keys, value = placed >> bits, weight.astype(np.float64)[placed & (1 << bits) - 1]
    first = np.ones(keys.shape, bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    at = np.flatnonzero(first)
    sums = np.add.reduceat(value.ravel(), at)
    return np.sqrt(np.bincount(at // len(weight), sums * sums, len(keys)))


def _features(words: list[str]):
    """For words of each length: their numbers, triples, and weights over norms."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, rows in by_length.items():
        for k in range(0, len(rows), 256):
            part = rows[k : k + 256]
            keys, weight = _keys(symbols("".join(words[i] for i in part)), np.arange(len(part)) * n, n)
            keys = np.ascontiguousarray(keys.T)
            yield np.array(part), keys, weight[None, :] / _norms(keys, weight)[:, None]


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised subsequence kernel of two lists of snippets of 1 to ``WINDOW`` characters."""
    out = np.zeros((len(a), len(b)), np.float32)
    for c in range(0, len(b), 128):
        marks = list(_features(b[c : c + 128]))
        used = np.unique(np.concatenate([keys.ravel() for _, keys, _ in marks]))
        place = np.zeros(_SIZE**3, np.int64)
        place[used] = np.arange(1, len(used) + 1)
        dense = np.zeros((len(used) + 1, len(b[c : c + 128])), np.float32)
        for rows, keys, value in marks:
            np.add.at(dense, (place[keys], rows[:, None]), value)
        for rows, keys, value in _features(a):
            at = place[keys]
            for r, row in enumerate(rows):
                hit = np.flatnonzero(at[r])
                out[row, c : c + 128] = value[r, hit].astype(np.float32) @ dense[at[r, hit]]
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float | None = None) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last coordinate is the bias."""
    cost = COST if cost is None else cost
    x = np.c_[x, np.ones(len(x), x.dtype)]
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(40):
        active = np.flatnonzero(1 - y * (x @ w) > 0)
        gram, pull = ridge.copy(), np.zeros(x.shape[1])
        for k in range(0, len(active), 2048):
            rows = active[k : k + 2048]
            xa, ca = x[rows].astype(np.float64), cost * weight[rows]
            gram += (xa * ca[:, None]).T @ xa
            pull += xa.T @ (ca * y[rows])
        new = np.linalg.solve(gram, pull)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def machine(positive: list[str], rating: np.ndarray, negative: list[str], marks: list[str]) -> tuple[np.ndarray, float]:
    """Weights of the triples and bias of the SVM with Nyström landmarks ``marks``."""
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    good = values > 1e-5
    root = vectors[:, good] / np.sqrt(values[good])
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    weight = np.r_[rating / rating.sum(), np.full(len(negative), 1 / len(negative))] * len(y) / 2
    w = fit_svm(kernel([*positive, *negative], marks) @ root.astype(np.float32), y, weight)
    beta = root @ w[:-1]
    table = np.zeros(_SIZE**3)
    for rows, keys, value in _features(marks):
        np.add.at(table, keys, value * beta[rows][:, None])
    return table.astype(np.float32), float(w[-1])


def _parts(n: np.ndarray):
    """Rows of equal length, at most 512 together."""
    order = np.argsort(n, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
        for k in range(0, len(rows), 512):
            yield rows[k : k + 512]


def _looks(code: np.ndarray, start: np.ndarray, n: np.ndarray, table: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the triples' weights in snippets, which ones are near the border, and bounds that their margins do not pass.

    Near are those above -1 by the norm without repeated triples. That norm is
    never too large, so no sum above 0 is missed; one below 0 may be, and counts
    as -1. The sum of all weights is never too small a norm. Each column is
    summed by itself, in one order, so that equal snippets get equal sums
    wherever they stand.
    """
    value, near, bound = np.zeros(len(n), np.float32), np.zeros(len(n), bool), np.zeros(len(n))
    for part in _parts(n):
        keys, weight = _keys(code, start[part], int(n[part[0]]))
        found = table.take(keys, mode="clip")
        found *= weight[:, None]
        v = value[part] = found.sum(0)
        least = np.sqrt((weight * weight).sum())
        near[part] = v / least + bias > -1
        bound[part] = v / np.where(v > 0, least, weight.sum()) + bias
    return value, near, bound + 1e-5  # for rounding


def _exact(code: np.ndarray, start: np.ndarray, n: np.ndarray, value: np.ndarray, bias: float) -> np.ndarray:
    out = np.zeros(len(n))
    for part in _parts(n):
        keys, weight = _keys(code, start[part], int(n[part[0]]))
        out[part] = value[part] / _norms(np.ascontiguousarray(keys.T), weight) + bias
    return np.maximum(-1.0, out)


def margins(code: np.ndarray, start: np.ndarray, n: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """SVM margins of snippets, those under -1 as -1; equal snippets are looked up once, and only those near the border need their norm."""
    if len(n) > CHARACTERS:
        return np.concatenate([margins(code, start[k : k + CHARACTERS], n[k : k + CHARACTERS], table, bias) for k in range(0, len(n), CHARACTERS)])
    one, lot = distinct(code, start, n)
    value, near, _ = _looks(code, start[one], n[one], table, bias)
    near, out = np.flatnonzero(near), np.full(len(one), -1.0)
    out[near] = _exact(code, start[one[near]], n[one[near]], value[near], bias)
    return out[lot]


def margins_of(words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    n = np.array([len(w) for w in words], np.int64)
    return margins(symbols("".join(words)), np.cumsum(n) - n, n, table, bias)


def _together(texts: list[str]):
    """Slices of texts that are read together."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > CHARACTERS:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if texts:
        yield slice(begin, len(texts))


def text_margins(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The largest margin among the snippets of each text, at least -1."""
    out = np.full(len(texts), -1.0)
    for these in _together(texts):
        points, n, text = read(texts[these])
        start, n, text = snippets_at(n, text)
        code = _symbols(points)
        for k in range(0, len(n), CHARACTERS):
            part = slice(k, k + CHARACTERS)
            _raise(out[these], code, start[part], n[part], text[part], table, bias)
    return out


def _raise(best: np.ndarray, code: np.ndarray, start: np.ndarray, n: np.ndarray, text: np.ndarray, table: np.ndarray, bias: float) -> None:
    """Raise the largest margins of texts to those of these snippets.

    First each text's snippet with the largest bound gets its norm, then only
    snippets whose bound is above the text's margin by then.
    """
    one, lot = distinct(code, start, n)
    start, n = start[one], n[one]
    value, near, bound = _looks(code, start, n, table, bias)
    near = np.flatnonzero(near[lot])
    near = near[np.lexsort((-bound[lot[near]], text[near]))]
    lot, text = lot[near], text[near]
    lead = np.diff(text, prepend=-1) > 0
    for later in (False, True):
        rows = np.flatnonzero((lead != later) & (bound[lot] > best[text]))
        lots, at = np.unique(lot[rows], return_inverse=True)
        np.maximum.at(best, text[rows], _exact(code, start[lots], n[lots], value[lots], bias)[at])


def witnesses(texts: list[str], toxic: list[int], table: np.ndarray, bias: float) -> list[list[tuple[str, float]]]:
    """The snippets of each text with the largest margins, different ones, best first."""
    out = []
    for these in _together(texts):
        points, n, text = read(texts[these])
        start, n, text = snippets_at(n, text)
        margin = margins(_symbols(points), start, n, table, bias)
        order = np.lexsort((-margin, text))
        ends = np.searchsorted(text[order], np.arange(len(texts[these]) + 1))
        for y, rows in zip(toxic[these], (order[a:b] for a, b in itertools.pairwise(ends))):
            best: dict[str, float] = {}
            for i in rows:
                best.setdefault(_text(points[start[i] : start[i] + n[i]]), float(margin[i]))
                if len(best) == (WITNESSES if y else RIVALS):
                    break
            out.append(list(best.items()))
    return out


def logistic(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a little ridge."""
    x = np.c_[margin, np.ones(len(margin))]
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (weight * (label - p)) - 1e-3 * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _likelihood(margin, slope: float, intercept: float):
    return 1 / (1 + np.exp(-np.clip(slope * np.asarray(margin) + intercept, -30, 30)))


def disguised(word: str, k: int) -> str:
    """The ``k``-th changed copy of a snippet: inside it a letter is inserted, replaced, dropped or doubled, or two are inserted."""
    rng = np.random.default_rng([k, *word.encode("utf-8", "surrogatepass")])
    at, other = rng.integers(1, max(2, len(word) - 1), 2)
    letters = "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 2))
    head, tail = word[:at], word[at:]
    out = [head + letters[0] + tail, head + letters[0] + tail[1:], head + tail[1:], head + head[-1] * 2 + tail, head + letters[0] + tail[: other - at] + letters[1] + tail[other - at :] if other > at else head + letters + tail][k % 5]
    return out[:WINDOW]


def held_out(doc_id) -> F.Column:
    """Rows that training never sees: crc32 of the id's decimal text divides by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _evidence(base: float) -> F.Column:
    """Nats by which a word's share of texts labelled 1 (``bad`` of ``bad + good``) is above the base rate."""
    n = F.col("bad") + F.col("good")
    share = F.col("bad") / n
    side = lambda x, p: F.when(x > 0, x * F.log(x / p)).otherwise(0.0)
    return F.when(share > base, n * (side(share, base) + side(1 - share, 1 - base))).otherwise(0.0)


def _word_batches(batches):
    for b in batches:
        rows = [(k, y, w) for k, t, y in zip(b["copy"].to_pylist(), b["text"].to_pylist(), b["toxic"].to_pylist()) for w in {w[:WINDOW] for w in words_of(t)}]
        copy, toxic, word = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_pydict({"copy": pa.array(copy, pa.int64()), "toxic": pa.array(toxic, pa.int32()), "word": pa.array(word, pa.string())})


def _witness_batches(model):
    def run(batches):
        for b in batches:
            found = witnesses(b["text"].to_pylist(), b["toxic"].to_pylist(), *model.value)
            yield pa.RecordBatch.from_pydict(
                {
                    "copy": b["copy"],
                    "toxic": b["toxic"],
                    "words": pa.array([[w for w, _ in f] for f in found], pa.list_(pa.string())),
                    "margins": pa.array([[m for _, m in f] for f in found], pa.list_(pa.float64())),
                }
            )

    return run


def _fitted(case: tuple) -> tuple[np.ndarray, float]:
    return machine(*case)


def learn(positive: list[str], rating: np.ndarray, negative: list[str], fit, search) -> dict:
    """Rounds of fits: ``fit`` is ``machine``, run wherever; ``search(table, bias)`` gives (copy, label, snippets, margins) of each training text, best snippets first."""
    for _ in range(ROUNDS):
        best = np.argsort(-rating, kind="stable")[: MAX_SNIPPETS // (1 + DISGUISES)]
        positive, rating = [positive[i] for i in best], rating[best]
        marks = list(dict.fromkeys([*positive[: LANDMARKS // 2], *negative[: LANDMARKS // 2]]))
        changed = [disguised(w, k) for k in range(DISGUISES) for w in positive]
        table, bias = fit([*positive, *changed], np.r_[rating, np.tile(rating / DISGUISES, DISGUISES)], negative, marks)
        found = search(table, bias)
        bag, label = np.array([m[0] for _, _, _, m in found]), np.array([y for _, y, _, _ in found], float)
        trust = _likelihood(bag, *logistic(bag, label, np.ones(len(bag))))
        bad: Counter[str] = Counter()
        clean: dict[str, float] = {}
        for p, (_, y, said, margin) in zip(trust, found):
            for w, m in zip(said, margin):
                if y and (m > 0 or m == margin[0]):
                    bad[w] += p
                elif not y and m > -1:
                    clean[w] = m
        positive, rating = list(bad), np.array(list(bad.values()))
        negative = list(dict.fromkeys([*sorted(clean, key=lambda w: (-clean[w], w)), *negative]))[:MAX_SNIPPETS]
    # The border also has to let through what a trusted text would score with its best snippet in disguise.
    toxic = [(p, said[0]) for p, (_, y, said, _) in zip(trust, found) if y]
    hidden = margins_of([disguised(w, k) for k in range(DISGUISES) for _, w in toxic], table, bias)
    share = np.tile([p / DISGUISES for p, _ in toxic], DISGUISES)
    slope, intercept = logistic(np.r_[bag, hidden], np.r_[label, np.ones(len(hidden))], np.r_[np.where(label > 0, trust, 1.0), share])
    return {"table": table, "bias": bias, "slope": max(slope, 0.0), "intercept": intercept}


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict:
    """The model: weights of triples, bias, slope and intercept.

    Uses at most ``max_train`` labelled texts, the first by a hash of the id, and
    ``MAX_SNIPPETS`` snippets of either sign in a fit. Both bounds hold for
    training alone, so what comes to the driver does not grow with the corpus.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    picked = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select("doc_id", text_or_empty("text").alias("text")).join(picked, "doc_id")
    sample = keep(texts.groupBy(F.xxhash64("text").alias("copy"), "toxic").agg(F.first("text").alias("text")).repartition(shuffle_parts(spark), "copy"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    constant = {"table": np.zeros(_SIZE**3, np.float32), "bias": -1.0, "slope": 0.0, "intercept": -30.0}
    if not sizes.get(0) or not sizes.get(1):
        return constant
    words = keep(sample.mapInArrow(_word_batches, "copy long, toxic int, word string"))
    seen = words.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    rated = keep(seen.withColumn("evidence", _evidence(sizes[1] / (sizes[0] + sizes[1]))))
    order = Window.partitionBy("copy").orderBy(F.desc("evidence"), "word")
    chosen = words.where("toxic = 1").join(rated.where("evidence > 0"), "word").withColumn("k", F.row_number().over(order)).where(F.col("k") <= WITNESSES)
    start = {r["word"]: r["weight"] for r in chosen.groupBy("word").agg(F.sum("evidence").alias("weight")).orderBy(F.desc("weight"), "word").limit(MAX_SNIPPETS).collect()}
    fair = rated.where((F.col("good") > 0) & (F.col("evidence") < 2)).orderBy(F.xxhash64("word"), "word")
    negative = [r["word"] for r in fair.limit(MAX_SNIPPETS // 2).collect()]
    if not start or not negative:
        return constant

    def fit(*case) -> tuple[np.ndarray, float]:
        """A fit's matrices (24,000 snippets by 512 landmarks) are made in a task: the driver has no memory to spare for them."""
        return spark.sparkContext.parallelize([case], 1).map(_fitted).first()

    def search(table: np.ndarray, bias: float) -> list:
        shared = spark.sparkContext.broadcast((table, bias))
        found = sample.mapInArrow(_witness_batches(shared), "copy long, toxic int, words array<string>, margins array<double>").collect()
        return sorted((r["copy"], r["toxic"], r["words"], r["margins"]) for r in found if r["words"])

    return learn(list(start), np.array(list(start.values())), negative, fit, search)


def _scores(model, texts: list[str | None]) -> np.ndarray:
    return _likelihood(text_margins([t or "" for t in texts], model["table"], model["bias"]), model["slope"], model["intercept"])


def scored(docs: DataFrame, model: dict, text_col: str = "text", *others: str) -> DataFrame:
    """``others`` columns and score (0 to 1) of every whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(others)], text_or_empty(docs[text_col]).alias("text"))

    def run(batches):
        for b in batches:
            score = pa.array(_scores(shared.value, b["text"].to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], score], [*b.schema.names[:-1], "score"])

    schema = ", ".join([*[f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others)], "score double"])
    return rows.mapInArrow(run, schema).toDF(*others, "score")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns kept.

    Rows pass through the scoring task whole, so nothing is joined or shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scores(shared.value, b["text"].to_pylist()) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model, "text", "doc_id").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
