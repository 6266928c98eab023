"""Document quality from a linear-chain conditional random field over its lines.

Every line is good or bad.  A line's features come from its own bytes and words
and from the lines before and after it; the chain adds a weight for each pair of
neighbouring labels.  Forward-backward gives each line's probability of being
good, and the document's score is their mean weighted by line length.

Training takes the lines of labelled documents with the document's label, on at
most ``max_docs`` documents (drawn by a hash of id, the bound holds in
expectation); scoring reads every line of every text.

Defined results: a null or empty text is one empty line; blank lines count with
the weight of their line end; without any training row every score is 1; of
several labels for one id the smallest counts; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from freshet.llm.textbytes import lowered, slices, span_hashes, words

_UPPER, _MARK, _STOP, _DIGIT, _LETTER = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_MARK[[ord(c) for c in "#$%&*!~@^|<>{}[]=+_\\/"]] = True
_STOP[[ord(c) for c in ".,;:?"]] = True
_DIGIT[48:58] = True

#: Cut points for each share; a share becomes itself and one indicator per point.
CUTS = (0.02, 0.08, 0.2, 0.4, 0.6, 0.8)
SHARES = ("upper", "mark", "stop", "digit", "letter", "fresh_words", "fresh_marks", "bars", "line_seen", "before_alike", "short_words", "length")
N_OWN = len(SHARES) * (1 + len(CUTS))
N_FEATURES = 3 * N_OWN + 1


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of each line (lines, SHARES), line lengths, and the first line of each text (one more at the end)."""
    n_docs = len(at) - 1
    inner = np.flatnonzero(data == 10) + 1
    doc_of = np.searchsorted(at, inner, "right") - 1
    inside = np.searchsorted(at[1:], inner) != np.searchsorted(at[1:], inner, "right")
    inner, doc_of = inner[~inside], doc_of[~inside]  # a break that ends a text starts no line
    order = np.argsort(np.concatenate([np.arange(n_docs), doc_of]), kind="stable")
    starts = np.concatenate([at[:-1], inner])[order]
    doc = np.concatenate([np.arange(n_docs), doc_of])[order]
    n = len(starts)
    ends = np.append(starts[1:], len(data))
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    length = ends - starts

    def per_line(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return (sums[ends] - sums[starts]).astype(float)

    upper, letter, mark = per_line(_UPPER[data]), per_line(_LETTER[data]), per_line(_MARK[data])
    stop, digit, bar = per_line(_STOP[data]), per_line(_DIGIT[data]), per_line(data == ord("|"))
    w_start, w_end, _ = words(data, at)
    low = lowered(data)
    w_hash = span_hashes(low, w_start, w_end)
    w_line = np.searchsorted(starts, w_start, "right") - 1
    # An empty text shares its place with the next one's first line, which then owns the words.
    n_words = np.bincount(w_line, minlength=n).astype(float)
    short = np.bincount(w_line[(w_end - w_start) <= 2], minlength=n)

    def kinds(key: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
        one = np.unique((group.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24)))
        return np.bincount((one >> np.uint64(40)).astype(np.int64), minlength=size).astype(float)

    fresh_line = kinds(w_hash, w_line, n)
    fresh_doc = kinds(w_hash, doc[w_line], n_docs) if len(w_line) else np.zeros(n_docs)
    words_doc = np.add.reduceat(n_words, first[:-1]) if n else np.zeros(0)
    l_hash = span_hashes(low, starts, ends, long=1024)
    seen = np.zeros(n)
    if n:
        by = np.lexsort((np.arange(n), l_hash, doc))
        again = (l_hash[by][1:] == l_hash[by][:-1]) & (doc[by][1:] == doc[by][:-1])
        seen[by[1:][again]] = 1.0
    opening = np.zeros(n, np.uint64)
    w_first = np.searchsorted(w_start, starts)
    has = n_words > 0
    opening[has] = w_hash[w_first[has]]
    alike = np.zeros(n)
    alike[1:] = (opening[1:] == opening[:-1]) & has[1:] & (doc[1:] == doc[:-1])
    safe = np.maximum(length, 1)
    shares = np.column_stack([
        upper / np.maximum(letter, 1), mark / safe, stop / safe * 10, digit / safe, letter / safe,
        np.where(has, fresh_line / np.maximum(n_words, 1), 1.0),
        (fresh_doc / np.maximum(words_doc, 1))[doc], np.minimum(1.0, bar / np.maximum(n_words, 1) * 2),
        seen, alike, short / np.maximum(n_words, 1), np.minimum(1.0, np.log1p(length) / 10),
    ])
    return shares, length, first


def expand(shares: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Feature rows: own values and indicators, those of the two neighbours (0 at a text's ends), and 1."""
    n = len(shares)
    own = np.concatenate([shares, *[(shares > c).astype(float) for c in CUTS]], axis=1)
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, :N_OWN] = own
    out[1:, N_OWN : 2 * N_OWN] = own[:-1]
    out[: n - 1, 2 * N_OWN : 3 * N_OWN] = own[1:]
    out[first[:-1], N_OWN : 2 * N_OWN] = 0
    out[first[1:] - 1, 2 * N_OWN : 3 * N_OWN] = 0
    out[:, -1] = 1
    return out


@dataclass
class Field:
    """Weights for label good against bad, and of label pairs (bad 0, good 1)."""

    weights: np.ndarray
    pairs: np.ndarray


def marginals(emit: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Each line's probability of being good, summed pair probabilities, and the log partition sum.

    ``emit``: score of good over bad per line.  All chains advance together, one
    line a step; the longest come first, so those still running are a prefix.
    """
    n_docs = len(first) - 1
    size = np.diff(first)
    by = np.argsort(-size, kind="stable")
    start, size = first[:-1][by], size[by]
    alive = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]) if n_docs else 0)]
    score = np.zeros((len(emit), 2))
    score[:, 1] = emit
    ahead, back = np.zeros((len(emit), 2)), np.zeros((len(emit), 2))
    for t, k in enumerate(alive):
        i = start[:k] + t
        ahead[i] = score[i] if t == 0 else score[i] + np.logaddexp(ahead[i - 1, :1] + pairs[0], ahead[i - 1, 1:] + pairs[1])
    for t in range(len(alive) - 2, -1, -1):
        i = start[: alive[t + 1]] + t
        nxt = score[i + 1] + back[i + 1]
        back[i] = np.logaddexp(pairs[:, 0] + nxt[:, :1], pairs[:, 1] + nxt[:, 1:])
    ends = first[1:] - 1
    total = np.logaddexp(ahead[ends, 0], ahead[ends, 1])
    both = ahead + back
    good = 1.0 / (1.0 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    inner = np.ones(len(emit), bool)
    inner[first[:-1]] = False
    j = np.flatnonzero(inner)
    of = np.repeat(np.arange(n_docs), np.diff(first))[j]
    joint = ahead[j - 1][:, :, None] + pairs[None] + (score[j] + back[j])[:, None, :] - total[of][:, None, None]
    return good, np.exp(joint).sum(axis=0), float(total.sum())


def fit(shares: np.ndarray, length: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 200, ridge: float = 1e-3, rate: float = 0.08) -> Field:
    """Maximum likelihood with a ridge, by Adam on all chains; each line weighs as the chain gives it."""
    x = expand(shares, first)
    y = np.repeat(label.astype(float), np.diff(first))
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    j = np.flatnonzero(inner)
    want = np.zeros((2, 2))
    np.add.at(want, (y[j - 1].astype(int), y[j].astype(int)), 1)
    theta, m, v = np.zeros(N_FEATURES + 4), 0.0, 0.0
    # Moves start at the share of good lines.
    theta[N_FEATURES - 1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for step in range(1, steps + 1):
        w, pairs = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        good, got, _ = marginals(x @ w, pairs, first)
        slope = np.concatenate([x.T @ (good - y), (got - want).ravel()]) / len(y) + ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))


def scores(field: Field | None, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' probabilities, for each text."""
    if field is None:
        return np.ones(len(at) - 1)
    shares, length, first = line_features(data, at)
    good, _, _ = marginals(expand(shares, first) @ field.weights, field.pairs, first)
    weight = np.maximum(length, 1).astype(float)
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 4000) -> Field | None:
    """Fit on the labelled rows given; the caller leaves out what must not be learned from."""
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    total = known.count()
    if not total:
        return None
    draw = F.pmod(F.xxhash64(F.lit("quality"), "_id"), F.lit(1_000_000)) * F.lit(total) < F.lit(max_docs * 1_000_000)
    drawn = docs.join(F.broadcast(known.filter(draw)), F.col(id_col) == F.col("_id"))

    def run(batches):
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            for begin, end, data, at in slices(batch, "text"):
                shares, length, first = line_features(data, at)
                for k in range(end - begin):
                    a, b = first[k], first[k + 1]
                    row = {"label": [int(label[begin + k])], "length": [length[a:b].tolist()], "shares": [shares[a:b].ravel().tolist()]}
                    yield pa.RecordBatch.from_pydict(row, pa.schema([("label", pa.int32()), ("length", pa.list_(pa.int64())), ("shares", pa.list_(pa.float64()))]))

    rows = drawn.select(F.col("_label").cast("int").alias("label"), F.col(text_col).alias("text"), F.xxhash64("_id").alias("key"))
    rows = rows.mapInArrow(run, "label int, length array<long>, shares array<double>").toPandas()
    if not len(rows):
        return None
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (rows["label"][i], len(rows["length"][i]), tuple(rows["shares"][i][:24])))]
    first = np.concatenate([[0], np.cumsum([len(x) for x in rows["length"]])])
    shares = np.concatenate([np.asarray(x) for x in rows["shares"]]).reshape(-1, len(SHARES))
    return fit(shares, np.concatenate([np.asarray(x) for x in rows["length"]]), first, rows["label"].to_numpy())


def predict(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for begin, end, data, at in slices(batch, "text"):
                out[begin:end] = scores(shared.value, data, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, score double")
