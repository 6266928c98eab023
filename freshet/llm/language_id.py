"""Language identification by prediction with partial matching (PPM).

Each language has a tree of byte contexts of up to three bytes with the counts of
the bytes that followed.  A byte costs -log2 of its share where its context has
seen it; else the context's escape, and the next shorter context decides, down to
one in 256.  Escapes are by method C: with n bytes of q kinds seen, a byte seen c
times has c / (n + q) and the escape q / (n + q).  The statistics are frozen after
training; a text gets the language under which its code length is least.

The trees of all languages are flattened to one table: for each gram (context and
byte) known in any language, its full cost in every language, and for each context
its escapes.  Costs are whole 1/1024 bits, so sums are exact.

Training counts grams on at most ``per_language`` texts of each language (drawn by
a hash of id, the bound holds in expectation) and keeps at most ``max_grams`` grams
of a language; both bound the model.  Scoring reads every byte of every text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so
is every text if nothing was learned; equal code lengths go to the smaller name;
texts start in the context of three line ends; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.llm.textbytes import slices

ORDER = 3
UNKNOWN = "und"
_SCALE = 1024
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The gram that ends at each byte; before its start a text has line ends."""
    gram = data.astype(np.uint32)
    for k in range(1, ORDER + 1):
        before = np.full(len(data), 10, np.uint32)
        before[k:] = data[:-k]
        for j in range(k):
            edge = at[:-1] + j
            before[edge[edge < at[1:]]] = 10
        gram |= before << np.uint32(8 * k)
    return gram


class _Map:
    """Fixed set of 32-bit keys; ``find`` gives each key's row, or -1."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(len(keys) * 4 + 4))))
        size = 1 << self.bits
        self.key = np.zeros(size, np.uint32)
        self.row = np.full(size, -1, np.int32)
        self.probes = 0
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            self.probes += 1
            free = self.row[slot] < 0
            self.row[slot[free]] = left[free]  # of several for one slot, the last stays
            won = self.row[slot] == left
            self.key[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        row = self.row[slot]
        other = np.flatnonzero((row >= 0) & (self.key[slot] != keys))
        for _ in range(self.probes):
            if not len(other):
                break
            slot[other] = (slot[other] + 1) & (len(self.row) - 1)
            row[other] = self.row[slot[other]]
            other = other[(row[other] >= 0) & (self.key[slot[other]] != keys[other])]
        row[other] = -1
        return row


@dataclass
class Model:
    """Frozen statistics: per order the known grams with costs and the known contexts with escapes."""

    languages: list[str]
    grams: list  # by order 0 .. ORDER: _Map
    costs: list  # by order: int32 (grams, languages)
    contexts: list  # by order
    escapes: list

    def cost(self, gram: np.ndarray) -> np.ndarray:
        """Cost of each gram in every language, int32 in 1/1024 bit."""
        row = self.grams[ORDER].find(gram)
        out = self.costs[ORDER][row]
        left = np.flatnonzero(row < 0)
        if len(left):
            out[left] = self._shorter(gram[left], ORDER)
        return out

    def _shorter(self, gram: np.ndarray, order: int) -> np.ndarray:
        seen = self.contexts[order].find(gram >> np.uint32(8))
        total = np.where((seen >= 0)[:, None], self.escapes[order][seen], 0)
        if order == 0:
            return total + 8 * _SCALE
        gram = gram & np.uint32((1 << 8 * order) - 1)
        row = self.grams[order - 1].find(gram)
        rest = self.costs[order - 1][row]
        left = np.flatnonzero(row < 0)
        if len(left):
            rest[left] = self._shorter(gram[left], order - 1)
        return total + rest


def freeze(counts: pd.DataFrame) -> Model:
    """Model from rows (lang, gram, n) with grams of ORDER + 1 bytes."""
    languages = sorted(counts["lang"].unique(), key=lambda s: s.encode())
    n_lang = len(languages)
    model = Model(languages, [], [], [], [])
    index = counts["lang"].map({s: i for i, s in enumerate(languages)}).to_numpy(np.int64)
    gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    for order in range(ORDER + 1):
        part = gram & ((1 << 8 * (order + 1)) - 1)
        known, at = np.unique(part, return_inverse=True)
        c = np.zeros((len(known), n_lang))
        np.add.at(c, (at, index), n)
        context, of = np.unique(known >> 8, return_inverse=True)
        total, kinds = np.zeros((len(context), n_lang)), np.zeros((len(context), n_lang))
        np.add.at(total, of, c)
        np.add.at(kinds, of, c > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            own = -np.log2(c / (total + kinds)[of])
        if order:
            low = model.costs[order - 1][model.grams[order - 1].find((known & ((1 << 8 * order) - 1)).astype(np.uint32))]
        else:
            low = np.full((len(known), n_lang), 8 * _SCALE)
        cost = np.where(c > 0, np.rint(own * _SCALE), np.rint(escape[of] * _SCALE) + low)
        model.grams.append(_Map(known.astype(np.uint32)))
        model.costs.append(cost.astype(np.int32))
        model.contexts.append(_Map(context.astype(np.uint32)))
        model.escapes.append(np.rint(escape * _SCALE).astype(np.int32))
    return model


def held_out(id_col: str | Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls into the part set aside."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part


def _count(batches):
    """Gram counts by language, added up over the task's texts."""
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        lang = np.array(batch.column(0).to_pylist(), dtype=object)
        for first, end, data, at in slices(batch, "text"):
            gram = _grams(data, at)
            of = np.repeat(lang[first:end], np.diff(at))
            for name in sorted(set(lang[first:end])):
                kinds, n = np.unique(gram[of == name], return_counts=True)
                if name in found:
                    both = np.concatenate([found[name][0], kinds])
                    kinds, inverse = np.unique(both, return_inverse=True)
                    n = np.bincount(inverse, np.concatenate([found[name][1], n])).astype(np.int64)
                found[name] = kinds, n
    for name, (kinds, n) in found.items():
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array([name] * len(kinds), pa.string()), "gram": pa.array(kinds.astype(np.int64)), "n": pa.array(n.astype(np.int64))}
        )


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, max_grams: int = 1 << 17) -> Model:
    """Fit on rows with a language and a text; the caller leaves out what must not be learned from."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(F.col(lang_col).alias("_lang")).count()
    draw = F.pmod(F.xxhash64(F.lit("learn"), id_col), F.lit(1_000_000)) * F.col("count") < F.lit(per_language * 1_000_000)
    drawn = rows.join(F.broadcast(sizes.orderBy(F.desc("count"), "_lang").limit(10_000)), F.col(lang_col) == F.col("_lang")).filter(draw)
    counts = drawn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return freeze(counts.withColumn("_nth", best).filter(F.col("_nth") <= max_grams).drop("_nth").toPandas())


def code_lengths(model: Model, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits (in 1/1024) of each text in every language."""
    out = np.zeros((len(at) - 1, len(model.languages)), np.int64)
    gram = _grams(data, at)
    if len(gram):
        some = np.flatnonzero(np.diff(at) > 0)
        out[some] = np.add.reduceat(model.cost(gram), at[some], axis=0, dtype=np.int64)
    return out


def _has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    plain, high = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTER[data], out=plain[1:])
    np.cumsum(data >= 128, out=high[1:])
    out = plain[at[1:]] > plain[at[:-1]]
    for i in np.flatnonzero(~out & (high[at[1:]] > high[at[:-1]])):
        out[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predict(
    docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """Adds the language and its score (the best language's share of the probability) under ``names`` to the columns ``keep``."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    copy_text = [i for i, c in enumerate(keep) if c == text_col]
    if copy_text:  # one copy of the text goes to Python
        kept = docs.select(*[F.col(c).alias(f"k{i}" if i not in copy_text else "text") for i, c in enumerate(keep)])
    passed = kept.columns

    def run(batches):
        model = shared.value
        for batch in batches:
            n_lang = len(model.languages)
            pred, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for first, end, data, at in slices(batch, "text") if n_lang else ():
                bits = code_lengths(model, data, at)
                best = bits.argmin(axis=1)
                over = (bits - bits[np.arange(len(best)), best][:, None]) / _SCALE
                share = 1.0 / np.exp2(-np.minimum(over, 1000.0)).sum(axis=1)
                some = _has_letter(data, at)
                pred[first:end] = np.where(some, np.array(model.languages, object)[best], UNKNOWN)
                score[first:end] = np.where(some, share, 0.0)
            cols = [batch.column(i) for i in range(len(passed))]
            out = [c for c, name in zip(cols, passed) if name != "text" or copy_text]
            fields = [name for name in passed if name != "text" or copy_text]
            yield pa.RecordBatch.from_arrays([*out, pa.array(list(pred), pa.string()), pa.array(score)], names=[*fields, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "text" or copy_text)
    out = kept.mapInArrow(run, f"{kinds + ', ' if kinds else ''}lang_pred string, score double")
    back = [F.col("text" if i in copy_text else f"k{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(*back, F.col("lang_pred").alias(names[0]), F.col("score").alias(names[1]))
