"""Encoding and decoding with a public sentencepiece model of the merge (BPE) type.

Merging starts from single characters and always joins the adjacent pair that forms
the piece of the highest score, the leftmost of equal ones.  Which merges happen
between two cuts hangs on what lies between them alone, so a row of pieces is the
encoding exactly when each piece is formed on its own and no merge of two neighbours
crosses the cut between them.  The encoder searches for that row by backtracking: an
Aho-Corasick automaton gives the longest piece at every position; a piece is taken if
re-merging it together with its predecessor gives these two again; else the next
shorter prefix is tried, and a position from which none goes on is marked in a
bitfield and never entered again.  The pieces before a position that was reached are
the encoding of the text before it, so each position is left at most once and the
work is linear in the text.

Texts are cut where no piece of the vocabulary can reach over (before white space,
between letters and marks, around characters that stand in no longer piece); a worker
remembers short units.

Defined results: a null text is empty and has no ids; ids are whole for any length of
text; characters without a piece become their bytes' pieces; null ids decode to an
empty text, bytes that are no UTF-8 to the replacement character; rows, repeated ones
included, give one row each; an empty table gives no rows; other columns are kept, but
one with the name of a new column is replaced.
"""

from __future__ import annotations

import hashlib
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from freshet.llm.textbytes import slices

SPACE = "▁"
#: Units a worker remembers in each of two generations, and pairs at most; longer units are encoded anew.
REMEMBERED, SHORT = 400_000, 48
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


class Vocabulary:
    """The pieces of a model file; encodes and decodes single texts."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec, trained = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        if trained.model_type != trained.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only merge models whose text is not normalised are handled")
        if kinds & {USER, UNUSED} or proto.denormalizer_spec.precompiled_charsmap or trained.treat_whitespace_as_suffix:
            raise ValueError("only models without user-defined and unused pieces are handled")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.id_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        byte_of = {i: int(p.piece[1:-1], 16) for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_id = {b: i for i, b in byte_of.items()}
        self.shorter = {p: self._shorter(p) for p in self.id_of}
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.units: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.cut = self._cut()

        self.bytes_of = [p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.bytes_of[i] = bytes([byte_of[i]])
            elif p.type != NORMAL:
                self.bytes_of[i] = trained.unk_surface.encode() if p.type == UNKNOWN else b""
        self.is_byte = [p.type == BYTE for p in proto.pieces]
        self.opens = [p.type == NORMAL and p.piece.startswith(SPACE) for p in proto.pieces]

    def _shorter(self, piece: str) -> str:
        """The longest proper prefix that is a piece or a single character; empty if there is none."""
        return next((piece[:n] for n in range(len(piece) - 1, 0, -1) if n == 1 or piece[:n] in self.id_of), "")

    def _cut(self) -> re.Pattern:
        """Units of a text: no piece reaches from one into the next."""
        longer = [p for p in self.id_of if len(p) > 1]
        joined = set("".join(longer))
        alone = {chr(c) for c in range(128)} - joined
        # Characters, letters aside, that share pieces with each other and with white space only.
        marks = {c for c in joined if c != SPACE and not c.isalpha()}
        while mixed := {c for p in longer for c in p if c in marks and not marks.issuperset(p.replace(SPACE, ""))}:
            marks -= mixed
        kind = lambda chars: "".join(map(re.escape, sorted(chars)))
        parts = [f"[{kind(alone)}]"] * bool(alone)
        if any(b == SPACE and a != SPACE for p in longer for a, b in zip(p, p[1:])):
            return re.compile("|".join([*parts, f"[^{kind(alone)}]+"]) if alone else "(?s:.+)")
        parts += [f"{SPACE}*[{kind(marks)}]+"] * bool(marks)
        return re.compile("|".join([f"{SPACE}*[^{SPACE}{kind(alone | marks)}]+", *parts, f"{SPACE}+"]))

    def _holds(self, text: str, cut: int) -> bool:
        """Whether merging ``text`` ends with pieces that meet at ``cut`` only (0: with one piece), none crossing it."""
        symbols, score = list(text), self.score
        ends = list(range(1, len(text) + 1))
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return len(symbols) == (2 if cut else 1) and (not cut or ends[0] == cut)
            if ends[at] == cut:
                return False
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ends[at]

    def compatible(self, a: str, b: str) -> bool:
        """Whether ``b`` can follow ``a``; an empty ``a`` asks whether ``b`` is formed at all."""
        found = self.pairs.get(a, {}).get(b)
        if found is None:
            if self.n_pairs >= REMEMBERED:
                self.pairs.clear()
                self.n_pairs = 0
            found = self.pairs.setdefault(a, {})[b] = self._holds(a + b, len(a))
            self.n_pairs += 1
        return found

    def split(self, unit: str) -> list[str]:
        """The pieces of a unit, characters without a piece included."""
        n = len(unit)
        longest = list(unit)
        for end, (back, piece) in self.automaton.iter(unit):
            longest[end - back] = piece  # ends ascend, so the longest comes last
        failed = bytearray((n >> 3) + 1)
        shorter, pairs, out = self.shorter.get, self.pairs, []
        at, last, piece = 0, "", longest[0]
        while True:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = pairs[last].get(piece) if last in pairs else None
                if self.compatible(last, piece) if fits is None else fits:
                    out.append(piece)
                    if end == n:
                        return out
                    at, last, piece = end, piece, longest[end]
                    continue
            piece = shorter(piece, "")
            while not piece:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else ""
                piece = shorter(piece, "")

    def _learn(self, unit: str) -> bytes:
        """The ids of a unit that is not among the last ones remembered."""
        found = self.before.get(unit)
        if found is None:
            ids = []
            for p in self.split(unit):
                i = self.id_of.get(p)
                if i is not None:
                    ids.append(i)
                else:
                    ids += [self.byte_id.get(b, self.unknown) for b in p.encode()] if self.byte_id else [self.unknown]
            found = struct.pack(f"<{len(ids)}i", *ids)
        if len(unit) <= SHORT:
            if len(self.units) >= REMEMBERED:
                self.units, self.before = {}, self.units
            self.units[unit] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        units = self.cut.findall(self.prefix + text.replace(" ", SPACE))
        return b"".join([self.units.get(u) or self._learn(u) for u in units])

    def decode(self, ids: list[int]) -> str:
        head, n = [], 0
        if self.prefix:  # the space put before a text goes, wherever its first piece stands
            while n < len(ids) and not head:
                i = ids[n]
                n += 1
                if self.opens[i]:
                    head = [self.bytes_of[i][1:]]
                    break
                if self.bytes_of[i]:
                    n -= 1
                    break
        raw = b"".join([*head, *map(self.bytes_of.__getitem__, ids[n:])])
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._mended(head, ids[n:])

    def _mended(self, head: list[bytes], ids: list[int]) -> str:
        out, run = [b.decode() for b in head], bytearray()
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.bytes_of[i]
                continue
            while run:
                size = next((k for k in range(1, min(4, len(run)) + 1) if _is_character(run[:k])), 0)
                out.append(run[:size].decode() if size else "�")
                del run[: size or 1]
            if i is not None:
                out.append(self.bytes_of[i].decode())
        return "".join(out)


def _is_character(b: bytearray) -> bool:
    try:
        return len(b.decode()) == 1
    except UnicodeDecodeError:
        return False


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """This worker's vocabulary of a model, with what it remembers from earlier tasks."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(model)
    return _vocabularies[key]


def _added(df: DataFrame, source: str, name: str, kind: str, run) -> DataFrame:
    """All columns and a new one, made by ``run`` from batches of the column ``source``."""
    rest = [c for c in df.columns if c != name]
    rows = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(rest)], F.col(f"`{source}`").alias("_source"))

    def step(batches):
        for batch in batches:
            for begin, end, new in run(batch):
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], new], names=[*part.schema.names[:-1], "new"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    out = rows.mapInArrow(step, ", ".join([*kinds, f"new {kind}"]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(rest)], F.col("new").alias(name))


def encode(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The rows with the ids of their whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        own = vocabulary(sent.value)
        for begin, end, data, at in slices(batch, "_source"):
            data = data.tobytes()
            lists = [own.encode(data[a:b].decode("utf-8", "replace")) for a, b in zip(at.tolist(), at[1:].tolist())]
            ends = np.cumsum([0, *map(len, lists)]) // 4
            ids = pa.array(np.frombuffer(b"".join(lists), "<i4"), pa.int32())
            yield begin, end, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)

    return _added(docs, text_col, ids_col, "array<int>", run)


#: Ids decoded at once, unless one list has more.
IDS = 1 << 19


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows with the text that their ids say."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        own = vocabulary(sent.value)
        column = batch.column(batch.num_columns - 1)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(ends):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + IDS, "right")))
            texts = [own.decode(i.as_py() or []) if not i.is_valid else own.decode(i.values.to_numpy().tolist()) for i in column.slice(begin, end - begin)]
            yield begin, end, pa.array(texts, pa.string())
            begin = end

    return _added(rows, ids_col, text_col, "string", run)
