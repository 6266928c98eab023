"""Token pieces of whole texts by a public tokenizer file.

Byte-level BPE never joins bytes across the end of a word, so a text is cut after
each word (a word takes the white space before it), and between a word's letters and
an ASCII mark or digit behind them; a worker encodes each distinct unit once and remembers it by
its bytes.  Texts with white space beyond ASCII are encoded as a whole.

Defined results: a null text is empty; rows, repeated ones included, are cut one by
one; a null id stays null; an empty table gives no rows; of the input's columns only
the id and the text are read.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from freshet.llm.textbytes import slices

#: Units a worker remembers in each of two generations; longer ones are encoded anew.
REMEMBERED, SHORT = 600_000, 64

#: Bytes of text cut into units at once.
SLICE_BYTES = 8 << 20

#: White space and then letters before another ASCII character, or all up to the next
#: white space.  Of the letters beyond ASCII only U+00C0 to U+00FF are told here; a unit
#: starts at a character, so other characters end their run before a byte above 127.
UNIT = re.compile(
    rb"[\x20\x09-\x0D]*+(?:[A-Za-z\xC3\x80-\x96\x98-\xB6\xB8-\xBF]++(?=[!-@\[-`{-~])|[^\x20\x09-\x0D]++)"
    rb"|[\x20\x09-\x0D]++"
)
#: White space beyond ASCII, as UTF-8.
ODD_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Encoder:
    """Token ids of texts.  Remembers units it has seen, up to ``remembered`` in a generation."""

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # one character of a token stands for one byte
            self.n_bytes[i] = len(token)
        self.remembered = REMEMBERED
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encoded(self, units: list[bytes]) -> dict[bytes, bytes]:
        """Ids of units: those that open with white space and hold a word, many in one text."""
        out: dict[bytes, bytes] = {}
        joined, apart = [], []
        for u in units:
            (joined if u[:1].isspace() and not u[-1:].isspace() else apart).append(u)
        out.update(zip(apart, self.whole([u.decode("utf-8", "replace") for u in apart])))
        groups = [joined[i : i + 512] for i in range(0, len(joined), 512)]
        for group, ids in zip(groups, self.whole([b"".join(g).decode("utf-8", "replace") for g in groups])):
            reached = np.cumsum(self.n_bytes[np.frombuffer(ids, "<u4")])
            ends = np.cumsum([len(u) for u in group])
            cut = np.searchsorted(reached, ends) + 1
            if (reached[cut - 1] != ends).any():
                raise ValueError("a token reaches over the end of a word")
            first = 0
            for u, last in zip(group, cut.tolist()):
                out[u] = ids[4 * first : 4 * last]
                first = last
        return out

    def _learn(self, texts: list[list[bytes]]) -> dict[bytes, bytes]:
        """Ids of the units of some texts; remembers the short ones."""
        wanted = set().union(*texts)
        found = {u: self.known[u] for u in wanted if u in self.known}
        new = [u for u in wanted if u not in found]
        more = {u: self.before[u] for u in new if u in self.before}
        more.update(self._encoded([u for u in new if u not in more]))
        if len(self.known) > self.remembered:
            self.known, self.before = found.copy(), self.known
        self.known.update((u, ids) for u, ids in more.items() if len(u) <= SHORT)
        found.update(more)
        return found

    def encode(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        data, at = data.tobytes(), at.tolist()
        texts = [data[a:b] for a, b in zip(at, at[1:])]
        odd = [i for i, t in enumerate(texts) if not t.isascii() and ODD_SPACE.search(t.decode("utf-8", "replace"))]
        apart = set(odd)
        units = [[] if i in apart else UNIT.findall(t) for i, t in enumerate(texts)]
        found = self._learn(units)
        out = [b"".join(map(found.__getitem__, own)) for own in units]
        for i, ids in zip(odd, self.whole([texts[i].decode("utf-8", "replace") for i in odd])):
            out[i] = ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(source: str) -> Encoder:
    """This process's encoder for a tokenizer, with what it remembers from earlier tasks."""
    if source not in _encoders:
        _encoders.clear()
        _encoders[source] = Encoder(source)
    return _encoders[source]


def pieces(
    docs: DataFrame, tokenizer_json: str, capacity: int, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
    remembered: int = REMEMBERED, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document.

    A document is its ids and then ``end_id``; only one of more than ``capacity``
    ids is cut, into pieces of ``capacity`` of which the first may be shorter.  A
    null text is empty: one piece that holds ``end_id`` alone.  ``remembered`` and
    ``slice_bytes`` trade a worker's memory for time; the pieces are the same.
    """
    source = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        own_encoder = encoder(source.value)
        own_encoder.remembered = remembered
        for batch in batches:
            for begin, end, data, at in slices(batch, "text", slice_bytes):
                ids = own_encoder.encode(data, at)
                rows = {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}
                for d in range(end - begin):
                    own = np.append(np.frombuffer(ids[d], "<u4"), np.uint32(end_id)).astype("<u4")
                    cut = 0
                    stop = len(own) % capacity or min(capacity, len(own))
                    number = 0
                    while cut < len(own):
                        rows["row"].append(begin + d)
                        rows["piece"].append(number)
                        rows["start"].append(cut)
                        rows["length"].append(stop - cut)
                        rows["crc"].append(zlib.crc32(own[cut:stop].tobytes()))
                        if with_ids:
                            rows["ids"].append(own[cut:stop].astype(np.int32))
                        cut, stop, number = stop, stop + capacity, number + 1
                out = [batch.column(0).take(pa.array(rows["row"], pa.int64())), pa.array(rows["piece"], pa.int32())]
                out += [pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc")]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array(rows["ids"], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
