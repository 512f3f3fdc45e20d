"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file compiles into one transducer: the normaliser (white space to U+2581, the leading one), an arc for
every piece, and for every character without a piece its UTF-8 bytes. Composed with an input it is a lattice
over the input's characters; the shortest path in the tropical semiring (weights add along a path, the
least sum wins) is the encoding. A state is a place in the input and the piece before it:

* unigram models: an arc weighs minus its piece's score;
* byte-pair models: an arc weighs 0 if merging would have left the two pieces apart, else it is missing. One path
  remains, the one that merging gives (each neighbouring pair alone decides that), so it is the shortest one.

A path never crosses from a character to U+2581 inside a piece where no piece does; there the input is cut
into segments, each composed on its own and kept for the next time it occurs, up to a bound.

Cases: a null text has null ids, an empty one none; null ids decode to null. Bytes that are no UTF-8 decode to
U+FFFD. U+2581 in a text decodes to a space, as the model file's own library does it. Ids outside the model
raise an error. Normalisers other than identity are refused when compiling.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
# Fixed values of the model file: kinds of pieces, kinds of models.
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Segments kept by a worker at most; beyond, it starts anew.
MOST_KEPT = 1_000_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message: ints, floats as 4 bytes, messages as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Transducer:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        pieces, trainer, norm = [dict(_fields(v)) for n, v in model if n == 1], {}, {}
        for n, v in model:
            trainer |= dict(_fields(v)) if n == 2 else {}
            norm |= dict(_fields(v)) if n == 3 else {}
        if norm.get(2):
            raise ValueError("only models with the identity normaliser can be compiled")
        self.kind, self.prefix, self.escape, self.squeeze = trainer.get(3, UNIGRAM), norm.get(3, 1), norm.get(5, 1), norm.get(4, 1)
        self.compile([(p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)) for p in pieces])

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], kind: int, prefix: bool = True) -> Transducer:
        """Of (piece, score, kind) in the order of ids."""
        self = cls.__new__(cls)
        self.kind, self.prefix, self.escape, self.squeeze = kind, prefix, True, False
        self.compile(pieces)
        return self

    def compile(self, pieces: list[tuple[str, float, int]]) -> None:
        self.pieces = [p for p, _, _ in pieces]
        self.arc = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
        self.score = [s for _, s, _ in pieces]
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.byte = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.longest = max(map(len, self.arc), default=1)
        values = {i: bytes([b]) for b, i in self.byte.items()}
        control = {i for i, (_, _, kind) in enumerate(pieces) if kind not in (NORMAL, USER_DEFINED, BYTE)}
        self.bytes_of = [values.get(i, b"" if i in control else p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)]
        alphabet = {c for p in self.arc for c in p}
        known = "".join(re.escape(c) for c in sorted(alphabet - {SPACE}))
        crosses = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.arc)
        # where no piece joins a letter and another character, no path does: such places cut segments too
        kinds = [{c for c in alphabet - {SPACE} if c.isalpha() == letter} for letter in (True, False)]
        mixed = any({c.isalpha() for c in p if c != SPACE} == {True, False} for p in self.arc)
        runs = [known] if mixed else ["".join(re.escape(c) for c in sorted(k)) for k in kinds]
        parts = f"(?:{SPACE}|[{known}])+" if crosses and known else "|".join([*(f"{SPACE}*[{r}]+" for r in runs if r), f"{SPACE}+"])
        self.segment = re.compile(f"{parts}|[^{known}{SPACE}]+")
        self.alphabet, self.kept, self.pairs, self.first_edges, self.last_edges = alphabet, {}, {}, {}, {}

    def _merges(self, text: str) -> tuple[list[int], str]:
        """What merging makes of a text, the best scored neighbours first, of equal ones the leftmost; and the last merge's right part."""
        parts, right = list(text), ""
        while True:
            best = None
            for i in range(len(parts) - 1):
                t = self.arc.get(parts[i] + parts[i + 1])
                if t is not None and (best is None or self.score[t] > best[0]):
                    best = (self.score[t], i)
            if best is None:
                return [self.arc.get(p, -1) for p in parts], right
            i, right = best[1], parts[best[1] + 1]
            parts[i : i + 2] = [parts[i] + right]

    def _edge(self, piece: str, last: bool) -> list[tuple[str, float]]:
        """The parts that stand at an edge of a piece while it is merged, smallest first, each with the score at which it grows."""
        edges = self.last_edges if last else self.first_edges
        if piece not in edges:
            found, right = self._merges(piece)
            if len(found) != 1:
                raise ValueError(f"merging can't make the piece {piece!r}")
            part = right if last else piece[: len(piece) - len(right)]
            edges[piece] = [(piece, float("-inf"))]
            if len(piece) > 1:
                edges[piece] = [*self._edge(part, last)[:-1], (part, self.score[found[0]]), *edges[piece]]
        return edges[piece]

    def _apart(self, before: str, after: str) -> bool:
        """Whether merging leaves the two pieces apart: while both grow, no merge across is due before theirs."""
        left, right, i, j = self._edge(before, True), self._edge(after, False), 0, 0
        while True:
            (a, grows_a), (b, grows_b) = left[i], right[j]
            t = self.arc.get(a + b)
            if t is not None and self.score[t] > grows_a and self.score[t] >= grows_b:
                return False
            if i == len(left) - 1 and j == len(right) - 1:
                return True
            if grows_a >= grows_b:
                i += 1
            else:
                j += 1

    def _weight(self, before: int, piece: int) -> float | None:
        """Of the arc of piece after before (-1: none): None if there is none."""
        if self.kind != BPE:
            return -self.score[piece]
        if before < 0:
            return 0.0
        pair = before * len(self.pieces) + piece
        found = self.pairs.get(pair)
        if found is None:
            if len(self.pairs) > MOST_KEPT:
                self.pairs.clear()
            found = self.pairs[pair] = self._apart(self.pieces[before], self.pieces[piece])
        return 0.0 if found else None

    def _bytes(self, text: str) -> list[int]:
        if not self.byte:
            return [self.unknown]
        return [self.byte[b] for b in text.encode()]

    def shortest_path(self, text: str) -> list[int]:
        """Of a segment whose characters all stand in pieces."""
        if self.kind == BPE:
            return self._only_path(text)
        n, arc = len(text), self.arc
        cost: list[float | None] = [0.0] + [None] * n
        piece, start = [-1] * (n + 1), [0] * (n + 1)
        worst = min(self.score, default=0.0) - 10
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                if cost[j] is None:
                    continue
                t = arc.get(text[j:i])
                w = None if t is None else self._weight(piece[j], t)
                if w is not None and (cost[i] is None or cost[j] + w < cost[i]):
                    cost[i], piece[i], start[i] = cost[j] + w, t, j
            j = i - 1
            if cost[j] is not None and text[j:i] not in arc and (cost[i] is None or cost[j] - worst < cost[i]):
                cost[i], piece[i], start[i] = cost[j] - worst, -1, j
        out: list[list[int]] = []
        while n:
            out.append([piece[n]] if piece[n] >= 0 else self._bytes(text[start[n] : n]))
            n = start[n]
        return [i for part in reversed(out) for i in part]

    def _only_path(self, text: str) -> list[int]:
        """The same where weights are 0 or missing: the one path there is, so each place is reached from one before."""
        n, arc, weight, longest = len(text), self.arc, self._weight, self.longest
        whole = arc.get(text)
        if whole is not None:
            return [whole]
        piece, start = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(i - longest if i > longest else 0, i):
                t = arc.get(text[j:i])
                if t is not None and (j == 0 or weight(piece[j], t) is not None):
                    piece[i], start[i] = t, j
                    break
            else:
                piece[i], start[i] = -1, i - 1
        out: list[list[int]] = []
        while n:
            out.append([piece[n]] if piece[n] >= 0 else self._bytes(text[start[n] : n]))
            n = start[n]
        return [i for part in reversed(out) for i in part]

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        text = (" " if self.prefix else "") + text
        return text.replace(" ", SPACE) if self.escape else text

    def encode(self, text: str) -> list[int]:
        out, kept = [], self.kept
        for s in self.segment.findall(self.normalise(text)):
            ids = kept.get(s)
            if ids is None:
                ids = self.shortest_path(s) if s[0] in self.alphabet else [i for c in s for i in self._bytes(c)]
                if len(kept) > MOST_KEPT:
                    kept.clear()
                if len(s) < 64:
                    kept[s] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        text = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_compiled: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """The file's transducer, compiled once in a worker."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, to: str = "ids") -> DataFrame:
    path = path or default_path()

    @F.pandas_udf("array<int>")
    def ids(text: pd.Series) -> pd.Series:
        return text.map(lambda t: compiled(path).encode(t) if isinstance(t, str) else None)

    return df.withColumn(to, ids(text_col))


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None, to: str = "text") -> DataFrame:
    path = path or default_path()

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else compiled(path).decode(x))

    return df.withColumn(to, text(ids_col))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_ids, ids_crc32, n_byte_ids, round_trip): of each text's ids as little-endian unsigned 32-bit numbers; null texts are empty."""
    path = path or default_path()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(path)
        is_byte = np.zeros(len(fst.pieces), bool)
        is_byte[list(fst.byte.values())] = True
        for batch in batches:
            n, crc, n_bytes, same = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids = fst.encode(text)
                a = np.array(ids, "<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(a.tobytes()))
                n_bytes.append(int(is_byte[a].sum()))
                same.append(fst.decode(ids) == text.replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(same, pa.bool_())], ["id", "n_ids", "ids_crc32", "n_byte_ids", "round_trip"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_ids long, ids_crc32 long, n_byte_ids long, round_trip boolean").withColumnRenamed("id", id_col)
