"""Shortest-pack-first histogram packing of tokenised documents into sequences of a fixed length.

Every document is tokenised and closed by an end id; what is longer than a sequence gives full pieces, and its last piece is the rest. The driver
plans with the histogram of the pieces' lengths alone, at most one number for each length, whatever the input: lengths are placed longest first,
all pieces of a length at once, each into the pack that is shortest so far (has most room) of those with room; a pack is opened only if none has. Packs with the same
pieces are one pattern with a count, split when fewer pieces are left than packs.

Documents may be cut, so what is padding in the packing's own result is filled: the shortest packs that aren't full are taken apart, and their pieces, one after
the other, are cut to the size of the others' gaps; of all tokens fewer than a sequence are left, and these go to sequences that are powers of two long, which need no
padding. No sequence is padded.

Patterns go back to documents by rank: a piece's rank among those of its length is its place in its task plus the counts of the tasks before,
so no window holds a length's pieces. Token ids are written once, and read again only for pieces that were cut.

Cases: a null text is empty: its document is the end id alone. Rows that repeat are packed each. A null id is kept. Pieces of equal length rank by task and place
there. Columns other than the id and the text play no part, whatever their names. An empty table gives no piece.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Distinct words that a worker keeps the ids of; they are forgotten when there are more.
WORDS = 1 << 19
#: Characters of texts that are encoded together; a longer text is encoded alone.
HANDED_ON = 1 << 19
# Fixed value: how the tokenizer file splits a text, after NFC and in lower case.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same pattern for texts without the characters of _OTHER, with the letters and numbers of U+0080 to U+024F.
_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|[^\\sa-z0-9ªµºß-öø-ɏ²³¹¼-¾]+")
_OTHER = re.compile("[^\x00-\x1b\x20-ɏ‐-‧€]|<\\|")


class WordEncoder:
    """Ids of a tokenizer whose words don't see each other, as little-endian 32-bit integers.

    Each distinct word is encoded once. Of texts in Latin letters a word is what the tokenizer itself splits off, and all new words of some texts are encoded as
    one text, whose ids end words where their tokens do; of others it is what stands between ASCII white space, which this kind of tokenizer drops before it splits.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.chunks = Tokenizer.from_file(path), {}, {}
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        splits = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        steps = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers") or []]
        self.latin = splits[0].get("pattern") == {"Regex": PATTERN} and steps == ["NFC", "Replace", "Lowercase"] and told["model"].get("end_of_word_suffix") == "</w>"
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def _encode(self, words: list[str], into: dict) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            into[w] = np.array(e.ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        (all_,) = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(all_.ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            return self._encode(words, self.known)
        raw, at = ids.tobytes(), 0
        for w, stop in zip(words, (4 * stops).tolist(), strict=True):
            self.known[w], at = raw[at:stop], stop
        return None

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) + len(self.chunks) > WORDS:
            self.known, self.chunks = {}, {}
        latin = [self.latin and not _OTHER.search(t) for t in texts]
        words = [_LATIN.findall(t.lower()) if x else None for t, x in zip(texts, latin, strict=True)]
        new = [w for w in set().union(*(x for x in words if x)) if w not in self.known]
        if new:
            self._learn(new)
        out = [b"".join(map(self.known.__getitem__, own)) if own is not None else self._by_chunks(t) for t, own in zip(texts, words, strict=True)]
        for w in new:
            if len(w) > 64:
                del self.known[w]
        return out

    def _by_chunks(self, text: str) -> bytes:
        chunks = [c.decode() for c in text.encode().split()]
        self._encode([c for c in set(chunks) if c not in self.chunks], self.chunks)
        out = b"".join(map(self.chunks.__getitem__, chunks))
        for c in set(chunks):
            if len(c) > 64:
                del self.chunks[c]
        return out


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One for all tasks that a worker runs."""
    return WordEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_BASE = "part int, place long, start long, length int, nth long, crc long, doc_tokens long, ids binary"


def _tokenised(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, place = encoder(path), TaskContext.get().partitionId(), 0
        end, seen = np.array([end_id], "<u4").tobytes(), np.zeros(size + 1, np.int64)
        for batch in batches:
            i = 0
            while i < batch.num_rows:
                texts, first, chars = [], i, 0
                while i < batch.num_rows and chars < HANDED_ON:
                    texts.append(batch.column(1)[i].as_py() or "")
                    chars, i = chars + len(texts[-1]), i + 1
                row, rows = [], []
                for j, ids in enumerate(encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    for a in range(0, n, size):
                        piece = ids[4 * a : 4 * (a + size)]
                        length = len(piece) // 4
                        row.append(first + j)
                        rows.append((part, place, a, length, int(seen[length]), zlib.crc32(piece), n, piece))
                        seen[length] += 1
                        place += 1
                yield _batch(batch, row, rows)

    return run


def _batch(batch: pa.RecordBatch, row: list[int], rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    arrays = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *arrays], ["id", *(x.split()[0] for x in _BASE.split(", "))])


class Plan:
    """Where the pieces of each length and range of ranks go, for a histogram of lengths.

    slots: (length, first rank, count, first sequence, offset): such pieces lie whole, one in each of `count` sequences.
    torn: (length, first rank, count, place): such pieces are taken apart; joined in this order they are one run of ids, which begins at 0 and fills the gaps.
    gaps: (place, count, room, first sequence, offset): from `place` of that run on, `count` gaps of `room` ids, one in each of as many sequences.
    """

    def __init__(self, histogram: dict[int, int], size: int):
        self.size, self.slots, self.torn, self.gaps, self.sequences = size, [], [], [], 0
        self._open: dict[int, list] = {}  # by room left, patterns: (count, [(length, first rank, offset)])
        self._rooms: list[int] = []
        for length in sorted(histogram, reverse=True):
            self._place(length, histogram[length])
        self._fill()

    def _pattern(self, room: int, count: int, slots: list) -> None:
        if not room:
            self._number(count, slots)
            return
        if not self._open.get(room):
            heapq.heappush(self._rooms, -room)
        self._open.setdefault(room, []).append((count, slots))

    def _number(self, count: int, slots: list) -> int:
        self.slots += [(length, rank, count, self.sequences, offset) for length, rank, offset in slots]
        self.sequences += count
        return self.sequences - count

    @staticmethod
    def _split(pattern: tuple, n: int) -> tuple[tuple, tuple]:
        count, slots = pattern
        return (n, slots), (count - n, [(length, rank + n, offset) for length, rank, offset in slots])

    def _place(self, length: int, n: int) -> None:
        rank, size = 0, self.size
        while n:
            room = -self._rooms[0] if self._rooms else 0
            if room >= length:
                pattern = self._open[room].pop()
                if not self._open[room]:
                    heapq.heappop(self._rooms)
                if n < pattern[0]:
                    pattern, rest = self._split(pattern, n)
                    self._pattern(room, *rest)
                count, slots = pattern
                self._pattern(room - length, count, [*slots, (length, rank, size - room)])
                rank, n = rank + count, n - count
            else:  # no pack has room: as many new ones as are full of this length, or one
                each = min(size // length, n)
                count = n // each
                self._pattern(size - each * length, count, [(length, rank + k * count, k * length) for k in range(each)])
                rank, n = rank + each * count, n - each * count

    def _fill(self) -> None:
        size, place = self.size, 0
        left = deque((room, p) for room in sorted(self._open) for p in self._open[room])
        tokens = sum((size - room) * p[0] for room, p in left)
        full = tokens // size
        while full:  # the longest packs stay
            room, p = left.popleft()
            if full < p[0]:
                p, rest = self._split(p, full)
                left.appendleft((room, rest))
            full -= p[0]
            self.gaps.append((place, p[0], room, self._number(*p), size - room))
            place += p[0] * room
        rest = tokens % size
        while rest:  # what all gaps leave goes to sequences of powers of two
            power = 1 << rest.bit_length() - 1
            self.gaps.append((place, 1, power, self._number(1, []), 0))
            place, rest = place + power, rest - power
        place = 0
        for _, (count, slots) in left:
            for length, rank, _ in slots:
                self.torn.append((length, rank, count, place))
                place += count * length

    def table(self) -> tuple[np.ndarray, ...]:
        """Arrays for look(): keys of the ranges of ranks in order, each range's row, and the gaps with the number of gaps before."""
        ranges = sorted([(length, rank, 1, sequence, offset) for length, rank, _, sequence, offset in self.slots] + [(length, rank, 0, place, 0) for length, rank, _, place in self.torn])
        r, g = np.array(ranges, np.int64).reshape(-1, 5), np.array(self.gaps, np.int64).reshape(-1, 5)
        return (r[:, 0] << _RANK_BITS) | r[:, 1], r, g, np.append(0, np.cumsum(g[:, 1]))


_RANK_BITS = 44


def look(table: tuple[np.ndarray, ...], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """For pieces by length and rank: of each part of one, the piece's place in the arguments, from, tokens, sequence and offset."""
    keys, ranges, gaps, before = table
    at = np.searchsorted(keys, (length << _RANK_BITS) | rank, "right") - 1
    far, whole = rank - ranges[at, 1], ranges[at, 2] == 1
    first = ranges[at, 3] + np.where(whole, 0, far * length)  # of torn ones, in the run of ids

    def gap(x: np.ndarray) -> np.ndarray:
        c = np.searchsorted(gaps[:, 0], x, "right") - 1
        return before[c] + (x - gaps[c, 0]) // gaps[c, 2]

    n = np.ones(len(rank), np.int64)
    torn = np.flatnonzero(~whole)
    low = np.zeros(len(rank), np.int64)
    if len(torn):
        low[torn] = gap(first[torn])
        n[torn] = gap(first[torn] + length[torn] - 1) - low[torn] + 1
    row = np.repeat(np.arange(len(rank)), n)
    start, tokens, sequence, offset = np.zeros(len(row), np.int64), length[row].copy(), (first + far)[row], ranges[at, 4][row]
    part = np.flatnonzero(~whole[row])
    if len(part):
        r = row[part]
        k = low[r] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))[part]
        c = np.searchsorted(before, k, "right") - 1
        begins = gaps[c, 0] + (k - before[c]) * gaps[c, 2]
        a, b = np.maximum(begins, first[r]), np.minimum(begins + gaps[c, 2], first[r] + length[r])
        start[part], tokens[part], sequence[part], offset[part] = a - first[r], b - a, gaps[c, 3] + k - before[c], gaps[c, 4] + a - begins
    return row, start, tokens, sequence, offset


def _placed(table: tuple[np.ndarray, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            length = of["length"].to_numpy().astype(np.int64)
            row, start, tokens, sequence, offset = look(table, length, of["rank"].to_numpy())
            crc = pc.if_else(pa.array(tokens == length[row]), of["crc"].take(pa.array(row)), pa.scalar(None, pa.int64()))
            kept = [of[c].take(pa.array(row)) for c in ("id", "part", "place", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, crc, *map(pa.array, (of["start"].to_numpy()[row] + start, tokens, start, sequence, offset))], ["id", "part", "place", "doc_tokens", "crc", "start", "length", "from", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids: and its ids, little-endian 32-bit integers."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    base = cut(rows.mapInArrow(_tokenised(path or default_path(), size, end_id), f"id {id_type}, {_BASE}"), "zstd")
    counts = cut(base.groupBy("part", "length").count())
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `size` rows
    plan = spark.sparkContext.broadcast(Plan(histogram, size).table())
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    ranked = base.drop("ids").join(ahead, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("ahead"))
    schema = f"id {id_type}, part int, place long, doc_tokens long, crc long, start long, length long, `from` long, sequence_id long, offset long"
    placed = ranked.select("id", "part", "place", "start", "length", "crc", "doc_tokens", "rank").mapInArrow(lambda b: _placed(plan.value)(b), schema)
    if not with_ids:
        placed = cut(placed)
        whole, torn = placed.where("crc is not null").withColumn("ids", F.lit(None).cast("binary")), placed.where("crc is null")
    else:
        whole, torn = placed.limit(0).withColumn("ids", F.lit(None).cast("binary")), placed
    read = torn.join(base.select("part", "place", F.col("ids").alias("__ids")), ["part", "place"]).withColumn("ids", F.expr("substring(__ids, cast(4 * `from` + 1 as int), cast(4 * length as int))"))
    out = whole.unionByName(read.withColumn("crc", F.crc32("ids")).drop("__ids"))
    return out.select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """Of pack(with_ids=True): a row for each sequence with its pieces' ids in place (binary, as there) and n_tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids")).withColumn("n_tokens", (F.length("ids") / 4).cast("long"))
