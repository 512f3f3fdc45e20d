"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

Every document is tokenised and closed by an end id; only a document longer than a sequence is cut, into full
pieces and a shorter first one. Pieces are dealt by hash, of a row's place in its partition too, over shards of about `shard_rows` pieces, so a shard's
size grows neither with the input nor with the rows that repeat, and each shard is packed in one task from its lengths alone. Longest
first, a piece goes where the sum over all gaps of (open sequences with that gap) squared becomes smallest, of equal sums to the smallest gap;
a new sequence is opened only if none has room. A shard wastes about one sequence of tens of thousands.

Cases: a null text is empty: its document is the end id alone. Rows that repeat are packed each. A null id is kept. Pieces of equal length
are placed in the order of id, piece and checksum. Columns other than the id and the text play no part, whatever their names. An empty table gives no piece.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Beyond these, libraries' tables of letters and numbers may be of different Unicode versions.
_OTHER = re.compile("[^\x00-ɏ‐-‧€]|<\\|")
#: The fast library's stack ends in white space of some hundred thousand characters; runs of twice this go to the other, some shorter ones too.
BLANKS = 5000


def _long_blank(text: str) -> bool:
    """Whether white space fills one of the pieces of BLANKS characters that lie one after another; linear."""
    return any(text[i].isspace() and text[i : i + BLANKS].isspace() for i in range(0, len(text) - BLANKS + 1, BLANKS))


class Encoder:
    """Ids of the tokenizer file at path; the byte-pair ranks at ranks_path, if given, serve texts that both read alike, faster.

    Texts with a long run of white space, and those on which the fast library raises, go to the tokenizer file too.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact, self.fast = Tokenizer.from_file(path), None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not _OTHER.search(text) and not _long_blank(text):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
            except Exception:  # whatever it can't read, the other can
                pass
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _tokenised(paths: tuple[str, str | None], size: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = Encoder(*paths), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, done = [], {}
            for text in batch.column(1):
                text = text.as_py() or ""
                if text not in done:
                    ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                    first = len(ids) % size or size
                    cuts = [0, *range(first, len(ids) + 1, size)]
                    done[text] = [{"start": a, "length": b - a, "crc": zlib.crc32(ids[a:b].tobytes())} | ({"ids": ids[a:b].astype(np.int32)} if with_ids else {}) for a, b in zip(cuts, cuts[1:], strict=False)]
                rows.append(done[text])
            fields = [("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
            place = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place), pa.array(rows, pa.list_(pa.struct(fields)))], ["id", "place", "pieces"])

    return run


def place(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For lengths in descending order: each one's sequence and its place there."""
    open_, count = [[] for _ in range(size + 1)], np.zeros(size + 1, np.int64)  # of sequences by gap
    sequence, offset, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(map(int, lengths)):
        had = count[s:]
        gap = -1
        if s < size and had.any():
            # what the sum of squares changes by when one sequence's gap falls from g to g - s; full ones don't count
            change = 2 * (count[: size + 1 - s] - had) + 2
            change[0] = 1 - 2 * had[0]
            change[had == 0] = np.iinfo(np.int64).max
            gap = s + int(change.argmin())
        if gap < 0:
            gap, b, n = size, n, n + 1
        else:
            b = open_[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = b, size - gap
        if gap > s:
            open_[gap - s].append(b)
            count[gap - s] += 1
    return sequence, offset


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 2, paths: tuple[str, str | None] | None = None, shard_rows: int = 1 << 15, with_ids: bool = False) -> DataFrame:
    """A row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset; with_ids: and its ids."""
    schema = docs.select(F.col(id_col).alias("id")).schema
    id_type = schema["id"].dataType.simpleString()
    # a token has two characters or more but in scripts of their own, whose shards hold a few times as many pieces
    rows, chars = docs.agg(F.count(F.lit(1)), F.sum(F.length(text_col).cast("long"))).first()
    shards = max(1, -(-(rows + (chars or 0) // (2 * size)) // shard_rows))
    extra, extra_type = (["ids"], ", ids array<int>") if with_ids else ([], "")
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_tokenised(paths or default_paths(), size, end_id, with_ids), f"id {id_type}, place long, pieces array<struct<start: long, length: long, crc: long{extra_type.replace('ids ', 'ids: ')}>>")
    pieces = cut.select("id", "place", F.posexplode("pieces").alias("piece", "p")).select("id", "place", "piece", "p.*")
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("place", "piece", "length", "crc"), F.lit(shards))).drop("place")

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "piece", "crc"], ascending=[False, True, True, True], kind="stable")
        sequence, pdf["offset"] = place(pdf["length"].to_numpy(), size)
        pdf["sequence_id"] = sequence + (int(pdf["shard"].iloc[0]) << 32)
        return pdf[["id", "piece", "start", "length", "crc", "sequence_id", "offset", *extra]]

    out = pieces.groupBy("shard").applyInPandas(packed, f"id {id_type}, piece int, start long, length long, crc long, sequence_id long, offset long{extra_type}")
    return out.withColumnsRenamed({"id": id_col, "crc": "ids_crc32"})


def sequences(pieces: DataFrame) -> DataFrame:
    """Of pack(with_ids=True): a row for each sequence with its pieces' ids in place, n_pieces and n_tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.size("parts").alias("n_pieces"), F.flatten("parts.ids").alias("ids")).withColumn("n_tokens", F.size("ids"))
