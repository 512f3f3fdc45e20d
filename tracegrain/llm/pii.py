"""Personal data: base patterns, and terms that reveal the entities they find.

The base patterns find e-mail addresses, IP addresses, card numbers and phone numbers. What else points to them is
estimated from the corpus. Most addresses and numbers are rare, so a mention stands for its value and for the classes of it:
an address's domain, a network of 16 bits, a card's issuer, a phone number's codes of three and four digits. A term of the documents that mention such an entity
discloses it by how much of the entity's information it carries,

    PMI(entity; term) / IC(entity) = 1 - log(n(term) / n(entity, term)) / log(N / n(entity)),

with n(entity), n(term), n(entity, term) and N all counted in distinct texts (copies of a document count once), wherever in
a text the two stand. A pair counts only with evidence that isn't chance and isn't near copies of one document: the term stands
there in `support` different contexts (two words on both sides), the entity's mentions too (`window` words on both sides), and by the
Chernoff bound n KL(n(entity, term) / n(term) || n(entity) / N), with n the smaller of texts and contexts, fewer than `chance` of all pairs
tried would come about by chance. In every document, whether it mentions the entity or not, a term with a ratio of
`generalise` or more is replaced by its shape, one of `remove` or more is removed.

Counts cover all documents: words shuffle only from texts that mention such an entity, and only words of these texts are counted
in the corpus; a Bloom filter of fixed size tells the tasks which. Of texts only those that may have a copy, and those that
mention an entity, are written or shuffled. Spans are found from the text alone, so they are keyed by the text's hash and length.

A term is a word as white space ends it, A-Z lower-cased, with a letter or digit. Cases: a null text is empty and has no span; it stays
null when sanitised. Repeated rows get the same spans each. Null ids are kept; other columns pass through, whatever their names. An
empty table has no terms and gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Bloom, cut
from .words import as_long, chunks, mix

KINDS = ("email", "ip", "card", "phone")
#: Keys over which a term's mentions are dealt.
SALTS = 16
#: Terms of entities' lists that a task holds before it hands them on.
TOGETHER = 1 << 17
#: Terms with counts that a task holds before it hands them on (16 bytes each).
COUNTED = 1 << 20
#: The words before and after a term that are its context.
BESIDE = 2
SPANS = "array<struct<kind: string, start: int, end: int>>"

_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# a match never starts inside a run of digits: what fails at the run's start fails further on too
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them; from each @, so that long runs without one cost nothing twice."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and not _NOT_LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points."""
    out = [("email", *x) for x in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(q) <= 3 and int(q or "0") <= 255 for q in (p.lstrip("0") for p in m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() < 64 else ""
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def _entities(kind: str, value: str) -> list[int]:
    """Hashes of what a mention stands for: its value and the classes of it."""
    if kind == "email":
        of = [value.lower(), "@" + value.lower().rpartition("@")[2]]
    elif kind == "ip":
        of = [value, ".".join(value.split(".")[:2])]
    else:
        digits = re.sub("[^0-9]", "", value)
        of = [digits, digits[:6]] if kind == "card" else [digits, digits[:4], digits[:3]]
    return [int.from_bytes(hashlib.blake2b(f"{kind}:{level}:{x}".encode(), digest_size=8).digest(), "little", signed=True) for level, x in enumerate(of, 1)]


#: Of each byte: whether it is a letter's or digit's, or part of a character beyond ASCII.
_IN_NAME = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])


class _Doc:
    """A document of a chunk: its words' hashes, their places in code points, and which of them have a letter or digit."""

    def __init__(self, chunk, row: int):
        i = row - chunk.row
        self.words = slice(chunk.bound[i], chunk.bound[i + 1])
        self.hash, start, end, self.named = chunk.hash[self.words], chunk.start[self.words], chunk.end[self.words], np.empty(0, bool)
        if len(start):
            low = int(chunk.offsets[i])
            data = chunk.data[low : int(end[-1])]
            points, marks = np.cumsum((data & 0xC0) != 0x80), np.append(0, np.cumsum(_IN_NAME[data]))
            self.named = marks[end - low] > marks[start - low]
            start, end = points[start - low] - 1, points[end - 1 - low]
        self.start, self.end = start, end


def _docs(batch: pa.RecordBatch, column: int, wanted: np.ndarray | None = None) -> Iterator[tuple[int, _Doc]]:
    for chunk in chunks(batch.column(column), lower=True, wanted=wanted):
        for row in range(chunk.row, chunk.row + chunk.n):
            if wanted is None or wanted[row]:
                yield row, _Doc(chunk, row)


def _inside(doc: _Doc, spans: list[dict]) -> np.ndarray:
    """Which words overlap a span."""
    out = np.zeros(len(doc.start), bool)
    for s in spans:
        out[np.searchsorted(doc.end, s["start"], "right") : np.searchsorted(doc.start, s["end"], "left")] = True
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (id, h, n, text) into (id, h, n, base, text): base spans; the text only where it has one."""
    for batch in batches:
        texts = batch.column(3).to_pylist()
        spans = [base_spans(t or "") for t in texts]
        base = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in s] for s in spans]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(base, pa.list_(_SPAN)), pa.array([t if s else None for t, s in zip(texts, spans, strict=True)], pa.string())], ["id", "h", "n", "base", "text"])


def _mixed(near: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mix(near + np.arange(len(near), dtype=np.uint64)))) if len(near) else 0


def _contexts(window: int):
    """mapInArrow: (text, base) into (entity, context, first): a hash of the words around every mention, and 1 for an entity's first in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for row, doc in _docs(batch, 0):
                text, spans, seen = batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), set()
                free = np.flatnonzero(~_inside(doc, spans))
                for s in spans:
                    left = np.searchsorted(free, np.searchsorted(doc.start, s["start"]))
                    context = _mixed(doc.hash[free[max(0, left - window) : left + window]])
                    for e in _entities(s["kind"], text[s["start"] : s["end"]]):
                        for to, v in zip(out, (e, context, int(e not in seen)), strict=True):
                            to.append(v)
                        seen.add(e)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(np.array(out[1], np.uint64).view(np.int64)), pa.array(out[2], pa.int64())], ["entity", "context", "first"])

    return run


def _together(entities, wanted=None):
    """mapInArrow: (text, base) into (entity, terms): for each of a text's entities that may be wanted, (term, context, first) of its other words;
    contexts only of the words that may be wanted, else every word once."""
    kind = pa.struct([("term", pa.int64()), ("context", pa.int64()), ("first", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(out: list[list]) -> pa.RecordBatch:
            offsets = pa.array(np.cumsum([0, *map(len, out[1])]), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.ListArray.from_arrays(offsets, pa.concat_arrays(out[1]) if out[1] else pa.array([], kind))], ["entity", "terms"])

        for batch in batches:
            out: list[list] = [[], []]
            held = 0
            for row, doc in _docs(batch, 0):
                text, spans = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                of = np.array(sorted({e for s in spans for e in _entities(s["kind"], text[s["start"] : s["end"]])}), np.int64)
                of = of[entities.value.has(of)]
                if not len(of):
                    continue
                free = ~_inside(doc, spans)
                h, named, context = doc.hash[free], doc.named[free], np.uint64(0)
                if wanted is None:
                    h = np.unique(h[named])
                padded = np.pad(h, BESIDE)
                for by in (*range(BESIDE), *range(BESIDE + 1, 2 * BESIDE + 1)) if wanted is not None else ():
                    context = mix(context ^ padded[by : by + len(h)])
                may = np.flatnonzero(named & wanted.value.has(as_long(h))) if wanted is not None else np.arange(len(h))
                pairs = np.unique(np.stack([h, context + h])[:, may], axis=1) if len(may) else np.empty((2, 0), np.uint64)
                first = np.diff(pairs[0], prepend=pairs[0][:1] + np.uint64(1)) != 0
                terms = pa.StructArray.from_arrays([pa.array(as_long(pairs[0].copy())), pa.array(as_long(pairs[1].copy())), pa.array(first.astype(np.int64))], fields=list(kind))
                # a text gives its list for each of its entities: they are handed on as they grow
                for e in of.tolist():
                    out[0].append(e)
                    out[1].append(terms)
                    held += len(terms)
                    if held > TOGETHER:
                        yield lists(out)
                        out, held = [[], []], 0
            yield lists(out)

    return run


def _frequencies(terms):
    """mapInArrow: (text) into (term, docs) of the terms that may be wanted, summed over a task's batches while at most COUNTED terms are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term = docs = np.empty(0, np.int64)
        for batch in batches:
            got = [[term], [docs]]
            for chunk in chunks(batch.column(0), lower=True):
                at = np.flatnonzero(terms.value.has(chunk.hash))
                pair = np.stack([np.searchsorted(chunk.bound, at, "right"), as_long(chunk.hash[at])])
                # each word once a text, then texts by word
                for to, v in zip(got, np.unique(np.unique(pair, axis=1)[1], return_counts=True) if len(at) else (), strict=False):
                    to.append(v)
            term, of = np.unique(np.concatenate(got[0]), return_inverse=True)
            docs = np.zeros(len(term), np.int64)
            np.add.at(docs, of, np.concatenate(got[1]))
            if len(term) > COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(docs)], ["term", "docs"])
                term = docs = np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(docs)], ["term", "docs"])

    return run


def _mentions(terms):
    """mapInArrow: (text, h, n) into (h, n, term, start, end) of the words outside base spans that may disclose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "n", "term", "start", "end"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for chunk in chunks(batch.column(0), lower=True):
                may = np.flatnonzero(terms.value.has(chunk.hash))
                for row in np.unique(np.searchsorted(chunk.bound, may, "right") - 1) + chunk.row:
                    doc = _Doc(chunk, row)
                    inside = _inside(doc, [{"start": a, "end": b} for _, a, b in base_spans(batch.column(0)[int(row)].as_py())])
                    at = np.flatnonzero(~inside & terms.value.has(doc.hash))
                    for to, v in zip(out, ([batch.column(1)[int(row)].as_py()] * len(at), [batch.column(2)[int(row)].as_py()] * len(at), as_long(doc.hash[at]), doc.start[at], doc.end[at]), strict=True):
                        to.extend(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return run


def _key(text):
    t = F.coalesce(text, F.lit(""))
    return F.xxhash64(t).alias("h"), F.length(t).alias("n")


def _maybe(bloom):
    """A column function: whether a long may be in the broadcast filter."""

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(bloom.value.has(h.to_numpy(np.int64)))

    return maybe


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, n, base, text) of every row: the text's hash and length, its base spans, and the text if it has any; a table."""
    found = docs.select(F.col(id_col).alias("id"), *_key(F.col(text_col)), F.col(text_col).alias("text"))
    return cut(found.mapInArrow(_base, f"id {found.schema['id'].dataType.simpleString()}, h long, n int, base {SPANS}, text string"))


def distinct_texts(docs: DataFrame, rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(text, h, n): every text of docs once, rows being its mentions(); only texts whose hash may occur twice shuffle."""
    keyed = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), *_key(F.col(text_col)))
    twice = cut(rows.groupBy("h", "n").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"))
    maybe = _maybe(docs.sparkSession.sparkContext.broadcast(Bloom.build(twice, "h")))
    keyed = keyed.withColumn("__maybe", maybe("h"))
    once = cut(keyed.where("__maybe").drop("__maybe").dropDuplicates(["h", "n"]))
    return keyed.where("not __maybe").drop("__maybe").unionByName(once)


def disclosing_terms(texts: DataFrame, rows: DataFrame, window: int = 8, support: int = 3, generalise: float = 0.8, chance: float = 0.01) -> DataFrame:
    """(entity, term, ratio) of the pairs whose ratio is at least generalise; hashes stand for both. rows: mentions(); texts: distinct_texts()."""
    spark = rows.sparkSession
    private = cut(rows.where("text is not null").dropDuplicates(["h", "n"]).select("text", "base"))
    contexts = private.mapInArrow(_contexts(window), "entity long, context long, first long").groupBy("entity", "context").agg(F.sum("first").alias("first"))
    often = contexts.groupBy("entity").agg(F.sum("first").alias("n_entity"), F.count(F.lit(1)).alias("n_contexts"))
    often = cut(often.where((F.col("n_entity") >= support) & (F.col("n_contexts") >= support)).select("entity", "n_entity"))
    entities = spark.sparkContext.broadcast(Bloom.build(often, "entity"))
    schema = "entity long, terms array<struct<term: long, context: long, first: long>>"
    pairs = private.mapInArrow(_together(entities), schema).select("entity", F.inline("terms")).groupBy("entity", "term").agg(F.sum("first").alias("n_both"))
    pairs = cut(pairs.where(F.col("n_both") >= support).join(often, "entity"))
    total = float(max(2, rows.select("h", "n").distinct().count()))
    # a term has most evidence if it stands nowhere else: what wouldn't be enough even so isn't counted in the corpus
    enough = math.log(max(1, pairs.count()) / chance)
    rarity = F.log(F.lit(total) / F.least("n_entity", F.lit(total - 1)))
    pairs = pairs.where(F.col("n_both") * rarity >= F.lit(enough - 1e-6))
    terms = spark.sparkContext.broadcast(Bloom.build(pairs.select("term").distinct(), "term"))
    counts = texts.select("text").mapInArrow(_frequencies(terms), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("n_term"))
    met = pairs.join(counts, "term").withColumn("n_term", F.greatest("n_term", "n_both"))
    ratio = 1 - F.log(F.col("n_term") / F.col("n_both")) / F.log(F.lit(total + 1) / F.least("n_entity", F.lit(total)))
    met = cut(met.withColumn("ratio", ratio).where(F.col("ratio") >= generalise))
    # contexts are read only of the words whose share would do
    near = spark.sparkContext.broadcast(Bloom.build(met.select("term").distinct(), "term"))
    contexts = private.mapInArrow(_together(entities, near), schema).select("entity", F.inline("terms")).groupBy("entity", "term", "context").agg(F.sum("first").alias("first")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_contexts"))
    met = met.join(contexts.where(F.col("n_contexts") >= support), ["entity", "term"])
    p, q = F.col("n_both") / F.col("n_term"), F.least("n_entity", F.lit(total - 1)) / F.lit(total)
    surprise = p * F.log(p / q) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - q))).otherwise(0.0)
    evidence = F.least("n_both", "n_contexts") / p * F.when(p > q, surprise).otherwise(0.0)
    return cut(met.where(evidence >= F.lit(enough)).select("entity", "term", "ratio"))


class Pii:
    """Finds and sanitises the personal data of docs; estimates are made on docs once."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, support: int = 3, generalise: float = 0.8, remove: float = 0.95, chance: float = 0.01):
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        self.rows = mentions(docs, id_col, text_col)
        self._texts = distinct_texts(docs, self.rows, text_col)
        self.terms = disclosing_terms(self._texts, self.rows, window, support, generalise, chance).withColumn("kind", F.when(F.col("ratio") >= remove, "term").otherwise("hint"))
        self._found = None

    def term_spans(self) -> DataFrame:
        """(h, n, terms): of each text (its hash and length) that has them, the terms' spans; kind term: to remove, hint: to generalise."""
        if self._found is None:
            terms = cut(self.terms.groupBy("term").agg(F.max("kind").alias("kind")))
            if terms.isEmpty():
                self._found = self.rows.select("h", "n", F.array().cast(SPANS).alias("terms")).limit(0)
                return self._found
            bloom = self.docs.sparkSession.sparkContext.broadcast(Bloom.build(terms, "term"))
            maybe = self._texts.mapInArrow(_mentions(bloom), "h long, n int, term long, start int, end int")
            # a term may stand in many texts, so it is dealt over SALTS keys
            salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            spans = maybe.withColumn("salt", F.pmod(F.xxhash64("h", "start"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"])
            self._found = cut(spans.groupBy("h", "n").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("terms")))
        return self._found

    def _with_terms(self, df: DataFrame, h: str, n: str, terms: str) -> tuple[DataFrame, DataFrame]:
        """df's rows whose text has no term's span, and the others with the spans as a column."""
        maybe = _maybe(self.docs.sparkSession.sparkContext.broadcast(Bloom.build(self.term_spans(), "h")))
        df, spans = df.withColumn("__maybe", maybe(h)), self.term_spans().toDF(h, n, terms)
        return df.where("not __maybe").drop("__maybe"), df.where("__maybe").drop("__maybe").join(spans, [h, n], "left")

    def spans(self) -> DataFrame:
        """(id, base, terms) of every row: arrays of (kind, start, end)."""
        none = F.array().cast(SPANS)
        plain, met = self._with_terms(self.rows.select("id", "h", "n", "base"), "h", "n", "terms")
        out = plain.select("id", "base", none.alias("terms")).unionByName(met.select("id", "base", F.coalesce("terms", none).alias("terms")))
        return out.withColumnRenamed("id", self.id_col)

    def sanitise(self) -> DataFrame:
        """docs with base spans replaced by their kind in brackets, hints by their shape, and terms removed.

        Only texts that may have a term's span meet the spans in a join; the others pass straight through.
        """
        columns = self.docs.columns
        keyed = self.docs.withColumn("__h", _key(F.col(self.text_col))[0]).withColumn("__n", _key(F.col(self.text_col))[1])

        @F.pandas_udf("string")
        def clean(text: pd.Series, terms: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else replaced(t, base_spans(t) + [(s["kind"], s["start"], s["end"]) for s in (() if x is None else x)]) for t, x in zip(text, terms, strict=True)], dtype=object)

        plain, met = self._with_terms(keyed, "__h", "__n", "__terms")
        plain = plain.withColumn(self.text_col, clean(self.text_col, F.lit(None).cast(SPANS)))
        met = met.withColumn(self.text_col, clean(self.text_col, "__terms"))
        return plain.select(columns).unionByName(met.select(columns))


def _shape(word: str) -> str:
    return "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "[WORD]"


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with every span replaced; of spans that overlap, the one that starts first (then the longer) stands for all."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], "" if kind == "term" else _shape(text[a:b]) if kind == "hint" else f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of Pii.spans(): counts, the hash of the base spans' list, and all spans as one string."""
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select(id_col, *map(count, KINDS), F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.concat("base", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_terms"))
