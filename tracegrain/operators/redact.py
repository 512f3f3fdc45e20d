"""Redaction: names, addresses and domains of one's own replaced by pseudonyms that a secret key fixes, and back again.

HMAC-SHA256 is composed of Spark's own SHA-256. Texts are read once, by an automaton of all values; a table too large for one is dealt over several
by the values' first characters.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import canonical_ip, is_public, is_usable, let
from .iocs import _all, _domains, host_of, is_internal

# Accounts that say nothing of anyone, as distributions and images create them: base system in the order of its user numbers, then services, then images.
SYSTEM_ACCOUNTS = """
root daemon bin sys sync games man lp mail news uucp proxy www-data backup list irc gnats nobody
systemd-network systemd-resolve systemd-timesync messagebus syslog sshd apache nginx mysql postgres redis ftp ntp polkitd dbus chrony
admin ubuntu ec2-user centos debian
""".split()
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
BLOCK = 64


def _padded(key: bytes, with_byte: int) -> bytes:
    key = hashlib.sha256(key).digest() if len(key) > BLOCK else key
    return bytes(b ^ with_byte for b in key.ljust(BLOCK, b"\0"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal."""
    inner = F.sha2(F.concat(F.lit(bytearray(_padded(key, 0x36))), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(_padded(key, 0x5C))), F.unhex(inner)), 256)


def pseudonym(key: bytes, category: Column, value: Column) -> Column:
    tag = F.substring(hmac_sha256(key, F.concat(category, F.lit(":"), value)), 1, 6)
    return (
        F.when(category == "email", F.concat(F.lit("email-"), tag, F.lit("@redacted.invalid"))).when(category == "domain", F.concat(F.lit("domain-"), tag, F.lit(".redacted.invalid")))
        .when(category == "ip", F.concat(F.lit("PRIVATE-IP-"), tag)).otherwise(F.concat(category, F.lit("-"), tag))
    )


def sensitive(events: DataFrame, *internal: str) -> DataFrame:
    """(category, value): hosts, users (actors, targets of account events, homes in paths), addresses that aren't public, internal domains, e-mail addresses."""
    text = F.concat_ws("\n", "raw", "command", "target")
    of = lambda category, value: F.struct(F.lit(category).alias("category"), value.alias("value"))
    private = lambda ip: F.when(let(canonical_ip(ip), lambda c: is_usable(c) & ~is_public(c)), ip)
    about_user = F.col("event_type").startswith("user.") | F.col("event_type").isin("password.change", "group.modify", "auth.sudo", "auth.su")
    found = F.flatten(F.array(
        F.array(of("host", F.col("host")), of("user", F.col("actor")), of("user", F.when(about_user, F.col("target"))), of("ip", private(F.col("src_ip"))), of("ip", private(F.col("dst_ip")))),
        F.transform(F.regexp_extract_all(text, F.lit(r"/home/([^/\s'\"]+)"), 1), lambda u: of("user", u)), F.transform(_all(text, "ip"), lambda ip: of("ip", private(ip))),
        F.transform(_domains(text), lambda d: of("domain", F.when(is_internal(d, *internal), d))), F.transform(_all(text, "url"), lambda u: of("domain", F.when(is_internal(host_of(u), *internal), host_of(u)))),
        F.transform(F.regexp_extract_all(text, F.lit(f"({EMAIL})"), 1), lambda e: of("email", e)),
    ))
    rows = events.select(F.explode(found).alias("x")).select("x.category", F.trim("x.value").alias("value")).where("value is not null and length(value) >= 2").distinct()
    plain = (F.col("category") == "user") & (F.col("value").isin(*SYSTEM_ACCOUNTS) | F.col("value").startswith("uid:"))
    return rows.where(~plain)


def mapping(values: DataFrame, key: bytes) -> DataFrame:
    """(value, pseudonym): each value once; of its categories the first of host, user, ip, domain, email counts."""
    order = F.array_position(F.array(*map(F.lit, ("host", "user", "ip", "domain", "email"))), F.col("category"))
    one = values.groupBy("value").agg(F.min_by("category", order).alias("category"))
    return one.select("value", pseudonym(key, F.col("category"), F.col("value")).alias("pseudonym"))


#: Characters of values that one automaton holds at most; a larger table is dealt over several by first characters.
AUTOMATON_CHARS = 1 << 21
#: First characters by which values are dealt: more of them where too many values begin alike. Their hashes are counted, so the driver gets BUCKETS rows at most.
FIRST, BUCKETS = (2, 4, 8, 16, 32, 64, 128, 256), 4096
_MAIL = re.compile(EMAIL)


def _in_name(c: str) -> bool:
    return c.isalnum() or c == "_"


def begins(text: str, at: int) -> bool:
    """Whether a name can begin here: behind no letter, digit or any of _ . @ -"""
    return at == 0 or not (_in_name(text[at - 1]) or text[at - 1] in ".@-")


def ends(text: str, at: int) -> bool:
    """Whether a name can end before this place: no letter, digit or any of _ @ - follows, nor a point with a letter, digit or _ behind it."""
    if at == len(text):
        return True
    return not (_in_name(text[at]) or text[at] in "@-" or text[at] == "." and at + 1 < len(text) and _in_name(text[at + 1]))


class Names:
    """An automaton of (old, new) pairs, for use inside tasks: one pass over a text finds all of them, however many there are."""

    def __init__(self, pairs: Iterable[tuple[str, str]], whole: bool):
        import ahocorasick

        self.whole, self.automaton = whole, ahocorasick.Automaton()
        for old, new in pairs:
            self.automaton.add_word(old, (len(old), new))
        if len(self.automaton):
            self.automaton.make_automaton()

    def spans(self, text: str) -> dict[int, tuple[int, str]]:
        """Of each place where a name stands: the end of the longest one there, and what comes in its place. whole: names between what isn't part of names."""
        found: dict[int, tuple[int, str]] = {}
        if len(self.automaton):
            for last, (n, new) in self.automaton.iter(text):
                start, end = last - n + 1, last + 1
                if end > found.get(start, (0,))[0] and (not self.whole or begins(text, start) and ends(text, end)):
                    found[start] = end, new
        return found


def _mails(text: str, key: bytes) -> dict[int, tuple[int, str]]:
    found = {}
    for mail in {m for m in _MAIL.findall(text) if not m.endswith("redacted.invalid")} if "@" in text else ():
        tag = hmac.new(key, f"email:{mail}".encode(), hashlib.sha256).hexdigest()[:6]
        at = text.find(mail)
        while at >= 0:
            if begins(text, at) and ends(text, at + len(mail)):
                found[at] = at + len(mail), f"email-{tag}@redacted.invalid"
            at = text.find(mail, at + 1)
    return found


def _written(text: str, found: dict[int, tuple[int, str]], key: bytes | None) -> str:
    """The text with the leftmost spans replaced, of those that begin together the longest; known names before e-mail addresses of the same length."""
    if key:
        for start, span in _mails(text, key).items():
            if span[0] > found.get(start, (0,))[0]:
                found[start] = span
    out, at = [], 0
    for start in sorted(found):
        if start >= at:
            out += [text[at:start], found[start][1]]
            at = found[start][0]
    return "".join([*out, text[at:]])


class Deal:
    """Which slice of a large table a value is in: by a hash of its first characters, as many of them as keep the slices small."""

    def __init__(self, table: DataFrame, most: int):
        self.slices: dict[tuple[int, int], int] = {}
        self.split: set[tuple[int, int]] = set()
        left, filled, slice_ = table, 0, 0
        for k, more in zip(FIRST, (*FIRST[1:], 0), strict=True):
            bucket = F.crc32(F.substring("old", 1, k).cast("binary")) % BUCKETS
            sizes = left.groupBy(bucket.alias("b")).agg(F.sum(F.length("old")).alias("all"), F.sum(F.when(F.length("old") < max(more, 1), F.length("old")).otherwise(0)).alias("short")).collect()
            for r in sorted(sizes, key=lambda r: r.b):
                size = r.all
                if more and r.all > most and r.all > r.short:
                    self.split.add((k, r.b))
                    size = r.short
                if size:
                    slice_, filled = (slice_ + 1, size) if filled and filled + size > most else (slice_, filled + size)
                    self.slices[k, r.b] = slice_
            again = [b for n, b in self.split if n == k]
            if not again:
                break
            left = left.where(bucket.isin(again) & (F.length("old") >= more))
        self.n = slice_ + 1

    @staticmethod
    def _bucket(k: int, text: str) -> tuple[int, int]:
        return k, zlib.crc32(text.encode()) % BUCKETS

    def of(self, value: str) -> int:
        for k, more in zip(FIRST, (*FIRST[1:], 1 << 62), strict=True):
            bucket = self._bucket(k, value[:k])
            if bucket not in self.split or len(value) < more:
                return self.slices[bucket]
        return 0

    def among(self, text: str, whole: bool) -> set[int]:
        """Slices of values that can stand somewhere in the text."""
        used, out = sorted({k for k, _ in self.slices}), set()
        for at in range(len(text)):
            if not whole or begins(text, at):
                for k in used:
                    slice_ = self.slices.get(self._bucket(k, text[at : at + k]))
                    if slice_ is not None:
                        out.add(slice_)
        return out


def _replaced(rows: DataFrame, id_col: str, text_col: str, table: DataFrame, whole: bool, key: bytes | None, most: int | None = None) -> DataFrame:
    """rows with the names of table (old, new) replaced in the text. A table of up to `most` characters is one automaton that each worker builds
    from a broadcast; a larger one is dealt over slices, and a text goes to those slices alone whose values can stand in it."""
    spark, most = rows.sparkSession, most or AUTOMATON_CHARS
    table = table.toDF("old", "new").where("length(old) >= 1")
    chars = table.agg(F.sum(F.length("old").cast("long"))).first()[0] or 0
    if chars <= most:
        pairs = spark.sparkContext.broadcast([tuple(r) for r in table.collect()])

        @F.pandas_udf("string")
        def written(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            names = Names(pairs.value, whole)
            for texts in batches:
                yield pd.Series([None if t is None else _written(t, names.spans(t), key) for t in texts], dtype=object)

        return rows.withColumn(text_col, written(F.col(text_col)))
    deal = spark.sparkContext.broadcast(Deal(table, most))

    @F.pandas_udf("int")
    def slice_of(old: pd.Series) -> pd.Series:
        return old.map(deal.value.of)

    @F.pandas_udf("array<int>")
    def slices_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(deal.value.among(t, whole)) if t else [])

    salts = spark.sparkContext.defaultParallelism
    texts = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("slice", F.explode(slices_of("text"))).withColumn("salt", F.pmod(F.xxhash64("id", "text"), F.lit(salts)).cast("int"))
    values = table.withColumn("slice", slice_of("old")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    id_type = texts.schema["id"].dataType
    both = values.select("slice", "salt", F.lit(0).alias("kind"), "old", "new", F.lit(None).cast(id_type).alias("id")).union(texts.select("slice", "salt", F.lit(1), "text", F.lit(None).cast("string"), "id"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pairs, names = None, [], None
        for batch in batches:
            ids, spans = [], []
            for i, (slice_, salt, kind, old, new) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)):
                if (slice_, salt) != at:
                    at, pairs, names = (slice_, salt), [], None
                if kind == 0:
                    pairs.append((old, new))
                    continue
                if names is None:
                    names, pairs = Names(pairs, whole), []
                here = names.spans(old)
                if here:
                    ids.append(i)
                    spans.append([{"start": a, "end": b, "new": n} for a, (b, n) in here.items()])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(5).take(pa.array(ids, pa.int64())), pa.array(spans, kind)], ["id", "spans"])

    schema = f"id {id_type.simpleString()}, spans array<struct<start: int, end: int, new: string>>"
    hits = both.repartition("slice", "salt").sortWithinPartitions("slice", "salt", "kind").mapInArrow(found, schema)
    hits = hits.groupBy(F.col("id").alias("__id")).agg(F.flatten(F.collect_list("spans")).alias("__spans"))

    @F.pandas_udf("string")
    def put(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text: str | None, own: list | None) -> str | None:
            longest: dict[int, tuple[int, str]] = {}
            for x in own if own is not None else ():
                if x["end"] > longest.get(x["start"], (0,))[0]:
                    longest[x["start"]] = x["end"], x["new"]
            return None if text is None else _written(text, longest, key)

        return pd.Series(map(one, texts, spans), dtype=object)

    return rows.join(hits, rows[id_col].eqNullSafe(hits["__id"]), "left").withColumn(text_col, put(F.col(text_col), F.col("__spans"))).select(rows.columns)


def redact(rows: DataFrame, id_col: str, text_col: str, table: DataFrame, key: bytes | None = None, most: int | None = None) -> DataFrame:
    """rows (of distinct ids) with the values of table (value, pseudonym) replaced in the text, where they stand as whole names; with the key, e-mail addresses
    that the table lacks are replaced too. A null text stays null."""
    return _replaced(rows, id_col, text_col, table.select("value", "pseudonym"), True, key, most)


def restore(rows: DataFrame, id_col: str, text_col: str, table: DataFrame, most: int | None = None) -> DataFrame:
    """The values again, wherever their pseudonyms stand."""
    return _replaced(rows, id_col, text_col, table.select("pseudonym", "value"), False, None, most)
