"""Operators 11, 12 and 13 against plain versions, on odd tables and on the tables of tests."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.conftest import same_rows
from tests.llm.helpers import empty, odd_documents, words
from tracegrain.llm import prefix_trie, shortest_pack, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, key string, n long, part long, depth long, conv long, audit string"


def odd_rows():
    rng = random.Random(5)
    rows = []
    for c in [*range(90), None]:
        for t in range(rng.choice([1, 2, 3, 4, 5, 12])):
            rows.append((c, rng.choice([t, t, None, t + 3]), rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool"]), rng.choice(["a b.", "", None, "hello there x", "é\x00 \n y!", "what?\n", "a b. c", f"{t}."])))
    # conversations that lie in several tasks and blocks, one of few distinct turns, and rows that repeat
    rows += [(1000, i, rng.choice(["user", "assistant"]), f"t {rng.random()}" + rng.choice([".", ""])) for i in range(900)]
    rows += [(1001, i, "user", rng.choice("ab")) for i in range(700)] + [(1002, i, "user", "ab"[i % 2]) for i in range(300)]
    rows += rows[:20]
    return [(*r, "k", 1, 2, 3, 4, "K") for r in rows]


@pytest.fixture(scope="module", params=["odd", "table"])
def conversations(request, spark, sf_dir):
    return spark.createDataFrame(odd_rows(), SCHEMA) if request.param == "odd" else spark.read.parquet(f"{sf_dir}/conversations.parquet")


def rows_of(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:30]


NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}


def struck(rows):
    """Rows of each conversation after damage, in order: (has turn, turn, digest, role, text)."""
    spaced, out = lambda v: " " if v is None else str(v), {}
    for c, turn, role, text in rows:
        own, fault = out.setdefault(c, []), zlib.crc32(f"{spaced(c)}:{spaced(turn)}".encode()) % 20
        role, text = "user" if fault == 4 else spaced(role), "" if fault == 1 else spaced(text)
        text = re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn is not None, turn or 0, digest(role, text), role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return {c: sorted(own) for c, own in out.items()}


def cheapest(own, faults):
    """(cost, audit, lines) by a walk over all rows at once; lines are linked pairs, so that long conversations don't copy them."""

    def better(ways, last, way):
        if last not in ways or way[:2] < ways[last][:2]:
            ways[last] = way

    def with_inserts(ways):
        out = dict(ways)
        for _ in range(3):
            for last, (cost, audit, lines) in list(out.items()):
                for i in NEXT[last].replace("s", ""):
                    better(out, i, (cost + 2, audit + "I", (lines, ROLES[i] + ":")))
        return out

    ways = {"": (0, "", None)}
    for (*_, role, text), fault in zip(own, faults, strict=True):
        now = {}
        for last, (cost, audit, lines) in with_inserts(ways).items():
            better(now, last, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            cost += fault == "truncated"
            for i in NEXT[last]:
                if role[:1] == i:
                    better(now, i, (cost, audit + "K", (lines, f"{role}:{text}")))
                if i != "s":
                    better(now, i, (cost + 2, audit + "R", (lines, f"{ROLES[i]}:{text}")))
        ways = now
    ways = with_inserts(ways)
    return min((ways[last] for last in ("", "a") if last in ways), key=lambda w: w[:2])


def plain_repair(rows):
    out = []
    for c, own in struck(rows).items():
        seen, faults = set(), []
        for *_, role, text in own:
            bare = text.rstrip(" \t\n\x0b\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, linked = cheapest(own, faults)
        lines = []
        while linked:
            linked, line = linked
            lines.append(line)
        turns = [r[1] for r in own if r[0]]
        out.append({
            "conv_id": c, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
            "illegal": sum(a[3][:1] + b[3][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False)), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(reversed(lines)).encode()).hexdigest(),
        })
    return out


def test_repair(conversations):
    same_rows(turn_repair.repair(conversations), plain_repair(rows_of(conversations)))
    assert turn_repair.repair(empty(conversations)).count() == 0


def test_repair_of_conversations_that_vanish(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = turn_repair.repair(spark.createDataFrame([(gone, 0, "user", "x")], "conv_id long, turn long, role string, text string")).collect()
    assert (row.conv_id, row.cost, row.audit, row.repaired_sha256) == (gone, 0, "", hashlib.sha256().hexdigest())


def test_repair_takes_any_size_of_block(spark, conversations, monkeypatch):
    monkeypatch.setattr(turn_repair, "BLOCK", 7)
    monkeypatch.setattr(turn_repair, "FAN", 3)
    monkeypatch.setattr(turn_repair, "BATCH", 50)
    told = turn_repair.faults(turn_repair.damaged(conversations))
    expected = [{"key": " " if r["conv_id"] is None else str(r["conv_id"]), "cost": r["cost"], "audit": r["audit"]} for r in plain_repair(rows_of(conversations)) if r["audit"]]
    same_rows(turn_repair.edits(told), expected)


def plain_trie(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by.setdefault(c, []).append((turn is not None, turn or 0, digest(role, text), role, text))
    own = {c: [r[3:] for r in sorted(v)] for c, v in by.items()}
    # sequences by the number of their node: the parent's number and the turn
    numbers, members, ends, parents, depths, said = {}, [], [], [], [], []
    for c in sorted(own):
        h, at = zlib.crc32(str(c).encode()) % 4, None
        for d, turn in enumerate([None, *own.get(c - c % 20, [])[:h], *own[c][h:]]):
            if (at, turn) not in numbers:
                numbers[at, turn] = len(members)
                for v, x in ((members, []), (ends, []), (parents, at), (depths, d), (said, turn)):
                    v.append(x)
            at = numbers[at, turn]
            members[at].append(c)
        ends[at].append(c)
    kids, leaves, saved = [0] * len(members), [0] * len(members), [0] * len(members)
    for i in sorted(range(len(members)), key=depths.__getitem__, reverse=True):
        leaves[i] += not kids[i]
        saved[i] += (len(members[i]) - 1) * (len(words(said[i][1])) if said[i] else 0)
        if parents[i] is not None:
            kids[parents[i]] += 1
            leaves[parents[i]] += leaves[i]
            saved[parents[i]] += saved[i]
    return [
        {"conv_id": min(members[i]), "depth": depths[i], "parent_conv_id": None if parents[i] is None else min(members[parents[i]]), "n_convs": len(members[i]), "n_children": kids[i], "n_leaves": leaves[i], "saved_tokens": saved[i], "ends_sha256": hashlib.sha256(",".join(map(str, ends[i])).encode()).hexdigest()}
        for i in range(len(members))
    ]


def test_trie(conversations):
    same_rows(prefix_trie.trie(conversations), plain_trie(rows_of(conversations)))
    assert prefix_trie.trie(empty(conversations)).count() == 0


def test_partial_tries_of_any_size(conversations, monkeypatch):
    monkeypatch.setattr(prefix_trie, "MOST_NODES", 5)
    monkeypatch.setattr(prefix_trie, "SEGMENT_BITS", 2)
    monkeypatch.setattr(prefix_trie, "FAN_BITS", 1)
    rows = plain_trie(rows_of(conversations))
    same_rows(prefix_trie.trie(conversations), rows)


@pytest.mark.parametrize("size", [8, 64, 2048])
def test_plan_of_packing(size):
    rng = random.Random(size)
    for _ in range(60):
        histogram = {rng.randint(1, size): rng.choice([1, 2, 3, 10, 1000]) for _ in range(rng.randint(1, 30))}
        plan = shortest_pack.Plan(histogram, size)
        length = np.repeat(*map(np.array, zip(*histogram.items(), strict=True)))
        rank = np.concatenate([np.arange(n) for n in histogram.values()])
        pieces, filled = {}, {}
        for row, start, tokens, sequence, offset in zip(*(x.tolist() for x in shortest_pack.look(plan.table(), length, rank)), strict=True):
            pieces.setdefault(row, []).append((start, tokens))
            filled.setdefault(sequence, []).append((offset, tokens))
        for row in range(len(length)):
            assert covers(pieces[row]) == length[row]
        assert sorted(filled) == list(range(plan.sequences))
        full = [covers(v) for v in filled.values()]
        assert all(n == size or n & (n - 1) == 0 for n in full) and sum(n < size for n in full) <= size.bit_length()


def covers(spans):
    at = 0
    for start, n in sorted(spans):
        assert start == at and n > 0
        at += n
    return at


def test_plan_stays_small():
    """As many patterns as the histogram asks for, whatever its counts."""
    rng = random.Random(1)
    plan = shortest_pack.Plan({i: rng.randint(1, 10**9) for i in range(1, 2049)}, 2048)
    assert len(plan.slots) + len(plan.torn) + len(plan.gaps) < 50_000


@pytest.fixture(scope="module", params=["odd", "table"])
def docs(request, spark, sf_dir):
    return odd_documents(spark) if request.param == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_shortest_pack(docs):
    from tokenizers import Tokenizer

    tokenizer, size = Tokenizer.from_file(shortest_pack.default_path()), 2048
    pieces = [r.asDict() for r in shortest_pack.pack(docs).collect()]
    assert set(pieces[0]) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    expected, by_doc, filled = [], {}, {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        filled.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for doc_id, text in ((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own, at = by_doc[doc_id, len(ids)], 0
        while at < len(ids):  # rows that repeat have pieces of their own
            p = next(p for p in own if p["start"] == at)
            own.remove(p)
            assert zlib.crc32(ids[at : at + p["length"]].tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids)
        expected.append(len(ids))
    assert not any(by_doc.values())
    full = [covers(v) for v in filled.values()]
    assert sum(full) == sum(expected) and all(n == size or n & (n - 1) == 0 for n in full)
    assert len(full) <= sum(expected) // size + 11
    assert shortest_pack.pack(empty(docs)).count() == 0


def test_sequences_hold_the_ids(docs):
    pieces = shortest_pack.pack(docs, with_ids=True)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in pieces.collect())
    assert {r.n_tokens for r in shortest_pack.sequences(pieces).select("n_tokens").collect()} <= {2048, *(1 << i for i in range(11))}


def test_words_are_encoded_as_in_their_text():
    from tokenizers import Tokenizer

    rng, encode, whole = random.Random(2), shortest_pack.WordEncoder(shortest_pack.default_path()), Tokenizer.from_file(shortest_pack.default_path())
    latin = ["a", "B", "é", "É", "'s", "'", "1", "-", ".", "ß", "½", "²", "ª", "×", "€", "…", " ", "  ", "\n", "\x85", "\xa0", "\x00", "can't", "don'T've", "İ", "ǀ", "the", "Ation"]
    other = ["文", "🙂", "<|endoftext|>", "<|", "ΑΣ", "Σ", "́", "ﬁ", "ᄀ", "ᅡ", "\x1c", " ", " ", "́"]
    for i in range(3000):
        texts = ["".join(rng.choice(latin + other * (i % 2)) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 3))]
        assert encode(texts) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts], repr(texts)
