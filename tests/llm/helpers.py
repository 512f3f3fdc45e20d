"""Tables with the odd cases that every operator has to handle, and plain versions of words and hashes."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n long, id string, word string, node long, e long, doc string, spans string, terms string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_texts():
    """Null, empty and blank texts, ties, repeated texts, near copies, shared passages, very long texts, other scripts."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage = words(300), words(60)
    near = [*base[:150], "other", *base[151:]]
    texts = [None, "", " ", "\n\t \n", "one", "one", "One two", "one two three four", "ONE two\tthree four"]
    texts += [" ".join(base), " ".join(base), "  ".join(base).upper(), " ".join(near), " ".join(base[:20])]
    texts += [" ".join([*words(80), *passage, *words(40)]), " ".join([*passage, *words(90)]), " ".join([*words(5), *passage[:34], *words(60)])]
    texts += [" ".join(["again"] * 120), "\n".join(["the same line here"] * 40), "line one\nline two\n\nline one\n \n"]
    texts += [" ".join(words(30_000)), "é" * 5000, "x" * 200_000, "naïve café ☕   \x00 \x1f 文字 " * 20, "🙂🙂 a b"]
    texts += [" ".join([*base[:280], *words(20)]), " ".join([*base[:262], *words(38)])]
    return texts


def odd_documents(spark):
    """doc_id from 0, then a row without an id, and a row twice; columns with names that clash with the operators' own."""
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    rows += [(None, "a row without an id " * 30), (7, "one two three four")]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2, "x", "y", 3, 4, "d", "s", "t") for i, t in rows], SCHEMA)


def empty(df):
    return df.where("1 = 0")


def words(text):
    return WORD.findall(text or "")
