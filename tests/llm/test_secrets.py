import hashlib
import random
import re
import string

import numpy as np
import pandas as pd

from mnesis.llm import queries
from mnesis.llm.automata import Scorer, learn
from mnesis.llm.secrets import ALPHABET, digest, find_secrets

SF = "/root/testdata/sf0.01"
WORDS = {k: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key")}
PATTERNS = (
    ("assign", re.compile("(" + "|".join(WORDS.values()) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


def plain(text):
    spans = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m)]
    line = ",".join(f"{name}:{s}:{e}" for s, _, e, name in sorted(spans))
    return [sum(n == x[3] for x in spans) for n, _, _ in PATTERNS], hashlib.sha256(line.encode()).hexdigest(), line


def check(rows, texts):
    for r in rows:
        counts, sha, line = plain(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == counts
        assert r.base_sha256 == sha
        assert [x for x in r.spans.split(",") if x and not x.startswith("format")] == [x for x in line.split(",") if x]


def test_whole_table_base_spans_equal_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text
    rows = queries.op5_secrets(spark, SF).collect()
    assert len(rows) == len(docs)
    assert sum(r.n_assign + r.n_hex for r in rows) > 0
    check(rows, docs)


def test_odd_texts(spark, documents):
    h = "0123456789abcdef"
    rows = [(1, None), (2, ""), (3, "é" * 5 + "AKIA" + "A" * 12 + " ü ToKeN' : \"abcdefgh"), (4, h * 2 + "g" + h * 2), (5, "ſecret=abcdefgh1 toKen=abcdefgh1"), (6, "password=short token=password=abcdefghij"), (7, "x " * 60_000 + "api_key: " + h * 3), (8, h), (9, h + h), (10, "AKIAAKIA" + "Z" * 9 + "AKIA" + "1" * 11)]
    got = digest(find_secrets(documents(rows))).collect()
    assert len(got) == len(rows)
    check(got, dict(rows))
    assert digest(find_secrets(documents([]))).collect() == []
    assert len(digest(find_secrets(documents([(None, "password=abcdefghijk")] * 2))).collect()) == 2


def test_inferred_format_is_found_where_no_pattern_matches(spark, documents):
    rng = random.Random(3)
    key = lambda: "sk_live_" + "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(24))
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 24)))
    rows = [(i, " ".join([*(word() for _ in range(80)), f"token={key()}" if i < 60 else key() if i < 70 else word()])) for i in range(100)]
    got = {r.doc_id: r.spans for r in digest(find_secrets(documents(rows))).collect()}
    assert all(got[i].count("format") == (60 <= i < 70) for i in range(100))


def test_redaction_keeps_all_else(spark, documents):
    h = "0123456789abcdef" * 2
    rows = [(1, "é password=abcdefgh1 x"), (2, None), (3, f"token={h} {h} end"), (4, "plain"), (None, "AKIA" + "A" * 16)]
    got = {r.doc_id: r for r in find_secrets(documents(rows), redacted=True).collect()}
    assert {k: r.text for k, r in got.items()} == {1: "é [assign] x", 2: None, 3: "[assign] [hex] end", 4: "plain", None: "[access]"}
    assert got[1].n_chars == len("é [assign] x") and got[4].n_chars == 5 and got[3].source == "s"


def test_merging_generalises():
    rng = random.Random(0)

    def text():
        out = "ab"
        while rng.random() < 0.6:
            out += "ab"
        return out

    model = learn([text() for _ in range(500)], 3)
    assert len(model.moves) <= 6
    assert model.score("ab" * 30) > model.score("aabb") + 0.5


def test_scores_of_many_strings_equal_those_of_each():
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("0aagG-") for _ in range(n))
    model = learn([text(rng.randint(3, 30)) for _ in range(200)], len(ALPHABET))
    strings = [text(rng.choice([1, 2, 8, 30, 255, 256, 257, 900])) for _ in range(60)]
    symbols = np.array([ALPHABET.index(x) for x in "".join(strings)], np.uint8)
    ends = np.cumsum([len(x) for x in strings])
    assert Scorer(model, ALPHABET).scores(symbols, ends - [len(x) for x in strings], ends).tolist() == [model.score(x) for x in strings]


def test_planted_unlabelled_credentials_are_found_in_a_whole_table_and_words_numbers_and_addresses_left_alone(spark, documents):
    rng = random.Random(11)
    docs = pd.read_parquet(f"{SF}/documents.parquet").text.tolist()
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    plain = lambda: rng.choice([digits(16), f"66.{digits(2)}.218.{digits(2)}", f"mail{digits(1)}.example.com", f"555-{digits(5)}", "THISTHATING", f"2024-{digits(2)}-{digits(2)}T00"])
    rows = [(i, f"{t} {plain()} {key(rng.randint(18, 31)) if i % 100 == 7 else 'end'}" + (f" token={key(40)} password={key(18)}" if i >= 800 else "")) for i, t in enumerate(docs)]
    got = {r.doc_id: r.spans for r in digest(find_secrets(documents(rows))).collect()}
    assert sum("format" in got[i] for i in range(7, len(docs), 100)) >= 9
    wrong = [rows[i][1][-80:] for i in range(len(docs)) if "format" in got[i] and i % 100 != 7]
    assert len(wrong) <= 2, wrong
    texts = {r.doc_id: r.text for r in find_secrets(documents(rows), redacted=True).collect()}
    assert all(("[format]" in texts[i]) == ("format" in got[i]) for i in texts)
