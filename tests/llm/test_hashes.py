import hashlib

import numpy as np
import pytest

from mnesis.llm.common import word_bounds, word_hashes
from mnesis.llm.jaccard import distinct_documents
from mnesis.llm.substrings import remove_repeats


def mirrored(n):
    """A word of n letters by the Thue-Morse sequence and the one with the letters swapped: a polynomial modulo 2**64 takes them for one, whatever its base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return ["".join("ab"[b ^ k] for b in bits) for k in (0, 1)]


def hashes(words, seed=0):
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]))
    return word_hashes(raw, starts, ends, seed)


@pytest.mark.parametrize("n", [1, 2, 64, 65, 512, 1024, 2048, 4096, 65536])
def test_no_structured_collisions(n):
    a, b = hashes(mirrored(n))
    assert a != b


def test_words_hash_alike_wherever_they_stand():
    rng = np.random.default_rng(4)
    words = ["".join(chr(97 + x) for x in rng.integers(0, 3, rng.integers(1, 300))) for _ in range(4000)]
    h = hashes(words)
    by = dict(zip(words, h.tolist(), strict=True))
    assert [by[w] for w in words] == h.tolist() and len(set(by.values())) == len(by)
    assert [int(hashes([w])[0]) for w in words[:300]] == h[:300].tolist()
    assert not set(by.values()) & set(hashes(words, 7).tolist())
    long = ["x" * 64 + "y" * 64, "y" * 64 + "x" * 64, "x" * 128, "y" * 128, "xy" * 64, "yx" * 64]
    assert len(set(hashes(long).tolist())) == len(long)


def test_mirrored_words_are_not_repeats(spark, documents):
    """Two texts of nineteen words alike and a last one that only such a hash confuses."""
    a, b = mirrored(1024)
    head = " ".join(f"w{i}" for i in range(19))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(documents([(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"{head} {a}")])).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (20, 0, digest(f"{head} {a}")), 2: (20, 0, digest(f"{head} {b}")), 3: (20, 20, digest(""))}


def test_mirrored_words_are_no_near_copies(spark, documents):
    a, b = mirrored(2048)
    assert sorted(r.doc_id for r in distinct_documents(documents([(1, a), (2, b), (3, a)])).collect()) == [1, 2]
