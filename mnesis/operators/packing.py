"""Scoring pairs of texts by a model in batches of bounded size: pairs are cut to the model's length, and packed by tokens, so that short ones don't wait for long ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

Tokens = list


def cut_pair(a: int, b: int, most: int) -> tuple[int, int]:
    """What of two lengths is left if the longer one loses its last token (of equal ones the second) until both together have `most`."""
    if a + b <= most:
        return a, b
    half = most // 2
    if a <= half:
        return a, most - a
    if b <= half:
        return most - b, b
    return most - half, half


def packs(lengths: Sequence[int], budget: int, most: int) -> list[list[int]]:
    """Places of `lengths`, the longest first, in packs of at most `most` whose number times the longest is at most `budget`; one that is over it alone is alone."""
    out: list[list[int]] = []
    longest = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if out and len(out[-1]) < most and longest * (len(out[-1]) + 1) <= budget:
            out[-1].append(i)
        else:
            out.append([i])
            longest = lengths[i]
    return out


def score_packed(
    pairs: DataFrame, tokenize: Callable[[str], Tokens], score: Callable[[list[tuple[Tokens, Tokens]]], Sequence[float]], budget: int = 8192, max_len: int = 1024, overhead: int = 0, most: int = 64,
) -> DataFrame:
    """id, tokens (of the pair, with `overhead` for the frame that a model sets around it), padded (tokens of its pack when all are as long as the longest) and relevance of
    pairs (id, query, text). Null texts are empty. score() gets the pairs of a pack and gives a number for each, which must not depend on the others.

    No pack is above the budget, which must hold one pair of max_len. Packs are made within an Arrow batch, so a task holds one batch whatever its partition's size.
    """
    if max_len > budget or overhead >= max_len:
        raise ValueError("the budget must hold a pair of max_len, and max_len more than the overhead")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = []
            for q, t in zip(b["query"], b["text"], strict=True):
                q, t = tokenize(q or ""), tokenize(t or "")
                m, n = cut_pair(len(q), len(t), max_len - overhead)
                cut.append((q[:m], t[:n]))
            lengths = [len(q) + len(t) + overhead for q, t in cut]
            padded, relevance = [0] * len(cut), [0.0] * len(cut)
            for pack in packs(lengths, budget, most):
                for i, s in zip(pack, score([cut[i] for i in pack]), strict=True):
                    relevance[i], padded[i] = float(s), lengths[pack[0]] * len(pack)
            yield pd.DataFrame({"id": b["id"], "tokens": lengths, "padded": padded, "relevance": relevance})

    return pairs.select("id", "query", "text").mapInPandas(run, "id long, tokens long, padded long, relevance double")
