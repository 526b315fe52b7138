"""What can be exchanged: embedders and rerankers, each with a deterministic one of built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnesis.functions.columns import tokens

QUERY_PREFIX = "Instruct: Given a query, retrieve the memories that answer it\nQuery: "


class Embedder(Protocol):
    """Vectors of texts, as columns: an expression, or a pandas or Arrow UDF around a model. Only queries get an instruction before them."""

    dim: int

    def documents(self, text: Column) -> Column: ...

    def queries(self, text: Column) -> Column: ...


class Reranker(Protocol):
    """How relevant a text is to a query, from 0 to 1."""

    def relevance(self, text: Column) -> Column: ...


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for a row, wherever f's lambdas use it: what a lambda is given is a variable, what it names from outside is computed at each step."""
    return F.transform(F.array(value), f)[0]


class HashEmbedder:
    """Words counted by a bucket of their MD5, as a vector of length one (zeros for a text without words)."""

    def __init__(self, dim: int = 64, instruction: str = QUERY_PREFIX):
        self.dim, self.instruction = dim, instruction

    def counts(self, text: Column) -> Column:
        """Each word is hashed once: its bucket stands among the sorted ones, between a mark for each bucket, and the marks' distances are the counts."""
        bucket = F.transform(tokens(F.coalesce(text, F.lit(""))), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % self.dim)
        marked = F.sort_array(F.concat(bucket, F.sequence(F.lit(0), F.lit(self.dim))))
        gap = lambda s, i: (F.array_position(s, i + 1) - F.array_position(s, i) - 1).cast("int")
        return _bound(marked, lambda s: F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: gap(s, i)))

    def documents(self, text: Column) -> Column:
        norm = lambda n: F.sqrt(F.aggregate(n, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
        unit = lambda n: _bound(norm(n), lambda size: F.transform(n, lambda x: F.when(size > 0, x / size).otherwise(0.0).cast("float")))
        return _bound(self.counts(text), unit)

    def queries(self, text: Column) -> Column:
        return self.documents(F.concat(F.lit(self.instruction), F.coalesce(text, F.lit(""))))


class LexicalReranker:
    """The share of the query's terms that a text has."""

    def __init__(self, terms: Sequence[str]):
        self.terms = sorted({t.lower() for t in terms})

    def relevance(self, text: Column) -> Column:
        words = tokens(F.coalesce(text, F.lit("")))
        return sum((F.array_contains(words, t).cast("int") for t in self.terms), F.lit(0)) / float(max(1, len(self.terms)))
