"""Operator 5: secret scans: fixed patterns, and formats inferred from the credentials that they label."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.llm.automata import Automaton, Scorer, learn
from mnesis.llm.common import Scratch, byte_slices, text_buffer, word_hashes

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
#: The automata's alphabet: digits, a-f, g-z, A-F, G-Z as classes, other characters as they are.
ALPHABET = "0agAG+/_.=-"
_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", *"+/_.=-")
_CLASS = str.maketrans({c: ALPHABET[k] for k, chars in enumerate(_CLASSES) for c in chars})
_SYMBOL = np.zeros(256, np.uint8)
for _k, _chars in enumerate(_CLASSES):
    _SYMBOL[list(_chars.encode())] = _k


def runs(mask: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of at least `least` set bytes, none across two texts."""
    if not mask.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.zeros(len(mask) + 1, bool)
    change[1:-1] = mask[1:] != mask[:-1]
    change[[0, -1]] = True
    change[offs] = True
    cuts = np.flatnonzero(change)
    long = (np.diff(cuts) >= least) & mask[cuts[:-1]]
    return cuts[:-1][long], cuts[1:][long]


def base_spans(text: bytes) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret) of the patterns' matches, in bytes. All that they match is ASCII, so that bytes and characters match alike."""
    out = []
    if b"=" in text or b":" in text:
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out


class Scanner:
    """What there is to be found in a slice of texts. models: see learn_formats(); without them there are no format spans."""

    def __init__(self, least: int, models: Sequence[tuple[Automaton, int, int]] = (), plain: Automaton | None = None, evidence: float = 0.0):
        self.least, self.models, self.evidence = least, [(Scorer(m, ALPHABET), lo, hi) for m, lo, hi in models], evidence
        self.plain = Scorer(plain, ALPHABET) if plain else None

    def base(self, raw: np.ndarray, offs: np.ndarray) -> list[tuple[str, int, int, int]]:
        """(kind, start, end, start of the secret) of the fixed patterns, as bytes of the slice."""
        marks = np.isin(np.arange(256), list(b"=:A"))[raw]
        out = []
        for i in np.unique(np.searchsorted(offs, np.flatnonzero(marks), "right") - 1).tolist():
            out += [(k, s + int(offs[i]), e + int(offs[i]), x + int(offs[i])) for k, s, e, x in base_spans(raw[offs[i] : offs[i + 1]].tobytes())]
        return out + [("hex", s, e, s) for s, e in zip(*(x.tolist() for x in runs(_HEX[raw], offs, 32)), strict=True)]

    def others(self, raw: np.ndarray, offs: np.ndarray, base: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the runs of token characters that no base span overlaps."""
        start, end = runs(_TOKEN[raw], offs, self.least)
        if base and len(start):
            edge = np.zeros(len(raw) + 1, np.int32)
            np.add.at(edge, [s for _, s, _, _ in base], 1)
            np.subtract.at(edge, [e for _, _, e, _ in base], 1)
            covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
            free = covered[end] == covered[start]
            start, end = start[free], end[free]
        return start, end

    def spans(self, raw: np.ndarray, offs: np.ndarray) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of each text, in code points, by start and kind."""
        base = self.base(raw, offs)
        all_ = [(k, s, e) for k, s, e, _ in base]
        if self.models and self.plain:
            start, end = self.others(raw, offs, base)
            if len(start):
                symbols = _SYMBOL[raw]
                usual, hit = self.plain.scores(symbols, start, end), np.zeros(len(start), bool)
                for model, lo, hi in self.models:
                    at = np.flatnonzero((end - start >= lo) & (end - start <= hi))
                    hit[at] |= (model.scores(symbols, start[at], end[at]) - usual[at]) * (end - start + 1)[at] >= self.evidence
                all_ += [("format", s, e) for s, e in zip(start[hit].tolist(), end[hit].tolist(), strict=True)]
        out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(offs) - 1)]
        if all_:
            # code points before each byte: bytes that begin one
            before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            for kind, s, e in all_:
                i = int(np.searchsorted(offs, s, "right")) - 1
                at = int(before[s] - before[offs[i]])
                out[i].append((kind, at, at + int(before[e] - before[s])))
            for row in out:
                row.sort(key=lambda x: (x[1], KINDS.index(x[0])))
        return out


def _samples(docs: DataFrame, labelled: int, ordinary: int, least: int, longest: int) -> dict[str, list[str]]:
    """Of each kind of labelled credentials, and of other runs, the `labelled` or `ordinary` distinct values of least hash, the first `longest` characters of each. A task
    keeps as many of its own, so that what is collected of the corpus is bounded and yet the least of all."""
    most = dict.fromkeys(KINDS[:3], labelled) | {"other": ordinary}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, held = Scanner(least), {k: {} for k in most}
        for batch in batches:
            for part in byte_slices(batch, "text"):
                raw, offs = text_buffer(part.column("text"))
                base = scanner.base(raw, offs)
                found = {k: (np.array([x for kind, _, _, x in base if kind == k], np.int64), np.array([e for kind, _, e, _ in base if kind == k], np.int64)) for k in KINDS[:3]}
                for kind, (start, end) in (found | {"other": scanner.others(raw, offs, base)}).items():
                    end = np.minimum(end, start + longest)
                    h, at = np.unique(word_hashes(raw, start, end, seed=5), return_index=True)
                    mine = held[kind]
                    for x, i in zip(h[: most[kind]].tolist(), at[: most[kind]].tolist(), strict=True):
                        mine.setdefault(x, raw[start[i] : end[i]].tobytes().decode())
                    if len(mine) > most[kind]:
                        held[kind] = {x: mine[x] for x in sorted(mine)[: most[kind]]}
        rows = [(kind, x - (1 << 63), v) for kind, mine in held.items() for x, v in mine.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["kind", "h", "secret"])

    scratch = Scratch(docs.sparkSession, "secrets")
    each = scratch.save(docs.select("text").mapInArrow(run, "kind string, h long, secret string"), "samples").distinct()
    out = {k: [r.secret for r in each.where(F.col("kind") == k).orderBy("h", "secret").limit(n).collect()] for k, n in most.items()}
    scratch.drop("samples")
    return out


def learn_formats(samples: dict[str, list[str]], longest: int, fewest: int = 8) -> tuple[list[tuple[Automaton, int, int]], Automaton | None]:
    """For each kind of labelled credentials with `fewest` distinct values or more an automaton and their least and greatest length (none, if one was cut at
    `longest`); and the automaton of ordinary runs, which hold no labelled value.

    Credentials among the ordinary runs teach that they are ordinary: formats are told from text in which unlabelled ones are rare, below about one in a thousand runs."""
    labelled = {k: v for k, v in samples.items() if k != "other"}
    joined = "\n".join(x for v in labelled.values() for x in v)
    other = [x.translate(_CLASS) for x in samples["other"] if x not in joined]
    models = []
    for values in labelled.values():
        if len(values) >= fewest:
            most = max(map(len, values))
            models.append((learn([x.translate(_CLASS) for x in values], len(ALPHABET)), min(map(len, values)), most if most < longest else 1 << 62))
    return models, learn(other, len(ALPHABET)) if other else None


def find_secrets(docs: DataFrame, labelled: int = 1000, ordinary: int = 8000, least: int = 8, longest: int = 256, evidence: float = 14.0, redacted: bool = False) -> DataFrame:
    """doc_id and spans of each row: array of (kind, start, end) in code points, ordered by start and kind.

    assign, access and hex are matches of fixed patterns, found over the whole text. Their values are labelled credentials: for each kind, a bounded sample
    (the `labelled` distinct values of least hash, `longest` characters of each) becomes a probabilistic automaton over character classes, and `ordinary` other runs of
    token characters become one for ordinary text. Every other run of at least `least` token characters is then scored: a format span is one that the automaton of
    some kind, whose values' lengths it is among, makes e ** `evidence` times as likely as the ordinary one does. It overlaps no other span.

    A null text is empty and has no spans. Repeated rows are scanned each; a null doc_id stays. Without labelled values (eight of a kind) there are no format spans.
    With redacted, the docs come back with their own columns instead, each secret in the text replaced by its kind in brackets and n_chars, if there is one,
    counted anew. Scale: texts are read twice, for the sample and for the spans, and never shuffled; a task keeps a bounded sample.
    """
    models, plain = learn_formats(_samples(docs, labelled, ordinary, least, longest), longest)
    scanner = lambda: Scanner(least, models, plain, evidence)
    if redacted:
        return _redact(docs, scanner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, kind = scanner(), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in byte_slices(batch, "text"):
                found = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in row] for row in scan.spans(*text_buffer(part.column("text")))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def _redact(docs: DataFrame, scanner: Callable[[], Scanner]) -> DataFrame:
    names, counted = docs.columns, "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner()
        for batch in batches:
            for part in byte_slices(batch, "text"):
                texts, changed = part.column("text"), {}
                for i, spans in enumerate(scan.spans(*text_buffer(texts))):
                    if spans:
                        text, out, at = texts[i].as_py(), [], 0
                        for kind, start, end in spans:
                            if end > at:  # what stands inside another span goes with it
                                out += [text[at : max(at, start)], f"[{kind}]" if start >= at else ""]
                                at = end
                        changed[i] = "".join(out) + text[at:]
                columns = list(part.columns)
                if changed:
                    columns[names.index("text")] = pa.array([changed.get(i, t) for i, t in enumerate(texts.to_pylist())], pa.string())
                    if counted:
                        n = part.column("n_chars").to_pylist()
                        columns[names.index("n_chars")] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(n)], part.column("n_chars").type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def digest(spans: DataFrame) -> DataFrame:
    """The spans as counts and text: doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    line = lambda kinds: F.array_join(F.transform(F.filter("spans", lambda x: x["kind"].isin(*kinds)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *map(count, KINDS[:3]), F.sha2(line(KINDS[:3]), 256).alias("base_sha256"), line(KINDS).alias("spans"))
