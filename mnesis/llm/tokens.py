"""Operator 8: token counts, batch-encoded in Arrow functions that return lengths only."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.llm.common import bound_batches, byte_slices, text_buffer

_SAFE = re.compile(r"[^\W_] (?=[^\W_])")
_LOADED: dict[str, object] = {}


def pieces(text: str, most: int) -> list[str]:
    """A text in pieces of about most characters, cut only before a single blank between two letters or digits.

    A byte-level BPE's pattern never has a token across such a place: its tokens hold white space at their start only, and a blank before a letter
    or digit always goes to what follows. Special strings hold no blank. So the pieces' tokens are the text's. Without such a place there is no cut.
    """
    out, at = [], 0
    while len(text) - at > most and (m := _SAFE.search(text, at + most)):
        out.append(text[at : m.start() + 1])
        at = m.start() + 1
    out.append(text[at:])
    return out


def _counter(path: str):
    """A function from texts to their token counts, by the file's kind; loaded once in each worker."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            coder = Tokenizer.from_file(path)
            coder.no_truncation()
            coder.no_padding()
            _LOADED[path] = lambda texts: [len(x) for x in coder.encode_batch_fast(texts, add_special_tokens=False)]
    return _LOADED[path]


def _byte_level(path: str) -> bool:
    """Whether a .json's tokens hold white space at their start only, as pieces() needs: its pre-tokenizer is byte-level and it changes no text beforehand."""
    with open(path) as f:
        spec = json.load(f)
    first = spec.get("pre_tokenizer") or {}
    kinds = [x.get("type") for x in first.get("pretokenizers", [first])]
    return "ByteLevel" in kinds and set(kinds) <= {"ByteLevel", "Split", "Digits"} and not spec.get("normalizer")


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, batch_bytes: int = 256 << 10, piece_chars: int = 16 << 10) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of each row; tokenizer is a file of tokenizers (.json) or sentencepiece (.model).

    No begin, end or added special tokens; special strings inside texts as the library's default has them; no truncation or padding. Long texts are cut at
    places where no token goes across (byte-level .json files; others take texts whole), and batches hold about batch_bytes whatever the texts' lengths. A null text
    is empty: no bytes, no tokens. Repeated rows and null ids stay as they are. No shuffle: one pass over the table, which returns numbers only.
    """
    bound_batches(docs.sparkSession)
    whole = tokenizer.endswith(".model") or not _byte_level(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                _, offs = text_buffer(part.column("text"))
                total = np.zeros(part.num_rows, np.int64)
                held, rows, size = [], [], 0

                def flush() -> None:
                    if held:
                        np.add.at(total, rows, count(held))  # noqa: B023

                for i, text in enumerate(part.column("text").to_pylist()):
                    for piece in [text or ""] if whole else pieces(text or "", piece_chars):
                        held.append(piece)
                        rows.append(i)
                        size += len(piece)
                        if size >= batch_bytes:
                            flush()
                            held, rows, size = [], [], 0
                flush()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offs)), pa.array(total), pa.array(total > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
