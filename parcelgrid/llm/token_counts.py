"""Token counts: batch encoding in Arrow functions that return lengths only.

Spark deals the texts out so that each task holds about the same bytes; inside
a task texts are taken in blocks of bounded bytes, long texts are cut where the
tokenizer itself always cuts, and each distinct cut is encoded once per block.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from parcelgrid.llm.arrow import blocks, coded, kept, texts

#: Byte-level tokenizers start a new piece before a blank that follows a visible character.
_CUT = re.compile(r"(?<=\S)(?= )")
#: Texts where some blank is not such a place.
_ODD = r"^ |[\s\x0b\x1c-\x1f\x{85}\p{Z}] "
REMEMBERED = 500_000


@kept
def tokenizer(path: str):
    """The tokenizer of a .json (tokenizers) or .model (sentencepiece) file, one per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def lengths_of(path: str, parts: list[str]) -> Iterator[int]:
    """Number of tokens of each part, without added special tokens."""
    t = tokenizer(path)
    for at in range(0, len(parts), 10_000):
        some = parts[at: at + 10_000]
        if path.endswith(".model"):
            yield from map(len, t.encode(some, num_threads=1))
        else:
            yield from map(len, t.encode_batch_fast(some, add_special_tokens=False))


@cache
def splits_at_blanks(path: str) -> bool:
    """Whether ids of a text are the ids of its cuts, one after another."""
    if path.endswith(".model"):
        return False
    import json

    t = json.loads(tokenizer(path).to_str())
    pre = t["pre_tokenizer"] or {}
    plain = all(not x["lstrip"] and not x["rstrip"] and " " not in x["content"] for x in t["added_tokens"])
    return plain and not t["normalizer"] and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]


def cut_texts(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(cuts of all texts, offsets per text)."""
    parts, ends = [], [0]
    for text, odd in zip(column.to_pylist(), pc.match_substring_regex(column, _ODD).to_pylist()):
        if odd:
            parts.extend(_CUT.split(text))
        elif text:
            first, *rest = text.split(" ")
            parts.append(first)
            parts.extend([" " + x for x in rest])
        ends.append(len(parts))
    return pa.array(parts, pa.string()), np.array(ends)


_KNOWN: dict[str, dict[str, int]] = {}


def _lengths(path: str, names: list[str]) -> list[int]:
    """Tokens of each distinct cut; those met lately are remembered, up to ``REMEMBERED``."""
    known = _KNOWN.setdefault(path, {})
    new = [x for x in names if x not in known]
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = names
    known.update(zip(new, lengths_of(path, new)))
    return [known[x] for x in names]


def text_lengths(column: pa.Array, path: str) -> np.ndarray:
    """Number of tokens of each text."""
    if not splits_at_blanks(path):
        return np.fromiter(lengths_of(path, column.to_pylist()), np.int64, len(column))
    flat, at = cut_texts(column)
    codes, names = coded(flat)
    # A stop or comma between a letter and the cut's end is a piece of its own.
    marked = pc.match_substring_regex(names, "[A-Za-z][.,]$")
    stem_codes, stems = coded(pc.if_else(marked, pc.utf8_slice_codeunits(names, 0, -1), names))
    per = np.array(_lengths(path, stems.to_pylist()), np.int64)[stem_codes] + marked.to_numpy(zero_copy_only=False)
    total = np.concatenate(([0], np.cumsum(per[codes])))
    return total[at[1:]] - total[at[:-1]]


def token_counts(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row; null and empty texts have 0 of both.

    Any columns may stand beside the two that are read, and repeated keys give
    a row each. Rows keep their partition: a scan is already cut by bytes.
    Files other than byte-level ones are encoded text by text.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_text"):
            column = texts(b, "_text")
            n_bytes = pc.cast(pc.binary_length(column), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("_key"), n_bytes, pa.array(text_lengths(column, path), pa.int64())], ["_key", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        count, f"_key {kind}, n_bytes bigint, n_tokens bigint")
    return made.withColumnRenamed("_key", key)
