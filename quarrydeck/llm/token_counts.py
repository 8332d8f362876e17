"""Token counts by field and section: encode a whole document once, then attribute its tokens by their spans.

A document is its fields joined by ``separator``; the last field is cut into sections at line breaks. The tokenizer is
byte-level, so the lengths of the tokens' bytes give each token's span, and an interval join with the sections' spans gives
its section. A token that crosses a boundary goes by ``rule``: ``first`` or ``last`` (the section of its first or last
byte) or ``longest`` (the section with most of its bytes, the first among equals). A separator or line break belongs to
the section before it, so the sections cover the document and the counts add up to its tokens.

Cases: a null field is an empty field and keeps its row (0 tokens, or its separator's); an empty text is one section;
special tokens' strings are ordinary text; repeated rows stay rows, each with its own sections; a token with equal shares
of several sections goes to the first; texts of any length, also long runs of white space, are encoded whole; an empty
table gives an empty one; of other columns only the fields and the id are read, so their names can't clash.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices


@lru_cache(4)
def encoding(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer of a ranks file, and the number of bytes of each token."""
    found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    sizes = np.zeros(max(found.values()) + 1, np.int64)
    sizes[list(found.values())] = [len(x) for x in found]
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=found, special_tokens={}), sizes


#: White space as the pattern's engine has it; the library's search can't bear long runs of it.
BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")


def encode(coder: tiktoken.Encoding, text: str) -> list[int]:
    """The tokens of the whole text.

    A run of white space is one pre-token without its last character, which goes with what follows; at the end of the text
    it is one as a whole. Long runs are therefore cut off there and encoded as the single pre-tokens that they are.
    """
    ids, at = [], 0
    for run in BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += coder.encode_ordinary(text[at : run.start()])
        ids += coder._encode_single_piece(text[run.start() : end])
        at = end
    return ids + coder.encode_ordinary(text[at:])


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; section i spans bounds[i] to bounds[i + 1] and may be empty."""
    section = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    if rule == "last":
        section = last
    elif rule == "longest":
        for t in np.flatnonzero(section != last):
            parts = np.arange(section[t], last[t] + 1)
            share = np.minimum(ends[t], bounds[parts + 1]) - np.maximum(starts[t], bounds[parts])
            section[t] = parts[share.argmax()]
    return np.bincount(section, minlength=len(bounds) - 1)


def count_tokens(docs: DataFrame, ranks: bytes, pattern: str, *, id_col: str = "doc_id", fields: Sequence[str] = ("source", "text"), separator: str = "\n", rule: str = "longest") -> DataFrame:
    """(id, section, field, start, chars, tokens): one row a section, in order; start and chars count characters."""
    if rule not in ("first", "last", "longest"):
        raise ValueError(f"unknown rule {rule}")
    held = docs.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary
    names = ("id", "section", "field", "start", "chars", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = encoding(held.value, pattern)
        for batch in slices(batches, 1024):
            columns = [batch.column(1 + i).to_pylist() for i in range(len(fields))]
            row, section, field, start, chars, tokens = [], [], [], [], [], []
            for r, parts in enumerate(zip(*columns)):
                parts = [x or "" for x in parts]
                lines = parts[-1].split("\n")
                pieces = [*(x + separator for x in parts[:-1]), *(x + "\n" for x in lines[:-1]), lines[-1]]
                ids = np.array(encode(coder, "".join(pieces)), np.int64)
                ends = np.cumsum(sizes[ids])
                bounds = np.concatenate([[0], np.cumsum([len(x.encode()) for x in pieces])])
                counts = attribute(ends - sizes[ids], ends, bounds, rule)
                lengths = [len(x) for x in pieces]
                row += [r] * len(pieces)
                section += range(len(pieces))
                field += [fields[min(i, len(parts) - 1)] for i in range(len(pieces))]
                start += [0, *np.cumsum(lengths)[:-1].tolist()]
                chars += lengths
                tokens += counts.tolist()
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(section, pa.int32()), pa.array(field, pa.string()), pa.array(start, pa.int64()), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())], names=list(names))

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), *(F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)))
    return rows.mapInArrow(run, f"id {kind}, section int, field string, start long, chars long, tokens long").withColumnRenamed("id", id_col)
