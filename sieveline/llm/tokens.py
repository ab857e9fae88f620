"""Token counts of a text's sections, from one encoding of the whole text."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE of this family splits a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("first", "last", "most", "share")
_LARGEST_VOCABULARY = 64 << 20
#: Unicode's White_Space, a few thousand times.
_LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{5000,}")


class Encoder:
    """Byte-level BPE from a file's ranks. A text's token ends come from the tokens' lengths: they are its bytes in
    order, so nothing has to be decoded."""

    def __init__(self, ranks: bytes):
        import tiktoken

        merged = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merged, special_tokens={})
        self.lengths = np.zeros(max(merged.values()) + 1, np.int64)
        for token, rank in merged.items():
            self.lengths[rank] = len(token)

    def encode(self, text: str) -> list[int]:
        """Very long white space overflows the pattern's look-ahead, so it is cut out: all but its last character is a
        piece of its own if something follows, just as the pattern has it, and else all of it."""
        found, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            found += self.encoding.encode_ordinary(text[at : run.start()])
            found += self.encoding._encode_single_piece(text[run.start() : end])
            at = end
        return found + self.encoding.encode_ordinary(text[at:])

    def ends(self, text: str) -> np.ndarray:
        return self.lengths[np.array(self.encode(text), np.int64)].cumsum()


def attribute(ends: np.ndarray, cuts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. ends: where tokens end, in bytes; cuts: where sections end, the last at the last token's
    end. A token that crosses a boundary goes to the section of its first byte (first), of its last (last), to that which
    has most of its bytes, the earlier of equals (most), or to each by its share of bytes (share). The sum over sections
    is the number of tokens."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(cuts, starts, side="right")
    last = np.searchsorted(cuts, ends - 1, side="right")
    counts = np.bincount(first[first == last], minlength=len(cuts)).astype(np.float64)
    for s, e, a, b in zip(*(x[first != last] for x in (starts, ends, first, last)), strict=True):
        held = np.diff(np.concatenate([[s], np.clip(cuts[a:b], s, e), [e]]))
        if rule == "share":
            counts[a : b + 1] += held / (e - s)
        else:
            counts[{"first": a, "last": b}.get(rule, a + int(held.argmax()))] += 1
    return counts


def sections_of(fields: list[str | None], separator: str) -> tuple[str, list[tuple[int, int, int, int, int]]]:
    """The fields joined by line ends, and (field, section, char start, char end, byte end) in order. A separator belongs
    to the section before it, the line end between fields to the last section of the field before it."""
    parts, spans, chars, size = [], [], 0, 0
    for f, field in enumerate(fields):
        text = field or ""
        pieces = text.split(separator) if separator else [text]
        pieces = [p + separator for p in pieces[:-1]] + [pieces[-1] + ("\n" if f + 1 < len(fields) else "")]
        for s, piece in enumerate(pieces):
            size += len(piece.encode())
            spans.append((f, s, chars, chars + len(piece), size))
            chars += len(piece)
            parts.append(piece)
    return "".join(parts), spans


def _counted(ranks, fields: tuple[str, ...], separator: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            docs, rows = [], []
            columns = [batch.column(i + 1).to_pylist() for i in range(len(fields))]
            for doc, *values in zip(batch.column(0).to_pylist(), *columns, strict=True):
                text, spans = sections_of(values, separator)
                counts = attribute(encoder.ends(text), np.array([s[4] for s in spans]), rule)
                docs += [doc] * len(spans)
                rows += [(fields[f], s, a, b, n) for (f, s, a, b, _), n in zip(spans, counts.tolist(), strict=True)]
            values = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            arrays = [pa.array(docs, batch.schema.field(0).type), *(pa.array(v, t) for v, t in zip(values, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "field", "section", "char_start", "char_end", "tokens"])

    return run


def section_tokens(
    docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), separator: str = "\n", rule: str = "first",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(id, field, section, char_start, char_end, tokens) for every section of every row of docs. The fields are joined by
    line ends and encoded once, as a whole; sections are what separator cuts a field into, with the separator at the end
    of each but the last, and a token across a boundary is allocated by rule (see attribute).

    tokens is a whole number but under rule share. A null or empty field is one section, which has at most the line end
    after it. Rows that repeat an id have their sections once each. Columns that aren't named are ignored. An empty table
    gives no rows. The vocabulary is read by the driver and broadcast; one above 64 MB is refused.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as file:
        ranks = file.read(_LARGEST_VOCABULARY + 1)
    if len(ranks) > _LARGEST_VOCABULARY:
        raise ValueError(f"{vocabulary} is larger than {_LARGEST_VOCABULARY} bytes")
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = f"id {kind}, field string, section int, char_start long, char_end long, tokens double"
    return narrow.mapInArrow(_counted(held, tuple(fields), separator, rule), schema).withColumnRenamed("id", id_col)
