"""Lines that many documents share are dropped from all of them."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.tables import SPACES, in_slices, join_counted, stored

_SPACES = SPACES.encode()


def _key(line: bytes) -> bytes:
    """A line as it is compared: no white space at its ends, A-Z in lower case (bytes.lower leaves all else alone)."""
    return line.strip(_SPACES).lower()


def _hash(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _line_hashes(min_chars: int):
    """Each document's distinct line hashes. A key has no fewer bytes than code points, so only short keys are decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            ids, hashes = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = {_key(line) for line in (text or "").encode().split(b"\n")}
                own = {_hash(k) for k in keys if len(k.decode()) >= min_chars}
                ids += [doc] * len(own)
                hashes += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], ["doc", "line"])

    return run


def _without(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            total, gone, kept = [], [], []
            for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = (text or "").encode().split(b"\n")
                stay = lines
                if drop:
                    common = set(drop)
                    stay = [x for x in lines if len((k := _key(x)).decode()) < min_chars or _hash(k) not in common]
                total.append(len(lines))
                gone.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                ["id", "n_lines", "n_dropped", "text"],
            )

    return run


def drop_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """Per row of docs: its id, n_lines and n_dropped, and text without the lines whose key is found in min_docs
    documents or more.

    Texts are split at \\n; null and empty texts are one empty line. A key shorter than min_chars code points never goes.
    Each row is a document, so rows that repeat an id, or have none, count each for itself. Other columns are ignored, so
    their names can't clash; an empty table gives no rows. A line's number of documents is known before documents meet
    the common lines, so lines of very many documents are joined where they are (see join_counted).
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("doc"))
    kind = docs.schema[id_col].dataType.simpleString()
    lines = stored(narrow.select("doc", "text").mapInArrow(_line_hashes(min_chars), "doc long, line binary"), "lines")
    # each row has a line once, so rows are documents
    common = stored(lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs), "lines-common")
    # one entry for each common line of a document, so a list is no longer than its document; rows of equal id and text share it
    per_doc = join_counted(lines, common, "line").groupBy("doc").agg(F.collect_set("line").alias("drop")).withColumnRenamed("doc", "other")
    return (
        narrow.join(per_doc, narrow["doc"] == per_doc["other"], "left")
        .select("id", "text", "drop")
        .mapInArrow(_without(min_chars), f"id {kind}, n_lines long, n_dropped long, text string")
        .withColumnRenamed("id", id_col)
    )
