"""Two tokenizers' tokens of the same texts, linked where their bytes meet, and how often the corpus links a pair of ids."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.tables import in_slices, stored

BYTE_TOKENS, PIECE_TOKENS = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
_LARGEST_VOCABULARY = 64 << 20
#: A flush of postings: so many links or documents at most, but for the last document's own.
_LINKS, _DOCS = 1 << 20, 1 << 12
#: Chunks remembered by a task, and the longest that is worth it.
_KNOWN, _LONGEST = 400_000, 64
#: Postings of one id that one task reads.
_PER_TASK = 2_000_000
#: Where a space follows what isn't white space. No token of either kind reaches across, so what lies between two such places
#: is encoded by itself, and they are ends of tokens in both.
_CUT, _WHITE_THEN_SPACE = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")


def chunks(text: str) -> list[str]:
    """A space and text, cut before each space that follows what isn't white space; each chunk without its first space."""
    if _WHITE_THEN_SPACE.search(text) or text[:1].isspace():
        return [p[1:] for p in _CUT.split(f" {text}")]
    return text.split(" ")


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters for themselves, the
    characters from 256 on for the other bytes in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers, and the bytes of their entries."""

    def __init__(self, byte_json: bytes, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_json.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=piece_model)
        of, vocabulary = byte_level(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            self.a_bytes[k] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
        self.b_bytes = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.a_length, self.b_length = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """B adds a space of its own to a text; alone it is one token, which an empty text wouldn't show."""
        return [ids if t else [self.space] for t, ids in zip(texts, self.b.encode(texts, num_threads=1), strict=True)]


def _encoded(parts: list[str], sizes: np.ndarray, lengths: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
    """Ids of chunks, none of which ends in white space, and how many each has. 256 chunks are encoded as one text, whose tokens
    end where chunks do; if their bytes don't come back, one by one."""
    starts = range(0, len(parts), 256)
    ids, counts = [], []
    for s, found in zip(starts, encode([" ".join(parts[s : s + 256]) for s in starts]), strict=True):
        own = np.array(found, np.int64)
        ends, want = lengths[own].cumsum(), sizes[s : s + 256].cumsum()
        at = np.searchsorted(ends, want)
        if len(ends) == at[-1] + 1 and (ends[at] == want).all():
            ids.append(own)
            counts.append(np.diff(at, prepend=-1))
        else:
            each = encode(parts[s : s + 256])
            ids.append(np.fromiter(chain.from_iterable(each), np.int64))
            counts.append(np.fromiter(map(len, each), np.int64))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *ids]), np.concatenate([none, *counts])


class Chunks:
    """What is known of chunks, a place each: counts, links (A id << 24 | B id) and the text of the groups."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.size, self.names = 0, []
        self.counts, self.ends, self.links = np.zeros((0, 4), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def add(self, parts: list[str]) -> None:
        """Groups of many chunks at once: laid end to end, chunks end where tokens of both kinds do."""
        if not parts:
            return
        parts = sorted(parts, key=lambda p: p[-1:].strip() == "")
        inner = next((k for k, p in enumerate(parts) if not p[-1:].strip()), len(parts))
        sizes = np.fromiter((len(p.encode()) + 1 for p in parts), np.int64, len(parts))
        found, good = [], np.ones(len(parts), bool)
        for encode, own, lengths in ((self.pair.encode_a, self.pair.a_bytes, self.pair.a_length), (self.pair.encode_b, self.pair.b_bytes, self.pair.b_length)):
            ids, n = _encoded(parts[:inner], sizes[:inner], lengths, encode)
            more = encode(parts[inner:])
            ids, n = np.concatenate([ids, np.fromiter(chain.from_iterable(more), np.int64)]), np.append(n, [len(x) for x in more]).astype(np.int64)
            if b"".join(map(own.__getitem__, ids.tolist())) != "".join(f" {p}" for p in parts).encode():
                cuts = n.cumsum()
                good &= [b"".join(map(own.__getitem__, x.tolist())) == f" {p}".encode() for p, x in zip(parts, np.split(ids, cuts[:-1]), strict=True)]
            found.append((ids, n))
        (a_ids, n_a), (b_ids, n_b) = ((ids[np.repeat(good, n)], np.where(good, n, 0)) for ids, n in found)
        a_ends, b_ends = self.pair.a_length[a_ids].cumsum(), self.pair.b_length[b_ids].cumsum()
        both = a_ends[b_ends[np.minimum(np.searchsorted(b_ends, a_ends), len(b_ends) - 1)] == a_ends] if len(a_ends) else a_ends
        a_group, b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        in_a, in_b = np.bincount(a_group, minlength=len(both)), np.bincount(b_group, minlength=len(both))
        # each A token with each B token of its group
        times = in_b[a_group]
        first = np.repeat((in_b.cumsum() - in_b)[a_group], times)
        at = np.arange(len(first)) - np.repeat(times.cumsum() - times, times)
        links = np.repeat(a_ids, times) << 24 | b_ids[first + at]
        chunk_of_group = np.repeat(np.arange(len(parts)), n_a)[in_a.cumsum() - 1] if len(both) else np.zeros(0, np.int64)
        groups = np.bincount(chunk_of_group, minlength=len(parts))
        n_links = np.bincount(chunk_of_group, weights=in_a * in_b, minlength=len(parts)).astype(np.int64)
        left, right = ([*map(str, ids.tolist())] for ids in (a_ids, b_ids))
        names, i, j = [], 0, 0
        for x, y in zip(in_a.tolist(), in_b.tolist(), strict=True):
            names.append(f"{left[i] if x == 1 else ','.join(left[i : i + x])}|{right[j] if y == 1 else ','.join(right[j : j + y])}")
            i, j = i + x, j + y
        cuts = groups.cumsum().tolist()
        self.names += [";".join(names[s:e]) for s, e in zip([0, *cuts[:-1]], cuts, strict=True)]
        self.place.update(zip(parts, range(self.size, self.size + len(parts)), strict=True))
        self.size += len(parts)
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, groups, good], axis=1)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + n_links.cumsum()])
        self.links = np.concatenate([self.links, links])

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The places of each text's chunks."""
        cut = [chunks(t) if t else [] for t in texts]
        if self.size > _KNOWN:
            self.clear()
        new = set().union(*cut) - self.place.keys()
        self.add(sorted(new))
        places = [np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts)) for parts in cut]
        for p in new:
            if len(p) > _LONGEST:
                del self.place[p]
        return places


def _lists(values: np.ndarray, starts: np.ndarray, kind: type = np.int32) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values.astype(kind)))


_POSTINGS = "batch long, kind int, doc int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, bs array<int>, docs array<int>, times array<int>"


def _linked(byte_json, piece_model):
    """Rows (id, text) in. Out: a row of kind 0 for each document; then, for each flush of documents and A id, the B ids it is
    linked with and in how many documents (kind 1), and the same by document with multiplicities (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Chunks(Pair(byte_json.value, piece_model.value))
        batch = TaskContext.get().partitionId() << 32
        held, docs, links = [], 0, 0
        schema = None

        def record(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        def flush() -> list[pa.RecordBatch]:
            key, times = np.unique(np.concatenate(held), return_counts=True)
            a, b, doc = key >> 36, key >> 12 & 0xFFFFFF, key & 0xFFF
            start = np.flatnonzero(np.diff(a, prepend=-1))
            run_start = np.flatnonzero(np.diff(key >> 12, prepend=-1))
            n, ids = len(start), pa.array(a[start].astype(np.int32))
            same = {"batch": pa.array(np.full(n, batch)), "a": ids}
            counted = record(n, kind=pa.array(np.full(n, 1, np.int32)), bs=_lists(b[run_start], np.searchsorted(run_start, start)),
                             times=_lists(np.diff(np.append(run_start, len(key))), np.searchsorted(run_start, start)), **same)
            posted = record(n, kind=pa.array(np.full(n, 2, np.int32)), bs=_lists(b, start), docs=_lists(doc, start), times=_lists(times, start), **same)
            return [counted, posted]

        for part in in_slices(batches):
            if schema is None:
                ints = pa.list_(pa.int32())
                kinds = [("id", part.schema.field(0).type), ("batch", pa.int64()), ("kind", pa.int32()), ("doc", pa.int32()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]]
                schema = pa.schema([*kinds, ("groups_sha256", pa.string()), ("a", pa.int32()), ("bs", ints), ("docs", ints), ("times", ints)])
            if links > _LINKS or docs + part.num_rows > _DOCS:
                if held:
                    yield from flush()
                held, docs, links, batch = [], 0, 0, batch + 1
            rows = []
            for own in known.of(part.column(1).to_pylist()):
                if not len(own) or not known.counts[own, 3].all():
                    rows.append((0, 0, 0, 0, ""))
                else:
                    starts, sizes = known.ends[own], known.ends[own + 1] - known.ends[own]
                    at = np.repeat(starts - (sizes.cumsum() - sizes), sizes) + np.arange(sizes.sum())
                    held.append(known.links[at] << 12 | docs)
                    links += len(at)
                    text = ";".join(map(known.names.__getitem__, own.tolist()))
                    rows.append((*known.counts[own, :3].sum(axis=0).tolist(), len(at), hashlib.sha256(text.encode()).hexdigest()))
                docs += 1
            n = part.num_rows
            places = np.arange(docs - n, docs, dtype=np.int32)
            columns = dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"), (pa.array(list(c)) for c in zip(*rows, strict=True)), strict=True))
            yield record(n, id=part.column(0), batch=pa.array(np.full(n, batch)), kind=pa.array(np.zeros(n, np.int32)), doc=pa.array(places), **columns)
        if held:
            yield from flush()

    return run


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, kind, batch, bs, docs, times), sorted. An A id's counts by B id come first, so they are whole before its
    postings are met; then each posting adds to its document. Held: counts of one A id, which are no more than the B ids there
    are, and the sums of documents until they are passed on, a row for each batch."""
    now, count, best = None, np.zeros(0, np.int64), 0
    keys, bests, sums, size = [], [], [], 0

    def passed_on() -> pa.RecordBatch:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = [np.zeros(len(key), np.int64) for _ in range(2)]
        for out, own in zip(total, (bests, sums), strict=True):
            np.add.at(out, at, np.concatenate(own))
        start = np.flatnonzero(np.diff(key >> 12, prepend=-1))
        lists = [_lists(key & 0xFFF, start), *(_lists(x, start, np.int64) for x in total)]
        return pa.RecordBatch.from_arrays([pa.array(key[start] >> 12), *lists], ["batch", "docs", "n_best", "count_sum"])

    for batch in batches:
        a, salt, kind, number = (batch.column(i).to_numpy() for i in range(4))
        bs, docs, times = (batch.column(i) for i in range(4, 7))
        offsets, doc_offsets = bs.offsets.to_numpy(), docs.offsets.to_numpy()
        b_values, doc_values, time_values = (c.values.to_numpy() for c in (bs, docs, times))
        time_offsets = times.offsets.to_numpy()
        group = np.stack([a, salt, kind], axis=1)
        starts = [0, *(np.flatnonzero((np.diff(group, axis=0) != 0).any(axis=1)) + 1).tolist()] if batch.num_rows else []
        for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            b, t = b_values[offsets[s] : offsets[e]], time_values[time_offsets[s] : time_offsets[e]].astype(np.int64)
            if (a[s], salt[s]) != now:
                now, count, best = (a[s], salt[s]), np.zeros(0, np.int64), 0
            if kind[s] == 1:
                if len(b) and b.max() >= len(count):
                    count = np.concatenate([count, np.zeros(b.max() + 1 - len(count), np.int64)])
                np.add.at(count, b, t)
                best = count.max(initial=0)
                continue
            n = count[b]
            keys.append(np.repeat(number[s:e], np.diff(doc_offsets[s : e + 1])) << 12 | doc_values[doc_offsets[s] : doc_offsets[e]])
            bests.append(np.where(n == best, t, 0))
            sums.append(n * t)
            size += len(b)
            if size > _PER_TASK:
                yield passed_on()
                keys, bests, sums, size = [], [], [], 0
    if keys:
        yield passed_on()


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (batch, docs, n_best, count_sum), sorted by batch, in; their sums by document out."""
    now, seen, total = None, np.zeros(_DOCS, bool), np.zeros((2, _DOCS), np.int64)

    def summed() -> pa.RecordBatch:
        doc = np.flatnonzero(seen)
        return pa.RecordBatch.from_arrays([pa.array(now << 12 | doc), *(pa.array(x[doc]) for x in total)], ["key", "n_best", "count_sum"])

    for batch in batches:
        for k, number in enumerate(batch.column(0).to_pylist()):
            if number != now:
                if now is not None:
                    yield summed()
                now, seen, total = number, np.zeros(_DOCS, bool), np.zeros((2, _DOCS), np.int64)
            doc, *more = (batch.column(i)[k].values.to_numpy() for i in (1, 2, 3))  # each document once
            seen[doc] = True
            for out, x in zip(total, more, strict=True):
                out[doc] += x
    if now is not None:
        yield summed()


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        found = file.read(_LARGEST_VOCABULARY + 1)
    if len(found) > _LARGEST_VOCABULARY:
        raise ValueError(f"{path} is larger than {_LARGEST_VOCABULARY} bytes")
    return found


def linked_tokens(docs: DataFrame, id_col: str, text_col: str, byte_tokens: str, piece_tokens: str) -> DataFrame:
    """The stored rows that _linked makes."""
    context = docs.sparkSession.sparkContext
    files = [context.broadcast(_read(p)) for p in (byte_tokens, piece_tokens)]
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(narrow.mapInArrow(_linked(*files), f"id {docs.schema[id_col].dataType.simpleString()}, {_POSTINGS}"), "alignment")


def align_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_tokens: str = BYTE_TOKENS, piece_tokens: str = PIECE_TOKENS
) -> DataFrame:
    """Per row of docs: id, n_a and n_b (tokens of a space and the text by the byte-level tokenizer A, of the text by the piece
    tokenizer B, which adds the space), n_groups (groups between byte offsets where tokens of both end), n_links (pairs of an A
    and a B token of one group), n_best (links whose pair of ids is linked in as many documents as any of its A id), count_sum
    (over links, how many documents link that pair of ids) and groups_sha256.

    A null or empty text has no tokens, nor has one that either tokenizer doesn't give back (B reads U+2581 as a space): zeros
    and an empty groups_sha256. Rows that repeat an id are documents of their own. Other columns are ignored. An empty table gives no
    rows. Vocabulary files are read by the driver and broadcast; above 64 MB they are refused.

    Multiplicities of pairs by document are shuffled by A id, in Spark's sorted streams, behind the id's counts, so that one pass
    has counts and their maximum before it meets documents. An id of very many postings is dealt to several tasks, each of which
    gets its counts. Documents' contributions are added up by document.
    """
    rows = linked_tokens(docs, id_col, text_col, byte_tokens, piece_tokens)
    # one row for each id of a vocabulary
    shares = rows.where("kind = 2").groupBy("a").agg((F.sum(F.size("bs")) / _PER_TASK).alias("share")).select("a", F.ceil("share").cast("int").alias("tasks"))
    dealt = rows.where("kind > 0").select("a", "kind", "batch", "bs", F.coalesce("docs", F.array().cast("array<int>")).alias("docs"), "times").join(F.broadcast(shares), "a")
    every = F.sequence(F.lit(0), F.col("tasks") - 1)
    own = F.array(F.pmod(F.xxhash64("batch"), F.col("tasks")).cast("int"))
    salted = dealt.withColumn("salt", F.explode(F.when(F.col("kind") == 1, every).otherwise(own)))
    # an id's rows must be whole and in order within a task
    streams = salted.select("a", "salt", "kind", "batch", "bs", "docs", "times").repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    parts = streams.mapInArrow(_contributions, "batch long, docs array<int>, n_best array<long>, count_sum array<long>")
    sums = parts.repartition("batch").sortWithinPartitions("batch").mapInArrow(_by_document, "key long, n_best long, count_sum long")
    each = rows.where("kind = 0").withColumn("key", F.expr("shiftleft(batch, 12) | doc"))
    return each.join(sums, "key", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256",
    )


def linked_ids(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_tokens: str = BYTE_TOKENS, piece_tokens: str = PIECE_TOKENS
) -> DataFrame:
    """(a, b, n_docs, best) for each pair of ids that any document links: in how many it does, and whether no other B id has
    more of the A id's. As many rows as two vocabularies have pairs, at most."""
    rows = linked_tokens(docs, id_col, text_col, byte_tokens, piece_tokens).where("kind = 1")
    counts = rows.select("a", F.explode(F.arrays_zip("bs", "times")).alias("x")).groupBy("a", F.col("x.bs").alias("b")).agg(F.sum("x.times").alias("n_docs"))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(F.broadcast(most), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
