"""Log-probabilities of texts under an n-gram model whose counts are levels in a Bloom filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sieveline.llm.bloom import CountFilter, Levels, mixed
from sieveline.llm.tables import SPACES, in_slices, stored

#: No words: a word holds no space.
END, PAD = np.uint64(xxh64_intdigest(b" end", 42)), np.uint64(xxh64_intdigest(b" pad", 42))
_FACTOR, _JOIN = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES.encode(), np.uint8))
#: Words longer than this are hashed one by one.
_LONG = 256
#: Grams that a task gathers before it passes counts on; tokens scored at a time; grams merged at a time.
_GATHERED, _WINDOW, _MERGED = 1_000_000, 125_000, 1_000_000
#: Characters that are scored together, but for a longer text; bytes of text for each part of the filter, and the largest number of parts.
_TOGETHER, _PART, _PARTS = 750_000, 8 << 20, 1 << 16
#: Bytes of tables that are broadcast at once; bytes that a task holds in one pass over the texts, but for single tokens' counts.
_PIECE, _HELD = 16 << 20, 64 << 20


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z in lower case, and the number of words of each text. A word's bytes are taken eight at a time,
    for all words together; two words of up to eight bytes never share a hash."""
    own = [(t or "").encode().lower() for t in texts]
    sizes = np.array([len(x) for x in own], np.int64)
    blob = b"\n".join(own) + b"\n" + bytes(8)
    at = np.frombuffer(blob, np.uint8)
    space = _SPACE[at[:-8]]
    edge = np.diff(space, prepend=True, append=True)
    starts = np.flatnonzero(edge[:-1] & ~space)
    ends = np.flatnonzero(edge[1:] & ~space) + 1
    length = ends - starts
    eight = np.ndarray(len(blob) - 7, "<u8", blob, strides=(1,))
    h, left, piece = length.astype(np.uint64) * _JOIN, np.flatnonzero(length <= _LONG), 0
    while len(left):
        v, rest = eight[starts[left] + 8 * piece], length[left] - 8 * piece
        short = rest < 8
        v[short] &= (np.uint64(1) << (8 * rest[short]).astype(np.uint64)) - np.uint64(1)
        x = (h[left] ^ v) * _FACTOR
        h[left] = x ^ (x >> np.uint64(32))
        piece += 1
        left = left[length[left] > 8 * piece]
    h = mixed(h)
    for k in np.flatnonzero(length > _LONG):
        h[k] = xxh64_intdigest(blob[starts[k] : ends[k]], 42)
    after = (sizes + 1).cumsum()
    return h, np.diff(np.searchsorted(starts, after), prepend=0)


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and an end, and the number of tokens of each text."""
    words, n = word_hashes(texts)
    return np.insert(words, n.cumsum(), END), n + 1


def grams_of(tokens: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length from 1 to order, the gram that ends at each token; place is a token's in its text, before which there are pads."""
    grams, past = [tokens], tokens
    for k in range(1, order):
        past = np.concatenate([[PAD], past[:-1]])
        past[place < k] = PAD
        grams.append(mixed(past * _JOIN + grams[-1]))
    return grams


def places(counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) - np.repeat(counts.cumsum() - counts, counts)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Grows with the key, so sorted keys are sorted by part, too."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


@dataclass
class Pack:
    """Tables of several parts behind one another, so that grams of all of them are looked up at once. starts and sizes: by kind, of
    each part's filter in words, size 0 where it isn't here. Single tokens are sorted, as parts grow with the key."""

    hashes: int
    starts: dict[int, np.ndarray]
    sizes: dict[int, np.ndarray]
    words: np.ndarray
    keys: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray] | CountFilter], parts: int) -> Pack:
        out, words, keys, counts, at = Pack(0, {}, {}, *(np.zeros(0, np.uint64),) * 3), [], [], [], 0
        for (kind, part), table in sorted(tables.items(), key=lambda x: x[0]):
            if kind == 1:
                keys.append(table[0])
                counts.append(table[1])
                continue
            if kind not in out.sizes:
                out.starts[kind], out.sizes[kind] = np.zeros(parts, np.int64), np.zeros(parts, np.uint64)
            out.hashes, out.starts[kind][part], out.sizes[kind][part] = table.hashes, at, len(table.words)
            words.append(table.words)
            at += len(table.words)
        out.words, out.keys, out.counts = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (words, keys, counts))
        return out

    def look(self, keys: np.ndarray) -> np.ndarray:
        """Counts of single tokens."""
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0).astype(np.float64)

    def levels(self, kind: int, keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Levels of grams of kind tokens, whose parts are given; 0 where their filter isn't here."""
        out = np.zeros(len(keys), np.uint8)
        if kind in self.sizes:
            here = np.flatnonzero(self.sizes[kind][parts])
            own = parts[here]
            out[here] = CountFilter(self.hashes, self.words).levels(keys[here], self.starts[kind][own], self.sizes[kind][own])
        return out


@dataclass
class Model:
    """Totals of the training tokens, and what each length's contexts give to shorter ones: a context of count c gives as much
    as c ** powers[k] tokens would."""

    order: int
    tokens: int
    types: int
    texts: int
    powers: list[float]
    levels: Levels
    parts: int
    tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray] | CountFilter] = field(default_factory=dict)
    packs: list[Pack] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.tables and not self.packs:
            self.packs = [Pack.of(self.tables, self.parts)]

    def look(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct grams of kind tokens: exact for single tokens, a level's middle for longer ones."""
        if kind > 1:
            return self.levels.middles[self.look_levels(kind, keys)]
        return sum((p.look(keys) for p in self.packs), np.zeros(len(keys)))  # a token is in one of them at most

    def look_levels(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Levels of distinct grams of kind tokens, 0 where their table isn't among those held."""
        out, parts = np.zeros(len(keys), np.uint8), part_of(keys, self.parts)
        for p in self.packs:
            out |= p.levels(kind, keys, parts)
        return out

    def held(self, kind: int) -> np.ndarray:
        """Of each part, whether its table of grams of kind tokens is among those held."""
        return sum((p.sizes[kind] > 0 for p in self.packs if kind in p.sizes), np.zeros(self.parts, bool))


def answer(table, keys: np.ndarray, levels: Levels) -> np.ndarray:
    if isinstance(table, CountFilter):
        return levels.middles[table.levels(keys)]
    held, counts = table
    at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    return np.where(held[at] == keys, counts[at], 0).astype(np.float64)


def log_probabilities(
    tokens: np.ndarray, place: np.ndarray, model: Model, look: Callable[[int, np.ndarray], np.ndarray], found: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, model's, count) of each token. The base is (c + 1) / (N + V + 1). From there on each longer context h mixes in its
    own share: p = (c(h w) + K p) / (c(h) + K) with K = c(h) ** power, so that probabilities after h add up to 1 as far as levels
    have the counts. A gram can't be more frequent than its context or its end, which also mends most false hits of the filter.
    found has the levels of grams of two and more tokens, a row for each length; without it, look is asked for their counts, too."""
    known = []
    for k, grams in enumerate(grams_of(tokens, place, model.order if found is None else 1), 1):
        keys, at = np.unique(grams, return_inverse=True)
        known.append(look(k, keys)[at])
    if found is not None:
        known += [model.levels.middles[x] for x in found]
    p = base = (known[0] + 1) / (model.tokens + model.types + 1)
    for k in range(1, model.order):
        context = np.where(place > 0, np.concatenate([[0], known[k - 1][:-1]]), model.texts)
        known[k] = np.minimum(np.minimum(known[k], context), known[k - 1])
        give = np.where(context > 0, context ** model.powers[k], 1)
        p = np.where(context > 0, (known[k] + give * p) / (context + give), p)
    return np.log10(base), np.log10(p), known[0]


def text_scores(tokens: np.ndarray, n: np.ndarray, model: Model, look: Callable[[int, np.ndarray], np.ndarray], found: np.ndarray | None = None) -> list[np.ndarray]:
    """[tokens, known tokens, base score, score] of texts of n tokens each, some tokens at a time. Sums are taken text by text in
    billionths, so they don't depend on what else is scored. found: as in log_probabilities."""
    place, doc = places(n), np.repeat(np.arange(len(n)), n)
    known, base, score = (np.zeros(len(n), np.int64) for _ in range(3))
    for s in range(0, len(tokens), _WINDOW):
        lead = min(s, model.order - 1)
        span = slice(s - lead, s + _WINDOW)
        low, high, count = (x[lead:] for x in log_probabilities(tokens[span], place[span], model, look, None if found is None else found[:, span]))
        own = doc[s : s + _WINDOW]
        for out, x in ((known, count > 0), (base, np.rint(low * 1e9)), (score, np.rint(high * 1e9))):
            np.add.at(out, own, x.astype(np.int64))
    return [n, known, base / 1e9, score / 1e9]


def text_levels(tokens: np.ndarray, n: np.ndarray, model: Model, found: np.ndarray | None = None) -> np.ndarray:
    """Levels of the grams of two and more tokens that end at each token of texts of n tokens each, a row for each length, as far as
    the model's tables and found have them. Only grams of parts that the model holds are sorted and looked up."""
    place, out = places(n), np.zeros((model.order - 1, len(tokens)), np.uint8) if found is None else found.copy()
    for s in range(0, len(tokens), _WINDOW):
        lead = min(s, model.order - 1)
        span = slice(s - lead, s + _WINDOW)
        for k, grams in enumerate(grams_of(tokens[span], place[span], model.order)[1:], 2):
            grams = grams[lead:]
            here = np.flatnonzero(model.held(k)[part_of(grams, model.parts)])
            keys, at = np.unique(grams[here], return_inverse=True)
            out[k - 2, s + here] = model.look_levels(k, keys)[at]
    return out


def _counted(order: int, parts: int):
    """Training texts in; the counts of their grams by part of the filter out, as two arrays of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(order)]
        size = 0

        def counted() -> pa.RecordBatch:
            rows = []
            for k, grams in enumerate(held, 1):
                keys, n = np.unique(np.concatenate(grams), return_counts=True)
                rows += [(part, k, keys[s:e].tobytes(), n[s:e].astype(np.uint32).tobytes()) for part, s, e in _by_part(keys, parts)]
            return _batch(rows, _COUNTED)

        for batch in in_slices(batches):
            tokens, n = tokens_of(batch.column(0).to_pylist())
            for out, grams in zip(held, grams_of(tokens, places(n), order), strict=True):
                out.append(grams)
            size += len(tokens)
            if size >= _GATHERED:
                yield counted()
                held, size = [[] for _ in range(order)], 0
        if size:
            yield counted()

    return run


_COUNTED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    part = part_of(keys, parts)
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
        yield int(part[s]), s, e


class _Merged:
    """Counts of the keys of one part and kind; no more is held than its distinct keys and some that wait."""

    def __init__(self):
        self.keys, self.counts, self.waiting, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(_MERGED, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1))) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts
        self.waiting, self.size = [], 0


_TABLES = pa.schema(
    [("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()), ("counts", pa.binary()), ("distinct", pa.int64()), ("total", pa.int64()), ("ends", pa.int64()), ("by_level", pa.list_(pa.int64()))]
)
_TABLE_COLUMNS = "part int, kind int, data binary, counts binary, distinct long, total long, ends long, by_level array<long>"


def _tables(growth: float, hashes: int):
    """Rows (part, kind, keys, counts), sorted, in; one table for each part and kind out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(growth)
        now, own = None, _Merged()

        def table() -> pa.RecordBatch:
            own.merge()
            level = levels.of(own.counts)
            ends = own.counts[own.keys == END].sum() if now[1] == 1 else 0
            if now[1] == 1:
                data, counts = own.keys.tobytes(), own.counts.astype(np.uint32 if own.counts.max(initial=0) < 1 << 32 else np.uint64).tobytes()
            else:
                data, counts = CountFilter.of(own.keys, level, hashes).words.tobytes(), b""
            return _batch([(*now, data, counts, len(own.keys), int(own.counts.sum()), int(ends), np.bincount(level).tolist())], _TABLES)

        for batch in batches:
            for part, kind, keys, counts in zip(*(batch.column(i) for i in range(4)), strict=True):
                if (part.as_py(), kind.as_py()) != now:
                    if now:
                        yield table()
                    now, own = (part.as_py(), kind.as_py()), _Merged()
                own.add(np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.uint32))
        if now:
            yield table()

    return run


def _table_of(row, hashes: int):
    """The table that a row of the stored tables holds."""
    if row["kind"] == 1:
        keys = np.frombuffer(row["data"], np.uint64)
        return keys, np.frombuffer(row["counts"], np.uint64 if len(row["counts"]) == keys.nbytes else np.uint32)
    return CountFilter(hashes, np.frombuffer(row["data"], np.uint64))


def power_of(by_level: np.ndarray, levels: Levels, distinct: int) -> float:
    """The power between 0 and 1 for which the contexts' counts, raised to it, add up to the number of distinct grams that
    follow them. by_level: how many contexts have a count of each level."""
    middles = levels.middles[: len(by_level)][1:]
    low, high = 0.0, 1.0
    for _ in range(50):
        at = (low + high) / 2
        low, high = (at, high) if (by_level[1:] * middles**at).sum() < distinct else (low, at)
    return low


@dataclass
class Trained:
    """The stored tables, their size in bytes, and the model without them."""

    tables: DataFrame
    bytes: int
    hashes: int
    model: Model


def train(texts: DataFrame, order: int = 2, growth: float = 1.3, hashes: int = 6) -> Trained:
    """The model of a column of texts. All grams of all texts are counted: tasks pass counts on by part of the filter, about 8 MB
    of text each, and one task merges a part and writes its table. A gram that most texts have is one key of each task, so no
    part is hot; parts are dealt by number, as a hash would give some tasks several, and all that a task reads is one Arrow batch."""
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    parts = int(min(_PARTS, max(1, -(-size // _PART))))
    rows = texts.mapInArrow(_counted(order, parts), "part int, kind int, keys binary, counts binary")
    # a part's rows must be whole and in order within a task
    merged = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind").mapInArrow(_tables(growth, hashes), _TABLE_COLUMNS)
    tables = stored(merged, "model")
    levels = Levels(growth)
    counts = {r["kind"]: r for r in tables.groupBy("kind").agg(F.sum("distinct").alias("distinct"), F.sum("total").alias("total"), F.sum("ends").alias("ends"), F.sum(F.length("data") + F.length("counts")).alias("bytes")).collect()}
    by_level: dict[int, np.ndarray] = {k: np.zeros(len(levels.middles), np.int64) for k in range(1, order + 1)}
    for r in tables.select("kind", F.posexplode("by_level").alias("level", "n")).groupBy("kind", "level").agg(F.sum("n").alias("n")).collect():
        by_level[r["kind"]][r["level"]] = r["n"]
    one = counts.get(1)
    powers = [0.0] + [power_of(by_level[k - 1], levels, counts[k]["distinct"]) if k in counts else 0.0 for k in range(2, order + 1)]
    model = Model(order, one["total"] if one else 0, one["distinct"] if one else 0, one["ends"] if one else 0, powers, levels, parts)
    return Trained(tables, sum(r["bytes"] for r in counts.values()), hashes, model)


_SCORES = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def _scored(model: Model, pieces, last: bool = True):
    """Rows (id, text) or, after another pass, (id, text, found) in; scores out if this pass is the last, else (id, text, found):
    the levels that passes have found so far, text by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**{**vars(model), "packs": [p.value for p in pieces]})
        ids, texts, before, size = [], [], [], 0

        def scores() -> pa.RecordBatch:
            found = np.concatenate([np.frombuffer(x, np.uint8).reshape(own.order - 1, -1) for x in before], axis=1) if before else None
            tokens, n = tokens_of(texts)
            levels = text_levels(tokens, n, own, found)
            if last:
                columns = [pa.array(x, t) for x, (_, t) in zip(text_scores(tokens, n, own, own.look, levels), _SCORES, strict=True)]
                return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns], ["id", *(c for c, _ in _SCORES)])
            ends = n.cumsum().tolist()
            each = pa.array([levels[:, e - m : e].tobytes() for e, m in zip(ends, n.tolist(), strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(texts, pa.string()), each], ["id", "text", "found"])

        for batch in in_slices(batches, 64):
            more = batch.column(1).to_pylist()
            ids.append(batch.column(0))
            texts += more
            before += batch.column(2).to_pylist() if batch.num_columns > 2 else []
            size += sum(map(len, filter(None, more)))
            if size >= _TOGETHER:
                yield scores()
                ids, texts, before, size = [], [], [], 0
        if ids:
            yield scores()

    return run


_ASKED = "batch long, kind int, part int, text string, keys binary"


def _asked(order: int, parts: int):
    """Texts in. Out: each with its batch (kind 0), and for each batch, kind and part the distinct grams to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, held = TaskContext.get().partitionId() << 32, 0, [[] for _ in range(order)]
        schema = None

        def questions() -> pa.RecordBatch:
            rows = []
            for k, grams in enumerate(held, 1):
                keys = np.unique(np.concatenate(grams))
                rows += [(None, number, k, part, None, keys[s:e].tobytes()) for part, s, e in _by_part(keys, parts)]
            return _batch(rows, schema)

        for batch in in_slices(batches):
            schema = schema or pa.schema([("id", batch.schema.field(0).type), ("batch", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string()), ("keys", pa.binary())])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, number)), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int32()), batch.column(1).cast(pa.string()), pa.nulls(n, pa.binary())], schema=schema)
            tokens, counts = tokens_of(batch.column(1).to_pylist())
            for out, grams in zip(held, grams_of(tokens, places(counts), order), strict=True):
                out.append(grams)
            size += len(tokens)
            if size >= _GATHERED:
                yield questions()
                number, size, held = number + 1, 0, [[] for _ in range(order)]
        if size:
            yield questions()

    return run


_ANSWERED = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])


def _answered(levels: Levels, hashes: int):
    """Rows (part, question, kind, batch, data, counts), sorted: a part's tables, then the questions to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tables = None, {}
        for batch in in_slices(batches, 64):
            rows = []
            for r in batch.to_pylist():
                if r["part"] != now:
                    now, tables = r["part"], {}
                if not r["question"]:
                    tables[r["kind"]] = _table_of(r, hashes)
                else:
                    keys = np.frombuffer(r["data"], np.uint64)
                    found = answer(tables[r["kind"]], keys, levels) if r["kind"] in tables else np.zeros(len(keys))
                    rows.append((r["batch"], r["kind"], r["part"], found.tobytes()))
            yield _batch(rows, _ANSWERED)

    return run


def _scored_by_answers(model):
    """Rows (id, batch, kind, part, text, counts), sorted: a batch's answers have kind -order to -1, its texts 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = model.value
        now, answers, texts, ids, kind = None, {}, [], [], None

        def scores() -> pa.RecordBatch:
            tokens, n = tokens_of(texts)
            known = {k: (np.unique(g), np.concatenate(answers[k])) for k, g in enumerate(grams_of(tokens, places(n), own.order), 1)}
            found = text_scores(tokens, n, own, lambda k, keys: known[k][1][np.searchsorted(known[k][0], keys)])
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(x, t) for x, (_, t) in zip(found, _SCORES, strict=True))], ["id", *(c for c, _ in _SCORES)])

        for batch in in_slices(batches):
            kind = batch.schema.field(0).type
            for r in batch.to_pylist():
                if r["batch"] != now:
                    if texts:
                        yield scores()
                    now, answers, texts, ids = r["batch"], {}, [], []
                if r["kind"] < 0:
                    answers.setdefault(-r["kind"], []).append(np.frombuffer(r["counts"], np.float64))
                else:
                    ids.append(r["id"])
                    texts.append(r["text"])
        if texts:
            yield scores()

    return run


def _passes(trained: Trained) -> list[Column]:
    """Conditions on tables that deal them to passes of _HELD bytes at most or of one table; single tokens' counts are exact, so
    they are all in the last."""
    size = F.length("data") + F.length("counts")
    sizes = trained.tables.select("kind", "part", size.alias("size")).collect()  # a row for each table
    ends, total = [], sum(r["size"] for r in sizes if r["kind"] == 1)
    if trained.bytes > _HELD:
        # the last pass, which has single tokens, is filled first
        for r in sorted((r for r in sizes if r["kind"] > 1), key=lambda r: (r["kind"], r["part"])):
            if total and total + r["size"] > _HELD:
                ends.append((r["kind"], r["part"]))
                total = 0
            total += r["size"]
    at = F.struct(F.col("kind"), F.col("part"))
    bounds = [F.struct(F.lit(k).cast("int").alias("kind"), F.lit(p).cast("int").alias("part")) for k, p in ends]
    conditions = [F.lit(True) if i == 0 else at >= bounds[i - 1] for i in range(len(bounds) + 1)]
    return [c & (at < bounds[i]) if i < len(bounds) else c for i, c in enumerate(conditions)][::-1]


def _broadcast(trained: Trained, own: Column) -> list:
    """The tables that fulfil own, in pieces, so that neither driver nor executors hold them more than once."""
    spark, pieces, held, size = trained.tables.sparkSession, [], {}, 0

    def sent() -> None:
        pieces.append(spark.sparkContext.broadcast(Pack.of(held, trained.model.parts)))

    for r in trained.tables.where(own).select("part", "kind", "data", "counts").toLocalIterator():
        held[r["kind"], r["part"]] = _table_of(r, trained.hashes)
        size += len(r["data"]) + len(r["counts"])
        if size >= _PIECE:
            sent()
            held, size = {}, 0
    if held or not pieces:
        sent()
    return pieces


def score_rows(rows: DataFrame, trained: Trained, most_bytes: int = 256 << 20) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) for each row (id, text).

    Tables of no more than most_bytes go to every task, _HELD bytes at a time: each pass over the texts but the last notes the
    levels that its tables have, a byte for each gram. Larger ones stay in parts: each batch of some texts sends its distinct
    grams to the parts that hold them, and scores its texts by the answers. All are the same to the last digit."""
    spark, model = rows.sparkSession, trained.model
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, n_known long, base_score double, score double"
    if trained.bytes <= most_bytes:
        *earlier, last = _passes(trained)
        for own in earlier:
            pieces = _broadcast(trained, own)
            rows = stored(rows.mapInArrow(_scored(model, pieces, last=False), f"id {kind}, text string, found binary"), "model-found")
            for p in pieces:
                p.destroy()
        return rows.mapInArrow(_scored(model, _broadcast(trained, last)), schema)
    asked = stored(rows.mapInArrow(_asked(model.order, model.parts), f"id {kind}, {_ASKED}"), "model-asked")
    nothing = F.lit(None)
    tables = trained.tables.select("part", F.lit(0).alias("question"), "kind", nothing.cast("long").alias("batch"), "data", "counts")
    questions = asked.where("kind > 0").select("part", F.lit(1), "kind", "batch", "keys", nothing.cast("binary"))
    # a part's rows, and then a batch's, must be whole and in order within a task
    met = tables.union(questions).repartitionById(model.parts, F.col("part")).sortWithinPartitions("part", "question")
    answers = met.mapInArrow(_answered(model.levels, trained.hashes), "batch long, kind int, part int, counts binary")
    texts = asked.where("kind = 0").select("id", "batch", "kind", "part", "text", nothing.cast("binary").alias("counts"))
    back = answers.select(nothing.cast(kind).alias("id"), "batch", (-F.col("kind")).alias("kind"), "part", nothing.cast("string").alias("text"), "counts")
    together = back.unionByName(texts).repartition("batch").sortWithinPartitions("batch", "kind", "part")
    return together.mapInArrow(_scored_by_answers(spark.sparkContext.broadcast(model)), schema)


def score_texts(
    docs: DataFrame, away: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2, growth: float = 1.3, hashes: int = 6, most_bytes: int = 256 << 20
) -> DataFrame:
    """Per row of docs: id, held_out (away; such rows aren't learned from), n_tokens (words and an end), n_known (tokens that
    training has), train_tokens, base_score and score: the log10 probability of the text by single tokens with one added to each
    count, and by the model of grams of up to order tokens (see log_probabilities).

    Words have A-Z in lower case. Tokens are told apart by 64-bit hashes and their own counts are exact; longer grams are in a
    Bloom filter whose levels grow by growth and with hashes bits for each key and level. A null or empty text is an end alone. A null in
    away is false. Rows that repeat an id are texts of their own. Other columns are ignored. An empty table gives no rows; without
    training rows each token has probability 1.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(away, F.lit(False)).alias("held_out"))
    trained = train(rows.where(~F.col("held_out")).select("text"), order, growth, hashes)
    # the flag travels with the id
    return score_rows(rows.select(F.struct("id", "held_out").alias("id"), "text"), trained, most_bytes).select(
        F.col("id.id").alias(id_col), "id.held_out", "n_tokens", "n_known", F.lit(trained.model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
