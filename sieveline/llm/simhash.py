"""SimHash fingerprints and the groups of documents whose fingerprints lie within a few bits of each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sieveline.llm.components import connected_components
from sieveline.llm.tables import content_of, join_counted, stored

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Nodes of the index have so many children.
_FANOUT = 4
#: Queries that walk the index together; bounds the walk's arrays.
_TOGETHER = 256
#: Neighbours in Gray order that are compared before the walk, which then passes over nodes of one component.
_BESIDE = 8
#: Cells of the index hold so many fingerprints, or more where the table would have more than _MOST_CELLS of them.
_CELL, _MOST_CELLS = 1 << 16, 1 << 14


def fingerprint(text: str | None, width: int = 3, seed: int = 42, chunk: int = 1 << 15) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's shingles of width words (repeats included).
    bytes.lower and bytes.split know ASCII only: A-Z, and U+0020 and U+0009 to U+000D."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n, counts = max(1, len(words) - width + 1), np.zeros(64, np.int64)
    for at in range(0, n, chunk):
        part = words[at : at + chunk + width - 1] if n > 1 else words
        shingles = map(b" ".join, zip(*[part[i:] for i in range(width)], strict=False)) if n > 1 or len(words) == width else [b" ".join(part)]
        hashes = np.array([xxh64_intdigest(s, seed) for s in shingles], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int64()), batch.column(2)], ["id", "fp", "content"])

    return run


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the order of the reflected Gray code: bit i is the parity of bits i to 63."""
    rank = bits.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class GrayTree:
    """A tree over rows of bits in Gray order. A node's pattern is the bits on which all below it agree; what its parent
    has already is left out of its mask, so that differences add up on the way down and a node whose sum exceeds the
    bound is left with all below it. Rows may themselves stand for groups: masks are the bits that they agree on."""

    def __init__(self, bits: np.ndarray, masks: np.ndarray | None = None):
        masks = np.full(len(bits), _ONES) if masks is None else masks
        both, any_ = bits & masks, bits | ~masks
        levels = [(masks, both)]
        while len(both) > 1:
            cuts = np.arange(0, len(both), _FANOUT)
            both, any_ = np.bitwise_and.reduceat(both, cuts), np.bitwise_or.reduceat(any_, cuts)
            levels.append((~(both ^ any_), both))
        levels.reverse()
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from the root down: own mask, pattern
        above = np.zeros(1, np.uint64)
        for mask, pattern in levels:
            up = above[np.arange(len(mask)) // _FANOUT] if len(mask) > 1 else above[:1]
            self.levels.append((mask & ~up, pattern))
            above = mask

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """The label of each node whose rows have one label, and -1 for the others, from the root down."""
        low = high = label
        levels = [label]
        while len(low) > 1:
            cuts = np.arange(0, len(low), _FANOUT)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            levels.append(np.where(low == high, low, -1))
        return levels[::-1]

    def near(self, bits: np.ndarray, max_bits: int, after: np.ndarray, own: np.ndarray, uniform: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) for all rows beyond `after` whose bits are within max_bits of a query's, but for rows below nodes
        whose one label is the query's own."""
        who, node, sums = np.arange(len(bits)), np.zeros(len(bits), np.int64), np.zeros(len(bits), np.uint8)
        below = _FANOUT ** (len(self.levels) - 1)
        for depth, (mask, pattern) in enumerate(self.levels):
            if depth:
                below //= _FANOUT
                node = (node[:, None] * _FANOUT + np.arange(_FANOUT)).ravel()
                who, sums = np.repeat(who, _FANOUT), np.repeat(sums, _FANOUT)
            open_ = (node < len(mask)) & ((node + 1) * below - 1 > after[who])
            node, who, sums = node[open_], who[open_], sums[open_]
            sums = sums + np.bitwise_count((bits[who] ^ pattern[node]) & mask[node])
            stay = sums <= max_bits
            if uniform is not None:
                stay &= uniform[depth][node] != own[who]
            node, who, sums = node[stay], who[stay], sums[stay]
        return who, node


class _Merged:
    """Least place of each place's component, over pairs given bit by bit."""

    def __init__(self, n: int):
        self.least = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.least[a], self.least[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.least, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.least[self.least]
                if (up == self.least).all():
                    break
                self.least = up


class GrayCell:
    """Fingerprints of one cell, in Gray order, with the components of those within max_bits of each other."""

    def __init__(self, bits: np.ndarray, max_bits: int):
        self.rank = gray_rank(bits)
        order = np.argsort(self.rank)
        self.bits, self.rank, self.max_bits = bits[order], self.rank[order], max_bits
        self.tree, merged, n = GrayTree(self.bits), _Merged(len(bits)), len(bits)
        for step in range(1, min(_BESIDE, n - 1) + 1):
            row = np.flatnonzero(np.bitwise_count(self.bits[:-step] ^ self.bits[step:]) <= max_bits)
            merged.add(row, row + step)
        anew = 0
        for turn, at in enumerate(range(0, n, _TOGETHER)):
            if turn == anew:  # labels are taken anew at every doubling
                uniform, anew = self.tree.uniform(merged.least), 2 * turn + 1
            rows = np.arange(at, min(at + _TOGETHER, n))
            who, found = self.tree.near(self.bits[rows], max_bits, rows, merged.least[rows], uniform)
            merged.add(rows[who], found)
        self.part = merged.least
        self.uniform = self.tree.uniform(self.part)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        row = np.flatnonzero(self.part != np.arange(len(self.part)))
        return self.bits[self.part[row]], self.bits[row]

    def visited(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of fingerprints of other cells with this one's components, one for each component."""
        out_a, out_b = [], []
        for at in range(0, len(bits), _TOGETHER):
            own = bits[at : at + _TOGETHER]
            place, label = np.searchsorted(self.rank, gray_rank(own)), np.full(len(own), -2)
            for step in range(-_BESIDE, _BESIDE):
                row = np.clip(place + step, 0, len(self.bits) - 1)
                label = np.where(np.bitwise_count(own ^ self.bits[row]) <= self.max_bits, self.part[row], label)
            who, row = self.tree.near(own, self.max_bits, np.full(len(own), -1), label, self.uniform)
            beside = np.flatnonzero(label >= 0)
            pairs = np.unique(np.stack([np.append(who, beside), np.append(self.part[row], label[beside])]), axis=1)
            out_a.append(self.bits[pairs[1]])
            out_b.append(own[pairs[0]])
        none = np.zeros(0, np.uint64)
        return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _visits(tree: GrayTree, max_bits: int):
    """Every fingerprint with its own cell, and with the later cells of the index that may hold others near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for at in range(0, len(bits), _TOGETHER):
                own = np.arange(at, min(at + _TOGETHER, len(bits)))
                who, to = tree.near(bits[own], max_bits, cell[own].astype(np.int64), own, None)
                columns = [np.append(cell[own], to).astype(np.int32), np.append(np.zeros(len(own), bool), np.ones(len(who), bool)), np.append(bits[own], bits[own][who]).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "visits", "fp"])

    return run


def _links(max_bits: int, batch_rows: int = 1 << 16):
    """Rows (cell, visits, fp) sorted by cell, a cell's own fingerprints before its visitors; links between fingerprints
    out: one for each own fingerprint but the first of a component, one for each visitor and component that it is near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, cell = None, [], None

        def out(pair: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(pair[0]), batch_rows):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + batch_rows].view(np.int64)) for x in pair], ["a", "b"])

        def closed() -> GrayCell:
            return GrayCell(np.concatenate(own), max_bits)

        for batch in batches:
            cells, visits, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]) | (visits[1:] != visits[:-1])))
            for a, b in zip(cuts, np.append(cuts[1:], len(cells)), strict=True):
                if cells[a] != at:
                    if own and cell is None:
                        yield from out(closed().links())
                    at, own, cell = cells[a], [], None
                if not visits[a]:
                    own.append(bits[a:b])
                elif own:
                    if cell is None:
                        cell = closed()
                        yield from out(cell.links())
                    yield from out(cell.visited(bits[a:b]))
        if own and cell is None:
            yield from out(closed().links())

    return run


def _in_gray_order(fp: Column) -> Column:
    """Sorts as the unsigned Gray rank does."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _cut(bounds: np.ndarray):
    """Every fingerprint with the number of its cell: how many of the bounds (Gray ranks, as _in_gray_order has them) lie
    below its rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = (gray_rank(batch.column(0).to_numpy().view(np.uint64)) ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, rank).astype(np.int32)), batch.column(0)], ["cell", "fp"])

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = 3, per_cell: int = _CELL) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints of fps (fp long) that differ in max_bits bits or fewer,
    directly or through others.

    All fingerprints are sorted by Gray rank over the cluster and cut into cells of about per_cell, 16,384 at most. A cell
    is a node: the bits that all its fingerprints share are its pattern. The tree above the cells is built of these
    patterns alone (at most 16,384 rows reach the driver, however many fingerprints there are) and goes to every task, where
    it sends a fingerprint on to the later cells whose patterns differ in max_bits bits or fewer. The tree below a cell
    is built and walked in the task that has the cell; its visitors stream by. Within a task, links that only repeat
    what others have joined are left out, so a dense cloud costs a link for each fingerprint and not for each pair.
    """
    once = stored(fps.select("fp").distinct(), "simhash-distinct")
    cells = min(_MOST_CELLS, max(1, -(-once.count() // per_cell)))
    bounds = np.zeros(0, np.int64)
    if cells > 1:  # a sketch's error moves a bound by a part of a cell
        at = F.array(*[F.lit(i / cells) for i in range(1, cells)])
        bounds = np.unique(np.array(once.agg(F.percentile_approx(_in_gray_order(F.col("fp")), at, F.lit(max(10_000, 8 * cells)))).first()[0], np.int64))
    dealt = stored(once.mapInArrow(_cut(bounds), "cell int, fp long"), "simhash-cells")
    shared = dealt.groupBy("cell").agg(F.expr("bit_and(fp)").alias("both"), F.expr("bit_or(fp)").alias("any")).orderBy("cell").toArrow()
    number = shared["cell"].to_numpy()
    both, any_ = np.zeros(int(number.max(initial=-1)) + 1, np.uint64), np.full(int(number.max(initial=-1)) + 1, _ONES)
    both[number], any_[number] = shared["both"].to_numpy().view(np.uint64), shared["any"].to_numpy().view(np.uint64)
    upper = GrayTree(both, ~(both ^ any_)) if len(both) else GrayTree(np.zeros(1, np.uint64))
    routed = dealt.select("cell", "fp").mapInArrow(_visits(upper, max_bits), "cell int, visits boolean, fp long")
    # cells must be whole and in order within a task
    whole = routed.repartition("cell").sortWithinPartitions("cell", "visits")
    return stored(whole.mapInArrow(_links(max_bits), "a long, b long"), "simhash-links")


def _groups(docs: DataFrame, id_col: str, text_col: str, width: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(id, content, fp) for each row, content being a hash of its text, and for each fingerprint (fp, n, least): its
    number of rows and the least (id, content) of its component, ids before none."""
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), content_of(F.col(text_col)).alias("content"))
    printed = narrow.mapInArrow(_fingerprints(width), f"id {kind}, fp long, content long")
    printed = stored(printed, "simhash")
    distinct = stored(printed.groupBy("fp").agg(F.min(least_row()).alias("least"), F.count(F.lit(1)).alias("n")), "simhash-groups")
    parts = connected_components(fingerprint_links(distinct, max_bits))  # only fingerprints that have a link
    return printed, with_least(distinct, parts, "fp")


def least_row() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), "id", "content")


def with_least(distinct: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """distinct (key, least, n) with least as the component's in parts (node, component)."""
    linked = stored(parts.join(distinct, parts["node"] == distinct[key]).select(key, "component", "least"), "groups-parts")
    lowest = linked.groupBy("component").agg(F.min("least").alias("lowest"), F.count(F.lit(1)).alias("n"))
    named = join_counted(linked.select(key, "component"), lowest, "component").select(key, "lowest")
    return stored(distinct.join(named, key, "left").select(key, F.coalesce("lowest", "least").alias("least"), "n"), "groups-least")


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3
) -> DataFrame:
    """Per row of docs: id, fingerprint (16 hex digits) and component_id, the smallest id that links reach.

    A text of fewer words than width is one shingle; a null or blank one has fingerprint zero and is linked like any
    other. Rows that repeat an id are fingerprinted each for itself. Null ids are no component's id unless it has no
    other, which makes it null. Other columns are ignored. An empty table gives no rows. Documents with equal
    fingerprints are one fingerprint in the search, however many there are.
    """
    printed, groups = _groups(docs, id_col, text_col, width, max_bits)
    return join_counted(printed, groups, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least.id").alias("component_id")
    )


def one_of_each(docs: DataFrame, rows: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each group: the one with the least id, none coming last, and, of rows that repeat it, the least hash of
    the text (groups.least). Of rows that repeat both, the least hash of all columns but maps stays. rows has id and content of each of docs."""
    counted = rows.groupBy(F.struct("id", "content").alias("_sl_key")).agg(F.count(F.lit(1)).alias("_sl_n"))
    stay = groups.select(F.struct("least.id", "least.content").alias("_sl_key")).distinct()
    stay = stored(counted.join(stay, "_sl_key"), "groups-stay")
    keyed = docs.withColumn("_sl_key", F.struct(F.col(id_col).alias("id"), content_of(F.col(text_col)).alias("content")))
    kept = join_counted(keyed, stay, "_sl_key", "_sl_n")
    # repeats are few rows or of few keys, which meet in tasks before they are shuffled
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    again = kept.where("_sl_n > 1").groupBy("_sl_key").agg(F.min_by(F.struct(*columns), order).alias("_sl_row")).select("_sl_row.*")
    return kept.where("_sl_n = 1").select(*columns).unionByName(again)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3) -> DataFrame:
    """docs with one row of each group of near_duplicate_groups, as one_of_each has it."""
    return one_of_each(docs, *_groups(docs, id_col, text_col, width, max_bits), id_col, text_col)
