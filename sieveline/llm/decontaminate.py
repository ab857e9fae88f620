"""Documents that hold benchmark items: BM25 over an inverted index of the items, block-max WAND, then exact overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.tables import buckets_for, stored, with_position

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Ranges of items that have a maximum of their own for each term.
_RANGES = 64
_SHINGLE = 5


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """An item's words in two parts: up to its last question mark if words follow it, else all but its last sentence of
    three words or more, else the first three quarters. An item of fewer than four words is all question."""
    text = text or ""
    head, mark, tail = text.rpartition("?")
    if mark and words_of(tail) and words_of(head):
        return words_of(head), words_of(tail)
    sentences = [w for s in _SENTENCE.split(text) if (w := words_of(s))]
    if len(sentences) > 1 and len(sentences[-1]) >= 3:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = words_of(text)
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


def _in_order(part: list[str], passage: list[str]) -> int:
    """The most of part's words that a stretch of the passage, a quarter longer than part at most, has in the same order.
    Bit i of state is 0 where a longest common subsequence grows at part's word i."""
    places: dict[str, int] = {}
    for i, word in enumerate(part):
        places[word] = places.get(word, 0) | 1 << i
    at = [places.get(word, 0) for word in passage]
    full, length, best = (1 << len(part)) - 1, len(part) + max(1, len(part) // 4), 0
    for start in (i for i, here in enumerate(at) if here):
        stretch = [here for here in at[start : start + length] if here]
        if len(stretch) <= best:
            continue
        state = full
        for here in stretch:
            grown = state & here
            state = (state + grown | state - grown) & full
        best = max(best, len(part) - state.bit_count())
    return best


def overlap(part: list[str], passage: list[str]) -> float:
    """The share of part's words that lie in a run of five (or all, if fewer) which the passage has too, or, if that is
    more, that a stretch of the passage has in order, so that a changed word takes no other with it; 1 for no words."""
    if not part:
        return 1.0
    n = min(_SHINGLE, len(part))
    there = set(zip(*[passage[i:] for i in range(n)], strict=False))
    covered = np.zeros(len(part), bool)
    for i, run in enumerate(zip(*[part[i:] for i in range(n)], strict=False)):
        if run in there:
            covered[i : i + n] = True
    return 1.0 if covered.all() else max(int(covered.sum()), _in_order(part, passage)) / len(part)


@dataclass(frozen=True)
class ItemIndex:
    """Postings in arrays: term t has items[start[t]:start[t + 1]], ascending, with their weights. An item's weights are
    BM25's over its own score, so that a query's sum is the share of the item's score that it reaches. most has each
    term's largest weight in each range of items."""

    terms: dict[str, int]
    start: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    most: np.ndarray  # terms x ranges, and a row of zeros for words that no item has
    width: int  # items in a range
    ids: list
    parts: list[tuple[list[str], list[str]]]
    longest: int

    def search(self, query: np.ndarray, least: float) -> list[tuple[int, float]]:
        """All items whose score for the query's terms (distinct) is least or more, by block-max WAND: ranges whose
        maxima add up to less are skipped; in the others, lists are moved on to the pivot, the first item at which the
        maxima of the lists that may hold it reach the bound, and only pivots are scored."""
        found = []
        slack = least - 1e-9
        for block in np.flatnonzero(self.most[query].sum(axis=0, dtype=np.float64) >= slack):
            low, high = block * self.width, (block + 1) * self.width
            cursors = []  # [item, place, end, bound]
            for t in query:
                bound = float(self.most[t, block])
                if bound > 0:
                    a, b = self.start[t], self.start[t + 1]
                    place = int(a + np.searchsorted(self.items[a:b], low))
                    if place < b and self.items[place] < high:
                        cursors.append([int(self.items[place]), place, int(b), bound])
            while cursors:
                cursors.sort()
                reach, pivot = 0.0, None
                for item, _, _, bound in cursors:
                    reach += bound
                    if reach >= slack:
                        pivot = item
                        break
                if pivot is None:
                    break
                if cursors[0][0] == pivot:
                    score = sum(float(self.weights[c[1]]) for c in cursors if c[0] == pivot)
                    if score >= slack:
                        found.append((pivot, score))
                    target = pivot + 1
                else:
                    target = pivot
                moved = []
                for c in cursors:
                    if c[0] < target:
                        c[1] += int(np.searchsorted(self.items[c[1] : c[2]], target))
                        if c[1] >= c[2] or self.items[c[1]] >= high:
                            continue
                        c[0] = int(self.items[c[1]])
                    moved.append(c)
                cursors = moved
        return found

    def matches(self, text: str | None, least: float, covered: float) -> dict[int, tuple[float, float, float]]:
        """Items (by place) in a text: the best score of a passage, with the overlaps of question and answer there.
        Passages are twice the longest item, each half over the next, so an item lies whole in one of them."""
        words = words_of(text)
        if not words:
            return {}
        get, none = self.terms.get, len(self.most) - 1
        ids = np.array([get(w, none) for w in words])
        stride = max(1, self.longest)
        kept: dict[int, tuple[float, float, float]] = {}
        for at in range(0, max(1, len(words) - stride), stride):
            query = np.unique(ids[at : at + 2 * stride])
            if query[-1] == none:
                query = query[:-1]
            if not len(query) or self.most[query].sum(axis=0).max() < least - 1e-4:
                continue
            for item, score in self.search(query, least):
                passage = words[at : at + 2 * stride]
                question, answer = (overlap(p, passage) for p in self.parts[item])
                if question >= covered and answer >= covered:
                    kept[item] = max(kept.get(item, (0.0, 0.0, 0.0)), (min(score, 1.0), question, answer))
        return kept


def _postings(items: DataFrame, k1: float, b: float) -> DataFrame:
    """(item, term, weight): statistics are over all items."""
    counted = items.select("item", F.explode("words").alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("tf"))
    lengths = items.select("item", F.size("words").alias("length"))
    whole = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    df = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    bm25 = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1)
    bm25 = bm25 / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    own = Window.partitionBy("item")
    scored = counted.join(df, "term").join(lengths, "item").crossJoin(F.broadcast(whole)).withColumn("bm25", bm25)  # one row
    return scored.select("item", "term", (F.col("bm25") / F.sum("bm25").over(own)).alias("weight"))


def item_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75, most: int = 500_000) -> Iterator[ItemIndex]:
    """Indexes over all items with a word, each of about most postings (or of one item), so that what is collected and
    broadcast at once is bounded however many items there are. Weights are the same as in one index over all. Items are
    numbered by a hash of id and text: neither goes through the numbering."""

    def with_words(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([words_of(t) for t in texts], pa.list_(pa.string()))], ["id", "text", "words"])

    kind = benchmark.schema[id_col].dataType.simpleString()
    worded = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(with_words, f"id {kind}, text string, words array<string>")
    own = worded.where(F.size("words") > 0).withColumn("item", F.xxhash64("id", F.col("id").isNull(), "text")).dropDuplicates(["item"])
    items = stored(own.withColumn("postings", F.size(F.array_distinct("words"))), "items")
    n, postings = items.agg(F.count(F.lit(1)), F.sum("postings")).first()
    parts = -(-(postings or 0) // most)
    dealt = items.select("item", F.pmod(F.xxhash64(F.lit(1), "item"), F.lit(max(1, parts))).cast("int").alias("part"))
    placed = stored(with_position(dealt, "place", ["part"], F.col("item"), ["item"], buckets_for(n)), "items-placed")
    weights = stored(_postings(items, k1, b), "postings")
    for part in range(parts):
        held = placed.where(F.col("part") == part).select("item", "place")
        rows = items.join(held, "item").select("place", "id", "text").orderBy("place").collect()
        if rows:
            post = weights.join(held, "item").select("term", F.col("place").alias("item"), "weight").toArrow()
            yield _index(post, [r["id"] for r in rows], [r["text"] for r in rows])


def _index(postings: pa.Table, ids: list, texts: list[str]) -> ItemIndex:
    names, term = np.unique(np.array(postings["term"].to_pylist(), object).astype(str), return_inverse=True)
    item, weight = postings["item"].to_numpy().astype(np.int64), postings["weight"].to_numpy()
    order = np.lexsort((item, term))
    term, item, weight = term[order], item[order], weight[order]
    start = np.searchsorted(term, np.arange(len(names) + 1))
    width = -(-len(ids) // _RANGES)
    most = np.zeros((len(names) + 1, -(-len(ids) // width)), np.float32)
    np.maximum.at(most, (term, item // width), np.nextafter(weight.astype(np.float32), np.float32(2)))
    longest = max(len(words_of(t)) for t in texts)
    return ItemIndex({t: i for i, t in enumerate(names.tolist())}, start, item, weight, most, width, ids, [question_and_answer(t) for t in texts], longest)


def _hits(index, least: float, covered: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc, own.ids[i], *x) for i, x in own.matches(text, least, covered).items()]
            names = ["doc", "item", "score", "question_overlap", "answer_overlap"]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [batch.schema.field(0).type, None, pa.float64(), pa.float64(), pa.float64()]
            types[1] = pa.int64() if not own.ids or isinstance(own.ids[0], int | None) else pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", least: float = 0.6, covered: float = 0.6,
) -> DataFrame:
    """(id, item, score, question_overlap, answer_overlap), once for each document and item that it holds: a passage
    reaches `least` of the item's own BM25 score, and `covered` of the words of its question and of its answer lie in
    runs of five words that the passage has, or in order in a stretch of it (see overlap).

    Words are runs of letters and digits, in lower case. Null and empty texts hold nothing, null and empty items are held
    by nothing. Rows that repeat a document's id count as one document, items that repeat an id as one item; null ids
    are kept as null. Other columns are ignored. Empty tables give no rows.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kinds = [docs.schema[id_col].dataType.simpleString(), "long" if benchmark.schema[item_col].dataType.typeName() in ("long", "integer", "short", "byte") else "string"]
    schema = f"doc {kinds[0]}, item {kinds[1]}, score double, question_overlap double, answer_overlap double"
    tests = benchmark.withColumn(item_col, F.col(item_col).cast(kinds[1]))
    found = spark.createDataFrame([], schema)
    for index in item_indexes(tests, item_col, item_text_col):
        found = found.unionByName(narrow.mapInArrow(_hits(spark.sparkContext.broadcast(index), least, covered), schema))
    best = found.groupBy("doc", "item").agg(F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "best.*")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    least: float = 0.6, covered: float = 0.6,
) -> DataFrame:
    """docs without the rows that hold an item; rows pass through their scan's tasks, nothing of them is shuffled."""
    at, schema = docs.columns.index(text_col), docs.schema
    for index in item_indexes(benchmark, item_col, item_text_col):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not held.value.matches(t.as_py(), least, covered) for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
