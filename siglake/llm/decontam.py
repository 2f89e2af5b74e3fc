"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts are cut into lower-cased words without ASCII punctuation. The n-grams of the test items
are counted over all documents; an item's seeds are those that are rare for it (in no more
documents than twice the item's median n-gram, or in RARE at most), so that an item that many
documents copy keeps its seeds. Where a document holds a seed, the words around it, by the
seed's diagonal, are aligned with the item: +2 for a match, -1 for a mismatch, -1 for a gap.
The other n-grams, which many edited copies may hold, lead to an alignment too, unless too few
words of the item are near for the score to be reached: that bound loses nothing.
The score is the best local alignment over that of the item with itself: 1 for a copy, less
for one that is edited or cut. The words around a seed reach as far as an alignment of the
asked score can: with a score from half on, a copy holds no more foreign words than the item
has words.

The test items are taken in blocks of bounded bytes, one after the other, each sent to all
executors and given up before the next; however large the benchmark, every block meets all
documents. Items of fewer words than a seed are found as whole word sequences, and apart
(`find_short_items`): two words alone can't be told from chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import column_of, mapped, quoted, text_bytes, written

#: Words of a seed, score from which a passage leaks, documents in which a seed is always rare, bytes of items in a block.
GRAM, LEAK, RARE, BLOCK_BYTES = 3, 0.5, 20, 4 << 20
_PUNCTUATION = bytes(32 if (c < 128 and not chr(c).isalnum()) else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
FOUND = "doc_id string, item_id long, score double, first_word int, last_word int"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split()


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of word numbers; 0 where a word has none."""
    size = len(ids) - n + 1
    if size < 1:
        return np.zeros(0, dtype=np.uint64)
    out, known = np.zeros(size, dtype=np.uint64), np.ones(size, dtype=bool)
    for j in range(n):
        part = ids[j : j + size]
        out = (out ^ part.astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
        known &= part > 0
    return np.where(known, out | np.uint64(1), np.uint64(0))


def _ranges(first: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the range and place, for all places of ranges."""
    of = np.repeat(np.arange(len(first)), width)
    return of, np.arange(len(of)) - (np.cumsum(width) - width - first)[of]


def _hits(at: np.ndarray, grams: np.ndarray, keys: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items that the n-grams at words belong to, and the words where they would begin."""
    low, high = np.searchsorted(keys, grams, "left"), np.searchsorted(keys, grams, "right")
    hit = np.flatnonzero(high > low)
    of, entry = _ranges(low[hit], high[hit] - low[hit])
    return owner[entry], at[hit][of] - place[entry]


class Items:
    """A block of test items with the n-grams to look for; items of fewer words than a seed aren't among them."""

    def __init__(self, items: list[tuple[int | None, str]], gram: int = GRAM):
        self.gram, self.vocabulary, self.items, grams = gram, {}, [], []
        for item_id, text in items:
            words = words_of(text)
            if len(words) >= gram:
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int64)
                grams.append(_grams(ids, gram))
                self.items.append((item_id, ids))
        keys = np.concatenate(grams or [np.zeros(0, dtype=np.uint64)])
        width = np.array([len(g) for g in grams], dtype=np.int64)
        owner, place = _ranges(np.zeros(len(grams), dtype=np.int64), width)
        order = np.lexsort((place, owner, keys))
        self.keys, self.owner, self.place = keys[order], owner[order], place[order]
        self.common = self.keys[:0], self.owner[:0], self.place[:0]
        bags = [np.unique(ids, return_counts=True) for _, ids in self.items]
        self.size = np.array([len(ids) for _, ids in self.items], dtype=np.int64)
        self.bag = np.concatenate([[0], np.cumsum([len(w) for w, _ in bags], dtype=np.int64)])
        self.bag_word = np.concatenate([w for w, _ in bags] or [np.zeros(0, dtype=np.int64)])
        self.bag_times = np.concatenate([n for _, n in bags] or [np.zeros(0, dtype=np.int64)])

    def ids(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words_of(text)], dtype=np.int64)

    def seen(self, text: str | None) -> np.ndarray:
        """The distinct n-grams of items that a text has."""
        if not len(self.keys):
            return np.zeros(0, dtype=np.uint64)
        g = np.unique(_grams(self.ids(text), self.gram))
        return g[self.keys[np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)] == g]

    def keep_rare(self, documents: dict[int, int], rare: int = RARE) -> None:
        if not len(self.keys):
            return
        counts = np.array([documents.get(int(k), 0) for k in self.keys])
        ranked = counts[np.lexsort((counts, self.owner))]
        size = np.bincount(self.owner, minlength=len(self.items))
        first = np.cumsum(size) - size
        median = (ranked[first + (size - 1) // 2] + ranked[first + size // 2]) / 2
        keep = counts <= np.maximum(rare, 2 * median)[self.owner]
        self.common = self.keys[~keep], self.owner[~keep], self.place[~keep]
        self.keys, self.owner, self.place = self.keys[keep], self.owner[keep], self.place[keep]

    def possible(self, items: np.ndarray, ids: np.ndarray, leak: float) -> np.ndarray:
        """Whether words have enough of an item's words to reach leak: a match scores 2 of 2 for each word of the item, all else less than 0."""
        known, times = np.unique(ids[ids > 0], return_counts=True)
        width = self.bag[items + 1] - self.bag[items]
        of, entry = _ranges(self.bag[items], width)
        at = np.minimum(np.searchsorted(known, self.bag_word[entry]), len(known) - 1)
        shared = np.where(known[at] == self.bag_word[entry], np.minimum(times[at], self.bag_times[entry]), 0)
        return np.bincount(of, weights=shared, minlength=len(items)) >= leak * self.size[items] - 1e-9

    def find(self, text: str | None, leak: float) -> list[tuple[int | None, float, int, int]]:
        """(item, score, first word, last word) of the best alignment with each item that reaches leak."""
        if not len(self.keys) and not len(self.common[0]):
            return []
        ids = self.ids(text)
        g = _grams(ids, self.gram)
        at = np.flatnonzero(g)
        (owner, start), (other, begin) = (_hits(at, g[at], *x) for x in ((self.keys, self.owner, self.place), self.common))
        if len(other):
            items = np.unique(other)
            fits = np.isin(items, owner)
            fits[~fits] = self.possible(items[~fits], ids, leak)
            kept = fits[np.searchsorted(items, other)]
            owner, start, rare = np.concatenate([owner, other[kept]]), np.concatenate([start, begin[kept]]), np.arange(len(owner) + kept.sum()) < len(owner)
        else:
            rare = np.ones(len(owner), dtype=bool)
        out = []
        for i in np.unique(owner):
            item_id, item = self.items[i]
            slack = max(4, math.ceil(2 * len(item) * (1 - leak)))  # foreign words that an alignment of this score can hold
            starts = np.unique(start[owner == i])
            sure = np.unique(start[(owner == i) & rare])
            best = (0.0, 0, 0)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > slack) + 1):
                a, b = max(0, int(run[0]) - slack), min(len(ids), int(run[-1]) + len(item) + slack)
                if np.searchsorted(sure, run[0]) == np.searchsorted(sure, run[-1], "right") and not self.possible(np.array([i]), ids[a:b], leak)[0]:
                    continue
                score, last = align(item, ids[a:b])
                if score / (2 * len(item)) > best[0]:
                    back, first = align(item[::-1], ids[a : a + last + 1][::-1])
                    best = (score / (2 * len(item)), a + last - first, a + last)
            if best[0] >= leak:
                out.append((item_id, float(best[0]), int(best[1]), int(best[2])))
        return out


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment: its score, and the passage's word that it ends with."""
    places = np.arange(len(passage))
    row, best, last = np.zeros(len(passage) + 1, dtype=np.int64), 0, 0
    for word in item:
        reach = np.maximum(row[:-1] + np.where(passage == word, 2, -1), row[1:] - 1)
        np.maximum(reach, 0, out=reach)
        row[1:] = np.maximum.accumulate(reach + places) - places
        top = int(row.argmax())
        if row[top] > best:
            best, last = int(row[top]), top - 1
    return best, last


def item_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """The test items in blocks of about block_bytes; a null text is no item, a null id is an id like any other."""
    rows = benchmark.select(F.col(quoted(item)).cast("long").alias("item_id"), F.col(quoted(text)).alias("text")).where("text is not null")
    total = rows.agg(F.sum(text_bytes(F.col("text")) + 16)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for b in range(blocks):
        yield [(r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).sort("item_id", "text").collect()]


def seeded_blocks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", gram: int = GRAM, rare: int = RARE, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple]:
    """For each block of items, a broadcast of them with their rare n-grams, counted over all documents, and whether it is the last."""
    context = docs.sparkSession.sparkContext
    waiting: Items | None = None
    for block in item_blocks(benchmark, item, item_text, block_bytes):
        if waiting is not None:
            yield context.broadcast(waiting), False
        waiting = Items(block, gram)
        held = context.broadcast(waiting)

        def counted(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            total: dict[int, int] = {}
            for b in batches:
                for body in b["text"]:
                    for k in held.value.seen(body).tolist():
                        total[k] = total.get(k, 0) + 1
            yield pd.DataFrame({"gram": np.array(list(total), dtype=np.uint64).view(np.int64), "n": list(total.values())}, columns=["gram", "n"])

        counts = mapped(docs.select(F.col(quoted(text)).alias("text")), counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # a row for each n-gram of the block
        held.destroy()
        waiting.keep_rare(dict(zip(counts["gram"].to_numpy(dtype=np.int64).view(np.uint64).tolist(), counts["n"].tolist(), strict=True)), rare)
    if waiting is not None:
        yield context.broadcast(waiting), True


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", leak: float = LEAK, **options) -> DataFrame:
    """A row for each document and item whose alignment reaches `leak`: doc_id, item_id, score, first_word, last_word.

    Of several alignments with one score, the first in the text is given. Nulls: a null text, of a
    document or an item, leaks nothing; null ids on either side are kept. Repeated documents are
    reported each; items with one text are reported each. Very long texts are searched whole. An
    empty table on either side gives an empty result. Other columns of docs, of any name, aren't
    returned. Items of under `gram` words: see find_short_items.
    """
    rows = docs.select(F.col(quoted(key)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"))
    out = None
    for held, last in seeded_blocks(docs, benchmark, text=text, **options):

        def found(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for b in batches:
                got = [(i, *x) for i, t in zip(b["doc_id"], b["text"], strict=True) for x in held.value.find(t, leak)]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "score", "first_word", "last_word"]).astype({"item_id": "Int64"})

        part = mapped(rows.withColumn("doc_id", F.col("doc_id").cast("string")), found, FOUND).withColumn("doc_id", F.col("doc_id").cast("long"))
        if not last:
            part = written(part, "leaks")
            held.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", leak: float = LEAK, **options) -> DataFrame:
    """The rows of docs that leak no test item, with their columns as they were, whatever their names.

    A null or empty text leaks nothing; repeated rows stand or fall together; an empty table stays
    empty, an empty benchmark leaves all. Seeds are rare among the rows that are left.
    """
    for held, last in seeded_blocks(docs, benchmark, text=text, **options):
        kernel = lambda texts, held=held: pd.Series([not held.value.find(t, leak) for t in texts], dtype=bool)
        docs = docs.where(column_of(docs.sparkSession, kernel, "boolean")(F.col(quoted(text))))
        if not last:
            docs = written(docs, "clean")
            held.destroy()
    return docs


def find_short_items(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", gram: int = GRAM) -> DataFrame:
    """doc_id, item_id, first_word: where a document holds the word sequence of an item of under `gram` words, the first place each.

    Items without words and null texts match nothing; null ids are kept; repeated rows are
    reported each; empty tables give an empty result. Word sequences meet by a join of their
    hashes, so neither side is gathered.
    """
    both = []
    for rows, of, body in ((docs, key, text), (benchmark, item, item_text)):

        def cut(batches: Iterator[pd.DataFrame], whole=rows is benchmark) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for i, t in zip(b["id"], b["text"], strict=True):
                    words, seen = words_of(t), set()
                    for n in ([len(words)] if whole else range(1, gram)):
                        for at in range(len(words) - n + 1 if 0 < n < gram else 0):
                            sequence = b" ".join(words[at : at + n])
                            if sequence not in seen:
                                seen.add(sequence)
                                out.append((i, sequence, at))
                yield pd.DataFrame(out, columns=["id", "words", "at"])

        both.append(mapped(rows.select(F.col(quoted(of)).cast("string").alias("id"), F.col(quoted(body)).alias("text")).where("text is not null"), cut, "id string, words binary, at int"))
    items = both[1].select(F.col("id").cast("long").alias("item_id"), F.col("words").alias("asked"))
    return both[0].join(items, F.col("words") == F.col("asked")).select(F.col("id").cast("long").alias("doc_id"), "item_id", F.col("at").alias("first_word"))
