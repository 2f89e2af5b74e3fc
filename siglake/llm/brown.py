"""Language-model scoring by Brown class-based bigrams.

P(word | before) = P(class | class before) * P(word | class). Over whole texts:

1. The counts of all words, as a table. The most frequent words are clustered; how many, and in
   how many classes, grows with the vocabulary (`sizes_for`).
2. Bigrams among them over all training documents; exchange clustering on the driver (bounded by
   the number of such words) moves words between classes while the mutual information of
   adjacent classes grows. Each class has a twin, its group, for other words (fewer groups, into
   which the classes are exchanged in the same way, can be asked for).
3. Texts become runs of word numbers, in blocks of bounded bytes: frequent words have one number
   everywhere, others a number in their block. Each block lists its other words with their
   training counts and the groups of their neighbours; the frequent ones never enter a shuffle.
   By word, these are summed over blocks, from sorted rows; a word goes to the group that its
   neighbours favour, one exchange step with the rest held fixed.
4. Each block meets the counts and classes of its own words and is turned into sums of
   logarithms and class transitions. Texts are cut into words once for 3 and 4.

What is left then is small: transitions and class sizes over all training documents give the
probabilities, which are applied to each document's transitions. Other words are known by 64-bit
hashes between passes.

Smoothing: a word of a class has (count - DISCOUNT) / class size; what is taken off is the
class's share of the one unknown word. Transitions are mixed with class shares by MIX. As in
the base score, all unknown words are one type.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import column_of, give_back, mapped, quoted, release, written

#: Bytes of text of a block; the most bigrams and words that a task holds before it hands them on or folds them.
BLOCK_BYTES, _HELD = 12 << 20, 250_000
DISCOUNT, MIX = 0.5, 20.0
#: Bigrams that the driver works on at once.
_PART = 500_000


def sizes_for(vocabulary: int) -> tuple[int, int]:
    """Frequent words that are clustered, and their classes: by the fourth root of the vocabulary, and by the square root of that."""
    frequent = max(600, round(32 * vocabulary**0.25))
    return frequent, max(40, round(1.4 * frequent**0.5))


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; the end is not among them."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 12) -> np.ndarray:
    """exchange_pairs of a matrix of counts."""
    a, b = np.nonzero(bigrams)
    return exchange_pairs(a, b, np.asarray(bigrams, dtype=float)[a, b], len(bigrams), classes, sweeps)


def exchange_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray, size: int, classes: int, sweeps: int = 12) -> np.ndarray:
    """Class of each of `size` words so that sum n(a,b) log n(a,b) over class pairs, less that of either side, is a local maximum.

    Words start by rank, in turn; they are visited in order and moved to the best class, the
    first of equals, until a sweep moves none. a, b, n: the bigrams that occur, in order of a, and
    their counts; beside them, four bytes each are held.
    """
    classes = max(1, min(classes, size))
    of = np.arange(size) % classes
    if size == 0 or classes == 1:
        return of
    right, left, own_counts = np.zeros((size, classes)), np.zeros((size, classes)), np.zeros(size)  # word x class: what follows it, what it follows
    for at in range(0, len(a), _PART):
        x, y, times = a[at : at + _PART].astype(np.int64), b[at : at + _PART].astype(np.int64), n[at : at + _PART]
        right += np.bincount(x * classes + of[y], weights=times, minlength=size * classes).reshape(size, classes)
        left += np.bincount(y * classes + of[x], weights=times, minlength=size * classes).reshape(size, classes)
        own_counts += np.bincount(x[x == y], weights=times[x == y], minlength=size)
    pairs = np.eye(classes)[of].T @ right
    by_b = np.argsort(b, kind="stable").astype(np.int32)
    ends_a = np.searchsorted(a, np.arange(size + 1))
    ends_b = np.concatenate([[0], np.cumsum(np.bincount(b, minlength=size))])
    h = lambda x: x * np.log(np.maximum(x, 1e-300))
    d = np.arange(classes)
    for _ in range(sweeps):
        moved = False
        for w in range(size):
            old, own = of[w], own_counts[w]
            pairs[old] -= right[w]
            pairs[:, old] -= left[w]
            pairs[old, old] += own
            r, c = right[w].copy(), left[w].copy()
            r[old] -= own
            c[old] -= own
            rows, columns, base = pairs.sum(1), pairs.sum(0), h(pairs)
            gain = (h(pairs + r) - base).sum(1) + (h(pairs + c[:, None]) - base).sum(0)
            gain += h(pairs[d, d] + r + c + own) - h(pairs[d, d] + r) - h(pairs[d, d] + c) + base[d, d]
            gain -= h(rows + c + r.sum() + own) - h(rows + c)
            gain -= h(columns + r + c.sum() + own) - h(columns + r)
            new = int(np.argmax(gain)) if gain.max() > gain[old] + 1e-9 else old
            pairs[new] += r
            pairs[:, new] += c
            pairs[new, new] += own
            if new != old:
                moved = True
                of[w] = new
                for table, at, other in ((right, by_b[ends_b[w] : ends_b[w + 1]], a), (left, slice(ends_a[w], ends_a[w + 1]), b)):
                    table[other[at], old] -= n[at]
                    table[other[at], new] += n[at]
        if not moved:
            break
    return of


class Classes:
    """Frequent words with counts and classes 0 to fine - 1; groups of other words follow, then the end, then the unknown word, then the start."""

    def __init__(self, words: list[bytes], counts: np.ndarray, of: np.ndarray, group_of_class: np.ndarray, follow: np.ndarray):
        self.ids = {w: i for i, w in enumerate(words)}
        self.counts, self.of = np.asarray(counts, dtype=np.int64), np.asarray(of, dtype=np.int64)
        self.groups = int(follow.shape[0])
        self.fine = int(self.of.max()) + 1 if len(self.of) else 0
        self.group_of_word = group_of_class[self.of] if len(self.of) else np.zeros(0, dtype=np.int64)
        self.follow = follow  # log P(group | neighbouring group)
        self.end, self.unknown, self.start = self.fine + self.groups, self.fine + self.groups + 1, self.fine + self.groups + 2
        self.width = self.start + 1


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of docs(text): counters of each task with all its words, handed on when large, and summed."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                held.update(tokens(t))
                if len(held) > _HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())}, columns=["word", "n"])
                    held = Counter()
        yield pd.DataFrame({"word": list(held), "n": list(held.values())}, columns=["word", "n"])

    return mapped(docs, counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> tuple[list[bytes], list[int]]:
    got = counts.orderBy(F.desc("n"), "word").limit(most).collect()
    return [bytes(r["word"]) for r in got], [r["n"] for r in got]


def _fold(keys: list, times: list) -> tuple[np.ndarray, np.ndarray]:
    kinds, back = np.unique(np.concatenate(keys), return_inverse=True)
    return kinds, np.bincount(back, weights=np.concatenate(times), minlength=len(kinds)).astype(np.int64)


def _bigrams(docs: DataFrame, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, next word, count) of the bigrams of frequent words over all training documents, in order."""
    ids, n = {w: i for i, w in enumerate(words)}, len(words)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, times = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for b in batches:
            for t in b["text"]:
                seq = np.array([ids.get(w, n) for w in tokens(t)], dtype=np.int64)
                both = np.flatnonzero((seq[:-1] < n) & (seq[1:] < n))
                keys.append(seq[both] * n + seq[both + 1])
                times.append(np.ones(len(both), dtype=np.int64))
            if sum(map(len, keys)) > 2 * _HELD:
                keys, times = ([x] for x in _fold(keys, times))
        at, sums = _fold(keys, times)
        yield pd.DataFrame({"pair": at, "n": sums})

    sums = mapped(docs, counted, "pair long, n long").groupBy("pair").agg(F.sum("n").cast("double").alias("n")).orderBy("pair")
    got = sums.select(F.floor(F.col("pair") / max(n, 1)).cast("int").alias("a"), (F.col("pair") % max(n, 1)).cast("int").alias("b"), "n").toArrow()  # frequent words squared at most, 16 bytes each
    return tuple(got.column(c).to_numpy() for c in ("a", "b", "n"))


def learn_classes(train: DataFrame, frequent: int | None = None, classes: int | None = None, groups: int | None = None, counts: DataFrame | None = None) -> Classes:
    """train(text) to classes of its frequent words and groups for the others; numbers that aren't named follow from the vocabulary."""
    counts = word_counts(train) if counts is None else counts
    if frequent is None or classes is None:
        wanted = sizes_for(counts.count())
        frequent, classes = frequent or wanted[0], classes or wanted[1]
    words, times = _frequent(counts, frequent)
    a, b, n = _bigrams(train, words)
    of = exchange_pairs(a, b, n, len(words), classes)
    fine = int(of.max()) + 1 if len(of) else 0
    between = np.zeros((fine, fine))
    for at in range(0, len(a), _PART):
        x, y = of[a[at : at + _PART]], of[b[at : at + _PART]]
        between += np.bincount(x * fine + y, weights=n[at : at + _PART], minlength=fine * fine).reshape(fine, fine)
    give_back()
    coarse = exchange(between, groups) if groups and groups < fine else np.arange(fine)
    k = int(coarse.max()) + 1 if len(coarse) else 1
    fold = np.eye(k)[coarse] if fine else np.zeros((0, k))
    near = fold.T @ (between + between.T) @ fold + 1.0 if fine else np.ones((1, 1))
    return Classes(words, np.array(times), of, coarse, np.log(near / near.sum(1, keepdims=True)))


#: A word's place is its block, then its number there in so many bits; a block is a task (20 bits) and a count.
_LOCAL = 29
BLOCKS = "place long, doc_id long, held_out boolean, seq binary, h long, near binary"


def _packed(seq: np.ndarray) -> bytes:
    """Word numbers below 2^30 in 15 bits, or twice 15 with a sign on the first."""
    large = seq >> 15 > 0
    at = np.cumsum(1 + large) - 1 - large
    out = np.zeros(len(seq) + int(large.sum()), dtype="<u2")
    out[at] = np.where(large, seq >> 15 | 0x8000, seq)
    out[at[large] + 1] = seq[large] & 0x7FFF
    return out.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, dtype="<u2").astype(np.int64)
    large = part >> 15 > 0
    first = np.concatenate([[True], ~large[:-1]])[: len(part)]
    after = np.append(part[1:], 0)
    return np.where(large, (part & 0x7FFF) << 15 | after, part)[first]


def _blocks(rows: DataFrame, model: Classes, block_bytes: int) -> DataFrame:
    """Of each block, its documents (seq, the word numbers) and its words that aren't frequent.

    A word has its place, its hash h and, in near as 32 bits each, its count in the block's training
    documents and the groups of its neighbours there (count << 16 | group, counts over 16 bits in
    parts). Numbers below the count of frequent words are theirs.
    """
    k, least = model.groups, len(model.ids)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def words_of(block: int, ids: dict, parts: list) -> pd.DataFrame:
        n = len(ids)
        names = [word_hash(w) for w, _ in zip(reversed(ids), range(n - least), strict=False)][::-1]
        group = np.full(n + 1, -1)
        group[:least] = held.value.group_of_word
        seq = np.concatenate([x for p in parts for x in (p, [n])]) if parts else np.zeros(0, dtype=np.int64)
        count = np.bincount(seq, minlength=n + 1)[least:n]
        keys, times = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for here, there in ((seq[1:], seq[:-1]), (seq[:-1], seq[1:])):
            g = group[there]
            ok = (g >= 0) & (here < n) & (here >= least)
            more, of = np.unique((here[ok] - least) * k + g[ok], return_counts=True)
            keys.append(more)
            times.append(of)
        key, total = _fold(keys, times)
        times = -(-total // 0xFFFF)
        key, part = np.repeat(key, times), np.full(int(times.sum()), 0xFFFF)
        part[np.cumsum(times) - 1] = total - (times - 1) * 0xFFFF
        ends = np.searchsorted(key, np.arange(n - least + 1) * k)
        packed = np.insert(part << 16 | key % k, ends[:-1], count).astype("<u4").tobytes()
        ends = (4 * (ends + np.arange(len(ends)))).tolist()
        near = [packed[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
        place = (block << _LOCAL) + np.arange(len(names))
        return pd.DataFrame({"place": place, "doc_id": pd.array([None] * len(names), dtype="Int64"), "held_out": None, "seq": None, "h": np.array(names, dtype=np.int64), "near": near})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, ids, parts, docs, size = TaskContext.get().partitionId() << 14, dict(held.value.ids), [], [], 0

        def done() -> Iterator[pd.DataFrame]:
            none = pd.array([None] * len(docs), dtype="Int64")
            seqs = [_packed(x) for _, _, x in docs]
            yield pd.DataFrame({"place": block << _LOCAL, "doc_id": pd.array([i for i, _, _ in docs], dtype="Int64"), "held_out": [o for _, o, _ in docs], "seq": seqs, "h": none, "near": None})
            yield words_of(block, ids, parts)

        for b in batches:
            for i, out, t in zip(b["doc_id"].astype("Int64"), b["held_out"], b["text"], strict=True):
                seq = np.array([ids.setdefault(w, len(ids)) for w in tokens(t)], dtype=np.int64)
                docs.append((None if i is pd.NA else i, bool(out), seq))
                size += len(t)
                if not out:
                    parts.append(seq)
                if size > block_bytes:
                    yield from done()
                    block, ids, parts, docs, size = block + 1, dict(held.value.ids), [], [], 0
        if docs:
            yield from done()

    return mapped(rows, cut, BLOCKS)


def _placed_words(found: DataFrame, model: Classes) -> DataFrame:
    """(place, is): words of blocks with their counts over all blocks, the groups that all their neighbours favour, and whether it is the word's first row: count << 20 | group << 1 | first."""
    k, follow = model.groups, model.follow

    def decided(rows: pd.DataFrame) -> pd.DataFrame:
        h = rows["h"].to_numpy()
        first = np.concatenate([[True], h[1:] != h[:-1]])
        word = np.cumsum(first) - 1
        packed = np.frombuffer(b"".join(rows["near"]), dtype="<u4").astype(np.int64)
        width = rows["near"].str.len().to_numpy(dtype=np.int64) // 4
        starts = np.cumsum(width) - width
        n = np.add.reduceat(packed[starts], np.flatnonzero(first))
        packed = np.delete(packed, starts)
        near = np.bincount(np.repeat(word, width - 1) * k + (packed & 0xFFFF), weights=packed >> 16, minlength=(word[-1] + 1) * k).reshape(-1, k)
        return pd.DataFrame({"place": rows["place"], "is": n[word] << 20 | (near @ follow).argmax(1)[word] << 1 | first})

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            rows = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if len(rows):
                whole = int(np.searchsorted(rows["h"].to_numpy(), rows["h"].iloc[-1]))
                if whole:
                    yield decided(rows.iloc[:whole])
                rest = rows.iloc[whole:]
        if rest is not None and len(rest):
            yield decided(rest)

    rows = found.select("place", "h", "near").repartition("h").sortWithinPartitions("h", "place")
    return mapped(rows, placed, "place long, is long")


def _block_sums(model: Classes):
    """For cogrouped documents and words of a block: each document's sums, and what the block's words add to the vocabulary."""

    def summed(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        at, known = words["place"].to_numpy(dtype=np.int64) & ((1 << _LOCAL) - 1), words["is"].to_numpy(dtype=np.int64)
        n, of = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        n[at], of[at] = known >> 20, known >> 1 & 0x7FFFF
        count = np.concatenate([model.counts, n]).astype(np.float64)
        kind = np.concatenate([model.of, np.where(n > 0, model.fine + of, model.unknown)])
        first = (known & 1 == 1) & (known >> 20 > 0)
        types = np.bincount(kind[len(model.of) + at[first]], minlength=model.width)
        base, emit = np.log10(count + 0.1), np.where(count > 0, np.log10(np.maximum(count, 1) - DISCOUNT), 0.0)
        rows = []
        for i, (doc_id, out, raw) in enumerate(zip(docs["doc_id"].astype("Int64"), docs["held_out"], docs["seq"], strict=True)):
            seq = _unpacked(raw)
            classes = np.concatenate([[model.start], kind[seq], [model.end]])
            pairs, times = np.unique(classes[:-1] * model.width + classes[1:], return_counts=True)
            rows.append((None if doc_id is pd.NA else doc_id, bool(out), len(seq) + 1, int((count[seq] > 0).sum()), float(base[seq].sum()), float(emit[seq].sum()), pairs.astype(np.int32), times.astype(np.int32), types.tolist() if i == 0 else None))
        give_back()
        return pd.DataFrame(rows, columns=["doc_id", "held_out", "n_tokens", "n_known", "base_sum", "emit_sum", "pairs", "times", "types"]).astype({"doc_id": "Int64"})

    return summed


SUMS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, emit_sum double, pairs array<int>, times array<int>, types array<long>"


def score_texts(docs: DataFrame, out_of_training: Column, *, key: str = "doc_id", text: str = "text", frequent: int | None = None, classes: int | None = None, groups: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document.

    Nulls: a null text is an empty one, just its end; ids are integers or null. Repeated rows are
    trained on and scored each. Very long texts are read whole; a block holds one at least. Words
    of one count are taken in byte order. Without training documents every word is unknown. An
    empty table gives an empty result. Other columns aren't returned.
    """
    rows = docs.select(F.col(quoted(key)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"), out_of_training.alias("held_out"))
    train = rows.where(~F.col("held_out")).select("text")
    counts = written(word_counts(train), "words")
    model = learn_classes(train, frequent, classes, groups, counts)
    release(counts)
    blocks = written(_blocks(rows, model, block_bytes), "blocks")
    placed = _placed_words(blocks.where("seq is null"), model)
    texts = blocks.where("seq is not null").select("place", "doc_id", "held_out", "seq")
    block = F.shiftright("place", _LOCAL)
    sums = texts.groupBy(block).cogroup(placed.groupBy(block)).applyInPandas(_block_sums(model), SUMS)
    sums = written(sums, "sums")

    def transitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, types = np.zeros(model.width**2, dtype=np.int64), np.zeros(model.width, dtype=np.int64)
        for b in batches:
            for out, pairs, times, own in zip(b["held_out"], b["pairs"], b["times"], b["types"], strict=True):
                if own is not None:
                    types += own
                if not out:
                    total[pairs] += times
        at, kinds = np.flatnonzero(total), np.flatnonzero(types)
        yield pd.DataFrame({"pair": np.concatenate([at, -1 - kinds]), "n": np.concatenate([total[at], types[kinds]])})

    got = mapped(sums.select("held_out", "pairs", "times", "types"), transitions, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # width squared rows at most
    table, types = np.zeros(model.width**2), np.zeros(model.width)
    pair, n = got["pair"].to_numpy(dtype=np.int64), got["n"].to_numpy(dtype=np.float64)
    table[pair[pair >= 0]] = n[pair >= 0]
    types[-1 - pair[pair < 0]] = n[pair < 0]
    types += np.bincount(model.of, minlength=model.width)
    table = table.reshape(model.width, model.width)
    size = table.sum(0)
    total, ends = float(size.sum()), float(size[model.end])
    vocabulary = float(types.sum()) + (ends > 0)
    base_rest, end_base = np.log10(total + 0.1 * (vocabulary + 1)), np.log10(ends + 0.1)
    logs = _log_transitions(model, table, size, types)

    kernel = lambda pairs, times: pd.Series([float(logs[p] @ t) for p, t in zip(pairs, times, strict=True)], dtype="float64")
    class_score = column_of(docs.sparkSession, kernel, "double")
    return sums.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_sum") + F.lit(float(end_base)) - F.col("n_tokens") * F.lit(float(base_rest))).alias("base_score"),
        (F.col("emit_sum") + class_score("pairs", "times")).alias("score"),
    )


def _log_transitions(model: Classes, table: np.ndarray, size: np.ndarray, types: np.ndarray) -> np.ndarray:
    """log10 of what a transition adds beside the words' own counts, by pair of classes."""
    total = max(float(size.sum()), 1.0)
    share = (size + 1e-3) / (size + 1e-3).sum()
    share[[model.start, model.unknown]] = 0.0
    share /= share.sum()
    rows = table.sum(1, keepdims=True)
    mixed = (table + MIX * share) / (rows + MIX)  # of classes, given the class before
    mixed[model.unknown] = share
    taken = np.minimum(DISCOUNT * types / np.maximum(size, 1.0), 1.0)  # of a class, for the unknown word
    unknown = np.maximum(mixed @ taken, 0.1 / (total + 1))
    out = np.log10(np.maximum(mixed, 1e-12)) - np.log10(np.maximum(size, 1.0))
    out[:, model.end] = np.log10(np.maximum(mixed[:, model.end], 1e-12))
    out[:, model.unknown] = np.log10(unknown)
    return out.reshape(-1)
