"""N-gram Jaccard join by a token-group matrix.

A document's tokens are hashes of its distinct word n-grams. The join finds every link (pair
with Jaccard similarity from the threshold on) that connects documents not yet connected:

1. Signatures. Tokens are dealt by hash into parts, more than a linked pair can differ in
   tokens; so a linked pair has a part in which both have the same tokens, and that part's
   tokens, hashed with the part and the level of size, are a signature that both have.
   Tokens that very many documents have (found on a sample; any set of them gives whole
   results) stay out of the parts as long as a document has enough others. In sets of few
   tokens parts would often be empty: there (and at low thresholds) the first tokens of the
   set, the rarest first, are the signatures, so many that a linked pair shares one.
2. Groups. Rows (signature, document) are sorted by signature and streamed: the least document
   of a signature is the group that the others join. Similar documents so meet in groups, each
   pair that shares a signature in at least one. A group of thousands is dealt into blocks of
   bounded documents and tokens.
3. Token-group matrix. In a group (or two blocks), documents are taken by size and collected in
   subgroups of linked documents. For each subgroup the matrix holds the union of its tokens. A
   document's overlap with a union bounds its overlap with every member; only subgroups whose
   bound reaches the overlap that a link needs are opened, and their members compared exactly.
4. Components. First each document meets one group only, in its block and with the first block
   of the group: that is linear in the group. The components found there mostly join whole
   groups. Only groups that still hold several components are joined in full, and there the
   documents of the largest component needn't meet each other.

Equal sets are one document from the start, known by a 64-bit hash of the set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siglake.llm.common import give_back, hashable, mapped, pack, quoted, release, unpack, written
from siglake.llm.components import connected_components

#: Growth of size levels; documents and tokens of a block; parts of a hot group's key; share of documents sampled for common tokens, how often they must be seen there, how many are kept.
LEVEL, SPLIT, SPLIT_TOKENS, SALTS = 1.5, 400, 500_000, 16
COMMON_RATE, COMMON_SEEN, COMMON_KEPT = 128, 6, 200_000
#: Sets up to so many tokens are signed by their first tokens; all sets are, below this threshold.
SHORT, LOW = 48, 0.75
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Words to 64-bit hashes, filled as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Distinct word n-grams of texts as sorted hashes. A text of fewer words is one n-gram, one without words has none."""

    def __init__(self, n: int):
        self.n, self.cache = n, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(self.cache) > 100_000:
            self.cache.clear()
        h = np.fromiter(map(self.cache.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self.n, len(h))
        out = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            out = _mix(out ^ h[j : j + len(out)]) + np.uint64(j)
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def set_hash(tokens: np.ndarray) -> int:
    """One number for a set of tokens; 0 for the empty set."""
    if not len(tokens):
        return 0
    total = _mix(tokens).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(tokens))
    return int(_mix(total).view(np.int64)[0])


class Signer:
    """Signatures of a set of tokens, for links from num / den on. common: sorted tokens; often: how often they were seen."""

    def __init__(self, num: int, den: int, common: np.ndarray, often: np.ndarray | None = None):
        if not 0 < num <= den:
            raise ValueError("the threshold num / den must be above 0 and at most 1")
        self.num, self.den, self.common = num, den, common
        self.often = np.ones(len(common), dtype=np.int64) if often is None else often
        self.short = SHORT if num >= LOW * den else 1 << 40
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * LEVEL)))

    def levels(self, size: int) -> range:
        """The levels in which the smaller set of a linked pair with a set of this size can be, if this one is the larger; and its own."""
        least = -(-size * self.num // self.den)
        low, own = (int(x) - 1 for x in np.searchsorted(self.edges, [least, size], "right"))
        return range(low, own + 1)

    def differ(self, level: int) -> int:
        """Most tokens that a linked pair whose smaller set is of this level can differ in."""
        smaller = self.edges[level + 1] - 1
        union = smaller * self.den // self.num
        return union * (self.den - self.num) // self.den

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        often = np.zeros(len(tokens), dtype=np.int64)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, tokens), len(self.common) - 1)
            often = np.where(self.common[at] == tokens, self.often[at], 0)
        out = []
        if len(tokens) * self.num <= self.short * self.den:  # a partner can be short
            out.append(self._first(tokens, often))
        if len(tokens) > self.short:
            out += [x for level in self.levels(len(tokens)) for x in self._of_level(tokens, often == 0, level)]
        return np.concatenate(out)

    def _first(self, tokens: np.ndarray, often: np.ndarray) -> np.ndarray:
        """The first tokens in one order of all tokens, the rarest first: a linked pair has one of them in common."""
        count = len(tokens) - -(-len(tokens) * self.num // self.den) + 1
        return _mix(tokens[np.lexsort((tokens, often))[:count]] + np.uint64(11)) | np.uint64(1)

    def _of_level(self, tokens: np.ndarray, uncommon: np.ndarray, level: int) -> list[np.ndarray]:
        need = self.differ(level) + 1
        parts = max(1, need + need // (2 if self.edges[level] < 1000 else 4))
        rare = self._parts(tokens[uncommon], level, parts, 0)
        out = [rare[rare > 0]]
        if np.count_nonzero(rare) < need:  # the rare tokens alone don't warrant a shared part
            rest = self._parts(tokens, level, parts, 1)
            filled = np.count_nonzero(rest)
            out.append(rest[rest > 0])
            if filled < need:  # nor do the filled parts (a chance of under one in a thousand): the empty ones count too
                empty = np.flatnonzero(rest == 0).astype(np.uint64)
                out.append(_mix(_mix(empty + np.uint64(parts)) ^ np.uint64(level * 4 + 2)) | np.uint64(1))
        return out

    def _parts(self, tokens: np.ndarray, level: int, parts: int, kind: int) -> np.ndarray:
        sums = np.zeros(parts, dtype=np.uint64)
        if len(tokens):
            t = _mix(tokens ^ np.uint64(level + 1))
            part = (t % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            t, part = _mix(t[order] + np.uint64(7)), part[order]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            which = part[first]
            sums[which] = _mix(np.add.reduceat(t, first) ^ _mix(which.astype(np.uint64) + np.uint64(parts << 20)) ^ np.uint64(level * 4 + kind)) | np.uint64(1)
        return sums


def matrix_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, num: int, den: int, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect a group's documents, by the token-group matrix.

    side: blocks of the documents; documents of one block only meet if all are of it (two blocks
    meet here for what is across, each block by itself for what is within). joined: components
    that are known already. Returned are pairs of ids, enough to connect all that is linked.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    tokens = np.concatenate(sets) if n else np.zeros(0, dtype=np.uint64)
    kinds, number, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[number]
    ends = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(n), sizes)[keep], minlength=n))])
    cells = column[number[keep]]  # the columns of each document, one after the other
    columns = int(shared.sum())
    unions = np.zeros((columns, 1), dtype=np.uint8)  # of a column, a bit for each subgroup
    marked = np.zeros(columns, dtype=bool)
    whole = len(np.unique(side)) < 2
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if joined is not None:
        first: dict[int, int] = {}
        for i in range(n):
            root[i] = first.setdefault(int(joined[i]), i)
    groups: list[list[int]] = []
    out = []
    for q in np.lexsort((ids, sizes)).tolist():
        own = cells[ends[q] : ends[q + 1]]
        need = -(-int(sizes[q]) * num // den)
        opened: list[int] = []
        if groups and len(own) >= need:
            overlap = np.unpackbits(unions[own], axis=1, bitorder="little").sum(0, dtype=np.int64)
            opened = np.flatnonzero(overlap[: len(groups)] >= need).tolist()
        marked[own] = True
        home = None
        for g in opened:
            mine = find(q)
            others = [m for m in groups[g] if find(m) != mine]
            if home is None and len(others) < len(groups[g]):
                home = g
            members = np.array([m for m in others if whole or side[m] != side[q]], dtype=np.int64)
            if not len(members):
                continue
            width = ends[members + 1] - ends[members]
            at = np.repeat(ends[members] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
            both = np.bincount(np.repeat(np.arange(len(members)), width), weights=marked[cells[at]], minlength=len(members)).astype(np.int64)
            linked = members[den * both >= num * (sizes[members] + sizes[q] - both)].tolist()
            for m in linked:
                if find(m) != find(q):
                    out.append((int(ids[q]), int(ids[m])))
                    root[find(q)] = find(m)
            if linked and home is None:
                home = g
        marked[own] = False
        if home is None:
            home = len(groups)
            groups.append([])
            if home >> 3 == unions.shape[1]:
                unions = np.concatenate([unions, np.zeros_like(unions)], axis=1)
        groups[home].append(q)
        unions[own, home >> 3] |= np.uint8(1 << (home & 7))
    return out


def _common_tokens(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that many documents have and how often they were seen, from a sample drawn by a hash of the text; they only decide which tokens make signatures."""
    sample = docs.where(F.pmod(F.xxhash64("t", "doc_id"), F.lit(COMMON_RATE)) == 0).select("text").distinct()

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(n)
        for b in batches:
            found = [shingle(t) for t in b["text"]]
            kinds, times = np.unique(np.concatenate(found), return_counts=True)
            yield pd.DataFrame({"t": kinds.view(np.int64), "n": times})

    seen = mapped(sample, distinct, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_SEEN)
    got = seen.orderBy(F.desc("n"), "t").limit(COMMON_KEPT).toPandas()
    tokens, often = got["t"].to_numpy(dtype=np.int64).view(np.uint64), got["n"].to_numpy(dtype=np.int64)
    order = np.argsort(tokens)
    return tokens[order], often[order]


def _signed(docs: DataFrame, n: int, signer: Signer) -> DataFrame:
    """docs(doc_id, t, text) to doc_id, t, n_shingles, h (of the set) and keys, the signatures; in a task, equal sets have keys once."""
    held = docs.sparkSession.sparkContext.broadcast(signer)

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, seen = Shingler(n), set()
        for b in batches:
            sizes, hashes, keys = [], [], []
            for text in b["text"]:
                tokens = shingle(text)
                h = set_hash(tokens)
                sizes.append(len(tokens))
                hashes.append(h)
                keys.append(None if not len(tokens) or h in seen else held.value(tokens).view(np.int64))
                seen.add(h)
            if len(seen) > 200_000:
                seen.clear()
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "t": b["t"], "n_shingles": sizes, "h": hashes, "keys": keys})

    return mapped(docs.select("doc_id", "t", "text"), signed, "doc_id long, t long, n_shingles long, h long, keys array<long>")


def _groups(signed: DataFrame, parts: int) -> DataFrame:
    """(center, h): documents by set hash in the groups that their signatures make; the center is a member."""

    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, center = None, None
        held_pairs: list[np.ndarray] = []
        count = 0
        for b in batches:
            k, h = b["key"].to_numpy(), b["h"].to_numpy()
            fresh = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
            at = np.maximum.accumulate(np.where(fresh, np.arange(len(k)), -1))
            centers = np.where(at >= 0, h[at], center if center is not None else 0)
            key, center = k[-1], centers[-1]
            other = centers != h
            if other.any():
                held_pairs.append(np.unique(np.stack([centers[other], h[other]]), axis=1))
                count += held_pairs[-1].shape[1]
            if count > 200_000:
                pairs = np.unique(np.concatenate(held_pairs, axis=1), axis=1)
                yield pd.DataFrame({"center": pairs[0], "h": pairs[1]})
                held_pairs, count = [], 0
        if held_pairs:
            pairs = np.unique(np.concatenate(held_pairs, axis=1), axis=1)
            yield pd.DataFrame({"center": pairs[0], "h": pairs[1]})

    rows = signed.select(F.explode("keys").alias("key"), "h").repartition(parts, "key").sortWithinPartitions("key", "h")
    return mapped(rows, streamed, "center long, h long").distinct()


def _blocks(documents: str, tokens: str):
    return F.greatest(F.ceil(F.expr(documents) / SPLIT), F.ceil(F.expr(tokens) / SPLIT_TOKENS), F.lit(1)).cast("int")


def _with(members: DataFrame, by_center: DataFrame, how: str) -> DataFrame:
    """members beside the row of their group; a group's members are dealt over SALTS tasks."""
    spread = by_center.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int")).join(spread, ["center", "salt"], how)


def _own(blocks: str):
    return F.pmod(F.xxhash64("h", F.lit(1)), F.col(blocks).cast("long")).cast("int")


def _pair(i, j):
    return F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j"))


def _dealt_first(members: DataFrame) -> DataFrame:
    """members(center, h, n) with own (block) and m (the pair of blocks): each block by itself and with the first."""
    large = members.groupBy("center").agg(F.count(F.lit(1)).alias("of"), F.sum("n").alias("tokens")).withColumn("blocks", _blocks("of", "tokens")).where("blocks > 1").select("center", "blocks")
    dealt = _with(members, large, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", _own("blocks"))
    first = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: _pair(F.col("own"), j))
    others = F.array(_pair(F.lit(0), F.col("own")), _pair(F.col("own"), F.col("own")))
    return dealt.select("center", "h", F.col("h").alias("root"), "own", F.explode(F.when(F.col("own") == 0, first).otherwise(others)).alias("m"))


def _dealt_open(placed: DataFrame) -> DataFrame:
    """placed(center, h, n, root) of groups with several roots, dealt so that all pairs meet but those within the largest root."""
    by_root = placed.groupBy("center", "root").agg(F.count(F.lit(1)).alias("of"), F.sum("n").alias("tokens"))
    groups = by_root.groupBy("center").agg(F.max(F.struct("of", "root", "tokens")).alias("most"), F.sum("of").alias("of"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    groups = groups.select(
        "center", F.col("most.root").alias("major"), (_blocks("of", "tokens") == 1).alias("small"),
        _blocks("of - most.of", "tokens - most.tokens").alias("few"), _blocks("most.of", "most.tokens").alias("many"),
    )
    dealt = _with(placed, groups, "inner").withColumn("large", F.col("root") == F.col("major"))
    own = F.when(F.col("small"), F.lit(0)).when(F.col("large"), F.col("few") + _own("many")).otherwise(_own("few"))
    last = F.when(F.col("small"), F.lit(0)).when(F.col("large"), F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1)
    meets = F.transform(F.sequence(F.lit(0), F.col("last")), lambda j: _pair(F.col("own"), j))
    return dealt.withColumn("own", own).withColumn("last", last).select("center", "h", "root", "own", F.explode(meets).alias("m"))


def _joined_groups(dealt: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) within groups, or pairs of their blocks: dealt(center, h, root, own, m) beside texts(h, text)."""

    def linked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shingle = Shingler(n)
        sets = [shingle(t) for t in rows["text"]]
        links = matrix_links(rows["h"].to_numpy(), sets, rows["own"].to_numpy(), num, den, rows["root"].to_numpy())
        if sum(map(len, sets)) > SPLIT_TOKENS // 4:  # most groups are small, and a call takes time
            give_back()
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    rows = dealt.select("center", "h", "root", "own", "m.i", "m.j").join(texts, "h")
    return rows.groupBy("center", "i", "j").applyInPandas(linked, "a long, b long")


def link_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), h (of the set), t (of the text) and stays of every document.

    Two documents link when den * common >= num * united n-grams; any threshold above 0 is taken.
    stays marks the rows of one id and text of each class (of the least id, then of the least
    hash of the text), and all rows without n-grams. Nulls: a null text, like one without words,
    has no n-grams and no links, so its component is its own id; null ids are kept and count as
    larger than any other. Ids are integers. Equal sets link. Repeated rows are returned each.
    Texts are read whole. An empty table gives an empty result. Other columns aren't returned.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(quoted(key)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    signed = written(_signed(rows, n, Signer(num, den, *_common_tokens(rows, n))), "signed")
    keys = signed.where("keys is not null").agg(F.sum(F.size("keys"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(keys * 16 / (32 << 20)))
    groups = written(_groups(signed, parts), "groups")

    thin = signed.select("doc_id", "t", "n_shingles", "h")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    sets = thin.where("h <> 0").groupBy("h").agg(F.min(one).alias("one"), F.max("n_shingles").alias("n"))
    centers = groups.select("center").distinct().select("center", F.col("center").alias("h"))
    members = written(groups.unionByName(centers).join(sets.select("h", "n"), "h").select("center", "h", "n"), "members")
    picked = sets.join(members.select("h").distinct(), "h").select("h", F.col("one.doc_id").alias("picked"), F.col("one.t").alias("picked_t"))
    found = rows.join(picked, F.col("doc_id").eqNullSafe(F.col("picked")) & (F.col("t") == F.col("picked_t")))
    texts = written(found.select("h", "text").dropDuplicates(["h"]), "texts")

    nearest = Window.partitionBy("h")
    primary = members.withColumn("least", F.min("center").over(nearest)).where("center = least").select("center", "h", "n")
    heads = members.where("center = h").join(primary.select("center").distinct(), "center", "left_semi").select("center", "h", "n")
    links = written(_joined_groups(_dealt_first(primary.unionByName(heads).distinct()), texts, n, num, den), "links")
    roots = written(connected_components(links), "roots")
    placed = members.join(roots.select(F.col("node").alias("h"), "root"), "h", "left").select("center", "h", "n", F.coalesce("root", "h").alias("root"))
    more = written(_joined_groups(_dealt_open(written(placed, "placed")), texts, n, num, den), "more")
    if not more.isEmpty():
        release(roots)
        roots = written(connected_components(links.unionByName(more)), "roots")
    named = thin.join(roots.select(F.col("node").alias("h"), "root"), "h", "left").withColumn("root", F.coalesce("root", "h")).withColumn("one", one)
    first = named.where("h <> 0").groupBy("root").agg(F.min("one").alias("first"))
    spread = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = named.withColumn("salt", F.pmod(F.xxhash64("t", "doc_id"), F.lit(SALTS)).cast("int")).join(spread, ["root", "salt"], "left")
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("h") == 0, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), "h", "t",
        ((F.col("h") == 0) | (F.col("one.doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("one.t") == F.col("first.t")))).alias("stays"),
    )


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs but for those whose text is linked to that of a row that stays, with columns as they were, whatever their names.

    The row of the least id (then of the least hash of the text) of each class stays; null ids
    count as larger than any other. Rows without n-grams stay. Of rows that share id and text one
    stays, that with the least hash of all its columns. An empty table stays empty.
    """
    classes = link_classes(docs, key=key, text=text, n=n, num=num, den=den)
    stays = classes.where("stays").select("doc_id", "t").distinct()
    rows = pack(docs, F.col(quoted(key)).cast("long").alias("k"), F.xxhash64(F.coalesce(F.col(quoted(text)), F.lit(""))).alias("u"), F.xxhash64(*hashable(docs)).alias("whole"))
    kept = rows.join(stays, F.col("k").eqNullSafe(F.col("doc_id")) & (F.col("u") == F.col("t")), "left_semi")
    if not classes.groupBy("doc_id", "t").count().where("count > 1").isEmpty():
        kept = kept.groupBy("k", "u").agg(F.min_by("row", "whole").alias("row"))
    return unpack(kept, [])
