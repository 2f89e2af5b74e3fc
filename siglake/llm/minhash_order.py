"""Document fingerprints by Order MinHash, by DataFrame functions alone.

A text is cut into words; its k-mers of words are numbered by occurrence, hashed, and dealt
by hash into bins. Of each bin the `width` least are selected, put back into the order they
have in the text, and their k-mers' hashes are hashed as a tuple: one entry of the signature
a bin. Two texts share an entry if they share the selected k-mers and their order, so that
moved and edited passages both lower the likeness. Bins of one hash function stand for
separate hash functions: the cost is one sort of the text's k-mers, whatever the number of bins.

A text stays in its row: words, hashes and signature are arrays, sorted as plain longs (hash
bits above, place below), and occurrences are numbered from the runs of the sorted array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siglake.llm.common import SPACE_CLASS, hashable, pack, quoted, shuffle_partitions, text_bytes, unpack

#: Words of a k-mer, k-mers of a tuple, bins (a power of two).
KMER, WIDTH, BINS = 2, 2, 64
_PLACE = (1 << 30) - 1
#: Bytes of text in a block of documents that follow each other.
BLOCK_BYTES = 12 << 20


def _let(value: Column, body) -> Column:
    """body of value, with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _run_starts(sorted_longs: Column, shift: int) -> Column:
    """Places (from 0) where the bits above shift change in a sorted array."""
    return F.filter(
        F.transform(sorted_longs, lambda x, i: F.when((i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(sorted_longs, i - 1), shift)), i).otherwise(F.lit(-1))), lambda i: i >= 0
    )


def _runs(sorted_longs: Column, shift: int) -> Column:
    """The sorted array cut into its runs."""
    starts = F.concat(_run_starts(sorted_longs, shift), F.array(F.size(sorted_longs)))
    return _let(starts, lambda s: F.transform(F.slice(s, 1, F.size(s) - 1), lambda a, j: F.slice(sorted_longs, a + 1, F.get(s, j + 1) - a)))


def signature(text: Column, kmer: int = KMER, width: int = WIDTH, bins: int = BINS) -> Column:
    """array<int> of one entry a bin; 0 is a bin without k-mers. A text of fewer words than a k-mer is one k-mer; one without words has none."""
    bits = int(math.log2(bins))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")

    def of_words(w: Column) -> Column:
        count = F.greatest(F.size(w) - F.lit(kmer - 1), F.when(F.size(w) > 0, 1).otherwise(0))
        places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(kmer)]))
        return _let(hashes, of_hashes)

    def of_hashes(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x.bitwiseAND(F.lit((1 << 33) - 1)), 30).bitwiseOR(i.cast("long"))))
        numbered = _let(by_hash, lambda s: F.flatten(F.transform(_runs(s, 30), lambda run: F.transform(run, lambda x, occurrence: F.struct(F.xxhash64(F.shiftright(x, 30), occurrence).alias("o"), x.bitwiseAND(F.lit(_PLACE)).alias("p"))))))
        # bin, then order within the bin, then place
        dealt = F.sort_array(F.transform(numbered, lambda x: F.shiftleft(x["o"].bitwiseAND(F.lit((1 << 33) - 1)), 30).bitwiseOR(x["p"])))
        return _let(dealt, lambda d: of_bins(h, d))

    def of_bins(h: Column, d: Column) -> Column:
        entry = lambda run: F.transform(F.sort_array(F.transform(F.slice(run, 1, width), lambda x: x.bitwiseAND(F.lit(_PLACE)))), lambda p: F.get(h, p.cast("int")))
        pairs = F.transform(_runs(d, 63 - bits), lambda run: F.struct(F.shiftright(F.get(run, F.lit(0)), 63 - bits).cast("int").alias("bin"), F.xxhash64(entry(run)).alias("v")))
        held = _let(F.map_from_entries(pairs), lambda m: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.get(F.array(m[b]), F.lit(0)), F.lit(0))))
        return F.transform(held, lambda v: F.when(v == 0, F.lit(0)).otherwise(F.greatest(F.shiftrightunsigned(v, 33), F.lit(1))).cast("int"))

    return _let(words, of_words)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries among those that either signature has; 1 if both have none."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != 0)), lambda x: x))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda x: x))
    return F.when(either == 0, F.lit(1.0)).otherwise(same / either)


def fingerprint(signature_: Column) -> Column:
    return F.array_join(F.transform(signature_, lambda v: F.lpad(F.lower(F.hex(v.cast("long"))), 8, "0")), "")


def block_limits(rows: DataFrame, key: str, size: str) -> tuple[list[int], bool, int | None]:
    """Keys that cut the table into blocks of about BLOCK_BYTES; whether a key is null; the least key."""
    total, nulls, low = rows.agg(F.sum(size), F.coalesce(F.bool_or(F.col(key).isNull()), F.lit(False)), F.min(key)).first()
    blocks = min(max(shuffle_partitions(rows.sparkSession), math.ceil((total or 0) / BLOCK_BYTES)), 20_000)
    if low is None or blocks < 2:
        return [], nulls, low
    shares = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    return sorted(set(rows.agg(F.percentile_approx(key, shares, F.lit(max(10_000, 10 * blocks)))).first()[0])), nulls, low


def follow(rows: DataFrame, key: str, tie: str, carried: list[str], limits: list[int], nulls: bool, low: int | None) -> DataFrame:
    """rows with next_<c> of the row that follows by (key, tie), the first row's after the last.

    Rows are dealt by blocks of the key's range, whose limits are keys of the table; the rows at a
    limit also go to the block before, as what follows its last row, and the first row to the last
    block. Nulls come first. A block is one window partition of bounded bytes, unless one key alone
    has more.
    """
    none = F.array().cast("array<struct<b:int,late:int>>")
    held = F.array(*[F.lit(x).cast("long") for x in limits]) if limits else F.array().cast("array<long>")
    block = F.coalesce(_rank(held, F.col(key), len(limits)), F.lit(0)) if limits else F.lit(0)
    first = F.col(key).isNull() if nulls else F.col(key) == F.lit(low)
    stands = lambda b, late: F.array(F.struct(b.cast("int").alias("b"), F.lit(late).alias("late")))
    before = F.when((F.col("block") > 0) & F.array_contains(held, F.col(key)), stands(F.col("block") - 1, 1)).otherwise(none)
    around = F.when(first, stands(F.lit(len(limits)), 2)).otherwise(none)
    placed = rows.withColumn("block", block.cast("int")).withColumn("stand", F.explode(F.concat(stands(F.col("block"), 0), before, around)))
    order = Window.partitionBy("stand.b").orderBy("stand.late", F.col(key).asc_nulls_first(), tie)
    return placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).where("stand.late = 0").drop("stand", "block")


def _rank(limits: Column, value: Column, n: int) -> Column:
    """How many of n ascending limits are at or below value, by halving."""

    def halve(low: Column, step: int) -> Column:
        there = low + F.lit(step)
        now = F.when((there <= n) & (F.get(limits, there - 1) <= value), there).otherwise(low)
        return _let(now, lambda x: halve(x, step >> 1)) if step > 1 else now

    return halve(F.lit(0), 1 << (n.bit_length() - 1))


def fingerprint_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", kmer: int = KMER, width: int = WIDTH, bins: int = BINS) -> DataFrame:
    """docs with signature (array<int>, one entry a bin) and fingerprint (hexadecimal).

    Nulls: a null text counts as empty. Equal texts have equal fingerprints, repeated rows too.
    Very long texts are read whole. An empty table gives an empty result. Input columns named
    like an output column give way to it.
    """
    out = pack(docs, signature(F.col(quoted(text)), kmer, width, bins).alias("signature")).withColumn("fingerprint", fingerprint(F.col("signature")))
    return unpack(out, ["signature", "fingerprint"])


def edit_probe(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document beside its edited text (the last half replaced by the beginning of the next document) and the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Nulls: a null text is empty; null ids come first, ordered by a hash of the row, as repeated ids are.
    """
    thin = docs.select(F.col(quoted(key)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"), F.xxhash64(*hashable(docs)).alias("tie"))
    limits = block_limits(thin.select("doc_id", text_bytes(F.col("text")).alias("size")), "doc_id", "size")
    lined = follow(fingerprint_documents(thin), "doc_id", "tie", ["text", "signature"], *limits)
    edited = F.expr("concat(substring(text, 1, n - cut), substring(next_text, 1, cut))")
    probed = lined.withColumn("n", F.char_length("text")).withColumn("cut", F.floor(F.col("n") / 2).cast("int")).withColumn("edited", edited)
    probed = probed.withColumn("edited_signature", signature(F.col("edited")))
    return probed.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint",
        fingerprint(F.col("edited_signature")).alias("edited_fingerprint"), likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
