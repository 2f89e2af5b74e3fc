"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from the seed and its code point. An
n-gram's vector binds (multiplies) its letters' vectors, each permuted (rolled) by its place;
a document bundles (adds) its n-grams' vectors over the whole text, and a language's
prototype bundles the unit vectors of its training documents. A document's language is the
prototype with the largest cosine, after the mean of the prototypes is taken off.

Prototypes come from a bounded sample of each language's training documents, drawn by a hash
of the id at a rate that the language's count gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import column_of, mapped, pack, quoted, unpack

#: Length of vectors, letters of an n-gram, documents of a language that teach.
DIM, GRAM, SAMPLE = 1024, 3, 3_000
_BLOCK = 2048
_SPACE = 32


@lru_cache(maxsize=20_000)
def letter_vector(code: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, code]).integers(0, 2, dim, dtype=np.int8) * np.int8(2) - np.int8(1)


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text, what is no letter as single spaces, one at either end."""
    raw = text.lower()
    codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if raw.isascii():
        letter = (codes >= 97) & (codes <= 122)
    else:
        kinds, back = np.unique(codes, return_inverse=True)
        letter = np.array([chr(c).isalpha() for c in kinds])[back]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    codes = np.concatenate([[_SPACE], np.where(letter, codes, _SPACE), [_SPACE]]).astype(np.int64)
    return codes[np.concatenate([[True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)])]


def document_vector(text: str | None, dim: int = DIM, gram: int = GRAM, seed: int = 17) -> np.ndarray | None:
    """The bundle of the text's n-grams as a unit vector; None without letters."""
    codes = letters_of(text or "")
    if len(codes) < gram:
        return None
    kinds, ids = np.unique(codes, return_inverse=True)
    base = np.stack([letter_vector(int(c), dim, seed) for c in kinds])
    places = [np.roll(base, gram - 1 - j, axis=1) for j in range(gram)]
    keys = ids[: len(ids) - gram + 1].astype(np.int64)
    for j in range(1, gram):
        keys = keys * len(kinds) + ids[j : len(ids) - gram + 1 + j]
    keys, counts = np.unique(keys, return_counts=True)
    total = np.zeros(dim, dtype=np.float32)
    for at in range(0, len(keys), _BLOCK):
        k = keys[at : at + _BLOCK]
        bound = None
        for j in range(gram - 1, -1, -1):
            part = places[j][k % len(kinds)]
            bound = part if bound is None else bound * part
            k = k // len(kinds)
        total += counts[at : at + _BLOCK].astype(np.float32) @ bound.astype(np.float32)
    size = float(np.linalg.norm(total))
    return total / size if size else total


class Profiles:
    def __init__(self, languages: list[str], prototypes: np.ndarray, dim: int, gram: int, seed: int):
        self.languages, self.dim, self.gram, self.seed = languages, dim, gram, seed
        self.mean = prototypes.mean(0) if len(languages) > 1 else np.zeros(dim)
        own = prototypes - self.mean
        self.units = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12) if len(languages) else np.zeros((0, dim))

    def predict(self, text: str | None) -> tuple[str, float]:
        v = document_vector(text, self.dim, self.gram, self.seed) if self.languages else None
        if v is None:
            return "und", 0.0
        v = v - self.mean
        cosines = self.units @ v / max(float(np.linalg.norm(v)), 1e-12)
        best = int(np.argmax(cosines))
        return self.languages[best], float(min(1.0, max(0.0, (1 + cosines[best]) / 2)))


def learn_profiles(docs: DataFrame, keep: Column | None = None, *, key: str = "doc_id", text: str = "text", lang: str = "lang", dim: int = DIM, gram: int = GRAM, sample: int = SAMPLE, seed: int = 17) -> Profiles:
    """Prototypes from the documents that keep admits; rows with a null language or without letters teach nothing.

    Repeated rows teach each. Without any teaching document there are no languages, and every
    text is `und`. Names of other columns don't matter.
    """
    rows = docs.select(F.col(quoted(key)).alias("doc_id"), F.col(quoted(text)).alias("text"), F.col(quoted(lang)).alias("lang")).where("lang is not null")
    if keep is not None:
        rows = rows.where(keep)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return Profiles([], np.zeros((0, dim)), dim, gram, seed)
    rate = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])[F.col("lang")]
    picked = rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < rate * (1 << 20))

    def bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for name, body in zip(b["lang"], b["text"], strict=True):
                v = document_vector(body, dim, gram, seed)
                if v is not None:
                    held[name] = held[name] + v if name in held else v.astype(np.float64)
        if held:
            yield pd.DataFrame({"lang": list(held), "v": [x.tolist() for x in held.values()]})

    parts = mapped(picked, bundled, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).toPandas()  # dim rows a language
    languages = sorted(sums["lang"].unique())
    prototypes = np.zeros((len(languages), dim))
    for r, name in enumerate(languages):
        own = sums[sums["lang"] == name]
        prototypes[r, own["i"].to_numpy()] = own["x"].to_numpy()
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    return Profiles(languages, np.round(prototypes, 9), dim, gram, seed)


def identify_language(docs: DataFrame, profiles: Profiles, *, text: str = "text") -> DataFrame:
    """docs with lang_pred (`und` if the text is null or without letters) and score (0 to 1; half of 1 + cosine).

    Ties go to the first language in order. Texts are read whole. Repeated rows are judged
    alike. An empty table gives an empty result. Input columns named like an output column
    give way to it.
    """
    kernel = lambda texts: pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])
    judged = column_of(docs.sparkSession, kernel, "struct<lang_pred: string, score: double>")
    out = pack(docs, judged(F.col(quoted(text))).alias("found"))
    return unpack(out.select("row", "found.lang_pred", "found.score"), ["lang_pred", "score"])
