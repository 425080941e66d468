"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (1 to ``max_n`` letters, word ends count as a
blank at either end) in labelled texts. A document's most frequent n-grams are ranked as well, and the distance to a
profile is the sum, over the document's n-grams, of how far each is out of place; one that the profile lacks
counts as far out of place as possible. The nearest profile wins, the smaller name in a tie.

Profiles are learned from at most about ``sample_rows`` rows a language, drawn by a hash of the id (a documented bound;
with fewer labelled rows all of them count). Whole texts are used throughout. Texts that are null or have no letter, and all texts if
nothing could be learned, are ``und`` with score 0. The score is 1 for a document that ranks its n-grams exactly as the
profile does and 0 for one that shares none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import text_batches

MAX_N, PROFILE_GRAMS, SAMPLE_ROWS = 3, 400, 2000
UNDETERMINED = "und"
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Characters that are counted at once when many texts are added up.
_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Profile:
    """n-grams in ascending order with their ranks."""

    lang: str
    grams: np.ndarray
    ranks: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def letter_codes(text: str | None) -> np.ndarray:
    """Lower-case code points with one 0 for each run of other characters, and at both ends. Empty without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.where(_letters()[codes], codes, 0)
    codes = np.concatenate([np.zeros(1, dtype=codes.dtype), codes, np.zeros(1, dtype=codes.dtype)])
    keep = codes != 0
    if not keep.any():
        return np.zeros(0, dtype=np.uint64)
    keep[1:] |= codes[:-1] != 0
    keep[0] = True
    return codes[keep].astype(np.uint64)


def gram_counts(codes: np.ndarray, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams as 64-bit values in ascending order and how often each occurs. A blank may only stand at an end."""
    blank, digits = codes == 0, codes + np.uint64(1)
    value, inner = digits, np.zeros(len(codes), dtype=bool)
    found = [value[~blank]]
    for n in range(2, max_n + 1):
        if len(value) < 2:
            break
        # Blanks of two texts that were counted at once meet, which is no n-gram.
        inner = inner[:-1] | blank[n - 2 : len(codes) - 1] if n > 2 else blank[:-1] & blank[1:]
        value = value[:-1] * _STEP + digits[n - 1 :]
        found.append(value[~inner])
    every = np.sort(np.concatenate(found))
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, dtype=np.int64)
    return every[first], np.diff(np.append(first, len(every)))


def top_grams(codes: np.ndarray, max_n: int, most: int) -> np.ndarray:
    """The most frequent n-grams of a text by rank; equal counts go by value."""
    grams, counts = gram_counts(codes, max_n)
    return grams[np.lexsort((grams, -counts))[:most]]


def predict(texts: list[str | None], profiles: list[Profile], max_n: int, most: int) -> tuple[list[str], list[float]]:
    tops = [top_grams(codes, max_n, most) if len(codes := letter_codes(t)) else codes for t in texts]
    sizes = np.array([len(t) for t in tops])
    if not profiles or not sizes.any():
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    grams = np.concatenate(tops)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    rank = np.arange(len(grams)) - np.repeat(begin[:-1], sizes)
    distances = np.empty((len(profiles), len(texts)))
    for k, p in enumerate(profiles):
        at = np.minimum(np.searchsorted(p.grams, grams), len(p.grams) - 1)
        out = np.where(p.grams[at] == grams, np.minimum(np.abs(p.ranks[at] - rank), most), most)
        total = np.concatenate([[0], np.cumsum(out)])
        distances[k] = total[begin[1:]] - total[begin[:-1]]
    best = distances.argmin(axis=0)
    score = 1 - distances.min(axis=0) / np.maximum(1, most * sizes)
    return [profiles[k].lang if n else UNDETERMINED for k, n in zip(best, sizes, strict=True)], np.where(sizes > 0, score, 0.0).tolist()


def fold(key: str) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(key).cast("string")) % 4


def learn(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", max_n: int = MAX_N, grams: int = PROFILE_GRAMS, sample_rows: int = SAMPLE_ROWS) -> list[Profile]:
    """Profiles of all languages of ``labelled`` (rows with a null language don't count), by name.

    What reaches the driver is a count and ``grams`` n-grams for each language.
    """
    text_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    if any(n > sample_rows for n in counts.values()):
        share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_rows / n))))
        rows = rows.where(F.pmod(F.xxhash64(F.lit("profiles"), F.col(key)), F.lit(1_000_000)) < F.element_at(share, F.col(lang)) * 1_000_000)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, texts in pdf.groupby("lang")["text"]:
                waiting, size = [], 0
                for codes in [*map(letter_codes, texts), None]:
                    if codes is not None and len(codes):
                        waiting.append(codes)
                        size += len(codes)
                    if waiting and (codes is None or size > _AT_ONCE):
                        values, n = gram_counts(np.concatenate(waiting), max_n)
                        yield pd.DataFrame({"lang": name, "gram": values.view(np.int64), "n": n})
                        waiting, size = [], 0

    found = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInPandas(count, "lang string, gram long, n long")
    totals = found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = totals.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1).where(F.col("rank") < grams)
    by_lang: dict[str, list[tuple[int, int]]] = {}
    for r in ranked.select("lang", "gram", "rank").collect():  # at most ``grams`` rows a language
        by_lang.setdefault(r["lang"], []).append((r["gram"], r["rank"]))
    out = []
    for name in sorted(by_lang):
        values = np.array([g for g, _ in by_lang[name]], dtype=np.int64).view(np.uint64)
        order = np.argsort(values)
        out.append(Profile(name, values[order], np.array([r for _, r in by_lang[name]])[order]))
    return out


def language(text: Column | str, profiles: list[Profile], *, max_n: int = MAX_N, grams: int = PROFILE_GRAMS) -> Column:
    """struct<lang_pred, score> of a text column, worked out where the row is."""

    @F.pandas_udf("lang_pred string, score double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            names, scores = [], []
            for i in range(0, len(column), 500):
                some_names, some_scores = predict(column.iloc[i : i + 500].tolist(), profiles, max_n, grams)
                names += some_names
                scores += some_scores
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return identify(text)


def with_language(docs: DataFrame, profiles: list[Profile], *, text: str = "text", into: str = "language", **options) -> DataFrame:
    """``docs`` with a column ``into`` of lang_pred and score; a column of that name is replaced."""
    text_batches(docs.sparkSession)
    return docs.withColumn(into, language(F.col(text), profiles, **options))
