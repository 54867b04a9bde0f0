"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent letter n-grams (n = 1 to 5, within words, with a blank on
either side of a word) of a text in order of falling frequency, ties by the n-gram's code.
A document takes the language whose profile has the smallest out-of-place distance: the
sum over the document's n-grams of the difference of the two ranks, where an n-gram that
the language lacks counts the profile length.

Language profiles are fitted on a bounded sample of the labelled rows
(``Settings.sample_rows`` per language in expectation, chosen by a hash of the row's id,
whole texts); every row is then predicted. Texts are turned to arrays of letters once, so
the n-grams of a text are integer arrays that numpy sorts; memory follows the longest
text of a slice, and rows never leave their partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import rest_worker

UND = "und"


@dataclass(frozen=True)
class Settings:
    """n-gram lengths, profile length, and rows per language that profiles are fitted on.

    A text is of no learned language if its closeness is below ``reject`` times the one that all but
    ``outliers`` of the sampled rows of the language reach.
    """

    longest: int = 5
    profile: int = 300
    sample_rows: int = 400
    bits: int = 12
    reject: float = 0.6
    outliers: float = 0.01


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point the code point of its lower-case letter; 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low[0])
    return out


def letters_of(text: str) -> np.ndarray:
    """The text as lower-case letters with one 0 before, between and after its words; empty without letters."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    word = codes > 0
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first blank behind a word
    codes = codes[keep]
    return np.concatenate([[np.uint32(0)], codes, [np.uint32(0)]]) if len(codes) and codes[-1] else np.concatenate([[np.uint32(0)], codes]) if len(codes) else codes


def grams_of(letters: np.ndarray, longest: int, bits: int) -> np.ndarray:
    """Codes of all n-grams with no blank inside; a code keeps ``bits`` bits a letter (CJK letters fold into them)."""
    codes = (letters.astype(np.uint64) % np.uint64((1 << bits) - 1)) + (letters > 0)
    blank = letters == 0
    found, code = [codes[~blank]], codes
    inner = np.zeros(len(codes), bool)  # a blank strictly inside the n-gram that starts here
    for n in range(2, longest + 1):
        if len(letters) < n:
            break
        code = (code[: len(letters) - n + 1] << np.uint64(bits)) | codes[n - 1 :]
        if n > 2:
            inner = inner[: len(letters) - n + 1] | blank[n - 2 : n - 2 + len(letters) - n + 1]
        else:
            inner = inner[: len(letters) - 1]
        found.append((code | np.uint64(n) << np.uint64(61))[~inner])
    return np.concatenate(found)


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams = np.sort(grams)
    edge = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[edge], np.diff(np.append(edge, len(grams)))


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, by falling count, then by code."""
    if len(counts) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        chosen = np.flatnonzero(counts >= least)
        grams, counts = grams[chosen], counts[chosen]
    return grams[np.argsort(-counts, kind="stable")][:size]


class Profiles:
    """Rank tables of the learned languages: sorted n-grams, and the rank of each in each language."""

    def __init__(self, by_language: dict[str, list[int]], settings: Settings):
        self.languages, self.settings = sorted(by_language), settings
        self.grams = np.unique(np.concatenate([np.array(by_language[x], np.uint64) for x in self.languages])) if by_language else np.zeros(0, np.uint64)
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), settings.profile, np.int32)
        self.absent = np.ones((len(self.grams) + 1, len(self.languages)), bool)
        for k, language in enumerate(self.languages):
            at = np.searchsorted(self.grams, np.array(by_language[language], np.uint64))
            self.ranks[at, k] = np.arange(len(at))
            self.absent[at, k] = False

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and closeness: 1 minus the distance over the largest possible one."""
        letters = letters_of(text) if text else None
        if letters is None or not len(letters) or not self.languages:
            return UND, 0.0
        size = self.settings.profile
        own = ranked(*counted(grams_of(letters, self.settings.longest, self.settings.bits)), size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at[self.grams[at] != own] = len(self.grams)
        gap = np.abs(self.ranks[at] - np.arange(len(own), dtype=np.int32)[:, None])
        gap[self.absent[at]] = size
        distance = gap.sum(axis=0)
        best = int(np.argmin(distance))
        return self.languages[best], float(1.0 - distance[best] / (size * len(own)))


def _sampled(labelled: DataFrame, settings: Settings) -> DataFrame:
    """Per language about ``sample_rows`` rows, chosen by a hash of the id (all rows of a small language)."""
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 11).cast("double") / float(1 << 53)
    return labelled.join(F.broadcast(counts), "lang").where(drawn * F.col("n") < settings.sample_rows).select("text", "lang")


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Profiles:
    """Profiles from rows of doc_id, text and lang; rows without a language or a letter teach nothing.

    Counts are added up per partition, then per (language, n-gram); each language sends
    its ``profile`` most frequent n-grams to the driver: languages * 300 numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for text, language in zip(batch.column(0), batch.column(1), strict=True):
                letters = letters_of(text.as_py() or "")
                if len(letters):
                    held.setdefault(language.as_py(), []).append(grams_of(letters, settings.longest, settings.bits))
        for language, parts in held.items():
            grams, counts = counted(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    counts = _sampled(_learnable(labelled), settings).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the code's order as an unsigned number breaks ties
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("gram") < 0, "gram"))
    by_language: dict[str, list[int]] = {}
    for row in counts.withColumn("rank", rank).where(F.col("rank") <= settings.profile).orderBy("lang", "rank").collect():
        by_language.setdefault(row["lang"], []).append(row["gram"] & (1 << 64) - 1)
    return Profiles(by_language, settings)


def _learnable(labelled: DataFrame) -> DataFrame:
    return labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")


def fit_bounds(labelled: DataFrame, profiles: Profiles) -> dict[str, float]:
    """The least closeness of each learned language, from all rows that have one."""
    settings = profiles.settings

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [profiles.predict(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["lang", "score"])
        rest_worker()

    scores = _learnable(labelled).select("text").mapInArrow(run, "lang string, score double").where(F.col("lang") != UND)
    return {r["lang"]: settings.reject * r["low"] for r in scores.groupBy("lang").agg(F.percentile("score", F.lit(settings.outliers)).alias("low")).collect()}


def predict(docs: DataFrame, profiles: Profiles, *keep: str) -> DataFrame:
    """The kept columns of each row with lang_pred and score."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [profiles.predict(t.as_py()) for t in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*keep, "lang_pred", "score"])
        rest_worker()

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, lang_pred string, score double")


def keep_identified(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without rows of no learned language: no letter, or a closeness below the language's bound; all columns stay.

    Profiles and bounds are fitted on rows that are not held out. Null and empty texts have no
    letter. Where no row has a language there is nothing to judge by, and every row with a
    letter stays. Repeated rows are judged alike; other columns may have any names.
    """
    learned = docs.where(~held_out(F.col("doc_id")))
    profiles = fit(learned, settings)
    bounds = fit_bounds(learned, profiles) if profiles.languages else {}

    def clean(text: str | None) -> bool:
        if not profiles.languages:
            return bool(text) and len(letters_of(text)) > 0
        language, score = profiles.predict(text)
        return language != UND and score >= bounds.get(language, 0.0)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array([clean(t.as_py()) for t in batch.column(at)], pa.bool_()))
        rest_worker()

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """A quarter of the rows, by a checksum of the id as text; a row without an id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    Fitted on the rows that are not held out. ``und`` with score 0: null text, a text
    without a letter, or nothing to learn from. Repeated rows get equal results.
    """
    profiles = fit(docs.where(~held_out(F.col("doc_id"))), settings)
    return predict(docs.withColumn("held_out", held_out(F.col("doc_id"))), profiles, "doc_id", "held_out")
