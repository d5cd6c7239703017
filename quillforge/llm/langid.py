"""Language ID by rank-order profiles.

A text's letters, lower-cased, form words; each word is framed by a boundary mark, and n-grams of
one to three characters inside it are counted. A language's profile is its most frequent n-grams
over all labelled training documents; a document's most frequent n-grams are compared with each
profile by the out-of-place distance: the sum of rank differences, with the profile's size for an
n-gram that it lacks. The nearest language wins, ties to the smaller name.

Texts are read in parts of PART characters, cut after a character that is no letter, and the counts
of a document's parts are added; so what a task holds does not grow with a text's length, and a text
is never cut short. Labels name languages, so the profiles, `PROFILE` rows for each, stay small.

Cases: null text, empty text or text without a letter gives `und` with score 0; null labels teach
nothing; without any labelled document everything is `und`; ranks of equal counts go by n-gram
code, so repeated rows and any order of input give the same profiles; texts of any length are taken
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillforge.llm.common import mapped, slices, strings, table

PROFILE = 400
UNKNOWN = "und"
#: A text with less than this score shares next to nothing with any profile.
FOREIGN = 0.1
#: The mark of a word's edge; letters lie above it.
EDGE = 1
#: Characters that are counted at once, and text read for that at once.
PART, READ_BYTES = 1 << 18, 1 << 20
#: Distinct n-grams that a counting task holds before it hands them on.
HELD = 1 << 20

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index, code) of every n-gram of lower-cased texts; code points take 21 bits each, the first on top."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    # one edge before the first letter of each word and one after its last
    letters = np.flatnonzero(_letter_table()[points])
    if not len(letters):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    starts = np.ones(len(letters), dtype=bool)
    starts[1:] = (np.diff(letters) > 1) | (doc[letters[1:]] != doc[letters[:-1]])
    word = np.cumsum(starts) - 1
    stream = np.full(len(letters) + 2 * (word[-1] + 1), EDGE, dtype=np.int64)
    stream[np.arange(len(letters)) + 2 * word + 1] = points[letters]
    of = np.repeat(doc[letters[starts]], np.diff(np.append(np.flatnonzero(starts), len(letters))) + 2)
    solid = stream != EDGE
    two = solid[:-1] | solid[1:]
    three = solid[1:-1]
    pair = (stream[:-1] << 21) | stream[1:]
    code = np.concatenate([stream[solid], pair[two], ((pair[:-1] << 21) | stream[2:])[three]])
    return np.concatenate([of[solid], of[:-1][two], of[1:-1][three]]), code


def parts(texts: list[str], most: int = PART) -> Iterator[list[tuple[int, str]]]:
    """Lists of (index, lower-cased text) of about `most` characters; a longer text is cut after a
    character that is no letter and goes on in the next list."""
    held: list[tuple[int, str]] = []
    size = 0
    for k, text in enumerate(texts):
        low, at = text.lower(), 0
        while len(low) - at > most:
            end = at + most
            while end < len(low) and low[end - 1].isalpha():
                end += 1
            yield [*held, (k, low[at:end])]
            held, size, at = [], 0, end
        held.append((k, low[at:] if at else low))
        size += len(low) - at
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _merged(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, where = np.unique(np.concatenate([one[0], two[0]]), return_inverse=True)
    return code, np.bincount(where, np.concatenate([one[1], two[1]]), len(code)).astype(np.int64)


def counted(texts: list[str], most: int = PART) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index, distinct codes in order, their counts) of each text that has a letter."""
    index, code, n = -1, np.zeros(0, np.int64), np.zeros(0, np.int64)  # the text that the next list may go on with
    for part in parts(texts, most):
        place, codes = ngrams([t for _, t in part])
        by = np.lexsort((codes, place))
        place, codes = place[by], codes[by]
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (codes[1:] != codes[:-1])])) if len(place) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(place)))
        edges = np.searchsorted(place[first], np.arange(len(part) + 1))
        for (k, _), a, b in zip(part, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            mine = codes[first[a:b]], counts[a:b]
            if k == index:
                code, n = _merged((code, n), mine)
                continue
            if len(code):
                yield index, code, n
            index, (code, n) = k, mine
    if len(code):
        yield index, code, n


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % modulus == remainder, F.lit(False))


def profiles(labelled: DataFrame, size: int = PROFILE) -> list[tuple[str, int, int]]:
    """(language, n-gram code, rank from 0) over all rows of (text, lang); `size` rows a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (code, n) in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)], names=["lang", "code", "n"])
            found.clear()

        for batch in slices(batches, most=READ_BYTES):
            texts = np.array(strings(batch.column(0)).to_pylist(), dtype=object)
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in sorted(set(langs.tolist())):
                for part in parts(texts[langs == lang].tolist()):
                    new = np.unique(ngrams([t for _, t in part])[1], return_counts=True)
                    found[lang] = _merged(found[lang], new) if lang in found else new
            if sum(len(code) for code, _ in found.values()) > HELD:
                yield from flush()
        yield from flush()

    counts = labelled.select("text", "lang").filter("text is not null and lang is not null").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return [(r.lang, r.code, r.rank - 1) for r in counts.withColumn("rank", rank).filter(F.col("rank") <= size).select("lang", "code", "rank").collect()]


class Classifier:
    """Profiles as one sorted code table with a column of ranks for each language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, dtype=np.int64)
        column = {lang: k for k, lang in enumerate(self.langs)}
        for lang, code, rank in rows:
            self.ranks[np.searchsorted(self.codes, code), column[lang]] = rank

    def distances(self, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, int]:
        """Out-of-place distances of one document's n-grams (in order of code), and the largest possible."""
        top = code[np.argsort(-n, kind="stable")[: self.size]]
        at = np.searchsorted(self.codes, top)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != top)] = len(self.codes)
        theirs = self.ranks[at]
        apart = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(top))[:, None]))
        return apart.sum(axis=0), self.size * len(top)

    def predict(self, texts: list[str], most: int = PART) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for k, code, n in counted(texts, most) if self.langs else ():
            apart, largest = self.distances(code, n)
            best = int(np.argmin(apart))
            names[k], scores[k] = self.langs[best], 1 - float(apart[best]) / largest
        return names, scores


def predict(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=READ_BYTES):
            names, scores = classifier.predict(strings(batch.column(1)).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, foreign: float = FOREIGN) -> DataFrame:
    """Rows of `docs` in one of the languages that its own labels teach.

    A text without a letter, or whose score is under `foreign`, goes; where `lang` is null it is set
    to the prediction. Without any label nothing can be told apart and every row stays."""
    classifier = Classifier(profiles(docs))
    if not classifier.langs:
        return docs

    at, k = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, READ_BYTES):
            names, scores = classifier.predict(strings(batch.column(at)).to_pylist())
            if batch.column(k).null_count:
                batch = batch.set_column(k, batch.schema.field(k), pc.coalesce(batch.column(k), pa.array(names, batch.column(k).type)))
            yield batch.filter(pa.array([name != UNKNOWN and score >= foreign for name, score in zip(names, scores, strict=True)], pa.bool_()))

    return mapped(docs, run)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    found = predict(docs, Classifier(profiles(docs.filter(~out))))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
