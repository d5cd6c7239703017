"""Language-model scoring: the marginal likelihood of a text over all its segmentations into pieces.

The vocabulary and its scores are a public piece model's. A piece may hold marks at its start only
(other models are refused), so a text's marginal is the product of its words' (each with the mark
before it) and of the end; within a word every piece of the vocabulary counts, so all segmentations
are summed. A word's lattice holds every piece that matches at every byte; a forward recursion in log
space sums over all paths. A byte piece stands for a byte that no piece holds alone, as the fallback
that it is, and gets a score under all others.

Two scores are given. `vocabulary_score` takes the vocabulary's scores untouched, as natural logs of
weights. They are no probabilities: a merge model's, as the 32k model's, are negated ranks. `score` is
the model's probability: piece weights start from the scores (exponentials, over their sum; 1 / rank
where they are ranks) and are re-estimated once from the expected piece counts of all training words,
the start weights standing in with PRIOR counts.

Counts of words come from the same pass: a chunk of documents posts its distinct words with their
training counts and the expected piece counts of these (see ledger), and meets the totals when it
is scored. What reaches the driver is one number for each piece and two totals.

Words are those of the text with A-Z lower-cased. Cases: null and empty texts are one end token; a
null id trains; without training rows N and V are 0 and pieces keep their start weights; repeated
rows count each; a word of any length is scored whole, and so is a text; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.llm import ledger
from quillforge.llm.common import Words, materialise, parallelism, strings, table
from quillforge.llm.pieces import BYTE, MARK, MODEL, USER_DEFINED, Model

PRIOR = 1000.0
#: Expected counts are passed as integers of this fraction, so that their sums do not depend on order.
MICRO = 1e6
#: The end token among word keys.
END = np.uint64(0xE0D0E0D0E0D0E0D1)
#: Bytes of a word (with its mark) up to which words are scored side by side; longer ones alone.
LONG = 160
BLOCK = 1 << 13
CHUNK_BYTES = 10 << 20


class Lattice:
    """A trie over the bytes of the pieces; the end of a text has the id after the last piece."""

    def __init__(self, model: Model):
        self.size = len(model.names)
        usable = [k in (1, USER_DEFINED) for k in model.kinds]
        if any(u and MARK in n.lstrip(MARK) for u, n in zip(usable, model.names, strict=True)):
            raise ValueError("a piece goes on past the end of a word")
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for k, name in enumerate(model.names):
            if not usable[k] or not name:
                continue
            node = 0
            for b in name:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    piece.append(-1)
                node = children[node][b]
            piece[node] = k
        for k, kind in enumerate(model.kinds):  # a byte without a piece of its own
            if kind == BYTE:
                b = int(model.names[k][3:5], 16)
                if b not in children[0]:
                    children[0][b] = len(children)
                    children.append({})
                    piece.append(-1)
                if piece[children[0][b]] < 0:
                    piece[children[0][b]] = k
        self.children, self.piece = children, np.array(piece, dtype=np.int32)
        self.next = np.zeros((len(children), 256), dtype=np.int32)
        for node, row in enumerate(children):
            for b, child in row.items():
                self.next[node, b] = child
        self.used = np.unique(self.piece[self.piece >= 0])
        scores = np.array(model.scores)
        weight = np.zeros(self.size + 1)
        if (scores[self.used] <= 0).all() and scores[self.used].min() < -1000:  # ranks of merges
            rank = np.argsort(np.argsort(-np.where(np.array(model.kinds)[self.used] == BYTE, -np.inf, scores[self.used]), kind="stable"), kind="stable")
            weight[self.used] = 1.0 / (rank + 1)
        else:
            weight[self.used] = np.exp(scores[self.used])
        #: The vocabulary's own scores; those of byte pieces say nothing and go under all others.
        self.own = np.full(self.size + 1, -np.inf)
        plain = self.used[np.array(model.kinds)[self.used] != BYTE]
        self.own[self.used] = scores[plain].min() - 1 if len(plain) else -1.0
        self.own[plain] = scores[plain]
        self.own[-1] = 0.0
        self.start = weight / weight.sum()
        self.start *= 0.99
        self.start[-1] = 0.01

    def log_weights(self, expected: np.ndarray | None = None) -> np.ndarray:
        """Natural logs of the pieces' (and the end's) probabilities; pieces out of use have -inf."""
        weight = self.start if expected is None else (expected + PRIOR * self.start) / (expected.sum() + PRIOR)
        with np.errstate(divide="ignore"):
            return np.log(weight)

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, log_p: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log marginal of each word, expected counts of the pieces if the words have counts)."""
        out, expected = np.zeros(len(start)), np.zeros(self.size + 1)
        size = end - start + len(MARK)
        by = np.argsort(-size, kind="stable")
        alone = int((size > LONG).sum())
        for j in by[:alone].tolist():
            text = MARK + data[start[j] : end[j]].tobytes()
            out[j] = self._one(text, log_p, 0 if counts is None else float(counts[j]), expected)
        for a in range(alone, len(by), BLOCK):
            part = by[a : a + BLOCK]
            out[part] = self._many(data, start[part], size[part], log_p, None if counts is None else counts[part], expected)
        return out, expected

    def _many(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, log_p: np.ndarray, counts: np.ndarray | None, expected: np.ndarray) -> np.ndarray:
        """Words from long to short, one byte further at a time; `expected` is added to."""
        n, longest = len(size), int(size[0])
        text = np.zeros((n, longest), dtype=np.uint8)
        text[:, : len(MARK)] = np.frombuffer(MARK, np.uint8)
        col = np.arange(longest - len(MARK))
        inside = col < (size - len(MARK))[:, None]
        at = (start[:, None] + col)[inside]
        text[:, len(MARK) :][inside] = data[at]
        alpha = np.full((longest + 1, n), -np.inf)
        alpha[0] = 0
        upto = np.searchsorted(-size, -np.arange(longest), side="left")  # words longer than k
        matches = []
        for k in range(longest):
            rows = np.arange(upto[k])
            node = np.zeros(len(rows), dtype=np.int32)
            for d in range(1, longest - k + 1):
                m = np.searchsorted(rows, upto[k + d - 1]) if len(rows) else 0
                rows, node = rows[:m], self.next[node[:m], text[rows[:m], k + d - 1]]
                alive = node > 0
                rows, node = rows[alive], node[alive]
                if not len(rows):
                    break
                piece = self.piece[node]
                hit = piece >= 0
                if hit.any():
                    r, p = rows[hit], piece[hit]
                    alpha[k + d, r] = np.logaddexp(alpha[k + d, r], alpha[k, r] + log_p[p])
                    if counts is not None:
                        matches.append((k, d, r, p))
        total = alpha[size, np.arange(n)]
        if counts is not None:
            beta = np.full((longest + 1, n), -np.inf)
            beta[size, np.arange(n)] = 0
            for k, d, r, p in reversed(matches):
                beta[k, r] = np.logaddexp(beta[k, r], log_p[p] + beta[k + d, r])
            for k, d, r, p in matches:
                share = np.exp(alpha[k, r] + log_p[p] + beta[k + d, r] - total[r])
                expected += np.bincount(p, share * counts[r], len(expected))
        return total

    def _one(self, text: bytes, log_p: np.ndarray, count: float, expected: np.ndarray) -> float:
        """One long word, with running logs; the same sums as _many."""
        n, children, piece = len(text), self.children, self.piece
        add = lambda a, b: b if a == -math.inf else a if b == -math.inf else max(a, b) + math.log1p(math.exp(-abs(a - b)))
        alpha, arcs = [-math.inf] * (n + 1), []
        alpha[0] = 0.0
        for k in range(n):
            node = 0
            for d in range(k, n):
                node = children[node].get(text[d], 0)
                if not node:
                    break
                if (p := int(piece[node])) >= 0:
                    alpha[d + 1] = add(alpha[d + 1], alpha[k] + float(log_p[p]))
                    if count:
                        arcs.append((k, d + 1, p))
        if count:
            beta = [-math.inf] * n + [0.0]
            for k, e, p in reversed(arcs):
                beta[k] = add(beta[k], float(log_p[p]) + beta[e])
            for k, e, p in arcs:
                expected[p] += count * math.exp(alpha[k] + float(log_p[p]) + beta[e] - alpha[n])
        return alpha[n]


@functools.cache
def load(path: str) -> Lattice:
    with open(path, "rb") as f:
        return Lattice(Model(f.read()))


class _Counted:
    """Distinct words of a chunk, with their places and training counts."""

    def __init__(self, rows: pa.Table):
        self.words = Words(strings(rows.column("text")), lower=True)
        self.train = rows.column("train").to_numpy(zero_copy_only=False)
        self.doc = self.words.doc_of_word()
        self.keys, at, self.which = np.unique(self.words.hash, return_index=True, return_inverse=True)
        self.start, self.end = self.words.start[at], self.words.end[at]
        self.counts = np.bincount(self.which, self.train[self.doc], len(self.keys)).astype(np.int64)


def score_texts(docs: DataFrame, train: Column, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score, vocabulary_score) of every row; logs to base 10."""
    path = path or public_tokenizers.path(MODEL)
    spark = docs.sparkSession
    chunks = ledger.chunk_count(*ledger.measure(docs, text_col), parallelism(spark), CHUNK_BYTES)
    buckets = max(parallelism(spark), chunks)
    sides = -(-chunks // 64)
    kind = docs.schema[id_col].dataType.simpleString()
    dealt = docs.select(ledger.chunk_of(chunks, id_col, text_col).alias("chunk"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))

    def learn(key: tuple, rows: pa.Table) -> pa.Table:
        chunk, part, lattice = key[0].as_py(), _Counted(rows), load(path)
        known = part.counts > 0
        _, expected = lattice.words(part.words.data, part.start[known], part.end[known], lattice.log_weights(), part.counts[known])
        ends = int(part.train.sum())
        expected[-1] = ends
        micro = np.rint(expected * MICRO).astype(np.int64)
        used = np.flatnonzero(micro)
        side = pa.table([[-1 - chunk % sides], [chunk], [used.astype(np.uint64).tobytes()], [ledger.pack(micro[used])], [None]], names=["bucket", "chunk", "keys", "vals", "marks"])
        posted = ledger.posts(chunk, np.append(part.keys, END), np.append(part.counts, ends), buckets)
        return pa.concat_tables([posted, side.cast(posted.schema)])

    found = materialise(ledger.replies(dealt.groupBy("chunk").applyInArrow(learn, ledger.POST), ledger.add, lambda whole, own, mark: whole > 0, summary=True), "counts")

    def flat(batches):
        for batch in batches:
            keys, values = ledger.unpack(batch)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(values)], names=["piece", "n"])

    def totals(batches):
        for batch in batches:
            each = np.frombuffer(b"".join(batch.column("vals").to_pylist()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in each.sum(axis=0)], names=["v", "n"])

    both = found.filter(F.col("chunk") == ledger.SUMMARY).mapInArrow(totals, "v long, n long").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    distinct, tokens = int(both.v or 0), int(both.n or 0)
    pieces = found.filter(F.col("chunk") == ledger.SIDE).mapInArrow(flat, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # one row a piece at most
    expected = np.zeros(load(path).size + 1)
    for row in pieces:
        expected[row.piece] = row.n / MICRO
    names = ["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score", "vocabulary_score"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        part, lattice = _Counted(left), load(path)
        log_p = lattice.log_weights(expected)
        keys, values = ledger.sorted_reply(right)

        def counts(of: np.ndarray) -> np.ndarray:
            at = ledger.find(keys, of)
            return np.where(at >= 0, values[at], 0) if len(values) else np.zeros(len(of), np.int64)

        c, (end,) = counts(part.keys), counts(np.array([END])).tolist()
        base = lambda n: np.log10((n + 0.5) / (tokens + 0.5 * (distinct + 1)))
        marginal, _ = lattice.words(part.words.data, part.start, part.end, log_p)
        plain, _ = lattice.words(part.words.data, part.start, part.end, lattice.own)
        docs_here = left.num_rows
        each = lambda of: np.bincount(part.doc, of[part.which], docs_here)
        n = np.diff(part.words.first)
        return pa.table([left.column("id"), left.column("train"), pa.array(n + 1), pa.array(each(c > 0).astype(np.int64) + (end > 0)), pa.array(np.full(docs_here, tokens)), pa.array(each(base(c)) + base(end)), pa.array((each(marginal) + log_p[-1]) / math.log(10)), pa.array(each(plain) / math.log(10))], names=names)

    scored = dealt.groupBy("chunk").cogroup(found.filter("chunk >= 0").groupBy("chunk")).applyInArrow(score, f"id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, vocabulary_score double")
    return scored.withColumnRenamed("id", id_col)


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by word counts and by the piece lattice, both learned from four fifths."""
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    scored = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), ~out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "vocabulary_score")
