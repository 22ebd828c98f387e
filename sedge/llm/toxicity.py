"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded, balanced sample of labelled rows gives the examples and, by chi-squared, the
terms (words, and their first letters, so that inflected forms meet): all that pass the test;
norms are over these terms. Document frequencies come from the whole corpus. An inverted index has
for each term the blocks of examples that hold it, each with its greatest weight and its postings
(example, weight). A text's bound on a block is the cosine it could reach at most: the sum over its
own terms of their weights times the block's greatest. Blocks are read by falling bounds, term by
term over postings, until none can change the nearest. Distance-weighted votes,
corrected for the sample's balance and calibrated on the examples themselves (each left out
of its own vote), give the score; the nearest examples are the evidence.

Defined cases: null and empty texts, and texts without any term, get the votes of no neighbour,
that is the calibrated prior; without labelled rows every score is 0; a label that
repeats counts once, as the largest; ties among examples go to the smaller doc_id;
repeated rows each give their row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, table

#: Labelled examples per class, at most, chosen by a hash of their id.
EXAMPLES = 2048
#: Least chi-squared (1 degree of freedom) of a term, and least examples that hold it.
LEAST_CHI = 6.6
LEAST_DF = 3
PREFIXES = (4, 5, 6)
BLOCK = 64
#: Blocks that each query reads first, by its own bounds.
FIRST = 3
NEIGHBOURS = 15
EVIDENCE = 3
BATCH = 512
#: Words whose terms a worker remembers.
REMEMBERED_WORDS = 200_000
#: Weight of the prior among the votes.
PRIOR_VOTES = 0.5
EVIDENCE_TYPE = T.ArrayType(T.StructType().add("doc_id", T.LongType()).add("cosine", T.DoubleType()).add("toxic", T.IntegerType()))
_WORD = re.compile(r"[^\W\d_]+")


def terms_of_word(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


class Known(dict):
    """The terms of words, of a vocabulary's if there is one; remembered for a bounded number of words."""

    def __init__(self, vocabulary: dict[str, int] | None = None):
        super().__init__()
        self.vocabulary = vocabulary
        # All terms of a word begin with its own first letters.
        self.heads = None if vocabulary is None else {t.rstrip("*")[: PREFIXES[0]] for t in vocabulary}

    def __missing__(self, word: str):
        got: list | tuple = ()
        if self.vocabulary is None:
            got = terms_of_word(word)
        elif word[: PREFIXES[0]] in self.heads:
            got = [self.vocabulary[t] for t in terms_of_word(word) if t in self.vocabulary] or ()
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        self[word] = got
        return got


class TermCounter:
    """Counts the terms of texts."""

    def __init__(self, vocabulary: dict[str, int] | None = None):
        self.ids = Known(vocabulary).__getitem__

    def terms(self, text: str | None) -> Iterator:
        """The terms of each word of a text, one after the other."""
        return chain.from_iterable(map(self.ids, _WORD.findall((text or "").lower())))

    def __call__(self, text: str | None) -> dict:
        return Counter(self.terms(text))

    def present(self, text: str | None) -> set:
        return set(self.terms(text))


@dataclass
class Sparse:
    """Rows of weights at terms."""

    start: np.ndarray  # of each row, and the end
    at: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, x: Sparse | np.ndarray) -> Sparse:
        if isinstance(x, Sparse):
            return x
        row, at = np.nonzero(x)
        return cls(np.searchsorted(row, np.arange(len(x) + 1)), at, x[row, at])

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, rows: np.ndarray) -> Sparse:
        size = np.diff(self.start)[rows]
        start = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(start[-1]) + np.repeat(self.start[:-1][rows] - start[:-1], size)
        return Sparse(start, self.at[place], self.weight[place])

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))


@dataclass
class Postings:
    """Per term, the blocks that hold it with their greatest weights; per term and block, examples and weights."""

    blocks: np.ndarray  # of the entries, which stand by term, then block
    most: np.ndarray  # weight of each entry
    first: np.ndarray  # entry of each term, and the end
    start: np.ndarray  # posting of each entry, and the end
    example: np.ndarray  # place within the block
    weight: np.ndarray
    entry: np.ndarray  # block, term: the entry, or one past all

    @classmethod
    def of(cls, vectors: Sparse, terms: int) -> Postings:
        row = vectors.row_of()
        order = np.lexsort((row, row // BLOCK, vectors.at))
        row, at, weight = row[order], vectors.at[order], vectors.weight[order]
        block = row // BLOCK
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(block) != 0)])) if len(at) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(weight, new) if len(new) else np.zeros(0)
        entry = np.full((-(-len(vectors) // BLOCK), terms), len(new))
        entry[block[new], at[new]] = np.arange(len(new))
        return cls(block[new], most, np.searchsorted(at[new], np.arange(terms + 1)), np.append(new, len(at)), row % BLOCK, weight, entry)

    @staticmethod
    def spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ranges, and which place, all ranges one after the other."""
        size = end - start
        of = np.repeat(np.arange(len(size)), size)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size - start, size)

    def bounds(self, queries: Sparse) -> np.ndarray:
        """The cosine that each query could reach with an example of each block, at most."""
        n, of = len(self.entry), queries.row_of()
        which, entry = self.spread(self.first[queries.at], self.first[queries.at + 1])
        return np.bincount(of[which] * n + self.blocks[entry], queries.weight[which] * self.most[entry], minlength=len(queries) * n).reshape(-1, n)

    def scores(self, queries: Sparse, block: int) -> np.ndarray:
        """Cosines of queries and a block's examples, by the queries' own terms."""
        entry, of = self.entry[block, queries.at], queries.row_of()
        held = entry < len(self.most)
        entry, of, weight = entry[held], of[held], queries.weight[held]
        which, at = self.spread(self.start[entry], self.start[entry + 1])
        return np.bincount(of[which] * BLOCK + self.example[at], weight[which] * self.weight[at], minlength=len(queries) * BLOCK).reshape(-1, BLOCK)


@dataclass
class Index:
    """Examples as unit TF-IDF vectors, their votes, and the inverted index over them."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: Sparse  # of each example
    votes: np.ndarray  # of each example
    prior: float
    slope: float = 1.0
    shift: float = 0.0
    postings: Postings | None = None

    def __post_init__(self):
        self.vectors = Sparse.of(self.vectors)

    def __getstate__(self):
        return self.__dict__ | {"postings": None}

    def inverted(self) -> Postings:
        if self.postings is None:
            self.postings = Postings.of(self.vectors, len(self.idf))
        return self.postings

    def vector(self, counts: list[dict[int, int]]) -> Sparse:
        size = [len(c) for c in counts]
        at = np.array([t for c in counts for t in c.keys()], dtype=np.int64)
        return self.unit(np.concatenate([[0], np.cumsum(size)]).astype(np.int64), at, np.array([n for c in counts for n in c.values()], dtype=np.float64))

    def unit(self, start: np.ndarray, at: np.ndarray, n: np.ndarray) -> Sparse:
        out = Sparse(start, at, (1 + np.log(n)) * self.idf[at])
        row = out.row_of()
        out.weight /= np.sqrt(np.bincount(row, out.weight**2, minlength=len(out)))[row]
        return out

    def nearest(self, queries: Sparse | np.ndarray, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine (rounded to 12 digits; ties to the first), and the cosines; 0 where there is none."""
        queries, index = Sparse.of(queries), self.inverted()
        n = len(queries)
        best, who = np.zeros((n, k)), np.full((n, k), len(self.ids))
        if not len(index.entry) or not n:
            return who, best
        bounds = index.bounds(queries) + 1e-9

        def read(b: int, rows: np.ndarray) -> None:
            at = b * BLOCK
            scores = np.round(index.scores(queries.take(rows), b), 12)
            if without is not None:
                scores[np.arange(at, at + BLOCK) == without[rows, None]] = 0
            new = scores.max(axis=1) >= best[rows, -1]
            rows, scores = rows[new], scores[new]
            s = np.concatenate([best[rows], scores], axis=1)
            w = np.concatenate([who[rows], np.broadcast_to(np.arange(at, at + BLOCK), scores.shape)], axis=1)
            w = np.where(s > 0, w, len(self.ids))
            top = np.lexsort((w, -s), axis=1)[:, :k]
            best[rows], who[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(w, top, 1)

        # The blocks of greatest bounds first, by query; then block by block what could still change the nearest.
        order = np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST]
        for r in range(order.shape[1]):
            for b in np.unique(order[:, r]):
                rows = np.flatnonzero((order[:, r] == b) & (bounds[:, b] >= best[:, -1]) & (bounds[:, b] > 2e-9))
                if len(rows):
                    read(b, rows)
        for b in np.argsort(-bounds.max(axis=0), kind="stable"):
            rows = np.flatnonzero((bounds[:, b] >= best[:, -1]) & (bounds[:, b] > 2e-9) & (order != b).all(axis=1))
            if len(rows):
                read(b, rows)
        return who, best

    def voted(self, who: np.ndarray, best: np.ndarray) -> np.ndarray:
        votes = best * best * np.concatenate([self.votes, [0.0]])[who]
        toxic = np.concatenate([self.labels, [0]])[who]
        return (PRIOR_VOTES * self.prior + (votes * toxic).sum(axis=1)) / (PRIOR_VOTES + votes.sum(axis=1))

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        x = _logit(raw) * self.slope + self.shift
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _platt(raw: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Logistic regression of labels on the votes' log odds, a little drawn to slope 1 and shift 0, by Newton's method."""
    x = np.stack([_logit(raw), np.ones(len(raw))], axis=1)
    theta, start, ridge = np.array([1.0, 0.0]), np.array([1.0, 0.0]), 1e-2 * weights.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        grad = x.T @ (weights * (p - labels)) + ridge * (theta - start)
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta - step
        if np.abs(step).max() < 1e-10:
            break
    return float(max(theta[0], 0.1)), float(theta[1])


def _counted(df: DataFrame, id_columns: list[str]) -> DataFrame:
    """(id columns, term, n) of the texts of ``df``."""
    schema = df.select(*id_columns).schema.add("term", "string").add("n", "long")

    def run(batches):
        count = TermCounter()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a in range(0, batch.num_rows, 200):
                at, terms, ns = [], [], []
                for i in range(a, min(a + 200, batch.num_rows)):
                    c = count(texts[i].as_py())
                    at += [i] * len(c)
                    terms += c.keys()
                    ns += c.values()
                part = batch.select(id_columns).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(terms, pa.string()), pa.array(ns, pa.int64())], schema.names)

    return df.select(*id_columns, "text").mapInArrow(run, schema)


def corpus_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """Documents of the whole corpus that hold each term, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches):
        count, sums, n = TermCounter(shared.value), np.zeros(len(shared.value) + 1, dtype=np.int64), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                held: list[int] = []
                for text in batch.column(0).slice(a, 256):
                    n += 1
                    held += count.present(text.as_py())
                if held:
                    sums[:-1] += np.bincount(held, minlength=len(shared.value))
        sums[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], ["term", "n"])

    got = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return out[:-1], int(out[-1])


def term_counts(docs: DataFrame, vocabulary: list[str], columns: list[str]) -> DataFrame:
    """``columns`` with each text's terms (``_at``) and how often it has them (``_n``)."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    kind = T.ArrayType(T.IntegerType())
    taken = docs.select(*columns, F.col("text").alias("_text"))
    schema = taken.drop("_text").schema.add("_at", kind).add("_n", kind)

    def run(batches):
        count = TermCounter(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                counts = [count(t.as_py()) for t in part.column(part.num_columns - 1)]
                start = pa.array(np.cumsum([0, *map(len, counts)]), pa.int32())
                lists = [pa.ListArray.from_arrays(start, pa.array([x for c in counts for x in of(c)], pa.int32())) for of in (dict.keys, dict.values)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *lists], schema.names)

    return taken.mapInArrow(run, schema)


def summed(counted: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """What ``corpus_frequencies`` gives, from the documents' own terms."""

    def run(batches):
        sums = np.zeros(terms + 1, dtype=np.int64)
        for batch in batches:
            sums[:-1] += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
            sums[-1] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], ["term", "n"])

    got = counted.select("_at").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(terms + 1, dtype=np.int64)
    out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, labels: DataFrame, frequencies=corpus_frequencies) -> Index:
    """``labels`` has doc_id and toxic; ``docs`` has doc_id and text and is the corpus, whose ``frequencies`` are asked for."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0
    picks = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES) for c in (0, 1)]
    sample = picks[0].unionByName(picks[1])  # 2 * EXAMPLES rows of two numbers at most
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    counted = keep(_counted(texts, ["doc_id", "toxic"]), "examples")
    per = counted.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    n1, n0 = (float(min(EXAMPLES, sizes.get(c, 0))) for c in (1, 0))
    if not n1 or not n0:
        return Index({}, np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), prior)
    a, b = F.col("a"), F.col("b")
    chi = (a * (n0 - b) - b * (n1 - a)) ** 2 * (n1 + n0) / (n1 * n0 * (a + b) * (n1 + n0 - a - b) + 1e-9)
    chosen = per.where(a + b >= LEAST_DF).withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI).orderBy(F.col("chi").desc(), "term")
    terms = [r.term for r in chosen.select("term").collect()]
    df, n = frequencies(docs, terms)
    idf = np.log((n + 1) / (df + 1)) + 1
    vocabulary = {t: i for i, t in enumerate(terms)}
    shared = docs.sparkSession.createDataFrame(pa.table({"term": pa.array(terms, pa.string()), "at": pa.array(np.arange(len(terms)), pa.int64())}))
    # Bounded: examples by their own terms. Of texts that share an id, the one that has a term most often counts.
    got = counted.join(shared, "term").groupBy("doc_id", "at").agg(F.max("n").alias("n")).orderBy("doc_id", "at").toArrow()
    doc, at, n = (got.column(c).to_numpy() for c in ("doc_id", "at", "n"))
    rows = sorted((r.doc_id, r.toxic) for r in sample.collect())
    filled, start = np.unique(doc, return_index=True)
    index = Index(vocabulary, idf, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(idf))), np.zeros(0), prior)
    own = index.unit(np.append(start, len(doc)), at, n.astype(np.float64))
    # Blocks hold examples with the same strongest term, so that few blocks reach far.
    by = np.lexsort((at, -own.weight, own.row_of()))[own.start[:-1]]
    order = np.lexsort((filled, at[by])) if len(filled) else np.zeros(0, np.int64)
    label = dict(rows)
    ids = filled[order].astype(np.int64)
    y = np.array([label[d] for d in ids.tolist()], dtype=np.int64)
    share = n1 / (n1 + n0)
    votes = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    index = Index(vocabulary, idf, ids, y, own.take(order), votes, prior)
    # Examples without any term are not indexed but count for the calibration.
    everyone = np.array([t for _, t in rows])
    raw = np.full(len(rows), index.prior)
    place = {d: i for i, (d, _) in enumerate(rows)}
    for s in range(0, len(ids), BATCH):
        raw[[place[d] for d in ids[s : s + BATCH]]] = index.voted(*index.nearest(index.vectors.take(np.arange(s, min(s + BATCH, len(ids)))), NEIGHBOURS, np.arange(s, min(s + BATCH, len(ids)))))
    index.slope, index.shift = _platt(raw, everyone, np.where(everyone == 1, prior / share, (1 - prior) / (1 - share)))
    return index


def score(docs: DataFrame, index: Index, columns: list[str], counted: bool = False) -> DataFrame:
    """Adds score, predicted and evidence (nearest examples: doc_id, cosine, toxic) to ``columns``; ``counted`` documents come from ``term_counts``."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    taken = docs.select(*columns, *(["_at", "_n"] if counted else [F.col("text").alias("_text")]))
    schema = taken.drop("_text", "_at", "_n").schema.add("score", "double").add("predicted", T.IntegerType()).add("evidence", EVIDENCE_TYPE)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        index = shared.value
        count = TermCounter(index.vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                raw, seen = np.full(part.num_rows, index.prior), [[]] * part.num_rows
                if len(index.ids):
                    if counted:
                        at, n = part.columns[-2:]
                        start = np.cumsum([0, *pc.list_value_length(at).to_pylist()]).astype(np.int64)
                        vectors = index.unit(start, at.flatten().to_numpy().astype(np.int64), n.flatten().to_numpy().astype(np.float64))
                    else:
                        vectors = index.vector([count(t.as_py()) for t in part.column(part.num_columns - 1)])
                    who, best = index.nearest(vectors, NEIGHBOURS)
                    raw = index.voted(who, best)
                    seen = [[(int(index.ids[w]), float(c), int(index.labels[w])) for w, c in zip(ws, cs, strict=True) if c > 0] for ws, cs in zip(who[:, :EVIDENCE], best[:, :EVIDENCE], strict=True)]
                p = index.calibrated(raw) if index.prior else np.zeros(part.num_rows)
                evidence = pa.array([[{"doc_id": d, "cosine": c, "toxic": t} for d, c, t in x] for x in seen], kind)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(schema) - 3], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), evidence], schema.names)

    return taken.mapInArrow(run, schema)


def _held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    columns, made = ["doc_id", "held_out"], []

    def frequencies(docs: DataFrame, terms: list[str]) -> tuple[np.ndarray, int]:
        made.append(keep(term_counts(docs.withColumn("held_out", _held_out()), terms, columns), "counts"))
        return summed(made[0], len(terms))

    index = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~_held_out()), frequencies)
    # Texts are split once; without labels of both kinds there are no terms and nothing was counted.
    scored = score(made[0], index, columns, counted=True) if made else score(docs.withColumn("held_out", _held_out()), index, columns)
    return scored.select("doc_id", "held_out", "score", "predicted", "evidence")


QUERIES = {"op4_toxicity": op4}
ORACLES: dict[str, str] = {}
