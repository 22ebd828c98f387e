"""Language identification of mixed-language text.

A word's script narrows its candidate languages; hashed letter trigrams score it in
each; Viterbi with a penalty for switching labels the words, and runs of one label
are spans. The document's language is the one that labels most of its letters.

Defined cases: a null text, or one without letters, is ``und`` with score 0; if no
training row has a language, every row is ``und``; ties go to the language first in
order; repeated rows each give their row; other columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shielded, table, text_slices, trimmed

UNKNOWN = "und"
#: About so many labelled rows are learned from, chosen by a hash of their id.
TRAIN_ROWS = 20_000
BUCKETS = 1 << 15
#: Price, in nats, of a change of language between two words.
SWITCH = 8.0
#: A language uses a script if so large a share of its training words is written in it.
SCRIPT_SHARE = 0.01
#: Words that are labelled side by side; longer texts are joined from such segments, exactly.
SEGMENT = 64
CHUNK_CHARS = 500_000
NEVER = -1e4
# First code points of the Unicode blocks that tell scripts apart.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0x20000, "han"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([a for a, _ in SCRIPTS], dtype=np.uint32)
_IDS = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS], dtype=np.int64)


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket, language: log probability, less its mean over languages
    uses: np.ndarray  # script, language

    def words(self, text: Words) -> np.ndarray:
        """A score for each word and language; a language that doesn't use the word's script is out, unless none does."""
        out = np.add.reduceat(self.scores[text.grams], text.starts, axis=0) if len(text.starts) else np.zeros((0, len(self.languages)))
        allowed = self.uses[text.scripts]
        return np.where(allowed | ~allowed.any(axis=1, keepdims=True), out, NEVER)


@dataclass(frozen=True)
class Words:
    """Words of several texts: trigram buckets letter by letter, each word's first letter, its script and its text."""

    grams: np.ndarray
    starts: np.ndarray
    scripts: np.ndarray
    first: np.ndarray  # first word of each text, and the number of words


def words_of(texts: list[str]) -> Words:
    low = [t.lower() for t in texts]
    points = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _letters()[points]
    c = np.where(is_letter, points, 0).astype(np.uint32)
    with np.errstate(over="ignore"):
        mixed = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    at = np.flatnonzero(is_letter[1:-1])
    grams = (mixed[at] >> np.uint32(17)).astype(np.int64)
    start = np.flatnonzero(~is_letter[at])  # a letter after something else, in whole-array positions one less
    place = at[start] + 1
    ends = np.cumsum([len(t) + 1 for t in low])
    first = np.searchsorted(place, np.concatenate([[0], ends]) + 1)
    return Words(grams, start, _IDS[np.searchsorted(_STARTS, points[place], side="right") - 1], first)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; ``first`` has each text's first word and, last, the number of words.

    Texts are cut into segments; each segment's best paths between all pairs of labels are found
    side by side, then joined along each text, so that the result is that of one long pass.
    """
    n_words, k = scores.shape
    counts = np.diff(first)
    parts = -(-counts // SEGMENT)
    doc = np.repeat(np.arange(len(counts)), parts)
    part = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[doc] + part * SEGMENT
    width = np.minimum(SEGMENT, first[doc + 1] - begin)
    at = begin[:, None] + np.arange(SEGMENT)
    real = np.arange(SEGMENT) < width[:, None]
    padded = np.where(real[..., None], scores[np.minimum(at, max(n_words - 1, 0))], 0.0)
    v = np.full((len(doc), k, k), -np.inf)
    v[:, np.arange(k), np.arange(k)] = 0.0
    for t in range(SEGMENT):
        v = np.maximum(v, v.max(axis=2, keepdims=True) - switch) + padded[:, None, t, :]
    total, back = np.zeros((len(counts), k)), np.zeros((len(doc), k), dtype=np.int64)
    offset = np.cumsum(parts) - parts
    longest = int(parts.max(initial=0))
    for p in range(longest):
        d = np.flatnonzero(parts > p)
        paths = total[d][:, :, None] + v[offset[d] + p]
        back[offset[d] + p] = paths.argmax(axis=1)
        total[d] = paths.max(axis=1)
    end, start = np.zeros(len(doc), dtype=np.int64), np.zeros(len(doc), dtype=np.int64)
    now = total.argmax(axis=1)
    for p in range(longest - 1, -1, -1):
        d = np.flatnonzero(parts > p)
        end[offset[d] + p] = now[d]
        now[d] = start[offset[d] + p] = back[offset[d] + p, now[d]]
    one, rows = np.full((len(doc), k), -np.inf), np.arange(len(doc))
    one[rows, start] = 0.0
    came = np.zeros((SEGMENT, len(doc), k), dtype=np.int8)
    for t in range(SEGMENT):
        best = one.argmax(axis=1)
        moved = one[rows, best][:, None] - switch
        came[t] = np.where(one >= moved, np.arange(k), best[:, None])
        one = np.maximum(one, moved) + padded[:, t]
    labels = np.zeros((len(doc), SEGMENT), dtype=np.int64)
    for t in range(SEGMENT - 1, -1, -1):
        labels[:, t] = end
        end = came[t, rows, end].astype(np.int64)
    out = np.zeros(n_words, dtype=np.int64)
    out[at[real]] = labels[real]
    return out


def _chunks(texts: list[str | None]):
    """Runs of texts of about CHUNK_CHARS, one longer text at most beyond that."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= CHUNK_CHARS or i + 1 == len(texts):
            yield at, [x or "" for x in texts[at : i + 1]]
            at, held = i + 1, 0


def fit(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from ``text`` and ``lang`` of about ``train_rows`` rows, chosen by a hash of ``doc_id``."""
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.where(F.col("lang").isNotNull()).count()
    if n > train_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * train_rows / n))

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for _, some in _chunks([t for a, t in zip(langs, texts, strict=True) if a == lang]):
                    w = words_of(some)
                    sums = held.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), dtype=np.int64))
                    sums[:BUCKETS] += np.bincount(w.grams, minlength=BUCKETS)
                    sums[BUCKETS:] += np.bincount(w.scripts, minlength=len(SCRIPT_NAMES))
        for lang, sums in held.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], ["lang", "bucket", "n"])

    got = known.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), max(1, len(languages))))
    index = {x: i for i, x in enumerate(languages)}
    counts[got.column("bucket").to_numpy(), [index[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    grams, scripts = counts[:BUCKETS] + 0.1, counts[BUCKETS:]
    logs = np.log(grams / grams.sum(axis=0))
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32), uses & (scripts > 0))


def label(model: Model, texts: list[str | None], spans: bool = False) -> list[tuple]:
    """(language, score) of each text; with ``spans`` also its (first word, words, language) runs.

    The score is the mean of the language's share of the letters and its probability in the whole text.
    """
    out: list[tuple] = []
    for _, some in _chunks(texts):
        w = words_of(some)
        scores = model.words(w)
        labels = viterbi(scores, w.first) if model.languages else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.concatenate([w.starts, [len(w.grams)]]))
        k = len(model.languages)
        doc = np.repeat(np.arange(len(some)), np.diff(w.first))
        if k:
            letters = np.bincount(doc * k + labels, weights=sizes, minlength=len(some) * k).reshape(-1, k)
            sums = np.stack([np.bincount(doc, weights=scores[:, i], minlength=len(some)) for i in range(k)], axis=1)
        for i in range(len(some)):
            if not k or w.first[i] == w.first[i + 1]:
                out.append((UNKNOWN, 0.0, []) if spans else (UNKNOWN, 0.0))
                continue
            best = int(letters[i].argmax())
            odds = np.exp(sums[i] - sums[i].max())
            score = float(min(1.0, (letters[i, best] / letters[i].sum() + odds[best] / odds.sum()) / 2))
            row = (model.languages[best], score)
            if spans:
                own = labels[w.first[i] : w.first[i + 1]]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
                row = (*row, [(int(a), int(b - a), model.languages[own[a]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            out.append(row)
    return out


def predict(docs: DataFrame, model: Model, keep: list[str], least: float | None = None) -> DataFrame:
    """Adds lang_pred and score to the columns ``keep`` of ``docs``, which has a column text; ``least`` lets only rows of a known language and such a score through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = "text" in keep
    taken = docs.select(*keep) if own else docs.select(*keep, "text")
    at = taken.columns.index("text")
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, at, CHUNK_CHARS):
                found = label(shared.value, part.column(at).to_pylist())
                columns = [c for i, c in enumerate(part.columns) if own or i != at]
                out = pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], schema.names)
                yield out if least is None else out.filter(pa.array([x[0] != UNKNOWN and x[1] >= least for x in found], pa.bool_()))

    return taken.mapInArrow(trimmed(run), schema)


def _held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def fit_documents(docs: DataFrame) -> Model:
    return fit(docs.select("doc_id", "text", "lang").where(~_held_out()))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs.withColumn("held_out", _held_out()), fit_documents(docs), ["doc_id", "held_out"])


#: Documents of no language go, and those whose words no language holds together.
LEAST_SCORE = 0.4


@shielded
def kept(docs: DataFrame) -> DataFrame:
    """Documents whose language is known and certain enough, with their own columns."""
    return predict(docs, fit_documents(docs), docs.columns, LEAST_SCORE).select(*docs.columns)


QUERIES = {"op3_language": op3}
ORACLES: dict[str, str] = {}
