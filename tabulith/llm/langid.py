"""Language identification by prediction by partial matching.

For each language a variable-order context tree over bytes counts what follows the last 0 to
MAX_ORDER bytes. Its statistics are frozen after the fit. A text's code length under a language is
the sum over its bytes of -log2 p, where p comes from the longest context that was seen:
count / (total + distinct) for a byte seen there, else the escape probability
distinct / (total + distinct) times what the next shorter context says, and 1 / 256 below order 0.
The shortest code length wins. A text starts as after START, a byte that no text holds.

The trees of all languages are laid out together: contexts up to two bytes as rows of costs, those
of three as the costs of what was seen there and the cost of an escape, so that a byte of a text
takes a few lookups whatever the number of contexts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.llm import _spark
from tabulith.llm._words import slices

MAX_ORDER = 3
#: No byte of UTF-8.
START = 0xFF
#: Labelled documents of a language that the fit takes (about so many, by a hash of the id; all if there are fewer).
FIT_DOCS = 1500
#: Bytes whose costs are looked up at once, so that a long text takes no more memory than a short one.
CHUNK = 1 << 18


def shifted(s: np.ndarray, at: np.ndarray, start: int) -> list[np.ndarray]:
    """For each byte of some texts those 1 to MAX_ORDER before it; start before a text."""
    place = np.arange(len(s)) - np.repeat(at[:-1], np.diff(at))
    out = []
    for k in range(1, MAX_ORDER + 1):
        back = np.full_like(s, start)
        back[k:] = s[:-k] if k < len(s) else []
        back[place < k] = start
        out.append(back)
    return out


def contexts(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte the code of it (lowest) and of the MAX_ORDER bytes before it."""
    code = s.astype(np.uint32)
    for k, back in enumerate(shifted(s, at, START), 1):
        code |= back.astype(np.uint32) << np.uint32(8 * k)
    return code


def _estimated(counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each symbol (columns) in each context (rows) by counts, or by what the shorter context says; and of the escape."""
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    below = np.maximum(total + kinds, 1)
    escape = np.where(total > 0, kinds / below, 1.0)
    return np.where(counts > 0, counts / below, escape * lower), escape


@dataclass
class _Tables:
    of_byte: np.ndarray  # a byte's symbol; 0 for bytes that the fit never saw, of which none is told from another
    size: int  # symbols
    row: np.ndarray  # of two symbols: the row of their context, or of the longest that was seen
    node: np.ndarray  # of a row and the symbol before: the context of three, 0 if never seen
    gram: np.ndarray  # of a context of three and a symbol: its place after the rows' costs, 0 if never seen there
    cost: np.ndarray  # a column for each language
    escape: np.ndarray  # of a context of three


@dataclass
class Model:
    """Frozen statistics: for each language the counts of runs of MAX_ORDER + 1 bytes, as sorted codes and counts."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    _tables: _Tables | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    def tables(self) -> _Tables:
        if self._tables is None:
            every = np.unique(np.concatenate([g[0] for g in self.grams])).astype(np.uint32)
            seen = np.unique(np.append(every.view(np.uint8), np.uint8(START)))
            of_byte = np.zeros(256, np.uint8)
            of_byte[seen] = np.arange(1, len(seen) + 1)
            n = len(seen) + 1
            split = lambda codes: [of_byte[(codes >> np.uint32(8 * k)) & np.uint32(255)].astype(np.int64) for k in range(MAX_ORDER + 1)]
            x, b1, b2, b3 = split(every)
            pairs = np.unique(b2 * n + b1)
            rows = 1 + n + len(pairs)
            row = np.tile(1 + np.arange(n), n)  # order 1, by the last symbol
            row[pairs] = 1 + n + np.arange(len(pairs))
            nodes = np.unique(row[b2 * n + b1] * n + b3)
            node = np.zeros(rows * n, np.int32)
            node[nodes] = 1 + np.arange(len(nodes))
            at = node[row[b2 * n + b1] * n + b3] * np.int64(n) + x
            gram = np.zeros((len(nodes) + 1) * n, np.int32)
            gram[at] = rows * n + np.arange(len(every))
            cost = np.empty((rows * n + len(every), len(self.grams)), np.float32)
            escape = np.zeros((len(nodes) + 1, len(self.grams)), np.float32)
            for k, (codes, counts) in enumerate(self.grams):
                x, b1, b2, b3 = split(codes.astype(np.uint32))
                table = lambda context, size: np.bincount(context * n + x, counts, size * n).reshape(size, n)  # noqa: B023, E731
                p0, _ = _estimated(table(np.zeros_like(x), 1), np.full((1, n), 1 / 256))
                p1, _ = _estimated(table(b1, n), p0)
                p2, _ = _estimated(table(row[b2 * n + b1] - 1 - n, len(pairs)), p1[pairs % n])
                below = np.concatenate((p0, p1, p2))
                cost[: rows * n, k] = -np.log2(below).ravel()
                own = node[row[b2 * n + b1] * n + b3]
                total, kinds = np.bincount(own, counts, len(nodes) + 1), np.bincount(own, minlength=len(nodes) + 1)
                out = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
                escape[:, k] = -np.log2(out)
                number = np.zeros(len(every))
                number[np.searchsorted(every, codes.astype(np.uint32))] = counts
                of = at // n
                p = np.where(number > 0, number / np.maximum(total + kinds, 1)[of], out[of] * below.ravel()[nodes[of - 1] // n * n + at % n])
                cost[rows * n :, k] = -np.log2(p)
            self._tables = _Tables(of_byte, n, row.astype(np.int32), node, gram, cost, escape)
        return self._tables

    def forget(self) -> None:
        """Give up the tables: a worker keeps what it was sent, and other stages follow."""
        self._tables = None

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text's code length in bits under each language."""
        t = self.tables()
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        n, start = np.int32(t.size), t.of_byte[START]
        symbols = t.of_byte[data]
        for low in range(0, len(data), CHUNK):
            high = min(low + CHUNK, len(data))
            first = int(np.searchsorted(offsets, low, "right")) - 1
            last = int(np.searchsorted(offsets, high, "left"))
            a = max(int(offsets[first]), low - MAX_ORDER)
            at = np.clip(offsets[first : last + 1], a, high) - a
            s = symbols[a:high]
            b1, b2, b3 = (b.astype(np.int32) for b in shifted(s, at, start))
            row = t.row[b2 * n + b1]
            node = t.node[row * n + b3]
            place = t.gram[node * n + s]
            known = place > 0
            cost = t.cost[np.where(known, place, row * n + s)] + t.escape[np.where(known, 0, node)]
            cost = cost[low - a :]
            own = np.clip(offsets[first:last], low, high) - low
            full = np.flatnonzero(np.diff(np.append(own, high - low)) > 0)
            out[first + full] += np.add.reduceat(cost, own[full], axis=0, dtype=np.float64)
        return out


def _lettered(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def fit(labelled: DataFrame, label: str = "lang", docs_per_language: int = FIT_DOCS) -> Model:
    """The model of labelled (doc_id, text, label). Rows with a null text or label are left out.

    The fit's bound: about docs_per_language whole documents a language, those with the smallest
    hashes of doc_id. What reaches the driver is a count table for each language.
    """
    labelled = labelled.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}
    if not counts:
        return Model([], [])
    share = F.lit(0.0)
    for language, n in counts.items():
        share = F.when(F.col(label) == language, min(1.0, docs_per_language / n)).otherwise(share)
    taken = labelled.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)) < share)
    taken = _spark.stored(taken.select(F.col(label).alias("label"), "text"), "fit")

    def grams(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in rows:
            for part, data, at in slices(batch):
                codes = contexts(data, at)
                names = np.array(part.column(0).to_pylist(), object)
                for language in set(names):
                    got, n = np.unique(codes[np.repeat(names == language, np.diff(at))], return_counts=True)
                    if language in held:
                        got, n = np.concatenate([held[language][0], got]), np.concatenate([held[language][1], n])
                        got, where = np.unique(got, return_inverse=True)
                        n = np.bincount(where, n).astype(np.int64)
                    held[language] = got, n
        for language, (got, n) in held.items():
            yield pa.record_batch([pa.array([language] * len(got)), pa.array(got.astype(np.int64)), pa.array(n)], names=["label", "code", "n"])

    tables: dict[str, tuple[list[int], list[int]]] = {language: ([], []) for language in sorted(counts)}
    got = _spark.arrow_map(taken.select("label", "text"), grams, "label string, code long, n long").groupBy("label", "code").agg(F.sum("n").alias("n"))
    packed = got.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("t"))
    for label_, t in packed.select("label", F.struct(F.col("t.code"), F.col("t.n"))).collect():
        tables[label_] = t[0], t[1]
    found = {k: (np.array(c, np.uint32), np.array(n, np.int64)) for k, (c, n) in tables.items() if c}
    return Model(list(found), list(found.values()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score for every whole text (column text; nothing else is read).

    lang_pred: the language with the shortest code; ties go to the first in order. `und` with score
    0 where the text is null or has no letter, or where the model has no language. score: the share
    of the language in the sum of 2**-(code length / symbols * 16), i.e. the odds after sixteen
    average symbols. Other columns stay; lang_pred and score are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = np.array([*model.languages, "und"], object)

    def guess(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in rows:
            for part, data, at in slices(batch):
                best, score = np.full(part.num_rows, len(names) - 1), np.zeros(part.num_rows)
                if model.languages:
                    bits, n = model.lengths(data, at), np.diff(at)
                    ascii_, letters, full = ((data | 0x20) >= ord("a")) & ((data | 0x20) <= ord("z")), np.zeros(part.num_rows, bool), np.flatnonzero(np.diff(at))
                    if len(full):
                        letters[full] = np.logical_or.reduceat(ascii_, at[full])
                    for k in np.flatnonzero(~letters & (np.diff(at) > 0)):
                        letters[k] = _lettered(data[at[k] : at[k + 1]].tobytes())
                    mean = bits / np.maximum(n, 1)[:, None] * 16
                    odds = np.exp2(mean.min(1, keepdims=True) - mean)
                    best = np.where(letters, bits.argmin(1), best)
                    score = np.where(letters, odds.max(1) / odds.sum(1), 0.0)
                columns = [*part.columns, pa.array(names[best].tolist(), pa.string()), pa.array(score)]
                yield pa.record_batch(columns, names=[*part.schema.names, "lang_pred", "score"])
        model.forget()

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return _spark.arrow_map(docs, guess, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The documents that no model learns from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """predict() over docs with a model fitted to those of them that are not held out."""
    return predict(docs, fit(docs.select("doc_id", "text", "lang").where(~held_out())))
