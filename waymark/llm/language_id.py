"""Language identification by error-correcting output codes.

Each language has a codeword; each bit has a binary classifier, a naive Bayes log-odds over hashed byte 2- and 3-grams
of the lower-cased text. A text's language is the codeword of the least weighted loss, where a bit counts for a language
as much as a classifier of the other training documents is right on a fourth of them. All training documents are counted,
whole, by Spark; only tables of languages x buckets reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import map_rows, plain_documents, read_table

#: Buckets for each n-gram length; a power of two.
BUCKETS = 1 << 14
LENGTHS = (2, 3)
#: More learned languages than this are refused: the model's size is LANGUAGES x BUCKETS x 2.
MAX_LANGUAGES = 256
#: Up to so many languages the code holds every split of them; beyond, seeded random codewords.
EXHAUSTIVE = 7
SMOOTHING = 0.5
#: Factor on the mean log-odds of a text's n-grams.
SHARPNESS = 8.0
#: Log-odds of an n-gram are held within this, so a foreign passage can't outweigh the rest of a text.
CLIP = 1.0
#: Factor on the differences of losses in the score.
CONFIDENCE = 2.0
#: A text is flagged as ambiguous if its score is under this.
AMBIGUOUS = 0.6
#: n-grams are looked up in runs of so many.
RUN = 1 << 16
#: The remainder of a doc_id's checksum by HELD_OUT_OF that is held out, and the one whose documents weigh the bits.
HELD_OUT_OF, HELD_OUT, WEIGHS = 5, 0, 1
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, second string, margin double, ambiguous boolean"
_BLANKED = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_LETTER = regex.compile(r"\p{L}")


def buckets_of(text: str) -> np.ndarray:
    """The bucket of every n-gram of the text."""
    data = np.frombuffer(b" " + text.lower().encode().translate(_BLANKED) + b" ", dtype=np.uint8).astype(np.uint32)
    out = []
    for k, n in enumerate(LENGTHS):
        key = np.zeros(max(0, len(data) - n + 1), dtype=np.uint32)
        for j in range(n):
            key = key * np.uint32(257) + data[j : j + len(key)]
        out.append((key * np.uint32(2_654_435_761)) >> np.uint32(32 - BUCKETS.bit_length() + 1) | np.uint32(k * BUCKETS))
    return np.concatenate(out)


def code_matrix(n: int) -> np.ndarray:
    """Codewords of n languages as rows of +1 and -1; no column is constant."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= EXHAUSTIVE:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, dtype=np.int8).T
    rng = np.random.default_rng(7)
    bits, best, least = int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, bits))
        code = code[:, np.abs(code.sum(axis=0, dtype=int)) < n]
        apart = (code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2
        apart[np.diag_indices(n)] = bits
        if apart.min() > least:
            best, least = code, apart.min()
    return best


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: n-grams of each language's training documents, languages x (buckets of all lengths)."""
        self.languages, self.code = languages, code_matrix(len(languages))
        if languages:
            share = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * counts.shape[1])
            positive, negative = (self.code > 0).astype(float), (self.code < 0).astype(float)
            mean = lambda side: (side.T @ share) / np.maximum(side.sum(axis=0), 1)[:, None]
            odds = np.log(mean(positive)) - np.log(mean(negative)) if len(languages) > 1 else np.zeros((1, counts.shape[1]))
            self.weights = (SHARPNESS * np.clip(odds.T, -CLIP, CLIP)).astype(np.float32)
        self.bit_weights = np.full(self.code.shape, 1 / self.code.shape[1])

    def set_accuracy(self, accuracy: np.ndarray) -> None:
        """accuracy: languages x bits, how often each bit is right on each language's training documents."""
        self.bit_weights = accuracy / np.maximum(accuracy.sum(axis=1, keepdims=True), 1e-9)

    def margins(self, text: str) -> np.ndarray:
        """For each bit the mean log-odds of the text's n-grams."""
        at = buckets_of(text)
        total = np.zeros(self.weights.shape[1])
        for lo in range(0, len(at), RUN):
            total += self.weights[at[lo : lo + RUN]].sum(axis=0, dtype=np.float64)
        return total / max(1, len(at))

    def decode(self, margins: np.ndarray) -> tuple[str, float, str | None, float]:
        """(language, score, second language, margin of the losses)."""
        losses = (self.bit_weights * np.logaddexp(0, -self.code * margins)).sum(axis=1)
        order = np.argsort(losses, kind="stable")
        odds = np.exp(-CONFIDENCE * (losses - losses[order[0]]))
        second = order[1] if len(order) > 1 else None
        return self.languages[order[0]], float(1 / odds.sum()), None if second is None else self.languages[second], 0.0 if second is None else float(losses[second] - losses[order[0]])


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def train(labelled: DataFrame) -> Model:
    """A model of all rows (text, lang, weighs) that have a text and a language; bits are weighed by rows that weigh, with classifiers of the others."""

    def count(batches: Iterator[pa.RecordBatch]):
        tables: dict[tuple[str, bool], np.ndarray] = {}
        for batch in batches:
            for text, lang, weighs in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "weighs")), strict=True):
                if has_letter(text):
                    at = buckets_of(text)
                    own = tables.setdefault((lang, weighs), np.zeros(BUCKETS * len(LENGTHS), dtype=np.int64))
                    for lo in range(0, len(at), RUN):
                        own += np.bincount(at[lo : lo + RUN], minlength=len(own)) if len(at) > 2048 else 0
                    if len(at) <= 2048:
                        np.add.at(own, at, 1)
        for (lang, weighs), own in tables.items():
            at = np.flatnonzero(own)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array([weighs] * len(at), pa.bool_()), pa.array(at), pa.array(own[at])], ["lang", "weighs", "bucket", "n"])

    rows = labelled.select("text", "lang", "weighs")
    summed = map_rows(rows, count, "lang string, weighs boolean, bucket bigint, n bigint").groupBy("lang", "weighs", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    found = summed.toPandas()  # 2 * languages x buckets rows at most
    languages = [x for x in languages if x in set(found["lang"])]
    counts = np.zeros((2, len(languages), BUCKETS * len(LENGTHS)))
    counts[found["weighs"].to_numpy(dtype=np.int64), found["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(dtype=np.int64), found["bucket"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    model = Model(languages, counts.sum(axis=0))
    if len(languages) > 1:
        model.set_accuracy(_accuracy(rows.filter("weighs"), Model(languages, counts[0])))
    return model


def _accuracy(rows: DataFrame, model: Model) -> np.ndarray:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def check(batches: Iterator[pa.RecordBatch]):
        own = shared.value
        place = {x: k for k, x in enumerate(own.languages)}
        right, total = np.zeros(own.code.shape, dtype=np.int64), np.zeros(len(own.languages), dtype=np.int64)
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if has_letter(text):
                    right[place[lang]] += own.margins(text) * own.code[place[lang]] > 0
                    total[place[lang]] += 1
        k, b = (x.ravel() for x in np.indices(right.shape))
        yield pa.record_batch([pa.array(k), pa.array(b), pa.array(right.ravel()), pa.array(total[k])], ["k", "b", "n_right", "n"])

    found = map_rows(rows, check, "k bigint, b bigint, n_right bigint, n bigint").groupBy("k", "b").agg(F.sum("n_right").alias("n_right"), F.sum("n").alias("n")).toPandas()
    out = np.zeros(model.code.shape)
    out[found["k"], found["b"]] = (found["n_right"] + 1) / (found["n"] + 2)
    return out


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF


def identify(docs: DataFrame) -> DataFrame:
    """One row for each row of docs with its predicted language, score and whether it's ambiguous.

    Learns from rows that aren't held out and whose lang and doc_id aren't null. A text that is null or has no letter gets
    ``und`` and score 0, as every text does if there is nothing to learn from. Repeated rows each give a row, and count
    as often in training. Of languages with equal losses the first in the alphabet is taken. A very long text is looked up in
    runs. More than MAX_LANGUAGES learned languages raise an error.
    """
    rows = plain_documents(docs, "doc_id", "text", "lang")
    rows = rows.withColumns({"held_out": F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)), "weighs": F.coalesce(remainder(F.col("doc_id")) == WEIGHS, F.lit(False))})
    model = train(rows.filter("NOT held_out AND doc_id IS NOT NULL AND lang IS NOT NULL"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]):
        own = shared.value
        for batch in batches:
            out = [own.decode(own.margins(t)) if own.languages and has_letter(t) else ("und", 0.0, None, 0.0) for t in batch.column("text").to_pylist()]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.float64()), pa.array([s < AMBIGUOUS for s in columns[1]], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "second", "margin", "ambiguous"],
            )

    return map_rows(rows.select("doc_id", "text", "held_out"), predict, SCHEMA)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}
