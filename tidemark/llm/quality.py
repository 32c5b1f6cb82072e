"""Quality classifier by compression: zstandard dictionaries of good and bad text.

Two dictionaries are trained, one on texts labelled good and one on texts labelled bad. Every text is compressed whole,
in blocks of ``BLOCK`` bytes, with either dictionary and with none. The difference of the compressed sizes, normalised by
the text's size, is calibrated to a probability by logistic regression over that difference, the normalised sizes and
the logarithm of the length, with their products. Both steps learn from a sample of at most about ``fit_rows`` labelled
rows in order of a hash, whole texts of at most ``fit_chars`` code points, never from held-out rows: one half of it
makes the dictionaries, of at most ``dictionary_text`` bytes of either label in pieces from all over the texts, and the
other half calibrates (all of it does both if a half has fewer than ``LEAST`` of a label). Scoring reads every text to
its end.

Defined cases: null text counts as empty and gets the calibrated score of an empty text; if no labelled row of either
kind exists the score is 0.5 for all; repeated rows get equal scores; a null ``doc_id`` is not held out; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table, text_or_empty
from tidemark.llm.labelled import held_out, teaching_sample

BLOCK = 4096
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
#: Bytes of the pieces of text that dictionaries are made of.
PIECE = 1024
#: Rows of a label that a half of the sample needs.
LEAST = 20


class CompressionClassifier:
    def __init__(self, fit_rows: int = 4000, fit_chars: int = 60_000, dictionary_text: int = 8 << 20):
        self.fit_rows, self.fit_chars, self.dictionary_text = fit_rows, fit_chars, dictionary_text
        self.dictionaries: list[bytes] | None = None

    # sizes ---------------------------------------------------------------------------------------------------------
    def compressors(self) -> list[zstandard.ZstdCompressor]:
        held = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO) for d in self.dictionaries]
        for d in held:
            d.precompute_compress(level=LEVEL)
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=d) for d in held] + [zstandard.ZstdCompressor(level=LEVEL)]

    @staticmethod
    def features(text: bytes, compressors: list) -> list[float]:
        n = max(len(text), 1)
        blocks = [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)] or [b""]
        bad, good, plain = (sum(len(c.compress(b)) for b in blocks) for c in compressors)
        return [(good - bad) / n, (good - bad) / (good + bad), good / n, bad / n, plain / n, float(np.log1p(len(text)))]

    def _expanded(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        products = [z[:, i] * z[:, j] for i in range(z.shape[1]) for j in range(i, z.shape[1])]
        return np.column_stack([np.ones(len(z)), z, *products])

    # learning ------------------------------------------------------------------------------------------------------
    def fit(self, texts: list[str], labels: np.ndarray) -> CompressionClassifier:
        if len(set(labels.tolist())) < 2:
            return self
        data = [t.encode() for t in texts]
        half = np.arange(len(labels)) % 2 == 0
        teach, test = (half, ~half) if min(np.bincount(labels[k], minlength=2).min() for k in (half, ~half)) >= LEAST else (half | True, half | True)
        self.dictionaries = []
        for label in (0, 1):
            mine = [t for t, k in zip(data, teach & (labels == label), strict=True) if k]
            pieces = [t[k : k + PIECE] for t in mine for k in range(0, len(t), PIECE)]
            step = max(1, -(-sum(map(len, pieces)) // self.dictionary_text))
            pieces = pieces[::step]
            pieces = [p for p in pieces if len(p) >= 8]
            try:
                self.dictionaries.append(zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes())
            except zstandard.ZstdError:  # too little text for training: the text itself serves as raw dictionary
                self.dictionaries.append((b"\n".join(pieces) or b"\n" * 8)[-DICTIONARY_BYTES:])
        compressors = self.compressors()
        data, labels = [t for t, k in zip(data, test, strict=True) if k], labels[test]
        x = np.array([self.features(t, compressors) for t in data])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z, y = self._expanded(x), labels.astype(float)
        self.weights = np.zeros(z.shape[1])
        for _ in range(40):
            p = self._sigmoid(z @ self.weights)
            step = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(z.shape[1])
            self.weights -= np.linalg.solve(step, z.T @ (p - y) + 1e-2 * self.weights)
        return self

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def scores(self, texts: list[bytes], compressors: list) -> np.ndarray:
        x = np.array([self.features(t, compressors) for t in texts]).reshape(-1, 6)
        return self._sigmoid(self._expanded(x) @ self.weights)

    # use -----------------------------------------------------------------------------------------------------------
    def fitted(self, docs: DataFrame, labels: DataFrame, label: str = "quality") -> CompressionClassifier:
        sample = teaching_sample(docs, labels, label, self.fit_rows, self.fit_chars, whole=True)
        return self.fit(sample["text"].tolist(), sample["label"].to_numpy())

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score) of every row."""
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            compressors = model.compressors() if model.dictionaries else []
            for batch in (part for b in batches for part in slices(b, "text")):
                texts = batch.column("text").to_pylist()
                out = model.scores(texts, compressors) if compressors else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
        return rows.mapInArrow(run, "doc_id bigint, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = CompressionClassifier().fitted(docs, labels).score(docs)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
