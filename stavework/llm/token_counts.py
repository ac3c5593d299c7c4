"""Count-only Viterbi: tokens of a text under a unigram vocabulary, without building the tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TOKENIZERS, file_bytes, text_chunks
from .lattice import Vocabulary

#: Units that a worker remembers at most; the store is emptied when it is full. It bounds memory, not results.
STORE = 400_000


class Counter:
    """space_runs: whether pieces that are runs of spaces are used. count_tokens uses them, as the library does."""

    def __init__(self, model: bytes, store: int = STORE, space_runs: bool = False) -> None:
        self.vocabulary, self.store = Vocabulary(model, space_runs), store
        self.known: dict[str, int] = {}
        self.scores: dict[str, float] = {}

    def count(self, texts: list[str | None]) -> tuple[list[int], list[float]]:
        units = [self.vocabulary.units_of(t) for t in texts]
        new = list(set().union(*units) - self.known.keys())
        if len(self.known) + len(new) > self.store:
            self.known.clear()
            self.scores.clear()
            new = list(set().union(*units))
        if new:
            score, tokens = self.vocabulary.best(new)
            self.known.update(zip(new, tokens.tolist(), strict=True))
            self.scores.update(zip(new, score.tolist(), strict=True))
        return [sum(map(self.known.__getitem__, row)) for row in units], [sum(map(self.scores.__getitem__, row), 0.0) for row in units]


#: One counter per worker process and model, so that its store lasts from task to task.
_counters: dict[tuple[int, int], Counter] = {}


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", model_path: str = f"{TOKENIZERS}/piece_bpe_32k.model", store: int = STORE) -> DataFrame:
    """One row per row of docs: key, n_chars, n_tokens, best_score (sum of the scores on the best path).

    Null and empty texts have 0 tokens and score 0. Null and repeated keys are kept as they come. Other columns are
    neither read nor returned, so their names do not matter. An empty table gives an empty result. Scores are summed in
    double precision; the library sums in single precision and can differ once a sum passes 2**24.
    The model file (under 1 MB) is read on the driver and broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(file_bytes(model_path))
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = hash(model.value), store
        counter = _counters.get(which) or _counters.setdefault(which, Counter(model.value, store, space_runs=True))
        for b in text_chunks(batches, "t"):
            texts = b.column("t").to_pylist()
            n, s = counter.count(texts)
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(np.fromiter((len(x or "") for x in texts), np.int64, len(texts))), pa.array(n, pa.int64()), pa.array(s, pa.float64())], ["k", "n_chars", "n_tokens", "best_score"])

    out = docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(run, f"k {key_type}, n_chars long, n_tokens long, best_score double")
    return out.withColumnRenamed("k", key)
