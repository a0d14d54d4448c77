"""Count-only Viterbi over a unigram vocabulary.

The tokenizer is a unigram model with a Metaspace pre-tokenizer: spaces become "▁", one is put in front, and every "▁" begins
a new stretch. An Aho-Corasick automaton enumerates the vocabulary pieces in a stretch; dynamic programming over its
characters carries the best score and the number of pieces, never the pieces, for as many places as the longest piece has characters. Ties are the tokenizer's: of equal scores the
piece that begins first wins; a character that is no piece costs the least score minus 10; neighbouring unknown characters
are one piece. A worker remembers the counts of stretches by code, up to REMEMBERED of them.

Defined cases: null and empty texts have no tokens; leading, trailing and repeated spaces count as the tokenizer counts
them; other columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import textcodes
from sluice.llm.common import table

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 1_000_000
_blank = np.zeros(256, bool)
_blank[32] = True


def default_vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece model without control and byte pieces, with the model's scores. Where these are whole numbers,
    they are the merge ranks of a byte-pair model and no log-probabilities; then scores follow Zipf's law by their order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [
        i for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    scores = [model.get_score(i) for i in own]
    if all(s == int(s) for s in scores):
        scores = [-math.log(k + 2) for k in range(len(own))]
    return [(model.id_to_piece(i), s) for i, s in zip(own, scores, strict=True)]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(len(piece) for piece, _ in pieces)
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.clear()

    def clear(self) -> None:
        self.codes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count(self, stretch: str) -> int:
        """Pieces of the best path through one stretch."""
        n = len(stretch)
        ring = min(self.longest, n) + 1  # places further back than the longest piece are never looked at again
        scores, counts, unknown = [0.0] * ring, [0] * ring, [False] * ring
        matches = self.automaton.iter(stretch)  # in order of their ends
        match = next(matches, None)
        for end in range(1, n + 1):
            ending = []
            while match is not None and match[0] < end:
                ending.append(match[1])
                match = next(matches, None)
            here, before = end % ring, (end - 1) % ring
            best, alone, was_unknown = None, False, unknown[before]
            unknown[here] = False
            for length, score in sorted(ending, reverse=True):
                alone |= length == 1
                start = (end - length) % ring
                candidate = score + scores[start]
                if best is None or candidate > best:
                    best, pieces = candidate, counts[start] + 1
            if not alone:
                candidate = self.unknown + scores[before]
                if best is None or candidate > best:
                    best, pieces, unknown[here] = candidate, counts[before] + (not was_unknown), True
            scores[here], counts[here] = best, pieces
        return counts[n % ring]

    def words(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each text."""
        codes, starts, ends, first = textcodes.words(data, offsets, lower=False, blank=_blank)
        if len(self.codes) > REMEMBERED:
            self.clear()
        distinct, where, back = np.unique(codes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.codes, distinct), max(0, len(self.codes) - 1))
        unseen = self.codes[at] != distinct if len(self.codes) else np.ones(len(distinct), bool)
        if unseen.any():
            raw = data.tobytes()
            spans = zip(starts[where[unseen]].tolist(), ends[where[unseen]].tolist(), strict=True)
            new = np.array([self.count(SPACE + raw[a:b].decode()) for a, b in spans], np.int64)
            place = np.searchsorted(self.codes, distinct[unseen])
            self.codes, self.counts = np.insert(self.codes, place, distinct[unseen]), np.insert(self.counts, place, new)
            at = np.searchsorted(self.codes, distinct)
        own = np.concatenate([[0], np.cumsum(self.counts[at][back])]) if len(codes) else np.zeros(1, np.int64)
        spaces = np.concatenate([[0], np.cumsum(data == 32)])[offsets]
        length = np.diff(offsets)
        begins = (data[np.minimum(offsets[:-1], max(0, len(data) - 1))] == 32) & (length > 0) if len(data) else np.zeros(len(length), bool)
        empty = np.where(length > 0, np.diff(spaces) + 1 - begins, 0) - np.diff(first)
        return np.diff(own[first]) + empty * self.count(SPACE)


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def count_tokens(docs: DataFrame, path: str | None = None, pieces: list[tuple[str, float]] | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row, by the model at the path, or by given pieces and their scores."""
    path = path or default_vocabulary_path()
    given = docs.sparkSession.sparkContext.broadcast(pieces) if pieces else None  # as large as a vocabulary

    def count(batches):
        counter = Counter(given.value) if given else _counter(path)
        for batch in batches:
            counts = [counter.words(data, offsets) for _, _, data, offsets in textcodes.chunks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]))], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
