"""Token counts of a unigram vocabulary without token lists: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary gives every piece that ends at each character;
dynamic programming carries the best score and the number of pieces of the path that has it.
Pieces with a word mark have it in front only, so texts are cut before spaces and each
distinct part of a batch is counted once.

Tie rules are those of the public unigram tokenizers: of equal scores the piece that starts
first wins. A character that no one-character piece covers may be an unknown of the lowest
score less 10, which costs its UTF-8 bytes as tokens where the vocabulary has byte pieces, and
one token for a run of unknowns where not.

Defined results: null or empty text has no tokens and score 0. Rows that repeat an id are
counted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.llm import words as W

MARK = "▁"
PENALTY = 10.0
KNOWN = 400_000  # distinct parts a task remembers


@dataclass
class Vocabulary:
    """Pieces with scores, and whether unknown characters fall back to bytes."""

    pieces: dict[str, float]
    bytes_for_unknown: bool
    automaton: object = field(default=None, repr=False)
    known: dict[int, tuple[int, float]] = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """The ordinary pieces of a SentencePiece file; control and byte pieces are left out."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = {model.id_to_piece(i): model.get_score(i) for i in ids
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
                          or model.is_unused(i))}
        return cls(pieces, any(model.is_byte(i) for i in ids))

    def ready(self) -> Vocabulary:
        """Build the automaton; once per task."""
        import ahocorasick

        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece with a word mark inside: texts cannot be cut before spaces")
        self.automaton = ahocorasick.Automaton()
        for p, score in self.pieces.items():
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        self.unknown = min(self.pieces.values()) - PENALTY
        return self

    def count(self, text: str) -> tuple[int, float]:
        """(tokens, score) of a text whose spaces are word marks already."""
        n = len(text)
        best, size, unk = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        single = [False] * n
        by_end: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            by_end[end].append(match)
            if match[0] == 1:
                single[end] = True
        for end in range(n):
            top = None
            for length, score in by_end[end]:
                value = best[end + 1 - length] + score
                if top is None or value > top:
                    top, own = value, size[end + 1 - length] + 1
            lone = False
            if not single[end]:
                value = best[end] + self.unknown
                if top is None or value > top:
                    top, lone = value, True
                    own = size[end] + (len(text[end].encode()) if self.bytes_for_unknown
                                       else 0 if unk[end] else 1)
            best[end + 1], size[end + 1], unk[end + 1] = top, own, lone
        return size[n], best[n]


def parts_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each part begins (text starts, spaces after another byte) and its row."""
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (data[1:] == 0x20) & (data[:-1] != 0x20)
    full = offsets[1:] > offsets[:-1]
    cut[offsets[:-1][full]] = True
    start = np.flatnonzero(cut[:-1])
    return start, np.searchsorted(offsets, start, "right") - 1


def column_counts(vocabulary: Vocabulary, column: pa.Array) -> Iterator[tuple[int, float]]:
    """(tokens, score) of each text of a column."""
    for _, data, offsets in W.texts(column):
        rows = len(offsets) - 1
        start, row = parts_of(data, offsets)
        stop = np.append(start[1:], len(data))
        # The first part of a text gets the leading mark, so it is told apart from later ones.
        lead = np.isin(start, offsets[:-1])
        key, first, which = np.unique(W.hashes(data, start, stop) ^ W.mix(lead.astype(np.uint64)),
                                      return_index=True, return_inverse=True)
        if len(vocabulary.known) > KNOWN:
            vocabulary.known.clear()
        raw, found = data.tobytes(), []
        for k, a, b, leads in zip(key.tolist(), start[first].tolist(), stop[first].tolist(),
                                  lead[first].tolist()):
            own = vocabulary.known.get(k)
            if own is None:
                text = raw[a:b].decode().replace(" ", MARK)
                own = vocabulary.known[k] = vocabulary.count(MARK + text if leads else text)
            found.append(own)
        size = np.array([f[0] for f in found], np.int64)
        score = np.array([f[1] for f in found])
        yield from zip(np.bincount(row, size[which], rows).astype(np.int64).tolist(),
                       np.bincount(row, score[which], rows).tolist())


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, score of the best segmentation."""
    vocabulary = Vocabulary.load(vocabulary_path)
    data = (vocabulary.pieces, vocabulary.bytes_for_unknown)
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(*shared.value).ready()
        for batch in batches:
            found = list(column_counts(own, batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.int64()),
                 pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "n_tokens", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, score double")
