"""Token counts of a unigram tokenizer by dynamic programming over a trie.

A text's pre-tokens are its words, each with the word mark before it.  A
pre-token's tokens are those of its best segmentation into vocabulary pieces,
where a piece of rank r scores -log(r + 2): the vocabulary file lists pieces
from frequent to rare but has no probabilities of its own, so Zipf's law
stands in for them.  A character that no piece covers falls back to its UTF-8
bytes, one token each.

Distinct pre-tokens are taken in sorted order, which walks their trie depth
first: the forward scores of the prefix shared with the one before stay, and
only the new characters are computed.  Counts at the ends of words are kept
by word for the rest of the task, in a table emptied when it is full.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import blocks

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Score of one byte of a character that is in no piece.
BYTE = -20.0
#: Words whose counts a task remembers.
KEPT = 1_000_000
_SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def load(path: str = VOCABULARY) -> dict[str, float]:
    """Piece -> score of a sentencepiece vocabulary, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return {model.id_to_piece(i): -log(i + 2) for i in ids}


class Trie:
    """Forward scores along the current path of the trie of pre-tokens."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.sizes = sorted({len(p) for p in pieces})
        self.word, self.score, self.tokens = "", [0.0], [0]

    def count(self, word: str) -> int:
        """Tokens of ``word``; what it shares with the last one is not computed again."""
        old, shared = self.word, 0
        for a, b in zip(old, word, strict=False):
            if a != b:
                break
            shared += 1
        score, tokens, pieces = self.score, self.tokens, self.pieces
        del score[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            width = len(word[end - 1].encode("utf-8", "replace"))
            best, n = score[end - 1] + BYTE * width, tokens[end - 1] + width
            for size in self.sizes:
                if size > end:
                    break
                p = pieces.get(word[end - size : end])
                if p is not None:
                    x = score[end - size] + p
                    if x > best:
                        best, n = x, tokens[end - size] + 1
            score.append(best)
            tokens.append(n)
        self.word = word
        return tokens[-1]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pre_tokens, n_tokens.

    Null, empty and blank texts have none, an empty table gives no rows.  Of
    segmentations that score alike, the one whose last piece is shortest
    counts.  Texts and words are read whole, very long ones too; null ids and
    repeated rows are counted as they come.  Columns other than doc_id and
    text are not read, whatever their names.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for first, texts in blocks(batch.column(1).to_pylist()):
                words = [t.translate(_SPACES).split(" ") for t in texts]
                new = set().union(*words) - known.keys()
                if len(known) + len(new) > KEPT:
                    known.clear()
                    new = set().union(*words)
                trie = Trie(pieces.value)
                known.update((w, trie.count(MARK + w) if w else 0) for w in sorted(new))
                tokens = [sum(map(known.__getitem__, w)) for w in words]
                sizes = [len(w) - w.count("") for w in words]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pre_tokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_pre_tokens bigint, n_tokens bigint")
