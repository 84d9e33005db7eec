"""SentencePiece encoding and decoding by a Viterbi search that shares common prefixes.

A text is cut at its spaces; each word carries the mark that stands for the space before it. The distinct
marked words of a slice are sorted, which lays them out as a trie in depth-first order: going from one word
to the next only steps back to their common prefix, whose forward scores stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from sentinel.llm.words import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Below the worst piece: the score of a character that only bytes can spell.
BYTES_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with id and score, and the ids of the 256 byte pieces. Its size is that of a vocabulary file."""

    pieces: dict[str, tuple[int, float]]
    bytes: tuple[int, ...]

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """Read on the driver, so executors need no such file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, spelled = {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                spelled[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[piece] = (i, model.get_score(i))
        return cls(pieces, tuple(spelled[b] for b in range(256)))


class Encoder:
    """Words to ids; `encode_all` walks sorted words depth-first."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes = vocabulary.bytes
        self.unknown = min((s for _, s in vocabulary.pieces.values()), default=0.0) - BYTES_PENALTY
        self.root: list = [{}, None, 0.0]  # children, id and score of the piece that ends here
        for piece, (i, score) in vocabulary.pieces.items():
            if MARK in piece[1:]:
                continue  # spans words
            node = self.root
            for c in piece:
                node = node[0].setdefault(c, [{}, None, 0.0])
            node[1], node[2] = i, score

    def encode_all(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """(word, ids) of distinct words in sorted order. Each starts with the mark; a later mark is text.

        best[d] is the forward score of the first d characters, back[d] where the last piece of the best
        way begins and its id (None: bytes), open[d] the pieces begun and not ended, as (start, trie node).
        """
        root, unknown = self.root, self.unknown
        best, back, open_ = [0.0], [(0, None)], [[]]
        before = ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1:], back[shared + 1:], open_[shared + 1:]
            for d in range(shared, len(word)):
                c = word[d]
                top, last, alive = best[d] + unknown, (d, None), []
                if c != MARK or d == 0:
                    # earlier starts first: of equal scores the longer last piece holds
                    for start, node in open_[d]:
                        node = node[0].get(c)
                        if node is not None:
                            alive.append((start, node))
                            if node[1] is not None:
                                s = best[start] + node[2]
                                if s > top:
                                    top, last = s, (start, node[1])
                    node = root[0].get(c)
                    if node is not None:
                        alive.append((d, node))
                        if node[1] is not None:
                            s = best[d] + node[2]
                            if s > top:
                                top, last = s, (d, node[1])
                best.append(top)
                back.append(last)
                open_.append(alive)
            ids: list[int] = []
            at = len(word)
            while at:
                start, piece = back[at]
                if piece is None:
                    ids.extend(self.bytes[b] for b in reversed(word[start:at].encode()))
                else:
                    ids.append(piece)
                at = start
            ids.reverse()
            yield word, tuple(ids)
            before = word


class Spelling(dict):
    """Words already encoded, a bounded number of them between slices."""

    def __init__(self, encoder: Encoder, most: int = 150_000):
        super().__init__()
        self.encoder, self.most = encoder, most

    def learn(self, words: set[str]) -> None:
        new = words.difference(self)
        if len(self) > self.most:
            self.clear()
            new = words
        self.update((w[1:], ids) for w, ids in self.encoder.encode_all(sorted(MARK + w for w in new)))


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", into: str = "token_ids") -> DataFrame:
    """Documents with the ids of their whole texts; `decode` gives back the exact text.

    Null text: null ids. Empty text: no ids. Characters outside the vocabulary, and the mark itself where a
    text has it, become byte pieces. A text of one long word is one path of the trie. Equal texts get equal
    ids. A column of the result's name is replaced; other columns pass.
    """
    base = docs.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Spelling(Encoder(vocabulary))
        for batch in batches:
            for lo, hi in slices(batch.column(text_col)):
                part = batch.slice(lo, hi - lo)
                texts = part.column(text_col).to_pylist()
                words = [t.split(" ") if t else [] for t in texts]
                known.learn(set().union(*words))
                ids = [np.fromiter(chain.from_iterable(map(known.__getitem__, w)), np.int32) for w in words]
                cuts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(cuts, pa.int32(), mask=np.array([*(t is None for t in texts), False])),
                    pa.array(np.concatenate(ids) if ids else [], pa.int32()))
                yield pa.record_batch([*part.columns, lists], names=[*part.schema.names, into])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField(into, ArrayType(IntegerType()))]))


def decode(tokens: DataFrame, vocabulary: Vocabulary, ids_col: str = "token_ids", into: str = "text") -> DataFrame:
    """Texts from ids: marks become spaces, byte pieces their bytes, the first mark goes. Null ids: null text."""
    base = tokens.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = {i: p.replace(MARK, " ").encode() for p, (i, _) in vocabulary.pieces.items()}
        spelled |= {i: bytes([b]) for b, i in enumerate(vocabulary.bytes)}
        for batch in batches:
            texts = []
            for row in batch.column(ids_col):
                ids = None if not row.is_valid else row.values.to_numpy(zero_copy_only=False).tolist()
                texts.append(None if ids is None else b"".join(map(spelled.__getitem__, ids))[1:].decode("utf-8", "replace"))
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField(into, StringType())]))
