"""Token counts by a Viterbi pass that carries only the best score and its number of pieces."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .tokens import slices

#: The mark that stands for a space.
SPACE = "▁"
#: Below the lowest score by so much scores a character that no piece covers.
UNKNOWN_PENALTY = 10.0
#: Segments remembered by a worker before it starts anew.
CACHE = 1_000_000
#: The mark at which texts are cut; a text that holds it is searched as a whole.
_CUT = "\x00"
#: Characters of a segment beyond which only the places that a piece can still reach are kept.
FORGET = 1 << 14


@dataclass(frozen=True)
class Vocabulary:
    """A unigram vocabulary: pieces, their scores, and whether uncovered characters fall back to bytes.

    space_prefix: a text begins with the space mark, as if a space stood before it.
    """

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_fallback: bool = True
    space_prefix: bool = True
    key: str = field(default="", compare=False)

    @classmethod
    def from_model(cls, path: str) -> Vocabulary:
        """Pieces and scores of a SentencePiece model file; control, unknown and byte pieces only mark what the model can do."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        n_bytes = sum(model.is_byte(i) for i in range(model.get_piece_size()))
        return cls.of([(model.id_to_piece(i), model.get_score(i)) for i in ids], n_bytes == 256)

    @classmethod
    def of(cls, scored: list[tuple[str, float]], byte_fallback: bool = True, space_prefix: bool = True) -> Vocabulary:
        """Of a piece given twice, the first score counts."""
        table: dict[str, float] = {}
        for piece, score in scored:
            if piece:
                table.setdefault(piece, float(score))
        key = hashlib.sha256(repr((sorted(table.items()), byte_fallback, space_prefix)).encode()).hexdigest()
        return cls(tuple(table), tuple(table.values()), byte_fallback, space_prefix, key)


class Counter:
    """The count-only Viterbi of one vocabulary, for one worker."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in zip(vocabulary.pieces, vocabulary.scores, strict=True):
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(map(len, vocabulary.pieces), default=1)
        self.single = {p for p in vocabulary.pieces if len(p) == 1}
        self.unknown = min(vocabulary.scores, default=0.0) - UNKNOWN_PENALTY
        self.bytes = vocabulary.byte_fallback
        self.cache: dict[str, tuple[int, float, bool, bool]] = {}
        inner = [p for p in vocabulary.pieces if len(p) > 1]
        # where no piece holds the space mark after another character, no piece spans the start of a run of marks
        self.by_space = not any(SPACE in p.lstrip(SPACE) for p in inner)
        held = set("".join(inner))
        self.alone = [c for c in "\n\t\r0123456789" if c not in held]

    def segment(self, text: str) -> tuple[int, float, bool, bool]:
        """(pieces, score, first is unknown, last is unknown) of the best path.

        The automaton reports matches by their end, longest first. A later candidate replaces an earlier one
        only if its score is higher, so of equal scores the longest last piece wins; the uncovered character
        comes last. This is what a pass over start positions that updates on higher scores only arrives at.
        Without byte fallback a run of unknown characters is one piece.
        """
        n = len(text)
        if n > FORGET:
            return self._long(text)
        score, count, last = [float("-inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        first = [False] * (n + 1)
        score[0], at = 0.0, 0

        def close(at: int) -> None:
            char = text[at - 1]
            if char not in self.single and (c := score[at - 1] + self.unknown) > score[at]:
                score[at], last[at], first[at] = c, True, first[at - 1] if at > 1 else True
                count[at] = count[at - 1] + (len(char.encode("utf-8", "surrogatepass")) if self.bytes else not last[at - 1])

        for end, (length, value) in self.automaton.iter(text):
            while at < end:
                at += 1
                close(at)
            begin = end + 1 - length
            if (c := score[begin] + value) > score[end + 1]:
                score[end + 1], count[end + 1], last[end + 1], first[end + 1] = c, count[begin] + 1, False, first[begin] if begin else False
        while at < n:
            at += 1
            close(at)
        return count[n], score[n] if n else 0.0, first[n], last[n]

    def _long(self, text: str) -> tuple[int, float, bool, bool]:
        """segment() of a long text: places share slots, as no piece reaches back by more than the longest one's characters."""
        size = 1 << (self.longest + 1).bit_length()
        mask, n, at = size - 1, len(text), 0
        score, count, last, first = [float("-inf")] * size, [0] * size, [False] * size, [False] * size
        score[0] = 0.0

        def close() -> None:
            nonlocal at
            at += 1
            i, before, after, char = at & mask, (at - 1) & mask, (at + 1) & mask, text[at - 1]
            if char not in self.single and (c := score[before] + self.unknown) > score[i]:
                score[i], last[i], first[i] = c, True, first[before] if at > 1 else True
                count[i] = count[before] + (len(char.encode("utf-8", "surrogatepass")) if self.bytes else not last[before])
            score[after], count[after], last[after], first[after] = float("-inf"), 0, False, False

        for end, (length, value) in self.automaton.iter(text):
            while at < end:
                close()
            i, begin = (end + 1) & mask, end + 1 - length
            if (c := score[begin & mask] + value) > score[i]:
                score[i], count[i], last[i], first[i] = c, count[begin & mask] + 1, False, first[begin & mask] if begin else False
        while at < n:
            close()
        return count[n & mask], score[n & mask], first[n & mask], last[n & mask]

    def known(self, text: str) -> tuple[int, float, bool, bool]:
        if (found := self.cache.get(text)) is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            found = self.cache[text] = self.segment(text)
        return found

    def count(self, texts: pa.Array, space_prefix: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and score of each text. Texts are cut where no piece can reach across, and each distinct segment is searched once."""
        marked = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), " ", SPACE)
        if space_prefix:
            empty = pc.equal(marked, "")
            marked = pc.if_else(empty, "", pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), marked, pa.scalar("", pa.large_string())))
        whole = pc.match_substring(marked, _CUT) if self.by_space else pa.array([True] * len(marked))
        if pc.any(whole).as_py():  # each by itself, so that a text's score does not hang on the others
            found = {i: self.segment(marked[i].as_py()) for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False))}
            tokens, scores = self._split(pc.if_else(whole, "", marked))
            for i, f in found.items():
                tokens[i], scores[i] = f[:2]
            return tokens, scores
        return self._split(marked)

    def _split(self, marked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring_regex(marked, f"({SPACE}+)", rf"{_CUT}\1")
        if self.alone:
            marked = pc.replace_substring_regex(marked, "([" + "".join(map(re.escape, self.alone)) + "])", rf"{_CUT}\1{_CUT}")
        lists = pc.split_pattern(marked, _CUT)
        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        table = [self.known(s) for s in coded.dictionary.to_pylist()]
        if not table:
            return np.zeros(len(marked), np.int64), np.zeros(len(marked))
        codes = coded.indices.to_numpy()
        pieces, scores, first, last = (np.array(c) for c in zip(*table, strict=True))
        n, s = pieces[codes].astype(np.int64), scores[codes].astype(np.float64)
        if not self.bytes:  # an unknown run that goes on in the next segment is one piece
            filled = np.flatnonzero(n > 0)
            runs = last[codes[filled[:-1]]] & first[codes[filled[1:]]]
            owner = np.searchsorted(offsets, filled, side="right")
            n[filled[1:][runs & (owner[1:] == owner[:-1])]] -= 1
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
        each = np.add.reduceat(np.concatenate([s, [0.0]]), offsets[:-1]) if len(offsets) > 1 else np.zeros(0)
        return total(n), np.where(np.diff(offsets) > 0, each, 0.0)


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, score of every row of docs: tokens of the best unigram segmentation of its whole text.

    Spaces count as the space mark; nothing else is normalised. Null and empty texts have 0 tokens and
    score 0. Rows are counted one by one, so repeats and null ids are kept. The vocabulary goes along with
    the function; its size does not depend on the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(vocabulary.key)
        if counter is None:
            counter = _COUNTERS[vocabulary.key] = Counter(vocabulary)
        for batch in slices(batches):
            tokens, score = counter.count(batch.column("text"), vocabulary.space_prefix)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "n_tokens", "score"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, score double")
