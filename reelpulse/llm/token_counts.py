"""Token counts without tokens: a count-only Viterbi search over a unigram vocabulary.

Spaces are written as U+2581; one is put in front of a text that begins with another character.  A text is cut
before each run of spaces, if no vocabulary entry can cross such a cut, which is looked up in the vocabulary;
otherwise the whole text is one cut.  Within a cut an Aho-Corasick
automaton lists all vocabulary entries that end at each character, and a dynamic program keeps, for every
character, the best score of a segmentation that ends there and its number of pieces.  Ties follow the
tokenizer: a candidate replaces another only if its score is strictly higher and candidates are tried from
the leftmost start, so of equal scores the longest last piece stays.  A character that is no entry itself may
be taken alone for the lowest score of the vocabulary less 10, and counts one piece per UTF-8 byte.
Cuts repeat a lot; their counts are remembered, at most ``most`` of them per worker.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import map_text

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
_CUT = re.compile(f"{SPACE}+[^{SPACE}]*")
_CROSSES = re.compile(f"[^{SPACE}]{SPACE}")
_COUNTERS: dict[str, "Counter"] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(entry, score) by id, of a public vocabulary file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts the pieces of texts for a vocabulary of (entry, score)."""

    def __init__(self, entries: list[tuple[str, float]], most: int = 500_000):
        self.found = ahocorasick.Automaton()
        for piece, score in entries:
            if piece:
                self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.cuts = not any(_CROSSES.search(piece) for piece, _ in entries)
        self.unknown = min(score for _, score in entries) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}
        self.most = most

    def pieces(self, word: str) -> int:
        """Number of pieces of the best segmentation of one cut."""
        n = len(word)
        score, count = [0.0] * (n + 1), [-1] * (n + 1)
        count[0], done, single = 0, 0, False

        def close(i: int) -> None:                    # all entries that end after character i are in
            if not single:
                alone = score[i] + self.unknown
                if count[i + 1] < 0 or alone > score[i + 1]:
                    score[i + 1], count[i + 1] = alone, count[i] + len(word[i].encode("utf-8", "surrogatepass"))

        for end, (size, value) in self.found.iter(word):      # by end, then the longest first
            while done < end:
                close(done)
                done, single = done + 1, False
            start = end + 1 - size
            through = score[start] + value
            if count[end + 1] < 0 or through > score[end + 1]:
                score[end + 1], count[end + 1] = through, count[start] + 1
            single = single or size == 1
        while done < n:
            close(done)
            done, single = done + 1, False
        return count[n]

    def count(self, text: str | None) -> int:
        """Number of pieces of a whole text; a null or empty one has none."""
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        if not self.cuts:
            return self.pieces(SPACE + marked.removeprefix(SPACE))
        if SPACE + SPACE in marked:                   # cuts without their first space
            marked = marked if marked.startswith(SPACE) else SPACE + marked
            words = [cut[1:] for cut in _CUT.findall(marked)]
        else:
            words = marked.removeprefix(SPACE).split(SPACE)
        try:
            return sum(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) + len(words) > self.most:
                self.known.clear()
            for w in words:
                if w not in self.known:
                    self.known[w] = self.pieces(SPACE + w)
            return sum(map(self.known.__getitem__, words))


def counter(path: str) -> Counter:
    """The counter of a vocabulary file, one per worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(vocabulary(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, the number of unigram pieces of each whole text; null and empty texts have 0.
    Each row is counted by itself; repeated rows stay."""

    def work():
        count = counter(vocabulary_path).count
        return lambda texts: [[count(t) for t in texts]]

    return map_text(docs, text, work, [("n_tokens", "bigint", pa.int64())])
