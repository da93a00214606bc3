"""Token counts: a Viterbi pass that carries only the best score and its piece count.

An Aho-Corasick automaton over the unigram vocabulary lists every piece that
ends at a character; the best path to it keeps its score and its number of
pieces, never the pieces. Ties go as in the public unigram implementation:
candidates come in order of their start and only a strictly better one
replaces, so the longest piece wins. A character that no piece holds alone
costs the least score less ten; where the file has pieces for bytes, a run of
such characters counts its bytes, else it is one token. White space becomes the
mark, one leads the text. Where no piece holds a mark behind another character,
no path's piece can cross from a word into the marks of the next, so a text's
count is the sum over its runs of marks with the word behind them, and runs met
before are looked up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces with scores of a sentencepiece file, the unknown piece first, without control and byte pieces; and whether it has all byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    skip = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in every if not skip(i)]
    return [("<unk>", 0.0), *pieces], sum(map(model.is_byte, every)) == 256


class Counter:
    """Counts tokens of texts; keeps the counts of at most ``keep`` distinct runs."""

    def __init__(self, vocabulary: list[tuple[str, float]], bytes_: bool = False, keep: int = 2_000_000):
        import ahocorasick

        self.keep, self.known, self.bytes = keep, {}, bytes_
        self.parts = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in vocabulary)
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary[1:]:  # the unknown piece is no text to be matched
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary[1:] if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY

    def word(self, word: str) -> int:
        n = len(word)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ended, single = 0, self.single
        low, reached = self.unknown, float("-inf")

        def close(end: int, score: float, pieces: int) -> None:
            # the unknown edge starts last, so it comes after all pieces that end here
            if word[end - 1] not in single and (score == reached or best[end - 1] + low > score):
                best[end], unknown[end] = best[end - 1] + low, True
                count[end] = count[end - 1] + (len(word[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else not unknown[end - 1])
            else:
                best[end], count[end] = score, pieces

        score, pieces = reached, 0
        for last, (length, own) in self.automaton.iter(word):
            end = last + 1
            if end != ended + 1:
                close(ended + 1, score, pieces)
                for e in range(ended + 2, end):
                    close(e, reached, 0)
                ended, score, pieces = end - 1, reached, 0
            start = end - length  # longest first: in order of starts
            if (x := best[start] + own) > score:
                score, pieces = x, count[start] + 1
        for e in range(ended + 1, n + 1):
            close(e, score, pieces)
            score, pieces = reached, 0
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        marked = marked if marked[0] == MARK else MARK + marked
        known = self.known
        if not self.splits:
            return self.word(marked)
        # words behind single spaces, else runs of marks with what follows them
        parts = marked.split(MARK)[1:] if MARK + MARK not in marked else [p.removeprefix(MARK) for p in self.parts.findall(marked)]
        try:
            return sum(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > self.keep:
                known.clear()
            for p in parts:
                if p not in known:
                    known[p] = self.word(MARK + p)
            return sum(map(known.__getitem__, parts))


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and n_tokens of every document, from its whole text.

    Null and empty texts have no tokens. Repeated rows and null ids stay. Other
    columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))  # a fixed file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*held.value)
        for batch in batches:
            counts = [counter.text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64())], ["id", "n_tokens"])

    schema = rows.select("id", F.lit(0).cast("long").alias("n_tokens")).schema
    return in_arrow(rows, run, schema).select(F.col("id").alias(id_col), "n_tokens")
