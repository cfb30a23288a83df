"""Token counts: count-only Viterbi over a unigram vocabulary.

Segmentation is that of a unigram tokenizer with a metaspace pre-tokenizer: spaces
become U+2581, a text starts with one, and each stretch from one U+2581 to before the
next is segmented by itself. An Aho-Corasick automaton lists the vocabulary pieces that
end at each character; dynamic programming over character positions keeps the best
score and the number of pieces on that path, nothing else.

Tie rules, as in the tokenizer: scores add up as doubles from left to right; a later
candidate for a position replaces an earlier one only if it scores strictly more, and
candidates come in the order of their starts, so that of equal paths the one whose last
piece starts first wins. Where no one-character piece starts, an unknown piece may,
at the lowest score less 10. Neighbouring unknown pieces are one piece; with byte
fallback such a run counts as its UTF-8 bytes if the vocabulary has all of them.

Since stretches are independent, their counts are kept in a memo bounded by bytes (a task's own, dropped with it), and a text
costs one look-up for most of its words. A long stretch without a space is read in one pass that
holds three numbers for each of its characters.

Defined results: null and empty texts have 0 tokens; repeated rows are counted each
for itself; only doc_id and text are read, other columns don't matter.

Scale: one map over the documents, no shuffle. The vocabulary is read on the driver and
travels with the function; its size is that of the tokenizer, not of the data.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BoundedMemo, byte_chunks, setting

SPACE = "\u2581"
UNKNOWN_PENALTY = 10.0
VOCABULARY_SETTING, DEFAULT_VOCABULARY = "spark.fotoloom.tokenizer.vocabulary", "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces in the order of their ids, with scores."""

    pieces: tuple[tuple[str, float], ...]
    unk_id: int = 0
    byte_fallback: bool = True

    @classmethod
    def from_sentencepiece(cls, path: str | None = None) -> Vocabulary:
        import sentencepiece

        path = path or setting(VOCABULARY_SETTING, DEFAULT_VOCABULARY)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls(tuple((sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())), sp.unk_id())


class Counter:
    """Counts pieces by the vocabulary's automaton."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary.pieces):
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score), i == vocabulary.unk_id))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        names = {p for p, _ in vocabulary.pieces}
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in names} if vocabulary.byte_fallback else set()

    def pieces(self, s: str) -> int:
        """The number of pieces on the best path through ``s``."""
        n = len(s)
        # score and count of the best path to each position, and one more than where the unknown run that ends it starts
        best, count, run = array("d", bytes(8 * n + 8)), array("q", bytes(8 * n + 8)), array("q", bytes(8 * n + 8))
        matches = self.automaton.iter(s)  # by their ends, at one end the longest first
        last, found = next(matches, (n, None))
        for end in range(1, n + 1):
            top, single = None, False
            while last == end - 1:
                size, score, is_unk = found
                total = score + best[end - size]
                if top is None or total > top:
                    top, came, unk = total, end - size, is_unk
                single = single or size == 1
                last, found = next(matches, (n, None))
            if not single:  # every prefix can be reached: where no one-character piece does, a single unknown character does
                total = self.unknown + best[end - 1]
                if top is None or total > top:
                    top, came, unk = total, end - 1, True
            best[end] = top
            if unk:
                first = run[came] - 1 if run[came] else came
                run[end] = first + 1
                count[end] = count[first] + self._unknown_run(s, first, end, came, count[came] - count[first])
            else:
                count[end] = count[came] + 1
        return count[n]

    def _unknown_run(self, s: str, first: int, end: int, came: int, had: int) -> int:
        """The pieces of the unknown run ``s[first:end]``, of which ``s[first:came]`` made ``had``."""
        if not self.bytes:
            return 1
        raw = s[came:end].encode("utf-8", "surrogatepass")
        if len(self.bytes) == 256:
            return had + len(raw)
        whole = s[first:end].encode("utf-8", "surrogatepass")
        return len(whole) if all(b in self.bytes for b in whole) else 1


def counting(counter: Counter):
    """A function that counts a text's pieces, with a memo of its own."""
    memo = BoundedMemo(lambda stretch: counter.pieces(SPACE + stretch), 64 << 20)

    def count(text: str | None) -> int:
        if not text:
            return 0
        s = text.replace(" ", SPACE)
        return sum(map(memo.__getitem__, (s[1:] if s[0] == SPACE else s).split(SPACE)))

    return count


#: The counter of this worker. It keeps nothing of the texts.
_counters: dict[Vocabulary, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, n_tokens) for every row of ``docs``."""
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.from_sentencepiece())

    def count(batches):
        if vocab.value not in _counters:
            _counters.clear()
            _counters[vocab.value] = Counter(vocab.value)
        pieces = counting(_counters[vocab.value])
        for batch in byte_chunks(batches, 4 << 20):
            texts = ((t or b"").decode("utf-8", "replace") for t in batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), pa.array(map(pieces, texts), pa.int64())], names=["doc_id", "n_tokens"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(count, "doc_id long, n_tokens long")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
