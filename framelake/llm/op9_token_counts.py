"""Token counts: Viterbi over a unigram vocabulary that carries scores and piece counts only.

An Aho-Corasick automaton lists the pieces that end at each place of a text.  Dynamic
programming keeps, for each place, the best score of a segmentation that ends there and its
number of pieces.  Ties go as in the tokenizer: a candidate replaces another only if its score
is strictly higher, and candidates come in order of their start, so the longer last piece
stays.  A character without a piece of its own may be unknown, at 10 below the lowest score;
with byte fallback it counts its UTF-8 bytes, else a run of unknowns counts once.  Scores are
summed in 64-bit floats.

No piece holds a space mark behind another character (this is checked), so a text falls into
independent chunks that begin at its space marks; each worker remembers the counts of chunks
it has met, up to a bound.

The vocabulary's pieces and scores come from the model file in the `model_path` parameter; the
driver reads it, as executors need not have it.  A file of merge ranks serves as well: a piece's score is
then its negative rank, and pieces scored -1e9, which stand for "never", are left out.  (The
tokenizer's own unigram mode counts the same on such a file, as the test shows.)

Defined results: null and empty texts have no tokens; a chunk without any blank may be as long as a
text, as only the scores of one piece length back are held; repeated rows are counted each; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_blocks

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: What an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
#: Pieces at or below this score are never taken.
NEVER = -1e8
#: Chunks whose counts a worker remembers.
REMEMBERED = 400_000


def load_pieces(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) of the normal pieces, and whether unknown characters fall back to bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) or model.get_score(i) <= NEVER)]
    return pieces, any(model.is_byte(i) for i in ids)


class PieceCounter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.byte_fallback = byte_fallback
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        joined = {c for p, _ in pieces if len(p) > 1 for c in p}
        splits = byte_fallback and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces)
        #: with byte fallback, counts of parts add up; a newline that no longer piece holds stands alone
        line = "\n" if splits and "\n" not in joined else ""
        self.chunk = re.compile(f"{line or '(?!)'}|{SPACE}*[^{SPACE}{line}]+|{SPACE}+" if splits else r"(?s).+")
        self.known: dict[str, int] = {}

    def chunk_count(self, chunk: str) -> int:
        ring = self.longest + 1  # places whose scores are held, one behind another in a circle
        score, count, in_unknown = [0.0] * ring, [0] * ring, [False] * ring
        found = self.automaton.iter(chunk)
        ahead = next(found, None)
        for i in range(len(chunk)):
            ends = []
            while ahead is not None and ahead[0] == i:
                ends.append(ahead[1])
                ahead = next(found, None)
            best, pieces, unknown, single = None, 0, False, False
            for length, own in sorted(ends, reverse=True):  # the earliest start first
                single = single or length == 1
                total = score[(i + 1 - length) % ring] + own
                if best is None or total > best:
                    best, pieces = total, count[(i + 1 - length) % ring] + 1
            here, after = i % ring, (i + 1) % ring
            if not single:
                total = score[here] + self.unknown
                if best is None or total > best:
                    unknown = True
                    width = len(chunk[i].encode("utf-8", "surrogatepass")) if self.byte_fallback else int(not in_unknown[here])
                    best, pieces = total, count[here] + width
            score[after], count[after], in_unknown[after] = best, pieces, unknown
        return count[len(chunk) % ring]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, known = 0, self.known
        for chunk in self.chunk.findall(SPACE + text.replace(" ", SPACE)):
            n = known.get(chunk)
            if n is None:
                n = self.chunk_count(chunk)
                if len(chunk) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[chunk] = n
            total += n
        return total


_counters: dict = {}


def count_tokens(docs: DataFrame, model_path: str = MODEL_PATH, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs; a narrow scan without a shuffle."""
    import pyarrow as pa

    pieces = load_pieces(model_path)
    vocabulary = docs.sparkSession.sparkContext.broadcast(pieces)  # a tokenizer's vocabulary: bounded
    content = hashlib.sha256(repr(pieces).encode()).hexdigest()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(content)
        if counter is None:
            _counters.clear()
            counter = _counters[content] = PieceCounter(*vocabulary.value)
        for b in in_blocks(batches):
            tokens = pa.array([counter.count(t) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), tokens], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
