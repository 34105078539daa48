"""SentencePiece encoding and decoding of a merge model by a table of last tokens.

Encoding.  A merge model joins, as long as it can, the two neighbours whose joint piece scores
highest, the leftmost of equals.  A sequence of pieces is what it makes of their text exactly
if it makes of every two neighbours the same two pieces, so each prefix of a text has one last
token.  An Aho-Corasick automaton lists the pieces that end at each place; of these the last
token of the prefix is the one that is compatible with the last token of the prefix before it.
Ids are then recovered backwards from the end.  Every place is visited once, whatever the
length of the text.  Two pieces are compatible if, going back through the merges that made both,
the last first, there never was a better merge across their boundary; this is found out once for each pair
that a worker meets.  (Pairs of a piece that scores above one of its own parts are tried by merging
their joint text.)  Pieces that merging doesn't make of their own text are never used.  A character that is no piece stands alone and becomes its UTF-8 bytes.

Decoding.  Ids become pieces, byte pieces bytes; the mark that encoding puts before a text goes,
other marks become blanks, and what isn't UTF-8 becomes U+FFFD, one for each byte.

No piece holds a space mark behind another character (this is checked), so texts fall into chunks
that begin at space marks, and texts without two marks in a row into words at each blank.  Each worker
remembers the words that it has met, up to a bound, and of these longest those that come again.

The driver reads the model file in `model_path`; executors get its pieces.  Models with other
normalisation than none, or with user-defined pieces, are refused.

Defined results: null and empty texts have no ids and decode to an empty text; very long texts, with
or without blanks, need memory in proportion to one text; repeated rows are encoded each; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_blocks

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words in either half of a worker's memory, and pairs of pieces that it remembers.
REMEMBERED_CHUNKS = 250_000
REMEMBERED_PAIRS = 2_000_000
#: Steps of the automaton that a worker remembers.
REMEMBERED_STEPS = 1_000_000
EMPTY = hashlib.sha256().hexdigest()


def load_model(path: str) -> tuple[list[tuple[str, float, int]], list[int], int]:
    """(piece, score, id) of the normal pieces, ids of the 256 bytes (empty without fallback), id of the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    probe = "a  ﬁ b"  # a ligature and double blanks stay only if texts aren't normalised
    if model.decode(model.encode(probe)) != probe:
        raise ValueError(f"{path} normalises texts")
    at = {model.id_to_piece(i): i for i in ids if model.is_byte(i)}
    return [(model.id_to_piece(i), model.get_score(i), i) for i in normal], [at[f"<0x{b:02X}>"] for b in range(256)] if at else [], model.unk_id()


class Remembered(dict):
    """What `make` gives for a key.  A full memory becomes the old half, whose keys are kept if they come again before the new half is full."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key: str):
        found = self.old.get(key) or self.make(key)
        if len(key) <= 64:
            if len(self) >= REMEMBERED_CHUNKS:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class State(dict):
    """A state of the automaton: the state after each next character, found out when a text first takes it."""

    __slots__ = ("automaton", "text", "tokens")

    def __init__(self, automaton: Automaton, text: str):
        self.automaton, self.text = automaton, text
        #: of the pieces that end here, the longest first
        self.tokens = [automaton[text[k:]] for k in range(len(text)) if text[k:] in automaton]

    def __missing__(self, character: str) -> State:
        automaton = self.automaton
        if automaton.steps >= REMEMBERED_STEPS:
            for state in automaton.states.values():
                state.clear()
            automaton.steps = 0
        automaton.steps += 1
        self[character] = found = automaton.step(self.text + character)
        return found


class Automaton(dict):
    """Aho-Corasick automaton over pieces, with the token of each; its states stand for the beginnings of pieces."""

    def __init__(self, tokens: dict[str, tuple[int, int, dict]]):
        super().__init__(tokens)
        self.beginnings = {""} | {p[:k] for p in tokens for k in range(1, len(p) + 1)}
        self.states: dict[str, State] = {}
        self.root, self.steps = self.step(""), 0

    def step(self, text: str) -> State:
        """The state of the longest end of a text that begins a piece."""
        while text not in self.beginnings:
            text = text[1:]
        if text not in self.states:
            self.states[text] = State(self, text)
        return self.states[text]


class PieceCodec:
    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int], unknown_id: int):
        self.score = {p: s for p, s, _ in pieces}
        self.text = {i: p for p, _, i in pieces}
        self.byte_ids, self.unknown_id = byte_ids, unknown_id
        self.bytes_of = {i: p.replace(SPACE, " ").encode() for p, _, i in pieces} | {i: bytes([b]) for b, i in enumerate(byte_ids)} | {unknown_id: " ⁇ ".encode()}
        self.singles = {p for p in self.score if len(p) == 1}
        tokens: dict[str, tuple[int, int, dict]] = {}
        #: what a piece's last merge joined; None for single characters
        self.parts: dict[str, tuple[str, str] | None] = dict.fromkeys(self.singles)
        self.late: set[str] = set()  # pieces made by a merge that had to wait for a worse one
        for piece, _, i in sorted(pieces, key=lambda p: len(p[0])):
            steps: list[tuple[str, str]] = []
            if piece and self.merged(piece, steps) == [piece]:
                #: length, id, and which ids are compatible on the left, as far as known
                tokens[piece] = (len(piece), i, {})
                if steps:
                    self.parts[piece] = steps[-1]
                    if any(len(p) > 1 and (p in self.late or self.score[p] < self.score[piece]) for p in steps[-1]):
                        self.late.add(piece)
        self.automaton = Automaton(tokens)
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score):
            raise ValueError("a piece holds a space mark behind another character")
        joined = {c for p in self.score if len(p) > 1 for c in p}
        line = "\n" if "\n" not in joined else ""  # a newline that no longer piece holds stands alone
        self.chunk = re.compile(f"{line or '(?!)'}|{SPACE}*[^{SPACE}{line}]+|{SPACE}+")
        self.tried, self.tables = 0, [token[2] for token in self.automaton.values()]
        self.shown = {i: str(i) for i in self.bytes_of}
        #: ids and raw bytes of chunks, and of words that stand behind a blank
        self.known, self.words = Remembered(self.learnt), Remembered(self.learnt_word)

    def merged(self, text: str, steps: list[tuple[str, str]] | None = None) -> list[str]:
        """The pieces that merging makes of a short text of known characters; steps gets the pairs that were joined."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            if steps is not None:
                steps.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        if left in self.late or right in self.late:
            return self.merged(left + right) == [left, right]
        score, parts = self.score, self.parts
        over = score.get(left + right)
        if over is not None:
            return False
        while (a := parts[left]) is not None or parts[right] is not None:
            b = parts[right]
            # of equal merges the left one came first, so the right one is undone first
            if a is None or (b is not None and score[right] <= score[left]):
                made, right = score[right], b[0]
                over = score.get(left + right)
                if over is not None and over >= made:
                    return False
            else:
                made, left = score[left], a[1]
                over = score.get(left + right)
                if over is not None and over > made:
                    return False
        return True

    def found_out(self, a: int, token: tuple[int, int, dict]) -> bool:
        if self.tried >= REMEMBERED_PAIRS:
            for table in self.tables:
                table.clear()
            self.tried = 0
        self.tried += 1
        token[2][a] = ok = self.compatible(self.text[a], self.text[token[1]])
        return ok

    def run_ids(self, run: str) -> list[int]:
        """Ids of a run of known characters."""
        last: list[tuple[int, int, dict]] = [(0, -1, {})]  # of the prefix that ends at each place
        state = self.automaton.root
        for end, character in enumerate(run, 1):
            state = state[character]
            for token in state.tokens:
                start = end - token[0]
                if start:
                    a = last[start][1]
                    ok = token[2].get(a)
                    if not (self.found_out(a, token) if ok is None else ok):
                        continue
                last.append(token)
                break
        ids, at = [], len(run)
        while at:
            length, token, _ = last[at]
            ids.append(token)
            at -= length
        ids.reverse()
        return ids

    def chunk_ids(self, chunk: str) -> list[int]:
        if self.singles.issuperset(chunk):
            return self.run_ids(chunk)
        ids: list[int] = []
        at = 0
        for k, c in enumerate(chunk):
            if c in self.singles:
                continue
            ids += self.run_ids(chunk[at:k])
            if self.byte_ids:
                ids += [self.byte_ids[b] for b in c.encode()]
            elif not ids or ids[-1] != self.unknown_id or k > at:
                ids.append(self.unknown_id)
            at = k + 1
        return ids + self.run_ids(chunk[at:])

    def encode(self, text: str | None) -> list[int]:
        return [i for c in self.chunks(text) for i in self.chunk_ids(c)]

    def chunks(self, text: str | None) -> list[str]:
        return self.chunk.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def raw(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for, with a blank for each space mark."""
        return b"".join([self.bytes_of.get(i, b"") for i in ids])

    def marked(self, ids: list[int]) -> bool:
        """Whether ids, control ids aside, begin with the mark that encoding puts before a text."""
        first = next((i for i in ids if i in self.bytes_of), None)
        return self.text.get(first, "").startswith(SPACE)

    @staticmethod
    def readable(raw: bytes) -> str:
        """The text of raw bytes; each byte that isn't UTF-8 is a U+FFFD."""
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return "".join("�" * len(c) if (c := raw[a:b]) and bad else c.decode() for a, b, bad in _spans(raw))

    def decode(self, ids: list[int]) -> str:
        runs: list[list[int]] = [[]]
        for i in ids:
            if i in self.bytes_of:
                runs[-1].append(i)
            else:  # a control id says nothing, but it ends a run of bytes
                runs.append([])
        raw = [self.raw(run) for run in runs]
        if self.marked(ids):
            at = next(k for k, r in enumerate(raw) if r)
            raw[at] = raw[at][1:]
        return "".join(map(self.readable, raw))

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and digests of the ids and of what they decode to."""
        if not text:
            return 0, EMPTY, EMPTY
        spaced = " " + text
        if "  " in spaced or SPACE in text:
            ids, raw = self.joined(self.chunks(text))
        else:  # a chunk begins at each blank
            found = list(map(self.words.__getitem__, text.split(" ")))
            ids, raw = ",".join([f[0] for f in found]), b"".join([f[1] for f in found])
        decoded = self.readable(raw[1:])  # the first chunk begins with the mark
        return ids.count(",") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    def joined(self, chunks: list[str]) -> tuple[str, bytes]:
        found = list(map(self.known.__getitem__, chunks))
        return ",".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def learnt(self, chunk: str) -> tuple[str, bytes]:
        """Ids and raw bytes of a chunk."""
        ids, shown, bytes_of = self.chunk_ids(chunk), self.shown, self.bytes_of
        return ",".join([shown[i] for i in ids]), b"".join([bytes_of[i] for i in ids])

    def learnt_word(self, word: str) -> tuple[str, bytes]:
        """Ids and raw bytes of a word with the mark before it; a newline may cut it into several chunks."""
        if "\n" not in word:
            return self.learnt(SPACE + word)
        chunks = self.chunk.findall(SPACE + word)
        if len(chunks) == 1:
            return self.learnt(chunks[0])
        first = self.words[chunks[0][1:]]
        ids, raw = self.joined(chunks[1:])
        return f"{first[0]},{ids}", first[1] + raw


def _spans(raw: bytes) -> Iterator[tuple[int, int, bool]]:
    """Parts of raw as (start, end, whether it is outside UTF-8)."""
    at = 0
    while at < len(raw):
        try:
            raw[at:].decode()
            yield at, len(raw), False
            return
        except UnicodeDecodeError as e:
            if e.start:
                yield at, at + e.start, False
            yield at + e.start, at + e.start + 1, True
            at += e.start + 1


_codecs: dict = {}


def _over(docs: DataFrame, model_path: str, columns: list, schema: str, made) -> DataFrame:
    """made(codec, values) over the last of the selected columns; the first is kept; a narrow scan."""
    import pyarrow as pa

    model = load_model(model_path)
    vocabulary = docs.sparkSession.sparkContext.broadcast(model)  # a tokenizer's vocabulary: bounded
    content = hashlib.sha256(repr(model).encode()).hexdigest()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codecs.get(content)
        if codec is None:
            _codecs.clear()
            codec = _codecs[content] = PieceCodec(*vocabulary.value)
        for b in in_blocks(batches):
            out = made(codec, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, t) for v, t in out)], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(*columns).mapInArrow(scanned, schema)


def encode_documents(docs: DataFrame, model_path: str = MODEL_PATH, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, ids (array of int) for each row."""
    import pyarrow as pa

    columns = [F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")]
    return _over(docs, model_path, columns, "doc_id long, ids array<int>", lambda codec, texts: [([codec.encode(t) for t in texts], pa.list_(pa.int32()))])


def decode_documents(encoded: DataFrame, model_path: str = MODEL_PATH, ids_column: str = "ids", id_column: str = "doc_id") -> DataFrame:
    """doc_id, text for rows with arrays of ids (null: none)."""
    import pyarrow as pa

    columns = [F.col(id_column).cast("long").alias("doc_id"), F.col(ids_column).cast("array<int>").alias("ids")]
    return _over(encoded, model_path, columns, "doc_id long, text string", lambda codec, rows: [([codec.decode(ids or []) for ids in rows], pa.string())])


def piece_digests(docs: DataFrame, model_path: str = MODEL_PATH, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row; a narrow scan without a shuffle."""
    import pyarrow as pa

    def made(codec: PieceCodec, texts: list) -> list:
        found = [codec.digests(t) for t in texts]
        return [([f[0] for f in found], pa.int64()), ([f[1] for f in found], pa.string()), ([f[2] for f in found], pa.string())]

    columns = [F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")]
    return _over(docs, model_path, columns, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", made)
