"""Piece encoding and decoding against the tokenizer's own library."""

import hashlib
import random

import pytest
import sentencepiece

from framelake.llm.op11_pieces import MODEL_PATH, PieceCodec, decode_documents, encode_documents, load_model, piece_digests

ALPHABET = "ab teh▁ \n\t\x00éß😀中文ingion's.,<0x41>"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(*load_model(MODEL_PATH))


def expected(library, text):
    ids = library.encode(text or "")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))


def test_texts_of_odd_characters_and_long_runs(library, codec):
    r = random.Random(11)
    texts = ["", " ", "x" * 20_000, " " * 333, "▁" * 40 + "a", "\n" * 50, "ab" * 9_000 + "😀" * 100, *(" " * n + "the" for n in range(60))]
    texts += ["".join(r.choice(ALPHABET) for _ in range(r.randrange(40))) for _ in range(4000)]
    for text in texts:
        ids = library.encode(text)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids)
        assert codec.digests(text) == expected(library, text)


def test_arbitrary_ids_decode_as_in_the_library(library, codec):
    r = random.Random(12)
    for _ in range(4000):
        ids = [r.randrange(library.get_piece_size() if r.random() < 0.5 else 270) for _ in range(r.randrange(8))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_pairs_are_compatible_if_merging_keeps_them(codec):
    r = random.Random(13)
    usable = [codec.text[t[1]] for t in codec.automaton.values()]
    blanks = [p for p in usable if not p.strip("▁")]
    pairs = [(a, b) for a in blanks for b in blanks] + [(r.choice(usable), r.choice(usable)) for _ in range(20_000)]
    for _ in range(20_000):  # and parts of one piece, which compete with it
        p, q = r.choice(usable), r.choice(usable)
        joint = p + q
        k = r.randrange(1, len(joint)) if len(joint) > 1 else 1
        pairs += [(joint[:k], joint[k:])] if joint[:k] in codec.parts and joint[k:] in codec.parts else []
    for a, b in pairs:
        assert codec.compatible(a, b) == (codec.merged(a + b) == [a, b]), (a, b)


def test_pieces_that_score_above_their_parts():
    # abc scores highest, but waits for ab; in b|cd the merge of cd comes first
    codec = PieceCodec([(p, s, i) for i, (p, s) in enumerate([("▁", -50.0), ("a", -50.0), ("b", -50.0), ("c", -50.0), ("d", -50.0), ("ab", -9.0), ("abc", -1.0), ("cd", -5.0), ("abcd", -7.0)])], [], 99)
    assert codec.late
    r = random.Random(2)
    for _ in range(2000):
        run = "".join(r.choice("abcd") for _ in range(r.randrange(1, 12)))
        assert [codec.text[i] for i in codec.run_ids(run)] == codec.merged(run), run


def test_bounded_memories_do_not_change_results(library, monkeypatch):
    from framelake.llm import op11_pieces

    monkeypatch.setattr(op11_pieces, "REMEMBERED_CHUNKS", 3)
    monkeypatch.setattr(op11_pieces, "REMEMBERED_PAIRS", 2)
    codec = PieceCodec(*load_model(MODEL_PATH))
    text = "the cat sat on the mat, the cat and thereabouts " * 3
    assert codec.digests(text) == expected(library, text)


def test_words_that_come_again_are_encoded_once(library, monkeypatch):
    from framelake.llm import op11_pieces

    monkeypatch.setattr(op11_pieces, "REMEMBERED_CHUNKS", 100)
    monkeypatch.setattr(op11_pieces, "REMEMBERED_STEPS", 50)
    codec, runs = PieceCodec(*load_model(MODEL_PATH)), []
    run_ids = codec.run_ids
    monkeypatch.setattr(codec, "run_ids", lambda run: runs.append(run) or run_ids(run))
    text = " ".join(f"frequent new{k}" for k in range(1000))
    assert codec.digests(text) == expected(library, text)
    assert runs.count("▁frequent") == 1
    for text in ("of.\nWas\n\nof", "\n", "a \nb", " a", "a ", "a  b", "▁a b", "a\n▁b"):
        assert codec.digests(text) == expected(library, text), text


def test_models_that_this_method_can_not_serve_are_refused():
    with pytest.raises(ValueError):
        PieceCodec([("a▁b", -1.0, 5), ("a", -2.0, 6)], [], 0)


def test_without_byte_fallback_unknown_runs_are_one_id():
    codec = PieceCodec([("▁", -3.0, 1), ("a", -2.0, 2), ("▁a", -1.0, 3)], [], 0)
    assert codec.encode("a??a? ?") == [3, 0, 2, 0, 1, 0]


@pytest.mark.parametrize("kind", ["odd", "none", "clashing"])
def test_tables(spark, request, library, kind):
    docs = request.getfixturevalue(kind)
    want = sorted(((d.doc_id, *expected(library, d.text)) for d in docs.collect()), key=str)
    assert sorted((tuple(r) for r in piece_digests(docs).collect()), key=str) == want
    encoded = encode_documents(docs)
    assert sorted((len(r.ids) for r in encoded.collect())) == sorted(w[1] for w in want)
    back = [hashlib.sha256(r.text.encode()).hexdigest() for r in decode_documents(encoded).collect()]
    assert sorted(back) == sorted(w[3] for w in want)


def test_documents_of_the_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted((d.doc_id, *expected(library, d.text)) for d in docs.collect())
    assert sorted(tuple(r) for r in piece_digests(docs).collect()) == want
