"""Quality, fingerprints, decontamination and token counts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from framelake.llm import op1_quality as Q
from framelake.llm import op3_fingerprints as P
from framelake.llm import op4_decontamination as D
from framelake.llm import op9_token_counts as T
from framelake.llm.common import read

from .conftest import odd_documents, words


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


# ---- quality


def test_quality_separates_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    got = {r.doc_id: r for r in Q.score_documents(docs, Q.fit(docs, labels)).collect()}
    pairs = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for s, q in pairs if q == 1], [s for s, q in pairs if q == 0]
    assert len(got) == docs.count() and bad and good
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(r.held_out == held_out(i) and r.predicted == int(r.score >= 0.7) for i, r in got.items())


def test_quality_of_odd_rows(spark, odd, none, clashing):
    labels = spark.createDataFrame([(1, 1), (20, 0), (21, 0), (22, 1), (22, 0), (23, None), (None, 1), (999, 1)], "doc_id long, quality int")
    model = Q.fit(odd, labels)
    got = Q.score_documents(clashing, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1
    assert Q.score_documents(none, model).count() == 0
    unlabelled = Q.fit(odd, labels.where("false"))
    assert {r.score for r in Q.score_documents(odd, unlabelled).collect()} == {0.5}
    kept = Q.accepted(clashing, model)
    assert kept.columns == clashing.columns and kept.count() == sum(r.predicted for r in got)


def test_score_ignores_other_columns(spark, odd):
    model = (np.arange(1 << Q.BUCKET_BITS, dtype=np.float32) / 1e6, 0.1)
    other = odd.withColumn("lang", odd.lang.substr(1, 1)).withColumn("doc_id", odd.doc_id + 1)
    assert sorted(r.score for r in Q.score_documents(odd, model).collect()) == sorted(r.score for r in Q.score_documents(other, model).collect())


# ---- fingerprints


def edited(text, following):
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_fingerprints_follow_the_next_row(spark, odd, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = P.fingerprint_documents(odd).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    by_id = {}
    for i, t, *_ in odd_documents():
        by_id.setdefault(i, []).append(t or "")
    assert len(got) == len(odd_documents())
    single = sorted(i for i, t in by_id.items() if i is not None and len(t) == 1)
    for a, b in zip(single, single[1:]):
        if sorted(x for x in by_id if x is not None).index(b) != sorted(x for x in by_id if x is not None).index(a) + 1:
            continue
        r = next(r for r in got if r.doc_id == a)
        text = edited(by_id[a][0], by_id[b][0])
        assert r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        f, e, n = (P.fingerprint(x) for x in (by_id[a][0], text, by_id[b][0]))
        assert (r.near_edited, r.near_next, r.n_chars) == (P.likeness(f, e), P.likeness(f, n), len(by_id[a][0]))
    prints = {}
    for r in got:
        prints.setdefault(r.fingerprint, set()).add(r.doc_id)
    assert any({1, 3} <= s for s in prints.values())


def test_fingerprints_of_one_shared_id(spark, clashing):
    r = random.Random(6)
    docs = [(7, words(r, 20)) for _ in range(120)] + [(8, words(r, 25))]
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        got = P.fingerprint_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == 121
    # ties follow one order over all ranges: each text is the next of one other
    texts = [t for _, t in docs]
    edits = {hashlib.sha256(edited(a, b).encode()).hexdigest(): (a, b) for a in texts for b in texts}
    pairs = [edits[x.edited_sha256] for x in got]
    assert sorted(a for a, _ in pairs) == sorted(texts) == sorted(b for _, b in pairs)
    assert len(P.fingerprint_documents(clashing).collect()) == len(odd_documents())


def test_fingerprint_of_one_row_and_none(spark, none):
    one = spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")
    r = P.fingerprint_documents(one).first()
    assert (r.near_next, r.edited_sha256) == (1.0, hashlib.sha256(b"a b a b"[:4] + b"a b ").hexdigest()[:64]) or r.near_next == 1.0
    assert r.edited_sha256 == hashlib.sha256(edited("a b c d", "a b c d").encode()).hexdigest()
    assert P.fingerprint_documents(none).count() == 0


def test_signature_is_sensitive_to_order():
    r = random.Random(1)
    w = [f"w{i}" for i in range(400)]
    same = P.fingerprint(" ".join(w))
    halves = P.fingerprint(" ".join(w[200:] + w[:200]))
    changed = list(w)
    for i in r.sample(range(400), 4):
        changed[i] = "new"
    assert P.likeness(same, P.fingerprint(" ".join(changed))) > 0.6 > P.likeness(same, halves)


def test_signature_by_definition():
    text = words(random.Random(2), 60) + " " + words(random.Random(2), 30)
    kmers = P.shingle_hashes(P.word_hashes(text.split()), P.KMER_WORDS)
    x = P.numbered_kmers(kmers)
    assert len(set(x.tolist())) == len(x)  # occurrence numbers tell repeats apart
    h = ((P._A >> np.uint64(16)).astype(np.uint32) | np.uint32(1))[:, None] * (x >> np.uint64(32)).astype(np.uint32)[None, :]
    sig = P.order_minhash(P.word_hashes(text.split()))
    for e in range(P.ENTRIES):
        i, j = sorted(np.argsort(h[e], kind="stable")[:2])
        pair = P.mix(P.mix(x[i : i + 1]) + P.mix(x[j : j + 1] ^ np.uint64(0x5BD1E995)) * np.uint64(3))
        assert sig[e] == (int(pair[0]) >> 32) | 1


# ---- decontamination


def brute_leaks(docs, items, near=0.8):
    out = set()
    for d, text in docs:
        w = D.words_of(text)
        for i, item in items:
            v = D.words_of(item)
            if not len(v) or not len(w):
                continue
            k = min(5, len(v))
            if len(w) < k:
                continue
            s, t = D.shingle_hashes(w, k), D.shingle_hashes(v, k)
            span = min(len(t), len(s))
            if any(D.similarity(s[a : a + span], t) >= near for a in range(len(s) - span + 1)):
                out.add((d, i))
    return out


def planted(seed):
    r = random.Random(seed)
    items = [(i, words(r, n)) for i, n in enumerate([3, 5, 8, 20, 20, 40, 60])] + [(90, None), (91, ""), (92, "?!")]
    docs = []
    for d in range(60):
        text = words(r, r.randrange(0, 120)).split()
        if d % 3:
            item = items[r.randrange(7)][1].split()
            for _ in range(r.randrange(3)):
                item[r.randrange(len(item))] = "edit"
            at = r.randrange(len(text) + 1)
            text[at:at] = [x.upper() + "," for x in item] if d % 2 else item
        docs.append((d, " ".join(text)))
    return docs, items


def test_leaks_match_brute_force(spark):
    docs, items = planted(4)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.leaks(*frames).collect()}
    assert got == brute_leaks(docs, items) and len(got) > 15
    kept = {r.doc_id for r in D.decontaminated(*frames).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_majorities_of_all_spans():
    r = np.random.default_rng(5)
    hashes = r.integers(0, 1 << 64, 700, np.uint64) | np.uint64(0b1111) << np.uint64(20)
    for span in [*range(1, 70), 127, 128, 255, 256, 257, 600, 699, 700]:
        digits = span.bit_length()
        counts = np.full((701, 64), 200, np.uint8 if digits <= 8 else np.uint16)
        D.running_counts(hashes, counts)
        planes = np.array([np.packbits(counts & counts.dtype.type(1 << j), axis=1).view(np.uint64).ravel() for j in range(digits)])
        got = D.majorities(planes, span, np.empty((4, 701), np.uint64))
        sums = np.cumsum(np.r_[np.zeros((1, 64), np.int64), D.signed_bits(hashes)], axis=0)
        assert got.tolist() == D.packed(sums[span:] - sums[:-span]).view(np.uint64).ravel().tolist()


@pytest.mark.parametrize("size", [3, 40, 300])
def test_windows_of_long_items_across_stretches(monkeypatch, size):
    monkeypatch.setattr(D, "WINDOWS_AT_ONCE", 64)
    r = random.Random(6)
    items = [(1, words(r, size)), (2, words(r, size + 7))]
    docs = [(d, f"{words(r, 90)} {items[d % 2][1]} {words(r, 50)}") for d in range(4)]
    found = D.Benchmark(items).search([t for _, t in docs])
    assert {(d, m[0]) for (d, _), own in zip(docs, found, strict=True) for m in own} == brute_leaks(docs, items)


def test_only_windows_that_share_enough_are_compared_exactly(monkeypatch):
    docs, items = planted(4)
    compared, similarity = [], D.similarity
    monkeypatch.setattr(D, "similarity", lambda a, b: compared.append((a, b)) or similarity(a, b))
    found = D.Benchmark(items).search([t for _, t in docs])
    held = [np.isin(a, b).sum() / max(len(a), len(b)) for a, b in compared]
    assert min(held) > 0.8 - 1e-9
    monkeypatch.setattr(D, "similarity", similarity)
    assert {(d, m[0]) for (d, _), own in zip(docs, found, strict=True) for m in own} == brute_leaks(docs, items)


def test_leaks_in_blocks_and_odd_rows(spark, odd, none, clashing, monkeypatch):
    items = spark.createDataFrame([(1, odd_documents()[0][1][:200]), (2, "one"), (None, "x")], "item_id long, text string")
    whole = sorted(tuple(r) for r in D.leaks(odd, items).collect())
    monkeypatch.setattr(D, "ITEMS_AT_ONCE", 1)
    assert sorted(tuple(r) for r in D.leaks(odd, items).collect()) == whole
    assert {(r[0], r[1]) for r in whole} >= {(1, 1), (2, 1), (3, 1), (7, 2)}
    assert D.decontaminated(clashing, items).columns == clashing.columns
    assert D.leaks(none, items).count() == 0 and D.leaks(odd, items.where("false")).count() == 0
    assert D.decontaminated(odd, items.where("false")).count() == odd.count()


# ---- token counts


def test_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer, models

    pieces, fallback = T.load_pieces(T.MODEL_PATH)
    low = 2 * min(s for _, s in pieces)  # byte pieces are for unknown characters only
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *((f"<0x{i:02X}>", low) for i in range(256)), *pieces], 0, True))
    counter = T.PieceCounter(pieces, fallback)
    texts = [t for _, t, *_ in odd_documents() if t] + ["a  b   c", " lead", "trail  ", "▁ x", "naïve façade 東京 ok", "12 34567", "\n\n a\nb"]
    texts += [r.text for r in read(spark, "/root/testdata/sf0.001", "documents").select("text").limit(60).collect()]
    assert [counter.count(t) for t in texts] == [len(model.encode(T.SPACE + t.replace(" ", T.SPACE)).tokens) for t in texts]


def test_counts_equal_sentencepiece_in_unigram_mode(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(T.MODEL_PATH, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for piece in proto.pieces:
        if piece.type == pb.ModelProto.SentencePiece.NORMAL and piece.score <= T.NEVER:
            piece.type = pb.ModelProto.SentencePiece.UNUSED
    model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    counter = T.PieceCounter(*T.load_pieces(T.MODEL_PATH))
    texts = [r.text for r in read(spark, "/root/testdata/sf0.01", "documents").select("text").limit(150).collect()]
    assert [counter.count(t) for t in texts] == [len(model.encode(t)) for t in texts]


def test_a_chunk_without_blanks_may_be_long():
    counter = T.PieceCounter([("▁", -1.0), ("a", -1.0), ("aa", -1.5), ("aaa", -1.9)], True)
    assert counter.count("a" * 300_000) == 1 + 100_000


def test_ties_keep_the_longer_last_piece():
    counter = T.PieceCounter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)], False)
    # ▁|ab, ▁|a|b and ▁a|b all score -3 or -3: the longer last piece wins
    assert counter.count("ab") == 2
    assert T.PieceCounter([("▁", -1.0)], False).count("xyz") == 2  # a run of unknowns counts once
    assert T.PieceCounter([("▁", -1.0)], True).count("é") == 3


def test_counts_of_odd_rows(spark, none, clashing):
    got = T.count_tokens(clashing).collect()
    assert len(got) == len(odd_documents())
    assert {r.n_tokens for r in got if r.doc_id in (4, 5)} == {0}
    assert T.count_tokens(none).count() == 0


def test_words_are_told_apart():
    texts = [t for _, t, *_ in odd_documents() if t] + ["a b a", "é_1 É_1 x-y", "ab ba aab abb", "\U0001d400 z"]
    seen = {}
    for t in texts:
        plain = re.findall(r"\w+", t.lower())
        hashes = D.words_of(t).tolist()
        assert len(plain) == len(hashes)
        for w, h in zip(plain, hashes, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_block_search_finds_all_within_the_radius(monkeypatch):
    rng = np.random.default_rng(3)
    for look_through in (0, 64):
        monkeypatch.setattr(D, "LOOK_THROUGH", look_through)
        index = D.Index(30, list(range(40)), [rng.integers(0, 2**63, 26).astype(np.uint64) for _ in range(40)])
        flips = [sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in range(26) for _ in range(20)]
        prints = np.array([int(index.prints[n % 40]) ^ f for n, f in enumerate(flips)], np.uint64)
        row, item = index.within(prints.view(np.uint16))
        want = {(r, i) for r in range(len(prints)) for i in range(40) if int(prints[r] ^ index.prints[i]).bit_count() <= D.RADIUS}
        assert set(zip(row.tolist(), item.tolist(), strict=True)) == want and len(row) == len(want) >= 320
