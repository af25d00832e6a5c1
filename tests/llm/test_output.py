"""Exact copies, token files and packing against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.encoding import Encoder
from tidemark.llm.exact_copies import drop_copies, exact_copies
from tidemark.llm.packing import best_fit_decreasing, pack
from tidemark.llm.token_files import read_documents, sequence, write_token_files

SCHEMA = "doc_id bigint, text string, h string, keep_id int"
AWKWARD = [
    (3, "one two  three", "x", 1), (1, None, "x", 2), (2, "", None, 3), (7, "One two", "y", None), (9, "One two", "y", 4),
    (4, " lead and trail ", "z", 5), (5, "a<|endoftext|> b", "z", 5), (8, "été\n\n  fin\tx", "z", 5), (6, "word " * 9000, "z", 1),
    (11, "it's 12 o'clock; don't", "q", 1), (12, "日本 語 ü", "q", 1), (13, "One two", "q", 9),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def expected_copies(rows, keep):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        best = keep(ids)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, best, len(ids), i == best, sha) for i in ids]
    return sorted(out)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("bound", [100, 0])
def test_exact_copies(spark, awkward, keep, bound):
    found = exact_copies(awkward, keep=keep, broadcast_rows=bound)
    assert sorted(map(tuple, found.collect())) == expected_copies(AWKWARD, {"min": min, "max": max}[keep])


@pytest.mark.parametrize("bound", [100, 0])
def test_colliding_hashes_are_split_by_bytes(spark, awkward, bound):
    weak = lambda text: F.unhex(F.substring(F.md5(text), 1, 1).rlike("[0-7]").cast("int").cast("string"))
    found = exact_copies(awkward, digest=weak, broadcast_rows=bound)
    assert sorted(map(tuple, found.collect())) == expected_copies(AWKWARD, min)


def test_exact_copies_defined_cases(spark, awkward):
    assert exact_copies(awkward.limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a"), (1, "a"), (None, "b"), (2, "c"), (2, "c")], "doc_id bigint, text string")
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_copies(rows).collect()}
    assert found == {(None, 1, 2, False), (1, 1, 2, True), (None, None, 1, True), (2, 2, 2, True)}
    assert sorted(r.doc_id for r in drop_copies(awkward).collect()) == [1, 3, 4, 5, 6, 7, 8, 11, 12]


def library_ids(name, text, end):
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_words_give_the_library_ids(name):
    encoder, plain = Encoder(public_tokenizers.path(name), remember=40), Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(5)
    parts = ["word", "don't", "word,", "Été...", "l'", "x<|", "ÆØ!?", "Éa\n", "12", "x.\n\ny", " ", "", "\t", " ", "é", "ΑΣ", "--", "日本", "　", "'s", "<|endoftext|>", "\x1c", "́z"]
    for _ in range(80):
        texts = [rng.choice([" ", "  ", ""]).join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(10)]
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_go_to_the_library_once(monkeypatch):
    """Also with other white space between them, in capitals and before punctuation, where the vocabulary knows no difference."""
    name, rng, sent = "word_bpe_49k.json", random.Random(3), []
    encoder, plain = Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    whole = Encoder._ids
    monkeypatch.setattr(Encoder, "_ids", lambda self, parts: whole(self, [sent.append(p) or p for p in parts]))
    words = ["".join(rng.choices("abcdeéß", k=5)) for _ in range(300)]
    texts = ["".join(rng.choice([w, w.capitalize(), w + "."]) + rng.choice("  \n\t") for w in rng.choices(words, k=200)) for _ in range(50)]
    texts += ["", "\n", "one\xa0two\x1cthree", " a<|endoftext|>b\n"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(sent) <= len(words) + 10


@pytest.mark.parametrize("length, rows", [(8, 2), (64, 3), (2048, 64)])
def test_token_files_round_trip(spark, awkward, length, rows):
    name = "byte_bpe_50k.json"
    files = write_token_files(awkward, public_tokenizers.path(name), length=length, rows_per_batch=rows)
    expected, start, stream = [], 0, []
    for doc_id, text, *_ in sorted(AWKWARD):
        ids = library_ids(name, text, 0)
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, read_documents(spark, files).collect())) == expected
    first = files.manifest(spark).orderBy("shard").first()
    for _, text, *_ in sorted(AWKWARD)[: first.n_docs]:
        stream += library_ids(name, text, 0)
    for i in range(first.n_sequences):
        ids, mask = sequence(f"{files.folder}/{first.file}", i, rows)
        assert len(ids) == length
        assert ids[mask].tolist() == stream[i * length : (i + 1) * length]


def test_token_files_defined_cases(spark, awkward):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert read_documents(spark, write_token_files(awkward.limit(0), path)).count() == 0
    rows = spark.createDataFrame([(None, "a"), (1, None), (1, "b"), (1, "b")], "doc_id bigint, text string")
    found = sorted(read_documents(spark, write_token_files(rows, path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, 1, 1, 1] and found[0].start == 0
    assert [b.start - a.start for a, b in zip(found, found[1:], strict=False)] == [r.n_tokens for r in found[:-1]]
    assert sorted(r.n_tokens for r in found) == [1, 2, 2, 2]


def naive_best_fit(lengths, window):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(window - length)
    return rooms


@pytest.mark.parametrize("seed", range(12))
def test_best_fit_decreasing_equals_piece_by_piece(seed):
    rng = random.Random(seed)
    window = rng.choice([7, 16, 100, 4096])
    lengths = [rng.randint(1, window) if rng.random() < 0.6 else rng.choice([1, window // 3 + 1]) for _ in range(rng.randint(1, 400))]
    plan = best_fit_decreasing(Counter(lengths), window)
    covered, filled = Counter(), {}
    for length, first, last, start, per, offset in plan:
        for k in range(last - first + 1):
            covered[length] += 1
            filled.setdefault(start + k // per, []).append((offset + k % per * length, length))
    assert covered == Counter(lengths)
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(window - sum(n for _, n in s) for s in filled.values()) == sorted(naive_best_fit(lengths, window))


def test_pack_pieces(spark, awkward):
    name = "word_bpe_49k.json"
    for window in (5, 64, 4096):
        rows = pack(awkward, public_tokenizers.path(name), window=window).collect()
        texts = {d: t for d, t, *_ in AWKWARD}
        whole = {}
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == len(whole.setdefault(r.doc_id, [])) and 1 <= r.length <= window
            whole[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
        assert whole == {d: library_ids(name, t, 2) for d, t in texts.items()}
        assert all(r.doc_tokens == len(whole[r.doc_id]) for r in rows)
        sequences = {}
        for r in rows:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for spans in sequences.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= window
        assert len(sequences) == len(naive_best_fit([r.length for r in rows], window))
    assert pack(awkward.limit(0), public_tokenizers.path(name)).count() == 0
