"""Token files, the BPE lexicon and the fingerprints against the library and plain Python."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sightline.llm import fingerprints, lexicon, pretokens, textkit, token_files

from .test_core import SCHEMA, corpus, frame, odd_rows

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PIECES = [*"x 'é€—\n\t", "'s", " 're", "''s", "'sab", "a'll", "  ", " \n a", "12 3", "Ünï", "“q”", "!?", "it's", "I'M", "日本", "😀", "<|endoftext|>", "\r\n", "'d'd", "9's", "--'t", "İx", "ΑΣ", "é", "aaaaaaa", "the of and", " ", "\x1c", "²", "ª"]


def odd_texts(n=3000):
    rng = random.Random(11)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_encoder_equals_library():
    texts = odd_texts()
    library = Tokenizer.from_file(BYTE)
    for text, ids in zip(texts, token_files.Encoder(BYTE).column(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("rows", ["odd", "corpus"])
def test_token_files(spark, rows):
    rows = odd_rows() if rows == "odd" else corpus(spark)
    library = Tokenizer.from_file(BYTE)
    manifest = token_files.write_token_files(frame(spark, rows).repartition(3), BYTE, end_id=2)
    got = token_files.read_token_files(manifest).collect()
    expected, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    some = spark.createDataFrame([(rows[0][0],), (rows[5][0],)], "doc_id long")
    found = {r.doc_id: r.ids for r in token_files.read_ids(manifest, some).collect()}
    assert found == {rows[k][0]: [*library.encode(rows[k][1] or "", add_special_tokens=False).ids, 2] for k in (0, 5)}


def test_damaged_frame_is_found(spark, tmp_path):
    manifest = token_files.write_token_files(frame(spark, corpus(spark)[:20]), BYTE, 2, f"file://{tmp_path}").collect()
    path = manifest[0].path
    raw = bytearray(open(path, "rb").read())
    reader = token_files.Reader(pafs.LocalFileSystem().open_input_file(path))
    reader.frame(0)
    reader.table = reader.table.copy()
    reader.table[0, 2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        reader.frame(0)
    assert raw[-4:] == (0x8F92EAB1).to_bytes(4, "little")


@pytest.mark.parametrize("rows", ["odd", "texts", "corpus"])
def test_bpe_round_trip(spark, rows):
    rows = odd_rows() if rows == "odd" else corpus(spark) if rows == "corpus" else [(i, t, "s") for i, t in enumerate(odd_texts(600))]
    library = Tokenizer.from_file(WORD)
    got = lexicon.encode_decode(frame(spark, rows), WORD, size=500).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert Counter(map(tuple, got)) == Counter(expected)


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = sorted({f"{a}{b}{c}".encode() for a in ("", "un", "re") for b in ("do", "load", "pack") for c in ("", "ing", "ed", "s")})
    path = tmp_path / "lexicon.bin"
    path.write_bytes(lexicon.compile_lexicon([(w, [k, k + 1]) for k, w in enumerate(words)]))
    found = lexicon.Lexicon(str(path))
    assert found.find(words).tolist() == list(range(len(words)))
    assert found.find([b"undoin", b"x", b"doo", b"loads!"]).tolist() == [-1] * 4
    assert [found.ids_at(k) for k in (0, 7)] == [[0, 1], [7, 8]]
    # states differ by what may follow: equal sets of suffixes are one state
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    assert len(found.finals) == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})


def brute_compare(rows):
    ordered = sorted([(i, t or "") for i, t, _ in rows], key=lambda r: r[1].encode())
    ordered = sorted(ordered, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (doc_id, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        marks = [fingerprints.fingerprints(pa.array([t]))[0] for t in (text, edited, after)]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), *marks))
    return Counter(out)


@pytest.mark.parametrize("rows", ["odd", "corpus", "one"])
def test_fingerprints(spark, rows):
    rows = {"odd": odd_rows, "corpus": lambda: corpus(spark), "one": lambda: [(5, "lonely text " * 9, "s")]}[rows]()
    got = fingerprints.compare_with_next(frame(spark, rows).repartition(5)).collect()
    assert Counter(tuple(r)[:6] for r in got) == brute_compare(rows)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.fingerprint != r.edited_fingerprint or r.near_edited == 1
    if len(rows) > 100:
        long = [r for r in got if r.n_chars > 500]
        assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.3


def test_likeness_meets_at_common_blocks(spark):
    rows = [("6:AAAA:BB", "3:xx:AAAA"), ("3:xx:AAAA", "6:AAAA:BB"), ("3:AAAB:C", "3:AAAA:C"), ("3:AA:AA", "12:AA:AA"), ("3::", "3::"), ("3::", "3:A:B")]
    got = spark.createDataFrame(rows, "a string, b string").select(fingerprints.likeness(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [1, 1, 0.75, 0, 1, 0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert token_files.read_token_files(token_files.write_token_files(none, BYTE, 2)).count() == 0
    assert lexicon.encode_decode(none, WORD).count() == 0
    assert fingerprints.compare_with_next(none).count() == 0


def test_long_words_equal_the_library():
    rules, library, rng = lexicon.Merges(WORD), Tokenizer.from_file(WORD), random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["a" * 5000, "ab" * 3000 + "a", "the" * 2000, "".join(rng.choice(letters) for _ in range(20_000)), "".join(rng.choice(["ing", "er", "th", "e", "n", "straße", "é"]) for _ in range(4000)), "日本語" * 800]
    for text in texts:
        for word in rules.slow_words(text):
            shown = "".join(rules.letters[b] for b in word)
            assert len(word) > lexicon.LONG_WORD and rules.long_ids(word) == rules.ids([word])[0]
            assert "".join(rules.token[i] for i in rules.long_ids(word)) == shown + rules.end
        assert [i for w in rules.slow_words(text) for i in rules.ids([w])[0]] == library.encode(text, add_special_tokens=False).ids
    short = ["hello", "aaaaaaa", "straße", "x"]
    assert [rules.long_ids(w.encode()) for w in short] == rules.ids([w.encode() for w in short])


def test_a_word_of_a_megabyte(spark):
    rows = [(1, "x" * (1 << 20), "s"), (2, "word " + "lo" * (1 << 18), "s")]
    library = Tokenizer.from_file(WORD)
    got = {r.doc_id: r.n_tokens for r in lexicon.encode_decode(frame(spark, rows), WORD).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t, _ in rows}


def test_a_file_that_is_not_the_lexicon_is_not_trusted(tmp_path, monkeypatch):
    monkeypatch.setattr(lexicon.tempfile, "gettempdir", lambda: str(tmp_path))
    block = lexicon.compile_lexicon([(b"ab", [7]), (b"abc", [8, 9])])
    name = tmp_path / f"lexicon-{hashlib.sha256(block).hexdigest()[:24]}.bin"
    name.write_bytes(block[:-1])
    assert lexicon.mapped(block).find([b"ab", b"abc", b"x"]).tolist() == [0, 1, -1] and name.read_bytes() == block


def test_splitting_takes_little_memory(spark):
    """What a counting or encoding task holds while it splits does not grow with its texts."""
    words = [f"w{k % 977}x" for k in range(400_000)]
    column = pa.array([" ".join(words[k : k + 400]) for k in range(0, len(words), 400)])
    tracemalloc.start()
    for part in textkit.slices(column, lexicon.SLICE_BYTES):
        pretokens.split(part, clip=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
