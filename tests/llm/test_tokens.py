"""Token codes and byte-level BPE against the tokenizer libraries and by round trips."""

import random
import sys
import types
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from loglane.llm import bpe, dac

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BITS = ["a", "Bé", "  ", "\n", "ж", "字", "　", "'s", "1", "٣", "!?", "\U00011de0", "ՠ", "՘", "😀", "\x85", "the", " ing", "\x1c", "é", "<|endoftext|>"]


def texts(n):
    r = random.Random(4)
    return [None, "", " ", "a" * 50_000] + ["".join(r.choice(BITS) for _ in range(r.randrange(50))) for _ in range(n)]


def test_levels():
    r = np.random.default_rng(1)
    for ids in (np.zeros(0), np.zeros(3), r.integers(0, 1 << 32, 5000), r.integers(0, 300, 5000), np.full(1025, 256)):
        ids = ids.astype(np.uint32)
        levels = dac.encode_levels(ids)
        assert (dac.decode_levels(*levels[:2]) == ids).all()
        assert [dac.token_at(*levels, i) for i in range(0, len(ids), 7)] == ids[::7].tolist()


def test_codes(spark, monkeypatch):
    monkeypatch.setattr(dac, "SHARD_IDS", 500)
    rows = [(i // 3 if i % 7 else None, t, "x", "y") for i, t in enumerate(texts(400))] + [(5, "hot", "x", "y")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, bucket string")
    library = Tokenizer.from_file(WORDS)
    want = sorted(((-1 if r[0] is None else r[0]), [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows)
    files = dac.written(docs, WORDS)
    got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in dac.documents(files).collect())
    assert sorted(x[1:] for x in [tuple(g) for g in got]) == [tuple(w) for w in want]
    assert [g[1] for g in got] == [w[0] for w in want]
    ends = np.cumsum([len(g[2]) for g in got])
    assert [g[0] for g in got] == [0, *ends[:-1].tolist()]
    line = [i for g in got for i in g[2]]
    places = spark.range(-3, len(line) + 3, 5).withColumnRenamed("id", "place")
    assert {r.place: r.id for r in dac.tokens_at(files, places).collect()} == {i: line[i] for i in range(-3, len(line) + 3, 5) if 0 <= i < len(line)}
    sums = {r.start: r.ids_crc32 for r in dac.checked(files).collect()}
    assert sums == {g[0]: zlib.crc32(np.array(g[2], "<u4").tobytes()) for g in got}


def test_codes_of_nothing(spark):
    assert dac.checked(dac.written(spark.createDataFrame([], "doc_id long, text string"), WORDS)).count() == 0


def test_words():
    r = random.Random(9)
    for n in (1, 2, 5, 30, 64, 65, 700):
        word = bytes(r.choice(b"abcde the\xc3\xa9\xff") for _ in range(n))
        assert bpe.bpe(word, RANKS) == bpe._bpe_long(word, RANKS) or word in RANKS
        assert bpe.TokenBytes(RANKS).decode(np.array(bpe.bpe(word, RANKS))) == word


def test_positions():
    r = np.random.default_rng(2)
    runs = [np.sort(r.choice(1 << 22, k, replace=False)) for k in (0, 1, 5, 3000, 0)] + [np.array([0, (1 << 31) - 1])]
    cuts = np.concatenate(([0], np.cumsum([len(x) for x in runs])))
    back, where = bpe.unpack(bpe.pack(np.concatenate(runs), cuts))
    assert (back == np.concatenate(runs)).all() and (where == cuts).all()


def test_bpe(spark, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_WORDS", 300)
    rows = [(i // 2, t, "x", 1.5) for i, t in enumerate(texts(300))] + [(None, "same text", "x", None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, packed double")
    got = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(got, "ids", RANKS).collect()
    want = sorted((repr(r[0]), LIBRARY.encode_ordinary(r[1] or "")) for r in rows)
    assert sorted((repr(r.row.doc_id), list(r.ids)) for r in back) == want
    assert sorted(r.decoded for r in back) == sorted((r[1] or "").encode() for r in rows)
    assert {r.row.ids for r in back} == {"x"} and all(r.n_tokens == len(r.ids) for r in back)
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_a_worker_remembers_words_between_tasks(monkeypatch):
    monkeypatch.setattr(dac, "REMEMBER", 4)
    encode, kind = dac._new_encoder(WORDS)
    monkeypatch.setitem(sys.modules, "loglane_kept", types.SimpleNamespace(tokenizer_file=WORDS, encoder=(encode, kind)))
    assert dac._encoder(WORDS)[0] is encode
    library = Tokenizer.from_file(WORDS)
    for t in texts(60) * 2:
        line = (t or "").replace("\x85", " ")
        assert np.frombuffer(encode([line.encode()])[0], kind).tolist() == library.encode(line, add_special_tokens=False).ids


def test_plain_runs_go_to_the_model_at_once(monkeypatch):
    given = []

    class Counting:
        def __init__(self, whole):
            self.whole = whole

        @classmethod
        def from_file(cls, path):
            return cls(Tokenizer.from_file(path))

        def __getattr__(self, name):
            return getattr(self.whole, name)

        def encode_batch_fast(self, words, **options):
            given.extend(words)
            return self.whole.encode_batch_fast(words, **options)

    monkeypatch.setattr("tokenizers.Tokenizer", Counting)
    encode, kind = dac._new_encoder(WORDS)
    odd = ["É École, Über!! ẞ straße. ×÷ a×b", "é é, é́! x̸= o̸", "don't l'été's c'est ŉ ǅ ﬁ", "<|endoftext|>É abc<|endoftext|>", "ab1,, 1ab é9 9é.", "a\x1cb a\xa0b", ""]
    plain = ["Straße und Häuser, señor! deja vu: (nein)", "über. Über; ÜBER"]
    library = Tokenizer.from_file(WORDS)
    got = [np.frombuffer(x, kind).tolist() for x in encode([t.encode() for t in odd + plain])]
    assert got == [x.ids for x in library.encode_batch(odd + plain, add_special_tokens=False)]
    assert not {"straße", "und", "häuser", "señor", "vu", "über", "Über"} & set(given)


def test_a_string_is_looked_up_once_for_all_its_uses(monkeypatch):
    monkeypatch.setattr(dac, "SOME_STRINGS", 7)
    given, in_order = [], dac._in_order
    monkeypatch.setattr(dac, "_in_order", lambda found, *more: given.append(len(found)) or in_order(found, *more))
    encode, kind = dac._new_encoder(WORDS)
    library = Tokenizer.from_file(WORDS)
    lines = ["the cat, the dog " * 50, "", "  dog\v\fthe ", "\x1cthe\x1c"]
    got = [np.frombuffer(x, kind).tolist() for x in encode([t.encode() for t in lines])]
    assert got == [x.ids for x in library.encode_batch(lines, add_special_tokens=False)]
    # "the", "cat,", "dog", the string with separators, and the empty one.
    assert given == [5]
