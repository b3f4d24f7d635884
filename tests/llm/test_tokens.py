"""Piecewise encoding against the libraries on whole texts."""

import base64
import hashlib
from types import SimpleNamespace
from zlib import crc32

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspan.llm import bpe, packing, pieces, tokencount, tokenfile

ODD = ["", " ", "\n", "a", "don't  stop\n\n now", "\ta b", "a \n b", "x" * 300, "ab" * 500, "\x00a \x01b", "tail ", " head", "İSTANBUL ǅ ŉ", "a<|endoftext|>b", "<|startoftext|> x", "é ́", "ＡＢＣ 123456 ½", "​　漢字かな", "it's We'LL", "a\r\nb", "ß STRASSE Σίσυφος Σ", "\x1c\x85x"]
texts = st.text(st.one_of(st.sampled_from(list(" \n\tabAB'é,.1<|> ́Σ")), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def level():
    return tokenfile.level_encoder(P.path("byte_bpe_50k.json"), P.PATTERN), Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word():
    return packing.word_encoder(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


def numbers(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, max_size=6))
def test_level_vocabulary(level, some):
    encode, library = level
    some = some + ODD
    assert [numbers(encode(x)) for x in some] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, max_size=6))
def test_word_vocabulary(word, some):
    encode, library = word
    some = some + ODD
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    assert [numbers(encode(x)) for x in some] == want
    count = tokencount.word_counter(P.path("word_bpe_49k.json"))
    assert [count(x) for x in some] == [len(x) for x in want]


@settings(max_examples=10, deadline=None)
@given(st.lists(texts, max_size=20))
def test_duckdb_bpe(ranks, some):
    some = some + ODD
    engine, encode = bpe.engine_for(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = encode(some)
    assert [numbers(x) for x in ids] == [library.encode_ordinary(t) for t in some]
    assert engine.decode(ids) == [t.encode() for t in some]


def test_each_token_encodes_to_itself(ranks):
    """Long words may contract all equal least pairs at once for that reason."""
    engine, _ = bpe.engine_for(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    some = [t.decode() for t in ranks if t.isascii()]
    assert [numbers(x) for x in engine.encode_words(some)] == [[ranks[t.encode()]] for t in some]


def test_small_cache_changes_nothing(ranks):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = pieces.LevelEncoder(regex.compile(P.PATTERN).findall, lambda ws: [np.array(library.encode_ordinary(w), "<u4").tobytes() for w in ws], limit=700)
    some = ["one two three four five", "six one two", "seven"]
    for t in some:
        assert numbers(encode([t])[0]) == library.encode_ordinary(t)


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for x in (rng.integers(0, 300, 3000), np.zeros(5, int), np.array([70000, 3, 70000]), np.array([], int)):
        x = x.astype("u4")
        ids, absent, ends, m = tokenfile.read_shard(tokenfile.write_shard([7], np.array([len(x)]), x))
        assert ids.tolist() == [7] and absent.tolist() == [False] and ends.tolist() == [len(x)] and m.all().tolist() == x.tolist()
        assert [m.access(i) for i in range(0, len(x), 41)] == x[::41].tolist()
        for s in (0, 3, 299, 70000, 1 << 20):
            at = np.flatnonzero(x == s).tolist()
            assert m.count(s) == len(at) and m.count(s, len(x) // 2) == sum(i < len(x) // 2 for i in at)
            assert [m.select(s, k) for k in range(len(at))][:50] == at[:50]


def test_plan_is_gapless_and_whole():
    rng = np.random.default_rng(2)
    for capacity in (10, 64):
        histogram = {n: int(c) for n, c in enumerate(rng.integers(0, 30, capacity), 1)}
        runs = sorted(packing.plan(histogram, capacity))
        bins: dict[int, list] = {}
        for n, count in histogram.items():
            mine = [r for r in runs if r[0] == n]
            for rank in range(count):
                _, first, sequence, each, offset = [r for r in mine if r[1] <= rank][-1]
                bins.setdefault(sequence + (rank - first) // each, []).append((offset + (rank - first) % each * n, n))
        for placed in bins.values():
            end = 0
            for offset, n in sorted(placed):
                assert offset == end
                end += n
            assert end <= capacity
        assert len(bins) <= 1.1 * sum(n * c for n, c in histogram.items()) / capacity + 2


def odd_docs(spark):
    rows = [(None if i == 3 else i % 20, t, "x", None, "clash") for i, t in enumerate([*ODD, None, "same", "same"])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, digest string")


def test_operators_on_odd_rows(spark, tmp_path):
    docs, path = odd_docs(spark), P.path("word_bpe_49k.json")
    texts = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    library, level = Tokenizer.from_file(path), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    count = lambda tok, t: len(tok.encode(t, add_special_tokens=False).ids)
    got = tokencount.token_counts(docs, path, str(tmp_path / "cache")).collect()
    want = sorted((n, i, len(t.encode()), count(library, t)) for n, i, t in texts)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    again = tokencount.token_counts(docs, path, str(tmp_path / "cache")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == len({t for *_, t in texts})
    got = packing.pack(docs, path, capacity=7).collect()
    assert sum(r.length for r in got) == sum(count(library, t) + 1 for *_, t in texts)
    by_bin: dict = {}
    for r in got:
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in sorted(x)[:k]) == sorted(x)[k][0] for x in by_bin.values() for k in range(len(x)))
    want = []
    for _, i, t in texts:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want += ((i, k // 7, k, len(ids[k : k + 7]), crc32(np.array(ids[k : k + 7], "<u4").tobytes())) for k in range(0, len(ids), 7))
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert all(r.length == 7 or r.start + r.length > 7 * r.piece for r in got) and max(r.offset + r.length for r in got) <= 7
    tokenfile.write_shards(docs, P.path("byte_bpe_50k.json"), P.PATTERN, str(tmp_path / "shards"), shard_tokens=50)
    got = sorted(tokenfile.read_documents(spark, str(tmp_path / "shards")).collect(), key=lambda r: r.start)
    least = -(1 << 63)  # an id like any other
    tokenfile.write_shards(spark.createDataFrame([(None, "a"), (least, "b")], "doc_id long, text string"), P.path("byte_bpe_50k.json"), P.PATTERN, str(tmp_path / "least"))
    assert [r.doc_id for r in tokenfile.read_documents(spark, str(tmp_path / "least")).orderBy("start").collect()] == [None, least]
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((not n, i) for n, i, _ in texts)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    sums = lambda t: crc32(np.array([*level.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert sorted(r.ids_crc32 for r in got) == sorted(sums(t) for *_, t in texts)
    found = bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert sorted(r.decoded_sha256 for r in found) == sorted(hashlib.sha256(t.encode()).hexdigest() for *_, t in texts)


def test_operators_on_no_rows(spark, tmp_path):
    docs, path = odd_docs(spark).limit(0), P.path("word_bpe_49k.json")
    assert tokencount.token_counts(docs, path, str(tmp_path / "cache")).count() == 0
    assert packing.pack(docs, path).count() == 0
    assert bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    tokenfile.write_shards(docs, P.path("byte_bpe_50k.json"), P.PATTERN, str(tmp_path / "shards"))
    assert tokenfile.read_documents(spark, str(tmp_path / "shards")).count() == 0


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ab", "=", " ", "é漢z", "tion"])
def test_long_words_are_joined_from_pieces(ranks, letters):
    import random

    rng = random.Random(letters)
    library = tiktoken.Encoding("one word", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    some = ["".join(rng.choice(letters) for _ in range(n)) for n in (63, 64, 65, 66, 127, 129, 500, 4000)]
    assert [numbers(x) for x in bpe.BpeEngine(ranks).encode_words(some)] == [library.encode_ordinary(w) for w in some]


def test_a_word_of_a_hundred_thousand_letters_ends(ranks):
    import random
    import time

    word = "".join(random.Random(0).choices("abcdefghijklmnopqrstuvwxyz", k=100_000))
    start = time.time()
    ids = numbers(bpe.BpeEngine(ranks).encode_words([word])[0])
    spelling = {rank: token for token, rank in ranks.items()}
    assert b"".join(map(spelling.__getitem__, ids)).decode() == word and time.time() - start < 60
    library = tiktoken.Encoding("one word", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    assert all(library.encode_ordinary((spelling[a] + spelling[b]).decode()) == [a, b] for a, b in zip(ids[:2000], ids[1:2000]))


def test_words_are_made_once():
    calls = []

    def tokenize(word):
        calls.append(word)
        return [SimpleNamespace(id=len(word))]

    library = SimpleNamespace(model=SimpleNamespace(tokenize=tokenize), get_added_tokens_decoder=dict)
    encoder = pieces.WordEncoder(library, 450_000)  # room for a thousand words, if they are held once
    text = " ".join("".join(chr(97 + i // 26**k % 26) for k in range(6)) for i in range(1000))
    assert encoder(text) == encoder(text) and len(calls) == 1000


def test_words_at_a_line_s_start_need_no_pattern(level):
    library, searched = level[1], []
    encoder = pieces.PieceIds(lambda t: searched.append(t) or regex.findall(P.PATTERN, t), pieces.ModelIds(library))
    text = "One two, three.\nFour five\nSix. Über\nÜber, done!"
    assert encoder(text) == pieces.library_ids(library, text) and searched == ["\n"]
    assert encoder("Don't\n(a) b-c") == pieces.library_ids(library, "Don't\n(a) b-c") and len(searched) > 1


@pytest.fixture(scope="module")
def column():
    return tokenfile.column_encoder(P.path("byte_bpe_50k.json"), P.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, max_size=6))
def test_columns_of_texts(level, column, some):
    some = some + ODD + ["one two\nthree", "x", "a b\nc d"]
    want = [e.ids for e in level[1].encode_batch(some, add_special_tokens=False)]
    batch = pa.RecordBatch.from_arrays([pa.array(["skipped", *some])], ["text"]).slice(1)
    assert [numbers(x) for x in column(batch.column("text"))] == want
    parts = list(tokenfile.by_bytes(batch, 20))
    assert [numbers(x) for part in parts for x in column(part.column("text"))] == want
    assert all(part.num_rows == 1 or sum(len(x.encode()) for x in part.column("text").to_pylist()) <= 20 for part in parts)
    assert column(pa.array([], pa.string())) == []


def test_a_column_s_pieces_are_looked_up_once(column, monkeypatch):
    looked_up, found = [], pieces.ColumnIds._pieces
    monkeypatch.setattr(pieces.ColumnIds, "_pieces", lambda self, some: looked_up.extend(some) or found(self, some))
    monkeypatch.setattr(pieces.ColumnIds, "LONG", 2_000)
    some = ["one two three\none two"] * 50 + ["one two " * 300 + "one"]
    assert [numbers(x) for x in column(pa.array(some))] == [numbers(column.encode(x)) for x in some]
    assert sorted(looked_up) == ["\0", "\0one", "\n", "three", "two"]


def test_latin_pieces_of_a_column_need_no_pattern(level):
    library, searched = level[1], []
    by_piece = pieces.PieceIds(lambda t: searched.append(t) or regex.findall(P.PATTERN, t), pieces.ModelIds(library))
    some = ["Über... naïve!!\nŒuvre### (", "a-b c_d", "naïve$$$ a.b", "x\u00d7y \u00f7 \u00aa ß] ſ\u0149"]
    column = pieces.ColumnIds(by_piece, by_piece, [])
    want = [pieces.library_ids(library, x) for x in some]
    assert column(pa.array(some)) == want
    assert set(searched) == {"\n", " (", "a-b", " c_d", " a.b", "x\u00d7y", " \u00f7"}
    assert sorted(column.table.words.to_pylist()) == sorted(["\0Über", "naïve", "\0Œuvre", "\0naïve", "ß", "ſ\u0149"])
    column.table.limit = 0  # words go, results stay
    assert [column(pa.array([x])) for x in some] == [[x] for x in want] and len(column.table.words) < 6


def test_words_of_columns_are_contracted_once(ranks, monkeypatch):
    contracted, found = [], bpe.BpeEngine.encode_words
    monkeypatch.setattr(bpe.BpeEngine, "encode_words", lambda self, words: contracted.extend(words) or found(self, words))
    _, encode = bpe.engine_for(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for some in (["one two, three", "naïve two"], ["two. three!!\none naïve", "", " two  one", "\x00 one"], ["two?\nthree; 漢字 12"]):
        assert [numbers(x) for x in encode(some)] == [library.encode_ordinary(t) for t in some]
    assert all(contracted.count(f" {w}") == 1 for w in ("three", "naïve"))
    encode.table.limit = encode.others.cache.limit = 0  # what is held goes, results stay
    for t in ODD:
        assert [numbers(x) for x in encode([t, "one", t])] == [library.encode_ordinary(x) for x in (t, "one", t)]
