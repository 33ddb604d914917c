"""The automaton and the token files against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from riskgrid.llm import bpe, tokenfiles
from riskgrid.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_automaton_as_library(library):
    own, pick = bpe.tokenizer(tokenizer_path()), random.Random(3)
    letters = [chr(c) for c in range(32, 127)] + list("éßÅçñΣσςİıſK一丁\U0001f600́̂ͅ\x1c\x85  ​\x00\x0b٣²½Ⅷ")
    words = [w.removesuffix("</w>") for w in list(own.automaton.vocab)[300:]]
    for k in range(6000):
        kind = k % 3
        if kind == 0:
            text = "".join(pick.choice(letters) for _ in range(pick.randint(1, 30)))
        elif kind == 1:
            text = "".join(pick.choice("aeinthgrso") for _ in range(pick.randint(1, 25)))
        else:
            text = "".join(pick.choice(words) for _ in range(pick.randint(1, 4)))
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text
    for text in ("a" * 5000, "ab" * 3000, "!" * 4000, "<|endoftext|>x <|startoftext|><|end", ""):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_small_merge_list_by_hand():
    vocab = {t: k for k, t in enumerate(["a", "b", "a</w>", "b</w>", "aa", "ab</w>", "aab</w>", "aa</w>"])}
    merges = [("a", "a"), ("a", "b</w>"), ("aa", "b</w>"), ("a", "a</w>")]
    own = bpe.Automaton(vocab, merges, "</w>")
    names = {k: t for t, k in vocab.items()}
    by_hand = {"ab": ["ab</w>"], "aab": ["aab</w>"], "aaab": ["aa", "ab</w>"], "aa": ["aa</w>"], "aaa": ["aa", "a</w>"], "ba": ["b", "a</w>"]}
    for word, want in by_hand.items():
        assert [names[t] for t in own.encode(word)] == want


def test_round(awkward, nothing, documents, library):
    for docs in (awkward, documents):
        want = sorted((str(r["doc_id"]), *expected(library, r["text"])) for r in docs.collect())
        got = bpe.encode_decode(docs, tokenizer_path()).collect()
        assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in got) == want
        assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert bpe.encode_decode(nothing, tokenizer_path()).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_pack_round_trip(n):
    rng = np.random.default_rng(n)
    values = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
    control, data = tokenfiles.pack(values)
    assert len(control) == -(-n // 4)
    assert tokenfiles.unpack(control, data, n).tolist() == values.tolist()
    assert len(data) == sum(max(1, (int(v).bit_length() + 7) // 8) for v in values)


def check_store(spark, docs, library, path, **sizes):
    rows = docs.select("doc_id", "text").collect()
    tokenfiles.write_store(docs, path, tokenizer_path(), end_id=1, **sizes)
    got = sorted(tokenfiles.read_store(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in rows), key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    want = sorted((str(r["doc_id"]), zlib.crc32(np.array([*expected(library, r["text"])[0], 1], "<u4").tobytes())) for r in rows)
    assert sorted((str(r["doc_id"]), zlib.crc32(bytes(r["ids"]))) for r in got) == want


def test_store(spark, awkward, documents, library, tmp_path):
    check_store(spark, awkward, library, str(tmp_path / "a"), block_ids=500, part_ids=3000)
    check_store(spark, documents, library, str(tmp_path / "b"), part_ids=20_000)


def test_store_ranks_by_frequency(spark, documents, tmp_path):
    path = str(tmp_path / "s")
    tokenfiles.write_store(documents, path, tokenizer_path(), end_id=1)
    counts = [r["n"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    assert counts == sorted(counts, reverse=True)


def test_empty_store(spark, nothing, tmp_path):
    path = str(tmp_path / "e")
    tokenfiles.write_store(nothing, path, tokenizer_path())
    assert tokenfiles.read_store(spark, path).count() == 0
