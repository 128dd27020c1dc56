import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkwell.llm import bpe


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(bpe.default_path())


def texts(n=4000):
    rng = random.Random(1)
    pools = ["abcdefghij '", "the and ing", "aaab", "İΣσς éè́éñ ½²Ⅷ١ 中文あ", "\x1c\x1d\x85\xa0​ 　 x\n\t", "!?.,'s't1234", "".join(map(chr, range(0x20, 0x17F)))]
    out = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(50))) for _ in range(n)]
    out += ["<|endoftext|>", "a<|startoftext|>B <|endoftext|>", "<|endoftext", "", " ", "word " * 3000, "Thhaeouble thonreerion eauxentre ofanwhorha"]
    return out


def test_encode_and_decode_as_the_library(own, plain):
    xs = texts()
    for x, ids in zip(xs, own.encode(xs), strict=True):
        want = plain.encode(x, add_special_tokens=False).ids
        assert ids.tolist() == want, x
        assert own.decode(ids.tolist()) == plain.decode(want, skip_special_tokens=False)


def test_pair_check_agrees_with_merging(own):
    import numpy as np

    rng = random.Random(6)
    inner = [i for s, i in own.vocab.items() if not s.endswith(own.end)]
    ending = [i for s, i in own.vocab.items() if s.endswith(own.end) and s != own.end]
    pairs = [(rng.choice(inner), rng.choice(ending)) for _ in range(3000)]
    fits = own.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    for (a, b), ok in zip(pairs, fits, strict=True):
        word = own.text[a] + own.text[b].removesuffix(own.end)
        assert ok == (own.merged(word) == [a, b])
    assert own.stable.all()


def test_failures_only_are_merged(own, monkeypatch):
    calls = []
    real = bpe.Bpe.merged
    monkeypatch.setattr(bpe.Bpe, "merged", lambda self, w: calls.append(w) or real(self, w))
    own._reset()
    own.encode(["the cat and the dog sat on the mat"])
    assert not calls


def test_cache_bound_keeps_results(own, plain, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 50)
    xs = texts(900)
    assert [x.tolist() for x in own.encode(xs)] == [plain.encode(x, add_special_tokens=False).ids for x in xs]


def test_columns_and_digests(spark, docs, plain):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (None, ""), (3, "x " * 10_000)]
    df = docs(rows)
    out = bpe.decode(bpe.encode(df)).collect()
    for r in out:
        want = plain.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["token_ids"]) == want and r["decoded"] == plain.decode(want, skip_special_tokens=False)
    for r in bpe.digests(df).collect():
        text = dict(rows)[r["doc_id"]] or ""
        want = plain.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(want),
            hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(),
            hashlib.sha256(plain.decode(want, skip_special_tokens=False).encode()).hexdigest(),
        )
    assert bpe.digests(docs([])).count() == 0 and bpe.encode(docs([])).count() == 0
    with pytest.raises(ValueError, match="exist already"):
        bpe.encode(df.withColumnRenamed("lang", "Token_Ids"))


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_leave_the_worker_in_slices(spark, own, plain):
    """A batch of 6,000 texts is never there as ids at once; columns, order and nulls stay."""
    import pyarrow as pa

    rng = random.Random(2)
    some = [" ".join(rng.choices(["the", "cats", "running", "So", "42"], k=40)) for _ in range(50)]
    rows = [(i, None if i == 7 else some[i % 50], i % 3) for i in range(6000)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in some]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["doc_id", "Text", "extra"])
    parts = list(bpe.id_batches([batch], own, 1, [0, 2], ["doc_id", "extra", "token_ids"]))
    assert max(p.num_rows for p in parts) == bpe.SLICE
    made = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert made == [(i, extra, want[i % 50] if text else []) for i, text, extra in rows]
    out = bpe.encode(spark.createDataFrame(rows, "doc_id long, Text string, extra int"), keep=False)
    assert out.columns == ["doc_id", "extra", "token_ids"]
    assert sorted((r["doc_id"], r["extra"], list(r["token_ids"])) for r in out.collect()) == made
