"""Token ids, entropy-coded files and packing against whole-text encoding and brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from penmark.llm import packing, rans, tokenfile
from penmark.llm.queries import QUERIES
from penmark.llm.tokenise import Stretches, with_end
from penmark.session import new_path

paths = pytest.importorskip("public_tokenizers")
FILES = {"word_bpe_49k.json": True, "byte_bpe_50k.json": False}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name, drop", FILES.items())
def test_stretches_give_the_ids_of_whole_texts(name, drop):
    rnd = random.Random(7)
    letters = "aé. \n\tÉA0×'s1,&̸́İß 　  <|endoftext|>ı한ᄀ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(4000)]
    texts += [None, "", " ", "don't we'll x's 'tis", "a  b\n\nc", "word " * 500]
    encoder = Stretches(paths.path(name), drop, remembered=500)  # forgets on the way
    for at in range(0, len(texts), 700):
        some = texts[at : at + 700]
        ids, bounds = encoder.encode(pa.array(some, pa.string()))
        for text, a, b in zip(some, bounds, bounds[1:]):
            want = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
            assert ids[a:b].tolist() == want, repr(text)


def test_end_ids():
    ids, bounds = with_end(np.array([5, 6, 7], np.uint32), np.array([0, 2, 2, 3]), 2)
    assert ids.tolist() == [5, 6, 2, 2, 7, 2] and bounds.tolist() == [0, 3, 4, 6]


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 1000, 40_000])
def test_coder_round_trip_and_parallel_segments(size):
    rng = np.random.default_rng(size)
    ids = np.minimum(rng.geometric(0.02, size), 999).astype(np.uint32)
    table = rans.Table(rans.Table.scaled(np.bincount(ids, minlength=1000), 16), 16)
    block = rans.encode(ids, table, lanes=8, every=16)
    assert rans.decode(block, table).tolist() == ids.tolist()
    segments = -(-size // 128)
    for s in range(segments):
        part = rans.decode(block, table, range(s, s + 1))
        assert part.tolist() == ids[s * 128 : (s + 1) * 128].tolist()
    if size == 40_000:
        shares = np.bincount(ids) / size
        entropy = -sum(p * np.log2(p) for p in shares if p > 0)
        assert len(rans.encode(ids, table, lanes=16, every=4096)) * 8 < 1.03 * size * entropy
        broken = bytearray(block)
        broken[-1] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            rans.decode(bytes(broken), table)


def test_scaled_frequencies_keep_every_id():
    counts = np.concatenate([[10**12], np.ones(60_000, np.int64)])
    scaled = rans.Table.scaled(counts)
    assert scaled.sum() == 1 << rans.BITS and scaled.min() == 1
    one = rans.Table(rans.Table.scaled(np.array([0, 9])))
    ids = np.ones(5000, np.uint32)
    assert rans.decode(rans.encode(ids, one), one).tolist() == ids.tolist()


def test_file_query_against_plain_encoding(spark, sf):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(paths.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    rows = QUERIES["op3_rans_token_file"](spark, sf).orderBy("doc_id").collect()
    start = 0
    for doc, row in zip(docs, rows, strict=True):
        ids = encoder.encode(doc["text"] or "", add_special_tokens=False).ids + [2]
        assert tuple(row) == (doc["doc_id"], start, len(ids), crc(ids))
        start += len(ids)


def test_file_of_small_blocks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    path = new_path(spark, "small-blocks")
    tokenfile.write_token_file(docs, path, paths.path("word_bpe_49k.json"), block_tokens=3000)
    assert spark.read.parquet(f"{path}/blocks").count() > 20
    got = tokenfile.read_token_file(spark, path).orderBy("doc_id").collect()
    start = 0
    for row in got:
        assert row["start"] == start and len(row["ids"]) == 4 * row["n_tokens"]
        start += row["n_tokens"]


def test_open_bins_take_the_tightest_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.place(6) == (0, 0)
    assert bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # exactly fills the tighter bin
    assert bins.place(8) == (2, 0)
    assert bins.place(9) == (3, 0)  # no room: bin 2, the fullest, closes
    assert bins.place(2) == (0, 6)
    assert bins.place(2) == (0, 8)


def test_cut_makes_only_the_first_piece_short():
    bounds = np.cumsum([0, 1, 1024, 1025, 2500])
    pieces = list(zip(*(x.tolist() for x in packing.cut(bounds, 1024))))
    assert pieces == [
        (0, 0, 0, 1),
        (1, 0, 0, 1024),
        (2, 0, 0, 1),
        (2, 1, 1, 1024),
        (3, 0, 0, 452),
        (3, 1, 452, 1024),
        (3, 2, 1476, 1024),
    ]


def test_packing_query(spark):
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.01"
    encoder = Tokenizer.from_file(paths.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op9_best_fit_packing"](spark, folder).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    total = 0
    for doc in docs:
        ids = encoder.encode(doc["text"] or "", add_special_tokens=False).ids + [2]
        at = 0
        for n, r in enumerate(sorted(pieces[doc["doc_id"]], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at)
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
        total += at
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(sequences) <= 1.01 * -(-total // 1024) + 1
