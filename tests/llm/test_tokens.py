import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, packing
from tests.llm.data import documents, key, plain

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_fuzzed_texts_encode_as_the_library_does(library):
    rng = random.Random(1)
    own = bpe.model(PATH)
    kinds = ["aA  éÉΣσςİßſḰ\x1c\x1f\x85 ​１²½'s'T'llaaaa!?日本😀\t\n", "".join(map(chr, range(1, 0x2000)))]
    for n in range(1500):
        text = "".join(rng.choice(kinds[n % 2]) for _ in range(rng.randint(0, 40)))
        text += "<|endoftext|>" * (n % 7 == 0) + " x"
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == want, repr(text)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_memory_of_chunks_is_bounded():
    known = bpe.Remembered(bpe.model(PATH), bpe.Bytes(), most=20)
    rng = random.Random(2)
    for _ in range(30):
        words = ["".join(rng.choice("abcde") for _ in range(5)) for _ in range(15)]
        (chunks,) = known.prepare([" ".join(words)])
        assert np.frombuffer(b"".join(known.table[c] for c in chunks), "<u4").tolist() == bpe.model(PATH).encode(" ".join(words)).tolist()
        assert len(known.table) < 60


def test_digests_and_round_trip(spark, library):
    docs = documents(spark)
    got = sorted(map(tuple, bpe.token_digests(docs, PATH).collect()), key=key)
    want = []
    for i, t in plain(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=key)
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r["decoded"] for r in back)) == sorted(library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, t in plain(docs))
    assert bpe.token_digests(docs.limit(0), PATH).count() == 0


def test_first_fit():
    rng = random.Random(3)
    for n in (0, 1, 2, 7, 200):
        lengths = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
        bins, room = [], []
        for x in lengths:
            at = next((k for k, r in enumerate(room) if r >= x), len(room))
            if at == len(room):
                room.append(100)
            room[at] -= x
            bins.append(at)
        assert packing.first_fit(lengths, 100) == bins


@pytest.mark.parametrize("group", [4096, 5])
def test_packing(spark, library, group):
    docs = documents(spark)
    rows = packing.pack(docs, PATH, width=256, group=group).collect()
    # every id of every row lies in one piece: rows with one id are told apart by their pieces
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in plain(docs))
    assert sum(r["length"] for r in rows) == sum(want)
    texts = {i: t for i, t in plain(docs) if i is not None}
    for r in rows:
        if r["doc_id"] is not None:
            ids = np.array([*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2], "<u4")
            assert len(ids) == r["doc_tokens"] and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    by = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        at = by.get(r["sequence_id"], 0)
        assert r["offset"] == at
        by[r["sequence_id"]] = at + r["length"]
    assert max(by.values()) <= 256
    assert packing.pack(docs.limit(0), PATH).count() == 0
