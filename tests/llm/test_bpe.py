import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lumenframe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def codec(ranks):
    return bpe.Codec(ranks, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(11)
    pools = ["ab \n\t", "aeiou th", ["the", "er", "ation", "é", "ñ", "中", "😀", "0", "12", "'s", " "], [chr(c) for c in (*range(32, 127), 0x1C, 0x1F, 0x85, 0xA0, 0x2028, 0x200B, 0x3000)]]
    out = ["", " ", "\n\n\n", "a" * 9000, "-=" * 4000, "don't  stop", "\x00\x01"]
    for k in range(1500):
        out.append("".join(rng.choice(pools[k % 4]) for _ in range(rng.randrange(60))))
    return out


def test_ranks_as_the_library_gives(codec, library):
    for text in texts():
        assert codec.encode(text.encode()) == library.encode_ordinary(text), text[:80]


def test_bounded_lookahead_changes_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "STEP", 3)
    monkeypatch.setattr(bpe, "LONG_TEXT", 500)
    small = bpe.Codec(ranks, public_tokenizers.PATTERN)
    small.transducer.look = 9
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["th", "er", "ing", "x", "中", "aa"]) for _ in range(1500))
        assert small.encode(text.encode()) == library.encode_ordinary(text)


def test_tokens_are_emitted_after_the_longest_token_has_passed(ranks, library):
    transducer = bpe.Transducer(ranks)
    assert transducer.look == max(map(len, ranks))
    rng = random.Random(9)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(20_000))
    read, seen, waiting = 0, 0, []

    def stream():
        nonlocal read
        for byte in text.encode():
            read += 1
            yield byte

    out = []
    for block in transducer.emit(stream()):
        out += block
        seen += sum(transducer.size[r] for r in block)
        waiting.append(read - seen)
    assert seen == len(text) and out == library._core_bpe.encode_single_piece(text.encode())
    assert max(waiting) <= 2 * transducer.look and len(waiting) > 100


def test_decoding_token_by_token(codec):
    text = "é中😀 and plain \u0301"
    ids = codec.encode(text.encode())
    steps = list(codec.decode_tokens(ids))
    assert len(steps) == len(ids) + 1 and "".join(steps) == text
    split = [codec.transducer.ranks[bytes([b])] for b in "中😀".encode()]
    assert list(codec.decode_tokens(split)) == ["", "", "中", "", "", "", "😀", ""]
    assert "".join(codec.decode_tokens(split[:2])).encode("utf-8", "surrogateescape") == "中".encode()[:2]


def test_round_trip_of_any_bytes(codec):
    rng = random.Random(6)
    for _ in range(300):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(80)))
        n, ids, back = codec.digests(data)
        assert back == hashlib.sha256(data).hexdigest()
        assert ids == hashlib.sha256(",".join(map(str, codec.encode(data))).encode()).hexdigest()
        assert n == len(codec.encode(data))


def test_decoding_holds_back_part_characters(codec):
    ids = [str(i) for i in codec.encode("中😀é".encode())]
    assert "".join(codec.decode(ids)) == "中😀é"


def test_query_on_documents_with_odd_rows(spark, library):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()] + [(None, "no id"), (7, None), (7, ""), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in bpe.round_trip(df, PATH, public_tokenizers.PATTERN).collect()), key=repr)
    want = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_columns_ride_along(spark):
    df = spark.createDataFrame([("x", "some text", [1])], "ids string, text string, token_ids array<int>")
    out = bpe.encode_documents(df, PATH, public_tokenizers.PATTERN)
    assert out.columns == ["ids", "text", "token_ids"]
    back = bpe.decode_documents(out.withColumn("text", out["ids"]), PATH, public_tokenizers.PATTERN)
    assert back.first()["text"] == "some text"
    assert bpe.encode_documents(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
