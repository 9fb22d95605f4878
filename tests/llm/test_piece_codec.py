import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from cadenza.llm import piece_codec
from cadenza.llm.piece_codec import BLANK, PieceCodec

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(library, n):
    rng = random.Random(11)
    pieces = [library.id_to_piece(i).replace(BLANK, " ") for i in range(259, library.vocab_size())]
    out = ["", " ", "  a b ", "\ta\n\nb", f"{BLANK}x", "<s> <0x0A> <unk>", "😀👍🏽", "a\r\nb", "﻿x​", "é é", "\x00x", "ab   ", " " * 100, "=" * 300]
    for _ in range(n):
        k = rng.random()
        if k < 0.4:
            out.append("".join(rng.choice("ab étha \n\t  e1.") for _ in range(rng.randrange(40))))
        elif k < 0.7:
            out.append("".join(rng.choice(pieces) for _ in range(rng.randrange(12))))
        elif k < 0.85:
            out.append("".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(10))))
        else:
            out.append(" " * rng.randrange(60) + rng.choice(pieces) + rng.choice("abeox=-_*.0") * rng.randrange(60))
    return out


def test_ids_and_texts_are_the_librarys(library):
    own = PieceCodec.load(PATH)
    for text in texts(library, 4000):
        ids = library.encode(text)
        assert own.encode(text).tolist() == ids, text
        assert own.decode(ids) == library.decode(ids)


def test_any_ids_decode_as_in_the_library(library):
    own, rng = PieceCodec.load(PATH), random.Random(5)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 28705, 0, 1]) for _ in range(rng.randrange(9))]
        assert own.decode(ids) == library.decode(ids), ids


def plain_merges(text, rank):
    """Best-scored, then leftmost pair first, until none is left."""
    parts = list(text)
    while True:
        found = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
        if not found:
            return parts
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_small_models_match_plain_merging():
    rng = random.Random(2)
    for _ in range(60):
        merged, pieces = ["a", "b", "c", BLANK], ["a", "b", BLANK]  # c has no piece of its own
        for _ in range(rng.randrange(1, 14)):
            new = rng.choice(merged) + rng.choice(merged)
            if len(new) < 9 and new not in merged:
                merged.append(new)
                pieces.append(new)
        own = PieceCodec([(p, i + 256, -float(i)) for i, p in enumerate(pieces)], list(range(256)))
        rank = {p: float(i) for i, p in enumerate(pieces)}
        for _ in range(60):
            text = "".join(rng.choice("aabbc" + BLANK) for _ in range(rng.randrange(1, 16)))
            assert own.tokens(text) == plain_merges(text, rank), (pieces, text)


def test_caches_may_be_cleared(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "PARTS", 3)
    monkeypatch.setattr(piece_codec, "PAIRS", 3)
    own = PieceCodec.load(PATH)
    for text in texts(library, 50):
        assert own.encode(text).tolist() == library.encode(text)


def test_frames_keep_nulls_repeats_and_columns(spark, library):
    long = "Ein sehr langer Text. " * 20_000
    data = [(1, None, "x"), (2, "", "y"), (3, "héllo  wörld\n", None), (3, "héllo  wörld\n", None), (None, "a", "z"), (4, long, "z"), (5, "a" * 100_000, "z")]
    df = spark.createDataFrame(data, "c0 long, text string, made string")
    out = piece_codec.decode(piece_codec.encode(df, PATH), PATH)
    assert out.columns == ["c0", "text", "made", "ids", "decoded"]
    found = out.collect()
    assert sorted((str(r.c0), r.text or "", r.made or "") for r in found) == sorted((str(a), b or "", c or "") for a, b, c in data)
    for r in found:
        assert r.ids == library.encode(r.text or "")
        assert r.decoded == (r.text or "")
    assert piece_codec.decode(piece_codec.encode(df.limit(0), PATH), PATH).count() == 0
    odd = spark.createDataFrame([(None,), ([264, None, 287],)], "ids array<int>")
    assert sorted(r.decoded for r in piece_codec.decode(odd, PATH).collect()) == ["", "a b"]


def test_query_matches_the_library(spark, library, tmp_path):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([None, *texts(library, 60)])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    got = piece_codec.op12_sentencepiece(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()} == want
