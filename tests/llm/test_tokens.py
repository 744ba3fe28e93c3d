"""SentencePiece codec, token counts, rANS and the token store, against the libraries."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfkin.llm import piece_model, rans, sentencepiece_codec, token_counts, token_store
from shelfkin.llm.word_cache import WordCache

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCRAPS = (
    "a|the |The| |  |=|==|...|\n|\t|é|é|漢|😀|▁|<s>|<0x0A>|<unk>|0|12|ing|aa|-|'s|'S|<\x7cendoftext\x7c>|"
    "<\x7cENDOFTEXT\x7c>|İ|Σ|ΑΣ |\xa0| |\x1c|\x85|ﬁ|word.|word,|.,|--|ß|中.|ñ,|end***|%%%|a-b|x,.!|it's.|ǅ"
).split("|")


def scraps(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(SCRAPS, k=rng.randint(0, 30))) for _ in range(n)] + ["", " ", "x" * 3000, "ab " * 2000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_codec_has_the_ids_of_sentencepiece(library):
    box, texts = sentencepiece_codec.Codec(MODEL), scraps(1500)
    ids, agree = box.encode(texts)
    assert [i.tolist() for i in ids] == library.encode(texts)
    assert [e.ids for e in box.whole.encode_batch(texts, add_special_tokens=False)] == library.encode(texts)
    assert all(agree)


def test_codec_decodes_as_both_libraries(library):
    box = sentencepiece_codec.Codec(MODEL)
    for ids in box.encode(scraps(300, 2))[0]:
        assert box.decode(ids) == library.decode(ids.tolist()) == box.whole.decode(ids.tolist())


def test_a_small_cache_changes_nothing():
    words = [random.Random(i).choice("abcdefghij") * (i % 4) for i in range(500)]
    cache = WordCache(lambda new: [[len(w), i] for i, w in enumerate(new)][: len(new)], limit=3)
    ids, sizes = cache(words)
    assert sizes.tolist() == [2] * 500 and ids[::2].tolist() == [len(w) for w in words]


def small_model(kind, pieces, byte_fallback=False, remove_extra=True):
    """The bytes of a model file written by hand."""

    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3]) + bytes([value]) if number < 16 else varint(number << 3) + bytes([value])
        if isinstance(value, float):
            return bytes([number << 3 | 5]) + struct.pack("<f", value)
        return varint(number << 3 | 2) + varint(len(value)) + value

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    body = b"".join(field(1, field(1, t.encode()) + field(2, s) + field(3, k)) for t, s, k in pieces)
    body += field(2, field(3, kind) + field(35, int(byte_fallback)))
    return body + field(3, field(1, b"identity") + field(4, int(remove_extra)))


UNIGRAM = [
    ("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -2.5, 1), ("a", -1.25, 1), ("b", -1.25, 1),
    ("ab", -2.5, 1), ("ba", -2.5, 1), ("▁a", -3.0, 1), ("aba", -3.75, 1), ("c", -4.0, 1),
]


def test_unigram_model_file_written_by_hand(tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(small_model(1, UNIGRAM))
    box = sentencepiece_codec.Codec(str(path))
    assert box.model.kind == piece_model.UNIGRAM and not box.cut
    texts = ["ab", "  ab  a ", "abab", "x", "axxb", "", "c a  b"]
    ids, _ = box.encode(texts)
    assert [i.tolist() for i in ids] == box.check.encode(texts)
    assert [e.ids for e in box.whole.encode_batch(texts)] == box.check.encode(texts)


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_counts_follow_the_library_ties_included(byte_fallback, tmp_path):
    """All scores equal or in simple proportion, so that ties are everywhere; and unknown runs."""
    pieces = list(UNIGRAM)
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    path = tmp_path / "tie.model"
    path.write_bytes(small_model(1, pieces, byte_fallback))
    model = piece_model.load(str(path))
    library = Tokenizer(piece_model.unigram(model))
    library.normalizer = piece_model.normalizer(model)
    count, rng = token_counts.Counter(model), random.Random(4)
    for _ in range(1500):
        text = "".join(rng.choices(["a", "b", "ab", " ", "é", "x", "<unk>", "c"], k=rng.randint(0, 12)))
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_counts_with_the_public_vocabulary():
    model = piece_model.load(MODEL)
    library = Tokenizer(piece_model.unigram(model))
    library.normalizer = piece_model.normalizer(model)
    count, small, texts = token_counts.Counter(model), token_counts.Counter(model, limit=2), scraps(800, 3)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert list(map(count, texts)) == want == list(map(small, texts))
    small.cut = False
    assert list(map(small, texts[:100])) == want[:100]


def test_counts_of_rows(docs_of, clashing):
    rows = [(1, "the cat"), (2, ""), (3, None), (None, "the cat"), (1, "the cat")]
    got = {(r.doc_id, r.n_tokens) for r in token_counts.token_counts(clashing(docs_of(*rows))).collect()}
    n = token_counts.Counter(piece_model.load(MODEL))("the cat")
    assert got == {(1, n), (2, 0), (3, 0), (None, n)}
    assert token_counts.token_counts(docs_of()).count() == 0


def test_digest_of_rows(docs_of, clashing, library):
    rows = [(1, "the  cat\n"), (2, ""), (3, None), (None, "▁x"), (1, "the  cat\n")]
    got = sentencepiece_codec.digest(clashing(docs_of(*rows))).collect()
    assert len(got) == 5 and all(r.agree for r in got)
    ids = np.array(library.encode("the  cat\n"), "<u4")
    assert {(r.n_tokens, r.ids_crc32, r.restored) for r in got if r.doc_id == 1} == {
        (len(ids), zlib.crc32(ids.tobytes()), True)
    }
    assert {r.n_tokens for r in got if r.doc_id in (2, 3)} == {0}
    assert [r.restored for r in got if r.doc_id is None] == [False]  # the mark itself reads as a blank
    decoded = sentencepiece_codec.decode(sentencepiece_codec.encode(docs_of(*rows))).collect()
    assert {r.decoded for r in decoded if r.doc_id == 1} == {"the  cat\n"}
    assert sentencepiece_codec.digest(docs_of()).count() == 0


def test_rans_round_trips_and_finds_damage():
    rng = np.random.default_rng(1)
    values = np.minimum(rng.geometric(0.02, 700_000), 40_000).astype(np.int64)
    table = rans.fit(*np.unique(values, return_counts=True))
    assert int(table.freqs.sum()) == 1 << rans.SCALE_BITS and table.freqs.min() >= 1
    block, decode = rans.encode(values, table), rans.Decoder(table)
    assert (decode(block) == values).all() and len(block.offsets) == 2
    second = rans.CHECKPOINT * rans.LANES
    assert (decode.segment(block, 1) == values[second:]).all()
    entropy = -sum(p * np.log2(p) for p in np.unique(values, return_counts=True)[1] / len(values))
    assert len(block.payload) * 8 < len(values) * entropy * 1.01
    broken = block._replace(payload=block.payload[:-1] + bytes([block.payload[-1] ^ 1]))
    with pytest.raises(ValueError, match="damaged"):
        decode(broken)
    for n in (0, 1, 1023, 1024, 1025):
        assert (decode(rans.encode(values[:n], table)) == values[:n]).all()
    with pytest.raises(ValueError):
        rans.encode(np.array([10**6]), table)
    one = rans.fit([7], [100])
    assert (rans.Decoder(one)(rans.encode(np.full(5000, 7), one)) == 7).all()


def split(box, texts, tail=b""):
    ids, sizes = box.encode(pa.array(texts, pa.string()), tail)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_words_have_the_ids_of_the_whole_text(monkeypatch):
    library, texts = Tokenizer.from_file(WORD_BPE), scraps(4000, 5)
    box = token_store.Words(WORD_BPE)
    assert box.parts and box.letters
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert split(box, texts) == want
    plain = [i for i, t in enumerate(texts) if "<|" not in t]
    assert len(plain) > 400 and split(box, [texts[i] for i in plain]) == [want[i] for i in plain]
    end = np.array([2, 7], box.kind).tobytes()
    assert split(box, [texts[i] for i in plain], end) == [want[i] + [2, 7] for i in plain]
    monkeypatch.setattr(token_store, "HELD", 5)
    assert [x for i in plain[:300] for x in split(box, [texts[i]])] == [want[i] for i in plain[:300]]


def test_another_tokenizer_is_used_as_it_is():
    box = token_store.Words(public_tokenizers.path("byte_bpe_50k.json"))
    assert not box.parts
    assert split(box, ["a  b\n"]) == [Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("a  b\n").ids]


def test_token_store(spark, docs_of, clashing, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["one", "Two", "three,", "été"], k=rng.randint(0, 40)))) for i in range(60)]
    rows += [(7, "a repeated id"), (7, "a repeated id"), (None, "no id"), (61, None), (62, "x " * 300)]
    path = str(tmp_path / "store")
    token_store.write(clashing(docs_of(*rows)), path, block=50)
    assert spark.read.parquet(f"{path}/blocks").count() > 10
    library = Tokenizer.from_file(WORD_BPE)
    back = sorted(token_store.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in back] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    at = 0
    for r in back:
        assert r.start == at and r.ids[-1] == 2
        at += len(r.ids)
    want = sorted(library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows)
    assert sorted(r.ids for r in back) == want
    sums = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_store.digest(spark, path).collect()}
    assert sums == {
        (r.doc_id, r.start): (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in back
    }
    empty = str(tmp_path / "empty")
    token_store.write(docs_of(), empty)
    assert token_store.digest(spark, empty).count() == 0
