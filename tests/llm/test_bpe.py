import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedge.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"
PATH = bpe.tokenizer_path()
LIB = tokenizers.Tokenizer.from_file(PATH)
TOK = bpe.Tokenizer.load(PATH)
PLAIN = bpe.Encoder(TOK)
WITH = bpe.Encoder(TOK, bpe.Lexicon.mapped(bpe.compile_lexicon(TOK, ["the", "there", "here", "banana", "naïve", "!!", "'s"])))


def same(text):
    want = LIB.encode(text, add_special_tokens=False).ids
    for e in (PLAIN, WITH):
        assert e.encode(text) == want, text
        assert e.decode(want) == LIB.decode(want, skip_special_tokens=False)
        assert next(e.encode_batch([text]))[2] == LIB.decode(want, skip_special_tokens=False)


CASES = ["", " ", "The there's HERE banana ' 's don't we'll", "ΣΑΣ ΌΔΟΣ İstanbul ǅ ß ẞ", "é é Å ﬁ 한국어 각", "a1b22 ½ ² Ⅷ ٣", "<|endoftext|> a <|startoftext|><|endoftext|>b", "\x00 \x1c \x85 \xa0   ​ x", "\0<|endoftext|>", "😀👩‍👩‍👧 !!??", "x" * 3000, "aAbB" * 300, "_under_score_ a-b", "banana" * 20, "हिन्दी नमस्ते"]


@pytest.mark.parametrize("text", CASES)
def test_equals_the_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cn"]), max_size=40))
def test_any_text_equals_the_library(text):
    same(text)


def test_long_and_side_by_side_merges_agree():
    rng = random.Random(3)
    words = ["".join(rng.choice("abehinorst") for _ in range(rng.randint(1, 40))).encode() for _ in range(500)]
    assert TOK.merge(words) == [TOK.merge_long(w) for w in words]


def test_automaton_is_minimal_and_exact():
    words = {w.encode(): [i] for i, w in enumerate(sorted(a + b for a in ("re", "un", "") for b in ("do", "doing", "load", "loading")))}
    lexicon = bpe.Lexicon(bpe.Lexicon.build(words))
    order = sorted(words)
    assert lexicon.find(order).tolist() == list(range(len(order)))
    assert lexicon.find([b"", b"r", b"loadi", b"doings", b"x" * 100]).tolist() == [-1] * 5
    # The states after "", "re" and "un" share all that follows do/load.
    assert len(set(lexicon.target.tolist())) < 20
    assert bpe.Lexicon(bpe.Lexicon.build({})).find([b"a"]).tolist() == [-1]


def test_query_equals_the_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = bpe.op6(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIB.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "", 5)], "doc_id long, text string, n_tokens int")
    out = bpe.encoded(df, ["doc_id"]).collect()
    assert [r.n_tokens for r in out] == [0, 0, 0] and len({r.ids_sha256 for r in out}) == 1
    assert bpe.encoded(df.where("false"), ["doc_id"]).count() == 0


def test_split_written_out_for_the_basic_plane_equals_the_library_engine():
    import regex

    from sedge.llm.bpe import Encoder, Tokenizer, basic_split, tokenizer_path

    tokenizer = Tokenizer.load(tokenizer_path())
    assert basic_split(tokenizer.pattern) is not None and basic_split(r"\p{L}+|[\s]") is None
    encoder, want = Encoder(tokenizer), regex.compile(tokenizer.pattern, flags=regex.V0).findall
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for text in (*(f"{c}a{c}1{c} '{c}s{c}" for c in every), "don't 'sd ''ll", "\U0001d400b \U0001f642x 𝟘1"):
        text = text.lower()
        assert (encoder.split_any if max(text) > "￿" else encoder.split)(text) == want(text)
    assert encoder.encode("a 🙂b'll") == [x for w in want("a 🙂b'll") for x in encoder.ids_of([w])[0]]
