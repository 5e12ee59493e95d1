import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mediatally.llm import bpe

from .conftest import odd_rows, table_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_against_the_library(spark, docs_of, library):
    rng = random.Random(2)
    texts = [r.text for r in table_rows(spark, "documents")]
    texts += ["ΣΑΣ ΟΔΟΣ", "İstanbul", "x<|endoftext|>y  <|startoftext|>", "<|ENDOFTEXT|>", "it's they'll I'VE", "\x1c\x1da\x1fb", "é ́a", "a" * 5000,
              "ab" * 3000, "1234 5६७", "日本語テキスト", "👍🏽👨‍👩‍👧", "　x\xa0y\x85z", "</w> <w>", "\x00\x01", "ﬁ ﬀ ſ K Å", "don’t"]
    texts += ["".join(rng.choice("abcde '\n.é1") for _ in range(300)) for _ in range(100)]
    found = bpe.token_digests(docs_of(list(enumerate(texts))), PATH).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == {i: wanted(library, t) for i, t in enumerate(texts)}


def test_fragments_encoded_alone_give_the_whole(library):
    vocabulary = bpe.Vocabulary(PATH)
    cut = 0
    for word in ("naïve", "日本", "größe", "x" * 100, "éà", "привет"):
        letters = word.encode().decode("latin-1").translate(vocabulary.letters)
        parts = vocabulary.fragments(letters)
        cut += len(parts) > 1
        assert "".join(parts) == letters
        assert all(a[-1] + b[0] not in vocabulary.inside for a, b in zip(parts, parts[1:]))
    assert cut


def test_long_and_short_merges_agree():
    vocabulary = bpe.Vocabulary(PATH)
    rng = random.Random(4)
    for _ in range(300):
        letters = [rng.choice("theranoi") for _ in range(rng.randrange(2, bpe.SHORT))]
        assert vocabulary.merged(list(letters)) == vocabulary._merged_long(list(letters))


def test_kept_pieces_are_bounded():
    kept = bpe.Kept(lambda k: k.encode(), most=2_200)
    assert all(kept[str(i % 37)] == str(i % 37).encode() for i in range(1000))
    assert 5 <= len(kept.older) <= 12 and len(kept) <= 12 and kept.held <= kept.most


def test_long_pieces_are_not_kept(library):
    """10,000 long pieces, with blanks between them or not, leave the table as small as it was."""
    vocabulary = bpe.Vocabulary(PATH)
    rng = random.Random(9)
    long = ["".join(rng.choice("abcdefgh") for _ in range(200)) for _ in range(10_000)]
    for text in (" ".join(long[:5_000]), "".join(f"{w}!" for w in long[5_000:])):
        vocabulary.encode(text)
        assert vocabulary.pieces.held < 10_000
    assert list(np.frombuffer(vocabulary.encode(long[0]), np.int32)) == library.encode(long[0], add_special_tokens=False).ids


def test_odd_rows_and_decoding(spark, odd_docs, no_docs, library):
    found = sorted(((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(odd_docs, PATH).collect()))
    assert found == sorted(wanted(library, r[1]) for r in odd_rows())
    assert bpe.token_digests(no_docs, PATH).count() == 0
    decoded = bpe.decode_ids(bpe.encode_texts(odd_docs, PATH), PATH).where("doc_id = 1").first().decoded
    assert decoded == library.decode(library.encode(odd_rows()[0][1], add_special_tokens=False).ids, skip_special_tokens=False)
