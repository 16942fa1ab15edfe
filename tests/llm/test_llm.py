import hashlib

import pytest

from rippleframe.llm.bpe import Encoder, Vocabulary
from rippleframe.llm.exact_dedup import CuckooIndex
from rippleframe.llm.simhash import fingerprint
from rippleframe.llm.warc import derive, parse, response


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load()


@pytest.mark.parametrize("text", ["", "hello world", "réeux  \n\n naïve 1234 <|endoftext|>", "a" * 3000])
def test_bpe_matches_tiktoken(vocabulary, text):
    import tiktoken

    reference = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    encoder = Encoder(vocabulary)
    ids = encoder.encode([text])[0]
    assert ids.tolist() == reference.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


def test_cuckoo_grows_and_deletes():
    index = CuckooIndex(8)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for k in keys:
        index.insert(k, 1, 1)
    assert index.resizes and all(index.get(k, 1) == 1 for k in keys)
    assert index.delete(keys[0], 1) and index.get(keys[0], 1) is None and index.get(keys[1], 1) == 1


def test_fingerprint_of_nothing():
    assert fingerprint(None) == fingerprint(" \n") == 0


def test_warc_derivatives_refer_to_their_source():
    source = response("http://x/", "<title>T</title><p>a &amp; b<p>c")
    of = parse(source)[0][0]["WARC-Record-ID"]
    metadata, conversion = derive(source)
    assert metadata[2] == conversion[2] == of
    assert parse(conversion[3])[0][1] == b"a & b\nc"
