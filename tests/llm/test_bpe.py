import hashlib
import json
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evitrace.llm.bpe import Automaton, encode
from evitrace.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def machine():
    with open(PATH, encoding="utf-8") as file:
        return Automaton(json.load(file))


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


def odd_texts():
    rng = random.Random(4)
    ranges = ((32, 127), (0x80, 0x250), (0x370, 0x530), (0x1E00, 0x2100), (0x3040, 0x3100), (0x1F300, 0x1F700))
    yield from (
        "", " ", "Hello   World's 'RE we'LL 123 ½ ²x", "a<|endoftext|>b <|startoftext|><|endoftext|", "ΟΔΟΣ İ ǅ ﬁ ẞ",
        "a" * 5000, "é ẛ̣ ÅΩ", "日本語 テスト 한국어 👩‍👩‍👧", "x\x00y\x85z", "''''''---===", "don't I'M 've")
    for _ in range(200):
        text = "".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(60))
        yield "".join(c for c in text if unicodedata.category(c) != "Cn")
        yield "".join(rng.choice("abcdeinort") for _ in range(rng.randrange(1, 200)))


def test_ids_and_labels_are_the_library_s(machine, library):
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert machine.encode(text) == ids, text
        assert machine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_gadgets_of_a_repeated_symbol():
    """aa is merged from the left: a run of three is aa a, never a aa."""
    spec = {"model": {"end_of_word_suffix": "</w>", "vocab": {"a": 0, "a</w>": 1, "aa": 2, "aa</w>": 3},
                      "merges": [["a", "a"], ["a", "a</w>"]]},
            "added_tokens": [], "pre_tokenizer": {"pretokenizers": [{"pattern": {"Regex": "[a]+"}}]}}
    small = Automaton(spec)
    assert [small.encode("a" * n) for n in (1, 2, 3, 4)] == [[1], [3], [2, 1], [2, 3]]


def test_rows(spark, docs, library):
    rows = [(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "Ab cd", "en", "a"), (5, "wört " * 50_000, "de", "b")]
    got = {r.doc_id: r for r in encode(docs(rows, "ids"), PATH).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[1].ids == []
    assert got[1].ids_sha256 == got[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[5].ids == library.encode("wört " * 50_000, add_special_tokens=False).ids
    assert got[None].decoded == "ab</w> cd</w>"
    assert encode(docs([]), PATH).count() == 0


def test_query_matches_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op2_bpe"](spark, sf).collect()}
    assert got == want
