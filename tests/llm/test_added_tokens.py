"""Texts that hold the content of an added token get the library's ids."""

import zlib
from collections import Counter
from random import Random

import numpy as np
import pyarrow as pa
import pytest

from obsflow.llm import packing, rans, tokens
from obsflow.llm.queries import vocabulary

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "end<|endoftext|>of", "x <|startoftext|> y", "<|StartOfText|> up <|ENDOFTEXT|>", "plain words here", "<|endoftext| >", "a\n<|endoftext|>\nb"]

PIECES = [
    "a", "b", "Z", "é", "İ", "ß", "ﬁ", "中", "文", "д", "😀", "\u0301", "ʼ", "'s", "'ll", "'", "’", "1", "23", "٣", "²", "½", ".", ",", "!", "&&&", "###", " ", " ", " ", "  ",
    "\n", "\n\n", " \n", "\t", "\xa0", "\u3000", "<|endoftext|>", "<|ENDOFTEXT|>", "the", "ing", "Ǆ", "ǰ", "Å", "\u212a", "ﷺ", "_", "-", "\u200b", "\u0307", "aİ,", "é.", "</w>", "\x00", "\r\n", "ſ", "\x85",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(name))
    ids, lengths = tokens.tokenizer(vocabulary(name)).encode(pa.array(TEXTS))
    want = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert lengths.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_random_texts_equal_the_library(name):
    from tokenizers import Tokenizer

    random = Random(4)
    texts = ["".join(random.choice(PIECES) for _ in range(random.randint(0, 14))) for _ in range(10_000)]
    library = Tokenizer.from_file(vocabulary(name))
    found = tokens.WordTokenizer(vocabulary(name), keep=2000)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        ids, lengths = found.encode(pa.array([*part, None]))
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)] + [[]]
        assert lengths.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_operators_equal_the_library(spark):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    crc = lambda ids: zlib.crc32(np.asarray(ids, "<u4").tobytes())
    path = vocabulary("word_bpe_49k.json")
    ids = [[*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 1] for t in TEXTS]
    starts = np.cumsum([0, *map(len, ids)]).tolist()
    got = Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rans.round_trip(docs, path).collect())
    assert got == Counter((k, starts[k], len(x), crc(x)) for k, x in enumerate(ids))
    path = vocabulary("byte_bpe_50k.json")
    ids = [[*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 2] for t in TEXTS]
    got = Counter((r.doc_id, r.length, r.ids_crc32) for r in packing.pack(docs, path).collect())
    assert got == Counter((k, len(x), crc(x)) for k, x in enumerate(ids))
