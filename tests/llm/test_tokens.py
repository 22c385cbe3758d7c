import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanlake.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SIGNS = "abc dé'srevtlmd\n\t\r 1２٣½!?  日本🎉​\u0085　ǅ-_\x00\x1c"


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    return tokens.PrefixCounter(spec, tokens.char_classes(spec))


def made_up(n, seed=1):
    rnd = random.Random(seed)
    odd = ["<|endoftext|>", "'re", "'ll", "the ", " hello", "aaaaaaaa", "'", "  ", "<|endof"]
    return ["".join(rnd.choice([rnd.choice(SIGNS), rnd.choice(SIGNS), *odd]) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_counts_and_prefixes_match_the_library(counter):
    texts = made_up(3000)
    _, counts, bounds = counter.table(texts)
    assert tokens.sums(counts, bounds).tolist() == [library(t) for t in texts]
    for text in texts[:300]:
        ends, counts, _ = counter.table([text])
        so_far = np.cumsum(counts).tolist()
        for n in range(len(text) + 1):
            assert counter.at(text, ends.tolist(), so_far, n) == library(text[:n]), (text, n)


def test_every_prefix_of_a_piece(counter):
    for piece in (b" antidisestablishmentarianism", b"zzzzzzzzzzzzzzzzz", "éèêçà".encode()):
        row = counter.prefixes(np.frombuffer(piece, np.uint8)[None, :])[0]
        assert row.tolist() == counter.long_prefixes(piece).tolist()
        plain = [library(piece[:n].decode("utf-8", "ignore")) for n in range(len(piece) + 1)]
        assert all(a == b for n, (a, b) in enumerate(zip(row, plain)) if (piece[:n].decode("utf-8", "ignore")).encode() == piece[:n])


def test_character_classes_match_the_library(counter):
    split = LIBRARY.pre_tokenizer.pre_tokenize_str
    for low in [*range(0, 0x34000, 0x8000), 0xE0000]:
        text = "".join("x" + chr(c) for c in range(low, low + 0x8000) if not 0xD800 <= c < 0xE000)
        ends, _, _ = counter.table([text])
        assert [0, *ends.tolist()[:-1]] == [a for _, (a, _) in split(text)]


CASES = [(1, None), (2, ""), (3, "  \n "), (3, "  \n "), (4, "a" * 3000), (5, "word " * 30000), (6, "x<|endoftext|>y<|endoftext|>"), (None, "it's"), (7, "é日" * 400)]


@pytest.mark.parametrize("rows", [CASES, []], ids=["cases", "empty"])
def test_tables_of_edge_cases(spark, rows):
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, n_tokens int, ends string")
    found = tokens.count_tokens(docs, PATH)
    assert found.columns == ["doc_id", "ends", "n_tokens"]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.n_tokens) for r in found.collect()), key=key) == sorted(((d, library(t)) for d, t in rows), key=key)
    cut = tokens.truncate(tokens.prefix_counts(docs, PATH), PATH, 50).collect()
    for r in cut:
        text = r.text or ""
        assert library(text[: r.fits]) <= 50
        assert r.fits == len(text) or library(text[: r.fits + 1]) > 50
        assert (r.counts[-1] if r.counts else 0) == library(text)


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tokens.count_tokens(docs, PATH).collect():
        assert r.n_tokens == library(texts[r.doc_id])
