"""Pre-tokens longer than the chunks they are read in, in every script, against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemospark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
RUNS = ["漢", "—", "•", "…", "→", "😀", "한", "م", "क", "Ж", "ß", "ñ", "½", "٣", "　", "́", "\x1c", "\x85"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(codec, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("run", RUNS)
def test_runs_longer_than_a_chunk(library, run):
    codec = bpe.Codec(*bpe.read_codec(PATH))
    for text in (run * 66_000, " " + run * 66_000, f"word {run * 40_000} and {run * 70_000}x", run * 65_536 + " ", f"a{run * 33_000}\n{run * 33_000}"):
        same(codec, library, text)


def test_runs_in_small_chunks(library, monkeypatch):
    codec = bpe.Codec(*bpe.read_codec(PATH))
    monkeypatch.setattr(bpe, "CHUNK", 64)
    codec.lookahead = 160
    rnd = random.Random(8)
    for _ in range(300):
        same(codec, library, "".join(rnd.choice([run * rnd.randint(1, 90) for run in RUNS] + [" ", "  ", "x", "\n", "'s", " 12"]) for _ in range(7)))


def test_long_runs_through_the_operator(spark, library):
    texts = ["漢" * 66_000, " " + "—" * 70_000, "😀" * 40_000 + " end", "é" * 80_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(d, PATH).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
