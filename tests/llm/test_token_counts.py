"""The transducer against the library's own encoding."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from corpusforge.llm import token_counts
from corpusforge.llm.queries import QUERIES

from .test_filters import docs_of

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def machine():
    with open(PATH, "rb") as f:
        return token_counts.Transducer(token_counts.model_pieces(f.read()))


def odd_texts():
    rnd = random.Random(1)
    return ["", None, " ", "  ", "a" * 5000, "ab" * 3000, "▁▁ x", "\x00\n\t<s></s><unk>", "日本語テキスト🙂🙂" * 50, "=" * 7000, " " * 5000, "x y " * 4000,
            "".join(rnd.choice("abcdefgh") for _ in range(20000)), "".join(chr(rnd.randrange(32, 0x3000)) for _ in range(9000))]


def test_pairs_that_stay_apart(machine, library):
    rnd = random.Random(3)
    for _ in range(3000):
        a, b = rnd.randrange(len(machine.tokens)), rnd.randrange(len(machine.tokens))
        text = machine.tokens[a] + machine.tokens[b]
        if text.startswith("▁"):  # the library sets a blank in front
            assert machine.stay_apart(a, b) == (library.encode(text[1:], out_type=str) == [machine.tokens[a], machine.tokens[b]] if len(text) > 1 else True)


@pytest.mark.parametrize("chunk,block", [(512, 1 << 21), (7, 1000), (64, 64), (1024, 5000)])
def test_odd_texts_in_chunks(machine, library, monkeypatch, chunk, block):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    monkeypatch.setattr(token_counts, "BLOCK", block)
    texts = odd_texts()
    want = [len(library.encode(t or "")) for t in texts]
    assert token_counts.count(machine, texts).tolist() == want
    monkeypatch.setattr(token_counts, "STATES", 50)  # the machine starts anew after every block
    assert token_counts.count(machine, texts).tolist() == want
    assert len(machine.keys) < 50_000


def test_maps_compose(machine, monkeypatch):
    """Entries that the scan picks are the states of a plain walk."""
    rnd = random.Random(5)
    text = "".join(rnd.choice("ab a= ") for _ in range(999)) + "=" * 700 + "word " * 50
    symbols = np.concatenate([[machine.start], machine.symbol[[ord(c) for c in text]]])
    states, state, gains = [], np.zeros(1, np.int64), []
    for s in symbols:
        state, gain = machine.move(state, np.array([s]))
        states.append(int(state[0]))
        gains.append(int(gain[0]))
    for size in (3, 16, 50):
        n = -(-symbols.size // size)
        grid = np.full(n * size, machine.fill)
        grid[:symbols.size] = symbols
        maps = token_counts.StateMaps(machine, np.ascontiguousarray(grid.reshape(n, size).T), 0)
        for k in range(1, n):
            assert maps.starts[maps.entry[k]][k] == states[k * size - 1]
            assert maps.sums[k - 1, 0] == sum(gains[:k * size])
        monkeypatch.setattr(token_counts, "CHUNK", size)
        assert machine.gains(symbols, 0)[0].tolist() == gains


def test_query(spark, library):
    sf = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in QUERIES["op11_token_counts"](spark, sf).collect())
    want = []
    for d, t in docs_of(spark, sf):
        n = len(library.encode(t or ""))
        want.append((d, len((t or "").encode()), n, n > 4096))
    assert got == sorted(want)


def test_edge_rows(spark, library):
    with open(PATH, "rb") as f:
        model = f.read()
    texts = odd_texts()
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, "a b", "y", 1), (3, "a b", "z", 1), (3, "a b", "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int").repartition(3)
    got = sorted([tuple(r) for r in token_counts.count_tokens(df, model, limit=600).collect()], key=repr)
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "")), n > 600) for d, t, _, _ in rows]
    assert got == sorted(want, key=repr)
    assert token_counts.count_tokens(df.where("false"), model, limit=1).count() == 0


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(PATH, "rb") as f:
        m = pb.ModelProto.FromString(f.read())
    m.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        token_counts.model_pieces(m.SerializeToString())
