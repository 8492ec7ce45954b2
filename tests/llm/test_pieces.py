import random

import numpy as np
import pytest
import sentencepiece
from odd import no_docs, odd_docs

from quillspark.llm import pieces
from quillspark.llm.pieces import BPE, MODEL, UNIGRAM, Pieces

ALPHABET = [" ", "  ", "a", "aa", "e", "th", "er", "\n", "\t", "é", "中", "国", "😀", "▁", "0", "1", "<s>", "<0x0A>", "in", "g", "the", "!", "=", "====", "​", "ñ", "x", "ON", "A"]


@pytest.fixture(scope="module")
def model():
    return Pieces.load()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def strange(n, seed=1):
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return [*out, "a" * 500, "=" * 300, " " * 200, "ab" * 400, "", "the" * 3000, "\n" * 100, "0123456789" * 50]


def lists(model, texts):
    ids, ends = model.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def test_ids_are_the_librarys(model, library):
    texts = strange(4000)
    assert lists(model, texts) == library.encode(texts)


def test_texts_of_the_table(model, library):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    assert lists(model, texts) == library.encode(texts)


def test_memory_can_be_lost(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 50)
    texts = strange(200, seed=2)
    assert [x for k in range(0, len(texts), 20) for x in lists(model, texts[k : k + 20])] == library.encode(texts)


def test_unspaced_texts_are_not_remembered(library, monkeypatch):
    """Texts without spaces are one word each: they are encoded whole, and the memory stays bounded."""
    model, rnd = Pieces.load(), random.Random(9)
    glyphs = [chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(300)] + list("abcdefghij0123456789+/=")
    texts = ["".join(rnd.choice(glyphs if k % 2 else "aAbBtThHeE0123456789+/") for _ in range(rnd.randint(40, 400))) for k in range(300)]
    assert lists(model, texts) == library.encode(texts)
    assert all(len(w) <= pieces._LONG for w in model.memo) and model.memo_used < 1000
    monkeypatch.setattr(pieces, "MEMO", 3000)
    for k in range(30):
        words = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(100))]
        assert lists(model, words) == library.encode(words)
        assert model.memo_used < 3000 + 2000 and len(model.memo_ids) <= 1 << 14


def test_long_words_of_near_lengths(model, library):
    """Padded rows give what each gives alone."""
    words = ["=" * n + "ab" * (n % 7) for n in range(40, 140)] + ["\n" * 61 + "x", "the" * 33]
    assert lists(model, words) == library.encode(words)
    assert lists(model, [" ".join(words)]) == library.encode([" ".join(words)])


def test_round_trip(model, library):
    for text in strange(800, seed=3):
        ids = lists(model, [text])[0]
        assert model.decode(ids) == library.decode(ids) == text.replace("▁", " ")
    assert model.decode(None) == "" and model.decode([]) == ""
    assert model.decode([1, 415, 2]) == library.decode([1, 415, 2])
    rnd = random.Random(5)
    for _ in range(300):  # broken characters too
        ids = [rnd.choice([229, 184, 230, 3, 243, 415, 130, 28705]) for _ in range(rnd.randint(1, 9))]
        assert model.decode(ids) == library.decode(ids)


def plain_viterbi(model, word):
    """Largest summed score over all segmentations, from strings."""
    scores = {model.names[i]: s for i, s in zip(model.piece_ids.tolist(), model.scores.tolist())}
    best = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        for at in range(max(0, end - model.width), end):
            s = scores.get(word[at:end], model.least if end - at == 1 else None)
            if s is not None:
                best[end] = max(best[end], best[at] + s)
    return best[-1]


def test_unigram_path_has_the_largest_score():
    model = Pieces.load(kind=UNIGRAM)
    scores = dict(zip(model.piece_ids.tolist(), model.scores.tolist()))
    for text in [t for t in strange(150, seed=4) if t]:
        for word in model._cut.findall("▁" + text.replace(" ", "▁")):
            ids, n = model._words([word])
            known = sum(scores.get(i, 0.0) for i in ids.tolist() if i in scores)
            unknown = sum(1 for c in word if c not in {model.names[i] for i in scores})
            assert known + unknown * model.least == pytest.approx(plain_viterbi(model, word))


def test_only_known_kinds_of_models():
    with pytest.raises(ValueError):
        Pieces.load(kind=3)
    assert Pieces.load().kind == BPE


def test_rows(spark, library):
    docs = odd_docs(spark)
    found = pieces.encode_pieces(docs)
    rows = found.collect()
    assert len(rows) == docs.count() and all(r["round_trip"] for r in rows)
    want = {r["doc_id"]: library.encode(r["text"] or "") for r in docs.where("doc_id IS NOT NULL").collect()}
    assert all(r["ids"] == want[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) for r in rows if r["doc_id"] is not None)
    assert pieces.encode_pieces(no_docs(spark)).collect() == []
    texts = {r["doc_id"]: (r["text"] or "").replace("▁", " ") for r in docs.where("doc_id IS NOT NULL").collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in pieces.decode_pieces(found).where("doc_id IS NOT NULL").collect())
