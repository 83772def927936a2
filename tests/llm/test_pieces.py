"""SentencePiece encoding against the library on whole texts."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tidemark.llm import pieces, queries
from tidemark.llm.common import pick

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def whole(rows):
    return sorted((str(i), SP.encode(t or ""), SP.decode(SP.encode(t or "")) if t else "") for i, t in rows)


def got(df):
    return sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in df.collect())


def by_words(texts):
    words, n = pieces.marked_words(pa.array(texts, pa.string()))
    of = {b"": [SP.piece_to_id(pieces.MARK)]}
    ids = [of.get(w) or SP.encode(w.decode()) for w in words.to_pylist()]
    out, at = [], 0
    for k in n.tolist():
        out.append([x for part in ids[at:at + k] for x in part])
        at += k
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(list("  ▁ab\n\t.<0x>s/")), st.characters(exclude_categories=["Cs"]))), min_size=1, max_size=6))
def test_marked_words_are_segmented_apart(texts):
    assert by_words(texts) == [SP.encode(t) for t in texts]


def test_against_the_library(spark, monkeypatch):
    rng = random.Random(1)
    letters = list("  ▁abcdeé日😀\n\t.,0123<s>\x00\x1f퟿") + ["the ", " and", "   ", "<unk>", "</s>", "<0x0A>", "ing"]
    rows = [(rng.choice([i, 3, None]), "".join(rng.choices(letters, k=rng.randrange(60)))) for i in range(400)]
    rows += [(1, None), (2, ""), (3, " "), (4, "   "), (5, "▁"), (6, "a "), (6, "a "), (7, "word " * 30_000 + "x" * 50_000)]
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, ids int, block string").repartition(4)
    for block in (8 << 20, 300):
        monkeypatch.setattr(pieces, "BLOCK", block)
        out = pieces.encode(df, MODEL, carry=("block",))
        assert out.columns == ["doc_id", "block", "ids", "decoded"]
        assert got(out) == whole(rows)


def test_odd_rows_and_empty_tables(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in pick(odd, "doc_id", "text").collect()]
    assert got(pieces.encode(odd, MODEL)) == whole(rows)
    assert pieces.encode(none, MODEL).collect() == []


def test_each_word_is_segmented_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(pieces, "BLOCK", 200)
    path = str(tmp_path / "rows")
    spark.createDataFrame([(i, f"some words that all rows have {i % 3}") for i in range(300)], "doc_id long, text string").repartition(6).write.parquet(path)
    rows = spark.read.parquet(path)
    words = pieces._split(rows.select("text", "doc_id"), 4, words=True)
    counts = [len(pieces._unpack(r["body"])[0]) for r in words.collect()]
    assert sum(counts) <= words.select("block").distinct().count() * 9  # distinct words of a block
    assert {r["bucket"] for r in words.collect()} <= set(range(4))
    places = pieces._split(rows.select("text", "doc_id"), 4, words=False)
    assert {r["block"] for r in places.collect()} == {r["block"] for r in words.collect()}
    assert got(pieces.encode(rows, MODEL, repeatable=True)) == whole([tuple(r) for r in rows.collect()])


def test_rows_in_another_order_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 200)
    df = spark.createDataFrame([(i, f"row {i} of many") for i in range(200)], "doc_id long, text string").repartition(2)
    split = pieces._split
    monkeypatch.setattr(pieces, "_split", lambda rows, n, words: split(rows if words else rows.orderBy(F.desc("doc_id")), n, words))
    with pytest.raises(Exception, match="another order"):
        pieces.encode(df, MODEL, repeatable=True).collect()


def test_a_model_whose_pieces_cross_markers_is_refused(monkeypatch):
    class Crossing:
        def __init__(self, model_file):
            pass

        def get_piece_size(self):
            return 2

        def id_to_piece(self, i):
            return ["▁new", "▁new▁york"][i]

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError, match="cross a whitespace marker"):
        pieces.processor("any")


def test_registered_query(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((i, len(SP.encode(t)), sha(",".join(map(str, SP.encode(t)))), sha(SP.decode(SP.encode(t)))) for i, t in rows)
    assert sorted(map(tuple, queries.op13_pieces(spark, SF).collect())) == want
