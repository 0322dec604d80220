"""Token counts against the model's own encoding of whole texts, in windows of a few bytes."""

import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import tokencount

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
SMALL = tokencount.Windows(PATH, chunk=48, overlap=4)
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "word " * 20000), (6, "x" * 300000), (7, "😀é漢字́"), (8, "<s> a</s>"), (8, "<s> a</s>"), (None, "the ▁ text")]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab the-=.1▁é中\U00020001\n\t"), max_size=400))
def test_windows_give_the_tokens_of_the_whole_text(text):
    ends, _, _ = SMALL.encode(text)
    pieces = [MODEL.id_to_piece(i) for i in MODEL.encode(text)]
    sizes = [1 if MODEL.is_byte(MODEL.piece_to_id(p)) else len(p.encode()) for p in pieces]
    want = [sum(sizes[: k + 1]) - 3 for k in range(len(sizes))]
    assert ends.tolist() == want


def test_runs_without_a_stable_boundary_widen_their_overlap():
    rnd, widened = random.Random(1), 0
    for _ in range(300):
        some = rnd.sample(["a", "aaa", "-", "==", "....", "  ", "中", "ing"], 2)
        text = "".join(rnd.choice(some) for _ in range(rnd.randint(0, 300)))
        ends, _, doubled = SMALL.encode(text)
        widened += doubled
        assert len(ends) == len(MODEL.encode(text))
    assert widened


def test_counts_of_a_table(spark):
    rows = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in EDGES], "doc_id long, text string, n_tokens int, id string, windows string")
    got = tokencount.count_tokens(rows, PATH, limit=1000)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "windows", "widened"]
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(((i, len((t or "").encode()), len(MODEL.encode(t or "")), len(MODEL.encode(t or "")) > 1000) for i, t in EDGES), key=key)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()), key=key) == want
    assert got.where("windows > 1").count() == 2
    assert tokencount.count_tokens(rows.limit(0), PATH).count() == 0


def test_all_documents_against_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, PATH, chunk=2000, overlap=64).collect()}
    assert got == {r.doc_id: len(MODEL.encode(r.text or "")) for r in docs.collect()}


def test_other_models_are_refused():
    with pytest.raises(Exception):
        tokencount.Windows(public_tokenizers.path("byte_bpe_50k.json"))
