import random

import pytest

from motorlake.llm import token_counts

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def encoder():
    return sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())


def test_any_cut_counts_like_the_library(encoder):
    rnd = random.Random(1)
    signs = [*" a b the\n\t  ▁▁é<s></s>&;\r{}()0123漢🙂　\xa0​", "tion", "</s>", "<unk>", "<0x0A>", "    "]
    for _ in range(1500):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randrange(60)))
        counter = token_counts.Counter(encoder, keep=40)
        assert counter.count([text], batch_bytes=10, piece_chars=rnd.choice([3, 7, 20, 1000])) == [len(encoder.encode(text))], text


def test_awkward_rows(awkward, nothing, encoder):
    got = token_counts.token_counts(awkward).join(awkward.select("doc_id", "text").distinct(), "doc_id").collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in awkward.where("doc_id is not null").collect()}
    for r in got:
        n = len(encoder.encode(r.text or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 4096)
    assert token_counts.token_counts(awkward).count() == awkward.count()
    assert token_counts.token_counts(nothing).count() == 0
