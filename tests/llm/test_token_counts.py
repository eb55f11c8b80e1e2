import random

import public_tokenizers
import sentencepiece

from scriptorium.llm.token_counts import PieceCounter, count_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_are_the_librarys():
    library, counter, draw = sentencepiece.SentencePieceProcessor(model_file=MODEL), PieceCounter(MODEL, most_cached=50), random.Random(2)
    assert counter.splits
    letters = list("abcdeé  \n\n\t▁☃漢<>/s1") + ["<s>", "</s>", "<unk>", "<0x0A>", " the", "the "]
    for table in ({}, dict(zip([" the", "the", " "], counter.lengths([" the", "the", " "])))):
        for _ in range(2000):
            text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 25)))
            assert counter.count(text, table) == len(library.encode(text)), repr(text)


def test_whole_texts(spark, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in odd.collect()}
    rows = count_tokens(odd, MODEL, sample_rows=3, table_size=5).collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(library.encode(text)), len(library.encode(text)) > 4096)
    assert count_tokens(odd.limit(0), MODEL).isEmpty()


def test_a_model_that_cannot_be_split_counts_whole():
    counter = PieceCounter(MODEL)
    counter.splits = False
    assert counter.count("a b  c", {}) == len(counter.model.encode("a b  c"))
