import os
import random

import pytest

from tests.llm.texts import ODD, frame, words
from wirelake.llm import token_cache as C

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(C.tokenizer_path(C.TOKENIZER))


def test_pieces_equal_the_library(tokenizer):
    rnd = random.Random(1)
    counter = C.PieceCounter(C.tokenizer_path(C.TOKENIZER))
    parts = [*"ab 1.,!'\n\t\r é中🙂", "  ", "\n\n ", "'s", "'re", " the", " ", " ", "\x1c", "\x85", "​", "<|endoftext|>", "x" * 40]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 15))) for _ in range(5000)]
    assert counter.count(texts) == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_documents_and_cache(spark, tokenizer, tmp_path):
    rnd = random.Random(2)
    texts = [*ODD, *[words(rnd, 700) for _ in range(3)], "again", "again"]
    cache = str(tmp_path / "cache")
    docs = frame(spark, [*enumerate(texts), (None, "null id")], digest="x", n_tokens=5, tokenizer="t")
    rows = C.count_tokens(docs, cache).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = "null id" if r.doc_id is None else texts[r.doc_id] or ""
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for t in texts}) + 1
    # a second run encodes only what is new
    C.count_tokens(frame(spark, ["again", "new text"]), cache).collect()
    assert spark.read.parquet(cache).count() == stored.count() + 1
    # another tokenizer version shares nothing
    C.count_tokens(frame(spark, ["again"]), cache, tokenizer="word_bpe_49k.json").collect()
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_a_digest_that_was_appended_twice_answers_once(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = frame(spark, ["one text", "two texts", "one text"])
    C.count_tokens(docs, cache).collect()
    spark.read.parquet(cache).write.mode("append").parquet(str(tmp_path / "twice"))
    spark.read.parquet(cache).write.mode("append").parquet(str(tmp_path / "twice"))
    rows = C.count_tokens(docs, str(tmp_path / "twice")).collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 2]


def test_other_tokenizers_count_whole_texts():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    rnd = random.Random(3)
    texts = [words(rnd, 30) for _ in range(20)] + [t for t in ODD if t]
    for name in sorted(f for f in os.listdir(os.path.dirname(public_tokenizers.path(C.TOKENIZER))) if f.endswith((".json", ".model"))):
        path = public_tokenizers.path(name)
        if name.endswith(".model"):
            want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
        else:
            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            want = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert C.PieceCounter(path).count(texts) == want, name


def test_empty(spark):
    assert C.count_tokens(frame(spark, [])).collect() == []
