import random
import tracemalloc

from tokenizers import Tokenizer, models, pre_tokenizers

from sluice.llm import token_counts as tc


def tokenizer(pieces):
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0, False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_counts_equal_the_tokenizer(spark):
    rng = random.Random(8)
    vocab = tc.vocabulary(tc.default_vocabulary_path())
    # the tokenizer takes the least score over its whole vocabulary, with <unk> at 0
    t = tokenizer(vocab)
    words = ["The", "thonouble", "ünïted", "", "", "日本語", "x\ny", "\t", "🙂🙂", "🙂", "don't", "HASHWH!!", " ", "a" * 70, "▁"]
    texts = [(i, " ".join(rng.choice(words[:-1]) for _ in range(rng.randint(1, 40)))) for i in range(200)]
    texts += [(200, None), (201, ""), (202, " "), (203, "  a  "), (204, "word " * 5000), (205, "🙂 🙂🙂 x🙂")]
    df = spark.createDataFrame([(*x, 1) for x in texts], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in tc.count_tokens(df).collect()}
    assert got == {d: len(t.encode(s or "", add_special_tokens=False).ids) for d, s in texts}
    assert tc.count_tokens(df.filter("false")).count() == 0


def test_ties(spark):
    rng = random.Random(9)
    pieces = sorted({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(40)} - {"c"})
    pieces = [(p, -float(rng.randint(1, 3))) for p in pieces]
    t, counter = tokenizer(pieces), tc.Counter(pieces)
    for _ in range(500):
        s = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        assert counter.count("▁" + s) == len(t.encode(s, add_special_tokens=False).ids), s


def test_given_scores(spark):
    rng = random.Random(10)
    pieces = [("▁", -2.5), ("a", -3.0), ("b", -3.25), ("ab", -5.5), ("▁a", -6.0), ("ba", -2.0), ("aba", -9.0)]
    t = tokenizer(pieces)
    texts = [(i, " ".join("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(5))) for i in range(50)]
    got = tc.count_tokens(spark.createDataFrame(texts, "doc_id long, text string"), pieces=pieces).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {d: len(t.encode(s, add_special_tokens=False).ids) for d, s in texts}


def test_long_stretch_in_constant_memory():
    rng = random.Random(11)
    pieces = [("▁", -1.0), ("a", -2.0), ("b", -2.5), ("ab", -3.0), ("bba", -4.0)]
    counter, stretch = tc.Counter(pieces), "".join(rng.choice("abc") for _ in range(300_000))
    want = len(tokenizer(pieces).encode(stretch, add_special_tokens=False).ids)
    tracemalloc.start()
    assert counter.count("▁" + stretch) == want
    assert tracemalloc.get_traced_memory()[1] < 2_000_000
    tracemalloc.stop()
