"""run() against the brute-force counterparts of its stages, one after the other."""

import random
import zlib
from array import array

import pytest
from brute import component_ids
from test_decontaminate import fewest_edits, fold
from test_line_dedup import brute as brute_lines
from test_quality_sharding import brute_repeat

import corpus_pipeline
from sluice.llm import decontaminate, packing, quality

COMMON = ["the", "of", "and", "to", "in", "is", "that"]


def corpus():
    rng = random.Random(21)
    vocab = [f"word{i}" for i in range(500)]
    line = lambda n: " ".join(rng.choice(COMMON) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(n))
    items = {i: line(12) for i in range(4)}
    docs = {}
    for d in range(60):
        lines = [line(rng.randint(8, 25)) for _ in range(rng.randint(2, 5))]
        if d % 6 == 0:
            lines.append("All rights reserved to the authors of this text.")
        if d % 10 == 3:
            lines.insert(1, items[d % 4])
        docs[d] = "\n".join(lines)
    docs[60], docs[61], docs[62] = docs[5], docs[7].replace("of", "to", 1), "### " * 30
    docs[63], docs[64], docs[65], docs[66] = None, "", "too short", "same words again " * 30
    return docs, items


def kept_by_quality(text):
    words = [w for w in (text or "").replace("\n", " ").split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.strip()]
    n = max(1, len(words))
    measure = {
        "mean_word_length": sum(map(len, words)) / n, "symbol_ratio": sum(c in "#*$%&|<>" for c in text or "") / n,
        "stop_ratio": sum(w in quality.STOP_WORDS for w in words) / n, "dup_line_ratio": (len(lines) - len(set(lines))) / max(1, len(lines)),
    }
    if len(words) < 10 or 100 * brute_repeat(words) > 20 * len(words):
        return False
    return not any(len(words) >= r.least_words and (measure[r.measure] < r.value if r.bound == "<" else measure[r.measure] > r.value) for r in quality.RULES)


@pytest.fixture
def folder(spark, tmp_path):
    docs, items = corpus()
    rows = [(d, t, "en", "s", len(t or "")) for d, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), docs, items


def test_run_equals_brute_force(spark, folder):
    from tokenizers import Tokenizer

    path, docs, items = folder
    left = {d: t for d, t in docs.items() if kept_by_quality(t)}
    assert 0 < len(docs) - len(left) < 8
    after = brute_lines(left)
    left = {d: t for d, (t, _, gone) in after.items() if not (gone and not t.strip())}
    roots = component_ids(left)
    left = {d: t for d, t in left.items() if roots[d] == d}
    clean = {d: t for d, t in left.items() if not any(fewest_edits(fold(s), fold(t)) <= len(s) // decontaminate.EDITS_PER for s in items.values() if len(s) >= decontaminate.MIN_CHARS)}
    assert len(clean) < len(left) < len(docs)
    tok = Tokenizer.from_file(packing.default_tokenizer_path())
    want = {}
    for d, t in clean.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        want[d] = (len(ids), zlib.crc32(array("I", ids).tobytes()))
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in rows} == want
    total = sum(n for n, _ in want.values())
    assert len({r.sequence_id for r in rows}) == -(-total // packing.CAPACITY)


def test_stages_keep_the_columns_of_documents(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(path + "/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, path).columns == list(corpus_pipeline.COLUMNS)
        assert stage(spark, docs.filter("false"), path).count() == 0
