"""The pipeline's stages and entries against brute force on planted rows."""

import random

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from graphmend.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_clean_documents_and_their_columns(spark, tmp_path):
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    clean = {i: say(120) for i in range(10)}
    exam = say(40)
    rows = [(i, t) for i, t in clean.items()]
    rows += [(20, clean[3]), (21, clean[3] + " end"), (22, say(5)), (23, "same words again and again so it is dull " * 20), (24, None)]
    rows += [(25, say(60) + " " + exam), (26, say(60) + " write to jane at example dot org")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, exam)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out, ids = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns, name
        ids.append(sorted(r.doc_id for r in out.collect()))
    assert ids[0] == [*range(10), 20, 21, 25, 26]
    assert ids[1] == [*range(10), 25, 26]
    assert ids[2] == ids[3] == [i for i in ids[1] if i != 25]
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[26].endswith("write to [EMAIL]") and all(texts[i] == clean[i] for i in clean)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert {p.doc_id: p.doc_tokens for r in packed for p in r.pieces} == sizes


def test_entries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) and 4 <= len(corpus_pipeline.STAGES) <= 5
