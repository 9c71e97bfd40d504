"""What a Python worker holds: it is used again for the tasks of the next operator."""

import tracemalloc

import numpy as np
import pyarrow as pa

from parcelgrid.llm import arrow, language
from parcelgrid.llm import packing
from parcelgrid.llm.packing import word_ids
from parcelgrid.llm.queries import tokenizer_file
from parcelgrid.llm.token_counts import tokenizer


def test_a_language_task_drops_the_tokenizer_that_packing_left():
    path = tokenizer_file("word_bpe_49k.json")
    word_ids(path)(["some", "words"])
    assert tokenizer.cache_info().currsize == word_ids.cache_info().currsize == 1
    arrow.forget()
    assert tokenizer.cache_info().currsize == word_ids.cache_info().currsize == 0
    assert len(word_ids(path)(["some", "words"])) == 2


def test_ngrams_of_a_block_take_bounded_memory():
    batch = pa.RecordBatch.from_arrays([pa.array(["a sentence of several words " * 40] * 3000)], ["text"])
    language._is_letter()
    tracemalloc.start()
    for b in arrow.blocks(iter([batch]), "text", language.BLOCK):
        language.ngrams(arrow.texts(b))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20


def test_packing_in_small_blocks_remembers_fewer_words_and_gives_the_same_pieces(spark, monkeypatch):
    import corpus_pipeline

    path, asked = tokenizer_file("word_bpe_49k.json"), {}
    text = pa.array([" ".join(f"w{i}x{j}, Stop." for j in range(60)) for i in range(40)])
    ids, at = packing.text_ids(text, path, 2)
    for some in (text[:20], text[20:]):
        packing.text_ids(some, path, 2, 500)
    assert len(word_ids(path, 500).size) < 2000 < len(word_ids(path, packing.REMEMBERED // 2).size)
    again, at2 = packing.text_ids(text, path, 2, 500)
    assert np.array_equal(ids, again) and np.array_equal(at, at2)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(text.to_pylist())], "doc_id bigint, text string")

    def batches(made):
        def seen(df):
            asked.setdefault(block, df.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
            return made(df)
        return seen

    monkeypatch.setattr(packing, "durable", batches(packing.durable))
    got = []
    for block in (1 << 20, 1 << 12):
        got.append({tuple(r) for r in packing.token_pieces(docs, path, end=2, block=block).select("doc_id", "start", "length", "ids").collect()})
        packing.packed(docs, path, end=2, with_ids=False, block=block)
    assert got[0] == got[1] and len(got[0]) == 40
    assert asked[1 << 20] == f"{8 << 20}b" and asked[1 << 12] == f"{8 << 12}b"
    monkeypatch.setattr(corpus_pipeline, "packed", lambda df, *a, **k: asked.update(stage=k["block"]))
    corpus_pipeline.pack_stage(spark, docs, "")
    assert asked["stage"] == 1 << 18
