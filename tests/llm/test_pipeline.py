import numpy as np

import corpus_pipeline
from loomwork.llm import decontamination as D
from loomwork.llm import simhash_dedup as S
from loomwork.llm import sentencepiece_scan as P
from loomwork.llm.queries import tokenizer_file


def test_stages_take_effect(spark, documents, tmp_path):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("aeioulmnrst"), rng.integers(3, 9))) for _ in range(3000)]
    say = lambda n: " ".join(vocabulary[k] for k in rng.integers(0, 3000, n))
    item = f"{say(20)}. {say(8)}."
    shared = say(60)
    texts = [say(80) + (" wretchedly" if i % 4 == 0 else "") for i in range(200)]
    clean = list(range(1, 200, 4))
    texts[201:] = [texts[1], say(40) + " " + shared, shared + " " + say(40), say(30) + " " + item + " " + say(30), say(50) + " wretchedly"]
    docs = documents([*texts[:200], texts[200], *texts[201:]])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    last, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, last, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out-{name}"))
        last = spark.read.parquet(str(tmp_path / f"out-{name}"))
        kept[name] = {r.doc_id: r for r in last.collect()}
    assert not [i for i in kept["toxicity"] if i < 200 and i % 4 == 0] and set(clean) <= set(kept["toxicity"]) and len(texts) - 1 not in kept["toxicity"]
    assert 200 not in kept["simhash_near_dedup"] and 1 in kept["simhash_near_dedup"]
    cut = kept["substring_dedup"]
    assert shared in cut[201].text and shared not in cut[202].text and cut[202].n_chars == len(cut[202].text)
    assert {i: r.text for i, r in cut.items() if i < 200} == {i: texts[i] for i in cut if i < 200}
    assert set(cut) - set(kept["benchmark_decontamination"]) == {203}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(rows) == set(kept["benchmark_decontamination"]) and all(r.round_trip for r in rows.values())
    model = P.lattice(tokenizer_file("piece_bpe_32k.model"))
    assert all(r.n_pieces == len(model.encode(kept["benchmark_decontamination"][i].text)) // 4 for i, r in rows.items())
    assert D.SHARE < 1 and S.MAX_BITS == 3
