"""The pipeline's stages against plain Python on the smallest tables."""

import corpus_pipeline
from lakesight.llm import decontamination
from lakesight.session import materialise
from tests.llm.test_operators import brute_components, plain_fingerprint  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def test_each_stage_does_its_part(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(materialise(stage(spark, tables[-1], SMALL)))
    assert all(t.columns == docs.columns for t in tables[:-1])
    whole, good, single, clean, mixed, tokens = ([tuple(r) for r in t.collect()] for t in tables)
    assert set(good) < set(whole) and set(single) < set(good) and set(clean) < set(single) and set(mixed) <= set(clean)
    components = brute_components([(d[0], d[1]) for d in good])
    assert {d[0] for d in single} == {component for (_, _, component) in components}
    items = [decontamination.words_of(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 13]) for w in items for i in range(max(1, len(w) - 12))}
    def bad(text):
        words, hit = decontamination.words_of(text), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit.update(range(i, i + size))
        return bool(hit) and 20 * len(hit) >= len(words)
    assert {d[0] for d in clean} == {d[0] for d in single if not bad(d[1])}
    assert sorted(t[0] for t in tokens) == sorted(m[0] for m in mixed)
    starts = sorted((t[1], t[2]) for t in tokens)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert set(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == set(tokens)
