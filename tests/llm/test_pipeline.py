"""The pipeline's stages on the smallest table: each against a plain version of its decision."""

import corpus_pipeline
from plumbline.llm import langid, spm, toxic
from plumbline.llm.common import fold, table
from plumbline.llm.decontam import normal_words

from .test_groups import plain_components
from .test_rows import LOW, MODEL, plain_hits

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_plain_versions_keep(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        kept[name] = docs
        if name != "sentencepiece":
            assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        if name == "toxicity":
            model = toxic.train(before, table(spark, SF, "labels"), fold("doc_id", 4) != 2)
            assert ids == {k for k, t in rows if toxic.score(normal_words(t), model) < 0.3}
        elif name == "language":
            f = langid.scorer(langid.train(before.filter(fold("doc_id", 5) != 0)))
            import pyarrow as pa

            lang, _, share, n = f(pa.array([t for _, t in rows]))
            assert ids == {k for (k, _), x, y, z in zip(rows, lang, share, n, strict=True) if x != "und" and (y >= 0.2 or z < langid.LEAST_TOLD)}
        elif name == "near_copies":
            assert ids == {c for _, n, c in plain_components(rows, 5, 8, 10)}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
            wanted = set()
            texts = {k: " ".join(x.decode() for x in normal_words(t)) for k, t in rows}
            for k, t in rows:
                if not any(f" {' '.join(w[i:i + 10])} " in f" {texts[k]} " for w in ([x.decode() for x in normal_words(i)] for _, i in items) for i in range(max(1, len(w) - 9))):
                    wanted.add(k)
            assert ids == wanted
        else:
            pieces = spm.loaded(MODEL)
            assert {r.doc_id: pieces.decode(r.ids) for r in docs.collect()} == dict(rows)
    assert len(LOW) and plain_hits("", [])[1] == 0
    assert corpus_pipeline.run(spark, SF).count() == kept["sentencepiece"].count()


def test_an_empty_table_passes(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
