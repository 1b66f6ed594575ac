import public_tokenizers as P
import tiktoken

import corpus_pipeline
from attesta.llm import bpe, pii, toxicity
from attesta.llm.common import read_table
from attesta.llm.queries import CATEGORIES
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_ngram_join import brute as linked


def test_against_plain_python(spark, sf):
    docs = read_table(spark, sf, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    models = toxicity.train(docs, read_table(spark, sf, "labels"), CATEGORIES)
    rows = {d: t for d, t in rows.items() if toxicity.probabilities(models, [t.encode()])[0, 1] < models[1].threshold}
    rows = {d: rows[d] for d, _, c in linked(sorted(rows.items())) if d == c}
    items = [(r.item_id, r.text) for r in read_table(spark, sf, "benchmark").collect()]
    rows = {d: rows[d] for d, _, _, bad in contaminated(sorted(rows.items()), items) if not bad}
    rows = {d: pii.pseudonymised(t, pii.session_key(spark))[0] for d, t in rows.items()}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert got.keys() == rows.keys() and len(rows) < docs.count()
    for d, t in rows.items():
        assert got[d].ids == library.encode_ordinary(t) and got[d].n_tokens == len(got[d].ids) and got[d].decodes


def test_stages_keep_the_columns(spark, sf, odd):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = odd.select(names)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == names
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
