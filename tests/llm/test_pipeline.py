import hashlib
import struct
from collections import Counter

import corpus_pipeline as cp
from quarrymill.llm import mixing, quality
from quarrymill.llm.queries import tokenizer_path

from .test_jaccard_join import brute
from .test_substring_dedup import WORD
from .util import ODD, docs as odd_docs

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.s for r in quality.with_scores(docs, quality.fit(docs, labels), "s").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] >= cp.QUALITY_THRESHOLD}
    assert 0 < len(texts) < docs.count()
    kept = {i: texts[i] for i, _, c, _ in brute(sorted(texts.items()), 5, "0.8") if i == c}
    least = {}
    for i in sorted(kept, reverse=True):
        ws = WORD.findall(kept[i])
        least |= {tuple(ws[k : k + 13]): i for k in range(len(ws) - 12)}
    left = {}
    for i, t in kept.items():
        spans = [m.span() for m in WORD.finditer(t)]
        ws = [t[a:b] for a, b in spans]
        gone = {k + j for k in range(len(ws) - 12) if least[tuple(ws[k : k + 13])] < i for j in range(13)}
        cut = t[: spans[0][0]] + "".join(t[a : spans[k + 1][0] if k + 1 < len(spans) else len(t)] for k, (a, _) in enumerate(spans) if k not in gone) if spans else t
        if not gone or len(gone) < len(ws):
            left[i] = cut
    got = cp.run(spark, SF).collect()
    sources = {r.doc_id: r.source for r in docs.collect()}
    plan = mixing.mix(spark.createDataFrame([(i, t, sources[i]) for i, t in left.items()], "doc_id long, text string, source string"), max_repetition=cp.MAX_REPETITION, whole=True)
    turns = Counter({i: 1 for i in left}) | Counter(r.doc_id for r in plan.select("doc_id").collect())
    assert Counter(r.doc_id for r in got) == turns and max(turns.values()) <= 2
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for r in got:
        ids = model.encode(left[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [d for _, d in out.dtypes] == [d for _, d in docs.dtypes]
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_take_odd_rows(spark):
    rows = ODD + [(20, "same text of a few words that two rows share"), (21, "same text of a few words that two rows share"), (None, None), (22, "y " * 60_000)]
    df = odd_docs(spark, rows, extra=True)
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        kept[name] = Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect())
    every = Counter(rows)
    assert kept["quality"] <= every
    assert kept["near_duplicates"] == every - Counter([(4, "one"), (21, rows[-3][1])])
    assert set(kept["substrings"]) == set(every) and set(kept["mixing"]) == set(every) and every <= kept["mixing"]
    last = cp.STAGES[-1][1](spark, df, SF).collect()
    assert Counter(r.doc_id for r in last) == Counter(i for i, _ in rows)
