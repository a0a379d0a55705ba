"""The pipeline against plain Python, stage by stage, each on what its predecessor kept."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
import plain
import pytest
from test_nearcopies import survivors

from blocklens.llm import bpe, mixing, quality

SF = "/root/testdata/sf0.001"


def draw(seed, doc_id):
    return int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)


def copies(docs):
    """Copies of each (doc_id, text, lang, source) row."""
    sizes = Counter()
    for _, text, _, source in docs:
        sizes[source] += len(plain.words(text))
    goal = plain.targets(dict(sizes))
    rate = {s: min(3.0, goal[s] / n) if n else 0.0 for s, n in sizes.items()}
    take = lambda d, s, seed: math.floor(rate[s]) + (draw(seed, d) < (rate[s] - math.floor(rate[s])) * 2**32)
    best = {s: min(range(mixing.SEEDS), key=lambda k: (abs(sum(len(plain.words(t)) * take(d, s, k) for d, t, _, x in docs if x == s) - goal[s]), k)) for s in sizes}
    return [take(d, s, best[s]) for d, _, _, s in docs]


def expected(docs):
    """Rows after each of the first four stages, and the tokens of the last."""
    kept = [r for r, ok in zip(docs, plain.kept_by_quality(docs, quality.MARGINS, quality.PRIOR, quality.SPREADS)) if ok]
    yield kept
    cut = [(d, text, lang, source) for (d, _, lang, source), (text, _) in zip(kept, plain.line_dedup([r[:2] for r in kept]))]
    yield cut
    stays = survivors({r[0]: r[1] for r in cut})
    single = [r for r in cut if r[0] in stays]
    yield single
    mixed = [r for r, n in zip(single, copies(single)) for _ in range(n)]
    yield mixed
    yield [(r[0], bpe.plain(r[1])) for r in mixed]


def test_pipeline_stages(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = expected([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in table.collect()])
    docs = table
    from blocklens.session import cut_lineage
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name == corpus_pipeline.STAGES[-1][0]:
            got = Counter((r["doc_id"], r["n_tokens"], hashlib.sha256(bytes(r["ids"])).hexdigest(), r["decoded_sha256"]) for r in docs.collect())
            assert got == Counter((d, *x) for d, x in next(want))
        else:
            assert docs.columns == table.columns, name
            docs = cut_lineage(docs)
            got = Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect())
            assert got == Counter(next(want)), name


def test_pipeline_runs_and_numbers_its_stages(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mix", "tokenise"]
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_pipeline_takes_awkward_rows(spark, docs, nothing, kind, tmp_path):
    now = docs if kind == "awkward" else nothing
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, now, SF).write.parquet(path)
        now = spark.read.parquet(path)
        assert name == "tokenise" or now.columns == docs.columns
    assert (now.count() > 0) == (kind == "awkward")
