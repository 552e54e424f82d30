"""The pipeline's stages one by one against brute force, and the registered queries."""

import os

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from cubewright.llm import decontaminate, mixing, toxicity  # noqa: E402
from cubewright.llm.common import stored, table  # noqa: E402
from cubewright.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

from .test_dedup import brute_components, brute_fingerprint, brute_overlaps, sha  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    labels, items = table(spark, SF, "labels"), [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stored(stage(spark, docs, SF), "stage")
        kept = [r["doc_id"] for r in out.collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= set(rows)
        if name == "toxicity":
            model = toxicity.train(docs, labels)
            want = {i for i, s in zip(rows, model.scores(list(rows.values()), {})) if s < toxicity.THRESHOLD}
        elif name == "exact dedup":
            best = {}
            for i, t in rows.items():
                best[sha(t)] = max(i, best.get(sha(t), i))
            want = set(best.values())
        elif name == "simhash near-dedup":
            want = set(brute_components([(i, brute_fingerprint(t)) for i, t in rows.items()]))
        elif name == "benchmark decontamination":
            want = set(rows) - {d for d, _ in brute_overlaps(rows.items(), items)}
        else:
            want = {r["doc_id"] for r in mixing.probabilities(docs).where("sampled").collect()}
        assert set(kept) == want, name
        assert out.columns[: len(columns)] == columns
        assert name == "mixing sources" or out.columns == columns
        docs = out
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(kept)


def test_decontamination_finds_planted_passages(spark):
    """Whole benchmark passages stand in some documents."""
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    texts = {r["doc_id"]: " ".join(r["text"].split()) for r in docs.collect()}
    planted = {(d, r["item_id"]) for r in items.collect() for d, t in texts.items() if " ".join(r["text"].split()) in t}
    assert planted <= {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, items).collect()}


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    want = c.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
