"""The pipeline's stages against plain versions, and the registered queries."""

from collections import Counter

import corpus_pipeline
import pyarrow.parquet as pq
import pytest
from floodspark.llm import decontam, quality, secrets, simhash
from floodspark.llm.queries import QUERIES, SQL
from floodspark.session import cut
from llm_rows import awkward, table
from test_overlap import alike, plain_set
from test_pairs import near_copies, plain_fingerprint, roots
from test_quality import plain

DATA = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_covers_its_table(spark, name):
    out = QUERIES[name](spark, DATA)
    rows = out.count()
    source = "pages" if name.startswith("op3") else "documents"
    n = pq.read_table(f"{DATA}/{source}.parquet").num_rows
    if name.startswith("op6"):
        assert rows > 0
    elif name.startswith("op4"):
        assert out.select("doc_id").distinct().count() == n
    else:
        assert rows == n


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [r for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, DATA), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if name == "quality_rules":
            good = {r["doc_id"] for r in quality.ledger(docs).where(quality.passes()).collect()}
            want = [r for r in kept if r["doc_id"] in good]
            assert all(plain(r["text"])[0] >= 20 for r in want)
        elif name == "near_dedup":
            fps = [plain_fingerprint(r["text"]) for r in kept]
            sets = [plain_set(r["text"]) for r in kept]
            near = [(i, j) for i in range(len(kept)) for j in range(i)
                    if (fps[i] ^ fps[j]).bit_count() <= 3 or alike(sets[i], sets[j])]
            root = roots(len(kept), near)
            least = {}
            for r, g in zip(kept, root):
                least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
            want = [r for r, g in zip(kept, root) if least[g] == r["doc_id"]]
        elif name == "decontamination":
            bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
            bad = {r["doc_id"] for r in decontam.contaminated(docs, bench).collect()}
            assert bad
            want = [r for r in kept if r["doc_id"] not in bad]
        else:
            want = secrets.redact(docs).collect()
            assert [r["doc_id"] for r in want] and len(want) == len(kept)
        got = out.collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, want)), name
        docs, kept = out, got
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == len(kept)
    assert corpus_pipeline.run(spark, DATA).count() == packed.count()


def test_stages_take_awkward_and_empty_tables(spark):
    for rows in (awkward() + near_copies(), []):
        docs = table(spark, rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = cut(stage(spark, docs, DATA), name)
        corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count()
