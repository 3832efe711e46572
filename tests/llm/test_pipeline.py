import random

import corpus_pipeline
from motorlake.llm import mixing
from motorlake.session import settle
from tests.llm.conftest import DOCS, edited, words


def test_stages(spark, tmp_path):
    rnd = random.Random(5)
    data = []
    for k in range(400):
        text = words(rnd, rnd.randrange(40, 120), 2000)
        if k % 5 == 1:
            text = " ".join(w for w in text.split(" ")[:15] for _ in range(8))
        data.append([k, text, "en", "abcd"[k % 4], 100, *["z"] * 12])
    clean = [k for k in range(400) if k % 5 != 1]
    item = words(rnd, 40, 2000)
    data[clean[10]][1] += " " + item
    exact = [(400, data[clean[3]][1]), (401, data[clean[3]][1])]
    near = [(402, edited(rnd, data[clean[4]][1] + " " + words(rnd, 150, 2000), 0.01))]
    data[clean[4]][1] = near[0][1].replace("x", "y", 1)
    data += [[k, t, "en", "a", 100, *["z"] * 12] for k, t in [*exact, *near, (403, None), (404, "")]]
    spark.createDataFrame([tuple(d) for d in data], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 5 != 1), 0) for k in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns
        seen.append(({r.doc_id for r in docs.select("doc_id").collect()}, [r.doc_id for r in out.select("doc_id").collect()]))
        if name == "mix":
            copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
            assert sorted(seen[-1][1]) == sorted(k for k, n in copies.items() for _ in range(n))
        docs = out
    lost = [before - set(after) for before, after in seen]
    poor = {k for k in range(400) if k % 5 == 1}
    assert poor <= lost[0] | set() and len(lost[0] - poor) <= 4
    assert {clean[3], 400} <= lost[1] and 401 not in lost[1]
    assert len(lost[2] & {402, clean[4]}) == 1
    assert lost[3] == {clean[10]} & seen[3][0]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()) == sorted(seen[-1][1])
