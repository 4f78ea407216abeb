import os

import corpus_pipeline
from helpers_llm import prose

import __spark_entry__ as entry


def write_tables(spark, folder):
    leak = prose(900, 20, 3000)
    personal = f"{prose(3, 60)} reach me at someone@corp.example or 10.1.2.3 {prose(4, 60)}"
    base = prose(1, 400)
    near = base.replace(base.split(" ")[100], "altered", 1)
    rows = [(i, prose(2000 + i, 80), "en", "s", 0) for i in range(100, 160)]
    toxic = [(i, prose(3000 + i, 60) + " grulm vexnor " + prose(4000 + i, 20), "en", "s", 0) for i in range(200, 240)]
    rows += [(1, base, "en", "s", 0), (2, base, "en", "s", 0), (3, near, "en", "s", 0), (4, None, None, None, None), (5, "", "en", "s", 0),
             (6, prose(5, 40) + " " + leak + " " + prose(6, 40), "en", "s", 0), (7, personal, "en", "s", 0), (8, prose(8, 9000), "en", "s", 0)]
    spark.createDataFrame(rows + toxic, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, 0) for r in rows[:60]] + [(r[0], 1, 1) for r in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {r[0] for r in rows}, {r[0] for r in toxic}


def test_stages_take_effect(spark, tmp_path):
    folder = str(tmp_path)
    clean, toxic = write_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, after = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        assert docs.columns == names
        after.append({r.doc_id: r for r in docs.collect()})
    assert set(after[0]) == clean
    assert set(after[1]) == clean - {2, 3, 5}
    assert set(after[2]) == set(after[3]) == clean - {2, 3, 5, 6}
    assert "<EMAIL>" in after[3][7].text and "<IP>" in after[3][7].text and "someone" not in after[3][7].text
    assert after[3][7].n_chars == len(after[3][7].text)
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(after[3])
    stages = [n for n, _ in corpus_pipeline.STAGES]
    assert len(stages) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "corpus_pipeline.py"))
