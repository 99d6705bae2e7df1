import os
import re
import subprocess
import sys
import time

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from foreunc.llm import bpe, common, contamination, lines, neardup, queries, toxicity
from foreunc.session import ensure_checkpoint_dir
from test_contamination import brute as contaminated
from test_lines import plain as line_classes
from test_neardup import brute as near_duplicates

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of each stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("ids", F.lit("clash")).withColumn("at", F.lit(1))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, FOLDER)
        after.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs.columns, docs.collect(), after.columns, after.collect())
        docs = after
    return out


def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    for name in list(stages)[:-1]:
        assert stages[name][0] == stages[name][2]
    assert stages["byte_bpe"][2] == ["doc_id", "ids", "decoded"]


def test_toxic_documents_go(spark, stages):
    _, before, _, after = stages["toxicity"]
    marks = {r.doc_id: r.toxic for r in queries.table(spark, FOLDER, "labels").collect()}
    kept = {r.doc_id for r in after}
    wrong = sum((r.doc_id in kept) == bool(marks[r.doc_id]) for r in before if r.doc_id in marks)
    assert wrong <= 0.05 * len(marks)
    assert set(after) <= set(before)


def test_lines_go(stages):
    _, before, _, after = stages["line_dedup"]
    kept = {(i, n) for i, n, _, _, k in line_classes([(r.doc_id, r.text) for r in before]) if k}
    texts = {r.doc_id: r.text for r in after}
    assert len(after) == len(before)
    for r in before:
        want = [x for n, x in enumerate(r.text.split("\n")) if not x.strip() or (r.doc_id, n) in kept]
        assert texts[r.doc_id] == "\n".join(want)


def test_near_duplicates_go(stages):
    _, before, _, after = stages["near_dedup"]
    want = [i for i, _, _, kept in near_duplicates([(r.doc_id, r.text) for r in before], 5) if kept]
    assert sorted(r.doc_id for r in after) == sorted(want)


def test_contaminated_documents_go(spark, stages):
    _, before, _, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in queries.table(spark, FOLDER, "benchmark").collect()]
    bad = {d for d, *_ in contaminated([(r.doc_id, r.text) for r in before], items)}
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if r.doc_id not in bad)


def test_ids_of_what_is_left(stages):
    _, before, _, after = stages["byte_bpe"]
    path = queries.public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=queries.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        assert r.ids == library.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded).decode() == texts[r.doc_id]


def test_run_applies_all_stages(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == sorted((r.doc_id, r.ids) for r in stages["byte_bpe"][3])


def test_filters_of_odd_rows(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (None, "a b c d e f g", "z"), (3, None, None), (4, "", "w"), (1, "other words are here now", "v")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    got = neardup.without_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(map(repr, got.collect())) == sorted(repr(r) for r in docs.collect() if r.doc_id != 2)
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert {r.doc_id for r in contamination.without_contaminated(docs, items).collect()} == {None, 3, 4}
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(docs.withColumn("lang", F.lit("en")), labels, F.lit(True))
    assert sorted(map(repr, toxicity.filter_toxic(docs, model).collect())) == sorted(map(repr, docs.collect()))


def test_the_rest_works_without_these_folders(tmp_path):
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['foreunc.llm'] = None\n"
        "import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op1_') for k in e.queries())"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=queries.__file__.rsplit("/", 3)[0])


def folders(spark):
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {x for x in os.listdir(root) if re.search(r"-[0-9a-f]{32}$", x)}


def shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = disk.getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_tables_on_the_way_are_deleted(spark):
    """Stages leave no tables but those that their result reads, and it reads them still."""
    texts = [f"{w} line that stands here and is long enough to be found\nalso {w}\nsame in all" for w in "abcdefgh"]
    texts += [texts[0], texts[1].replace("enough", "enuogh"), None, "same in all"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    for stage, left in ((lines.without_repeated_lines, {"dropped"}), (neardup.without_near_duplicates, {"judged", "dropped"})):
        before = folders(spark)
        out = stage(docs)
        made = folders(spark) - before
        assert {x.rpartition("-")[0] for x in made} == left
        assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in out.collect())

    before = folders(spark)
    inner = []

    def make():
        inner.append(common.only(lambda: common.written(spark.range(5), "x").filter("id > 1"), "y"))
        return inner[0].filter("id > 2")

    table = common.only(make, "z")
    assert {x.rpartition("-")[0] for x in folders(spark) - before} == {"z"}
    assert sorted(r.id for r in table.collect()) == [3, 4]
    common.forget(docs, inner[0], table)
    common.forget(table)
    assert folders(spark) == before


def test_a_written_table_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_to, before = spark.conf.get(key, None), shuffle_files(spark)
    table = common.written(spark.range(1000).repartition(3, "id").groupBy("id").count(), "counts")
    assert spark.conf.get(key, None) == set_to
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert table.count() == 1000
