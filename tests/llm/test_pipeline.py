"""Each stage on its input against a plain version of its decision."""

import re
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from knowlattice.llm import pii, toxicity

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [spark.read.parquet(f"{D}/documents.parquet")], None
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], D).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    for df in stages[1:5]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_toxic_go_and_clean_stay(stages):
    before, after = rows(stages[0]), rows(stages[1])
    bad = "disgusting trash loser worthless moron idiot pathetic stupid clown scum".split()
    count = lambda t: sum(w in t.lower() for w in bad)
    assert not [i for i in after if count(before[i].text) >= 3]
    english = [i for i, r in before.items() if r.lang == "en" and count(r.text) == 0]
    assert len([i for i in english if i in after]) >= 0.998 * len(english)
    assert all(after[i] == before[i] for i in after)


def test_one_of_each_group_stays(stages):
    """Links are pairs whose sets of five-word shingles have a Jaccard likeness of 0.8 or more, found here by comparing all pairs."""
    before, after = rows(stages[1]), rows(stages[2])
    sets, held = {}, defaultdict(list)
    for i in sorted(before):
        w = (before[i].text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for g in sets[i] or [None]:
            held[g].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    shared = defaultdict(int)
    for ids in held.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert sorted(after) == sorted({find(i) for i in sets}) and len(after) < len(before)


def test_passages_are_cut(spark, stages):
    before, after = rows(stages[2]), rows(stages[3])
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = set()
    for r in spark.read.parquet(f"{D}/benchmark.parquet").collect():
        w = split(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    lengths = {len(x) for x in windows}

    def holds(text):
        w = split(text)
        return any(tuple(w[i : i + n]) in windows for n in lengths for i in range(len(w) - n + 1))

    held = {i for i, r in before.items() if holds(r.text)}
    assert held
    for i, r in before.items():
        if i not in held:
            assert after[i] == r
        elif i in after:
            assert len(after[i].text) < len(r.text) and after[i].n_chars == len(after[i].text)


def test_personal_data_is_replaced(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    found = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+\w|\b\d{1,3}(?:\.\d{1,3}){3}\b|\+\d \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d{16}(?!\d)|(?<=token = \")\w+")
    names = {}
    for i, r in before.items():
        old, new = found.findall(r.text or ""), found.findall(after[i].text or "")
        assert len(old) == len(new) and not set(old) & set(new)
        assert old or after[i] == r
        for a, b in zip(old, new):
            assert names.setdefault(a, b) == b
    assert len(set(names.values())) == len(names) > 20 and pii.KEY


def test_every_id_is_packed_once(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc = defaultdict(list)
    for p in stages[5].collect():
        by_doc[p.doc_id].append((p.start, p.length))
    for i, r in rows(stages[4]).items():
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at
            at += length
        assert at == len(library.encode(r.text or "", add_special_tokens=False).ids) + 1


def test_nulls_repeats_and_empty(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_TEXTS", 1)
    columns = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    odd = [(None, None, None, None, None, 1), (None, "", "en", "s", 0, 1), (4, "same text here", "en", "s", 14, 1), (4, "same text here", "en", "s", 14, 1), (5, "w " * 30_000, None, "s", 60_000, 1)]
    for k, data in enumerate(([], odd)):
        docs = spark.createDataFrame(data, columns)
        for name, stage in cp.STAGES:
            path = f"{tmp_path}/{k}-{name}"
            stage(spark, docs, D).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() >= (3 if data else 0)


def test_near_duplicates_survive_another_cluster_size(spark, tmp_path):
    """Splits of a scan follow the cores at hand; with other splits at each reading the same documents stay."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    docs.repartition(12, "doc_id").write.parquet(f"{tmp_path}/docs")
    kept = []
    try:
        for first, then in ((4, 4), (4, 2)):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", first)
            found = cp.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), D)
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", then)
            kept.append(sorted(r.doc_id for r in found.select("doc_id").collect()))
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert kept[0] == kept[1] and len(kept[0]) == len(set(kept[0])) > 800


def test_near_duplicates_by_both_kinds_of_links(spark, monkeypatch):
    """SimHash holds 1 and 2 together, shingles 2 and 3: one group."""
    monkeypatch.setattr(cp.simhash, "near_duplicates", lambda docs, key: docs.select("key", F.when(F.col("key.doc_id") == 2, one).otherwise(F.col("key")).alias("component_id")))
    monkeypatch.setattr(cp.shingles, "near_duplicates", lambda docs, key: docs.select("key", F.when(F.col("key.doc_id") == 3, two).otherwise(F.col("key")).alias("component_id")))
    docs = spark.createDataFrame([(i, f"text {i}") for i in (4, 3, 2, 1)], "doc_id long, text string").coalesce(1)
    row = lambda i: F.struct(F.lit(False).alias("none"), F.lit(i).cast("long").alias("doc_id"), F.lit(4 - i).cast("long").alias("_row"))
    one, two = row(1), row(2)
    assert sorted(r.doc_id for r in cp.drop_near_duplicates(spark, docs, D).collect()) == [1, 4]


def test_near_duplicates_of_small_tables_take_few_queries(spark):
    """Each query leaves plans in the driver: groups of few links are not found step by step."""
    sc = spark.sparkContext
    sc.setJobGroup("near", "near")
    try:
        assert cp.drop_near_duplicates(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), D).count() > 50
        jobs = len(sc.statusTracker().getJobIdsForGroup("near"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 150, jobs
