"""Each stage of the pipeline against brute force, on rows with nulls, empty texts, repeats and clashing columns."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tremorlake.llm import knn_quality
from tremorlake.llm.common import materialised, table

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))


@pytest.fixture(scope="module")
def docs(spark):
    base = table(spark, SF, "documents")
    text = base.orderBy("doc_id").first()["text"]
    rows = [(None, None, None, None, 0), (10**6, "", "en", "src0", 0), (10**6 + 1, " \n\t", "en", None, 3), (None, text, "en", "src0", 5), (None, text, "en", "src0", 5), (10**6 + 2, LONG, "en", "src1", 1), (10**6 + 2, LONG + " and another end", "en", "src1", 1)]
    rows += [(10**6 + 10 + k, "One line of many documents on this host\n" + LONG[900 * k : 900 * k + 700], "en", "one", 1) for k in range(30)]
    odd = spark.createDataFrame(rows, base.schema)
    names = ("row", "doc", "score", "predicted", "removed", "m", "h1", "rep")
    return base.unionByName(odd).withColumns({n: F.lit(n) for n in names})


def rows_of(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_stages_in_a_row(spark, docs):
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = materialised(stage(spark, docs, SF), name)
        ids, known = ({r["doc_id"] for r in f.select("doc_id").collect()} for f in (docs, before))
        assert ids <= known and ids
        if k < 3:
            assert docs.columns == before.columns and docs.count() < before.count()
        else:
            assert ids == known


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_of_an_empty_table(spark, docs, name):
    out = STAGES[name](spark, docs.where("FALSE"), SF)
    assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", line.lower())).strip(" ")


def test_quality_rule_stage(spark, docs):
    holders: dict = {}
    rows = docs.collect()
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if normal(line):
                holders.setdefault((r["source"], normal(line)), set()).add(r["text"])
    frequent = {k for k, v in holders.items() if len(v) > 25}
    want = Counter()
    for r in rows:
        w = words(r["text"])
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeat = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = (r["text"] or "").split("\n")
        left = [x for x in lines if (r["source"], normal(x)) not in frequent]
        gone = sum(len(words(x)) for x in lines) - sum(len(words(x)) for x in left)
        if len(w) >= 50 and 100 * len(repeat) <= 50 * len(w) and not len(w) - gone < 0.3 * len(w):
            text = "\n".join(left)
            want[tuple((r.asDict() | {"text": text, "n_chars": len(text)}).values())] += 1
    got = rows_of(STAGES["quality_rules"](spark, docs, SF).withColumn("n_chars", F.length("text").cast("long")))
    assert ("one", "one line of many documents on this host") in frequent
    assert got == want


def test_quality_classifier_stage(spark, docs):
    scored = knn_quality.classify(docs, table(spark, SF, "labels")).collect()
    good = Counter(r["doc_id"] for r in scored if r["predicted"])
    kept = STAGES["quality_classifier"](spark, docs, SF)
    assert Counter(r["doc_id"] for r in kept.collect()) == good and sum(good.values()) < len(scored)


def test_near_duplicate_stage(spark, docs):
    rows = docs.collect()

    def grams(text):
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        return frozenset(tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)) if w else frozenset()

    sets = [grams(r["text"]) for r in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                group[find(i)] = find(j)
    best: dict = {}
    for i, r in enumerate(rows):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        best[find(i)] = min(best.get(find(i), key), key)
    want = Counter(k[1] if not k[0] else None for k in best.values())
    got = Counter(r["doc_id"] for r in STAGES["near_duplicates"](spark, docs, SF).collect())
    assert got == want and sum(want.values()) < len(rows)


def test_packing_stage(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((r["doc_id"], k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048)))
    rows = STAGES["best_fit_packing"](spark, docs, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
