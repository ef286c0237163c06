"""Cases in which the operators once did less than the whole job."""

import re

import numpy as np

from mapweave.llm import licenses, op8, toxicity

# 1 licenses


def found_in(spark, texts, templates=licenses.TEMPLATES):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.find_licenses(docs, licenses.Templates(spark, templates)).collect()}
    return [got[i] for i in range(len(texts))]


def test_every_license_line_of_the_documents_is_matched(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lower(text) LIKE '%licen%'").select("text")
    texts = [r["text"] for r in docs.collect()]
    lines = [[x for x in t.split("\n") if re.search("licen[sc]", x.lower())] for t in texts]
    names = sorted({x for held in lines for x in held})
    of = dict(zip(names, found_in(spark, names), strict=True))
    assert names and all(len(x) == 1 for x in of.values()), of
    assert of["This work is licensed under the GNU General Public License, version 3."] == ["GPL-3.0"]
    assert found_in(spark, texts) == [sorted({n for x in held for n in of[x]}) for held in lines]


def test_short_notices_part_the_versions(spark):
    gnu = "This work is licensed under the GNU {}General Public License, version {}."
    cases = {
        gnu.format("", "2"): ["GPL-2.0"],
        gnu.format("", "3"): ["GPL-3.0"],
        gnu.format("", "1"): [],
        gnu.format("Lesser ", "2.1"): ["LGPL-2.1"],
        gnu.format("Lesser ", "3"): ["LGPL-3.0"],
        gnu.format("Affero ", "3"): ["AGPL-3.0"],
        "Licensed under the BSD 2-Clause License.": ["BSD-2-Clause"],
        "Licensed under the BSD 3-Clause License.": ["BSD-3-Clause"],
        "Licensed under the Mozilla Public License, Version 2.0.": ["MPL-2.0"],
        "Licensed under the Mozilla Public License, Version 1.1.": [],
        "Released under the ISC License.": ["ISC"],
    }
    assert found_in(spark, list(cases)) == list(cases.values())
    assert found_in(spark, [" ".join(cases)]) == [sorted({n for x in cases.values() for n in x})]


# 8 toxicity


def test_held_out_toxic_texts_are_caught(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    marked = docs.join(labels.where("toxic IN (0, 1)").select("doc_id", "toxic"), "doc_id")
    got = op8.apply(marked.select("doc_id", "text"), labels).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    truth, caught = (np.array([r[k] for r in got]) == 1 for k in ("toxic", "predicted"))
    assert (truth & caught).sum() >= 0.8 * truth.sum()
    assert (truth & caught).sum() >= 0.78 * caught.sum()


def test_training_reads_whole_texts(spark):
    long = "ordinary words " * 3000 + "nastyslur"
    docs = spark.createDataFrame([(1, long), (2, long[:-10]), (3, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert sorted(r["text"] for r in toxicity.training_sample(docs, labels).collect()) == sorted([long, long[:-10], "short"])
