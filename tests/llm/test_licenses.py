import re

import duckdb
import pytest
from cases import HOSTILE, hostile

from auctionflow.llm import licenses as L


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places(w, phrase):
    p = phrase.split()
    return [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]


def texts(w, index):
    """Labels of licence texts, by looking at every stretch of a document."""
    found = set()
    for (label, text, keys), own in zip(L.TEXTS, index.anchors):
        if len({a for a, _ in own} & set(w)) < L.needed(own):
            continue
        for stretch in range(-8, len(w) // L.STRETCH + 2):
            agree = sum(any(x == a and (i - at) // L.STRETCH in (stretch, stretch - 1) for i, x in enumerate(w)) for a, at in own)
            first = max(0, (stretch - 1) * L.STRETCH)
            part = w[first : first + len(L.text_words(text)) + 3 * L.STRETCH]
            if agree >= L.needed(own) and all(places(part, key) for key in keys):
                found.add(label)
    return found


def check(df, docs):
    index = L.build_index(df)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in L.scan(df).collect())
    want = []
    for d, t in docs:
        w = words(t)
        base = [(label, i) for label, p in L.BASE for i in places(w, p)]
        more = {label for label, p in L.BASE + L.MORE if places(w, p)} | texts(w, index)
        starts = [i for _, i in base]
        want.append((d is not None, d or 0, len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in base})), ",".join(sorted(more))))
    key = lambda x: [(v is not None, v if v is not None else 0) if not isinstance(v, str) else v for v in x]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_planted(spark):
    docs = [
        (1, "Under the MIT License, under the mit-license! the mit license"),
        (2, "cc by nc by nc cc cc by nc"),
        (3, "Apache License, Version 2.0 and apache license version 20"),
        (4, "license mit the under"),
        (5, "GNU GENERAL PUBLIC LICENSE; GNU Lesser General Public License"),
        (6, "under the K mit license"),
        (7, "boost software license version 1 0 boost software license version 1"),
    ]
    check(spark.createDataFrame(docs, "doc_id bigint, text string"), docs)
    check(hostile(spark), HOSTILE)
    assert L.scan(hostile(spark, [])).collect() == []


def test_texts(spark):
    mit, gnu = (next(t for label, t, _ in L.TEXTS if label == x) for x in ("mit", "gpl"))
    w = mit.split()
    docs = [(1, mit), (2, "Some code.\n" * 300 + mit), (3, " ".join(w[:30] + ["(added", "by", "us)"] + w[30:50] + w[52:])), (4, " ".join(w[::-1]))]
    docs += [(5, mit.replace("without restriction", "with restrictions")), (6, gnu), (7, gnu.replace("General", "Lesser General")), (8, " ".join(w[:20])), (9, None), (10, (mit + " ") * 5)]
    docs += [(11, "// SPDX-License-Identifier: MPL-2.0"), (12, " ".join(w[40:] + w[:40])), (13, next(t for label, t, _ in L.TEXTS if label == "mpl-2"))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    check(df.where("doc_id <> 10"), [d for d in docs if d[0] != 10])
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in L.scan(df).collect()}
    assert [got[k][0] for k in (1, 2, 3, 10)] == ["mit"] * 4 and got[1][1] == got[2][1] == 1.0
    assert got[4] == ("", 0.0) and got[6][0] == "gpl" and got[7][0] == "lgpl" and got[11][0] == got[13][0] == "mpl-2"
    assert len(L.vocabulary(L.STANDARD)) < 400


@pytest.mark.parametrize("what", ["corpus", "texts"])
def test_sql(spark, sf_dir, tmp_path, what):
    path = f"{sf_dir}/documents.parquet"
    if what == "texts":
        rows = [(i, f"Header. {t} {'x ' * i} {'Free software. ' * (i % 3)}") for i, (_, t, _) in enumerate(L.TEXTS)] + [(99, None), (100, "")]
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(path := f"{tmp_path}/d")
        path += "/*.parquet"
    got = L.scan(spark.read.parquet(path.removesuffix("/*.parquet")))
    want = duckdb.sql(f"SELECT {', '.join(got.columns)} FROM ({L.oracle_sql().replace('FROM documents)', f"FROM '{path}')")})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    if what == "texts":
        assert all(label in r["labels"].split(",") for r, (label, _, _) in zip(got.where("doc_id < 99").orderBy("doc_id").collect(), L.TEXTS))


def test_corpus(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(df, [(r["doc_id"], r["text"]) for r in df.collect()])


def test_templates_of_a_user(spark):
    """Phrases and a text from a table, in place of the module's; none at all."""
    text = "You may keep this granary book for as long as its pages hold, lend it to any neighbour, and burn it in no winter but the last; the miller disclaims whatever flour comes of it."
    table = spark.createDataFrame([("granary", text, ["granary book", "the miller disclaims"]), ("spdx", "SPDX: Granary-1", []), ("other", "the SECOND phrase", None), ("none", None, None)], "label string, text string, phrases array<string>")
    templates = L.Templates.of(table)
    changed = text.replace("neighbour", "friend").replace("winter", "summer")
    docs = spark.createDataFrame([(1, f"Front matter. {changed} End."), (2, "spdx granary 1; mit license"), (3, "under the MIT license, the second phrase"), (4, text.replace("granary book", "ledger")), (5, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["labels"], r["n_base"], r["base_labels"]) for r in L.scan(docs, templates=templates).collect()}
    assert got == {1: ("granary", 0, ""), 2: ("spdx", 0, ""), 3: ("other", 0, ""), 4: ("", 0, ""), 5: ("", 0, "")}
    assert {r["labels"] for r in L.scan(docs, templates=L.Templates([], [], [])).collect()} == {""}
    assert {r["doc_id"]: r["n_base"] for r in L.scan(docs, templates=L.Templates(L.BASE, [], [])).collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}
