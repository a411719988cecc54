import os
import random
import zlib

import duckdb
import pytest

import corpus_pipeline
from newsloom.llm import classifier, neardup, queries
from newsloom.llm._shared import run_dir, written
from newsloom.llm._text import TextBlock
from test_operators import brute_repeats, components_by_force, ids_of, words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.select(", ".join(columns)).fetchall()))


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def rejected_by_hand(t):
    """The quality rules, written out."""
    w = words(t)
    n, chars = len(w), sum(map(len, w))
    lines = [x for x in (t or "").split("\n") if words(x)]
    grams = [tuple(w[i : i + 8]) for i in range(n - 7)]
    many = {g: grams.count(g) for g in set(grams)}
    repeat = len({i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(8)})
    count = lambda keep: sum(keep(c) for c in t or "")
    return (
        n < 20
        or 100 * repeat > 30 * n
        or 100 * count(lambda c: c in "#*$%&|<>") > 5 * chars
        or 100 * count(lambda c: c in "!?") > 5 * chars
        or 100 * count(lambda c: "A" <= c <= "Z") > 50 * chars
        or 100 * sum(a == b for a, b in zip(w, w[1:], strict=False)) > 25 * n
        or 100 * (len(lines) - len(set(lines))) > 40 * len(lines)
        or 100 * max(map(w.count, set(w))) > 30 * n
        or chars > 20 * n
    )


def test_stages_by_brute_force(spark, tmp_path):
    """Each stage's rows on a fixture with nulls, copies, junk, passages and odd columns."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(700)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = say(60), say(200)
    texts = [say(rng.randint(25, 300)) for _ in range(60)] + [say(30) + " " + passage + " " + say(30) for _ in range(4)]
    texts += [base, base, " ".join(base.split()[:-6] + ["q"] * 2), None, "", "few words", "same line\n" * 20, say(40).upper() + " !!! $$$ ###" * 9, "*** ".join(say(60).split())]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, say(50), None, None), (3, texts[3], "x", 3)]
    schema = "doc_id long, text string, features string, Kept long"
    folder = str(tmp_path)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    marks = [(i, int(not rejected_by_hand(t) and i % 9 != 4)) for i, t in enumerate(texts)]
    spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(written(stage(spark, frames[-1], folder), run_dir(spark, "test")))
    got = [[tuple(r) for r in f.collect()] for f in frames]
    key = repr
    assert all(f.columns == docs.columns for f in frames[:-1])
    # 1: rules
    assert sorted(got[1], key=key) == sorted((r for r in got[0] if not rejected_by_hand(r[1])), key=key)
    # 2: a discriminant fitted here on the same training rows
    y = dict(marks)
    x = {t: v for t, v in zip(*(lambda ts: (ts, classifier.features(TextBlock(__import__("pyarrow").array(ts)))))([r[1] for r in got[1]]), strict=True)}
    taught = [(x[t], y[i]) for i, t, *_ in got[1] if i is not None and zlib.crc32(str(i).encode()) % 5 and i in y]
    sums = {c: (float(len(v)), sum(v), sum(a[:, None] * a for a in v)) for c in (0, 1) if (v := [a for a, b in taught if b == c])}
    model = classifier.Model.fit(sums)
    assert sorted(got[2], key=key) == sorted((r for r in got[1] if model.score(x[r[1]][None])[0] >= 0.3), key=key)
    # 3: one document of each component, that of the smallest id
    keep = components_by_force([(i if i is not None else 10**9, t) for i, t, *_ in got[2]], 80)
    first = {c for _, _, c, _ in keep}
    assert sorted(str(r[0]) for r in got[3]) == sorted("None" if c == 10**9 else str(c) for c in first) and set(got[3]) <= set(got[2])
    # 4: repeated windows of 35 words go
    lists, gone = brute_repeats([(i, t) for i, t, *_ in got[3]], 35)
    want = [(r[0], " ".join(w for j, w in enumerate(ws) if j not in g) if g else r[1], *r[2:]) for r, ws, g in zip(got[3], lists, gone, strict=True)]
    assert sorted(got[4], key=key) == sorted(want, key=key) and any(gone)
    # 5: every id of every text in one piece
    pieces = [r for r in frames[5].collect() if r["doc_id"] is not None]
    ids = ids_of([(i, t) for i, t, *_ in got[4] if i is not None])
    assert sum(r["length"] for r in pieces) == sum(map(len, ids.values()))
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)
    lazily = corpus_pipeline.STAGES[4][1](spark, corpus_pipeline.STAGES[3][1](spark, corpus_pipeline.STAGES[2][1](spark, frames[2], folder), folder), folder)
    assert lazily.count() == frames[5].count()  # composed without writing: no input is deleted
    # a table without rows
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, folder), run_dir(spark, "test"))
        assert empty.count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, kept = docs.columns, [docs.count()]
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = written(stage(spark, frame, SF), run_dir(spark, "test"))
        assert frame.columns == columns
        kept.append(frame.count())
    assert kept[0] > kept[1] >= kept[2] >= kept[3] == kept[4] > 0
    assert neardup.keep_one(frame, percent=80).count() <= kept[4]
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.select("doc_id").distinct().count() == kept[4]
    clean = [r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").join(docs, "doc_id").where("length(text) > 400").select("doc_id").collect()]
    by_rules = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).select("doc_id").collect()}
    assert len(set(clean) - by_rules) <= 0.02 * len(clean)
