"""The pipeline's stages against brute force, each on what the stage before kept."""

import random
import zlib

import numpy as np
import pyarrow as pa
import test_decontaminate
import test_near_dedup
import test_substring
from helpers import word

import corpus_pipeline as pipeline
from acadspark.llm import packing, toxicity


def tables(spark, folder):
    rng = random.Random(11)
    passage = [word(rng) for _ in range(60)]
    items = [(i, " ".join(word(rng) for _ in range(rng.choice([8, 20, 40])))) for i in range(10)]
    rows, labels = [], []
    for i in range(260):
        w = [word(rng) for _ in range(rng.choice([5, 60, 150, 400]))]
        toxic = i % 4 == 3
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["moron", "idiot", "scumbag"])
        elif i % 9 == 0:
            w[len(w) // 3:len(w) // 3] = passage
        elif i % 9 == 1:
            w[len(w) // 2:len(w) // 2] = items[i % 10][1].split()
        elif i % 9 == 2 and rows:
            w = rng.choice([t for j, t, *_ in rows if j % 4 != 3]).split()
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, rng.choice([" ", "\n"]).join(w), "en", f"src{i % 3}"))
        labels.append((i, 1, int(toxic)))
    rows += [(500, None, "en", None), (501, "", None, "s"), rows[0], (502, rows[4][1], "en", "s")]
    docs = spark.createDataFrame([(i, t, a, b, None if t is None else len(t)) for i, t, a, b in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items, {i: t for i, _, t in labels}


def slow_score(model, text):
    """The factorization machine by its definition, pair by pair."""
    _, place = toxicity.terms(pa.array([text or ""]), model.bits)
    z = model.bias + sum(model.w[p] for p in place)
    on = [p for p in place if model.v[p].any()]
    z += sum(float(model.v[a] @ model.v[b]) for k, a in enumerate(on) for b in on[:k])
    return 1 / (1 + np.exp(-z))


def test_stages(spark, tmp_dir):
    items, labels = tables(spark, tmp_dir)
    docs = spark.read.parquet(tmp_dir + "/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near-duplicates", "substring-dedup", "decontamination", "packing"]
    kept = {}
    for name, stage in pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = pipeline.save(stage(spark, docs, tmp_dir), "test")
        if name != "packing":
            assert docs.columns == columns
            kept[name] = before, [(r.doc_id, r.text) for r in docs.collect()]

    before, after = kept["toxicity"]
    rows = [(i, labels[i], toxicity.terms(pa.array([t]), 18)[1]) for i, t in before
            if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    model = toxicity.fit(rows)
    assert sorted(map(str, after)) == sorted(str(r) for r in before if slow_score(model, r[1]) < toxicity.THRESHOLD)
    gone = {i for i, _ in before} - {i for i, _ in after}
    assert len(gone) > 40 and all(labels[i] for i in gone)

    before, after = kept["near-duplicates"]
    heads = sorted({i for i, n, c in test_near_dedup.brute(before, 5) if not n or i == c})
    assert sorted(i for i, _ in after) == heads and set(after) <= set(before) and len(after) < len(before)

    before, after = kept["substring-dedup"]
    want = {r[0]: r for r in test_substring.brute(before, 20)}
    assert {i for i, _ in after} == set(want) and any(r[2] for r in want.values())
    for i, t in after:
        split = test_substring.split(t)
        assert len(split) == want[i][1] - want[i][2]
        assert test_substring.hashlib.sha256(" ".join(split).encode()).hexdigest() == want[i][3]
    assert all(t == dict(before)[i] for i, t in after if not want[i][2])

    before, after = kept["decontamination"]
    bad = {i for i, _ in test_decontaminate.brute(before, items)}
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r[0] not in bad) and bad

    packed = docs.collect()
    encode = packing.Encoder()
    assert sum(r.length for r in packed) == sum(len(encode(t or "")) + 1 for _, t in after)
    again = pipeline.run(spark, tmp_dir)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in again.collect()) == sorted(
        (r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_lengths_follow_the_text(spark, tmp_dir):
    tables(spark, tmp_dir)
    docs = spark.read.parquet(tmp_dir + "/documents.parquet")
    left = pipeline.drop_repeated_passages(spark, docs, tmp_dir)
    assert left.where("n_chars <> length(text) or (n_chars is null) <> (text is null)").count() == 0
    assert left.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
