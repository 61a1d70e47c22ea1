"""Operators 5 and 7: what they learn from, and their fits against plain ones."""

import math
import pickle
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scansmith.llm import labelled, quality, toxicity

GOOD, BAD = "the quiet river runs past old stone houses", "buy NOW!!! cheap $$$ click click click"


def corpus(spark, n=120):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices((GOOD if i % 3 else BAD).split(), k=rng.randint(5, 40)))) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(5, None, "x"), (None, GOOD, "x")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, int(bool(i % 3)), int(not i % 3)) for i, _ in rows], "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_labels_have_no_part(spark, module, label):
    docs, labels = corpus(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))
    assert labels.where(held).count() > 10
    assert module.train(docs, labels) == module.train(docs, turned) == module.train(docs, labels.where(~held))
    assert zlib.crc32(b"7") % 5 == spark.range(7, 8).select(labelled.fold(F.col("id")).alias("f")).first()["f"]


@pytest.mark.parametrize("module, score", [(quality, quality.score_quality), (toxicity, toxicity.score_toxicity)])
def test_no_documents_and_no_labels(spark, module, score):
    docs, labels = corpus(spark, 12)
    model = module.train(docs.limit(0), labels)
    assert score(docs.limit(0), model).count() == 0 and score(docs, model).count() == docs.count()
    out = score(docs, module.train(docs, labels.limit(0)), "quality").collect()  # a column of the score's name is replaced
    assert len({r["quality"] for r in out}) == 1


def test_hinge_loss_by_plain_dual_steps():
    """The fit's margins are those of a plain dual coordinate descent over dictionaries, in the same order of rows."""
    rng = random.Random(1)
    texts = [" ".join(rng.choices((GOOD if i % 2 else BAD).split(), k=9)) for i in range(40)]
    labels, rows = np.array([i % 2 for i in range(40)]), [quality.ngrams(t) for t in texts]
    weights, norm, intercept, a, b = pickle.loads(quality.fit(labels, rows, []))
    order = np.random.default_rng(5)
    late = order.random(len(rows)) < 0.2
    train = [i for i in range(40) if not late[i]]
    count = [{}, {}]
    for i in train:
        for f in rows[i].tolist():
            count[labels[i]][f] = count[labels[i]].get(f, 0) + 1
    size = [sum(labels[i] == y for i in train) for y in (0, 1)]
    ratio = {}
    for f in {*count[0], *count[1]}:
        n = [count[y].get(f, 0) for y in (0, 1)]
        ratio[f] = math.log((n[1] + 1) / (size[1] + 1)) - math.log((n[0] + 1) / (size[0] + 1)) if sum(n) > 1 else 0.0
    vector = [{f: ratio.get(f, 0.0) for f in r.tolist()} for r in rows]
    length = [max(1e-9, math.sqrt(sum(x * x for x in v.values()))) for v in vector]
    own, base, alpha = {}, 0.0, [0.0] * 40
    for _ in range(quality.PASSES):
        most = 0.0
        for i in order.permutation(np.array(train)).tolist():
            x, y = {f: v / length[i] for f, v in vector[i].items()}, 1 if labels[i] else -1
            margin = y * (sum(own.get(f, 0.0) * v for f, v in x.items()) + base)
            new = min(max(alpha[i] - (margin - 1) / (sum(v * v for v in x.values()) + 1), 0.0), quality.COST)
            step = (new - alpha[i]) * y
            for f, v in x.items():
                own[f] = own.get(f, 0.0) + step * v
            base, alpha[i], most = base + step, new, max(most, abs(step))
        if most < 1e-3:
            break
    score = quality.scorer(quality.fit(labels, rows, []))
    for i, t in enumerate(texts):
        margin = sum(own.get(f, 0.0) * v for f, v in vector[i].items()) / length[i] + base
        assert score([t])[0] == pytest.approx(1 / (1 + math.exp(-(a * margin + b))), abs=1e-5)


def test_a_bag_of_subwords():
    """The fit tells the classes apart, and `choice` orders settings by the loss of rows that fits did not see."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices((GOOD if i % 3 else BAD).split(), k=12)) for i in range(60)]
    labels = np.array([int(not i % 3) for i in range(60)])
    rows, counts = zip(*(toxicity.counted(t) for t in texts), strict=True)
    values = [toxicity._damped(c, toxicity.SETTING.rate) for c in counts]
    known, clean = toxicity._fitted(labels, list(rows), values, 0, toxicity.SETTING)
    margins = [toxicity._margin(known, clean, toxicity.SETTING.prior, r, v) for r, v in zip(rows, values, strict=True)]
    assert min(m for m, y in zip(margins, labels, strict=True) if y) > max(m for m, y in zip(margins, labels, strict=True) if not y)
    table = toxicity.choice(labels, list(rows), list(counts), (40, 20), toxicity.CHOICES[:2])
    assert [s for _, s in table] == [s for _, s in sorted(table)] and table[0][0] < 0.7
