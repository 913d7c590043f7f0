from __future__ import annotations

import random
from collections import Counter

from evispark.operators.models import ablation, compare_feature_sets, loo_eval, sample_predictions


def majority(labels):
    counts = Counter(labels)
    return min(counts, key=lambda x: (-counts[x], x)) if counts else ""


def naive(samples, features):
    rows = [s for s in samples if s["y"] not in (None, "", "NA")]
    out = []
    for i, s in enumerate(rows):
        train = rows[:i] + rows[i + 1 :]
        fallback = majority([t["y"] for t in train]) or majority([t["y"] for t in rows])

        def key(r):
            return tuple(r[f] if r[f] not in (None, "", "-", "NA") else "NA" for f in features)

        same = [t["y"] for t in train if key(t) == key(s)]
        out.append((s["i"], s["y"], majority(same) if same else fallback, fallback, len(same)))
    return out


def test_counted_form_equals_the_naive_rule(spark):
    for seed in range(4):
        rng = random.Random(seed)
        n = rng.choice([1, 2, 5, 40])
        samples = [
            {"i": i, "a": rng.choice(["x", "y", "", "-"]), "b": rng.choice(["p", "q", None]), "y": rng.choice(["m", "n", "o", "NA", None])} for i in range(n)
        ]
        df = spark.createDataFrame(samples, "i int, a string, b string, y string")
        for features in (["a"], ["a", "b"]):
            got = sample_predictions(df, "y", {"s": features}, ["i"]).collect()
            assert sorted((r.i, r.true_label, r.predicted_label, r.baseline_label, r.matched_training_count) for r in got) == sorted(naive(samples, features))


def test_status_words(spark):
    def status(labels):
        df = spark.createDataFrame([("k", y) for y in labels], "f string, y string")
        return loo_eval(df, "y", ["f"]).first().status

    assert status([None]) == "no_labeled_samples"
    assert status(["a", "a", "a"]) == "single_class_uninformative"
    assert status(["a", "b"]) == "too_few_samples_interpret_with_caution"
    assert status(["a", "b", "a"]) == "ok"


def test_single_feature_is_compared_with_the_baseline(spark):
    df = spark.createDataFrame([("x", "1"), ("x", "1"), ("y", "2"), ("y", "2"), ("y", "2")], "f string, y string")
    row = ablation(df, "y", {"one": ("f",)}).first()
    assert row.full_accuracy == 1.0 and row.accuracy_without_feature == 0.0  # a tie goes to the smaller label
    assert compare_feature_sets(df, ["y"], {"one": ("f",)}).first().macro_f1 == 1.0
