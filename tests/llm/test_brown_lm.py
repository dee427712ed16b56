"""Operator 11 against plain counts, sums of probabilities and exact likelihoods."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import op11_brown_lm as op11

ODD = ["a b c a b", "A b C", "", None, " \t\n", "é É  x", "x" * 5000, "b a " * 4000, "once upon", "a b c a b", "the end <s>", "a b"]
COLUMNS = "doc_id long, text string, held boolean, score string"


def words(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        folded = folded.replace(c, " ")
    return [w for w in folded.split(" ") if w] + [""]


def learnt(spark, rows, rounds=3, parts=3):
    df = spark.createDataFrame([(i, t, h, "clash") for i, t, h in rows], COLUMNS).repartition(parts)
    segments = op11.write_segments(df, "held")
    model = op11.train(segments, rounds)
    return segments, model, op11.score_segments(segments, model).collect()


def class_of(segments, model):
    """Every word's hash with its count and class."""
    found = {}
    for row in segments.toArrow().to_batches():
        for s in op11._segments([row]):
            found.update({int(w): (int(n), int(c)) for w, n, c in zip(s.words, *op11._resolved(s, model.classes, model.folder), strict=True)})
    return found


def hash_of(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(op11.tokens_of(data, np.array([0, len(data)]))[0][0])


def plain_scores(rows, known):
    """Scores by dictionaries, given every word's class."""
    cls = lambda w: known[hash_of(w)][1] if w else op11.ENDS
    counts, uni, bi, tri = Counter(), Counter(), Counter(), Counter()
    for _, text, held in rows:
        if not held:
            one = two = op11.ENDS
            for w in words(text):
                c = cls(w)
                counts[w] += 1
                uni[c] += 1
                bi[one, c] += 1
                tri[two, one, c] += 1
                two, one = one, c
    total, active = sum(uni.values()), {op11.RARE, op11.ENDS, *uni}
    once = sum(n == 1 for w, n in counts.items() if w)

    def backed_off(grams, history, c, low):
        n = sum(v for k, v in grams.items() if k[:-1] == history)
        kinds = max(1, sum(k[:-1] == history for k in grams))
        return (grams[*history, c] + kinds * low) / (n + kinds)

    out = []
    for _, text, _ in rows:
        one = two = op11.ENDS
        score = base = 0.0
        for w in words(text):
            c, n = cls(w), counts[w]
            p = (uni[c] + 1) / (total + len(active))
            p = backed_off(tri, (two, one), c, backed_off(bi, (one,), c, p))
            word = 1.0 if not w else ((n or once + 1) / (2 * once + 1) if c == op11.RARE else n / uni[c])
            score += np.log10(p * word)
            base += np.log10((n + 0.5) / (total + 0.5 * (len(counts) + 1)))
            two, one = one, c
        out.append((len(words(text)), sum(counts[w] > 0 for w in words(text)), total, base, score))
    return out


def test_scores_equal_plain_sums(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "ß"]
    rows = [(k, t, k % 4 == 1) for k, t in enumerate(ODD)] + [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))), k % 5 == 1) for k in range(100, 160)] + [(None, "null id", False), (7, "again", False)]
    segments, model, found = learnt(spark, rows)
    want = Counter((i, bool(h), *x[:3], round(x[3], 6), round(x[4], 6)) for (i, _, h), x in zip(rows, plain_scores(rows, class_of(segments, model)), strict=True))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found) == want


def test_words_outside_the_head_take_the_best_class(spark, monkeypatch):
    monkeypatch.setattr(op11, "HEAD", 40)  # words below a fortieth of all tokens are outside
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["der", "die", "das"]) + " " + rng.choice([f"haus{rng.randint(0, 60)}", "hund"]) for _ in range(20)), k % 5 == 1) for k in range(80)]
    segments, model, found = learnt(spark, rows)
    known = class_of(segments, model)
    assert len(model.classes.words) < 10 < len(known)
    want = [x[4] for x in plain_scores(rows, known)]
    assert np.allclose(sorted(want), sorted(r.score for r in found))
    # Each such word's class has the highest gain to first order.
    counts = op11.word_counts(segments)
    classes, bigrams, _ = op11.cluster(segments, counts, 3)
    smooth = bigrams + 0.5
    right, left = np.log(smooth / smooth.sum(1, keepdims=True)), np.log(smooth / smooth.sum(0, keepdims=True))
    head = {int(w): int(c) for w, c in zip(classes.words, classes.of, strict=True)}
    profile = {}
    for _, text, held in rows:
        if not held:
            seen = [0, *map(hash_of, words(text)[:-1]), 0]
            for a, b in zip(seen, seen[1:], strict=False):
                profile.setdefault(a, Counter())["r", head.get(b, 0)] += 1
                profile.setdefault(b, Counter())["l", head.get(a, 0)] += 1
    checked = 0
    for w, (n, c) in known.items():
        if w and w not in head and n >= 2:
            gain = sum(v * (right[:, x] if side == "r" else left[x]) for (side, x), v in profile[w].items())
            gain = gain[op11.FIRST : op11.FIRST + classes.used]
            assert gain[c - op11.FIRST] >= gain.max() - 1e-3
            checked += 1
    assert checked > 10


def test_gains_are_exact_differences():
    rng = np.random.default_rng(1)
    stream, k = rng.integers(0, 30, 4000), 8
    of = rng.integers(0, k, 30)

    def bigrams(of):
        m = np.zeros((k, k))
        np.add.at(m, (of[stream[:-1]], of[stream[1:]]), 1)
        return m

    for word in range(5):
        own = of[word]
        right = np.bincount(of[stream[1:]][stream[:-1] == word], minlength=k)
        left = np.bincount(of[stream[:-1]][stream[1:] == word], minlength=k)
        itself = int(((stream[:-1] == word) & (stream[1:] == word)).sum())
        gain = op11.gains(bigrams(of), right, left, itself, own)
        before = op11.log_likelihood(bigrams(of))
        for c in range(k):
            moved = of.copy()
            moved[word] = c
            assert gain[c] - gain[own] == pytest.approx(op11.log_likelihood(bigrams(moved)) - before, abs=1e-6)


def test_probabilities_sum_to_one_and_likelihood_rises(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 5 == 1).alias("held"))
    segments = op11.write_segments(docs.repartition(3), "held")
    counts = op11.word_counts(segments)
    _, _, history = op11.cluster(segments, counts, 5)
    assert history == sorted(history) and history[-1] > history[0]
    model = op11.train(segments, 5)
    known = [v for v in class_of(segments, model).values() if v[0]]
    n, of = np.array([v[0] for v in known]), np.array([v[1] for v in known])
    word = 10.0 ** model.emissions(n, of)
    for two, one in ((op11.ENDS, op11.ENDS), (2, 5), (op11.RARE, 9), (63, 63)):
        transition = 10.0 ** model.log_transition[two, one]
        unseen = transition[op11.RARE] * 10.0 ** model.emissions(np.array([0]), np.array([op11.RARE]))[0]
        assert (word * transition[of]).sum() + unseen == pytest.approx(1, abs=1e-9)
    scores = op11.score_segments(segments, model)
    ours, base = ({r.held_out: r.perplexity for r in op11.perplexity(scores, c).collect()} for c in ("score", "base_score"))
    assert ours[True] < base[True] / 2


def test_nothing_to_learn_from(spark):
    assert op11.language_scores(spark.createDataFrame([], COLUMNS), "held").count() == 0
    _, _, found = learnt(spark, [(1, "a b", True), (2, None, True)])
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in found} == {(1, 3, 0, 0), (2, 1, 0, 0)}
    assert all(np.isfinite(r.score) and r.base_score == pytest.approx(0) for r in found)


def test_segments_do_not_pass_through_rows(spark):
    docs = spark.createDataFrame([(k, f"a b c{k % 7} " * 50, k % 5 == 0) for k in range(60)], "doc_id long, text string, held boolean")
    segments = op11.write_segments(docs.repartition(20), "held")
    # Numbers and paths alone are rows of Spark; the arrays are read by the tasks that use them.
    assert segments.columns == ["seg", "path"]
    assert segments.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-segments.count() // op11.TASK_SEGMENTS))
    found = list(op11._segments(segments.toArrow().to_batches()))
    assert sorted(d for s in found for d in s.doc_ids.tolist()) == list(range(60))
    assert {s.seg for s in found} == {r["seg"] for r in segments.collect()}
    assert sum(int(s.counts.sum()) for s in found) == sum(3 * 50 + 1 for k in range(60) if k % 5)
