"""Quality, toxicity and licences: held-out accuracy, parts, odd rows."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import licences, quality, toxicity
from larkspur.llm._common import crc_mod

EVEN = lambda c: F.col(c) % 2 == 0


def prose(rng, n=120):
    return ". ".join(" ".join(rng.choice(["the", "of", "and", "cat", "river", "stone", "walk", "light", "under", "green"]) + rng.choice(["", "ing", "er", "s"]) for _ in range(rng.randint(4, 12))).capitalize() for _ in range(n // 8)) + "."


def test_quality_learns_without_negatives(documents, spark, odd):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 7 in (0, 1)
        t = " ".join(rng.choice(["BUY!!", "%%%", "$$$", "|", "spam"]) for _ in range(100)) if bad else prose(rng)
        rows.append((i, t, "s"))
        if not bad and i % 3:
            labels.append((i, 1))
    labels += [(None, 1), (7, None), (9999, 0)]
    d = documents(rows).select("doc_id", "text")
    model = quality.train(d, spark.createDataFrame(labels, "doc_id long, label int"), EVEN)
    assert 0.5 < model.prior < 0.95
    out = {r.doc_id: r for r in quality.score(d, model).collect()}
    assert np.mean([out[i].predicted == int(i % 7 not in (0, 1)) for i in range(1, 400, 2)]) > 0.97
    odd_out = quality.score(documents(odd).withColumn("text_", F.lit(1)), model).collect()
    assert len(odd_out) == len(odd) and all(0 <= r.score <= 1 for r in odd_out)
    none = quality.train(d, spark.createDataFrame([], "doc_id long, label int"), EVEN)
    assert {r.score for r in quality.score(d.limit(3), none).collect()} == {0.5}
    assert quality.score(documents([]), model).count() == 0


def test_nnpu_on_moments():
    rng = np.random.default_rng(0)
    p, u = rng.normal(1, 1, (2000, 3)), np.vstack([rng.normal(1, 1, (1400, 3)), rng.normal(-2, 1, (600, 3))])
    mp, mu = (quality.moments(x) / len(x) for x in (p, u))
    w = rng.normal(0, 0.3, 4)
    gp, gu = (np.hstack([x, np.ones((len(x), 1))]) @ w for x in (p, u))
    positive, negative, d_positive, d_negative = quality.nnpu_risk(w, mp, mu, 0.7)
    assert np.isclose(positive, 0.7 * ((gp - 1) ** 2).mean()) and np.isclose(negative, ((gu + 1) ** 2).mean() - 0.7 * ((gp + 1) ** 2).mean())
    for k in range(4):  # finite differences
        e = np.eye(4)[k] * 1e-5
        more, less = quality.nnpu_risk(w + e, mp, mu, 0.7), quality.nnpu_risk(w - e, mp, mu, 0.7)
        assert np.isclose((more[0] - less[0]) / 2e-5, d_positive[k], atol=1e-5) and np.isclose((more[1] - less[1]) / 2e-5, d_negative[k], atol=1e-5)
    for prior in (0.5, 0.7, 0.9):
        w, risk = quality.fit_nnpu(mp, mu, prior)
        assert risk >= 0
        part = quality.nnpu_risk(w, mp, mu, prior)
        assert np.isclose(risk, part[0] + max(0, part[1]))
    w, _ = quality.fit_nnpu(mp, mu, 0.7)
    g = np.hstack([u, np.ones((2000, 1))]) @ w
    assert (g[:1400] > 0).mean() > 0.9 and (g[1400:] < 0).mean() > 0.9


def test_prior_is_bounded_by_the_mixture():
    rng = np.random.default_rng(1)
    z = lambda m, n: np.bincount(quality.bins_of(rng.normal(m, 1, n)), minlength=quality.BINS)
    assert 0.68 < quality.prior_bound(z(1, 20000), z(1, 14000) + z(-3, 6000)) < 0.74
    assert quality.prior_bound(z(1, 0), z(1, 10)) == 1


def test_quality_moments_cover_every_row(documents, spark):
    rows = [(i, prose(random.Random(i), 20), "s") for i in range(50)] + [(None, "no id", "s"), (3, None, "s")]
    d = documents(rows)
    feats = quality._featured(d.select("text", (F.col("doc_id") < 10).alias("good"), (F.coalesce("doc_id", F.lit(0)) % 2).cast("int").alias("fold")).fillna(False))
    sums = quality.sum_moments(feats.repartition(5))
    x = quality.quantised([t or "" for _, t, _ in rows]) / quality.UNIT
    assert np.allclose(sums[0, 0] + sums[1, 0], quality.moments(x)) and sums[0, 1][-1, -1] + sums[1, 1][-1, -1] == 11


def test_results_give_way_to_columns_of_the_same_name(documents, spark):
    d = documents([(i, prose(random.Random(i)), "s") for i in range(30)]).withColumn("score", F.lit("mine")).withColumn("predicted", F.lit(-1)).withColumn("x", F.array(F.lit(1)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, label int")
    model = quality.train(d, labels, lambda c: F.lit(True))
    out = quality.score(d, model)
    assert out.columns == [*d.columns, "score_", "predicted_"] and {(r.score, r.predicted) for r in out.collect()} == {("mine", -1)}
    assert quality.keep(d, model).columns == d.columns and quality.keep(d, model).count() == out.where("predicted_ = 1").count()
    lm = toxicity.language_model(toxicity.gram_counts(d))
    tox = toxicity.score(d, toxicity.train(d, labels, lambda c: F.lit(True), lm))
    assert tox.columns == [*d.columns, "score_", "predicted_"] and tox.count() == 30


def brute_force(span, lm):
    """All (score, text) of the lattice of a span, by enumeration."""
    T, raw, gaps, gap = toxicity, [], [], ""
    for c in span:
        if c in T.SEPARATORS:
            gap += c
        else:
            raw.append(c)
            gaps.append(gap)
            gap = ""
    mixed = any(len(g) == 1 for g in gaps[1:])
    runs = [len(list(g)) for _, g in itertools.groupby(raw) for g in [list(g)] for _ in g]
    out = []

    def code(text, k):
        return [0 if c == " " else T._PLAIN.get(c, 0) for c in "   " + text][-k:]

    def walk(i, score, history, text, run):
        past = tuple(history[-3:])
        if i == len(raw):
            out.append((score + float(lm[past][0]), text))
            return
        ways = [(score, history, text, run)]
        if i and gaps[i]:
            wide = mixed and gaps[i].isspace() and len(gaps[i]) > 1
            ways = [(score - (T.COST_JOIN if wide else 0), history, text, run)]
            if history[-1]:
                ways.append((score - (0 if wide else T.COST_PART) + float(lm[past][0]), [*history, 0], text + " ", 1))
        c = raw[i]
        options = [(T._PLAIN[c], c, 0)] if c in T._PLAIN else []
        options += [(ord(x) - 96, x, T.COST_LOOKALIKE) for x in T.LOOKALIKES.get(c, "")]
        for s, h, t, r in ways:
            for k, char, cost in options or [(0, c, 0)]:
                again = k and k == h[-1]
                walk(i + 1, s - cost + float(lm[tuple(h[-3:])][k]) - (T.COST_LONG if again and r >= 2 else 0), [*h, k], t + char, min(r + 1, 3) if again else 1)
                if again:
                    walk(i + 1, s - cost - (T.COST_DROP if runs[i] > 2 else T.COST_PAIR), h, t, r)

    walk(0, 0.0, [0, 0, 0], "", 0)
    return out


def test_viterbi_against_enumeration(documents):
    d = small_decoder(documents)
    rng = random.Random(9)
    spans = ["1d10t", "i d i o t", "y0u  a r e", "***", "m*r*n", "ii1!|", "g.o a.w", "tt77tt"]
    spans += ["".join(rng.choice("idot1!0*|a  .e7m") for _ in range(rng.randint(2, 8))).strip(" .") for _ in range(150)]
    for span in filter(None, spans):
        every = brute_force(span, d.lm)
        best = max(s for s, _ in every)
        assert d.decode(span) in {t for s, t in every if s > best - 1e-3}, span


def test_dividers_stand_for_themselves(documents):
    d = small_decoder(documents)
    assert d.decode("a" + "*" * 5000 + "a") == "a" + "*" * 5000 + "a"


def test_viterbi_restores(documents):
    rng = random.Random(6)
    text = " ".join(rng.choice(["idiot", "moron", "loser", "stupid", "worthless", "green", "letter", "river"]) for _ in range(5000))
    lm = toxicity.language_model(toxicity.gram_counts(documents([(1, text, "s"), (2, None, "s")])))
    assert np.allclose(np.exp(lm).sum(-1), 1, atol=1e-3)
    d = toxicity.Decoder(lm)
    for raw, word in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("m.o.r.o.n", "moron"), ("l0s3r", "loser"), ("stuuuupid", "stupid"), ("$tup1d", "stupid"), ("w0rthle55", "worthless"), ("letter", "letter"), ("l-e-t-t-e-r", "letter")):
        assert d.decode(raw) == word, raw
    assert "idiot" in d.restore("You 1 d 1 o t") or "idiot" in d.restore("you i d i o t now")
    assert len(d.decode("a1" * 500)) > 0


def small_decoder(documents):
    rng = random.Random(6)
    text = " ".join(rng.choice(["idiot", "moron", "you", "are", "an", "go", "away", "green", "letter", "river"]) for _ in range(5000))
    return toxicity.Decoder(toxicity.language_model(toxicity.gram_counts(documents([(1, text, "s")]))))


def test_words_spaced_out_are_parted(documents):
    d = small_decoder(documents)
    for raw in ("y o u i d i o t g o a w a y", "y o u  i d i o t  g o  a w a y", "y 0 u 1 d 1 o t g o a w a y"):
        assert {"you", "idiot", "go", "away"} <= d.restore(raw), raw
    assert toxicity.readings("an.idiot.you", d)[1:] == ["an", "idiot", "you"]
    assert toxicity.readings("an-1d10t-you", d)[1:] == ["an", "idiot", "you"]


def test_long_tokens_are_decoded(documents):
    d = small_decoder(documents)
    assert toxicity.readings("id" + "i" * 400 + "ot", d)[1:] == ["idiot"]
    assert set(toxicity.readings(".".join(["y.o.u.i.d.i.o.t.g.o.a.w.a.y"] * 20), d)[1:]) == {"you", "idiot", "go", "away"}
    assert len(d.decode("a1" * 20000)) > 0


def test_toxicity_keeps_its_sample_and_feature_space():
    assert (toxicity.SAMPLE, toxicity.SPACE_OF_FEATURES) == (12000, 1 << 22)


def test_toxicity(documents, spark, odd):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        ws = prose(rng).split()
        toxic = i % 4 == 1 or i % 8 == 4
        if toxic:
            for _ in range(2):
                ws.insert(rng.randrange(len(ws)), rng.choice(["idiot", "moron", "loser"]))
        rows.append((i, " ".join(ws), "s"))
        labels.append((i, int(toxic)))
    disguised = ["1d10t", "m0r0n", "l o s e r", "idiooot", "l.o.s.e.r"]
    rows += [(1001 + 2 * k, prose(rng) + " you " + w + " go", "s") for k, w in enumerate(disguised)]
    d = documents(rows).select("doc_id", "text")
    lm = toxicity.language_model(toxicity.gram_counts(d))
    model = toxicity.train(d, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, label int"), EVEN, lm)
    out = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert np.mean([out[i].predicted == int(i % 4 == 1 or i % 8 == 4) for i in range(1, 600, 2)]) > 0.97
    assert all(out[1001 + 2 * k].predicted == 1 for k in range(len(disguised)))
    assert len(toxicity.score(documents(odd), model).collect()) == len(odd)
    assert toxicity.score(documents([]), model).count() == 0
    assert {r.predicted for r in toxicity.score(d.limit(2), toxicity.train(d, spark.createDataFrame([], "doc_id long, label int"), EVEN, lm)).collect()} == {0}


def test_held_out_rows_do_not_teach(documents, spark):
    rows = [(i, "alpha beta gamma" if i % 2 else "delta epsilon zeta", "s") for i in range(40)]
    d = documents(rows).select("doc_id", "text")
    lm = toxicity.language_model(toxicity.gram_counts(d))
    right = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    keep = lambda c: crc_mod(c, 4) != 2
    wrong = right.withColumn("label", F.when(keep("doc_id"), F.col("label")).otherwise(1 - F.col("label")))
    a, b = (toxicity.train(d, x, keep, lm) for x in (right, wrong))
    assert a.weights == b.weights and a.bias == b.bias


def test_licences(documents, odd):
    rng = random.Random(8)
    lines = {
        "mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0.", "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "cc-by-nc": "Licensed under CC BY-NC 4.0.", "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    }
    rows = [(i, prose(rng) + "\n" + line + "\n\n" + prose(rng), "s") for i, line in enumerate(lines.values())]
    rows += [(100 + i, prose(rng), "s") for i in range(20)] + [(200, "He renewed his driver license in the public library. The MIT professor was free.", "s")]
    d = documents(rows + odd)
    got = sorted((r.doc_id, r.line, r.family) for r in licences.scan(d, licences.train(d)).collect())
    assert [(i, f) for i, n, f in got if n == 1] == [(i, f) for i, f in enumerate(lines)] and not [g for g in got if g[0] is not None and g[0] >= 100]
    assert licences.scan(documents([]), licences.fit()).count() == 0


def test_licence_paragraphs_not_seen_in_training():
    """Whole templates left out of the fit: how often their family is still told, and other sentences aren't."""
    held = frozenset(t for ts in licences.TEXTS.values() if len(ts) > 2 for t in ts[1::3])
    model = licences.fit(held=held)
    cases = [(f, t) for f, ts in licences.TEXTS.items() for t in ts if t in held]
    right = sum(model.predict(licences.words_of(t))[0] == f for f, t in cases)
    assert len(cases) >= 8 and right / len(cases) >= 0.5
    rng = random.Random(12)
    alarms = sum(bool(model.scan(prose(rng))) for _ in range(200))
    assert alarms == 0 and not any(model.scan(t) for t in licences.OTHERS)


def test_licence_recall_on_wordings(documents):
    """Known notices inside other text, broken over lines, in other case and with other marks."""
    rng = random.Random(13)
    rows, want = [], set()
    for k, (family, ts) in enumerate(licences.TEXTS.items()):
        for j, t in enumerate(ts):
            ws = t.split()
            for v, text in enumerate((t, t.upper(), "# " + t, "\n".join(" ".join(ws[i : i + 7]) for i in range(0, len(ws), 7)), t.replace(",", " ,"))):
                rows.append((k * 1000 + j * 10 + v, prose(rng) + "\n\n" + text + "\n\n" + prose(rng), "s"))
                want.add((k * 1000 + j * 10 + v, family))
    clean = [(10**6 + i, prose(rng) + "\n" + rng.choice(licences.OTHERS), "s") for i in range(100)]
    d = documents(rows + clean)
    got = {(r.doc_id, r.family) for r in licences.scan(d, licences.train(d)).collect()}
    assert len(want & got) / len(want) >= 0.95 and not [g for g in got if g[0] >= 10**6]


def test_licences_in_long_repeated_and_clashing_rows(documents):
    rng = random.Random(14)
    long = "\n\n".join(prose(rng) for _ in range(150)) + "\n\nReleased under the MIT License."
    d = documents([(1, long, "s"), (1, long, "s"), (2, long, "s")]).withColumn("line", F.lit("clash")).withColumn("family", F.lit(1))
    got = sorted(tuple(r)[:3] for r in licences.scan(d, licences.train(d)).collect())
    assert got == [(1, 300, "mit"), (1, 300, "mit"), (2, 300, "mit")]
