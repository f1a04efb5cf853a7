"""Mixing, rules, chat formatting and decontamination against brute force, and on odd rows."""

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import _common, chat, decontam, mixing, rules


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def python_nodes(df):
    return re.findall("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def mixed(docs):
    return mixing.mix_documents(docs)


def test_mixing_reaches_targets(documents):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 60), ["big"] * 6 + ["b", "c", None]) for i in range(1500)]
    rows = [(i, t, rng.choice(s)) for i, t, s in rows]
    out = mixed(documents(rows)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert r.mix_copies <= 3
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        taken, target = sum(r.mix_copies * r.mix_size for r in rs), rs[0].mix_target
        assert rs[0].mix_source_size == sum(r.mix_size for r in rs)
        assert abs(taken - target) <= 0.03 * target + 60
    assert sorted((r.doc_id, r.mix_copies) for r in mixed(documents(rows)).collect()) == sorted((r.doc_id, r.mix_copies) for r in out)


def test_mixing_targets_by_hand(documents):
    # weights 5, 2, 1 in order a, b, null; a may take 3 * 10 at most, the rest is shared 2 : 1
    rows = [(1, "x " * 10, "a"), (2, "x " * 50, "b"), (3, "x " * 40, None)]
    got = {r.source: r.mix_target for r in mixed(documents(rows)).collect()}
    assert got["a"] == 30 and math.isclose(got["b"], 140 / 3) and math.isclose(got[None], 70 / 3)


def test_mixing_odd_rows(documents, odd):
    clashing = documents(odd).withColumn("mix_size", F.lit(-5)).withColumn("size", F.lit("clash")).withColumn("row", F.lit(7)).withColumn("key", F.lit("k")).withColumn("copies", F.lit("c"))
    out = mixing.expand(clashing)
    assert out.columns == clashing.columns
    assert {tuple(r)[5:] for r in out.collect()} <= {(-5, "clash", 7, "k", "c")}
    assert {(r.mix_size, r.mix_size_ >= 0) for r in mixed(clashing).collect()} == {(-5, True)}
    assert mixed(documents(odd)).count() == len(odd)
    assert mixed(documents([])).count() == 0 and mixing.expand(documents([])).count() == 0
    assert not python_nodes(mixed(documents(odd)))


def test_mixing_spreads_a_source_without_ids(documents):
    docs = documents([(None, f"word {i} of {i % 7}", "a") for i in range(600)])
    sized = docs.select(F.col("doc_id").alias("id"), "source", F.lit(4).alias("size"), mixing.tie("doc_id", "text").alias("tie"))
    most = max(r["count"] for r in mixing.with_blocks(sized).groupBy(*mixing.BLOCK_COLUMNS).count().collect())
    assert most < 40
    first = sorted((r.text, r.mix_copies) for r in mixed(docs).collect())
    assert first == sorted((r.text, r.mix_copies) for r in mixed(docs.repartition(7)).collect())


def test_mixing_by_shuffled_joins(documents, monkeypatch):
    docs = documents([(i % 50 or None, "word " * (i * 37 % 301), ["a", "b", None][i % 3]) for i in range(600)])
    taken = lambda: sorted(map(str, mixed(docs).select("doc_id", "text", "source", "mix_copies").collect()))
    before = taken()
    monkeypatch.setattr(_common, "BROADCAST_BYTES", 0)
    assert taken() == before


def repeat_words(ws):
    wins = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    c = Counter(wins)
    return len({j for i, w in enumerate(wins) if c[w] > 1 for j in (i, i + 1, i + 2)})


def test_rules_counts(documents, odd):
    rng = random.Random(2)
    rows = odd + [(100 + i, "".join(rng.choice(["the ", "a#b ", "cat\n", "dog  ", "<x> ", "été\t", "|\n"]) for _ in range(rng.randint(0, 200))), "s") for i in range(40)]
    rows += [(200, "Na " * 5000, "s"), (201, " ".join(f"w{i % 97} v{i % 89}" for i in range(4000)), "s")]
    got = sorted(map(tuple, rules.judge(documents(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    want = []
    for i, t, _ in rows:
        ws, n = words(t), repeat_words(words(t))
        ls = [x for x in (t or "").split("\n") if words(x)]
        want.append((i, len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), n, len(ws) < 50 or 100 * n > 50 * len(ws)))
    assert got == sorted(want, key=str)


def js(p, q):
    p, q = (np.array(x, float) / sum(x) for x in (p, q))
    m = (p + q) / 2
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def test_jensen_shannon_distance(spark):
    rng = np.random.default_rng(0)
    rows = [([int(x) for x in rng.integers(0, 9, 6)], [int(x) for x in rng.integers(1, 50, 6)]) for _ in range(40)] + [([0] * 6, [1] * 6), ([3] * 6, [5] * 6), ([1, 0], [0, 7])]
    got = spark.createDataFrame(rows, "p array<long>, q array<long>").selectExpr("p", "q", f"{rules.js_distance('p', 'q')} AS d").collect()
    for r in got:
        assert r.d is None if not sum(r.p) else math.isclose(r.d, js(r.p, r.q), abs_tol=1e-7)


def test_rules_distances_against_brute_force(documents):
    rng = random.Random(31)
    vocab = ["the", "of", "and", "Der", "und", "cat", "river", "x1", "É"]
    rows = []
    for i in range(60):
        w = [rng.choice(vocab if i % 5 else ["%%", "77", "A"]) for _ in range(rng.randint(40, 90))]
        rows.append((i, rng.choice([" ", "  ", "\n", ", "]).join(w) + f" tail{i} " + " ".join(f"u{i}v{k}" for k in range(60)), "s"))
    docs = documents(rows).withColumn("lang", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'de' WHEN doc_id % 3 = 1 THEN 'en' WHEN doc_id % 2 = 0 THEN 'xx' END"))
    hist, com, lang, ok = {}, {}, {}, {}
    for i, t, _ in rows:
        lang[i] = "de" if i % 3 == 0 else "en" if i % 3 == 1 else "xx" if i % 2 == 0 else None
        kind = [0 if unicodedata.category(c) == "Ll" else 1 if unicodedata.category(c) == "Lu" else 2 if c in "0123456789" else 3 if c in rules.PUNCTUATION else 4 if c in rules.SPACE else 5 for c in t]
        hist[i] = [kind.count(k) for k in range(6)]
        if lang[i] in rules.COMMON:
            low = re.split(r'[\x20\x09-\x0D.,;:!?"()]+', t.lower())
            com[i] = [low.count(w) for w in rules.COMMON[lang[i]]]
            com[i].append(max(0, len(words(t)) - sum(com[i])))
        ok[i] = len(words(t)) >= 50 and 100 * repeat_words(words(t)) <= 50 * len(words(t))
    total = lambda ids, h: [sum(x) for x in zip(*(h[i] for i in ids))]
    group = lambda i, among: [k for k in among if lang[k] == lang[i]]
    first = [i for i in ok if ok[i]]
    near = [i for i in first if js(hist[i], total(group(i, first), hist)) <= 0.15]
    for r in rules.judge(docs).collect():
        ref = group(r.doc_id, near)
        judged = r.word_chars >= 200 and ref
        want = js(hist[r.doc_id], total(ref, hist)) if judged else None
        assert (r.class_distance is None) == (want is None) and (want is None or math.isclose(r.class_distance, want, abs_tol=1e-7))
        want_com = js(com[r.doc_id], total(ref, com)) if ref and r.doc_id in com and r.n_words >= 50 and sum(com[r.doc_id]) else None
        assert (r.common_distance is None) == (want_com is None) and (want_com is None or math.isclose(r.common_distance, want_com, abs_tol=1e-7))
        assert r.kept == (ok[r.doc_id] and (want or 0) <= 0.16 and (want_com or 0) <= 0.45)


def test_rules_verdict(documents):
    rng = random.Random(3)
    vocab = [a + b for a in "thr she lor ban wen".split() for b in "ing and or el ta en".split()]
    clean = [" ".join(rng.choice(vocab + ["the", "of", "and", "to"] * 5) for _ in range(300)) + "." for _ in range(60)]
    junk = ["".join(chr(rng.randint(0x2500, 0x25FF)) + " " for _ in range(400)), " ".join(str(rng.randint(0, 10**9)) for _ in range(300))]
    d = documents([(i, t, "s") for i, t in enumerate(clean + junk)])
    kept = {r.doc_id for r in rules.judge(d).where("kept").collect()}
    assert kept == set(range(60))
    assert not python_nodes(rules.judge(d)) and rules.judge(documents([])).count() == 0


def test_chat(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 2, "user", "x"), (1, 0, "user", "hi"), (1, 1, "assistant", "bb"),
        (2, 0, None, None), (3, None, None, None), (4, 0, "user", "alone"), (None, 0, "user", "nobody"), (6, 0, "user", "q"), (6, 1, "assistant", "r"), (7, 0, "user", "q"), (7, 1, "assistant", "r"),
    ]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1)).withColumn("pair_id", F.lit("clash"))
    out = {r.pair_id: r for r in chat.preference_pairs(t, F.shiftright("conv_id", 1), F.col("conv_id") % 2 == 0).collect()}
    assert set(out) == {0, 1, 2, 3}
    a = out[0]
    assert a.n_prompt_turns == 1 and a.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert a.chosen == "<|im_start|>assistant\na<|im_end|>\n<|im_start|>user\nx<|im_end|>\n"
    assert [a.chosen[s.start : s.end] for s in a.chosen_mask] == ["a<|im_end|>"] and [a.rejected[s.start : s.end] for s in a.rejected_mask] == ["bb<|im_end|>"]
    assert out[1].paired and out[1].n_prompt_turns == 1 and out[1].chosen == ""  # null turns are equal
    assert not out[2].paired and out[2].rejected == "" and out[2].prompt == ""
    assert out[3].n_prompt_turns == 2 and out[3].chosen == out[3].rejected == ""
    assert chat.preference_pairs(t.where("false"), F.col("conv_id"), F.lit(True)).count() == 0


def test_chat_long_and_tied(spark):
    """Thousands of turns, repeated rows and turns of equal number: spans against a plain loop."""
    rng = random.Random(32)
    rows = [(c, i // 2 if c == 2 else i, rng.choice(["user", "assistant"]), f"text {rng.random()}" * (i % 4)) for c in (0, 2) for i in range(3000)]
    rows += [(1, *r[1:]) for r in rows if r[0] == 0 and r[1] < 1500] + [(3, 0, "assistant", "same")] * 3
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = chat.preference_pairs(t, F.shiftright("conv_id", 1), F.col("conv_id") % 2 == 0)
    assert not python_nodes(pairs)
    for p in pairs.collect():
        sides = [sorted(r[1:] for r in rows if r[0] == 2 * p.pair_id + k) for k in (0, 1)]
        k = 0
        while k < min(map(len, sides)) and sides[0][k][1:] == sides[1][k][1:]:
            k += 1
        assert p.n_prompt_turns == k
        for turns, out, mask in zip(sides, (p.chosen, p.rejected), (p.chosen_mask, p.rejected_mask)):
            spans, at = [], 0
            for _, role, text in turns[k:]:
                whole = f"<|im_start|>{role}\n{text}<|im_end|>\n"
                if role == "assistant":
                    spans.append((at + len("<|im_start|>assistant\n"), at + len(whole) - 1))
                at += len(whole)
            assert len(out) == at and [tuple(s) for s in mask] == spans


def shingle_set(t):
    ws = [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    return {" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_decontamination(documents, spark, odd, monkeypatch):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 8, 20, 45])))) for i in range(30)] + [(99, None), (98, " . "), (97, "one two"), (96, "one two")]
    rows = list(odd) + [(500, "One, TWO!", "s")]
    for i in range(80):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 400))]
        if i % 2:
            passage = rng.choice(items[:30])[1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = passage
        rows.append((1000 + i, " ".join(body), "s"))
    got = {(r.doc_id, r.item_id, r.n_shared) for r in decontam.contaminated(documents(rows).withColumn("h", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for d, t, _ in rows:
        for i, x in items:
            a, b = shingle_set(t), shingle_set(x)
            if b and 10 * len(a & b) >= 8 * len(b):
                want.add((d, i, len(a & b)))
    assert got == want and len(want) > 15
    with monkeypatch.context() as m:
        m.setattr(_common, "BROADCAST_BYTES", 0)
        shuffled = decontam.contaminated(documents(rows), spark.createDataFrame(items, "item_id long, text string"))
        assert {(r.doc_id, r.item_id, r.n_shared) for r in shuffled.collect()} == want and not python_nodes(shuffled)
    clean = decontam.decontaminate(documents(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert clean.count() == sum(d not in {x[0] for x in want} for d, _, _ in rows) and clean.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not python_nodes(clean)
    assert decontam.contaminated(documents([]), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_mixing_takes_the_same_documents_whatever_the_block_size(documents, monkeypatch):
    docs = documents([(i, "word " * (i * 37 % 301), "abc"[i % 3]) for i in range(600)])
    taken = lambda: sorted((r.doc_id, r.mix_copies) for r in mixing.mix_documents(docs).select("doc_id", "mix_copies").collect())
    before = taken()
    monkeypatch.setattr(mixing, "ROWS", 1)
    assert taken() == before


def test_decontamination_counts_an_id_once(documents, spark):
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(1, " ".join(f"w{i}" for i in range(18)), "s"), (1, " ".join(f"w{i}" for i in range(12, 30)), "s"), (2, " ".join(f"w{i}" for i in range(18)), "s"), (None, item, "s"), (None, "x", "s"), (3, item, "s"), (3, item, "s")]
    items = spark.createDataFrame([(7, item), (None, item), (8, item), (8, "one more of the same id")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared) for r in decontam.contaminated(documents(rows), items).collect()}
    # the rows of id 1 hold 14 shingles each, 2 of them in common: neither is enough alone
    assert got == {(d, i, 26) for d in (1, None, 3) for i in (7, None, 8)}


def test_decontamination_searches_by_sketches(documents, spark):
    rng = random.Random(5)
    item = [f"w{i}" for i in range(60)]
    docs = documents([(i, " ".join(item[i : i + 7]), "s") for i in range(50)] + [(99, " ".join(item), "s")] + [(100 + i, " ".join(rng.choice(item) for _ in range(50)), "s") for i in range(20)])
    index = decontam.item_sketches(spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    (row,) = index.collect()
    assert (row.m, row.need, row.part) == (56, 45, 6) and row.sketch == sorted(row.hs)[: len(row.sketch)] and 56 - 45 < len(row.sketch) < 20
    sketched, whole = (index.select("item", F.explode(c).alias("h")) for c in ("sketch", "hs"))
    few, all_ = (decontam.candidates(docs, x, 100).count() for x in (sketched, whole))
    assert 1 <= few < all_ and decontam.candidates(docs, sketched.where("false"), 0).count() == 0
