"""Base counts against brute force, exact binomial bounds, and the risk guarantee."""

import math
import random
import re

from flowlens.llm.quality_rules import COUNTS, RULES, apply_rules, at_most, certified, least_good, text_counts

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = W.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if W.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    covered = {j for k, w in enumerate(windows) if times[w] > 1 for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), dup, len(covered)


def test_base_counts():
    rng = random.Random(3)
    parts = ["a", "b", "é", "😀x", "#", "<|>", " ", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\x85", "　", "A", "a b c d e", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for t in [*texts, None, "", "x" * 100_000, "same line here\n" * 5000]:
        assert text_counts(t)[:5] == brute(t)


def test_at_most_is_the_binomial_distribution():
    for n, p in ((10, 0.3), (200, 0.02), (2000, 0.005)):
        total = 0.0
        for k in range(min(n, 40)):
            total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            assert abs(at_most(k, n, p) - total) < 1e-9
    assert at_most(5, 5, 0.1) == 1.0


def test_certified_stops_at_the_first_failure():
    assert certified(1000, [0, 0, 1, 30, 0], 0.02, 0.01) == 3
    assert certified(100, [0], 0.02, 0.01) == 0 and certified(0, [0], 0.02, 0.01) == 0


def documents(n):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(n):
        good = k % 5 > 0
        words = [f"w{rng.randint(0, 10**6)}" + ("" if good or rng.random() < 0.3 else "##$") for _ in range(40)]
        rows.append((k, " ".join(words), ("en", "xx", None)[k % 3]))
        labels.append((k, int(good)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def verdicts(rows, labels, risk, confidence):
    """Kept ids, from plain counts, direct binomial sums and every level tried."""
    quality = {}
    for i, q in labels:
        if i is not None and q is not None:
            quality[i] = min(q, quality.get(i, q))
    counts = {i: dict(zip(COUNTS, text_counts(t))) for i, t, _ in rows}
    passed = {i for i, c in counts.items() if c["n_words"] >= 10 and 100 * c["n_repeat_words"] <= 20 * c["n_words"]}
    stratum = {i: lang for i, _, lang in rows}

    def over(i, rule, cutoff):
        top, bottom, _ = RULES[rule]
        return counts[i][bottom] > 0 and counts[i][top] > cutoff * counts[i][bottom]

    def tail(k, n, p):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))

    share, error = risk / 4, (1 - confidence) / 4
    good = {s: [i for i in passed if stratum[i] == s and quality.get(i) == 1] for s in set(stratum.values())}
    large = [s for s, g in good.items() if (1 - share) ** len(g) <= error]
    cut = {}
    for s in large:
        bad = [i for i in passed if stratum[i] == s and quality.get(i) == 0]
        for rule, (_, _, cutoffs) in RULES.items():
            best = None
            for c in cutoffs:
                wrong = sum(over(i, rule, c) for i in good[s])
                if tail(wrong, len(good[s]), share) > error / len(large):
                    break
                gain = sum(over(i, rule, c) for i in bad) - wrong
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, c
            if best:
                cut[s, rule] = best[1]
    return {i for i in passed if not any(over(i, r, cut[stratum[i], r]) for r in RULES if (stratum[i], r) in cut)}, cut


def test_levels_reject_bad_documents_and_keep_good_ones(spark):
    rows, labels = documents(3000)
    rows += [(10**6, None, "en"), (10**6 + 1, "", None), (10**6 + 2, "few words", "en"), (10**6 + 2, "few words", "en")]
    labels += [(5, None), (None, 1), (6, 1)]
    out, levels = apply_rules(*frames(spark, rows, labels), risk=0.08)
    assert set(levels) == {"=en", "=xx", ""} and all(set(of) == {"symbols"} for of in levels.values()) and len(out.columns) == 4 + len(COUNTS)
    got = out.collect()
    assert len(got) == len(rows)
    assert all(r["base_failed"] and not r["kept"] for r in got if r["doc_id"] >= 10**6)
    assert all(r["kept"] == (r["doc_id"] % 5 > 0) for r in got if r["doc_id"] < 3000)


def test_kept_equals_brute_force(spark):
    """Strata of different quality and size; a rule that can't be certified doesn't stop the others."""
    rng, rows, labels = random.Random(12), [], []
    for k in range(6000):
        lang, good = ("en", "en", "nl", None, "rare")[k % 5 if k % 25 else 4], rng.random() < 0.8
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(40)]
        if not good or rng.random() < 0.003:
            words = [w + rng.choice(["", "##$", "#"]) for w in words]
        if rng.random() < (0.3 if lang == "nl" else 0.5 if not good else 0.0):  # good Dutch documents shout, too
            words = [w.upper() + "AB" for w in words]
        rows.append((k, " ".join(words) + (" x" * 60 if not good and rng.random() < 0.3 else ""), lang))
        if rng.random() < (0.05 if lang == "rare" else 0.95):
            labels.append((k, int(good)))
    out, levels = apply_rules(*frames(spark, rows, labels), risk=0.08)
    want, cut = verdicts(rows, labels, 0.08, 0.95)
    assert {r["doc_id"] for r in out.where("kept").collect()} == want
    assert {(s, r) for s, of in levels.items() for r in of} == {("" if s is None else f"={s}", r) for s, r in cut}
    assert "upper_words" in levels["=en"] and "upper_words" not in levels["=nl"] and "symbols" in levels["=nl"] and "=rare" not in levels


def test_too_few_labels_leave_the_base_rules_alone(spark):
    rows, labels = documents(100)
    out, levels = apply_rules(*frames(spark, rows, labels))
    assert levels == {} and out.where("kept").count() == 100


def test_least_good_rows():
    n = least_good(0.005, 0.01)
    assert at_most(0, n, 0.005) <= 0.01 < at_most(0, n - 1, 0.005)
