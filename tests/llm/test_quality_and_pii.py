import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdlp.llm import cotraining, linear, pii, quality_rules
from sparkdlp.llm.common import utf8, word_spans
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words, seen, twice = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n, cover = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            cover.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(cover)


@pytest.mark.parametrize("text", ["", None, " \n", "a b", "é 😀|x\x1cy z", "l\n\nl\n l\nl", "one two three four five six seven eight " * 3, "w " * 9, "a b c d e f g h"])
def test_base_counts(text):
    data = utf8(text)
    assert quality_rules.counts(data, *word_spans(data)) == brute_counts(text)


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]


def test_quality_rules(tables):
    docs, labels = tables
    got = {r.doc_id: r for r in quality_rules.judge(docs, *quality_rules.train(docs, labels)).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        base = brute_counts(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == base
        assert g.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert g.kept == (not g.base_failed and g.probability >= 0.5)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([(got[d].probability >= 0.5) == (q == 1) for d, q in truth.items()]) > 0.9


def test_quality_awkward(awkward, empty, tables, spark):
    labels = tables[1]
    model = quality_rules.train(*tables)
    got = quality_rules.judge(awkward, *model).collect()
    rows = {(str(r.doc_id), *brute_counts(r.text)) for r in awkward.collect()}
    assert {(str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == rows
    assert quality_rules.judge(empty, *model).count() == 0
    none = quality_rules.train(awkward, labels.where("doc_id < 0"))
    assert {r.probability for r in quality_rules.judge(awkward, *none).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 1), (1, 0), (4, None), (None, 0), (20, 0), (21, 0)], "doc_id long, quality int")
    assert quality_rules.sample(awkward.select("doc_id", "text"), odd, "quality", 10).count() == 3


def test_calibration_matches_frequencies():
    rng = np.random.default_rng(1)
    odds = rng.normal(size=20_000)
    labels = rng.random(20_000) < linear.sigmoid(2 * odds - 1)
    assert linear.calibrate(odds, labels) == pytest.approx([2, -1], abs=0.1)


def test_cotraining_uses_all_unlabelled_rows(spark):
    """Content that the labelled rows do not show is learned through the other view's sure rows, wherever they are."""
    rows = [(i, ("bright", "murky")[i % 2], ("good", "bad")[i % 2]) for i in range(40)]
    rows += [(i, ("clear", "foggy")[i % 2], ("good", "bad")[i % 2]) for i in range(40, 4000)]
    rows += [(None, "clear", "bad"), (5000, None, None)]
    docs = spark.createDataFrame([(i, f"{t} page {i}", s, "en") for i, t, s in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    gap = lambda m: linear.raw_score(m, *linear.features_of("clear")) - linear.raw_score(m, *linear.features_of("foggy"))
    alone, _ = cotraining.train(docs, labels, rounds=0)
    taught, _ = cotraining.train(docs, labels)
    assert gap(alone[0]) < 0.1 < 1 < gap(taught[0])


def test_handed_rows_are_the_surest_of_all(spark):
    scored = spark.createDataFrame([(i, i, i, 10, float(i - 50), float(50 - i)) for i in range(101)], "id long, body long, words long, bytes int, odds0 double, odds1 double")
    first = cotraining.handed(scored, None, 0.5, 10)
    got = {(r.id, r.truth, r.view) for r in first.collect()}
    assert got == {(i, 1, 1) for i in range(96, 101)} | {(i, 0, 1) for i in range(5)} | {(i, 1, 0) for i in range(5)} | {(i, 0, 0) for i in range(96, 101)}
    again = {(r.id, r.truth, r.view) for r in cotraining.handed(scored, first, 0.5, 10).collect()}
    assert again == {(i, 1, 1) for i in range(91, 96)} | {(i, 0, 1) for i in range(5, 10)} | {(i, 1, 0) for i in range(5, 10)} | {(i, 0, 0) for i in range(91, 96)}


def test_fit_sees_whole_texts_and_bounded_rows(spark):
    """The feature that decides is the last of long texts; ids repeat far beyond the bound."""
    many = " ".join(f"w{i}" for i in range(3000))
    rows = [(i, f"{many} {i} {('splendid', 'dreadful')[i % 2]}") for i in range(400)]
    docs = spark.createDataFrame(rows + rows[:50] + [(0, f"{many} {i} splendid") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)], "doc_id long, quality int")
    assert quality_rules.sample(docs, labels, "quality", 1000).count() == 400
    assert quality_rules.sample(docs, labels, "quality", 30).count() == 30
    model = quality_rules.train(docs, labels, rows=200)
    got = quality_rules.judge(docs, *model).collect()
    assert [r.probability >= 0.5 for r in got] == [r.doc_id % 2 == 0 for r in got]


def test_sample_is_bounded_by_features(spark):
    rows = spark.createDataFrame([(i, 1000) for i in range(10)] + [(10, None), (11, 10**6)], "id long, bytes int")
    got = [r.id for r in quality_rules.bounded(rows, ["id"], 100, 2002 * 4).collect()]
    assert got == [0, 1, 2, 3] and quality_rules.bounded(rows, ["id"], 100).count() == 12


MASK = (1 << 64) - 1


def plain_mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ x >> shift) * factor) & MASK
    return x ^ x >> 31


def plain_features(text):
    """The content features without numpy: slot -> value."""
    text, step = text or "", 0x9E3779B97F4A7C15
    power = lambda bs: sum((b + 1) * pow(step, i, 1 << 64) for i, b in enumerate(bs))
    words = [plain_mix((power(w.encode()) + 0x632BE59BD9B4E019 * len(w.encode())) & MASK) for w in WORD.findall(text)]
    codes = words + [plain_mix((a * step + b) & MASK) for a, b in zip(words, words[1:], strict=False)]
    for i in range(len(text) - 3):
        a, b, c, d = map(ord, text[i : i + 4])
        codes.append(plain_mix((((a * step + b) * step + c) * step + d) & MASK))
    counts = Counter(c % 65536 for c in codes)
    length = sum(np.log1p(n) ** 2 for n in counts.values()) ** 0.5
    return {at: np.log1p(n) / length for at, n in counts.items()}


def test_predictions_equal_plain_versions(tables):
    docs, labels = tables
    docs = docs.orderBy("doc_id").limit(60).cache()
    model, weights = quality_rules.train(*tables)
    got = {r.doc_id: r.probability for r in quality_rules.judge(docs, model, weights).collect()}
    models, (by_content, by_meta, by_both) = cotraining.train(*tables, rounds=1)
    scored = {r.doc_id: r for r in cotraining.score(docs, (models, (by_content, by_meta, by_both))).collect()}
    odds = lambda m, found: sum(m[at] * v for at, v in found.items()) + m[-1]
    chance = lambda x: 1 / (1 + np.exp(-x))
    for r in docs.collect():
        found = plain_features(r.text)
        assert got[r.doc_id] == pytest.approx(chance(weights[0] * odds(model, found) + weights[1]), abs=1e-4)
        a = by_content[0] * odds(models[0], found) + by_content[1]
        assert scored[r.doc_id].content_prob == pytest.approx(chance(a), abs=1e-4)
        b = np.log(scored[r.doc_id].meta_prob / (1 - scored[r.doc_id].meta_prob))
        assert scored[r.doc_id].quality_prob == pytest.approx(chance(by_both[0] * a + by_both[1] * b + by_both[2]), abs=1e-4)


def test_character_runs_are_of_letters():
    found = dict(zip(*linear.features_of("дом дома 😀 ünï"), strict=True))
    assert found == pytest.approx(plain_features("дом дома 😀 ünï"), abs=1e-6)


def test_accuracy_on_labels_that_were_held_back(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    seen, unseen = (labels.where(f"doc_id % 2 = {i}") for i in (0, 1))
    truth = {r.doc_id: r.quality == 1 for r in unseen.collect() if r.quality is not None}
    always = np.mean(list(truth.values()))
    rules = {r.doc_id: r.probability >= 0.5 for r in quality_rules.judge(docs, *quality_rules.train(docs, seen)).collect()}
    views = {r.doc_id: r.kept for r in cotraining.score(docs, cotraining.train(docs, seen)).collect()}
    for got in (rules, views):
        accuracy = np.mean([got[d] == q for d, q in truth.items()])
        assert accuracy > max(0.93, always, 1 - always)


def test_cotraining_accuracy_and_awkward(tables, awkward, empty):
    docs, labels = tables
    trained = cotraining.train(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in cotraining.score(docs, trained).collect()}
    assert len(got) == docs.count()
    assert np.mean([got[d].kept == (q == 1) for d, q in truth.items()]) > 0.9
    rows = cotraining.score(awkward, trained).collect()
    assert len(rows) == awkward.count() and all(0 <= r.quality_prob <= 1 for r in rows)
    assert cotraining.score(empty, trained).count() == 0
    untrained = cotraining.train(empty, labels)
    assert {r.quality_prob for r in cotraining.score(awkward, untrained).collect()} == {0.5}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 8 <= len(d) <= 15,
            }[kind]()
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    None, "", "a@b.c_x@y.zz, 1.2.3.4.5.6.7.8 é 300.1.1.1 0001.002.3.4", "call (555) 555-1234 or +44 20 7946 0958 or +1+2 3456789",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 12 3", "😀é bob@ex.com! @ a@b a@b.", "9" * 3000, "x" * 50_000 + "@", "1." * 5000,
    "+" + "1 " * 3000, "mail@mail@mail.com", "10[.]0[.]0[.]1 fe80:0:0:1:2:3:4:5", "bob [at] mail [dot] com",
]


def test_base_spans_equal_brute_force(spark, awkward, empty):
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(TEXTS)] + [(10_003, TEXTS[2])], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(extra).union(awkward.select("doc_id", "text"))
    got = {(str(r.doc_id), r.body): r for r in pii.find(docs).collect()}
    rows = docs.selectExpr("doc_id", "text", "xxhash64(text) body").collect()
    for r in rows:
        g, base = got[str(r.doc_id), r.body], base_spans(r.text)
        assert g.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (r.doc_id, base, g.spans)
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(s.startswith(k) for s in base) for k in PATTERNS]
        spans = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in g.spans.split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} >= set(base)
        added = [s for s in spans if "{}:{}:{}".format(*s) not in base]
        assert all(b <= c or d <= a for _, a, b in added for k, c, d in spans if (a, b) != (c, d))
        assert (g.n_added, g.has_pii) == (len(added), bool(spans))
    assert pii.find(docs).count() == len(rows)
    assert pii.find(empty).count() == 0


def test_redaction_and_additions(spark):
    own = spark.createDataFrame([(-1, "reach (555) 555-1234 today, é a@b.com 1.2.3.4"), (-2, None), (-3, "clean text")], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(own)
    got = {r.doc_id: r.text for r in pii.redact(docs).where("doc_id < 0").collect()}
    assert got == {-1: "reach [PHONE] today, é [EMAIL] [IP]", -2: None, -3: "clean text"}


def test_counter_examples_of_every_kind(spark):
    text = "a@b.com 1.2.3.4, 4111 1111 1111 1111, +44 20 7946 0958"
    found = pii.checked(pii.proposals(spark.createDataFrame([(1, text)] * 3, "doc_id long, text string"))).where("base and valid")
    assert {(r.kind, r.hit) for r in pii.lookalikes(found).collect()} == {("email", "a@bcom"), ("ip", "1.2.3"), ("card", "4111 1111"), ("phone", "+44 20 7")}
    assert found.count() == 4 and not {"check_digit", "octets", "digits"} & set(pii.FEATURES)


def test_additions_need_their_check_and_keep_apart(spark, monkeypatch):
    """With every chance high enough: what overlaps a base span goes first, then what overlaps an earlier addition."""
    always = pii.Model("0.0D", 0.0, 9.0, dict.fromkeys(pii.KINDS, 0.5))
    monkeypatch.setattr(pii, "train", lambda found: always)
    texts = ["10[.]0[.]0[.]1 10[.]0[.]0[.]999", "4111.1111.1111.1111 4111.1111.1111.1112", "a@b.com", "x+é@b.com", "(555) 555-1234 and 555-555-1234"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert got == {0: "ip:0:14", 1: "card:0:19", 2: "email:0:7", 3: "email:0:9", 4: "phone:0:14,phone:19:31"}


def test_plan_has_no_python(awkward):
    plan = pii.find(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_every_example_is_fitted_on(spark, monkeypatch):
    """What the fit reads stands for all examples of a kind, those that occur once too."""
    rows = [(i, f"mail {'a' * (1 + i % 3 if i % 20 else 100 + i)}@x.org or 1.2.3.{i % 400}") for i in range(3000)]
    found = pii.with_features(pii.checked(pii.proposals(spark.createDataFrame(rows, "doc_id long, text string")))).cache()
    read = []
    monkeypatch.setattr(pii, "saved", lambda df: read.append(df.cache()) or read[-1])
    assert pii.train(found).thresholds
    (sample,) = read
    got = {(r.kind, r.label): r.n for r in sample.groupBy("kind", "label").agg(F.sum("weight").alias("n")).collect()}
    right = sum(i % 400 < 256 for i in range(3000))
    assert {k: n for k, n in got.items() if k[0] in ("email", "ip")} == pytest.approx({("email", 1.0): 3000, ("email", 0.0): 3000, ("ip", 1.0): right, ("ip", 0.0): 3000})
    assert {100 + i + 6 for i in range(0, 3000, 20)} <= {r.chars for r in sample.where("kind = 'email' and label = 1").select("chars").collect()}
    assert sample.count() < 1500
