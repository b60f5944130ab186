import random

import numpy as np

from sparkdlp.llm import decontaminate, order_minhash, sharding
from tests.conftest import SF
from tests.llm.conftest import prose


def brute_classes(rows):
    """Class (lowest id) of each row by comparing all pairs; texts without words stay alone."""
    codes = [order_minhash.word_codes(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if order_minhash.aligned(codes[i], codes[j]) > 0:
                group[top(i)] = top(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(doc_id)
    lowest = lambda own: min((x for x in own if x is not None), default=None)
    return sorted((str(d), str(lowest(ids[top(i)])) if len(codes[i]) else str(d)) for i, (d, _) in enumerate(rows))


def got_classes(docs):
    return sorted((str(r.doc_id), str(r.class_id)) for r in order_minhash.classes(docs).collect())


def test_classes_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got_classes(docs) == brute_classes([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_chains_and_near_misses_equal_brute_force(spark):
    rng, rows = random.Random(4), []
    base = prose(300, 11).split()
    for i in range(60):  # a group in which many pairs are just under the threshold
        words = list(base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    passage = prose(80, 12)
    rows += [(100 + i, prose(60, 100 + i) + " " + passage + " " + prose(60, 300 + i)) for i in range(40)]
    rows += [(200, prose(100, 50)), (201, " ".join(prose(100, 50).split()[50:] + prose(100, 50).split()[:50]))]  # halves swapped
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_classes(docs) == brute_classes(rows)


def test_alignment_is_ordered():
    words = prose(200, 3).split()
    codes = lambda own: order_minhash.word_codes(" ".join(own))
    whole = codes(words)
    assert order_minhash.aligned(whole, whole) == 1
    assert order_minhash.aligned(whole, codes(words[100:] + words[:100])) == 0
    assert order_minhash.aligned(whole, codes(words[:190])) == 190 / 200
    repeated = order_minhash.shingles("a b c d e " * 50)
    assert len(set(repeated.tolist())) == len(repeated)


def plain_similarity(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1] / (len(a) + len(b) - row[-1])


def test_alignment_against_the_longest_common_subsequence():
    rng, exact = random.Random(7), 0
    for n in (3, 9, 10, 40, 100, 300):
        for _ in range(40):
            a = [f"w{rng.randrange(60)}" for _ in range(n)]
            b = list(a)
            for _ in range(rng.randint(0, max(1, n // 7))):
                at, way = rng.randrange(len(b)), rng.randrange(3)
                b[at : at + (way < 2)] = [f"w{rng.randrange(60)}"] if way else []
                b = b or ["w"]
            codes = [order_minhash.word_codes(" ".join(x)) for x in (a, b)]
            got, most = order_minhash.aligned(*codes), plain_similarity(a, b)
            assert got == order_minhash.aligned(*codes[::-1]) and (got == 0 or 0.8 - 1e-9 <= got <= most + 1e-9)
            exact += got == (most if most >= 0.8 else 0)
    assert exact >= 236  # of 240: anchors may cost a word


def test_changed_words_are_found(spark):
    """Pairs with one word in ten and fewer substituted are linked: more than nine in ten of them."""
    rng, rows = random.Random(8), []
    for i in range(300):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((40, 100, 300)))]
        other = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) * rng.choice((2, 4, 7, 10)) // 100)):
            other[at] = f"new{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = dict(got_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(got[str(2 * i + 1)] == str(2 * i) for i in range(300)) >= 0.95 * 300
    assert all(int(c) in (int(d), int(d) - 1) for d, c in got.items())


def test_bins_bound_the_common_words():
    rng = random.Random(3)
    for _ in range(50):
        a, b = ([f"w{rng.randrange(90)}" for _ in range(rng.randint(1, 200))] for _ in range(2))
        shared = sum(min(a.count(x), b.count(x)) for x in set(a))
        bound = np.minimum(*(order_minhash.bin_counts(order_minhash.word_codes(" ".join(x))) for x in (a, b))).sum()
        assert bound >= shared


def test_near_duplicates_awkward(awkward, empty):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    # Ids 20 and 21 repeat: classes are told apart by label, so compare ids only where they are unique.
    got, expected = got_classes(awkward), brute_classes(rows)
    assert got == expected
    kept = order_minhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    left = sorted(str(r.doc_id) for r in kept.collect())
    assert left == sorted(map(str, [1, 4, 5, 6, 7, 8, 10, 11, 12, 13, None, None, 20, 21, 21, 22, 23]))
    assert order_minhash.keep_one(empty).count() == 0 and order_minhash.classes(empty).count() == 0


def brute_overlaps(docs, items):
    out = set()
    for doc_id, text in docs:
        words = decontaminate.words(text)
        for item_id, item in items:
            codes = decontaminate.words(item)
            window, allowed = decontaminate.tolerance(len(codes))
            if not window or not len(words):
                continue
            at, to = np.nonzero(codes[:, None] == words[None, :])
            shifts, n = np.unique(to - at, return_counts=True)
            best = max((decontaminate.overlap(codes, words, int(s)) for s in shifts[n >= window - allowed]), default=0)
            if best:
                out.add((str(doc_id), item_id, best))
    return out


def test_overlaps_equal_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(str(r.doc_id), r.item_id, r.matched) for r in decontaminate.overlaps(docs, items).collect()}
    assert got == brute_overlaps([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert got


def test_substitutions_are_tolerated_up_to_the_limit(spark):
    rng = random.Random(9)
    items = [(i, prose(n, 20 + i)) for i, n in enumerate((7, 8, 11, 12, 18, 23, 24, 40, 60))]
    docs = []
    for item_id, text in items:
        for changes in range(7):
            for _ in range(6):
                words = text.upper().split()
                for at in rng.sample(range(len(words)), min(changes, len(words))):
                    words[at] = f"other{rng.randrange(10**6)}"
                docs.append((len(docs), prose(rng.randrange(40), 77) + ", " + "  ".join(words) + "! " + prose(rng.randrange(40), 78)))
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(str(r.doc_id), r.item_id, r.matched) for r in got.collect()}
    assert found == brute_overlaps(docs, items)
    # A table that lets everything through and one that lets chance hits through give the same rows.
    assert {tuple(r) for r in decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), bits=64).collect()} == {tuple(r) for r in got.collect()}


def test_decontamination_awkward(awkward, empty, spark):
    items = spark.createDataFrame([(1, prose(50, 7)), (1, prose(50, 7)), (2, None), (3, ""), (4, "short one"), (None, prose(80, 2))], "item_id long, text string")
    found = decontaminate.overlaps(awkward, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(20, 1), (4, None)}
    clean = decontaminate.keep_clean(awkward, items)
    assert clean.columns == awkward.columns and clean.count() == awkward.count() - 3
    assert decontaminate.overlaps(empty, items).count() == 0
    assert decontaminate.overlaps(awkward, items.where("item_id > 100")).count() == 0


def shards_hold(docs, shards=16):
    got = sharding.assign(docs, shards).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert got["shard"].between(0, shards - 1).all() and got["grown_shard"].isna().all() and set(got["law"]) <= {"bytes"}
    return got, sizes


def test_shards_are_even_and_groups_stay_together(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    got, sizes = shards_hold(docs)
    assert sizes.max() < 1.02 * sizes.mean() and sizes.min() > 0.98 * sizes.mean()
    groups = got.groupby(["text_crc32", "size"])["shard"].agg(["nunique", "count"])
    groups = groups[groups["count"] > 1]
    assert (groups["nunique"] == 1).mean() > 0.9


def test_a_group_larger_than_a_shard_is_spread(spark):
    rows = [(i, prose(30, 1)) for i in range(400)] + [(1000 + i, prose(30, i + 2)) for i in range(600)]
    got, sizes = shards_hold(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sizes.max() < 1.05 * sizes.mean()


def test_groups_are_cut_only_for_what_whole_groups_cannot_even_out(spark):
    import random

    rng, texts = random.Random(4), ["hot " + prose(30, 1)] * 4000
    while len(texts) < 7600:  # groups of 2 to 150, all less than a part
        texts += [f"{len(texts)} {prose(30, 1)}"] * rng.choice([2, 3, 5, 10, 40, 100, 150])
    texts += [f"{i} {prose(30, 1)}" for i in range(len(texts), 12_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, sizes = shards_hold(docs)
    assert sizes.max() < 1.02 * sizes.mean() and sizes.min() > 0.98 * sizes.mean()
    groups = got.groupby(["text_crc32", "size"])["shard"].agg(["nunique", "count"])
    small = groups[(groups["count"] > 1) & (groups["count"] < 4000)]
    assert len(small) > 30 and (small["nunique"] > 1).sum() <= 3


def test_sharding_awkward(awkward, empty):
    import zlib

    got, _ = shards_hold(awkward, 4)
    expected = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in awkward.collect())
    ids = ["None" if np.isnan(x) else str(int(x)) for x in got["doc_id"]]
    assert sorted(zip(ids, got["size"], got["text_crc32"], strict=True)) == expected
    assert sharding.assign(empty).count() == 0


PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def test_words_of_every_script():
    spaced = decontaminate.words("the quoted words here")
    assert decontaminate.words("the “quoted” words…here —").tolist() == spaced.tolist()
    assert len(decontaminate.words("日本語 テスト")) == 6 and len(decontaminate.words("это “важный” текст")) == 3


def test_quotes_and_unspaced_scripts_are_found(spark):
    items = spark.createDataFrame([(1, PASSAGE), (2, "我们今天在学校里学习新的语言和文化")], "item_id long, text string")
    docs = [(1, f"He said “{PASSAGE}” – twice"), (2, "前面我们今天在学校里学习新的语言和文化后面"), (3, "我们明天不去"), (4, PASSAGE.replace(" ", "’ "))]
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 2), (4, 1)}


def test_short_items_match_word_for_word(spark):
    items = [(4, "alpha beta gamma delta"), (7, "a b c d e f g"), (3, "too few words")]
    docs = [(1, "x alpha, Beta gamma delta y"), (2, "alpha beta gamma other delta"), (3, "z a b c d e f g"), (4, "a b c d e f h g"), (5, "too few words"), (6, "alpha beta gamma delta")]
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.matched, r.n_words) for r in got} == {(1, 4, 4, 4), (6, 4, 4, 4), (3, 7, 7, 7)}


def test_ids_keep_their_type(spark):
    items = spark.createDataFrame([("q-1", PASSAGE)], "item_id string, text string")
    docs = spark.createDataFrame([("a", PASSAGE), ("b", "clean"), (None, PASSAGE), ("c", None), ("a", "other text")], "doc_id string, text string")
    got = decontaminate.overlaps(docs, items)
    assert sorted((str(r.doc_id), r.item_id) for r in got.collect()) == [("None", "q-1"), ("a", "q-1")]
    assert sorted((r.doc_id, str(r.text)) for r in decontaminate.keep_clean(docs, items).collect()) == [("a", "other text"), ("b", "clean"), ("c", "None")]


def test_small_tables_are_written_by_few_tasks(spark, monkeypatch):
    edges = spark.range(0, 60, 2).selectExpr("id a", "id + 1 b").union(spark.createDataFrame([(0, 2)], "a long, b long"))
    monkeypatch.setitem(order_minhash.__dict__, "saved", saved := spy(order_minhash.saved))
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.node: r.label for r in order_minhash.components(edges).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: 0 if i < 4 else i - i % 2 for i in range(60)}
    assert max(saved.partitions) <= 2 * spark.sparkContext.defaultParallelism < 97


def spy(save):
    def run(df):
        run.partitions.append(df.rdd.getNumPartitions())
        return save(df)

    run.partitions = []
    return run
