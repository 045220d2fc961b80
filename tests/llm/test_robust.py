"""Every corpus operator on odd rows that carry columns named as its own."""

import random

import pytest
from pyspark.sql import functions as F

from tenderlens.llm import decontaminate, language_id, line_dedup, mixing, near_join, pii, quality_model, quality_rules, spelling, substring_dedup, suffix_dedup

NAMES = (
    "key cls row n sig rep size unit terms label rank mask score held_out predicted word h form root id run slot bits kind spans base clean bucket before uses position taken target "
    "source_size copy_of class_id n_links links members band blk h1 h2 known ids texts cosine lcs item_id n_words kept text_id share entity term letters p lang_pred"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(80)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 60))), rng.choice(["x", "y"]), "s") for i in range(24)]
    rows += [(100, rows[3][1], "x", None), (101, None, None, None), (102, "", "x", "s"), (103, " \n\t", "y", "s"), (None, rows[3][1], "x", "s"), (None, None, None, None), (3, rows[3][1], "x", "s"), (104, "a@b.cd +44 20 7946 0958 " + "é" * 5000, "x", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    return df.select("*", *(F.lit("clash").alias(n) for n in NAMES)).cache(), len(rows)


@pytest.mark.parametrize(
    "op",
    [near_join.near_duplicates, substring_dedup.repeated_windows_removed, mixing.training_order, lambda d: quality_rules.judged(quality_rules.rule_ledger(d)), pii.sanitised, suffix_dedup.repeated_bytes_removed, line_dedup.digest, language_id.languages],
    ids=["near", "windows", "mixing", "rules", "pii", "suffix", "lines", "language"],
)
def test_a_row_for_each_row(docs, op):
    df, n = docs
    assert op(df).count() == n


def test_spelling_ignores_other_columns(docs):
    df, _ = docs
    assert {tuple(r) for r in spelling.variant_forms(df).collect()} == {tuple(r) for r in spelling.variant_forms(df.select("doc_id", "text")).collect()}


def test_quality_of_odd_and_of_no_rows(spark, docs):
    df, n = docs
    labels = spark.createDataFrame([(i, i % 2, 0, "clash") for i in range(24)] + [(3, 1, 0, "clash"), (None, 1, 0, "clash")], "doc_id long, quality int, toxic int, text string")
    first = {tuple(r) for r in quality_model.quality_scores(df, labels).collect()}
    assert {tuple(r) for r in quality_model.quality_scores(df.repartition(5), labels).collect()} == first and quality_model.quality_scores(df, labels).count() == n
    assert quality_model.quality_scores(df.limit(0), labels).count() == 0
    assert {r.score for r in quality_model.quality_scores(df, labels.limit(0)).collect()} == {0.5}
    # ids repeated more often than the sample may be large: the same rows are learnt from, wherever they lie
    many = df.select("doc_id", "text").unionByName(df.select("doc_id", F.concat("text", F.lit(" more")).alias("text")))
    runs = [sorted((tuple(r) for r in quality_model.quality_scores(many.repartition(k), labels, train_rows=4).collect()), key=str) for k in (2, 7)]
    assert runs[0] == runs[1]


def test_benchmark_in_several_passes(spark, docs, monkeypatch):
    """Items that are searched in several passes are found as in one; equal items are each found."""
    df, _ = docs
    rng = random.Random(2)
    text = lambda k: " ".join(f"q{rng.randrange(200)}k{k}" for _ in range(40))
    items = [(k, text(k)) for k in range(7)] + [(90, None), (91, " ")]
    items.append((7, items[0][1]))
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")
    more = df.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + k, f"before {items[k][1]} after") for k in range(7)], "doc_id long, text string"))
    want = {(500 + k, k) for k in range(7)} | {(500, 7)}
    found = lambda: {(r.doc_id, r.item_id, round(r.cosine, 4), round(r.lcs, 6)) for r in decontaminate.contaminated(more, bench).collect()}
    once = found()
    assert {r[:2] for r in once} == want
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 3)
    assert found() == once  # the same space, so the same cosines
    monkeypatch.setattr(decontaminate, "FEATURES", 1 << 10)
    assert {r[:2] for r in found()} == want


def test_latent_search_misses_little_of_an_exhaustive_one(spark):
    """Recall of the cosine search: with every passage a candidate of every item, the same judge finds no more
    than a tenth of the rows that the search lacks.  Items lose up to a fifth of their words and keep their order."""
    rng = random.Random(11)
    vocab = [f"w{int(2000 * rng.random() ** 2)}" for _ in range(4000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, text(rng.randint(20, 60))) for k in range(30)]
    rows = [(k, " ".join(text(rng.randint(50, 200)))) for k in range(60)]
    for k, words in items:
        for copy in range(3):
            gone = set(rng.sample(range(len(words)), len(words) * copy // 10))
            near = [f"x{rng.randrange(9)}" if i in gone else w for i, w in enumerate(words)]
            rows.append((100 + 3 * k + copy, " ".join(text(rng.randint(0, 90)) + near + text(rng.randint(0, 90)))))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    found = lambda cosine: {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b, cosine).collect()}
    got, every = found(decontaminate.COSINE), found(-2.0)
    assert got <= every and len(every) >= 60 and len(got) >= 0.9 * len(every)
