"""Toxicity on held-out labels; mixing against a plain projected gradient; the pipeline's stages against plain versions."""

import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tandem.llm import mixing, queries, quality_rules, secrets, toxicity
from tests.llm.test_ngram_join import brute
from tests.llm.test_text_ops import plain_base

DATA, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, label int, score double, words int, p double, tokens string, f int"
ODD = [(1, None), (2, ""), (None, "no id here"), (3, "you stupid idiot " * 3), (3, "you stupid idiot " * 3), (4, "word " * 60_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, 0.5, 2, 0.1, "t", 3) for i, t in ODD], SCHEMA)


# --- toxicity


def area(pairs):
    """The chance that a row of label 1 scores above one of label 0."""
    good, bad = [s for s, y in pairs if y == 0], [s for s, y in pairs if y == 1]
    return float(np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]))


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{MORE}/documents.parquet"), spark.read.parquet(f"{MORE}/labels.parquet")
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["score"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert 0 < sum(y for _, y in held) < len(held) and area(held) >= 0.9


def test_toxicity_ignores_held_out_labels_and_other_columns(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    flipped = labels.withColumn("toxic", F.when(fold == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "n_chars": F.lit(0)})
    score = lambda d, lab: {r["doc_id"]: r["score"] for r in toxicity.toxicity(d, lab).collect()}
    assert score(docs, labels) == score(other, flipped)


def test_toxicity_learns_from_a_bounded_number_of_rows(spark, monkeypatch):
    """A labelled id that a thousand rows share is one row of training."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet")
    one = next(r["doc_id"] for r in labels.orderBy("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5)
    many = docs.unionByName(spark.range(1000).select(F.lit(one).alias("doc_id"), F.concat(F.lit("you fool "), F.col("id").cast("string")).alias("text")))
    seen, plain = [], toxicity.learned_stems
    monkeypatch.setattr(toxicity, "learned_stems", lambda rows: seen.append(rows.count()) or plain(rows))
    got = toxicity.toxicity(many, labels, max_labelled=60)
    assert got.count() == docs.count() + 1000 and len(seen) == 1 and 0 < seen[0] <= 60


def test_toxicity_edges(spark, odd):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd, none).collect()
    assert len(rows) == len(ODD) and {r["score"] for r in rows} == {0.5}
    assert toxicity.toxicity(odd.limit(0), none).count() == 0
    got = odd.select("doc_id", toxicity.features([])(F.col("text")).alias("x")).collect()
    by = {r["doc_id"]: r["x"] for r in got}
    empty = {c: 0.0 for c in toxicity.FEATURES} | {"words": pytest.approx(np.log(2))}
    assert by[1].asDict() == by[2].asDict() == empty
    alone = spark.createDataFrame([("",)], "text string").coalesce(1).select(toxicity.features([])(F.col("text")).alias("x")).first()["x"]
    assert alone.asDict() == empty
    assert by[3]["near_you"] > 0 and by[4]["lexicon"] == 0 and by[4]["words"] == pytest.approx(np.log1p(60_001))


def plain_features(text, learned):
    text = text or ""
    low = text.lower()
    letters = r"[0-9a-z\x80-\U0010ffff]"
    words = [(m.start(), m[0]) for m in re.finditer(letters + "+", low)]
    n, chars = len(words) + 1.0, len(text.encode()) + 1.0
    insult = [w in toxicity.LEXICON for _, w in words]
    stem = [any(len(w) >= len(v) and w.startswith(v) for v in learned) for _, w in words]
    you = [i for i, (_, w) in enumerate(words) if w in toxicity.SECOND_PERSON]
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i, hit in enumerate(insult) if hit)
    raw_letter = "[0-9A-Za-z\x80-\U0010ffff]"
    return {
        "lexicon": sum(insult) / n, "learned": sum(stem) / n, "n_learned": float(sum(stem)), "distinct": float(len({w for (_, w), a, b in zip(words, insult, stem, strict=True) if a or b})),
        "near_you": near / n, "capitals": len(re.findall("[A-Z]", text)) / chars, "shouted": len(re.findall(f"(?<!{raw_letter})[A-Z]{{3,}}(?!{raw_letter})", text)) / n,
        "bangs": len(re.findall("[!?]+", text)) / n, "stops": len(re.findall("[,.:;]", text)) / n,
        "masked": len(re.findall(r"(?<=[A-Za-z\x80-\U0010ffff])[#$*@0-9]+(?=[A-Za-z\x80-\U0010ffff])", text)) / n,
        "stretched": len(re.findall(r"([a-z])\1\1+", low)) / n, "words": float(np.log1p(n)),
    }


def test_features_against_plain_python(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    texts += ["YOU absolute IDIOT!!! sh1t and st*pid ... sooo loooong", "you, you; idiots: moron?", "A1B a1b ABC1 ABCÉ ABC.", "idiot " * 20 + "you", "   ", "#$* 12 a#b", "aaa bbb" * 5, ("plain words here " * 90_000) + " you idiot" + " more words" * 200_000]
    learned = ["idio", "stupid", "plai"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3)
    for r in df.select("k", toxicity.features(learned)(F.col("text")).alias("x")).collect():
        assert r["x"].asDict() == pytest.approx(plain_features(texts[r["k"]], learned)), texts[r["k"]][:80]


def test_isotonic_against_the_minimax_formula():
    rng = np.random.default_rng(3)
    pairs = [(float(x), float(rng.random() < x)) for x in rng.choice(np.linspace(0, 1, 23), 90)]
    xs = sorted({x for x, _ in pairs})
    sums = np.array([[sum(y for v, y in pairs if v == x), sum(1 for v, _ in pairs if v == x)] for x in xs])
    mean = lambda i, j: sums[i : j + 1, 0].sum() / sums[i : j + 1, 1].sum()
    want = [max(min(mean(i, j) for j in range(k, len(xs))) for i in range(k + 1)) for k in range(len(xs))]
    steps = toxicity._isotonic(pairs)
    got = [[y for least, y in steps if least <= x][-1] for x in xs]
    assert got == pytest.approx(want)


# --- mixing


def plain_rates(a, goal, steps=60_000):
    """Projected gradient on ||A r - T||^2 with the least sure step."""
    r = np.ones(a.shape[1])
    rate = 1.0 / np.linalg.norm(a, 2) ** 2
    for _ in range(steps):
        r = np.maximum(0.0, r - rate * (a.T @ (a @ r - goal)))
    return r


@pytest.mark.parametrize("share", [(0.6, 0.3, 0.1), (0.9, 0.07, 0.03), (0.2, 0.2, 0.6), (0.98, 0.01, 0.01)])
def test_rates_reach_what_a_plain_solver_reaches(spark, share):
    rng = np.random.default_rng(7)
    tokens, p = rng.integers(1, 60, 40), rng.dirichlet((3.0, 1.0, 0.4), 40)
    soft = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(tokens, p, strict=True)], "tokens long, p array<double>")
    a = (tokens[:, None] * p).T
    goal = np.array(share) * tokens.sum()
    rates = mixing.fit_rates(soft, goal.tolist())
    rows = soft.select("tokens", "p", rates.column().alias("r")).collect()
    got = sum(np.array(r["p"]) * r["tokens"] * r["r"] for r in rows)
    assert all(r["r"] >= 0 for r in rows) and np.allclose(got, rates.totals)
    best = np.linalg.norm(a @ plain_rates(a, goal) - goal)
    # targets that can be met are, and of those that cannot the nearest totals are reached
    assert np.linalg.norm(got - goal) <= 1e-3 * tokens.sum() + best


@pytest.mark.parametrize("k", [1, 2, 5])
def test_rates_of_other_numbers_of_domains(spark, k):
    rng = np.random.default_rng(k)
    tokens, p = rng.integers(0, 60, 200), rng.dirichlet([2.0] + [1.0] * (k - 1), 200)
    soft = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(tokens, p, strict=True)], "tokens long, p array<double>")
    goal = np.array([0.5] + [0.5 / max(1, k - 1)] * (k - 1)) * tokens.sum()
    rates = mixing.fit_rates(soft, goal.tolist())
    rows = soft.select("tokens", "p", rates.column().alias("r")).collect()
    got = sum(np.array(r["p"]) * r["tokens"] * r["r"] for r in rows)
    assert np.allclose(got, goal, atol=1e-4 * tokens.sum()) and all(r["r"] == 1.0 for r in rows if not r["tokens"])


@pytest.mark.parametrize("k, n, alpha, cells", [(9, 300, 0.5, 5000), (14, 400, 1.0, 5000), (24, 600, 0.3, 5000), (24, 600, 0.3, 300)])
def test_rates_of_many_domains(spark, monkeypatch, k, n, alpha, cells):
    monkeypatch.setattr(mixing, "CELLS", cells)
    rng = np.random.default_rng(k)
    tokens, p = rng.integers(1, 60, n), rng.dirichlet([alpha] * k, n)
    soft = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p, strict=True)], "tokens long, p array<double>")
    a = (tokens[:, None] * p).T
    goal = rng.dirichlet([20.0] * k) * tokens.sum()
    rates = mixing.fit_rates(soft, goal.tolist())
    got = sum(np.array(r["p"]) * r["tokens"] * r["r"] for r in soft.select("tokens", "p", rates.column().alias("r")).collect())
    best = np.linalg.norm(a @ plain_rates(a, goal, 20_000) - goal)
    assert np.allclose(got, rates.totals) and np.linalg.norm(got - goal) <= 1e-3 * tokens.sum() + best
    assert max(map(len, (rates.whole, *rates.split, *rates.inside))) <= cells


def plain_posterior(text, domains, spark_rows):
    """Naive Bayes in plain Python: priors, bins of statistics, tempered word weights."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D.,;:!?]+", text.lower())
    runs = lambda pattern: float(len(re.findall(pattern, text)))
    n, m = len(text) + 1.0, len(words) + 1.0
    stats = {
        "length": float(np.log2(n)), "word_length": n / m, "symbols": runs("[#*$%&<>]+") / m, "capitals": runs("[A-Z]{2,}") / m,
        "digits": runs("[0-9]+") / m, "bangs": runs("[!?]+") / m, "bars": runs("[|]") / m, "line_length": n / (runs("\n") + 1.0),
    }
    hashes = {xxhash.xxh64_intdigest(w.encode(), 42) for w in words}
    hashes = {h - (1 << 64) if h >> 63 else h for h in hashes}
    z = []
    for i in range(len(domains.names)):
        s = domains.priors[i]
        for name, cuts in domains.cuts.items():
            s += domains.bins[name][i][sum(stats[name] >= c for c in cuts)]
        z.append(s + mixing.TEMPER * sum(r[f"l{i}"] for r in spark_rows if r["w"] in hashes))
    e = np.exp(np.array(z) - max(z))
    return e / e.sum()


def test_posteriors_against_plain_python(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    domains = mixing.fit_domains(spark.read.parquet(f"{MORE}/documents.parquet"), queries.domain_labels(spark, MORE), list(queries.TARGETS))
    table = domains.words.collect()
    assert table and domains.cuts
    soft, tokens, p = mixing.posteriors(docs, domains)
    rows = soft.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert np.allclose(r[p], plain_posterior(r["text"], domains, table), atol=1e-9)


def test_labels_of_absent_documents_do_not_use_up_the_sample(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = [r["doc_id"] for r in docs.select("doc_id").limit(30).collect()]
    labels = spark.createDataFrame([(i, "clean" if i % 2 else "poor") for i in ids] + [(10**9 + i, "poor") for i in range(3000)], "doc_id long, domain string")
    monkeypatch.setattr(mixing, "MAX_LABELLED", 30)
    assert mixing.fit_domains(docs, labels, ["clean", "poor"]).cuts
    marks = spark.createDataFrame([(i, i % 2) for i in ids] + [(10**9 + i, 0) for i in range(3000)], "doc_id long, toxic int")
    scores = {r["score"] for r in toxicity.toxicity(docs, marks, max_labelled=30).collect()}
    assert len(scores) > 1  # were the sample spent on absent documents, no label would be left and all scores be 0.5
    quality = marks.withColumnRenamed("toxic", "quality")
    assert isinstance(quality_rules.learn(docs, quality, max_labelled=30), quality_rules.DecisionList)


def test_mix_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = queries.op2_mixing(spark, DATA).collect()
    assert len(rows) == len(texts)
    names = list(queries.TARGETS)
    for r in rows:
        assert r["tokens"] == len(re.findall(r"[^\x20\x09-\x0D.,;:!?]+", texts[r["doc_id"]].lower()))
        assert r["rate"] >= 0 and sum(r[f"p_{k}"] for k in names) == pytest.approx(1.0)
    total = sum(r["tokens"] for r in rows)
    for k, share in queries.TARGETS.items():
        assert sum(r["tokens"] * r["rate"] * r[f"p_{k}"] for r in rows) == pytest.approx(share * total, abs=0.01 * total)


def test_mixing_edges(spark, odd):
    none = spark.createDataFrame([(1, None), (None, "clean")], "doc_id long, domain string")
    rows = mixing.mix(odd, none, {"clean": 1.0, "poor": 1.0}).collect()
    assert len(rows) == len(ODD) and all(r["p_clean"] == r["p_poor"] == 0.5 for r in rows)
    assert {r["rate"] for r in rows if r["tokens"] == 0} == {1.0}
    # documents without tokens keep rate 1 whatever the targets
    skewed = mixing.mix(odd, spark.createDataFrame([(3, "poor"), (4, "clean")], "doc_id long, domain string"), {"clean": 0.2, "poor": 0.8}).collect()
    assert {r["rate"] for r in skewed if r["tokens"] == 0} == {1.0} and len({r["rate"] for r in skewed}) > 1
    assert mixing.mix(odd.limit(0), none, {"clean": 1.0, "poor": 1.0}).count() == 0
    some = spark.createDataFrame([(3, "poor"), (4, "clean")], "doc_id long, domain string")
    out = mixing.resample(odd, some, {"clean": 1.5, "poor": 0.5})
    assert out.columns == odd.columns and out.where("doc_id = 4").count() >= 1


# --- the pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], DATA).cache())
    assert all(t.columns == docs.columns for t in tables[:-1])
    rows = [[r.asDict() for r in t.collect()] for t in tables]
    ids = [sorted(r["doc_id"] for r in t) for t in rows]
    assert ids[1] == sorted(r["doc_id"] for r in quality_rules.quality_rules(docs, labels).where("kept").collect())
    assert ids[2] == sorted(i for i, c, _ in brute([(r["doc_id"], r["text"]) for r in rows[1]]) if i == c)
    assert ids[3] == ids[2]
    before = {r["doc_id"]: r["text"] for r in rows[2]}
    spans = {r["doc_id"]: r["spans"] for r in secrets.secret_scan(tables[2]).collect()}
    for r in rows[3]:
        text, want, end = before[r["doc_id"]], "", 0
        found = sorted((int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0]), int(s.split(":")[2])) for s in spans[r["doc_id"]].split(",") if s)
        assert {(a, k, b) for a, k, b, _ in plain_base(text)} <= set(found)
        for a, k, b in found:
            if a >= end:
                want += text[end:a] + f"[{secrets.KINDS[k]}]"
            end = max(end, b)
        assert r["n_chars"] == len(r["text"]) and r["text"] == want + text[end:]
    texts = {r["doc_id"]: r["text"] for r in rows[3]}
    assert set(ids[4]) <= set(ids[3]) and all(r["text"] == texts[r["doc_id"]] for r in rows[4])
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file(queries.PIECE_MODEL))
    assert ids[5] == ids[4] and all(r["ids"] == library.encode(r["text"]) for r in rows[5])
    # clean documents are not thinned by mixing, but for what a classifier of 87 labels gets wrong
    clean = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()} & set(ids[3])
    assert len(clean - set(ids[4])) <= 0.05 * len(clean)
