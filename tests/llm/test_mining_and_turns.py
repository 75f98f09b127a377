"""Conversation repair, phrase mining and language profiles, held against plain versions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tandem.llm import collocations, conversations, language_id

# -- conversations -----------------------------------------------------------

SPACES = " \t\n\x0b\x0c\r"


def _plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        part = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{part(conv)}:{part(turn)}".encode()) % 20
        role, text = part(role), part(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def _faults(turns):
    seen, out = set(), []
    for role, text in turns:
        bare = text.strip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


NEXT = {("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a", ("", "s"): "s"}


def _plain_repair(turns):
    """Cheapest (cost, audit) and the repaired turns, by a search over (turn, state) in that order."""
    faults = _faults(turns)
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, i, state, made = heapq.heappop(todo)
        if i == len(turns) and state in ("", "a"):
            return cost, audit, list(made)
        if (i, state) in done:
            continue
        done.add((i, state))
        grow = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[grow]
        heapq.heappush(todo, (cost + 2, audit + "I", i, grow, (*made, (name, ""))))
        if i == len(turns):
            continue
        role, text = turns[i]
        heapq.heappush(todo, (cost + 3, audit + "D", i + 1, state, made))
        if faults[i] in ("blank", "duplicate"):
            continue
        extra = int(faults[i] == "truncated")
        if (state, role[:1]) in NEXT:
            heapq.heappush(todo, (cost + extra, audit + "K", i + 1, role[:1], (*made, (role, text))))
        heapq.heappush(todo, (cost + 2 + extra, audit + "R", i + 1, grow, (*made, (name, text))))


def _plain_report(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][: conversations.HEAD].encode(), hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        said = [(role, text) for _, role, text in turns]
        numbers = [t for t, _, _ in turns if t is not None]
        faults = _faults(said)
        cost, audit, made = _plain_repair(said)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest, made)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _random_turns(n_conv, most, seed):
    random.seed(seed)
    texts = ["Yes.", "No", "", " \t", "Why?", "ok", "Good!\n", "x" * 40 + "a.", "x" * 40 + "b.", "é.", None]
    rows = []
    for conv in [None, *range(n_conv)]:
        for turn in range(random.randint(1, most)):
            rows.append((conv, random.choice([turn, turn, turn, turn + 1, None]), random.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), random.choice(texts)))
    random.shuffle(rows)
    return rows


def _check_report(spark, rows):
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copies", F.lit("clash")).withColumn("id", F.lit(7)).drop("copies")
    got = conversations.repair_report(given).collect()
    want = _plain_report(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r["conv_id"]][:-1], r["conv_id"]
    return want


def test_repair_equals_the_cheapest_edits_of_a_search(spark):
    rows = _random_turns(60, 7, 1)
    want = _check_report(spark, rows)
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = defaultdict(list)
    for r in conversations.repaired_turns(given).orderBy("conv_id", "place").collect():
        made[r["conv_id"]].append((r["role"], r["text"]))
    assert {c: m for c, m in made.items()} == {c: w[-1] for c, w in want.items() if w[-1]}


def test_runs_of_a_long_conversation_are_joined(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", 1)
    monkeypatch.setattr(conversations, "FAN", 1)
    rows = _random_turns(4, 6, 2)
    random.seed(9)
    rows += [(99, t, random.choice(["user", "assistant", "system"]), f"turn {random.randint(0, 25)}{random.choice(['.', ''])}") for t in range(45)]
    _check_report(spark, rows)


def test_damage_and_conversations_that_lose_every_row(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {t}. And?") for c in range(40) for t in range(3)]
    lost = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "Gone."))
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    damaged = conversations.damage(given)
    flat = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in damaged.collect() for _ in range(r["copies"]))
    assert flat == sorted(_plain_damage(rows))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in conversations.repair_report(damaged, given).collect()}
    want = _plain_report(_plain_damage(rows))
    assert set(got) == {*range(40), lost}
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert all(got[c] == want[c][:-1] for c in want)
    assert conversations.repair_report(given.limit(0)).count() == 0


# -- phrases -----------------------------------------------------------------


def _plain_phrases(docs, least, keep):
    counts = defaultdict(Counter)
    for lang, text in docs:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        n = sum(a for p, a in f.items() if len(p) == 1)
        rows = []
        for p, a in cand.items():
            if any(len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in cand.items()):
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(rows)[:keep]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def _random_docs(n, seed):
    random.seed(seed)
    words = ["the", "The", "of", "and", "ÉTÉ", "a", "bb", "x\x0by", "in-to", "'", "naïve", "z z", "THE"]
    glue = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "; ", "\r\n", "?", ":"]
    make = lambda: "".join(random.choice(words) + random.choice(glue) for _ in range(random.randint(0, 120)))
    docs = [(random.choice(["en", "fr", None, "und"]), random.choice([make(), make(), make(), make(), "", None])) for _ in range(n)]
    return docs + docs[:5]


def test_phrases_equal_plain_counts(spark, monkeypatch):
    docs = _random_docs(120, 4)
    for shard, block, bits in ((collocations.SHARD_BYTES, collocations.BLOCK, collocations.MOST_BITS), (400, 16, 1 << 12)):
        monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
        monkeypatch.setattr(collocations, "BLOCK", block)
        monkeypatch.setattr(collocations, "MOST_BITS", bits)
        given = spark.createDataFrame(docs, "lang string, text string").withColumn("phrase", F.lit("clash")).repartition(3)
        for least, keep in ((3, 1000), (6, 7)):
            got = sorted(tuple(r) for r in collocations.collocations(given, least=least, keep=keep).collect())
            assert got == _plain_phrases(docs, least, keep)
    assert collocations.collocations(given.limit(0)).count() == 0


def test_a_full_filter_lets_everything_through_and_changes_nothing(spark, monkeypatch):
    docs = _random_docs(60, 6)
    given = spark.createDataFrame(docs, "lang string, text string")
    monkeypatch.setattr(collocations, "filter_of", lambda frequent, width, n: np.full(64, 2**64 - 1, np.uint64))
    assert sorted(tuple(r) for r in collocations.collocations(given, least=4, keep=500).collect()) == _plain_phrases(docs, 4, 500)


def test_bitmaps_shift_over_bytes_and_stop_at_pieces():
    text = "a b a b a b a b a b a b. b a"
    data = np.frombuffer(text.encode(), np.uint8)
    shard = collocations.Shard("en", [(data, np.array([0, len(data)]))])
    ones = collocations.Bits(np.full(64, 2**64 - 1, np.uint64))
    pairs = {p: n for phrases, counts in collocations.mine(shard, ones, None) for p, n in zip(phrases.to_pylist(), counts.tolist(), strict=True)}
    assert pairs == {"a b": 6, "b a": 6}
    triples = Counter()
    for phrases, counts in collocations.mine(shard, ones, ones):
        triples.update(dict(zip(phrases.to_pylist(), counts.tolist(), strict=True)))
    assert triples == {"a b a": 5, "b a b": 5}


# -- languages ---------------------------------------------------------------


def _plain_grams(text):
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (text or "").lower())):
        line = [32, *map(ord, word), 32]
        for n in (1, 2, 3):
            for i in range(len(line) - n + 1):
                part = line[i : i + n]
                if any(c != 32 for c in part) and 32 not in part[1:-1] and not (n == 1 and part == [32]):
                    key = 0
                    for c in part:
                        key = key << 21 | c
                    out[key] += 1
    return out


def _plain_profile(grams, size):
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:size]]


SYLLABLES = {"aa": "la le mi to ra", "bb": "sch ung ver ein ß", "cc": "що не на та ї"}


def _tongue(lang, n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", ".", ", 7"]) for _ in range(n))


def test_predictions_equal_plain_profiles(spark):
    rng = random.Random(8)
    docs = [(i, _tongue(lang := rng.choice(list(SYLLABLES)), rng.randint(1, 60), i), rng.choice([lang, lang, lang, None])) for i in range(80)]
    docs += [(80, None, "aa"), (81, "", "bb"), (82, " 12 _ !", "aa"), (83, "A", None), (None, _tongue("aa", 9, 1), "aa"), (5, docs[5][1], docs[5][2])]
    docs += [(84, "LA\tle-la\n" * 400, None), (85, "one Éstanbul \U0001f600 \U0001d54f", "aa")]
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    given = spark.createDataFrame(docs, "doc_id int, text string, lang string").withColumn("gram", F.lit(1)).repartition(3)
    for size in (30, 300):
        sums = defaultdict(Counter)
        for i, text, lang in docs:
            if lang and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
                sums[lang].update(_plain_grams(text))
        ranks = {lang: {g: k for k, g in enumerate(_plain_profile(c, size))} for lang, c in sums.items()}
        got = sorted((tuple(r) for r in language_id.predict(given, held, size=size).collect()), key=lambda r: (r[0] is None, r[0] or 0))
        assert len(got) == len(docs)
        for (i, out, pred, score), (j, text, _) in zip(got, sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
            assert i == j and out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
            mine = _plain_profile(_plain_grams(text), size)
            if not mine:
                assert (pred, score) == ("und", 0.0)
                continue
            far = sorted((sum(abs(k - r[g]) if g in r else size for k, g in enumerate(mine)), lang) for lang, r in ranks.items())
            assert pred == far[0][1] and abs(score - (1 - far[0][0] / far[1][0])) < 1e-12


def test_held_out_documents_and_cases_without_profiles(spark):
    docs = [(i, _tongue(list(SYLLABLES)[i % 3], 40, i), list(SYLLABLES)[i % 3]) for i in range(60)]
    given = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    out = language_id.predict(given, held).join(given.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert out and all(r["lang"] == r["lang_pred"] for r in out)
    flipped = given.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))  # held-out labels are never read
    assert sorted(language_id.predict(flipped, held).collect()) == sorted(language_id.predict(given, held).collect())
    none = language_id.predict(given.withColumn("lang", F.lit(None).cast("string")), held).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    one = language_id.predict(given.where("lang = 'aa'"), held).collect()
    assert {r["lang_pred"] for r in one} == {"aa"} and all(0 <= r["score"] <= 1 for r in one)
    assert language_id.predict(given.limit(0), held).count() == 0


def test_ngrams_keep_to_their_rows():
    keys, rows = language_id.ngrams(pa.array(["ab", None, "", "b-é"]))
    for i, text in enumerate(["ab", "", "", "b-é"]):
        assert Counter(keys[rows == i].tolist()) == _plain_grams(text)
