"""Personal data, quality rules, classifiers and near-duplicates against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from strandframe.llm import fingerprint, langid, pii, quality, simhash, toxicity

WORD = re.compile("[^\x20\x09-\x0D]+")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c)
        total += v * 2 - 9 * (v > 4) if k % 2 else v
    return total % 10 == 0


def plain_base(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", lambda v: 12 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    ]
    spans = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, pattern, ok) in enumerate(rules)
             for m in re.finditer(pattern, text) if ok(m.group())]
    return [s[2] for s in sorted(spans)]


def personal_texts():
    rng = random.Random(4)
    parts = ["a.b@c.d", "a@b.c_d@e.f", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.3.4", "4111 1111 1111 1111", "4111111111111112",
             "5500-0000-0000-0004", "+1 (555) 123-4567", "+12", "+1+2 345 678 901", "call (555) 123-4567", "me (at) site (dot) org", "é", "漢", "👍", "\n", "@", "..", "-", "7",
             "token = 4111111111111111", "x4111111111111111y", "00000000000000000001.1.1.1"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [" ".join(["a@b.cd"] * 700), "1" * 3000, "a" * 20_000]


def test_personal_data(spark, documents, nothing):
    texts = personal_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rows = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want, r = plain_base(t), rows[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t[:200], want[:5])
        kinds = collections.Counter(s.split(":")[0] for s in want)
        assert all(r[f"n_{k}"] == kinds[k] for k in pii.KINDS)
        own = r["spans"].split(",") if r["spans"] else []
        assert set(want) <= set(own)
        order = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])) for s in own]
        assert order == sorted(order)
    assert pii.personal_data(documents).count() == documents.count()
    assert pii.personal_data(nothing).count() == 0


def test_reliabilities_follow_agreement():
    """Labelers that agree come out reliable; one that votes at random does not."""
    counts = [((0, 1, 1, 1, 0, 1), 900), ((0, 1, 2, 2, 0, 1), 800), ((0, 1, 1, 1, 1, 1), 100), ((0, 1, 2, 2, 1, 1), 90)]
    model = pii.learn(counts)
    good, bad = model["reliabilities"]["email"][1], model["reliabilities"]["email"][0]
    assert good[0][pii.FOR] > 0.8 > 0.2 > bad[0][pii.FOR]
    assert abs(math.log(good[2][pii.FOR] / bad[2][pii.FOR])) < 1
    weight = lambda p: sum(model["weights"].get(f, 0.0) for f in pii._active(p))
    assert weight(counts[0][0]) > 0 > weight(counts[1][0])


def test_masking(spark, documents, nothing):
    docs = spark.createDataFrame([(1, "write a@b.com or +1 (555) 123-4567!", "en", "s", 35), (2, None, None, None, None), (3, "é", "fr", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in pii.masked(docs).collect()}
    assert out[1]["text"] == "write <EMAIL> or <PHONE>!" and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] is None and out[3]["text"] == "é"
    assert pii.masked(documents).columns == documents.columns
    assert pii.masked(nothing).count() == 0


def plain_quality(text):
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_quality_counts(spark, documents, nothing):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "b", "é", " ", " ", "\n", "\x0b", "#", "|", "1", " "]) for _ in range(rng.randint(0, 400))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.quality_rules(docs.withColumn("lang", quality.F.lit("en"))).collect():
        assert tuple(r)[1:7] == plain_quality(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    texts = [r["text"] or "" for r in documents.collect()]
    got = collections.Counter(tuple(r)[1:7] for r in quality.quality_rules(documents).collect())
    assert got == collections.Counter(map(plain_quality, texts))
    assert quality.quality_rules(nothing).count() == 0 and quality.quality_rules(docs).count() == 200


def test_divergence(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    entropy = lambda x: -sum(v * math.log2(v) for v in x if v)
    want = math.sqrt(entropy([(a + b) / 2 for a, b in zip(p, q)]) - (entropy(p) + entropy(q)) / 2)
    F = quality.F
    got = spark.range(1).select(quality.jensen_shannon(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d")).first()["d"]
    assert got == pytest.approx(want)


def test_quality_keeps_prose_and_drops_symbols(spark):
    rng = random.Random(7)
    vocabulary = ["the", "of", "and", "to"] + ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    prose = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(60)]
    junk = [" ".join(w + "$$$###" for w in t.split()) for t in prose[:5]]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(prose + junk)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality.passing(docs).collect()}
    assert kept == set(range(60))
    assert quality.passing(docs).columns == docs.columns


def test_quality_drops_lists_without_common_words(spark):
    """Texts with hardly a common word are judged by words too, however long they are; prose stays."""
    rng = random.Random(11)
    common = quality.COMMON_WORDS["en"]
    word = lambda: "".join(rng.choice("aehnordtu") for _ in range(rng.randint(4, 7)))
    prose = [" ".join(rng.choice(common) if rng.random() < 0.2 else word() for _ in range(n)) for n in [120, 200, 400, 800] * 25]
    lists = [" | ".join(word() for _ in range(n)) for n in [60, 200, 1500]]
    lists.append(" | ".join([*common, *(word() for _ in range(1000))]))  # 11 common words, each once
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(prose + lists)], "doc_id long, text string, lang string")
    judged = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert not any(r["base_failed"] or r["word_distance"] is None for r in judged.values())
    assert not any(judged[i]["kept"] for i in range(100, 104))
    assert sum(judged[i]["kept"] for i in range(100)) >= 97
    assert {r["doc_id"] for r in quality.passing(docs).collect()} == {i for i, r in judged.items() if r["kept"]}


def plain_simhash(text, shingle=3):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(spark, documents, nothing):
    rows = documents.collect()
    prints = [plain_simhash(r["text"] or "") for r in rows]
    parts = plain_components(prints)
    least = {}
    for r, p in zip(rows, parts):
        if r["doc_id"] is not None:
            least[p] = min(least.get(p, r["doc_id"]), r["doc_id"])
    want = collections.Counter((r["doc_id"], f"{f:016x}", least.get(p)) for r, f, p in zip(rows, prints, parts))
    assert collections.Counter(tuple(r) for r in simhash.near_duplicates(documents).collect()) == want
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each_group(documents)
    assert kept.columns == documents.columns
    keys = [r["doc_id"] for r in kept.collect()]
    assert sorted(k for k in keys if k is not None) == sorted(set(least.values())) and keys.count(None) == 2


@pytest.mark.parametrize("largest", [4, 2048])
def test_links_join_all_close_fingerprints(spark, largest):
    """Dense groups: splitting hot keys by further blocks loses no link."""
    rng = random.Random(8)
    prints = set()
    for centre in [rng.getrandbits(64) for _ in range(5)]:
        for _ in range(60):
            p = centre
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    links = simhash.close_links(spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long"), largest=largest).collect()
    number = {simhash.signed(p): i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(number[a])] = find(number[b])
    same = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == y) for y in set(labels)}
    assert same([find(i) for i in range(len(prints))]) == same(plain_components(prints))


def plain_phrases(text):
    known, begin = set(), 0
    for end in range(1, len(text) + 1):
        if text[begin:end] not in known:
            known.add(text[begin:end])
            begin = end
    return known


def test_fingerprints(spark, documents, nothing):
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in documents.collect()))
    got = fingerprint.compare_with_next(documents, ranges=6).collect()
    assert len(got) == len(rows)
    sig = lambda t: fingerprint.smallest_hashes(plain_phrases(t))
    want = collections.Counter()
    for i, (has_key, key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][2]
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + following[:quarter]
        a, b, c = sig(text), sig(edited), sig(following)
        want[(key if has_key else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.to_text(a), fingerprint.to_text(b),
              round(fingerprint.likeness(a, b), 9), round(fingerprint.likeness(a, c), 9))] += 1
    assert collections.Counter((*tuple(r)[:5], round(r[5], 9), round(r[6], 9)) for r in got) == want
    assert fingerprint.compare_with_next(nothing).count() == 0
    alone = spark.createDataFrame([(1, "only one row")], "doc_id long, text string")
    assert fingerprint.compare_with_next(alone).first()["near_next"] == 1.0
    assert {r["fingerprint"] for r in fingerprint.fingerprints(alone.union(alone)).collect()} == {fingerprint.to_text(sig("only one row"))}


def insults(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    bad = ["zorkward", "flubbernose", "grimwort"]
    rows = []
    for i in range(500):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(len(text))
            text[at] = rng.choice(bad) + rng.choice(["", "s", "ly", "!"])
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_toxicity(spark, documents, nothing):
    rows = insults(9)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(out[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] for r, _ in held) and sum(r["held_out"] for r in out.values()) == len(held)
    assert np.mean([r["predicted"] == y for r, y in held]) >= 0.95
    model = toxicity.train([t for _, t, _ in rows], np.array([y for *_, y in rows], np.float32))
    scores = toxicity.WordScores(model["values"], toxicity.SIZES, toxicity.BUCKETS - 1, {})
    assert toxicity.score_text("you zorkwurd", scores, model) > toxicity.score_text("you sailor", scores, model)
    assert toxicity.toxicity(documents, labels).count() == documents.count()
    assert toxicity.toxicity(nothing, labels).count() == 0
    unlabelled = toxicity.toxicity(docs, labels.limit(0))
    assert {r["score"] for r in unlabelled.collect()} == {0.0}
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and 370 <= kept.count() <= 380


def test_languages(spark, documents, nothing):
    rng = random.Random(10)
    syllables = {"en": "th er ing ed wh sh", "de": "sch ei ung ä ich ü", "fr": "eau é que oi ç ê", "es": "ción ñ os ado í que"}
    rows = []
    for i in range(400):
        lang = rng.choice(list(syllables))
        text = " ".join("".join(rng.choice(syllables[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(40))
        rows.append((i, text, lang if i % 10 else None))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 + 3 ²", "de"), (None, "thersh thing", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.languages(docs).collect()}
    known = [r for r in rows[:400] if r[2] and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(out[i]["held_out"] for i, *_ in known)
    assert np.mean([out[i]["lang_pred"] == lang for i, _, lang in known]) >= 0.97
    assert all((out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[None]["held_out"] is False
    assert langid.languages(documents).count() == documents.count()
    assert langid.languages(nothing).count() == 0
    assert {r["lang_pred"] for r in langid.languages(docs.withColumn("lang", quality.F.lit(None).cast("string"))).collect()} == {"und"}


def near_copies(seed):
    """Texts with copies in which a word or a run of words is changed, and families below the limit."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(60, 300))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(1, 4)):
            changed = list(base)
            for at in rng.sample(range(len(base)), max(1, len(base) // rng.choice([30, 45, 60, 90]))):
                changed[at] = word()
            rows.append(" ".join(changed))
    rng.shuffle(rows)
    return rows


def test_no_two_kept_texts_share_four_fifths(spark):
    import corpus_pipeline

    texts = near_copies(12)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = {(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(near) > 30
    assert not [p for p in near if p[0] in kept and p[1] in kept]
    assert {i for i in range(len(texts)) if i not in kept} <= {i for i, _ in near}


def test_texts_under_one_key_are_told_apart(spark, documents, nothing):
    from strandframe.llm import resemblance

    rows = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "p q r s t u"), (2, None), (3, ""), (4, "a b c d e f"), (1, "a b c d e f"), (None, "x"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, resemblance.one_of_similar(docs).collect()), key=str) == sorted(
        [(1, "a b c d e f"), (1, "p q r s t u"), (2, None), (None, "x"), (None, "x")], key=str)
    assert resemblance.one_of_similar(documents).columns == documents.columns
    assert resemblance.one_of_similar(nothing).count() == 0


def test_large_groups_are_refined(spark):
    from strandframe.llm import resemblance

    texts = near_copies(13) + ["no word in common with any other text here"] * 3
    docs = spark.createDataFrame([(i, t, "x", 0, 1) for i, t in enumerate(texts)], "doc_id long, text string, _id string, _key int, bits int")
    kept = resemblance.one_of_similar(docs, largest=3)
    assert kept.columns == docs.columns
    kept = {r["doc_id"] for r in kept.collect()}
    sets = [resemblance.shingles(t) for t in texts]
    near = {(i, j) for i in range(len(sets)) for j in range(i) if resemblance.similarity(sets[i], sets[j]) >= 0.8}
    assert not [p for p in near if kept.issuperset(p)]
    assert {i for i in range(len(texts)) if i not in kept} <= {i for i, _ in near}


def test_one_large_family_names_few_pairs(spark):
    from strandframe.llm import resemblance

    rng = random.Random(3)
    base = ["w%d" % rng.randrange(10**6) for _ in range(200)]
    texts = []
    for i in range(600):
        changed = list(base)
        for at in rng.sample(range(200), rng.randint(1, 4)):
            changed[at] = "c%d" % rng.randrange(10**6)
        texts.append((i, " ".join(changed)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = [resemblance.shingles(r["text"]) for r in resemblance.one_of_similar(docs, largest=100).collect()]
    assert 0 < len(kept) < 60
    assert not [1 for i in range(len(kept)) for j in range(i) if resemblance.similarity(kept[i], kept[j]) >= 0.8]
