"""Each operator against brute force, with nulls, empty and long texts, repeated rows, clashing names and empty tables."""

import collections
import hashlib
import itertools
import random
import re
import time

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import chat_format, common, decontaminate, license_scan, mixing, pii, quality_model, quality_rules, simhash, sql, token_count, url_filter
from linkloom.llm.components import connected_components

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, n_words string, fp string, score string"
PROSE = "the quick fox and the lazy dog went to a small town where it was cold in winter and the people of that place were glad to see them come again"
ITEM = "zebra quilts hang under seven copper moons while patient clerks count every silent river stone twice"


def rows():
    texts = [None, "", " ", "one", "one two", PROSE, PROSE, PROSE.upper(), PROSE + " today", PROSE + " " + ITEM + " " + PROSE, "Released under the MIT License. " + PROSE, "Licensed under CC BY-NC 4.0.",
             "mail a.b@c.example.com or +1 (437) 555-0689, card 4111 1111 1111 1111 at 10.0.0.255 " + PROSE, "### %%% " * 40, "line one here\nline one here\n" * 10, "é " * 30 + PROSE, "word " * 9000, "x" * 50_000, "<|endoftext|> it's 中文 İ " + PROSE]
    return [(None if k == 3 else k, t, None if k == 4 else "en", None if k == 5 else f"s{k % 3}", len(t or ""), "x", "y", "z") for k, t in enumerate(texts)] + [(7, texts[7], "en", "s1", 1, "x", "y", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SHAPE)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


def by_text(frame, docs, *columns):
    """Results in the input's order; ids are unique but for two equal rows."""
    found = {r["doc_id"]: tuple(r[c] for c in columns) for r in frame.collect()}
    assert frame.count() == docs.count()
    return [(t or "", found[i]) for i, t, *_ in rows()]


def lower(t):
    return t.encode().lower().decode()


def test_license_scan(docs, none):
    for t, got in by_text(license_scan.scan(docs), docs, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels"):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at = [(k, label) for phrase, label in license_scan.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        base = ",".join(sorted({x for _, x in at}))
        assert got[:5] == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, base)
        assert set(filter(None, base.split(","))) <= set(got[5].split(","))
    assert license_scan.scan(none).count() == 0


def test_license_notice_without_base_phrase(spark):
    notice = "Header text here. Licensed under the GNU General Public License, version 3. More."
    d = spark.createDataFrame([(1, notice), (2, "the general public was licensed to use version control")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.scan(d).collect()} == {1: "gpl-3", 2: ""}


def test_every_notice_of_a_bundle_is_found(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. "
    texts = [mit + "This work is licensed under the GNU General Public License, version 3.", ". ".join(notice for _, notice, _ in license_scan.TEMPLATES)]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "gpl-3,mit", 1: ",".join(sorted({label for label, *_ in license_scan.TEMPLATES}))}


def matched(w, idf):
    """Labels and best score of a text's words, every start of every template tried."""
    common = min(idf.values()) / 2
    weight = lambda x: idf.get(x, common)
    found = {}
    for label, notice, phrases in license_scan.TEMPLATES:
        terms = notice.split()
        total = sum(map(weight, terms))
        for d in range(-len(terms), len(w)):
            at = lambda i: w[i] if 0 <= i < len(w) else None  # noqa: B023, E731
            cover = sum(weight(x) for k, x in enumerate(terms) if at(d + k) == x) / total  # noqa: B023
            off = lambda p: next(i for i in range(len(terms)) if terms[i : i + len(p)] == p)  # noqa: B023, E731
            if cover >= license_scan.MIN_COVER and all(any(all(at(d + off(p) + move + j) == x for j, x in enumerate(p)) for move in range(-2, 3)) for p in map(str.split, phrases)):  # noqa: B023
                found[label] = max(found.get(label, 0), cover)
    return found


def test_license_labels_and_scores_by_brute_force(spark):
    r = np.random.default_rng(8)
    notices, vocabulary = [n for _, n, _ in license_scan.TEMPLATES], PROSE.split()
    texts = ["", PROSE]
    for k in range(60):
        parts = []
        for n in r.choice(notices, 1 + k % 15, replace=False):
            w = n.split()
            for _ in range(k % 4):
                at = int(r.integers(len(w)))
                w[at : at + 1] = [[], [str(r.choice(vocabulary))], [w[at], str(r.choice(vocabulary))]][int(r.integers(3))]
            parts += w + list(r.choice(vocabulary, int(r.integers(0, 8))))
        texts.append(" ".join(parts))
    got = {x["doc_id"]: x for x in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    n, some = len(texts), 0
    idf = {w: np.log((1 + n) / (1 + sum(w in t.split() for t in texts))) + 1 for w in license_scan.vocabulary()}
    for k, t in enumerate(texts):
        want = matched(t.split(), idf)
        base = [label for phrase, label in license_scan.BASE if f" {phrase} " in f" {t} "]
        assert got[k]["labels"] == ",".join(sorted({*want, *base})), t
        assert abs(got[k]["score"] - min(1, max([*want.values(), float(bool(base))], default=0))) < 1e-9
        some += len(want)
    assert some > 150


def test_quality_rules(docs, none):
    for t, got in by_text(quality_rules.judge(docs), docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, covered = collections.defaultdict(list), set()
        for k in range(len(w) - 7):
            seen[tuple(w[k : k + 8])].append(k)
        for places in seen.values():
            if len(places) > 1:
                covered.update(j for k in places for j in range(k, k + 8))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        assert got[:6] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and got[6])
    assert quality_rules.judge(none).count() == 0 and quality_rules.filter_documents(none).count() == 0
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns


def test_posterior_knows_good_from_bad():
    p = quality_rules.posterior({"+000000+": 900, "+0--000+": 40, "+-00000+": 30, "+0--0-0-": 30})
    assert p["+000000+"] > 0.9 and p["+0--0-0-"] < 0.1


def brute_components(texts):
    def fp(t):
        w = t.encode().lower().split()
        shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    return [fp(t) for t in texts]


def near_groups(texts):
    """The group of each text: the least place that links of a Jaccard similarity of 0.8 of five-word shingles reach."""
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_simhash(docs, none):
    got = by_text(simhash.components(docs), docs, "fingerprint", "component_id")
    prints = brute_components([t for t, _ in got])
    label = list(range(len(prints)))
    for _ in prints:
        label = [min(label[j] for j in range(len(prints)) if bin(prints[i] ^ prints[j]).count("1") <= 2) for i in range(len(prints))]
    ids = [r[0] for r in rows()]
    for i, (_, (fp, component)) in enumerate(got):
        assert fp == f"{prints[i]:016x}"
        assert component == min((ids[j] for j in range(len(ids)) if label[j] == label[i] and ids[j] is not None), default=None)
    assert simhash.components(none).count() == 0 and simhash.keep_one(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(near_groups([t for t, _ in got])))


def test_simhash_crowded_variants(spark):
    r = np.random.default_rng(1)
    base = [int(x) for x in r.integers(-(2**62), 2**62, 3)]
    flip = lambda x, *bits: (lambda u: u - (1 << 64) if u >> 63 else u)((x & (2**64 - 1)) ^ sum(1 << b for b in bits))
    fps = sorted({*base, *(flip(base[0], b) for b in range(0, 64, 2)), *(flip(base[1], a, b) for a in range(8) for b in range(40, 44)), flip(base[2], 1, 2, 3)})
    edges = {tuple(sorted(e)) for e in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    near = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert edges <= near

    def groups(es):
        label = {x: x for x in fps}
        for _ in fps:
            for a, b in es:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert groups(edges) == groups(near)


def test_near_copies_of_many_kinds(spark):
    """Groups of near copies of all sizes, one of them large, with words replaced, appended and cut."""
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("abcdefgh"), 5))
    texts = []
    for size in (1, 1, 2, 2, 3, 5, 8, 150):
        base = [word() for _ in range(int(r.integers(80, 300)))]
        for k in range(size):
            w = list(base)
            if k % 3 == 1:
                w += [word() for _ in range(len(w) // 10)]
            elif k % 3 == 2:
                w = w[: -len(w) // 12]
            for _ in range(k and 1):
                w[int(r.integers(len(w)))] = word()
            texts.append(" ".join(w))
    d = spark.createDataFrame([(len(texts) - k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    kept = [x["doc_id"] for x in simhash.keep_one(d).collect()]
    group = near_groups(texts[::-1])
    assert {group[k - 1] for k in kept} == set(group)  # one of each stays at least
    assert len(kept) - len(set(group)) <= 0.05 * (len(texts) - len(set(group)))


def test_short_texts_are_copies_only_if_equal(spark):
    texts = ["a b c", "A  b\nc ", "a b d", "a b", "", " ", None, "a b c d e", "a b c d f"]
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(x["doc_id"] for x in kept.collect()) == [0, 2, 3, 4, 7, 8]


def test_components_of_chain_star_and_loops(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (None, 3), (61, 60), (60, 61)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(62)}, **{100 + k: 100 for k in range(50)}}


def test_chat(spark):
    data = [(1, 0, "system", "s # \\h <x>"), (1, 1, "user", None), (1, 2, "assistant", "</turn>\n### user: a"), (1, 3, "user", "b"), (1, 4, "assistant", "c: \\"), (1, 5, "user", "tail"), (2, 0, "user", "only"), (3, None, "assistant", "n"), (3, 1, None, "r"), (1, 2, "assistant", "</turn>\n### user: a")]
    d = spark.createDataFrame([(*r, "extra") for r in data], "conv_id long, turn long, role string, text string, example string")
    examples = chat_format.expand(d)
    got = {r["conv_id"]: r for r in chat_format.digest(examples).collect()}
    for conv in (1, 2, 3):
        turns = sorted([r[1:] for r in data if r[0] == conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        body = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(turns), hashlib.sha256(body.encode()).hexdigest())
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert examples.filter("conv_id = 1").count() == 4  # three replies and the tail
    assert chat_format.digest(chat_format.expand(d.limit(0))).count() == 0


def test_pii(docs, none):
    for t, got in by_text(pii.find(docs), docs, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"):
        base = pii.base_spans(t)
        assert got[4] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for a, k, b in base} <= set(got[5].split(","))
    assert pii.find(none).count() == 0 and pii.redact(none).count() == 0
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    text = clean.filter("doc_id = 12").head()
    assert "@" not in text["text"] and "<EMAIL>" in text["text"] and "<CARD>" in text["text"] and text["n_chars"] == len(text["text"])


def test_pii_numbers_side_by_side():
    trees, limits = pii.model()
    found = lambda t: [t[a:b] for a, _, b in pii.all_spans([t], trees, limits)[0][1]]
    assert found("call 415-555-0132 415-555-0199") == ["415-555-0132", "415-555-0199"]
    assert found("123-45-6789 987-65-4321 111-22-3333") == ["123-45-6789", "987-65-4321", "111-22-3333"]
    assert found("2024-05-01 415-555-0132") == ["415-555-0132"]
    assert found("tel 415 555 0132 415 555 0199") == ["415 555 0132", "415 555 0199"]
    assert found("fax (415) 555-0132 (415) 555-0199") == ["415) 555-0132", "415) 555-0199"]
    assert found("on 2024-05-01 2024-05-02 2024-05-03") == []


def test_pii_long_secrets_and_addresses_after_lengthening_letters():
    trees, limits = pii.model()
    found = lambda t: [(kind, t[a:b]) for a, kind, b in pii.all_spans([t], trees, limits)[0][1]]
    secret = "b44e15e0.9fd311c3+" * 34
    assert ("secret", secret) in found(f"token={secret} end")
    assert ("address", "anna [AT] example [dot] com") in found("\u0130" * 600 + " mail anna [AT] example [dot] com")


def test_pii_thresholds_and_planted_spans():
    trees, limits = pii.model()
    assert all(0 < x < 1 for x in limits.values()) and len(set(limits.values())) == len(limits)
    found = lambda t: [(kind, t[a:b]) for a, kind, b in pii.all_spans([t], trees, limits)[0][1]]
    assert found("2021 (437) 555-0689 x") == [("number", "437) 555-0689")] and found("2024 10 11 12 13") == []
    assert found("password: hunter2secret") == [("secret", "hunter2secret")]
    long = "x" * 300
    assert found(f"mail {long} [at] {long} [dot] com") == [("address", f"{long} [at] {long} [dot] com")]
    hits = collections.Counter()
    made = pii.examples(600, seed=99)
    for text, span, label in made:
        start = span[0] + (text[span[0]] == "(")  # a number's span begins at its first digit
        hits[span[1], label, any(a <= start and span[2] <= b for a, _, b in pii.all_spans([text], trees, limits)[0][1])] += 1
    for kind in pii.KINDS[4:]:
        assert hits[kind, 1, True] >= 0.95 * (hits[kind, 1, True] + hits[kind, 1, False]), kind
        assert hits[kind, 0, True] <= 0.1 * (hits[kind, 0, True] + hits[kind, 0, False]), kind
    scores, labels = np.array([0.9, 0.8, 0.8, 0.3, 0.1]), np.array([1.0, 1, 1, 0, 0])
    assert pii.threshold(scores, labels) == pytest.approx(0.8) and pii.threshold(scores, 0 * labels) == 1.1


def test_pii_base_patterns_and_secrets():
    r = np.random.default_rng(2)
    texts = ["".join(r.choice(list("ab.@1203+-() 9\n%é"), r.integers(0, 60))) for _ in range(1500)]
    email, ip, card, phone = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))
    n = lambda s: re.sub("[^0-9]", "", s)
    for t in texts:
        want = [(m.start(), "email", m.end()) for m in email.finditer(t)] + [(m.start(), "ip", m.end()) for m in ip.finditer(t) if all(int(p) < 256 for p in m[0].split("."))]
        want += [(m.start(), "card", m.end()) for m in card.finditer(t) if 12 <= len(n(m[0])) <= 19 and pii.luhn(n(m[0]))] + [(m.start(), "phone", m.end()) for m in phone.finditer(t) if 9 <= len(n(m[0])) <= 15]
        assert pii.base_spans(t) == sorted(want, key=pii._order)
    trees, limits = pii.model()
    (_, spans), (_, clean) = pii.all_spans(['x token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" y', PROSE], trees, limits)
    assert [k for _, k, _ in spans] == ["secret"] and not clean


def test_token_count(docs, none):
    library = token_count.library(token_count.vocabulary_text())
    for t, got in by_text(token_count.count(docs), docs, "n_bytes", "n_tokens", "over_limit"):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert got == (len(t.encode()), n, n > 2048)
    assert token_count.count(none).count() == 0


def test_token_count_random_texts():
    text = token_count.vocabulary_text()
    library = token_count.library(text)
    counter, r = token_count.Counter(text, token_count.whole_tokens(library)), np.random.default_rng(3)
    texts = ["".join(r.choice(list("abcXYZ'sdre ll19²½µªº—’\n\t\x0b\x1c\x85\xa0É ßŸŉſΣςσİ中🙂<|>_#%.-"), r.integers(0, 50))) for _ in range(3000)]
    assert counter.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    mixed = [" ".join(r.choice(["中文", "plain", "it's", "Ελλάς", "İstanbul", "x<|endoftext|>y", "हिन्दी", "naïve", "🙂", "e\u0301", "\u0301"], 12)) for _ in range(500)]
    assert counter.count(mixed) == [len(e.ids) for e in library.encode_batch(mixed, add_special_tokens=False)]
    assert not any("plain" in p for p in counter.odd)


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "lazy dog"), (4, "nowhere to be found in any of these texts at all")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in decontaminate.find(docs, items).collect()}
    want = {}
    for i, t, *_ in rows():
        for item, text in ((1, ITEM), (3, "lazy dog"), (4, "nowhere to be found in any of these texts at all")):
            w, v = re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(t or "")), text.lower().split()
            k = min(5, len(v))
            own, held = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            if len(own & held) >= 0.8 * len(own):
                want[i, item] = (len(own & held), len(own))
    assert got == want and (9, 1) in got
    db = duckdb.connect()
    db.register("documents", docs.filter("doc_id is not null").toPandas())
    db.register("benchmark", items.toPandas())
    assert {r[:2]: r[2:4] for r in db.execute(sql.DECONTAMINATION).fetchall()} == {k: v for k, v in want.items() if k[0] is not None}
    assert decontaminate.find(none, items).count() == 0 and decontaminate.find(docs, items.limit(0)).count() == 0
    kept = decontaminate.remove(docs, items.filter("item_id = 1"))
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1


def test_contained_share_of_items_of_all_sizes(spark):
    """Items of 1 to 300 words, whole, edited, scattered and cut, inside long documents."""
    r = np.random.default_rng(5)
    word = lambda: "".join(r.choice(list("abcdefghij"), 4))
    items = [[word() for _ in range(n)] for n in (1, 3, 5, 6, 9, 16, 20, 33, 64, 120, 300)]
    docs = []
    for k, w in enumerate(items * 4):
        v = list(w)
        if k % 4 == 1 and len(v) > 8:
            v[len(v) // 2] = word()
        if k % 4 == 2:
            v = v[: max(1, int(len(v) * 0.83))]
        if k % 4 == 3:
            v = v[: len(v) // 2 + 4] + [word() for _ in range(500)] + v[len(v) // 2 :]
        docs.append(" ".join([word() for _ in range(400)] + v + [word() for _ in range(200)]))
    found = decontaminate.find(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"))
    want = {}
    for i, t in enumerate(docs):
        v = t.split()
        for j, w in enumerate(items):
            k = min(5, len(w))
            own, held = {tuple(w[x : x + k]) for x in range(len(w) - k + 1)}, {tuple(v[x : x + k]) for x in range(len(v) - k + 1)}
            if len(own & held) >= 0.8 * len(own):
                want[i, j] = (len(own & held), len(own))
    assert {(x["doc_id"], x["item_id"]): (x["n_shared"], x["n_item"]) for x in found.collect()} == want
    assert 20 < len(want) < len(docs)


def test_sketches_lose_no_item():
    for m in range(1, 400):
        missed, hits = m - decontaminate.needed(m), min(decontaminate.hits_of(m), decontaminate.needed(m))
        assert decontaminate.needed(m) >= 0.8 * m > decontaminate.needed(m) - 1 and missed + hits <= m


def test_decontamination_of_repeated_and_text_ids(spark):
    docs = spark.createDataFrame([("a", ITEM), ("a", ITEM + " end"), ("b", PROSE), (None, ITEM)], "doc_id string, text string")
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, "lazy dog")], "item_id long, text string")
    assert sorted((x["doc_id"] or "", x["item_id"] or 0) for x in decontaminate.find(docs, items).collect()) == [("", 1), ("", 1), ("a", 1), ("a", 1), ("a", 1), ("a", 1), ("b", 0)]
    assert decontaminate.remove(docs, items).count() == 0


def test_mixing(docs, none):
    got = mixing.weigh(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["probability"] <= 1 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    assert mixing.sample(docs).columns == [*docs.columns, "mix_probability"] and mixing.sample(none).count() == 0


def test_mixing_reaches_targets(spark):
    data = [(k, "w " * 20, f"l{k % 2}", "big" if k % 3 else "small") for k in range(3000)]
    d = mixing.weigh(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).toPandas()
    mass = (d.n_tokens * d.probability).groupby(d.source).sum()
    assert abs(mass["big"] / mass["small"] - 2**0.5) < 0.01 and abs(d.kept.mean() - 0.5) < 0.04


def test_url_filter(spark):
    link = '<link rel="canonical" href="{}">'
    data = [(1, "http://a.net/x", link.format("https://Q.example.org/es/1")), (2, "https://b.net/y#f", '<meta http-equiv=refresh content="0; url=http://a.net/x">'), (3, "http://z.com/fr/1", link.format("/de/9")), (4, "http://c.net", None), (5, None, None), (6, "http://c.org/es/2", link.format("http://b.net/y")), (7, "no host", "canonical"), (8, "HTTP://EXAMPLE.org?q", ""), (4, "http://c.net", None)]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got == {1: ("a.net", "/x", None, "block"), 2: ("b.net", "/y", None, "block"), 3: ("z.com", "/fr/1", "com/fr/", "allow"), 4: ("c.net", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("c.org", "/es/2", "org/", "allow"), 7: ("", "", None, "allow"), 8: ("example.org", "", None, "allow")}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_filter_with_clashing_names_and_long_html(spark):
    link = "x" * 300_000 + '<link rel="canonical" href="http://q.com/de/1">'
    rows = [(1, "http://a.net/x", link), (2, "http://b.net/y", None)]
    names = "host path rule verdict node label alias_blocked a b u v m target r".split()
    d = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("z").alias(n) for n in names])
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(d).collect()} == {1: "block", 2: "allow"}


def test_chat_without_id(spark):
    d = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in chat_format.digest(chat_format.expand(d)).collect()] == [(None, 2, 1)]


def test_mixing_by_a_given_topic_and_of_an_empty_table(spark, none):
    data = [(k, "w " * 10, "en", "s", ("a", "b", "b", "b")[k % 4]) for k in range(2000)]
    d = mixing.weigh(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, subject string"), topic="subject").toPandas()
    mass = (d.n_tokens * d.probability).groupby(d.topic).sum()
    assert abs(mass["b"] / mass["a"] - 3**0.9) < 0.01 and mixing.weigh(none).count() == 0


def test_quality_model(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    real, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net = quality_model.train(real, labels)
    d = quality_model.score(real, net).toPandas().merge(labels.toPandas(), on="doc_id")
    d = d[d.held_out]
    pos, neg = d.score[d.quality == 1].values, d.score[d.quality == 0].values
    assert (pos[:, None] > neg).mean() > 0.85
    s = [r["score"] for r in quality_model.score(docs, net).collect()]
    assert len(s) == docs.count() and all(0 <= x <= 1 for x in s)
    assert quality_model.score(none, net).count() == 0
    assert quality_model.train(real, labels.filter("quality = 1")) == 1.0
    assert quality_model.train(real, labels.limit(0)) == 0.5
    twice = labels.filter("quality = 1").unionByName(labels.filter("quality = 1").withColumn("quality", F.lit(0)))
    assert quality_model.train(real, twice) == 0.0


def test_chunks_cover_the_text():
    for n in (0, 1, 255, 256, 257, 1000, 5000):
        c = quality_model.chunks(bytes(k % 250 + 1 for k in range(n)))
        assert c.shape[1] == quality_model.CHUNK and len(c) >= max(1, n // quality_model.CHUNK)
        assert bytes(c[-1]).rstrip(b"\0")[-1:] == (bytes([(n - 1) % 250 + 1]) if n else b"")


def test_pipeline_stages(spark, docs):
    frame = docs.drop("n_words", "fp", "score")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, "/root/testdata/sf0.001")
        assert out.columns[: len(frame.columns)] == frame.columns, name
        assert out.count() <= docs.count()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_stages_with_clashing_names(spark, docs):
    names = "row at id fp votes f d label least first any lo hi n kept posterior probability mix_probability r_source tokens item_id value topic copy keys node key hits item marked".split()
    plain = docs.drop("n_words", "fp", "score")
    clashing = plain.select("*", *[F.lit("z").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        got, want = (stage(spark, d, "/root/testdata/sf0.001") for d in (clashing, plain))
        assert len(set(got.columns)) == len(got.columns) == len(clashing.columns), name
        assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count(), name


def test_coded_marks_repeats():
    r = np.random.default_rng(6)
    x = r.integers(0, 4, (20, quality_model.CHUNK)).astype(np.uint8)
    got = quality_model.coded(x)
    for row, out in zip(x, got, strict=True):
        for i in range(len(row)):
            again = any(i - lag >= 3 and (row[i - 3 : i + 1] == row[i - lag - 3 : i - lag + 1]).all() for lag in quality_model.LAGS)
            assert out[i] == row[i] + 256 * (again and row[i] > 0)
    assert got.max() > 255 and not quality_model.coded(np.zeros((2, quality_model.CHUNK), np.uint8)).any()


def test_near_dedup_loses_no_link_of_a_large_group(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(4000)]
    base, rows = [rng.choice(words) for _ in range(60)], []
    for k in range(240):
        own = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            own[rng.randrange(len(own))] = f"x{k}"
        rows.append(own + [f"y{k}-{i}" for i in range(rng.choice([0, 0, 3, 7]))] if k % 2 else own[: rng.choice([52, 56, 60])])
    rows += [[rng.choice(words) for _ in range(30)] + base[:20] for _ in range(40)]
    texts = [" ".join(r) for r in rows]
    sets = [simhash.shingles(t.encode()) for t in texts]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if label[i] != label[j] and simhash.alike(sets[i], sets[j]):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_near_dedup_takes_no_texts_for_pairs_that_sketches_rule_out(spark, monkeypatch):
    rng = random.Random(12)
    words = lambda n: [f"{rng.getrandbits(28):x}" for _ in range(n)]
    base = words(700)
    rows = [base + words(500) for _ in range(60)]
    rows.append(rows[0][:600] + ["changed"] + rows[0][601:])
    whole, verified = [], simhash._verified

    def counted(pairs, *rest):
        if len(rest) == 1:
            whole.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(simhash, "_verified", counted)
    kept = simhash.keep_one(spark.createDataFrame([(k, " ".join(r)) for k, r in enumerate(rows)], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(60))
    assert sum(whole) <= 100  # 1,829 pairs have enough first shingles in common


def test_sketches_rule_out_no_alike_texts():
    r = np.random.default_rng(13)
    for n in (1, 2, 5, 40, 300, 5000):
        for share in (0.0, 0.4, 0.7, 0.88, 0.89, 0.9, 0.95, 1.0):
            for stretch in (1.0, 0.9, 1.2):
                same, a, b = (r.integers(-(1 << 63), 1 << 63, int(k)) for k in (share * n, (1 - share) * n, (1 - share) * n * stretch))
                x, y = np.unique(np.concatenate((same, a))), np.unique(np.concatenate((same, b)))
                may = simhash.may_be_alike(simhash.sketch(x), simhash.sketch(y))
                assert may or not simhash.alike(set(x.tolist()), set(y.tolist()))
                assert not (may and n >= 300 and share <= 0.4)
    crowded = np.arange(2000, dtype=np.int64) << 20
    assert simhash.sketch(crowded) == b"" and simhash.may_be_alike(b"", simhash.sketch(r.integers(0, 1 << 62, 2000)))


def test_written_tables_leave_no_shuffle_files(spark):
    found = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split() if "shuffle_" in f}
    before = found()
    out = common.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if not found() - before:
            break
        time.sleep(0.1)
    assert not found() - before
    assert out.count() == 7 and spark.conf.get(common.CLEANUP, "false") == "false"
