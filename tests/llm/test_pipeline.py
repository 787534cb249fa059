"""The pipeline's rows against a plain version of all five stages."""

import hashlib
import math
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from linkloom.llm import mixing, pii, quality_rules

SF = "/root/testdata/sf0.001"
ITEM = "zebra quilts hang under seven copper moons while patient clerks count every silent river stone twice"
PROSE = "in the morning the baker said that it was a good day to walk along the old canal and so for an hour we went past the mill and the lock with the dog"


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def rule_facts(t):
    w = words_of(t)
    places = defaultdict(list)
    for k in range(len(w) - 7):
        places[tuple(w[k : k + 8])].append(k)
    covered = {j for at in places.values() if len(at) > 1 for k in at for j in range(k, k + 8)}
    lines = [x for x in t.split("\n") if words_of(x)]
    n, chars, symbols, repeats = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
    function = len(set(w) & set(quality_rules.FUNCTION_WORDS))
    bad = (n < 20, len(covered) > 0.25 * n, symbols > n / 10, symbols > chars / 10, repeats > 2 and repeats > 0.3 * len(lines), chars < 2.5 * n or chars > 15 * n, len(re.findall("[A-Z]", t)) > 0.3 * chars, function == 0 and n >= 20)
    good = (n >= 40, False, False, False, False, False, False, function > 1)
    return n < 20 or len(covered) > 0.3 * n, "".join("-" if b else "+" if g else "0" for b, g in zip(bad, good, strict=True))


def kept_by_rules(docs):
    """Expectation-maximisation over documents one by one, not over counts of patterns."""
    facts = [rule_facts(d["text"] or "") for d in docs]
    good = [0.02 if "-" in v else 0.98 for _, v in facts]
    for _ in range(quality_rules.ROUNDS):
        prior = (1 + sum(good)) / (2 + len(good))
        chance = []
        for k in range(len(quality_rules.RULES)):
            weight = {(v, side): 0.01 + sum((g if side else 1 - g) for g, (_, p) in zip(good, facts, strict=True) if p[k] == v) for v in "+-0" for side in (0, 1)}
            chance.append({key: x / sum(y for (_, side), y in weight.items() if side == key[1]) for key, x in weight.items()})
        odds = [math.log(prior / (1 - prior)) + sum(math.log(chance[k][v, 1] / chance[k][v, 0]) for k, v in enumerate(p)) for _, p in facts]
        good = [1 / (1 + math.exp(-max(-500, min(500, x)))) for x in odds]
    return [d for d, (failed, _), g in zip(docs, facts, good, strict=True) if not failed and g >= 0.5]


def one_of_each_group(docs):
    """Groups by links of a Jaccard similarity of 0.8 or more of distinct five-word shingles."""
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, group = [shingles(d["text"] or "") for d in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for d, g in sorted(zip(docs, group, strict=True), key=lambda x: (x[0]["doc_id"] is None, x[0]["doc_id"] or 0)):
        least.setdefault(g, d)
    return list(least.values())


def without_items(docs, items):
    def shingles(t, width):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}, len(w)

    wanted = []
    for t in items:
        n = shingles(t, 1)[1]
        if n:
            wanted.append((min(5, n), shingles(t, min(5, n))[0]))
    return [d for d in docs if not any(len(s & shingles(d["text"], width)[0]) >= 0.8 * len(s) for width, s in wanted)]


def without_personal_data(docs):
    """Fixed formats by their patterns; the rest candidate by candidate, each scored alone."""
    trees, limits = pii.model()
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = []
    for d in docs:
        t = d["text"] or ""
        base = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        base += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        base += [(m.start(), "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        base += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
        more = [s for s in pii.candidates(t) if trees.scores(pii.np.array([pii.features(t, s)]))[0] >= limits[s[1]] and not any(a <= s[0] and s[2] <= b for a, _, b in base)]
        spans = sorted(base + more, key=lambda s: (s[0], pii.KINDS.index(s[1]), s[2]))
        text, end = "", 0
        for a, kind, b in spans:
            if a >= end:
                text += t[end:a] + f"<{kind.upper()}>"
            end = max(end, b)
        text += t[end:]
        out.append({**d, "text": None if d["text"] is None else text, "n_chars": None if d["text"] is None else len(text)})
    return out


def mixed(docs):
    def topic(w):
        return next((name for name, marks in mixing.TOPICS.items() if set(marks) & set(w)), mixing.OTHER)

    cell_of = [(d["source"], d["lang"], topic(words_of(d["text"] or ""))) for d in docs]
    size = [len(words_of(d["text"] or "")) for d in docs]
    cells = defaultdict(int)
    for c, n in zip(cell_of, size, strict=True):
        cells[c] += n
    p = dict.fromkeys(cells, mixing.SHARE)
    targets = []
    for k, power in enumerate(mixing.POWERS.values()):
        own = defaultdict(int)
        for c, n in cells.items():
            own[c[k]] += n
        scale = sum(x**power for x in own.values())
        targets.append({v: mixing.SHARE * sum(cells.values()) * x**power / scale for v, x in own.items()})
    for _ in range(mixing.ROUNDS):
        for k, target in enumerate(targets):
            now = defaultdict(float)
            for c, n in cells.items():
                now[c[k]] += p[c] * n
            p = {c: x * target[c[k]] / now[c[k]] if now[c[k]] > 0 else x for c, x in p.items()}
        p = {c: min(x, 1.0) for c, x in p.items()}
    draw = lambda d, n: int(hashlib.md5(f"{'' if d['doc_id'] is None else d['doc_id']}:{n}".encode()).hexdigest()[:13], 16) / 2**52
    return [{**d, "mix_probability": p[c]} for d, c, n in zip(docs, cell_of, size, strict=True) if draw(d, n) < p[c]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small documents table with copies, a null text, a benchmark passage and personal data beside it."""
    at = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = [None, "", PROSE, PROSE, PROSE.upper(), PROSE.replace("hour", "hour or so"), f"{PROSE} {ITEM} {PROSE}", f"{PROSE} mail a.b@c.example.com or +1 (437) 555-0689 and 4111 1111 1111 1111, token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\" {PROSE[::-1]}"]
    more = spark.createDataFrame([(900_000 + k, t, None if k == 2 else "en", None if k == 3 else "web", len(t or "")) for k, t in enumerate(own)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(900_000, ITEM), (900_001, None)], "item_id long, text string")).write.parquet(f"{at}/benchmark.parquet")
    return at


def test_each_stage_and_the_whole(spark, folder):
    docs = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    plain = (kept_by_rules, one_of_each_group, lambda d: without_items(d, items), without_personal_data, mixed)
    shape = spark.read.parquet(f"{folder}/documents.parquet").schema
    for (name, stage), want_of in zip(corpus_pipeline.STAGES, plain, strict=True):
        got = {r["doc_id"]: r.asDict() for r in stage(spark, spark.createDataFrame(docs, shape), folder).collect()}
        want = {d["doc_id"]: d for d in want_of(docs)}
        assert got.keys() == want.keys() and len(got) > 0, name
        for k, d in want.items():
            assert {c: got[k][c] for c in shape.names} == {c: d[c] for c in shape.names}, (name, k)
        docs = list(want.values())
    probability = {d["doc_id"]: pytest.approx(d["mix_probability"], abs=1e-8) for d in docs}
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"]: r["mix_probability"] for r in rows} == probability and len(rows) == len(docs)
    assert {r["doc_id"]: r["text"] for r in rows} == {d["doc_id"]: d["text"] for d in docs}


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[-1] == "mix_probability"
