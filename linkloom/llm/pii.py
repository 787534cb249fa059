r"""Personal data by candidates and gradient boosting.

High-recall generators propose spans, which may overlap; boosted trees score each from its format and
its context; a threshold for each kind, set for precision on examples that neither fitted nor calibrated the
trees, selects what is redacted. Spans that
the fixed formats below find (email, ip, card, phone) always stay.

There are no labelled spans, so the trees learn from examples made by a fixed rule (``examples``):
formats of each kind in contexts of either class. They are fitted in about a second on the driver and
go to the executors as a few kilobytes.

Every generator is linear in the text: each either starts at a rare character or consumes whole runs.

Defined cases: null and empty texts have no spans; texts and spans of any length are taken whole; positions are code points, ends exclusive; ties in
start go by kind as listed; repeated rows give repeated rows; an empty table gives an empty table;
columns beside ``doc_id`` and ``text`` are not read, and ``redact`` hands them through, with ``n_chars``
counted anew where there is one.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .trees import Boosted

KINDS = ("email", "ip", "card", "phone", "address", "number", "secret", "account")
BASE_KINDS = KINDS[:4]
RECALL, PRECISION = 0.99, 0.98  # that a kind's threshold gives on the examples kept back for thresholds

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9]++(?:(?:\.[0-9]++){3})?")  # takes whole runs, so a long run is read once
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]")
_SIGN = re.compile(r"[\[(]at[\])]", re.I)
_DOTTED = re.compile(r" ?[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)++", re.I)
_NUMBER = re.compile(r"[0-9](?:[ ().-]{0,2}[0-9])++")
_BLANKS = re.compile(r"[^ ]++")
_SHAPES = re.compile(r"(?<![0-9])[0-9]{3}[ ().-]{1,2}(?:[0-9]{3}|[0-9]{2})[ ().-]{1,2}[0-9]{4}(?![0-9])")
_NAMED = re.compile(r"(?:token|secret|password|passwd|api[_-]?key|auth|access[_-]?key)[\"']? ?[:=] ?[\"']?([^\s\"',;]{6,}+)", re.I)
_CODE = re.compile(r"[A-Za-z0-9_/+-]{20,}+")
_ACCOUNT = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")
_CUES = ("tel", "phone", "call", "fax", "mobile", "ssn", "social", "token", "secret", "password", "key", "iban", "account", "mail", "contact", "order", "page", "version", "isbn", "id", "total", "commit", "sha", "md5")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches that don't overlap: each starts where the run before its @ does, or the last match ended."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                found.append((start, end))
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed formats; matches that fail their test are dropped and not tried again."""
    spans = [(a, "email", b) for a, b in emails(text)]
    if _SOME.search(text):
        for m in _IP.finditer(text):
            parts = m[0].split(".")
            if len(parts) == 4 and all(len(q := p.lstrip("0")) < 4 and int(q or 0) <= 255 for p in parts):
                spans.append((m.start(), "ip", m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                spans.append((m.start(), "card", m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    spans.append((m.start(), "phone", m.end()))
    return sorted(spans, key=_order)


def _order(span: tuple[int, str, int]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[1]), span[2]


def numbers(text: str) -> set[tuple[int, int]]:
    """Spans of 7 to 19 digits; they overlap where a run may hold several numbers.

    Proposed are each run of digits with up to two separators between them, its parts between blanks, and what
    in it is shaped 3-3-4 or 3-2-4. No two such shapes overlap by whole groups, so leftmost matches are all.
    """
    found = set()
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        found.add(m.span())
        for part in _BLANKS.finditer(text, m.start(), m.end()):
            inner = text[part.start() : part.end()]
            left = len(inner) - len(inner.lstrip("().-"))
            found.add((part.start() + left, part.start() + len(inner.rstrip("().-"))))
        found.update(x.span() for x in _SHAPES.finditer(text, m.start(), m.end()))
    return {(a, b) for a, b in found if 7 <= len(_digits(text[a:b])) <= 19}


def addresses(text: str) -> list[tuple[int, str, int]]:
    """Spans like ``name [at] domain [dot] com``. Names end at the sign before, so each is walked through once."""
    found = []
    for m in _SIGN.finditer(text):
        end = _DOTTED.match(text, m.end())
        stop = m.start() - (text[m.start() - 1 : m.start()] == " ")
        start = stop
        while start and text[start - 1] in _LOCAL:
            start -= 1
        if end and start < stop:
            found.append((start, "address", end.end()))
    return found


def candidates(text: str) -> list[tuple[int, str, int]]:
    """What the high-recall generators propose beyond the fixed formats; spans may overlap."""
    found = addresses(text)
    if _SOME.search(text):
        found += [(a, "number", b) for a, b in numbers(text)]
        found += [(m.start(), "secret", m.end()) for m in _CODE.finditer(text) if any("0" <= c <= "9" for c in m[0])]
        found += [(m.start(), "account", m.end()) for m in _ACCOUNT.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), "secret", m.end(1)) for m in _NAMED.finditer(text)]
    return sorted(set(found), key=_order)


def features(text: str, span: tuple[int, str, int]) -> list[float]:
    start, kind, end = span
    s, before, after = text[start:end], text[max(0, start - 24) : start].lower(), text[end : end + 1]
    digits, letters = sum("0" <= c <= "9" for c in s), sum(c.isalpha() for c in s)
    chars = np.unique(np.frombuffer(s.encode("utf-32-le"), np.uint32), return_counts=True)[1] / max(1, len(s))
    groups = re.findall(r"[0-9]+", s)
    return [
        *(float(kind == k) for k in KINDS[4:]), len(s), digits, letters, len(s) - digits - letters, float(-(chars * np.log2(chars)).sum()), len(chars), digits / len(s),
        sum(c.isupper() for c in s) / len(s), float(luhn(_digits(s))) if digits else 0.0, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), float("(" in s), s.count("-"), s.count("."),
        float(bool(re.fullmatch(r"[0-9a-f]+", s))), float(before[-1:].isalnum()), float(after.isalnum()), float(before.rstrip(" \"'")[-1:] in ("=", ":")), *(float(c in before) for c in _CUES),
    ]


def examples(n: int = 5000, seed: int = 7) -> list[tuple[str, tuple[int, str, int], int]]:
    """(text, span, label) made by a fixed rule: half are personal data in fitting contexts."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    code = lambda k, a="0123456789abcdef": "".join(r.choice(a) for _ in range(k))
    word = lambda: "".join(r.choice("aeiounrstlhd") for _ in range(r.randint(2, 9)))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    good = [
        ("number", lambda: r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"]), ["tel ", "phone: ", "call ", "", "fax "]),
        ("number", lambda: f"{num(3)}-{num(2)}-{num(4)}", ["ssn ", "social security ", "ssn: "]),
        ("secret", lambda: r.choice([code(40), code(32), code(64)]), ['token = "', "secret: ", "api_key=", 'key = "', "password="]),
        ("secret", lambda: code(r.randint(20, 48), alnum), ['token = "', "secret=", "api_key: ", "access_key="]),
        ("secret", lambda: word() + num(r.randint(1, 4)) + r.choice(["", word(), "!"]), ["password: ", "password=", "passwd: ", 'password = "']),
        ("address", lambda: f"{word()} [at] {word()} [dot] com", ["mail ", "", "contact "]),
        ("account", lambda: r.choice("DE FR ES GB".split()) + num(2) + " " + " ".join(num(4) for _ in range(4)), ["iban ", "account ", ""]),
    ]
    bad = [
        ("number", lambda: num(r.randint(7, 19)), ["order ", "page ", "id ", "total ", ""]),
        ("number", lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", ["on ", "date ", ""]),
        ("number", lambda: r.choice([f"{num(2)}.{num(3)}.{num(3)}", f"{num(3)} {num(3)} {num(3)}"]), ["version ", "total ", ""]),
        ("number", lambda: " ".join(num(r.randint(1, 4)) for _ in range(r.randint(4, 6))), ["", "table ", "total ", "on "]),
        ("number", lambda: f"{r.randint(1900, 2030)} " + r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}"]), ["", "in ", "call "]),
        ("number", lambda: f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", ["isbn ", "isbn: ", ""]),
        ("secret", lambda: r.choice([code(40), code(32)]), ["commit ", "sha ", "md5 "]),
        ("secret", lambda: "_".join(word() for _ in range(4)) + num(1), ["", "see "]),
        ("secret", lambda: "/".join(word() for _ in range(5)) + num(2), ["", "page "]),
        ("secret", lambda: word() + word(), ["password: ", "token: "]),
        ("address", lambda: f"{word()} (at) {word()} (dot) {word()}", ["meet ", "look "]),
        ("account", lambda: code(2, "QXZ") + num(2) + code(r.choice([8, 12]), "ABCDEFGH0123"), ["id ", "version "]),
    ]
    out = []
    for k in range(n):
        kind, make, contexts = r.choice(good if k % 2 else bad)
        head = " ".join(word() for _ in range(3)) + " " + r.choice(contexts)
        s = make()
        tail = '"' if head.endswith('"') else ""
        out.append((f"{head}{s}{tail} {word()}", (len(head), kind, len(head) + len(s)), k % 2))
    return out


def threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle, by odds, of the scores that give PRECISION and RECALL; without such the least that gives PRECISION; else over 1."""
    order = np.argsort(-scores, kind="stable")
    p, found = scores[order], labels[order].cumsum()
    whole = np.append(p[1:] < p[:-1], True)  # equal scores are on one side
    sure = np.flatnonzero((found >= PRECISION * np.arange(1, len(p) + 1)) & whole)
    if not len(sure):
        return 1.1
    enough = sure[found[sure] >= RECALL * found[-1]]
    odds = lambda k: np.log(p[k] / (1 - p[k]))
    return float(1 / (1 + np.exp(-(odds(enough[0]) + odds(enough[-1])) / 2))) if len(enough) else float(p[sure[-1]])


@functools.cache
def model() -> tuple[Boosted, dict[str, float]]:
    """The trees, and each kind's threshold. Of the examples three in five fit the trees, one calibrates, one sets thresholds."""
    made = examples()
    x, y = np.array([features(t, s) for t, s, _ in made]), np.array([label for *_, label in made], float)
    kinds, fold = np.array([span[1] for _, span, _ in made]), np.arange(len(y)) // 2 % 5
    trees = Boosted().fit(x[fold > 1], y[fold > 1]).calibrate(x[fold == 1], y[fold == 1])
    p = trees.scores(x)
    return trees, {kind: threshold(p[own], y[own]) for kind in KINDS[4:] for own in [(fold == 0) & (kinds == kind)]}


def all_spans(texts: list[str], trees: Boosted, limits: dict[str, float]) -> list[tuple[list, list]]:
    """(fixed, all) spans of each text; the candidates of all texts are scored together. What stands in a span of its kind is left out."""
    fixed = [base_spans(t) for t in texts]
    proposed = [(k, s) for k, t in enumerate(texts) for s in candidates(t)]
    every = [list(b) for b in fixed]
    if proposed:
        p = trees.scores(np.array([features(texts[k], s) for k, s in proposed]))
        reach: dict[tuple[int, str], int] = {}  # how far the spans of a text and kind go that are taken
        for (k, s), score in sorted(zip(proposed, p, strict=True), key=lambda x: (x[0][0], x[0][1][0], -x[0][1][2])):
            if score >= limits[s[1]] and s[2] > reach.get((k, s[1]), 0) and not any(a <= s[0] and s[2] <= b for a, _, b in fixed[k]):
                every[k].append(s)
                reach[k, s[1]] = s[2]
    return [(b, sorted(e, key=_order)) for b, e in zip(fixed, every, strict=True)]


def _written(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


_OUT = "struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base:string,spans:string>"
_CHUNK = 64  # texts whose candidates are scored at once


def _chunks(texts: pd.Series):
    for at in range(0, len(texts), _CHUNK):
        yield [t or "" for t in texts.iloc[at : at + _CHUNK]]


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the fixed kinds, their digest ``base_sha256``, and all ``spans``."""
    trees, limits = model()

    @F.pandas_udf(_OUT)
    def spans_of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for part in _chunks(texts):
            for base, every in all_spans(part, trees, limits):
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in BASE_KINDS), _written(base), _written(every)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    found = docs.select("doc_id", spans_of(C.text_of()).alias("s"))
    return found.select("doc_id", "s.n_email", "s.n_ip", "s.n_card", "s.n_phone", F.sha2(F.col("s.base").cast("binary"), 256).alias("base_sha256"), "s.spans")


def redacted(text: str, spans) -> str:
    """The text with each run of overlapping spans replaced by its first kind in angle brackets."""
    out, end = [], 0
    for a, kind, b in spans:
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``."""
    trees, limits = model()

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(t, every) if every else t for part in _chunks(texts) for t, (_, every) in zip(part, all_spans(part, trees, limits), strict=True)], dtype=object)

    out = docs.withColumn("text", F.when(F.col("text").isNotNull(), clean(C.text_of())))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(C.table(spark, sf_dir, "documents"))
