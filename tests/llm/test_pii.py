import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from spanlake.llm import pii
from spanlake.llm.queries import op5_sanitisation

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(v):
    return re.sub("[^0-9]", "", v)


def valid(kind, v):
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        d = [int(c) for c in digits(v)][::-1]
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0
    return kind != "phone" or 9 <= len(digits(v)) <= 15


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        matches = list(re.finditer(pattern, text))
        for i, m in enumerate(matches):
            if valid(kind, m.group()):
                low = matches[i - 1].end() if i else 0
                high = matches[i + 1].start() if i + 1 < len(matches) else len(text)
                value = m.group().lower() if kind == "email" else m.group() if kind == "ip" else digits(m.group())
                out.append((kind, m.start(), m.end(), value, terms_near(text, low, m.start(), True) + terms_near(text, m.end(), high, False)))
    return out


def terms_near(text, low, high, left):
    cut = high - low > pii.CONTEXT
    if left:
        low = max(low, high - pii.CONTEXT)
    else:
        high = min(high, low + pii.CONTEXT)
    words, at = [], low
    for w in re.split("[ \t-\r]", text[low:high]):
        words.append((w, at))
        at += len(w) + 1
    words = words[1 if cut else 0 : -1] if left else words[1 : len(words) - (1 if cut else 0)]
    out = []
    for w, s in words:
        m = re.fullmatch(r"([^\W\d_]{3,})[.,;:!?)]*", w)
        if m:
            out.append((m.group(1).lower(), s, s + len(m.group(1))))
    return out


def brute(rows):
    found = [(d, t or "", base_spans(t or "")) for d, t in rows]
    entity, both, texts, term = Counter(), Counter(), defaultdict(set), Counter()
    total = 0
    for _, text, spans in found:
        words = re.findall("[^ \t-\r]+", text)
        total += len(words)
        term.update(w.lower().rstrip(".,;:!?)") for w in words)
        for kind, _, _, value, near in spans:
            entity[kind, value] += 1
            for t in {t for t, _, _ in near}:
                both[kind, value, t] += 1
                texts[kind, value, t].add(text)
    out = []
    for d, text, spans in found:
        marks = set()
        for kind, _, _, value, near in spans:
            ic = math.log2(total / entity[kind, value])
            for t, s, e in near:
                k = (kind, value, t)
                if len(texts[k]) >= pii.SUPPORT and ic + math.log2(both[k] / term[t]) >= pii.DISCLOSURE * ic:
                    marks.add((s, e))
        base = [f"{k}:{s}:{e}" for k, s, e, *_ in spans]
        n = Counter(k for k, *_ in spans)
        out.append((d, *(n[k] for k in BASE), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(base + [f"term:{s}:{e}" for s, e in sorted(marks)])))
    return out


CASES = [
    (1, None),
    (2, ""),
    (3, "mail a@b.c_d@e.f, x.y+z@host-1.example.org. Also @nobody and a@b"),
    (4, "ip 1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255 1.2.3 10.0.0.256"),
    (5, "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 79927398713 0000000000000"),
    (6, "call +49 (30) 123-456 78 or +1 or +12345678 or +1234567890123456, +4111111111111111"),
    (7, "Été 🎉🎉 write zoë.müller@example.com or é@x.yz +33 1 23 45 67 89 日本"),
    (7, "Été 🎉🎉 write zoë.müller@example.com or é@x.yz +33 1 23 45 67 89 日本"),
    *[(10 + i, f"Agent Blofeld, of spectre ({i}) wrote from 10.9.8.7 near volcano {'lair ' * i}and left. The the the.") for i in range(5)],
    (None, "Agent blofeld of Spectre wrote from 10.9.8.7 near volcano and left"),
    (20, "volcano tours and the volcano museum"),
    (21, "a" * 60000 + " " + "1" * 60000 + " " + "1.2 " * 20000 + "+1" + " " * 50000),
    (22, "x@y.zz " * 3000 + "9 " * 2000),
]


@pytest.mark.parametrize("rows", [CASES, []], ids=["cases", "empty"])
def test_spans_of_edge_cases(spark, folder, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, spans string, key int")
    docs.write.parquet(f"{folder}/documents.parquet")
    got = op5_sanitisation(spark, folder)
    key = lambda r: (str(r[0]), r[1:])
    found = sorted((tuple(r)[:7] for r in got.collect()), key=key)
    want = sorted(brute(rows), key=key)
    for a, b in zip(found, want):
        assert a == b
    assert len(found) == len(want)
    if rows:
        assert any("term:" in r[6] for r in want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r)[:7] for r in op5_sanitisation(spark, sf).collect()) == sorted(brute(rows))


def test_texts_are_sanitised(spark):
    docs = spark.createDataFrame([(d, t, "x") for d, t in CASES[:-2]], "doc_id long, text string, terms string")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1] is None and texts[2] == ""
    assert all("[IP]" in texts[i] and "lofeld" not in texts[i] and ". The the the." in texts[i] for i in range(10, 15))
    assert texts[20] == CASES[14][1]
    assert "10.9.8.7" not in texts[None] and "lofeld" not in texts[None]
