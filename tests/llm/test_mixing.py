import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from spanlake.llm import mixing
from spanlake.llm.mixing import Mix


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def brute(rows, mix):
    """Draws of (id, source, text): a count per (id, source, text)."""
    tag = lambda s: "" if s is None else "=" + s
    size = lambda t: len(re.findall("[^ \t-\r]+", t or ""))
    tokens = Counter()
    for _, s, t in rows:
        tokens[tag(s)] += size(t)
    tokens = {s: n for s, n in tokens.items() if n}
    total = sum(tokens.values())
    budget = total if mix.budget is None else mix.budget

    def share(k):
        power = {s: math.exp(k / mixing.GRID * math.log(n / total)) for s, n in tokens.items()}
        z = sum(power.values())
        return {s: p / z for s, p in power.items()}

    def entropy(k):
        return -sum(w * math.log(w) for w in share(k).values())

    target = mix.evenness * math.log(len(tokens)) - 1e-12 if tokens else 0
    k = mixing.GRID
    if tokens:
        if entropy(k) < target:
            low, high = 0, mixing.GRID
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if entropy(mid) >= target else (low, mid)
            k = low
        low, high = -1, mixing.GRID
        while high - low > 1:
            mid = (low + high) // 2
            ok = max(w * budget / tokens[s] for s, w in share(mid).items()) <= mix.most_epochs
            low, high = (low, mid) if ok else (mid, high)
        k = max(k, high)
    quota = {s: math.floor(round(w * budget, 3)) for s, w in share(k).items()} if tokens else {}
    out = Counter()
    by_source = defaultdict(list)
    for d, s, t in rows:
        by_source[tag(s)].append((d, s, t))
    for s, own in by_source.items():
        if s not in tokens:
            out.update(own)
            continue
        whole, rest = divmod(quota[s], tokens[s])
        for r in own:
            out[r] += whole
        n_blocks = -(-tokens[s] // mix.block_tokens)
        name = lambda d: "" if d is None else d
        block = lambda d: int(md5(mix.seed, name(d))[:12], 16) % n_blocks
        blocks = defaultdict(list)
        for r in own:
            blocks[md5(mix.seed, whole, s, block(r[0]))].append(r)
        for key in sorted(blocks):
            of = sum(size(t) for _, _, t in blocks[key])
            if not rest:
                break
            if of <= rest:
                out.update(blocks[key])
                rest -= of
                continue
            groups = defaultdict(list)
            for r in blocks[key]:
                groups[md5(mix.seed, whole, name(r[0]))].append(r)
            for g in sorted(groups):
                n = sum(size(t) for _, _, t in groups[g])
                if n > rest:
                    break
                out.update(groups[g])
                rest -= n
            break
    return k / mixing.GRID, +out


WORDS = [(i, "big" if i % 3 else "small", "w " * (5 + i % 7)) for i in range(120)] + [(200 + i, "tiny", "t t") for i in range(4)]
CASES = WORDS + [(None, None, "a b c"), (None, None, "a b c"), (1, "none", None), (2, "none", ""), (3, "", "x"), (5, "big", "w " * 5000), (7, "big", "w w"), (7, "big", "w w")]


@pytest.mark.parametrize("rows", [WORDS, CASES, CASES[-6:-4], [], WORDS[:1]], ids=["words", "cases", "no tokens", "empty", "one"])
@pytest.mark.parametrize("mix", [Mix(), Mix(0.8, 4.0, 64), Mix(1.0, 2.0, 20, 3), Mix(0.9, 8.0, 40, 2, 3000), Mix(1.0, 50.0, 40, 2, 100)], ids=str)
def test_draws(spark, rows, mix):
    more = "epoch string, tokens int, rest int, whole int, n_blocks int, cut_bk string, cut_dk string, left int, bk int, dk int, t int, weight int, quota int"
    docs = spark.createDataFrame([(d, s, t, "x", 1, 2, 3, 4, "y", "z", *range(6)) for d, s, t in rows], f"doc_id long, source string, text string, {more}")
    exponent, want = brute(rows, mix)
    got = mixing.draws(docs, mix)
    assert got.columns == [*(c for c in docs.columns if c != "epoch"), "epoch", "block", "n_tokens"]
    assert Counter((r.doc_id, r.source, r.text) for r in got.collect()) == want
    found = {r.exponent for r in mixing.weights(docs, mix).collect()}
    assert found <= {exponent}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
