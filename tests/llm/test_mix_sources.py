from collections import defaultdict

from tessera.llm import mix_sources as mx


def fill(budget, children):
    """children: {name: (cap, weight)} -> shares, by repeated rounds."""
    out, open_ = dict.fromkeys(children, 0.0), {k for k, (c, w) in children.items() if w > 0}
    while open_ and budget > 1e-9:
        total = sum(children[k][1] for k in open_)
        full = {k for k in open_ if out[k] + budget * children[k][1] / total >= children[k][0] - 1e-9}
        if not full:
            for k in open_:
                out[k] += budget * children[k][1] / total
            return out
        for k in full:
            budget -= children[k][0] - out[k]
            out[k] = children[k][0]
        open_ -= full
    return out


def brute(leaves, budget, epochs, weights):
    w = lambda level, name: weights.get(level, {}).get(name, 1.0)

    def cap(prefix):
        return epochs * sum(n for leaf, n in leaves.items() if leaf[: len(prefix)] == prefix)

    shares = {(): budget}
    for k, level in enumerate(mx.LEVELS):
        for parent in {leaf[:k] for leaf in leaves}:
            children = {leaf[k] for leaf in leaves if leaf[:k] == parent}
            for c, x in fill(shares[parent], {c: (cap((*parent, c)), w(level, c)) for c in children}).items():
                shares[(*parent, c)] = x
    return {leaf: int(shares[leaf] + 1e-6) for leaf in leaves}


ROWS = [(i, "tok " * (1 + i * 7 % 50), "en de fr".split()[i % 3], f"src{i * i % 9}", 5) for i in range(300)] + [(None, "a b", None, None, 1), (900, None, "en", "src1", 1), (901, " \n", "en", "x", 1), (902, "z " * 70000, "es", "web", 1), (5, "tok " * 36, "fr", "src7", 1), (7, "one", "de", "src4", 1), (7, "one", "de", "src4", 1)]
WEIGHTS = {"domain": {"domain1": 5.0, "(none)": 0.0}, "lang": {"de": 3.0, "es": 2.0}, "source": {"src4": 9.0}}


def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, epoch int")


def test_budgets_and_selection(spark):
    for share, epochs in ((0.02, 1), (0.5, 2), (1.7, 2), (9.0, 3)):
        mix = mx.Mix(spark, docs(spark), share, epochs, "s", WEIGHTS)
        plan = {(r.domain, r.lang, r.source): (r.tokens, r.budget) for r in mix.budgets.collect()}
        tokens = {k: t for k, (t, _) in plan.items()}
        want = brute(tokens, share * sum(tokens.values()), epochs, WEIGHTS)
        assert {k: b for k, (_, b) in plan.items()} == want
        got = mix.taken(mix.light).collect()
        took, times = defaultdict(int), defaultdict(int)
        for r in got:
            took[r.domain, r.lang, r.source] += r.taken
            times[r.domain, r.lang, r.source, r.epoch] += r.taken < r.n_tokens
            assert 0 < r.taken <= r.n_tokens
        for k, b in want.items():
            assert b - 2 <= took[k] <= b, (k, b, took[k])
        assert all(v <= 2 for v in times.values())


def test_mixed(spark):
    d = docs(spark)
    whole = mx.mixed(spark, d, share=9.0, epochs=1, weights={})
    assert whole.columns == d.columns and whole.count() == len(ROWS) - 2
    part = mx.mixed(spark, d, share=0.3, epochs=1, weights={}).collect()
    texts = {(r[0], r[1]) for r in ROWS}
    cut = [r for r in part if (r.doc_id, r.text) not in texts]
    assert sum(len(r.text.split()) for r in part) <= 0.3 * sum(len((r[1] or "").split()) for r in ROWS) and 0 < len(cut) < 40
    assert mx.mixed(spark, d, share=0.3, epochs=1, weights={}).collect() == part or sorted(map(str, mx.mixed(spark, d, share=0.3, epochs=1, weights={}).collect())) == sorted(map(str, part))


def test_empty(spark):
    assert mx.mix_report(spark, docs(spark).where("false")).collect() == []
