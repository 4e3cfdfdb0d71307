import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from ledgerlens.llm import mixing as m

from .corpora import frame, odd_rows, sentence, with_clashes


def water(children, given):
    """[(capacity, weight)] to budgets, by filling up step by step."""
    full, out = set(), {}
    while True:
        left = given - sum(children[i][0] for i in full)
        weight = sum(w for i, (_, w) in enumerate(children) if i not in full)
        new = {i for i, (c, w) in enumerate(children) if i not in full and Fraction(left * w, weight) >= c}
        if not new:
            return [c if i in full else left * w // weight for i, (c, w) in enumerate(children)]
        # the least capacity for its weight fills first
        full.add(min(new, key=lambda i: Fraction(*children[i])))
        if len(full) == len(children):
            return [c for c, _ in children]


def plain(rows, percent=m.BUDGET_PERCENT, epochs=m.MAX_EPOCHS, seed=m.SEED):
    domain_of = {s: d for d, sources in m.DOMAINS.items() for s in sources}
    tree = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for doc_id, text, lang, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        if n:
            source = source or "unknown"
            tree[domain_of.get(source, "other")][lang or "unknown"][source].append((doc_id, text, n))
    size = lambda t: sum(x[2] for x in t) if isinstance(t, list) else sum(size(x) for x in t.values())
    if not tree:
        return Counter()

    def share(nodes, weights, other, given):
        names = sorted(nodes)
        return dict(zip(names, water([(size(nodes[x]) * epochs, weights.get(x, other)) for x in names], given)))

    out = Counter()
    for domain, given in share(tree, m.DOMAIN_WEIGHTS, m.OTHER["domain"], size(tree) * percent // 100).items():
        for lang, given_lang in share(tree[domain], m.LANG_WEIGHTS, m.OTHER["lang"], given).items():
            for source, budget in share(tree[domain][lang], m.SOURCE_WEIGHTS, m.OTHER["source"], given_lang).items():
                docs = tree[domain][lang][source]
                whole, rest = divmod(budget, size(docs))
                place = lambda d: hashlib.md5(f"{seed}:{whole}:{'' if d[0] is None else d[0]}".encode()).hexdigest()  # noqa: B023, E731
                ahead = 0
                for d in sorted(docs, key=lambda d: (place(d), d[0] is not None, d[0] or 0, hashlib.md5(d[1].encode()).hexdigest())):
                    copies = whole + (ahead < rest)
                    ahead += d[2]
                    if copies:
                        out[(d[0], domain, lang, source, d[2], copies)] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.domain, r.leaf_lang, r.leaf_source, r.n_tokens, r.copies) for r in df.collect())


def corpus(seed, n=150):
    import random

    r = random.Random(seed)
    return [(i, sentence(r, r.choice((1, 5, 40))), r.choice(("en", "en", "en", "de", "xx", None)),
             r.choice(("src0", "src0", "src0", "src8", "src12", "src14", "src15", "new", None))) for i in range(n)]


@pytest.mark.parametrize("seed,percent,epochs", [(1, 60, 2), (2, 100, 1), (3, 190, 2), (4, 0, 2), (5, 10, 3), (6, 500, 2)])
def test_equals_the_plain_version(spark, seed, percent, epochs):
    rows = corpus(seed)
    assert got(m.mixture(frame(spark, rows), budget_percent=percent, max_epochs=epochs)) == plain(rows, percent, epochs)


def test_shortage_stays_among_siblings():
    assert water([(10, 1), (100, 1), (100, 2)], 90) == [10, 26, 53]


def test_odd_rows_and_clashing_columns(spark):
    rows = [(*r[:2], *(r[2:] or ("en", "src1"))) for r in odd_rows()]
    docs = with_clashes(frame(spark, rows))
    assert got(m.mixture(docs)) == plain(rows)
    taken = m.mixed_documents(docs)
    assert taken.columns == docs.columns
    copies = Counter()
    for (doc_id, *_, n), times in plain(rows).items():
        copies[doc_id] += n * times
    assert Counter(r.doc_id for r in taken.collect()) == copies


def test_empty_table(spark):
    assert got(m.mixture(frame(spark, []))) == Counter()
    assert m.mixed_documents(frame(spark, [])).collect() == []
