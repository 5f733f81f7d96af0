"""Small groups of equal texts stay whole beside one that holds a third of all rows."""

import random
from collections import Counter, defaultdict

from docquery.llm import sharding


def test_one_group_of_a_third(docs_of):
    rng, texts = random.Random(1), ["h" * 99] * 2000
    for g in range(170):
        texts += [f"group {g:093d}"] * rng.randint(2, 5)
    texts += [f"single {i:092d}" for i in range(6000 - len(texts))]
    placed = sharding.shard_documents(docs_of(list(enumerate(texts)))).collect()
    where, full = defaultdict(set), Counter()
    for r in placed:
        where[texts[r.doc_id]].add(r.shard)
        full[r.shard] += r.size
    assert len(placed) == len(texts)
    assert sum(len(s) > 1 for t, s in where.items() if t[0] == "g") == 0
    assert len(where["h" * 99]) <= 4 and max(full.values()) - min(full.values()) < 0.03 * sum(full.values()) / 8
