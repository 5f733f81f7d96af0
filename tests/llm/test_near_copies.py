"""The pipeline's near-copy stage on planted edited copies, against brute force over shingle sets."""

import itertools
import random

import numpy as np
import pytest
from against import SF
from pyspark.sql import functions as F

import corpus_pipeline
from docquery.llm import near_copies


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_by_brute_force(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {top(i) for i in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return words


@pytest.mark.parametrize("most, block", [(1, 4000), (32, 500_000)])
def test_edited_copies_go(spark, docs_of, monkeypatch, most, block):
    """Copies with 1 to 9 of 300 words changed, by pairs and as crowds in blocks; those with 9 lie about the limit."""
    monkeypatch.setattr(near_copies, "MOST_SHARED", most)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng, rows = random.Random(3), []
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((k, " ".join(words)))
        rows += [(100 + 10 * k + n, " ".join(edited(rng, words, n))) for n in (1, 3, 5, 9)]
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "One  two"), (1004, "one two three")]
    want = kept_by_brute_force(rows)
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs_of(rows), "").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert not {100 + 10 * k + 1 for k in range(40)} & set(got)


def test_a_cloud_of_copies(spark, docs_of):
    """More copies of one text than are compared by pairs."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = [(i, " ".join(edited(rng, words, 4))) for i in range(300)] + [(i, f"other {i} " * 9) for i in range(300, 320)]
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs_of(rows), "").collect()}
    assert got == kept_by_brute_force(rows)


def test_links_on_the_tables(spark):
    """All links of the smallest table are found, and no others."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == kept_by_brute_force(texts.items()) and len(got) < len({tuple(sorted(shingle_set(t))) for t in texts.values()})


@pytest.mark.parametrize("block, postings", [(500_000, 1_000_000), (3000, 50), (100, 7)])
def test_a_crowd_in_blocks(spark, docs_of, monkeypatch, block, postings):
    """Chains of edited copies in one crowd: every link between components counts, for short sets and for those above a block."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "_POSTINGS", postings)
    rng, rows = random.Random(5), []
    for k in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for i in range(4):
            words = edited(rng, words, 2)
            rows.append((10 * k + i, " ".join(words)))
    sets = [(i, near_copies._shingles(t, 5, 42).view("int64")) for i, t in rows]
    members = spark.createDataFrame([(i, s.tolist()) for i, s in sets], "fp long, shingles array<long>")
    crowd = spark.createDataFrame([(i, len(s), 1, i) for i, s in sets], "fp long, size int, key long, root long")
    grown = near_copies._Components()
    near_copies._in_blocks(crowd, grown, members, 0.8)
    roots = {r.node: r.root for r in grown.roots.collect()}
    assert {roots.get(i, i) for i, _ in rows} == kept_by_brute_force(rows)


def test_components_grow(spark):
    """Links in several parts give the components of all links, and keys within one component go."""
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    rows = spark.createDataFrame([(i, i % 40, i) for i in range(200)], "fp long, key long, root long")
    grown = near_copies._Components()
    for at in range(0, 150, 30):
        rows = grown.link(rows, spark.createDataFrame(edges[at : at + 30], "u long, v long"))
    assert grown.link(rows, None) is rows and grown.link(rows, spark.createDataFrame([(5, 5), edges[0]], "u long, v long")) is rows
    whole = {r.node: r.root for r in near_copies.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {r.node: r.root for r in grown.roots.collect() if r.node != r.root} == {k: v for k, v in whole.items() if k != v}
    roots = {i: whole.get(i, i) for i in range(200)}
    open_ = {k for k in range(40) if len({roots[i] for i in range(k, 200, 40)}) > 1}
    assert {(r.fp, r.root) for r in rows.collect()} == {(i, roots[i]) for i in range(200) if i % 40 in open_}


def test_simhash_meets_first(spark, docs_of):
    """Without any MinHash key, what SimHash has within two bits is linked if it is similar, and only then."""
    rng, rows = random.Random(7), []
    for k in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(1500)]
        rows += [(10 * k + n, " ".join(edited(rng, words, n))) for n in (0, 1, 2, 3)]
    docs = docs_of(rows)
    nodes = docs.select(F.col("doc_id").alias("least"), near_copies._signature(F.col("text"), 5, 42).alias("s")).select("least", "s.*")
    nodes = nodes.withColumn("keys", F.array().cast("array<long>"))
    bits = {r.fp: (r.bits, r.least) for r in nodes.collect()}
    near = [(u, v) for u, v in itertools.combinations(bits, 2) if (bits[u][0] ^ bits[v][0]) & (2**64 - 1) and ((bits[u][0] ^ bits[v][0]) & (2**64 - 1)).bit_count() <= 2]
    same = [(u, v) for u, v in itertools.combinations(bits, 2) if bits[u][0] == bits[v][0]]
    options = {"shingle": 5, "seed": 42, "id_col": "doc_id", "text_col": "text"}
    roots = {r.node: r.root for r in near_copies.roots_of(docs, nodes, similarity=0.8, **options).collect()}
    assert near and all(roots[u] == roots[v] for u, v in near + same)
    assert all(bits[u][1] // 10 == bits[v][1] // 10 for u, v in roots.items())
    assert near_copies.roots_of(docs, nodes, similarity=0.9999, **options) is None


def test_counts_bound_what_is_common():
    """Counts refuse no pair that reaches the similarity, at sizes with different buckets too, and most of the others."""
    rng, refused = np.random.default_rng(8), 0
    for size in (1, 5, 16, 31, 33, 200, 1000, 5000):
        for share in (0.0, 0.3, 0.8, 0.88, 0.95, 1.0):
            a = rng.integers(0, 2**64, size, np.uint64)
            b = np.concatenate([a[: round(share * size)], rng.integers(0, 2**64, round((1 - share) * size * 1.2), np.uint64)])
            one, other = (near_copies._counts(np.unique(x)) for x in (a, b))
            if jaccard(set(a.tolist()), set(b.tolist())) >= 0.8:
                assert near_copies._may_reach(one, other, 0.8) and near_copies._may_reach(other, one, 0.8)
            elif size >= 200 and share <= 0.3:
                refused += not near_copies._may_reach(one, other, 0.8)
    assert refused == 6
    same = np.arange(400, dtype=np.uint64) << np.uint64(32)  # more in one bucket than a byte counts
    assert near_copies._may_reach(near_copies._counts(same), near_copies._counts(same), 0.8)


def test_a_passage_moves_no_sets(spark, docs_of, monkeypatch):
    """Texts with a passage in common meet by their counts only, and a crowd's keys are looked through once in each round of fingerprints."""
    made, write = {}, near_copies.materialise

    def recorded(df, name):
        out = write(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_copies, "materialise", recorded)
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(150)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(100)])) for i in range(80)]
    rows += [(100 + i, " ".join(edited(rng, rows[i][1].split(), 1))) for i in range(20)]
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs_of(rows), "").collect()}
    assert got == set(range(80)) == kept_by_brute_force(rows)
    assert sum(made["copies-pairs"]) > 4 * sum(made["copies-possible"]) > 0
    assert sum(made["copies-open"]) <= 1.5 * sum(made["copies-met"])
