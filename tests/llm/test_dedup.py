import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from facetwatch.llm import simhash
from facetwatch.llm.common import components
from facetwatch.llm.exact_dedup import exact_dedup
from facetwatch.llm.line_dedup import boilerplate, line_dedup


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm):
        groups[t].append(i)
    out = []
    for (i, _), t in zip(rows, norm):
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return out


def as_set(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_exact_dedup_brute_force(docs, odd):
    for df in (docs, odd):
        want = brute_exact([(r.doc_id, r.text) for r in df.collect()])
        assert as_set(exact_dedup(df)) == sorted(map(repr, want))


def test_exact_dedup_collisions_are_told_apart(odd):
    want = brute_exact([(r.doc_id, r.text) for r in odd.collect()])
    short = exact_dedup(odd, content_hash=lambda t: F.unhex(F.substring(F.md5(t), 1, 0)))
    assert as_set(short) == sorted(map(repr, want))


def test_exact_dedup_empty(empty):
    assert exact_dedup(empty).count() == 0


def plain_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", low)
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps):
    """fps: list of (id, fingerprint)."""
    n, root = len(fps), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 2:
                root[find(i)] = find(j)
    low = {}
    for i in range(n):
        if fps[i][0] is not None:
            low[find(i)] = min(low.get(find(i), 1 << 62), fps[i][0])
    return [low.get(find(i)) for i in range(n)]


def test_fingerprints_follow_the_definition(docs, odd):
    for df in (docs, odd):
        for r in df.limit(60).collect():
            assert simhash.fingerprint(r.text) == plain_fingerprint(r.text)


def test_anchors_cover():
    masks, rng = simhash.anchor_masks(), random.Random(5)
    syndrome = lambda x: int(np.bitwise_xor.reduce([p + 1 for p in range(63) if x >> p & 1] or [0]))
    full = (1 << 64) - 1
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for p in rng.sample(range(64), rng.randint(0, 2)):
            y ^= 1 << p
        a = {(x ^ (m & full)) for m in masks[syndrome(x)]}
        b = {(y ^ (m & full)) for m in masks[syndrome(y)]}
        assert all(syndrome(c) == 0 for c in a)
        assert a & b, "a pair within two bits shares an anchor"


def test_components_of_planted_fingerprints(spark):
    rng, rows = random.Random(3), []
    for g in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 30])):
            rows.append((len(rows), x))
            for p in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << p
    want = dict(zip([i for i, _ in rows], brute_components(rows)))
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in rows], "rep long, fp long")
    one = df.groupBy("fp").agg(F.min("rep").alias("rep"))
    got = {r.node: r.component for r in components(simhash.links(one)).collect()}
    of_fp = {r.fp: r.rep for r in one.collect()}
    for i, x in rows:
        rep = of_fp[x - (1 << 64) if x >> 63 else x]
        assert got.get(rep, rep) == want[i]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5), (3, 4), (4, 3), (None, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100}
    assert {got[i] for i in range(200, 260)} == {7} and got[4] == 3 and 5 not in got


def test_simhash_components(docs, odd, empty):
    for df in (docs, odd):
        rows = [(r.doc_id, plain_fingerprint(r.text)) for r in df.select("doc_id", "text").collect()]
        want = [(i, f"{x:016x}", c) for (i, x), c in zip(rows, brute_components(rows))]
        assert as_set(simhash.simhash_components(df)) == sorted(map(repr, want))
    assert simhash.simhash_components(empty).count() == 0


def test_near_dedup_keeps_one(odd):
    kept = [r.doc_id for r in simhash.near_dedup(odd).collect()]
    assert 5 in kept and 6 not in kept and kept.count(4) >= 2 and None in kept
    assert simhash.near_dedup(odd).columns == odd.columns


def brute_lines(rows, min_sites=3, min_chars=16):
    sites, first = defaultdict(set), {}
    for i, text, site in rows:
        for line in (text or "").split("\n") if text is not None else []:
            line = line.strip(" \t\r\x0b\x0c")
            if len(line) >= min_chars:
                sites[line].add(site)
                if i is not None:
                    first[line] = min(first.get(line, i), i)
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        parts = text.split("\n")
        kept = [x for x in parts if not (len(sites.get(b := x.strip(" \t\r\x0b\x0c"), ())) >= min_sites and first.get(b) != i)]
        out.append((i, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return out


def test_line_dedup(spark, docs, odd, empty):
    plant = "this very line stands on many sites"
    rows = [(i, f"own line of {i} and only of it\n{plant} \nshort", f"s{i % 4}") for i in range(20)] + [(30, plant, None), (None, plant, "s1"), (31, None, "s0"), (32, "\n\n", "s1")]
    planted = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for df in (docs, odd, planted):
        for limit in (0, 500_000):
            got = line_dedup(df, broadcast_rows=limit).select("doc_id", "text", "n_lines", "n_removed")
            assert as_set(got) == sorted(map(repr, brute_lines([(r.doc_id, r.text, r.source) for r in df.collect()])))
    assert line_dedup(empty).count() == 0
    assert boilerplate(planted).count() == 1


def test_ids_with_several_texts_join_no_components(spark):
    a, b = "alpha beta gamma delta " * 30, "other words stand in this text " * 30
    for rows in ([(1, a), (1, b), (0, b), (4, a)], [(1, a), (2, a), (2, b), (3, b)]):
        got = sorted((r.doc_id, r.component_id) for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        least = {t: min(i for i, u in rows if u == t) for t in (a, b)}
        assert got == sorted((i, least[t]) for i, t in rows)
