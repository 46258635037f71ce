"""Rules that keep work spread: salts, readers, thresholds; odd rows with real hits; whole licenses; stages on odd rows."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_decontaminate import check

from facetwatch.llm import decontaminate, exact_dedup, licenses, line_dedup, packing, simhash, tokens, warc
from facetwatch.llm.common import components, scratch


def test_a_hot_token_spreads_over_all_salts():
    blocks = [p << 40 | k << 20 for p in range(400) for k in range(3)]
    seen = Counter(tokens.salt_of(b, 50) for b in blocks)
    assert set(seen) <= set(range(1, 51)) and len(seen) == 50 and max(seen.values()) < 3 * len(blocks) / 50


def test_hot_tokens_of_blocks_are_salted(spark, vocabulary):
    own = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    df = spark.createDataFrame([(i, "the " * 3 + f"own{own(i)}") for i in range(4000)], "doc_id long, text string").repartition(16)
    rows = df.mapInArrow(tokens._frequencies(tokens.pre_tokens, tokens.BLOCK_PAIRS, 40), "token string, salt long, base long, codes array<int>, doc_id long, n_bytes long").where("token is not null")
    salts = {r.salt for r in rows.where("token = 'the'").select("salt").distinct().collect()}
    assert len(salts) > 8 and 0 not in salts and rows.where("token <> 'the' and salt <> 0").count() == 0
    assert {r.n_tokens for r in tokens.token_counts(df.where("doc_id < 10"), vocabulary).collect()} <= {4, 5, 6, 7}


def test_archives_are_dealt_to_many_readers(spark):
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("x" * 1200), F.col("id")).alias("html"))
    manifest = warc.write_archives(pages.repartition(4), scratch(spark, "warc"), archive_bytes=2000)
    n = manifest.count()
    assert n > 20
    read = warc.read_archives(manifest)
    assert read.rdd.getNumPartitions() == 8 and read.count() == 600
    assert warc.read_archives(manifest, readers=n).rdd.getNumPartitions() == n
    used = read.select(F.spark_partition_id().alias("p"), "path").distinct().groupBy("p").count().collect()
    assert len(used) == 8 and max(r["count"] for r in used) <= n / 8 + 2


def test_each_size_partition_has_its_threshold(spark):
    rng = random.Random(5)
    items = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))) for i, n in enumerate([6, 9] * 5 + [60, 64] * 5 + [600] * 5)], "item_id long, text string")
    rates = {r.part: r for r in decontaminate.pass_rates(items).collect()}
    assert len(rates) > 3
    small, large = rates[min(rates)], rates[max(rates)]
    assert small.pass_rate > 0.4 > 0.3 > large.pass_rate and large.n_values == 5 * 120


def test_wider_thresholds_lose_no_link(spark):
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in list(fps):
        for flips in (1, 2, 3, 4, 5):
            x = f
            for k in rng.sample(range(64), flips):
                x ^= 1 << k
            fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "rep long, fp long")
    for t in (1, 3, 4):
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= t:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        got = {r.node: r.component for r in components(simhash.links(df, t)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == [find(i) for i in range(len(fps))]
    with pytest.raises(ValueError):
        simhash.links(df, 7)


def test_odd_rows_with_hits(spark, odd):
    items = spark.createDataFrame([(1, "wide words in a long row wide words in a long row"), (1, "other text under an id used before"), (None, "ünïcödé 中文 😀 Σς"), (2, "one"), (2, "one"), (3, None)], "item_id long, text string")
    for rows in (0, decontaminate.BROADCAST_ROWS):
        got = check(spark, odd, items.where("item_id is null or item_id <> 2 or text is null").unionByName(items.where("item_id = 2").limit(1)), broadcast_rows=rows)
        assert {x[:2] for x in got} >= {(4, 1), (10, None), (9, 2)}
    kept = decontaminate.decontaminate(odd, items)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 5, 6, None, 7, 8}


def test_line_dedup_with_clashing_columns(spark):
    line = "a line that stands on every site"
    df = spark.createDataFrame([(i, f"{line}\nown text of {i}", f"s{i}", "mine", i) for i in range(5)], "doc_id long, text string, source string, h string, n_lines long")
    for rows in (0, line_dedup.BROADCAST_ROWS):
        got = {r.doc_id: r for r in line_dedup.line_dedup(df, broadcast_rows=rows).collect()}
        assert got[0].n_removed == 0 and all(got[i].text == f"own text of {i}" and got[i].n_removed == 1 and got[i].n_lines == 2 and got[i].h == "mine" for i in range(1, 5))


def test_exact_dedup_does_not_depend_on_the_broadcast(spark, docs, odd):
    for df in (docs, odd):
        for content_hash in (lambda t: F.unhex(F.md5(t)), lambda t: F.unhex(F.substring(F.md5(t), 1, 1))):
            a, b = (sorted(map(repr, exact_dedup.exact_dedup(df, content_hash=content_hash, broadcast_rows=n).collect())) for n in (0, 10**6))
            assert a == b and len(a) == df.count()


def plain(label):
    """A whole license as a text: markup replaced by wording."""
    import re

    text = licenses.WHOLE[label][0]
    return re.sub(r"\s+", " ", re.sub(r"<<var;words=\d+-\d+>>", "The Authors", re.sub(r"<<(begin|end)Optional>>", "", text)))


@pytest.mark.parametrize("label", sorted(licenses.WHOLE))
def test_whole_licenses(label):
    scan, text = licenses.Scanner().scan, plain(label)
    own = [x for x in scan(f"Copyright 2024 me. {text.upper()} The end.")[5].split(",") if not x.endswith("-fragment")]
    assert own == [label]
    words = text.split()
    rng = random.Random(1)
    for k in rng.sample(range(len(words)), 12):
        if words[k] in ("The", "Authors") or words[k].isdigit() or words[k] in ("its", "their", "including", "the", "next", "paragraph", "or"):
            continue
        changed = " ".join([*words[:k], "otherwise0", *words[k + 1 :]])
        assert label not in scan(changed)[5].split(","), words[k]
    assert label not in scan(" ".join(words[:-1]))[5].split(",")


def test_notices_tell_versions():
    scan = lambda t: [x for x in licenses.Scanner().scan(t)[5].split(",") if x]
    assert scan("subject to the terms of the Mozilla Public License, v. 2.0.") == ["mpl-2.0"]
    assert scan("CC BY-SA 4.0") == ["cc-by", "cc-by-sa-4.0"] and scan("Creative Commons Attribution-ShareAlike 3.0 Unported License") == ["cc-by-sa-3.0"]
    assert scan("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version") == ["lgpl-2.1", "lgpl-2.1-or-later"]
    assert scan("GNU Affero General Public License") == [] and scan("GNU Affero General Public License v3") == ["agpl-3.0"]
    assert scan("SPDX-License-Identifier: GPL-2.0-or-later") == ["gpl-2.0", "gpl-2.0-or-later"] and scan("SPDX-License-Identifier: BSD-3-Clause") == ["bsd-3-clause"]
    row = licenses.Scanner().scan("This is free and unencumbered software released into the public domain.")
    assert row[5] == "unlicense-fragment" and row[6] == 0.5


def test_three_limits_and_ties(spark, vocabulary):
    """Tokens, segments and loss bind in turn; equal pieces go in the order of their rows."""
    rows = [(i, "word " * 3, None, 0) for i in range(40)] + [(100 + i, "word " * 100, None, 90) for i in range(6)] + [(200 + i, "word " * 60, None, 0) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, skip int").coalesce(1)
    out = packing.pack(df, vocabulary, loss_start_col="skip", max_tokens=256, max_segments=8, max_loss=128, window=1).collect()
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append(r)
    full = {"tokens": 0, "segments": 0, "loss": 0}
    for s in by.values():
        n, k, loss = sum(r.length for r in s), len(s), sum(r.loss_tokens for r in s)
        assert n <= 256 and k <= 8 and loss <= 128
        assert n & (n - 1) == 0  # what a limit ends is cut to a power of two, so over half of it is left
        full = {"tokens": full["tokens"] + (n == 256), "segments": full["segments"] + (k == 8), "loss": full["loss"] + (n < 256 and k < 8 and loss > 64)}
    assert full["segments"] and full["loss"]
    again = packing.pack(df, vocabulary, loss_start_col="skip", max_tokens=256, max_segments=8, max_loss=128, window=1).collect()
    assert out == again
    small = [r.doc_id for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)) if r.doc_id < 100]
    assert small == sorted(small)


def test_stages_on_odd_rows_with_clashing_columns(spark, odd):
    df = odd
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark, "odd")
        out = stage(spark, df, "/root/testdata/sf0.001")
        if name != "packing":
            assert out.columns == odd.columns
        out.write.parquet(path)
        df = spark.read.parquet(path)
    assert {r.doc_id for r in df.select("doc_id").collect()} <= {None, 4, 5, 6, 9, 10}
