from collections import Counter

from facetwatch.llm.packing import Packer, pack


def full_and_tails(rows):
    sizes = Counter()
    for r in rows:
        sizes[r.sequence_id] += r.length
    tails = [n for n in sizes.values() if n != 4096]
    assert all(n & (n - 1) == 0 for n in tails) and len(tails) == len(set(tails)), tails
    return len(sizes) - len(tails)


def test_short_documents_fill_sequences(spark, vocabulary):
    docs = spark.createDataFrame([(i, "a short title") for i in range(6000)], "doc_id long, text string").coalesce(1)
    rows = pack(docs, vocabulary).collect()
    total = sum(r.length for r in rows)
    assert total == sum(r.doc_tokens for r in rows if r.start == 0)
    assert full_and_tails(rows) == total // 4096
    assert max(Counter(r.sequence_id for r in rows).values()) > 256


def test_segments_bind_for_empty_texts():
    packer = Packer(4096, 1024, 4096, 256)
    bins = [len(b) for i in range(4000) for b in packer.add([i, 0, b"\2\0\0\0", 1, 0])]
    assert bins == [1024] * 3 and len(packer.pieces) == 4000 - 3 * 1024


def test_loss_binds_and_window_stays_bounded():
    packer, put = Packer(4096, 1024, 600, 256), 0
    for i in range(3000):
        for b in packer.add([i, 0, b"\2\0\0\0" * 6, 6, 4]):
            # 600 tokens with loss lie in some 1,800; the sequence is cut to a power of two.
            assert 300 < sum(packer._loss(p) for p in b) <= 600
            assert sum(len(p[2]) // 4 for p in b) == 1024
            put += 1024
        assert len(packer.pieces) < 1024
    assert put + sum(len(p[2]) // 4 for b in packer.finish() for p in b) == 18_000


def test_no_padding_where_segments_or_loss_bind(spark, vocabulary):
    for texts, least in ((["", "a", "b"], 1024), (["a b", "c d e"], 1024), (["one word more", ""], 512)):
        docs = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(9001)], "doc_id long, text string").coalesce(1)
        rows = pack(docs, vocabulary, max_segments=least).collect()
        size, ids = Counter(), Counter()
        for r in rows:
            size[r.sequence_id] += r.length
            ids[r.doc_id] += r.length
        assert all(n & (n - 1) == 0 for n in size.values())
        assert all(ids[r.doc_id] == r.doc_tokens for r in rows) and len(ids) == 9001
        assert max(Counter(r.sequence_id for r in rows).values()) <= least


def test_long_documents_under_a_small_loss_limit_need_no_padding():
    packer = Packer(4096, 1024, 600, 256)
    bins = [b for b in packer.add([1, 0, b"\2\0\0\0" * 9000, 9000, 100])]
    bins += list(packer.finish())
    sizes = [sum(len(p[2]) // 4 for p in b) for b in bins]
    assert sum(sizes) == 9000 and all(n & (n - 1) == 0 for n in sizes)
