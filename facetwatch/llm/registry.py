"""Queries of the thirteen operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetwatch.llm.common import scratch, table

#: Fixed value: the vocabulary file that counts and packs documents.
VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    """Where the public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_packing(spark, sf_dir):
    from facetwatch.llm.packing import pack

    # A document's first token has nothing before it that could tell it, and bears no loss.
    docs = table(spark, sf_dir, "documents").withColumn("loss_start", F.lit(1))
    rows = pack(docs, vocabulary(), loss_start_col="loss_start")
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "loss_tokens")


def op2_quality(spark, sf_dir):
    from facetwatch.llm.quality import quality_scores

    rows = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    kept = (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5)
    return rows.select("doc_id", "quality_content", "quality_meta", "quality_score", "toxic_content", "toxic_meta", "toxic_score", F.coalesce(kept, F.lit(True)).alias("kept"))


def op3_decontamination(spark, sf_dir):
    from facetwatch.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "n_shingles", "n_shared", F.round("containment", 6).alias("containment"))


def op4_language_id(spark, sf_dir):
    from facetwatch.llm.language import held_out, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", F.size("mixture").alias("n_languages"))


def op5_simhash(spark, sf_dir):
    from facetwatch.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    from facetwatch.llm.line_dedup import line_dedup

    rows = line_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op7_warc(spark, sf_dir):
    from facetwatch.llm.warc import read_archives, write_archives

    manifest = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_token_counts(spark, sf_dir):
    from facetwatch.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op9_exact_dedup(spark, sf_dir):
    from facetwatch.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_licenses(spark, sf_dir):
    from facetwatch.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op11_sharding(spark, sf_dir):
    from facetwatch.llm.sharding import shard_digest

    rows = shard_digest(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"), "region", "rack")


def op12_hard_negatives(spark, sf_dir):
    from facetwatch.llm.negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives(rows.withColumn("label", label), F.col("id") % 50 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_whitening(spark, sf_dir):
    from facetwatch.llm.whitening import whiten

    rows = whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_quality, op3_decontamination, op4_language_id, op5_simhash, op6_line_dedup, op7_warc, op8_token_counts, op9_exact_dedup, op10_licenses, op11_sharding, op12_hard_negatives, op13_whitening
    )
}


def _pattern(template: str) -> str:
    """A license template as a regular expression over words with a space before and after each."""
    from facetwatch.llm import licenses

    out, at, begun = " ", 0, False
    for m in licenses._MARKUP.finditer(template):
        head = "".join(f"{w} " for w in licenses.WORD.findall(template[at : m.start()]))
        begun, at = begun or bool(head), m.end()
        out += head + {"beginOptional": "(?:", "endOptional": ")?"}.get(m[1], f"(?:[^ ]+ ){{{m[2]},{m[3]}}}" if begun else "")
    return out + "".join(f"{w} " for w in licenses.WORD.findall(template[at:]))


def _license_sql() -> str:
    from facetwatch.llm import licenses

    upper = "".join(map(chr, range(65, 91)))
    found = {label: f"[i FOR i IN range(len(w)) IF w[i + 1:i + {len(p.split())}] = {p.split()}]" for p, label in licenses.BASE.items()}
    tests = {label: " OR ".join(f"regexp_matches(s, '{_pattern(t)}')" for t in texts) for label, texts in licenses.TEMPLATES.items()}
    base = "[" + ", ".join(f"CASE WHEN len(p_{k}) > 0 THEN '{label}' END" for k, label in enumerate(found)) + "]"
    more = "[" + ", ".join(f"CASE WHEN {t} THEN '{label}' END" for label, t in tests.items()) + "]"
    return rf"""
        WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, {", ".join(f"{e} AS p_{k}" for k, e in enumerate(found.values()))} FROM t),
        q AS (SELECT doc_id, len(w) AS n_words, flatten([{", ".join(f"p_{k}" for k in range(len(found)))}]) AS places, [x FOR x IN {base} IF x IS NOT NULL] AS b, [x FOR x IN {more} IF x IS NOT NULL] AS m FROM p)
        SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, coalesce(array_to_string(list_sort(b), ','), '') AS base_labels,
            coalesce(array_to_string(list_sort(list_distinct(list_concat(b, m))), ','), '') AS labels, CASE WHEN len([x FOR x IN m IF NOT suffix(x, '-fragment')]) > 0 THEN 1.0 WHEN len(b) + len(m) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM q
    """


ORACLE_SQL = {
    "op12_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * c::DOUBLE) FOR c IN embedding] AS x FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
        s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same, list_inner_product(a.x, e.x)::BIGINT AS score FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
    """,
    "op10_licenses": _license_sql(),
    "op9_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "op6_line_dedup": r"""
        WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
        l AS (SELECT doc_id, source, unnest(parts) AS raw, unnest(range(len(parts))) AS pos FROM d),
        n AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l),
        b AS (SELECT line, min(doc_id) AS first_doc FROM n WHERE length(line) >= 16 GROUP BY line HAVING count(DISTINCT source) >= 3),
        k AS (SELECT n.doc_id, n.pos, n.raw, b.line IS NOT NULL AND n.doc_id <> b.first_doc AS gone FROM n LEFT JOIN b ON n.line = b.line),
        s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS clean FROM k GROUP BY doc_id)
        SELECT doc_id, n_lines::INTEGER AS n_lines, n_removed::INTEGER AS n_removed, length(clean) AS n_kept_chars, sha256(clean) AS kept_sha256 FROM s
    """,
    "op7_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
        SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM m
    """,
    "op3_decontamination": r"""
        WITH dn AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM documents),
        bn AS (SELECT item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM benchmark),
        dw AS (SELECT doc_id, string_split(norm, ' ') AS w FROM dn), bw AS (SELECT item_id, string_split(norm, ' ') AS w FROM bn WHERE norm <> ''),
        ds AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 3, 1))]) AS s FROM dw),
        bs AS (SELECT DISTINCT item_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 3, 2))]) AS s FROM bw),
        q AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
        m AS (SELECT doc_id, item_id, count(*) AS k FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, n::INTEGER AS n_shingles, k::INTEGER AS n_shared, round(k / n, 6) AS containment FROM m JOIN q USING (item_id) WHERE k >= 0.8 * n
    """,
}
