"""Queries of the text operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causal_panel.llm import chat_format, conversation_repair, epsilon_grid, license_templates, lsh_forest, ngram_ratio, packing, page_text, personal_data, phrase_mining, secret_scan, source_mix, toxicity
from causal_panel.llm.text import table


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret candidates of all documents and what the forest says of them."""
    return secret_scan.findings(table(spark, sf_dir, "documents")).drop("row_key")


def tokenizer_path() -> str:
    """The vocabulary file of the packing query, from the tokenizer package that every executor has."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2,048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template matches of all documents."""
    return license_templates.summarize(license_templates.scan_licenses(table(spark, sf_dir, "documents"))).drop("matches")


def op8_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95."""
    linked = epsilon_grid.similar_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return linked.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP8_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
       min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN reached r ON r.a = e.vec_id GROUP BY e.vec_id
"""


def op9_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents; trusted are those labelled of good quality."""
    labels = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("good_id")).distinct().hint("shuffle_hash")  # texts move once, whatever the sizes
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, F.col("doc_id") == F.col("good_id"), "left")
    rules = ngram_ratio.quality_rules(docs, F.col("good_id").isNotNull())
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_grams", "ratio_sum")


OP9_SQL = r"""
WITH crc_table AS (
    SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
    FROM (SELECT unnest(range(256)) AS n)
), split AS MATERIALIZED (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), placed AS MATERIALIZED (
    SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM split
), hashes AS MATERIALIZED (
    SELECT word, xor(4294967295, list_reduce(list_concat([4294967295],
               list_transform(range(1, octet_length(encode(word)) + 1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT)),
               lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1]))) AS h
    FROM (SELECT DISTINCT word FROM placed), crc_table
), hashed AS MATERIALIZED (
    SELECT doc_id, k, h, lead(h) OVER (PARTITION BY doc_id ORDER BY k) AS next_h FROM placed JOIN hashes USING (word)
), grams AS MATERIALIZED (
    SELECT doc_id, h % 16384 AS cell FROM hashed
    UNION ALL SELECT doc_id, (h * 31 + next_h * 17 + 7) % 16384 FROM hashed WHERE next_h IS NOT NULL
), counted AS (
    SELECT cell, count(*) AS raw, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS target FROM grams GROUP BY cell
), ratios AS (
    SELECT cell, CAST(floor((ln((target + 1) / (sum(target) OVER () + 16384.0::DOUBLE)) - ln((raw + 1) / (sum(raw) OVER () + 16384.0::DOUBLE))) * 1e6 + 0.5) AS BIGINT) AS ratio
    FROM counted
), scored AS (
    SELECT doc_id, count(*) AS n_grams, CAST(sum(ratio) AS BIGINT) AS ratio_sum FROM grams JOIN ratios USING (cell) GROUP BY doc_id
), starts AS (
    SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS next_k FROM (
        SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, five) AS n FROM (
            SELECT doc_id, unnest(range(1, len(w) - 3)) AS k, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS five
            FROM split WHERE len(w) >= 5)
    ) WHERE n > 1
), repeats AS (
    SELECT doc_id, CAST(sum(least(5, coalesce(next_k - k, 5))) AS BIGINT) AS n FROM starts GROUP BY doc_id
), ruled AS (
    SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
                - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
           coalesce(r.n, 0) AS n_repeat_words
    FROM split s LEFT JOIN repeats r USING (doc_id)
)
SELECT r.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(ratio_sum, 0) >= -250000 * coalesce(n_grams, 0) AS kept,
       coalesce(n_grams, 0) AS n_grams, coalesce(ratio_sum, 0) AS ratio_sum
FROM ruled r LEFT JOIN scored USING (doc_id)
"""


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to 150 % of their words by source weights 5, 2, 1."""
    mixed = source_mix.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9))::BIGINT AS point
    FROM documents
), by_source AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
           row_number() OVER (ORDER BY source NULLS LAST) AS rank
    FROM by_source
), summed AS (
    SELECT *, 150 * sum(source_size) OVER () AS budget,
           coalesce(sum(200 * source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
           sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
    FROM weighed
), judged AS (
    SELECT *, weight * (budget - stopped) >= 200 * source_size * open AS stops FROM summed
), targets AS (
    SELECT source, source_size, CASE WHEN stops THEN CAST(2 * source_size AS DOUBLE) ELSE
           CAST(weight * (budget - coalesce(sum(CASE WHEN stops THEN 200 * source_size END) OVER (), 0)) AS DOUBLE)
           / (100.0::DOUBLE * sum(CASE WHEN NOT stops THEN weight END) OVER ()) END AS target
    FROM judged
), budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), points AS (
    SELECT source, point, sum(size) AS tokens FROM sized GROUP BY source, point
), sums AS (
    SELECT p.source, p.point, p.tokens, sum(p.tokens) OVER (PARTITION BY p.source ORDER BY p.point) AS upto,
           b.target - b.whole * b.source_size AS extra
    FROM points p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source
), edges AS (
    SELECT source, min(CASE WHEN upto > extra THEN point + CASE WHEN upto - extra < extra - (upto - tokens) THEN 1 ELSE 0 END END) AS edge FROM sums GROUP BY source
)
SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, b.source_size, b.target,
       CAST(s.size * least(2, b.whole + CASE WHEN e.edge IS NULL OR s.point < e.edge THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source JOIN edges e ON s.source IS NOT DISTINCT FROM e.source
"""


def op1_label_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at a similarity of 0.85."""
    grouped = lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))
    return grouped.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP2_SQL = r"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, list_aggregate(w[k:k + 4], 'string_agg', ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM split WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), classes AS (
    SELECT md5(string_agg(s, chr(10) ORDER BY s)) AS digest, doc_id FROM shingles GROUP BY doc_id
), reps AS (
    SELECT digest, min(doc_id) AS rep FROM classes GROUP BY digest
), sets AS (
    SELECT s.doc_id, s.s FROM shingles s WHERE s.doc_id IN (SELECT rep FROM reps)
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)
    UNION SELECT rep, doc_id FROM reps JOIN classes USING (digest) WHERE rep <> doc_id
), ways AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reached AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN ways l ON r.b = l.a
), least AS (
    SELECT a, min(b) AS component_id FROM reached GROUP BY a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.a = d.doc_id
"""


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return page_text.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


PROBE = ((-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"))


def op4_prefix_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of control strings, as examples; read back per conversation."""
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.conversation_digests(chat_format.prefix_examples(turns))


OP4_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
    SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns,
           sum(length(role) + length(regexp_replace(role, '[^\\\n]', '', 'g')) + len(regexp_extract_all(role, '</?s>|\[/?INST\]'))
               + length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]'))
               + 9 + CASE WHEN role = 'assistant' THEN 0 ELSE 13 END) OVER w AS upto
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, max(n_turns) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR n = n_turns) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op11_branch_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged, and the cheapest repair of each."""
    original = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_summary(original, conversation_repair.damaged(original))


#: At most two Inserts stand next to each other: a third leads where one does.
OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
    FROM (SELECT unnest(range(256)) AS n)
), keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
    FROM conversations
), thrown AS (
    SELECT * EXCLUDE (key), xor(4294967295, list_reduce(list_concat([4294967295],
               list_transform(range(1, octet_length(encode(key)) + 1), lambda i: ('0x' || substr(hex(encode(key)), 2 * i - 1, 2))::BIGINT)),
               lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1]))) % 20 AS die
    FROM keyed, crc_table
), damaged AS (
    SELECT conv_id, turn, CASE WHEN die = 4 THEN 'user' ELSE role END AS role,
           CASE die WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM thrown, (SELECT unnest([1, 2]) AS copy) WHERE die <> 0 AND (copy = 1 OR die = 3)
), placed AS (
    SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n FROM damaged
), judged AS MATERIALIZED (
    SELECT conv_id, conv, n, turn, role, text, substr(role, 1, 1) AS initial,
           CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
           coalesce(lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY n) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal
    FROM placed
), moves (state, edits, paid, now, lines) AS (
    VALUES (0, '', 0, 0, CAST([] AS VARCHAR[])), (0, 'I', 3, 2, ['user:']), (0, 'II', 6, 3, ['user:', 'assistant:']),
           (1, '', 0, 1, []), (1, 'I', 3, 2, ['user:']), (1, 'II', 6, 3, ['user:', 'assistant:']),
           (2, '', 0, 2, []), (2, 'I', 3, 3, ['assistant:']), (2, 'II', 6, 2, ['assistant:', 'user:']),
           (3, '', 0, 3, []), (3, 'I', 3, 2, ['user:']), (3, 'II', 6, 3, ['user:', 'assistant:'])
), walked AS (
    SELECT DISTINCT conv, CAST(0 AS BIGINT) AS n, 0 AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS fixed FROM judged
    UNION ALL
    SELECT conv, n, state, cost, audit, fixed FROM (
        SELECT w.conv, j.n, e.state, w.cost + m.paid + e.paid AS cost, w.audit || m.edits || e.edit AS audit, list_concat(list_concat(w.fixed, m.lines), e.line) AS fixed,
               row_number() OVER (PARTITION BY w.conv, e.state ORDER BY w.cost + m.paid + e.paid, w.audit || m.edits || e.edit) AS best
        FROM walked w JOIN judged j ON j.conv = w.conv AND j.n = w.n + 1 JOIN moves m ON m.state = w.state,
             LATERAL (SELECT unnest([
                 {'edit': 'D', 'paid': 4, 'state': m.now, 'line': CAST([] AS VARCHAR[]), 'can': true},
                 {'edit': 'R', 'paid': CASE WHEN j.fault = 'truncated' THEN 6 ELSE 3 END, 'state': CASE WHEN m.now = 2 THEN 3 ELSE 2 END,
                  'line': [CASE WHEN m.now = 2 THEN 'assistant:' ELSE 'user:' END || j.text], 'can': j.fault IN ('', 'truncated')},
                 {'edit': 'K', 'paid': CASE WHEN j.fault = 'truncated' THEN 3 ELSE 0 END, 'state': CASE j.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END,
                  'line': [j.role || ':' || j.text],
                  'can': j.fault IN ('', 'truncated') AND ((j.initial = 's' AND m.now = 0) OR (j.initial = 'u' AND m.now <> 2) OR (j.initial = 'a' AND m.now = 2))}
             ], recursive := true))  e(edit, paid, state, line, can)
        WHERE e.can
    ) WHERE best = 1
), ended AS (
    SELECT w.conv, w.cost + m.paid AS cost, w.audit || m.edits AS audit, list_concat(w.fixed, m.lines) AS fixed,
           row_number() OVER (PARTITION BY w.conv ORDER BY w.cost + m.paid, w.audit || m.edits) AS best
    FROM walked w JOIN moves m ON m.state = w.state JOIN (SELECT conv, max(n) AS n FROM judged GROUP BY conv) l ON l.conv = w.conv AND l.n = w.n
    WHERE m.now IN (0, 3)
), counted AS (
    SELECT conv_id, conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
    FROM judged GROUP BY conv_id, conv
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(e.cost, 0) AS BIGINT) AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.fixed, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv = c.conv AND e.best = 1
"""


def op12_toivonen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language of all documents."""
    return phrase_mining.collocations(phrase_mining.frequent_phrases(table(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH pieces AS (
    SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), placed AS (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k + size - 1], ' '))) AS phrase
    FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size
), counted AS MATERIALIZED (
    SELECT lang, size, phrase, count(*) AS f FROM placed GROUP BY lang, size, phrase
), sizes AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE size = 1 GROUP BY lang
), candidates AS MATERIALIZED (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE size > 1 AND f >= 30
), cuts AS (
    SELECT lang, phrase, a, w, unnest(range(1, size)) AS k FROM candidates
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
    FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.k], ' ') JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
), lowest AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM scored) WHERE cut = 1
), subs AS (
    SELECT lang, a, unnest(flatten(list_transform(range(2, size), lambda m: list_transform(range(1, size - m + 2), lambda k: array_to_string(w[k:k + m - 1], ' '))))) AS phrase FROM candidates
), longest AS (
    SELECT lang, phrase, max(a) AS longer FROM subs GROUP BY lang, phrase
), ranked AS (
    SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, l.phrase) AS rank
    FROM lowest l LEFT JOIN longest g ON g.lang = l.lang AND g.phrase = l.phrase
    WHERE g.longer IS NULL OR 100 * CAST(g.longer AS HUGEINT) < 80 * CAST(l.a AS HUGEINT)
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, s.n, r.score FROM ranked r JOIN sizes s ON s.lang = r.lang WHERE r.rank <= 2000
"""


def op13_span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and places of the base kinds, and all spans."""
    found = personal_data.find_personal_data(table(spark, sf_dir, "documents"))
    base = found.withColumn("base", F.filter("spans", lambda s: s["base"]))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return base.select(
        "doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(personal_data.listed(F.col("base")), 256).alias("base_sha256"), personal_data.listed(F.col("spans")).alias("spans")
    )


OP13_SQL = r"""
WITH patterns (rank, kind, pattern, prior, bonus, context) AS (VALUES
    (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', 80, 10, 'mail|correo|courriel|contact|kontakt'),
    (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)', 50, 30, '(^|[^a-z])ip([^a-z]|$)|host|server|address|adress|direcci'),
    (2, 'card', '[0-9]([\x20-]?[0-9])+', 60, 30, 'card|visa|credit|karte|carte|tarjeta'),
    (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]', 60, 30, 'phone|tel|call|mobil|fax|anruf|llama'),
    (4, 'iban', '[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?', 80, 10, 'iban|account|bank|konto|compte|cuenta'),
    (5, 'ssn', '[0-9]+(?:-[0-9]+)+', 40, 30, '(^|[^a-z])ssn([^a-z]|$)|social security|tax'),
    (6, 'tel', '(?:\+[0-9]{1,3}[\x20.-]?)?\([2-9][0-9]{2}\)[\x20.-]?[2-9][0-9]{2}[\x20.-][0-9]{4}', 60, 30, 'phone|tel|call|mobil|fax|anruf|llama'),
    (7, 'birth', '[0-9]+(?:-[0-9]+)+', 30, 30, '(^|[^a-z])born([^a-z]|$)|birth|(^|[^a-z])dob([^a-z]|$)|geboren|geburt|naissance|nacid|nacimiento')
), texts AS (
    SELECT row_number() OVER () AS row_key, doc_id, coalesce(text, '') AS text FROM documents
), matched AS (
    SELECT row_key, rank, kind, prior, bonus, context, regexp_extract_all(text, pattern) AS found, string_split_regex(text, pattern) AS gaps
    FROM texts, patterns WHERE regexp_matches(text, pattern)
), placed AS (
    SELECT row_key, rank, kind, prior, bonus, context, unnest(range(1, len(found) + 1)) AS k, unnest(found) AS v, unnest(gaps[:-2]) AS gap, unnest(gaps[2:]) AS next_gap FROM matched
), spans AS (
    SELECT *, sum(length(gap) + length(v)) OVER (PARTITION BY row_key, kind ORDER BY k) AS stop, regexp_replace(v, '[^0-9]', '', 'g') AS digits, replace(v, ' ', '') AS bare,
           prior + CASE WHEN regexp_matches(lower(right(gap, 40) || ' ' || left(next_gap, 20)), context) THEN bonus ELSE 0 END AS score
    FROM placed
), confirmed AS (
    SELECT *, kind || ':' || (stop - length(v)) || ':' || stop AS span FROM spans
    WHERE (rank < 4 OR score >= 60) AND CASE kind
        WHEN 'email' THEN true
        WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda p: TRY_CAST(ltrim(p, '0') AS HUGEINT) > 255 OR length(ltrim(p, '0')) > 3)) = 0
        WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(digits)), lambda i:
            CASE WHEN (length(digits) - 1 - i) % 2 = 0 THEN CAST(digits[i + 1] AS INTEGER) WHEN CAST(digits[i + 1] AS INTEGER) > 4 THEN 2 * CAST(digits[i + 1] AS INTEGER) - 9
                 ELSE 2 * CAST(digits[i + 1] AS INTEGER) END)) % 10 = 0
        WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
        WHEN 'iban' THEN length(bare) BETWEEN 15 AND 34 AND list_reduce(list_concat([0], list_transform(range(1, length(bare) + 1), lambda i: ascii((bare[5:] || bare[:4])[i]))),
            lambda r, c: CASE WHEN c < 58 THEN r * 10 + c - 48 ELSE r * 100 + c - 55 END % 97) = 1
        WHEN 'ssn' THEN regexp_full_match(v, '[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(v, '^(000|666)|-00-|-0000')
        WHEN 'tel' THEN NOT starts_with(v, '+')
        ELSE regexp_full_match(v, '(19|20)[0-9]{2}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])') END
)
SELECT t.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(span, ',' ORDER BY rank, stop) FILTER (rank < 4), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY rank, stop), '') AS spans
FROM texts t LEFT JOIN confirmed c USING (row_key) GROUP BY t.row_key, t.doc_id
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_label_model": op1_label_model,
    "op2_lsh_forest": op2_lsh_forest,
    "op3_page_text": op3_page_text,
    "op4_prefix_examples": op4_prefix_examples,
    "op5_secret_forest": op5_secret_forest,
    "op6_linear_grouping": op6_linear_grouping,
    "op7_license_templates": op7_license_templates,
    "op8_epsilon_grid": op8_epsilon_grid,
    "op9_ngram_ratio": op9_ngram_ratio,
    "op10_source_mix": op10_source_mix,
    "op11_branch_bound": op11_branch_bound,
    "op12_toivonen": op12_toivonen,
    "op13_span_scores": op13_span_scores,
}

ORACLES = {
    "op2_lsh_forest": OP2_SQL,
    "op4_prefix_examples": OP4_SQL,
    "op8_epsilon_grid": OP8_SQL,
    "op9_ngram_ratio": OP9_SQL,
    "op10_source_mix": OP10_SQL,
    "op11_branch_bound": OP11_SQL,
    "op12_toivonen": OP12_SQL,
    "op13_span_scores": OP13_SQL,
}
