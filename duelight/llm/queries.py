"""One query per operator, over the whole supplied tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelight.llm import bpe, dialogue, embeddings, langid, mixing, neardup, qda, quality, search, secrets, substrings, suffixes, warc
from duelight.llm.tables import materialise, read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of weights 3, 1, 2 and 150% of all words takes of every document, in training order."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    rows = mixing.mix(materialise(docs, "op1-sizes"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "position")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and give digests of both."""
    return bpe.digests(spark, read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95."""
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without windows of 20 words that start earlier."""
    return substrings.deduplicate(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, by thresholds of its language and source."""
    return quality.judge(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by cross-parsing against labelled text."""
    return langid.identify(read(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to WARC archives, normalised, and read back."""
    rows = warc.round_trip(read(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, as `labels` teaches it."""
    return qda.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan(read(spark, sf_dir, "documents"))


def op11_shared_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that start anywhere else too."""
    return suffixes.deduplicate(read(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by its rows' checksums and repaired at least cost."""
    return dialogue.repair(dialogue.damage(read(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_near_vectors": op3_near_vectors,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_warc": op8_warc,
    "op9_quality_score": op9_quality_score,
    "op10_secret_scan": op10_secret_scan,
    "op11_shared_strings": op11_shared_strings,
    "op12_ranked_search": op12_ranked_search,
    "op13_repaired_conversations": op13_repaired_conversations,
}

ORACLE: dict[str, str] = {
    "op1_source_mix": """
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source
        ), w AS (
            SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, CAST(2.0 AS DOUBLE) * source_size AS most,
                   CAST(CASE rank % 3 WHEN 0 THEN 4.0 WHEN 1 THEN 0.5 ELSE 2.0 END AS DOUBLE) AS w0, CAST(CASE rank % 3 WHEN 0 THEN -2.0 WHEN 1 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS slope
            FROM s
        ), o AS (
            SELECT *, most / weight AS full_at,
                   (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS BIGINT) - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
            FROM w
        ), t AS (
            SELECT *, max(CASE WHEN own_level <= full_at THEN own_level END) OVER () AS level FROM o
        ), g AS (
            SELECT source, source_size, weight, w0, slope, CASE WHEN level IS NULL OR full_at < level THEN most ELSE level * weight END AS target FROM t
        ), l AS (
            SELECT d.*, g.* EXCLUDE (source), CAST(floor(target) AS BIGINT) AS whole,
                   CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
            FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
        ), p AS (
            SELECT *, greatest(0, least(size, whole - before)) AS first_pass, greatest(0, least(size, whole - source_size - before)) AS second_pass,
                   CAST(before AS DOUBLE) / CAST(whole AS DOUBLE) * weight AS due
            FROM l
        )
        SELECT doc_id, size, source_size, target, first_pass + second_pass AS taken,
               CASE WHEN first_pass > 0 THEN CASE WHEN due <= 0 THEN 0.0 ELSE 2 * due / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * due, 0.0))) END END AS position
        FROM p
    """,
    "op3_near_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
        ), r AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
        ), c AS (
            SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a
        )
        SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
    """,
    "op5_repeated_passages": """
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
        ), s AS (
            SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM d WHERE len(words) >= 20
        ), r AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY array_to_string(words[pos : pos + 19], ' ') ORDER BY doc_id, pos) AS nth FROM s
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM r WHERE nth > 1
        ), w AS (
            SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d
        ), k AS (
            SELECT w.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY w.pos) AS text
            FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.pos = gone.pos GROUP BY w.doc_id
        )
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """,
    "op6_quality_rules": """
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
                   CAST(len(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
            FROM documents
        ), s AS (
            SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d
        ), t AS (
            SELECT rid, pos, word || ' ' || lead(word) OVER (PARTITION BY rid ORDER BY pos) || ' ' || lead(word, 2) OVER (PARTITION BY rid ORDER BY pos) AS three FROM s
        ), r AS (
            SELECT rid, pos, count(*) OVER (PARTITION BY rid, three) AS n FROM t WHERE three IS NOT NULL
        ), g AS (
            SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS p FROM r WHERE n > 1) GROUP BY rid
        ), c AS (
            SELECT d.rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(len(array_to_string(words, '')) AS BIGINT) AS word_chars, n_symbols,
                   CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
            FROM d LEFT JOIN g USING (rid)
        ), y AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                   [ln(word_chars / nullif(n_words, 0)), n_symbols / nullif(n_words, 0), n_dup_lines / nullif(n_lines, 0), n_repeat_words / nullif(n_words, 0)] AS v
            FROM c
        ), z AS (
            SELECT rid, lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS name, unnest(v) AS v FROM y WHERE NOT base_failed
        ), small AS (
            SELECT lang, source, name, count(*) AS n, quantile_disc(v, [0.25, 0.5, 0.75, 0.95]) AS q FROM z GROUP BY lang, source, name
        ), wide AS (
            SELECT lang, name, count(*) AS n, quantile_disc(v, [0.25, 0.5, 0.75, 0.95]) AS q FROM z GROUP BY lang, name
        ), whole AS (
            SELECT name, quantile_disc(v, [0.25, 0.5, 0.75, 0.95]) AS q FROM z GROUP BY name
        ), w AS (
            SELECT lang, w.name, [(n * w.q[k] + 100 * a.q[k]) / (n + 100) for k in [1, 2, 3, 4]] AS q FROM wide w JOIN whole a USING (name)
        ), e AS (
            SELECT s.lang, source, s.name, [(n * s.q[k] + 100 * w.q[k]) / (n + 100) for k in [1, 2, 3, 4]] AS q
            FROM small s JOIN w ON s.name = w.name AND s.lang IS NOT DISTINCT FROM w.lang
        ), f AS (
            SELECT lang, source, name, CASE WHEN name = 'word_length' THEN q[1] - 5 * greatest(q[2] - q[1], 0.05) END AS least,
                   CASE WHEN name = 'word_length' THEN q[3] + 5 * greatest(q[3] - q[2], 0.05)
                        ELSE greatest(CASE WHEN q[3] > 0 THEN q[3] + 5 * (q[3] - q[2]) ELSE 0 END,
                                      least(greatest(4 * q[4], CASE name WHEN 'symbols' THEN 0.1 WHEN 'dup_lines' THEN 0.35 ELSE 0.3 END), CASE name WHEN 'symbols' THEN 0.3 WHEN 'dup_lines' THEN 0.7 ELSE 0.45 END))
                   END AS most
            FROM e
        ), j AS (
            SELECT rid, min(CASE z.name WHEN 'word_length' THEN 1 WHEN 'symbols' THEN 2 WHEN 'dup_lines' THEN 3 ELSE 4 END) AS first_rule
            FROM z JOIN f ON z.name = f.name AND z.lang IS NOT DISTINCT FROM f.lang AND z.source IS NOT DISTINCT FROM f.source
            WHERE v > most + 1e-9 OR v < least - 1e-9
            GROUP BY rid
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND first_rule IS NULL AS kept,
               CASE WHEN n_words < 50 THEN 'few_words' WHEN base_failed THEN 'repetition' ELSE ['word_length', 'symbols', 'dup_lines', 'repeats'][first_rule] END AS failed_rule
        FROM y LEFT JOIN j USING (rid)
    """,
    "op8_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), d AS (
            SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS keeper
            FROM p
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
        FROM d
    """,
    "op11_shared_strings": """
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
        ), s AS (
            SELECT rid, unnest(range(0, CAST(len(h) // 2 AS BIGINT) - 399, 1024)) AS base FROM d WHERE len(h) >= 800
        ), c AS (
            SELECT rid, base, array_slice(h, 2 * base + 1, 2 * base + 2 * (1023 + 400)) AS part FROM s JOIN d USING (rid)
        ), w AS (
            SELECT rid, base + o AS pos, md5(array_slice(part, 2 * o + 1, 2 * o + 800)) AS win FROM (SELECT rid, base, part, unnest(range(0, CAST(len(part) // 2 AS BIGINT) - 399)) AS o FROM c)
        ), r AS (
            SELECT rid, pos FROM w WHERE win IN (SELECT win FROM w GROUP BY win HAVING count(*) > 1)
        ), e AS (
            SELECT rid, pos, lag(pos) OVER (PARTITION BY rid ORDER BY pos) AS before FROM r
        ), g AS (
            SELECT rid, pos, sum(CASE WHEN before IS NULL OR pos > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY pos) AS run FROM e
        ), gone AS (
            SELECT rid, run, min(pos) AS a, max(pos) + 400 AS b FROM g GROUP BY rid, run
        ), gap AS (
            SELECT d.rid, doc_id, h, coalesce(b, 0) AS a, coalesce(lead(a) OVER (PARTITION BY d.rid ORDER BY a), len(h) // 2) AS b, a AS run_from, b AS run_to
            FROM d LEFT JOIN gone USING (rid)
        ), k AS (
            SELECT rid, string_agg(array_slice(h, 2 * a + 1, 2 * b), '' ORDER BY a) AS rest, min(run_from) AS head, count(run_from) AS n_spans, coalesce(sum(run_to - run_from), 0) AS n_removed
            FROM gap GROUP BY rid
        )
        SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans,
               sha256(unhex(CASE WHEN head > 0 THEN array_slice(h, 1, 2 * head) ELSE '' END || rest)) AS kept_sha256
        FROM d JOIN k USING (rid)
    """,
    "op12_ranked_search": """
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, list_transform(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
                   lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents WHERE text IS NOT NULL
        ), i AS (
            SELECT item_id, unnest(list_transform(regexp_extract_all(min(text), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
                   lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM benchmark GROUP BY item_id
        ), q AS (
            SELECT item_id, term, count(*) AS times FROM i GROUP BY item_id, term
        ), c AS (
            SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0
        ), p AS (
            SELECT rid, doc_id, len(terms) AS size, unnest(terms) AS term FROM d
        ), f AS (
            SELECT rid, doc_id, size, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY rid, doc_id, size, term
        ), w AS (
            SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), c
        ), v AS (
            SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * n) // l))) AS v FROM f JOIN w USING (term), c
        ), s AS (
            SELECT item_id, rid, doc_id, CAST(sum(times * v) AS BIGINT) AS score FROM q JOIN v USING (term) GROUP BY item_id, rid, doc_id
        ), r AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
        )
        SELECT * FROM r WHERE rank <= 10
    """,
    "op13_repaired_conversations": """
        WITH RECURSIVE o AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
            FROM conversations
        ), f AS (
            SELECT *, md5(role || ':' || text) AS tie,
                   xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST((ascii(ch) >> k) & 1 AS BIGINT) for k in range(8)] for ch in string_split(key, '')])),
                       lambda c, b: xor(c >> 1, CAST(3988292384 AS BIGINT) * (xor(c, b) & 1))), CAST(4294967295 AS BIGINT)) % 20 AS fate
            FROM o
        ), d AS (
            SELECT conv_id, turn, tie, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
            FROM f WHERE fate <> 0
        ), n AS (
            SELECT coalesce(CAST(conv_id AS VARCHAR), '-') AS c, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tie, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM d
        ), t AS (
            SELECT *, left(role, 1) AS r, left(lag(role) OVER (PARTITION BY c ORDER BY i), 1) || left(role, 1) AS pair, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
                   row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut
            FROM n
        ), a AS (
            SELECT *, blank OR again AS gone, CASE WHEN cut AND NOT blank AND NOT again THEN 3 ELSE 0 END AS extra FROM t
        ), g AS (
            SELECT c, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, CAST(coalesce(sum(extra) // 3, 0) AS BIGINT) AS truncated,
                   count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
            FROM a GROUP BY c
        ), b AS (
            SELECT c, i + 1 AS i, CAST([0, 6, 3, 0] AS BIGINT[]) AS v FROM a WHERE i = n
            UNION ALL
            SELECT c, i, CAST([least(z[1], z[3] + 3), least(z[2], z[3] + 3), least(z[3], z[4] + 3), least(z[4], z[3] + 3)] AS BIGINT[]) AS v FROM (
                SELECT b.c, a.i, CASE WHEN gone THEN [v[1] + 4, v[2] + 4, v[3] + 4, v[4] + 4] ELSE [
                    least(v[1] + 4, v[3] + extra + CASE WHEN r = 'u' THEN 0 ELSE 3 END, v[2] + extra + CASE WHEN r = 's' THEN 0 ELSE 1000 END),
                    least(v[2] + 4, v[3] + extra + CASE WHEN r = 'u' THEN 0 ELSE 3 END), least(v[3] + 4, v[4] + extra + CASE WHEN r = 'a' THEN 0 ELSE 3 END),
                    least(v[4] + 4, v[3] + extra + CASE WHEN r = 'u' THEN 0 ELSE 3 END)] END AS z
                FROM b JOIN a ON a.c = b.c AND a.i = b.i - 1)
        ), e AS (
            SELECT c, CAST(1 AS BIGINT) AS i, 1 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS lines, CAST('' AS VARCHAR) AS op FROM (SELECT DISTINCT c FROM a)
            UNION ALL
            SELECT c, CASE WHEN op = 'I' THEN i ELSE i + 1 END, CASE WHEN op = 'D' THEN q WHEN op = 'K' AND r = 's' THEN 2 WHEN q = 3 THEN 4 ELSE 3 END, audit || op,
                   CASE op WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'R' THEN list_append(lines, due || ':' || text) ELSE list_append(lines, due || ':') END, op
            FROM (
                SELECT e.c, e.i, e.q, e.audit, e.lines, a.r, a.role, a.text, CASE WHEN e.q = 3 THEN 'assistant' ELSE 'user' END AS due,
                       CASE WHEN a.i IS NOT NULL AND y.v[e.q] + 4 = x.v[e.q] THEN 'D' WHEN x.v[CASE WHEN e.q = 3 THEN 4 ELSE 3 END] + 3 = x.v[e.q] THEN 'I'
                            WHEN r = 's' AND e.q = 1 AND y.v[2] + extra = x.v[e.q] OR r = 'u' AND e.q <> 3 AND y.v[3] + extra = x.v[e.q] OR r = 'a' AND e.q = 3 AND y.v[4] + extra = x.v[e.q] THEN 'K'
                            ELSE 'R' END AS op
                FROM e JOIN b x ON x.c = e.c AND x.i = e.i LEFT JOIN a ON a.c = e.c AND a.i = e.i LEFT JOIN b y ON y.c = e.c AND y.i = e.i + 1
                WHERE a.i IS NOT NULL OR x.v[e.q] > 0)
        ), z AS (
            SELECT e.c, audit, lines FROM e JOIN b ON b.c = e.c AND b.i = e.i LEFT JOIN a ON a.c = e.c AND a.i = e.i WHERE a.i IS NULL AND b.v[e.q] = 0
        ), x AS (
            SELECT c, v[1] AS cost FROM b WHERE i = 1
        )
        SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN g ON g.c = coalesce(CAST(k.conv_id AS VARCHAR), '-') LEFT JOIN x ON x.c = g.c LEFT JOIN z ON z.c = g.c
    """,
}
