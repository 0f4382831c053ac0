"""The queries of this package, and their SQL where SQL can express them."""

from .bpe import op6_bpe, op8_token_counts
from .divergence import op13_divergence
from .extract import op7_html_text
from .fingerprint import op3_fingerprint
from .langid import op4_langid
from .lm import op2_lm_score
from .mixing import op1_mix
from .negatives import op11_hard_negatives
from .ngram_join import op5_ngram_join
from .quality import op9_quality
from .sentencepiece import op12_sentencepiece
from .warc import op10_warc

QUERIES = {
    "op1_mix": op1_mix,
    "op2_lm_score": op2_lm_score,
    "op3_fingerprint": op3_fingerprint,
    "op4_langid": op4_langid,
    "op5_ngram_join": op5_ngram_join,
    "op6_bpe": op6_bpe,
    "op7_html_text": op7_html_text,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_divergence": op13_divergence,
}

ORACLES = {
    "op9_quality": r"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d)),
        r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) >= 2),
        c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2, 3, 4]) AS j FROM r) GROUP BY 1),
        m AS (SELECT d.*, len(w) AS n_words, coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN c USING (doc_id)),
        ln AS (SELECT doc_id, source, text, lower(regexp_replace(trim(x), '[\x20\x09-\x0D0-9]+', ' ', 'g')) AS line, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, source, text, unnest(l) AS x FROM d)),
        h AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY 1),
        o AS (SELECT ln.source, line FROM ln JOIN h ON ln.source IS NOT DISTINCT FROM h.source GROUP BY ln.source, line, docs HAVING count(DISTINCT ln.doc_id) > 20 AND count(DISTINCT ln.doc_id) > 0.05 * docs),
        x AS (SELECT doc_id, sum(n) AS n FROM ln JOIN o ON ln.source IS NOT DISTINCT FROM o.source AND ln.line = o.line GROUP BY 1)
        SELECT doc_id, n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
               len(l) - len(list_distinct(l)) AS n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - coalesce(x.n, 0) >= 10 AND n_words - coalesce(x.n, 0) >= 0.2 * n_words AS kept, CAST(n_words - coalesce(x.n, 0) AS BIGINT) AS words_left
        FROM m LEFT JOIN x USING (doc_id)""",
    "op10_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
        g AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < top THEN top END AS refers_to
        FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000""",
    "op11_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
              FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op13_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY 1, 2, 3),
        k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
        l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY 1),
        g AS (SELECT DISTINCT lang, source FROM d),
        t AS (SELECT lang, source, sum(c.n) AS words FROM c JOIN k USING (lang, term) GROUP BY 1, 2),
        s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(t.words, 0) + 2 * l.v) AS p, 1 + (1000000000 * (k.n + 2)) // (l.total + 2 * l.v) AS q
              FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM s WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o) WHERE part = 'pair' OR rank <= 10""",
}
