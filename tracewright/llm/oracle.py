"""DuckDB SQL of the queries that SQL can express."""

from .licenses import BASE, TEMPLATES, postings

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first_id FROM d GROUP BY hex)
SELECT d.page_id, d.payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(d.hex, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN d.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id = f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM d JOIN f USING (hex)
"""

OP4 = r"""
WITH lowered AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM lowered),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit_words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(len(w), 5) - 1], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least_id AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_id USING (doc_id)
"""

OP10 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (k) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""



def licences() -> str:
    """The licence scan in SQL: words by place, key phrases, and the weights of words that agree on a template's place."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    base = ", ".join(f"('{label}', {quoted(phrase.split())})" for phrase, label in BASE)
    keys = ", ".join(f"({k}, '{label}', {first}, {quoted(phrase)})" for k, (label, _, first, phrase) in enumerate(TEMPLATES))
    index = ", ".join(f"('{w}', {k}, {i})" for w, k, i in postings())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
base(label, phrase) AS (VALUES {base}), keys(k, label, first, phrase) AS (VALUES {keys}), idx(word, k, i) AS (VALUES {index}),
x AS (SELECT row, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
b AS (SELECT x.row, x.p, label FROM x JOIN base ON x.word = phrase[1] JOIN d ON d.row = x.row WHERE d.w[p + 1:p + len(phrase)] = phrase),
v AS (SELECT x.row, x.p - first AS place, k, label FROM x JOIN keys ON x.word = phrase[1] JOIN d ON d.row = x.row WHERE d.w[p + 1:p + len(phrase)] = phrase),
df AS (SELECT word, count(DISTINCT row) AS n FROM x WHERE word IN (SELECT word FROM idx) GROUP BY word),
weight AS (SELECT DISTINCT idx.word, ln(((SELECT count(*) FROM d) + 1) / (coalesce(df.n, 0) + 1)) + 0.05 AS idf FROM idx LEFT JOIN df ON df.word = idx.word),
whole AS (SELECT k, sum(idf) AS total FROM idx JOIN weight ON weight.word = idx.word GROUP BY k),
agreed AS (SELECT x.row, idx.k, x.p - idx.i AS place, sum(idf) AS s FROM x JOIN idx ON idx.word = x.word JOIN weight ON weight.word = x.word
           JOIN v ON v.row = x.row AND v.k = idx.k AND v.place = x.p - idx.i GROUP BY ALL),
best AS (SELECT row, max(least(s / total, 1.0)) AS score FROM agreed JOIN whole USING (k) GROUP BY row),
places AS (SELECT row, count(*) AS n, min(p) AS low, max(p) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY row),
every AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM b UNION ALL SELECT row, label FROM v) GROUP BY row)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_base, CAST(low AS BIGINT) AS first_word, CAST(high AS BIGINT) AS last_word,
       coalesce(places.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM d LEFT JOIN places USING (row) LEFT JOIN every USING (row) LEFT JOIN best USING (row)
"""


ORACLE: dict[str, str] = {
    "op6_rare_token_licences": licences(),
    "op2_warc_archives": OP2,
    "op4_suffix_automaton_decontamination": OP4,
    "op7_ngram_jaccard_join": OP7,
    "op10_repeated_passages": OP10,
}
