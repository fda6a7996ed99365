"""SQL for DuckDB that gives the rows of those training-data queries which SQL can state: brute force over whole tables."""

from __future__ import annotations

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

#: Bytes are pairs of hexadecimal digits, so a string of 50 bytes is a substring of 100 digits.
SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, unnest(range(n - 49)) AS i, h FROM d WHERE n >= 50),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS k FROM w),
f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY 1),
s AS (SELECT doc_id, i FROM k JOIN f USING (k) WHERE doc_id > first),
r AS (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM s),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY 1, 2),
cut AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
kept AS (SELECT d.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(max(h), 2 * max(b) + 1) AS h, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM cut JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

WINDOWS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, unnest(range(len(w) - 12)) AS i, w FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 13], ' ')) AS k FROM k),
f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY 1),
s AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM h JOIN f USING (k) WHERE doc_id > first),
g AS (SELECT doc_id, list(i) AS gone FROM s GROUP BY 1),
u AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS text FROM u ANTI JOIN s ON s.doc_id = u.doc_id AND s.i = u.i GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(sh, ' ')) AS sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i : i + 4]) END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)"""

#: The table of crc32 by its rule, and the checksum of a list of bytes.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list(list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n))"
_CRC = "xor(list_reduce(list_concat([4294967295], {}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, levels: int) -> str:
    """Levels of the trees over {name}0 (g, i, n, node), and the siblings of every node, as common tables."""
    out = []
    for k in range(levels):
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, i // 8 AS i, (max(n) + 7) // 8 AS n, CASE WHEN max(n) = 1 THEN max(node) ELSE sha256(string_agg(node, '' ORDER BY i)) END AS node FROM {name}{k} GROUP BY g, i // 8)")
        out.append(f"{name}s{k} AS MATERIALIZED (SELECT a.g, a.i, max(a.n) AS n, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r FROM {name}{k} a JOIN {name}{k} b ON a.g = b.g AND a.i // 8 = b.i // 8 GROUP BY 1, 2)")
    return ",\n".join(out)


def _fold(name: str, tree: str, levels: int) -> str:
    return ",\n".join(f"{name}{k + 1} AS (SELECT p.* EXCLUDE (i, proof, h), p.i // 8 AS i, proof || l || r AS proof, CASE WHEN s.n = 1 THEN h ELSE sha256(l || h || r) END AS h FROM {name}{k} p JOIN {tree}s{k} s ON s.g = p.g AND s.i = p.i)" for k in range(levels))


#: Trees of up to 8 ** 10 leaves, and of up to 8 ** 4 languages.
_DEEP, _WIDE = 10, 4
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"
MANIFEST = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF.format(_FIELD.format("text"))} AS leaf, {_LEAF.format(_FIELD.format(_LOWERED.format("text")))} AS low,
  coalesce({_CRC.format("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c))")} % 3 = 0, false) AS touched FROM documents, crc),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
a0 AS (SELECT g, i, n, leaf AS node FROM o),
{_tree("a", _DEEP)},
t0 AS MATERIALIZED (SELECT '' AS g, g AS lang, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, node FROM a{_DEEP}),
{_tree("t", _WIDE)},
p0 AS (SELECT doc_id, leaf, g, i, '' AS proof, CASE WHEN touched THEN low ELSE leaf END AS h FROM o),
{_fold("p", "a", _DEEP)},
q0 AS (SELECT doc_id, leaf, node AS subroot, t0.g, t0.i, proof, h FROM p{_DEEP} p JOIN t0 ON t0.lang = p.g),
{_fold("q", "t", _WIDE)}
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = node AS verified FROM q{_WIDE} JOIN t{_WIDE} USING (g)"""

_TOKENS = f"regexp_extract_all({_LOWERED.format('coalesce(text, {})')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format("''")
_HEX = "(instr('0123456789abcdef', lower(substr({}, {}, 1))) - 1)"
_BYTES = "list_transform(range(1, 2 * strlen(word), 2), lambda i: 16 * " + _HEX.format("hex(encode(word))", "i") + " + " + _HEX.format("hex(encode(word))", "i + 1") + ")"
_DRAW = "list_reduce(list_transform(range(1, 9), lambda i: " + _HEX.format("digest", "i") + "), lambda a, b: 16 * a + b)"
IMPORTANCE = f"""
WITH {_CRC_TABLE},
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TOKENS} AS w, sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')) AS digest FROM documents),
own AS MATERIALIZED (SELECT r, unnest(w) AS word FROM d),
target AS MATERIALIZED (SELECT unnest({_TOKENS}) AS word FROM benchmark),
buckets AS MATERIALIZED (SELECT word, ({_CRC.format(_BYTES)} % 10000)::BIGINT AS b FROM (SELECT word FROM own UNION SELECT word FROM target), crc),
s AS (SELECT b, count(*) AS s FROM own JOIN buckets USING (word) GROUP BY 1),
t AS (SELECT b, count(*) AS t FROM target JOIN buckets USING (word) GROUP BY 1),
gains AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM own) + 10000)) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM target) + 10000))))::BIGINT AS gain FROM range(10000) x(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
sums AS (SELECT r, sum(gain)::BIGINT AS weight FROM own JOIN buckets USING (word) JOIN gains USING (b) GROUP BY 1),
scored AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(({_DRAW} + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN sums USING (r)),
able AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM scored LEFT JOIN able USING (r)"""

ARCHIVES = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY 1),
r AS (SELECT p.*, first, row_number() OVER (PARTITION BY p.d ORDER BY page_id) AS k FROM p LEFT JOIN f ON f.d = p.d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND k > 1 THEN first END AS refers_to FROM r"""

ORACLE_SQL = {"op13_warc_conversion": ARCHIVES, "op12_importance_resampling": IMPORTANCE, "op11_merkle_manifest": MANIFEST, "op3_suffix_array_dedup": SUBSTRINGS, "op5_count_min_dedup": WINDOWS, "op10_jaccard_join": NEAR_DUPLICATES}
